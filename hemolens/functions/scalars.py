"""Names, labels, thresholds and seeds as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hemolens.functions.draws import draw_index


def run_name(peptide_id: Column, n: Column) -> Column:
    return F.concat(F.lower(peptide_id), F.lit("_run_"), n.cast("string"))


def whole_number(token: Column, kind: str = "int") -> Column:
    """The integer a text spells, else null; only texts that look like one reach the cast,
    because a failing cast costs an exception per row."""
    return F.when(token.rlike(r"^\s*[+-]?\d+\s*$"), token).try_cast(kind)


def parse_run_name(name: Column, sep: str = "_") -> Column:
    """Integer after the last separator, else null."""
    return whole_number(F.substring_index(name, sep, -1))


def log_hc50(hc50_um: Column) -> Column:
    return F.when(hc50_um > 0, F.log10(hc50_um))


def idp_flag(mean_plddt: Column, threshold: float = 70.0) -> Column:
    return F.coalesce(mean_plddt < threshold, F.lit(False))


def is_toxic(hc50_um: Column, threshold: float = 100.0) -> Column:
    """1 at or under the threshold; a missing HC50 stays null."""
    return (hc50_um <= threshold).cast("int")


def hc50_band(hc50_um: Column, toxic_max: float = 50.0, nontoxic_min: float = 250.0) -> Column:
    return (
        F.when(hc50_um <= toxic_max, "toxic")
        .when(hc50_um >= nontoxic_min, "nontoxic")
        .when(hc50_um.isNotNull(), "borderline")
    )


def flag_high_toxicity(hc50_um: Column, threshold: float = 10.0) -> Column:
    return hc50_um < threshold


def rbc_critical(ads: Column, insert: Column, barrier: Column) -> Column:
    """Strong adsorption together with easy insertion or a low barrier (kJ/mol)."""
    return (ads < -8) & ((insert <= -3) | (barrier < 12))


def n_steps(time: Column, dt: Column) -> Column:
    """Whole steps of `dt` in `time`, truncated; both in the same unit."""
    return (time / dt).cast("long")


def n_steps_ns(time_ns: Column, dt_ps: Column) -> Column:
    return n_steps(time_ns * 1000.0, dt_ps)


def crc_seed(*parts: Column, sep: str = "|") -> Column:
    """crc32 of the joined UTF-8 text, as an unsigned 32-bit value."""
    return F.crc32(F.concat_ws(sep, *[p.cast("string") for p in parts]).cast("binary"))


def placement_seed(peptide_id: Column, n: Column, label: Column, replicate: Column) -> Column:
    return crc_seed(peptide_id, n, label, F.concat(F.lit("rep"), replicate.cast("string")))


def umbrella_seed(peptide_id: Column, replicate: Column, window: Column) -> Column:
    rep = F.concat(F.lit("rep"), replicate.cast("string"))
    return crc_seed(peptide_id, rep, F.concat(F.lit("umbrella"), window.cast("string")), sep="_")


def orientation_angle(orientation: Column, system: Column | None = None, drawn: Column | None = None) -> Column:
    """Named tilt in degrees; any other is `drawn`, or without it one of 0/45/90 from an md5 stream of `system`."""
    o = F.lower(F.coalesce(orientation, F.lit("random")))
    other = drawn if drawn is not None else draw_index(3, system, F.lit("tilt")) * 45.0
    return (
        F.when(o == "parallel", 0.0)
        .when(o.isin("45", "tilt45", "tilt_45"), 45.0)
        .when(o.isin("perpendicular", "orthogonal", "90"), 90.0)
        .otherwise(other)
    )


def occupancy_count(level: Column, override: Column | None = None, levels: dict[str, int] | None = None) -> Column:
    levels = levels or {"low": 8, "medium": 12, "high": 16}
    named = F.coalesce(*[F.when(level == k, F.lit(v)) for k, v in levels.items()])
    return named if override is None else F.when(override > 0, override).otherwise(named)


def occupancy_label(level: Column, override: Column | None = None) -> Column:
    if override is None:
        return level
    return F.when(override > 0, F.concat(F.lit("n"), override.cast("string"))).otherwise(level)


def replicate_tag(label: Column, replicate: Column, replicates: Column | int) -> Column:
    many = (F.lit(replicates) if isinstance(replicates, int) else replicates) > 1
    return F.when(many, F.concat(label, F.lit("_rep"), replicate.cast("string"))).otherwise(label)


def normalize_patch(value: Column, area_nm2: Column) -> Column:
    return F.try_divide(value.cast("double"), area_nm2.cast("double"))
