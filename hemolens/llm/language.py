"""Language identification by Bayesian fusion of the text, the declared language and the host.

The text gives a likelihood under byte-trigram models, one a language, counted over all rows
by their declared language; an extra class, `und`, is uniform over trigrams. The declared
markup language counts by how often it is declared for texts of each language. The prior comes
from the host: votes of all its texts, smoothed by those of its address suffix, which are
smoothed by those of all rows. Votes are grouped sums, so a host with a third of the rows is no
special case, and the table of hosts is joined, not broadcast by force.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.llm.common import attach
from hemolens.session import cut_lineage

BINS = 1 << 14
NONE = "und"


def trigram_bins(raw: bytes) -> np.ndarray:
    """Bins of the byte trigrams of a lower-cased text with runs of white space as one space."""
    a = np.frombuffer(b" %s " % b" ".join(raw.lower().split()), np.uint8).astype(np.uint32)
    tri = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
    return ((tri * np.uint32(2654435761)) >> np.uint32(18)).astype(np.int64)


def letters(text: str) -> bool:
    return any(map(str.isalpha, text))


def trigram_counts(df: DataFrame, label: str, text: str) -> DataFrame:
    """(label, bin, n) over all rows with a label."""

    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if t and name is not None:
                    if name not in total:
                        total[name] = np.zeros(BINS, np.int64)
                    bins = trigram_bins(t.encode("utf-8", "surrogatepass"))
                    total[name] += np.bincount(bins, minlength=BINS)
        for name, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(n[at])], ["label", "bin", "n"])

    return df.select(F.col(label).alias("label"), F.col(text).alias("text")).mapInArrow(run, "label string, bin long, n long").groupBy("label", "bin").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Trigram log-probabilities: the languages' and, last, the uniform one of `und`."""

    def __init__(self, rows: list, most: int = 256):
        self.names = [*sorted({r[0] for r in rows}), NONE]
        if len(self.names) > most:
            raise ValueError(f"{len(self.names)} declared languages; give `languages` to choose among them")
        n = np.zeros((BINS, len(self.names) - 1))
        where = {name: k for k, name in enumerate(self.names)}
        for name, b, c in rows:
            n[b, where[name]] = c
        log = np.log(n + 0.05) - np.log(n.sum(0) + 0.05 * BINS)
        self.log = np.concatenate([log, np.full((BINS, 1), -math.log(BINS))], 1)

    def score(self, text: str | None, scale: float) -> list[float]:
        """Log-likelihoods by name; trigrams overlap, so their sum is divided by `scale`."""
        if not letters(text or ""):
            return [0.0] * (len(self.names) - 1) + [1e3]
        raw = text.encode("utf-8", "surrogatepass")
        return (self.log[trigram_bins(raw)].sum(0) / scale).tolist()


def page_parts(url: Column) -> tuple[Column, Column]:
    """(host, suffix) of an address; the suffix is what follows the last dot of the host."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    return host, F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)


def markup_language(html: Column) -> Column:
    """Language that `<html lang=..>` declares, without its region; null if there is none."""
    found = F.lower(F.regexp_extract(html, r"""(?i)<html\b[^>]*\blang\s*=\s*["']?([a-zA-Z]{2,3})\b""", 1))
    return F.when(found != "", found)


def identify(
    df: DataFrame, text: str = "text", declared: Column | None = None, host: Column | None = None,
    suffix: Column | None = None, languages: list[str] | None = None, least: float = 0.5, strength: float = 10.0,
    scale: float = 3.0, unknown: float = 0.01,
) -> DataFrame:
    """`df` with `text_language`, `language`, `language_posterior` and `language_kept`.

    `declared`, `host` and `suffix` are columns over `df`; nulls in them are no evidence. The
    inventory is the declared codes of two or three letters (or `languages`); what follows a hyphen or
    low line in a code (a region, a script) is left out. A text without a
    letter is `und`; null and empty texts are. `language_kept` is false for `und` and for a
    posterior under `least`. Ties go to the first name. Repeated rows get equal results, an
    empty table an empty one, and input columns named like an output are replaced.
    """
    null = F.lit(None).cast("string")
    df = df.drop("text_language", "language", "language_posterior", "language_kept").withColumns({
        "_lid_said": F.regexp_extract(F.lower(declared if declared is not None else null), "^([a-z]{2,3})([-_][a-z0-9]+)*$", 1),
        "_lid_host": F.coalesce(host if host is not None else null, F.lit("")),
        "_lid_suffix": F.coalesce(suffix if suffix is not None else null, F.lit("")),
    })
    ok = ~F.col("_lid_said").isin("", NONE)
    if languages:
        ok = ok & F.col("_lid_said").isin(languages)
    df = df.withColumn("_lid_said", F.when(ok, F.col("_lid_said")))
    counts = trigram_counts(df, "_lid_said", text)
    model = LanguageModel([tuple(r) for r in counts.collect()])  # at most 256 languages times BINS rows
    names, size = model.names, len(model.names)
    scored = attach(df, "_lid_log array<double>", lambda: lambda b: [[model.score(t, scale) for t in b.column(text).to_pylist()]])
    name = F.array(*map(F.lit, names))
    by_text = name[(F.array_position("_lid_log", F.array_max("_lid_log")) - 1).cast("int")]
    votes = cut_lineage(
        scored.groupBy("_lid_host", "_lid_suffix", "_lid_said", by_text.alias("vote")).agg(F.count("*").alias("n"))
    )
    sure = votes.filter(F.col("vote") != NONE)
    overall = {r[0]: r[1] for r in sure.groupBy("vote").agg(F.sum("n")).collect()}
    rows = sum(overall.values())
    base = [(1 - unknown) * (overall.get(x, 0) + 1) / (rows + size - 1) for x in names[:-1]] + [unknown]
    said = {(r[0], r[1]): r[2] for r in sure.groupBy("_lid_said", "vote").agg(F.sum("n")).collect()}
    reliable = {}
    for d in names[:-1]:
        of = [(said.get((d, x), 0) + 1) / (overall.get(x, 0) + size) for x in names[:-1]]
        reliable[d] = [math.log(p) for p in [*of, sum(of) / max(len(of), 1) if of else 1.0]]

    def voted(keys: list[str]) -> DataFrame:
        per = sure.groupBy(*keys, "vote").agg(F.sum("n").alias("n"))
        by = F.map_from_entries(F.collect_list(F.struct("vote", "n")))  # one entry a language
        return per.groupBy(*keys).agg(by.alias("by"))

    def shares(prior: Column) -> Column:
        n = F.array(*[F.coalesce(F.col("by")[x], F.lit(0)) for x in names])
        total = F.coalesce(F.aggregate(F.map_values("by"), F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0))
        return F.transform(prior, lambda p, k: (F.get(n, k) + strength * p) / (total + strength))

    table = votes.select("_lid_suffix", "_lid_host").distinct()
    table = table.join(voted(["_lid_suffix"]), "_lid_suffix", "left")
    table = table.withColumn("_lid_p1", shares(F.array(*map(F.lit, base)))).drop("by")
    table = table.join(voted(["_lid_suffix", "_lid_host"]), ["_lid_suffix", "_lid_host"], "left")
    table = table.withColumn("_lid_p2", shares(F.col("_lid_p1"))).drop("by")
    hosts = cut_lineage(table.select("_lid_suffix", "_lid_host", F.col("_lid_p2").alias("_lid_prior")))
    claims = F.create_map(*[x for d, v in reliable.items() for x in (F.lit(d), F.array(*map(F.lit, v)))]) if reliable else None
    joined = scored.join(hosts, ["_lid_suffix", "_lid_host"], "left")
    claim = F.coalesce(claims[F.col("_lid_said")], F.array_repeat(F.lit(0.0), size)) if claims is not None else F.array_repeat(F.lit(0.0), size)
    joined = joined.withColumn("_lid_claim", claim).withColumn(
        "_lid_sum",
        F.transform("_lid_log", lambda x, k: x + F.log(F.coalesce(F.get("_lid_prior", k), F.lit(1.0))) + F.get("_lid_claim", k)),
    )
    top = F.array_max("_lid_sum")
    weight = F.aggregate("_lid_sum", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    language = name[(F.array_position("_lid_sum", top) - 1).cast("int")]
    return joined.withColumns({
        "text_language": by_text, "language": language, "language_posterior": 1.0 / weight,
    }).withColumn(
        "language_kept", (F.col("language") != NONE) & (F.col("language_posterior") >= least)
    ).drop(*[c for c in ("_lid_said", "_lid_host", "_lid_suffix", "_lid_log", "_lid_prior", "_lid_claim", "_lid_sum")])


def identify_documents(docs: DataFrame, **how) -> DataFrame:
    """`identify` for documents: the language of their markup or else the column, the source as host."""
    declared = F.coalesce(markup_language(F.col("text")), F.col("lang"))
    return identify(
        docs, declared=declared, host=F.col("source"), suffix=F.regexp_extract("source", r"\.([a-z0-9-]+)$", 1), **how
    )


def identify_pages(pages: DataFrame, **how) -> DataFrame:
    """`identify` for raw web pages: text without markup, `<html lang>`, host and suffix of the address."""
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    host, suffix = page_parts(F.col("url"))
    found = identify(
        pages.withColumn("_bare", bare), text="_bare", declared=markup_language(F.col("html")), host=host, suffix=suffix, **how
    )
    return found.drop("_bare")
