"""Secret scans in SQL expressions alone: fixed patterns, and sliding-window entropy.

Patterns find what looks like an assignment of a credential, an access key or a long hex
number. Beyond them, candidate strings (long runs of key characters that mix letters and
digits) are measured: Shannon entropy over a sliding window, kept up to date by one count
that goes up and one that goes down a step, against a threshold for the candidate's character
class. What an allow-list names (digest labels, UUIDs, placeholders) is not reported, unless
a pattern found it. Everything is a row-wise expression: no shuffle, no Python.

Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (pattern, group that counts, least length of that group), in the order of the kinds
PATTERNS = {
    "assign": (r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),  # maximal runs: the same spans as [0-9a-f]+ with the short ones dropped
}
#: Words of which a text needs one for the pattern to match anywhere; cheap to look for.
NEEDS = {"assign": ("password", "passwd", "secret", "token", "apikey", "api_key"), "access": ("akia",), "hex": ()}

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: class -> (pattern of the whole candidate, window, least bits a character in some window)
CLASSES = {
    "hexadecimal": (r"^[0-9A-Fa-f]+$", 20, 3.0),
    "base32": (r"^[A-Z0-9=]+$", 20, 3.5),
    "base64": (r"^[A-Za-z0-9+/_=-]+$", 20, 3.8),
}
WIDEST = max(window for _, window, _ in CLASSES.values())
LOWEST, SLOTS = ord("+"), ord("z") - ord("+") + 1  # the characters of candidates
ALLOWED = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|sample|placeholder|dummy|changeme|your[_-]",
    r"(?i)^(sha|md5)[0-9]*[-=_]",
    r"(?i)0123456789|abcdefghij",
)
ENTROPY = "entropy"
SPAN = "array<struct<start:int,kind:int,end:int>>"


def located(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches, those with too short a group dropped."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.split(text, pattern, -1)
    rows = F.arrays_zip(hits.alias("hit"), groups.alias("group"), F.slice(between, 1, F.size(hits)).alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc, row):
        begin = acc["at"] + F.length(row["gap"])
        end = begin + F.length(row["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        more = F.concat(acc["spans"], F.array(span))
        return F.struct(end.alias("at"), F.when(F.length(row["group"]) >= least, more).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(rows, start, step, lambda acc: acc["spans"])


def pattern_spans(text: Column) -> Column:
    """All spans of `PATTERNS`, by start, then kind."""
    low, found = F.lower(text), []
    for k, (name, (pattern, group, least)) in enumerate(PATTERNS.items()):
        spans = located(text, pattern, k, group, least)
        possible = F.lit(False)
        for w in NEEDS[name]:
            possible = possible | F.contains(low, F.lit(w))
        if not NEEDS[name]:
            possible = text.rlike(pattern)
        found.append(F.when(possible, spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def dense_part(word: Column, window: Column, most: Column) -> Column:
    """(first, last) start of a window of `word` whose sum of c * log2 c is at most `most`; -1 if none.

    c are the counts of the characters in the window. A window moves by two steps: one count goes
    down, one goes up, each a single replaced place, so the time is linear in the word. The word is
    of candidate characters, taken apart once.
    """
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) - LOWEST)
    part = F.lit([0.0, *[c * math.log2(c) for c in range(1, WIDEST + 1)]])
    start = F.struct(
        F.array_repeat(F.lit(0), SLOTS).alias("counts"), F.lit(0.0).cast("double").alias("total"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"),
    )

    def moved(b):
        def step(acc, j):
            up, at = j % 2 == 1, F.shiftright(j, 1)
            slot = F.get(b["codes"], F.when(up, at).otherwise(at - b["window"]))
            count, change = F.get(acc["counts"], slot), F.when(up, 1).otherwise(-1)
            put = F.concat(F.slice(acc["counts"], 1, slot), F.array(count + change), F.slice(acc["counts"], slot + 2, SLOTS))
            hit = ~up & (at >= b["window"]) & (acc["total"] <= b["most"])  # of the window that ends before `at`
            total = acc["total"] + F.get(part, count + change) - F.get(part, count)
            return F.struct(
                F.when(slot.isNull(), acc["counts"]).otherwise(put).alias("counts"),
                F.when(slot.isNull(), acc["total"]).otherwise(total).alias("total"),
                F.when(hit & (acc["first"] < 0), at - b["window"]).otherwise(acc["first"]).alias("first"),
                F.when(hit, at - b["window"]).otherwise(acc["last"]).alias("last"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.size(b["codes"]) * 2), start, step, lambda a: F.struct(a["first"], a["last"]))

    bound = F.struct(codes.alias("codes"), window.alias("window"), most.alias("most"))
    return F.transform(F.array(bound), moved)[0]


def entropy_spans(text: Column) -> Column:
    """Spans of the dense parts of the candidates that the allow-list does not name."""
    kind = len(PATTERNS)

    def measured(found):
        word, begin = found["word"], found["span"]["start"]
        window = most = None
        for pattern, size, bits in CLASSES.values():
            fits, limit = word.rlike(pattern), size * (math.log2(size) - bits) + 1e-9
            window = F.when(fits, size) if window is None else window.when(fits, size)
            most = F.when(fits, limit) if most is None else most.when(fits, limit)
        allowed = F.lit(False)
        for pattern in ALLOWED:
            allowed = allowed | word.rlike(pattern)
        mixed = word.rlike("[0-9]") & word.rlike("[A-Za-z]")
        return F.when(mixed & ~allowed, F.transform(
            F.array(F.struct(dense_part(word, window, most).alias("dense"), window.alias("window"))),
            lambda r: F.struct(
                (begin + r["dense"]["first"]).alias("start"), F.lit(kind).alias("kind"),
                F.when(r["dense"]["first"] >= 0, begin + r["dense"]["last"] + r["window"]).alias("end"),
            ),
        )[0])

    words = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.arrays_zip(located(text, CANDIDATE, kind).alias("span"), words.alias("word"))
    spans = F.filter(F.transform(both, measured), lambda s: s["end"].isNotNull())
    return F.when(text.rlike(CANDIDATE), spans).otherwise(F.array().cast(SPAN))


def as_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*PATTERNS, ENTROPY)])
    one = lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def scan_secrets(df: DataFrame, text: str = "text", base: str = "base_spans", spans: str = "secret_spans") -> DataFrame:
    """`df` with two arrays of (start, kind number, end): pattern spans, and all spans.

    Row by row. Null or empty texts have none; equal texts have equal spans; an empty table
    stays empty; input columns named like an output are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    return (
        df.drop(base, spans)
        .withColumn(base, pattern_spans(whole))
        .withColumn(spans, F.array_sort(F.concat(F.col(base), entropy_spans(whole))))
    )


def redacted(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """`text` with every stretch that spans cover replaced by `mask`; overlapping spans become one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc, s):
        begin = F.greatest(s["start"], acc["at"])
        piece = F.concat(F.substring(text, acc["at"] + 1, begin - acc["at"]), F.lit(mask))
        joined = F.when((s["start"] < acc["at"]) & (F.size(acc["parts"]) > 0), acc["parts"]).otherwise(
            F.concat(acc["parts"], F.array(piece))
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), joined.alias("parts"))

    def finish(acc):
        rest = F.substring(text, acc["at"] + 1, F.length(text))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, finish))
