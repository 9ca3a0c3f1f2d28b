"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each rule looks at one measure of the text and says good, bad or nothing. How far a rule can
be trusted is not given: expectation-maximisation over the counts of vote patterns estimates,
for either class, how often a rule votes each way and how common the class is. The posterior
probability of the good class then takes the place of a filter in which all rules must pass.
The vote patterns are at most 3^rules, whatever the number of documents, and their counts are
all that EM needs, so only they reach the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hemolens.llm.common import LOWER, UPPER, attach, words
from hemolens.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_distinct long, n_short long, n_capital long, n_latin long"
LETTERS, CAPITALS = UPPER + LOWER, UPPER


def repeated_words(tokens: list[bytes], size: int = 3) -> int:
    """Words standing in some window of `size` words that occurs twice or more, the first included."""
    n = len(tokens) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*[tokens[k : n + k] for k in range(size)]))
    if len(set(windows)) == n:
        return 0
    seen: dict = {}
    hit = bytearray(len(tokens))
    mark = b"\1" * size
    for i, w in enumerate(windows):
        first = seen.setdefault(w, i)
        if first != i:
            hit[first : first + size] = mark
            hit[i : i + size] = mark
    return hit.count(1)


def measures(text: str | None) -> tuple[int, ...]:
    text = text or ""
    tokens = words(text)
    seen, copies, lines = set(), 0, 0
    for line in text.split("\n"):
        if words(line):
            lines += 1
            copies += line in seen
            seen.add(line)
    raw = text.encode("utf-8", "surrogatepass")
    latin = len(raw) - len(raw.translate(None, LETTERS.encode()))
    capital = len(raw) - len(raw.translate(None, CAPITALS.encode()))
    chars = len(b"".join(tokens).decode("utf-8", "surrogatepass"))
    return (
        len(tokens), chars, sum(map(raw.count, (c.encode() for c in SYMBOLS))), copies,
        repeated_words(tokens), lines, len(set(tokens)),
        sum([len(w) < 4 and (w[0] > 127 or w[:1].isalpha()) for w in tokens]), capital, latin,
    )


def with_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """`df` with the `MEASURES` of every whole text; a null text has none of anything."""

    def make():
        return lambda batch: list(zip(*map(measures, batch.column(text).to_pylist()))) or [[]] * 10

    return attach(df, MEASURES, make)


@dataclass(frozen=True)
class Rule:
    """Votes good where `good` holds, else bad where `bad` holds, else abstains (nulls abstain)."""

    name: str
    good: Column
    bad: Column

    def vote(self) -> Column:
        return F.when(self.good, 2).when(self.bad, 0).otherwise(1)


def default_rules() -> list[Rule]:
    n = F.col("n_words")
    share = lambda c, of=n: 100.0 * F.col(c) / F.greatest(of, F.lit(1))
    mean = F.col("word_chars") / F.greatest(n, F.lit(1))
    repeats, copies, variety = share("n_repeat_words"), share("n_dup_lines", F.col("n_lines")), share("n_distinct")
    capitals, short = share("n_capital", F.col("n_latin")), share("n_short")
    return [
        Rule("length", F.lit(False), (n < 20) | (n > 100_000)),
        Rule("word_length", (mean >= 4) & (mean <= 6.2), (mean < 3) | (mean > 6.6)),
        Rule("symbols", share("n_symbols") <= 1, share("n_symbols") > 5),
        Rule("repetition", (repeats <= 10) & (copies <= 10), (repeats > 30) | (copies > 30) | ((variety < 40) & (n < 3000))),
        Rule("capitals", capitals <= 10, capitals > 30),
        Rule("short_words", short >= 12, short < 6),
    ]


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> dict:
    """EM for two classes with votes independent given the class; exact on pattern counts.

    `patterns`: (patterns, rules) of 0 bad, 1 abstain, 2 good. Starts from "any bad vote is
    bad", which also fixes which class is the good one. Rates are smoothed by one vote.
    """
    rules = patterns.shape[1]
    good = np.where((patterns == 0).any(1), 0.1, 0.9)
    onehot = (patterns[:, :, None] == np.arange(3)).astype(float)
    last = -np.inf
    for _ in range(rounds):
        weight = np.stack([counts * (1 - good), counts * good])
        prior = (weight.sum(1) + 1) / (counts.sum() + 2)
        rates = (np.einsum("cp,prv->crv", weight, onehot) + 1) / (weight.sum(1)[:, None, None] + 3)
        log = np.log(prior)[:, None] + np.einsum("prv,crv->cp", onehot, np.log(rates))
        top = log.max(0)
        total = top + np.log(np.exp(log - top).sum(0))
        good = np.exp(log[1] - total)
        likelihood = float((counts * total).sum())
        if likelihood - last < tolerance * max(1.0, abs(likelihood)):
            break
        last = likelihood
    return {"prior": prior, "rates": rates, "posterior": good, "rules": rules}


def quality_posterior(measured: DataFrame, rules: Sequence[Rule] | None = None, out: str = "quality") -> DataFrame:
    """`measured` (see `with_measures`) with `votes` (one digit a rule) and the posterior `out`.

    Fits on every row of `measured`; pass a written table, as it is read twice. Equal votes get
    equal posteriors, so ties and repeated rows agree. An empty table stays empty.
    """
    rules = list(rules or default_rules())
    voted = measured.withColumn("votes", F.concat(*[r.vote().cast("string") for r in rules]))
    table = voted.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()  # at most 3^rules rows
    if not table:
        return voted.withColumn(out, F.lit(None).cast("double"))
    fit = fit_votes(np.array([[int(c) for c in r["votes"]] for r in table]), np.array([float(r["n"]) for r in table]))
    known = F.create_map(*itertools.chain(*[(F.lit(r["votes"]), F.lit(float(p))) for r, p in zip(table, fit["posterior"])]))
    return voted.withColumn(out, known[F.col("votes")])


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def filter_quality(df: DataFrame, id_col: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """Per row of `df`: id, the measures, `votes`, `quality`, `base_failed` and `kept`.

    `kept` needs the base checks and a posterior of `least` or more. Null or empty texts have
    no words and fail; a null id is carried along; repeated rows each get their row.
    """
    measured = cut_lineage(with_measures(df.select(F.col(id_col), F.col(text)), text).drop(text))
    return (
        quality_posterior(measured)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & (F.coalesce(F.col("quality"), F.lit(0.0)) >= least))
    )
