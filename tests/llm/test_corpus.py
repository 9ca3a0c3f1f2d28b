"""Operators that look across documents: groups, repeated passages, classifiers, rollups, language models."""

import math
import pathlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hemolens import session
from hemolens.llm import components, cotraining, decontaminate, jaccard, lm, queries, recurrent, secrets, substrings, token_counts
from hemolens.llm.common import lower_words, words

SF = "/root/testdata/sf0.001"


def near_copies(seed=3, groups=6, most=14):
    rng = random.Random(seed)
    passage = " ".join(f"p{k}" for k in range(40))
    rows, i = [], 0
    for g in range(groups):
        n = rng.choice([4, 9, 12, 30, 60, 150])
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        for _ in range(rng.randrange(2, most)):
            text = list(base)
            for _ in range(rng.randrange(0, max(2, n // 25))):
                text[rng.randrange(n)] = f"e{rng.randrange(10**6)}"
            rows.append((i, " ".join(text) + (f" {passage}" if rng.random() < 0.3 else "")))
            i += 1
    rng.shuffle(rows)
    return rows


def plain_groups(rows, size=3, percent=90):
    sets = []
    for _, t in rows:
        w = lower_words(t)
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            linked = sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and (linked or rows[a][0] == rows[b][0]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        r = root(k)
        least[r] = i if r not in least or (i is not None and i < least[r]) else least[r]
    return sorted(((i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)), key=str)


def found_groups(docs):
    return sorted((tuple(r) for r in jaccard.similar_groups(docs).collect()), key=str)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(300, 200), (5, 5)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0}
    assert {got[k] for k in range(100, 160)} == {100}
    assert got[300] == got[200] == 200
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("light", [None, 0, 10_000])
def test_groups_equal_brute_force_on_both_sides_of_the_boundary(docs_of, monkeypatch, light):
    rows = near_copies()
    if light is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda *a: light)
    assert found_groups(docs_of(rows)) == plain_groups(rows)


def test_a_large_group_with_leaders(docs_of, monkeypatch):
    rng = random.Random(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(70):  # a chain: each text a few edits from the one before
        for _ in range(2):
            base[rng.randrange(120)] = f"x{i}{rng.random()}"
        rows.append((i, " ".join(base)))
    assert found_groups(docs_of(rows)) == plain_groups(rows)


def test_copies_that_are_too_different_are_not_compared(docs_of, monkeypatch):
    rng = random.Random(5)
    base = [f"w{k}" for k in range(500)]
    rows = []
    for i in range(60):  # each with edits of its own: a fifth of its shingles are no other text's
        text = list(base)
        for k in rng.sample(range(500), 40):
            text[k] = f"x{i}-{k}"
        rows.append((i, " ".join(text)))
    compared, verified = [], jaccard.verified

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    assert found_groups(docs_of(rows)) == plain_groups(rows)
    assert sum(compared) == 0


def test_lists_are_costed_by_the_leaders_met(spark):
    entry = "array(named_struct('at', 0, 'seen', 5000L, 'member', 1L), named_struct('at', 1, 'seen', 5000L, 'member', 2L), " \
        "named_struct('at', 2, 'seen', 5000L, 'member', 3L), named_struct('at', 3, 'seen', 5000L, 'member', 4L))"
    begun = spark.range(50).selectExpr("id", "0 AS zone", "40L AS n", f"{entry} AS first")
    assert jaccard.boundary(begun, 90) == 0  # six subsets a set cost more than four lists


def test_groups_of_odd_rows(docs_of):
    rows = [
        (5, None), (6, ""), (7, " \n"), (8, "One two"), (9, "one TWO"), (10, "one"), (None, "one two"), (3, "a b c d e f"),
        (3, "one two"), (2, "a b c d e f"), (2, "a b c d e f"), (11, "long " * 20_000),
    ]
    want = [r if r[0] is not None else (None, r[1], None) for r in plain_groups(rows)]
    assert found_groups(docs_of(rows).withColumn("n_shingles", F.lit(1))) == sorted(want, key=str)
    assert found_groups(docs_of([])) == []


def test_groups_of_rows_that_repeat_an_id(docs_of):
    rng = random.Random(11)
    a, b, c, d = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(120)) for k in "abcd")
    near = lambda t: t + " more"
    for rows in (
        [(2, a), (3, a), (3, b), (9, near(b))],
        [(3, c), (3, d), (7, near(c)), (8, near(d)), (20, near(b)), (21, b)],
        [(2, a), (3, a), (3, None), (5, ""), (5, near(a))],
        [(-4, c), (-4, d), (-4, c), (-9, near(d)), (12, "one two"), (12, a), (15, near(a)), (None, a)],
    ):
        want = [r if r[0] is not None else (None, r[1], None) for r in plain_groups(rows)]
        assert found_groups(docs_of(rows).repartition(3)) == sorted(want, key=str)


def test_one_of_each(docs_of):
    docs = docs_of([(1, "a b c"), (2, "a b c"), (3, "other"), (None, "a b c")])
    left = jaccard.one_of_each(docs, jaccard.similar_groups(docs))
    assert sorted(str(r.doc_id) for r in left.collect()) == ["1", "3", "None"]
    assert left.columns == docs.columns


# passages


def plain_left(rows, size=20):
    seen, out = {}, []
    order = sorted((k for k in range(len(rows)) if rows[k][0] is not None), key=lambda k: rows[k][0])
    for k in order:
        w = words(rows[k][1])
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            seen[key] = min(seen.get(key, (rows[k][0], s)), (rows[k][0], s))
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - size + 1):
            if i is not None and seen[tuple(w[s : s + size])] < (i, s):
                gone |= set(range(s, s + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket_bytes", [12_000_000, 400])
def test_repeated_passages(docs_of, monkeypatch, bucket_bytes):
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket_bytes)
    rng = random.Random(6)
    passages = [" ".join(rng.choice("abcdefg") + str(rng.randrange(9)) for _ in range(rng.randrange(15, 60))) for _ in range(5)]
    rows = [(None, passages[0]), (900, None), (901, ""), (902, "a " * 70), (903, "a " * 70), (903, "a " * 70), (904, passages[1] * 2), (905, "x\ty\n" * 15)]
    for i in rng.sample(range(500), 60):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(f"u{rng.randrange(99)}" for _ in range(25)) for _ in range(4)]
        rows.append((i, "  ".join(parts)))
    docs = docs_of(rows).withColumn("kept_text", F.lit(0)).repartition(5)
    got = sorted((tuple(r) for r in substrings.without_repeats(docs).collect()), key=str)
    assert got == plain_left(rows)
    assert substrings.without_repeats(docs_of([])).count() == 0


@pytest.mark.parametrize("size", [1, 3, 20])
def test_stretches_of_texts_cut_together(size):
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 6, n).astype(np.uint64) for n in (20, 45, 20, 21, 90)]
    lengths = np.array([len(t) for t in texts])
    got = list(zip(*(x.tolist() for x in substrings.stretches(np.concatenate(texts), lengths, size))))
    want, before = [], 0
    for k, t in enumerate(texts):
        least = substrings.minimisers(t, size).tolist()
        for w, m in enumerate(least):
            if w and least[w - 1] == m:
                want[-1] = (m, k, want[-1][2], before + w + 1)
            else:
                want.append((m, k, before + w, before + w + 1))
        before += len(t)
    assert got == want


def test_words_are_numbered_by_first_appearance():
    tokens = [w for t in ("a b a\x00 \xa0c b", "\u2003 a\x1f \x00 a\x00") for w in words(t)]
    order = list(dict.fromkeys(tokens))
    assert substrings.numbered(b" ".join(tokens)).tolist() == [order.index(w) for w in tokens]


def test_equal_hashes_are_told_apart_by_their_words(monkeypatch):
    monkeypatch.setattr(substrings, "shingle_hashes", lambda codes, size: np.zeros(len(codes) - size + 1, np.uint64))
    block = substrings.pack([(1, 0, 0, 2, b"a b c"), (2, 0, 0, 2, b"b c d"), (3, 7, 5, 1, b"a b")])
    assert sorted(map(tuple, substrings.repeats([block], 2).tolist())) == [(2, 0, 0), (3, 7, 5)]


def test_passages_of_rows_that_repeat_an_id(docs_of):
    rng = random.Random(10)
    one, two, three = (" ".join(f"{k}{rng.randrange(10**6)}" for _ in range(40)) for k in "pqr")
    rows = [(1, one), (5, one), (5, two), (5, two), (6, three), (6, f"{three} x {two}"), (7, three), (7, three)]
    got = sorted((tuple(r) for r in substrings.without_repeats(docs_of(rows).repartition(3)).collect()), key=str)
    want = [(1, 40, 0, one), (5, 40, 40, ""), (5, 40, 0, two), (5, 40, 0, two), (7, 40, 40, ""), (7, 40, 40, "")]
    assert [r for r in got if r[0] != 6] == sorted(want, key=str)
    six = [r for r in got if r[0] == 6]  # the earlier of the two keeps `three`, `two` goes from the longer one anyway
    assert sorted(r[2] for r in six) in ([0, 80], [40, 40])
    assert sum(three in r[3] for r in six) == 1


# classifier


def test_cotraining_finds_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").filter("doc_id < 4000")
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 4000")
    known, hidden = labels.filter("doc_id % 3 > 0"), labels.filter("doc_id % 3 = 0")
    got = cotraining.score_quality(docs, known)
    n, right, good = got.join(hidden, "doc_id").agg(
        F.count("*"), F.sum((F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).cast("int")),
        F.sum(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")),
    ).first()
    assert right / n > max(good / n, 0.9)
    assert got.count() == docs.count()


def test_classifier_without_enough_labels(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (3, "x"), (None, "y"), (3, "x")])
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in cotraining.score_quality(docs, empty).collect()] == [0.5] * 5
    one = spark.createDataFrame([(3, 1, None), (3, 1, 1), (None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    assert {(r.score, r.kept) for r in cotraining.score_quality(docs, one).collect()} == {(0.0, False)}
    assert cotraining.score_quality(docs_of([]), one).count() == 0


def test_cotraining_uses_every_document(spark, docs_of, monkeypatch):
    rng = random.Random(5)
    word = {0: [f"b{k}" for k in range(9)], 1: [f"g{k}" for k in range(9)]}
    rows = [(i, " ".join(rng.choices(word[i % 2], k=6)) + (" late" if i >= 12_000 else "")) for i in range(20_000)]
    docs = docs_of(rows).withColumn("source", F.when(F.col("doc_id") % 2 == 1, "src1").otherwise("src0"))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    fitted, rarity = [], []
    fit_view, featurised = cotraining.fit_view, cotraining.featurised
    monkeypatch.setattr(cotraining, "fit_view", lambda df, *a: fitted.append(df.count()) or fit_view(df, *a))
    monkeypatch.setattr(cotraining, "featurised", lambda *a: rarity.append(featurised(*a)) or rarity[-1])
    got = cotraining.score_quality(docs, labels).collect()
    assert {r.doc_id: r.kept for r in got} == {i: i % 2 == 1 for i, _ in rows}
    assert min(fitted[2:]) > 19_800  # all unlabelled rows are sure, and the labelled ones not held out
    assert {m.numDocs for _, m in rarity} == {20_000}
    assert 8_000 in rarity[0][1].docFreq  # a term that no labelled row has


def test_cotraining_keeps_terms_without_weights(spark, docs_of, monkeypatch):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randrange(5_000)}" for _ in range(200))) for i in range(3_000)]
    sizes = []
    monkeypatch.setattr(cotraining, "cut_lineage", lambda df: sizes.append(cut_lineage(df)) or sizes[-1])
    cut_lineage = session.cut_lineage
    got, rarity = cotraining.featurised(docs_of(rows))
    (written,) = sizes
    assert "text" not in written.columns
    terms = sum(len({w for x in t.split() for w in (x, "~" + x[-3:])}) for _, t in rows)
    folder = written.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert sum(f.stat().st_size for f in pathlib.Path(folder).glob("*.parquet")) < 4 * terms  # weights alone would take eight bytes
    idf, first = rarity.idf.toArray(), got.join(written.select("doc_id", "_tf"), "doc_id").first()
    weights = idf[first["_tf"].indices]
    assert np.allclose(first["_text_x"].values, weights / np.linalg.norm(weights)) and set(first["_tf"].values) == {1.0}


def test_small_logistic_fit():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((6000, 2))
    y = (rng.random(6000) < 1 / (1 + np.exp(-(0.5 + 1.5 * x[:, 0] - x[:, 1])))).astype(float)
    assert np.abs(cotraining.logistic(x, y) - [0.5, 1.5, -1.0]).max() < 0.15


# rollups


def test_rollup_is_additive_and_idempotent(spark, tmp_path):
    ddl = "op string, source string, lang string, tokenizer string, n_tokens long, n_chars long, old_source string, old_lang string, old_tokenizer string, old_n_tokens long, old_n_chars long, extra int"
    new = lambda op, s, n, c: (op, s, "en", "v1", n, c, None, None, None, None, None, 1)
    roll = token_counts.Rollup(spark, f"{tmp_path}/rollup")
    assert roll.totals().count() == 0
    first = spark.createDataFrame([new("insert", "a", 10, 40), new("insert", "a", 5, 20), new("insert", None, None, 7), new("other", "a", 9, 9)], ddl)
    assert roll.commit("one", first) and not roll.commit("one", first)
    second = spark.createDataFrame([("revise", "b", "en", "v2", 12, 40, "a", "en", "v1", 10, 40, 1), new("delete", "a", 5, 20)], ddl)
    assert roll.commit("two", second)
    assert not token_counts.Rollup(spark, f"{tmp_path}/rollup").commit("two", second)
    assert sorted((tuple(r) for r in roll.totals().collect()), key=str) == [("b", "en", "v2", 1, 12, 40), (None, "en", "v1", 1, 0, 7)]
    assert roll.commit("none", first.limit(0))
    assert roll.totals().count() == 2


def test_token_count_query(spark):
    import public_tokenizers
    import re
    import tiktoken

    ranks, name = token_counts.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    codec = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id not in toxic:
            text = re.sub(" {2,}", " ", r.text)
            want[r.source, r.lang, name] += np.array([1, len(codec.encode_ordinary(text)), len(text)])
    got = {tuple(r)[:3]: tuple(r)[3:] for r in queries.QUERIES["op6_token_counts"](spark, SF).collect()}
    assert got == {k: tuple(v.tolist()) for k, v in want.items()}


# language models


def test_gradients():
    rng = np.random.default_rng(0)
    model = {k: v.astype(float) for k, v in recurrent.start_model(3).items()}
    tok = rng.integers(0, recurrent.TOKENS, (7, 5))
    tok[:, 0] = 3
    first = np.zeros((7, 5), bool)
    first[0] = True
    first[3, 2] = True

    def loss():
        before, _, _ = recurrent.run_window(model, tok, first, np.zeros((5, recurrent.HIDDEN)), False)
        return -recurrent.outputs(model, before.reshape(-1, recurrent.HIDDEN), tok.ravel(), False)[0].sum()

    before, _, saved = recurrent.run_window(model, tok, first, np.zeros((5, recurrent.HIDDEN)), True)
    _, grads, back = recurrent.outputs(model, before.reshape(-1, recurrent.HIDDEN), tok.ravel(), True)
    recurrent.backward(model, tok, first, before, saved, back.reshape(before.shape), grads)
    for k in recurrent.SHAPES:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        was, step = model[k][at], 1e-3
        model[k][at] = was + step
        up = loss()
        model[k][at] = was - step
        down = loss()
        model[k][at] = was
        assert abs(grads[k][at] - (up - down) / (2 * step)) < 1e-3 * max(1, abs(grads[k][at]))


def test_state_is_carried_through_lanes_and_windows():
    rng = np.random.default_rng(1)
    model = recurrent.start_model(5)
    texts = [rng.integers(0, recurrent.TOKENS, n) for n in (1, 100, 0, 33, 32, 7, 260)]
    many = recurrent.score_texts(model, texts, lanes=3)
    for t, got in zip(texts, many):
        h, want = np.zeros((1, recurrent.HIDDEN), np.float32), 0.0
        for k in t:
            want += float(recurrent.outputs(model, h, np.array([k]), False)[0][0])
            _, h, _ = recurrent.run_window(model, np.array([[k]]), np.zeros((1, 1), bool), h, False)
        assert abs(got - want) < 1e-2 + 1e-5 * abs(want)


def test_probabilities_sum_to_one():
    h = np.random.default_rng(2).standard_normal((1, recurrent.HIDDEN)).astype(np.float32)
    every = np.arange(recurrent.TOKENS)
    logp = recurrent.outputs(recurrent.start_model(), np.repeat(h, len(every), 0), every, False)[0]
    assert abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_probabilities_sum_to_one_at_every_width():
    for width in (2, 3, 4, 5, 9, 33):
        for size in (1, 300):  # exponents that overflow are shifted
            model = {k: v * np.float32(size) for k, v in recurrent.start_model(width=width).items()}
            h = np.random.default_rng(2).uniform(-1, 1, (1, recurrent.HIDDEN)).astype(np.float32)
            every = np.arange(width * width)
            logp = recurrent.outputs(model, np.repeat(h, len(every), 0), every, False)[0]
            assert np.isfinite(logp).all() and abs(np.exp(logp.astype(float)).sum() - 1) < 1e-4


def test_frequent_tokens_take_few_exponentials(monkeypatch):
    class Counting:
        taken = 0

        def __getattr__(self, name):
            return getattr(np, name)

        def exp(self, x, *out):
            Counting.taken += np.size(x)
            return np.exp(x, *out)

    width, n = 200, 6_000
    share = 1 / np.arange(1, width * width + 1)
    tokens = np.random.default_rng(0).choice(width * width, n, p=share / share.sum())
    model = recurrent.with_frequencies(recurrent.start_model(width=width), 1e6 * share)
    states = np.zeros((n, recurrent.HIDDEN), np.float32)
    monkeypatch.setattr(recurrent, "np", Counting())
    logp = recurrent.outputs(model, states, tokens, True)[0]
    monkeypatch.undo()
    assert 0 < Counting.taken < width * n  # two softmaxes of `width` are twice that
    want = np.log((1e6 * share + 1) / (1e6 * share + 1).sum())[tokens]  # the biases alone give these
    assert np.abs(logp - want).max() < 1e-3


def test_a_step_is_plain_adam():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, recurrent.TOKENS, recurrent.WINDOW) for _ in range(160)]  # one window, more than `STEP` tokens
    model = recurrent.start_model(7)
    trainer = recurrent.Trainer(model, 0.01)
    trainer.learn(texts)
    tokens, first = np.stack(texts, 1), np.zeros((recurrent.WINDOW, len(texts)), bool)
    first[0] = True
    before, _, saved = recurrent.run_window(model, tokens, first, np.zeros((len(texts), recurrent.HIDDEN), np.float32), True)
    logp, grads, back = recurrent.outputs(model, before.reshape(-1, recurrent.HIDDEN), tokens.ravel(), True)
    recurrent.backward(model, tokens, first, before, saved, back.reshape(before.shape), grads)
    assert trainer.seen == tokens.size and abs(trainer.loss + logp.sum()) < 1e-3 * trainer.loss
    for k, g in grads.items():
        g = np.clip(g / tokens.size, -0.1, 0.1)
        step = 0.01 * g / (np.abs(g) + 1e-7 * 1000**0.5)  # the first step: both averages are of one gradient
        far = np.abs(g) > 1e-5
        assert far.any() and np.abs(trainer.model[k] - model[k] + step)[far].max() < 5e-4


def test_vocabulary_follows_the_counts(spark, docs_of):
    rows = [(i, " ".join(f"v{k}" for k in range(4_000))) for i in range(3)] + [(9, " ".join(f"once{k}" for k in range(1_000)))]
    counts = lm.count_words(docs_of(rows), "text")
    total, distinct = counts.agg(F.sum("n"), F.count("*")).first()
    words = lm.Vocabulary(lm.most_frequent(counts, 100, lm.COVERED), total, distinct)
    ids = words.encode(rows[0][1])[:-1]
    assert (ids != lm.UNKNOWN_ID).sum() * 3 >= lm.COVERED * total - len(rows) - 3  # each of them three times
    assert words.width**2 >= len(set(ids)) > recurrent.TOKENS and (words.width - 1) ** 2 < len(set(ids)) + 2
    model = recurrent.with_frequencies(recurrent.start_model(width=words.width), words.token_counts)
    again = recurrent.shaped(recurrent.flat(model), words.width)
    assert all((again[k] == model[k]).all() for k in model)
    h = np.zeros((words.width**2, recurrent.HIDDEN), np.float32)
    assert abs(np.exp(recurrent.outputs(model, h, np.arange(len(h)), False)[0].astype(float)).sum() - 1) < 1e-3


def test_words_of_texts_by_arrow():
    texts = [None, "", " ", "a", " a", "a ", "\t A\x0b\x0cb\r\n\n c\xa0D \x1cE\x85f ", "ÀÉ K\u0130", "\u2003x\x00y z\x1f"]
    found, sizes = lm.tokens_of(pa.array(texts, pa.string()))
    assert found.to_pylist() == [w for t in texts for w in [*lower_words(t), b""]]
    assert sizes.tolist() == [len(lower_words(t)) + 1 for t in texts]
    which = np.array([w in (b"a", b"b", b"") for w in found.to_pylist()])
    got = [{x["word"]: x["times"] for x in row} for row in lm.counted_by_text(found, which, sizes).to_pylist()]
    assert got == [Counter(w for w in [*lower_words(t), b""] if w in (b"a", b"b", b"")) for t in texts]


def check_base(rows, got):
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0
    seen = Counter()
    for i, t in rows:
        if not out(i):
            seen.update([*lower_words(t), b""])
    total, distinct = sum(seen.values()), len(seen)
    want = []
    for i, t in rows:
        w = [*lower_words(t), b""]
        base = sum(math.log10((seen[x] + 0.1) / (total + 0.1 * (distinct + 1))) for x in w)
        want.append((str(i), out(i), len(w), sum(seen[x] > 0 for x in w), total, round(base, 6)))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)


def test_scores_beat_the_base_on_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(lm, "KNOWN", 1500)  # so that many words go through the join
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op8_lm_scoring"](spark, sf).collect()
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows(docs_of):
    rows = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "b c"), (4, "x " * 3000), (11, "a new word"), (20, "a b")]
    got = lm.score_documents(docs_of(rows).withColumn("score", F.lit(0))).collect()
    check_base(rows, got)
    assert len({r.score for r in got if r.doc_id == 3}) == 1
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(docs_of([])).count() == 0


# pipeline


def test_pipeline_equals_a_plain_one(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r.doc_id)
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [r for r in docs if any(map(str.isalpha, r.text or ""))]
    group = {i: c for i, _, c in plain_groups([(r.doc_id, r.text) for r in kept], size=5, percent=80)}
    kept = [r for r in kept if group[r.doc_id] == r.doc_id and not any(i in decontaminate.plain(r.text) for i in items)]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in kept}
    spans = {r.doc_id: r for r in secrets.scan_secrets(spark.createDataFrame(kept)).collect()}
    import sentencepiece
    import hashlib

    lib = sentencepiece.SentencePieceProcessor(model_proto=queries.model_bytes())
    for r in kept:
        text = r.text
        merged = []
        for s in spans[r.doc_id].secret_spans:
            if merged and s["start"] < merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], s["end"])
            else:
                merged.append([s["start"], s["end"]])
        for a, b in reversed(merged):
            text = text[:a] + "[SECRET]" + text[b:]
        ids = lib.encode(text, add_bos=True, add_eos=True)
        assert got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_on_odd_rows(spark, docs_of):
    odd = [(1, None), (2, ""), (3, "Same words in here"), (4, "Same words in here"), (4, "Same words in here"), (None, "no id at all words in here"), (5, "Same words in here " * 4 + "token = abcDEF123456789x"), (6, "Same words in here " * 5_000)]
    docs = docs_of(odd).withColumns({"language": F.lit(1), "item_hits": F.lit(2), "component_id": F.lit(3), "key": F.lit(4), "_row": F.lit(5)})
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns, name
    left = {(r.doc_id, r.text[:30]) for r in docs.collect()}
    assert {(3, "Same words in here"), (None, "no id at all words in here")} <= left
    assert [r.text[-8:] for r in docs.filter("doc_id = 5").collect()] == ["[SECRET]"]
    assert not {i for i, _ in left} & {1, 2, 4}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
    nothing = docs_of([])
    for _, stage in corpus_pipeline.STAGES:
        nothing = stage(spark, nothing, SF)
    assert nothing.count() == 0


def test_pipeline_drops_near_copies_from_eight_tenths_on(spark, docs_of):
    def edited(n):
        return " ".join(f"e{k}" if n and k % (500 // n) == 20 else f"w{k}" for k in range(500))

    five = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    alike = lambda a, b: len(five(a) & five(b)) / len(five(a) | five(b))
    assert 0.8 <= alike(edited(0), edited(10)) < 0.9 and alike(edited(0), edited(14)) < 0.8
    got = corpus_pipeline.one_of_near_copies(spark, docs_of([(1, edited(0)), (2, edited(10)), (3, edited(14).replace("e", "f"))]), SF)
    assert {r.doc_id for r in got.collect()} == {1, 3}

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = {}
    for r in docs.collect():
        w = lower_words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    for _ in links:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = corpus_pipeline.one_of_near_copies(spark, docs, SF)
    assert {r.doc_id for r in got.collect()} == {i for i in sets if label[i] == i}


def test_large_sets_without_a_partner_are_dropped_before_all_their_members_are_counted(spark, docs_of, monkeypatch):
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    passage = " ".join(f"p{k}" for k in range(50))
    rows = [(i, own(i, 450) + " " + passage) for i in range(40)]
    rows += [(100, rows[0][1] + " more at the end"), (101, own(101, 500))]
    seen, in_full = [], jaccard.in_full
    monkeypatch.setattr(jaccard, "in_full", lambda begun, *a: seen.append({r.id for r in begun.collect()}) or in_full(begun, *a))
    got = {r.doc_id: r.component_id for r in jaccard.similar_groups(docs_of(rows), size=5, percent=80).collect()}
    assert got == {i: 0 if i == 100 else i for i, _ in rows}
    assert seen == [{0, 100}]


def test_written_steps_leave_no_shuffle_files(spark):
    import glob

    from hemolens.session import cut_lineage

    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in folders for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = files()
    written = cut_lineage(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    assert not files() - before
    assert len(written.collect()) == 100
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
