"""Exact Jaccard join of word n-gram sets: subsets for light sets, inverted lists for heavy ones.

Two sets with `100 * |x & y| >= percent * |x | y|` share nearly all their members, so under any
common order of the members they share one of their first `n - o + 1` and two of their first
`n - o + 2` (`o`: the least overlap that a set of size `n` needs). Rare members come first in
the order here. Light sets list the fixed-size subsets (pairs) of that beginning and meet in
equal subsets; heavy sets have too many, so they scan the inverted lists of the single members
in their beginning. The size that parts light from heavy is where the sum of subsets listed and
list entries scanned is least, from counts over all sets.

Sets that are equal are one node from the start. The members of a list are not paired with each
other: first with the least id, then, as long as a list holds several components, with random
leaders, sixteen times as many each round, until all of its members have led. Pairs within one
component are skipped, so a group of thousands of near copies costs a few pairs a copy, while
every pair that could join two components is compared in full.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hemolens.llm.common import WordHash, checked_broadcast, lower_words, mix, shingle_hashes
from hemolens.llm.components import components
from hemolens.session import cut_lineage

SUBSET = 2
#: Sets up to this size have all of their members counted. Larger ones have those in the first `COUNTED`
#: of the hash range counted, or in `BEYOND` times the share that a set may have beyond the least overlap if
#: that is more: a set without a partner then has more members alone there than a similar one could, and is
#: dropped before all of its members are counted. The result is exact for any values.
WHOLE = 200
COUNTED, BEYOND = 0.2, 1.5
GROWTH = 16
TOGETHER = 8
SMALL, LARGE = 0, 1
#: Words whose hash a task remembers, and rows whose sets it holds at a time.
MOST_WORDS, ROWS = 200_000, 1000


def steps(batches):
    """The batches in slices of at most `ROWS` rows."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def least_overlap(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def counted_range(percent: int) -> float:
    """Share of the hash range in which the members of large sets are counted."""
    return max(COUNTED, BEYOND * (100 - percent) / 100)


def shingle_set(text: str | None, size: int, hashed: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; a shorter text is one run; none without words."""
    tokens = lower_words(text)
    if not tokens:
        return np.empty(0, np.uint64)
    return np.unique(shingle_hashes(hashed.of(tokens), min(size, len(tokens))))


def arrow_lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def keys_of(sets: list[np.ndarray]) -> pa.Array:
    """Digests of the sets, null for empty ones."""
    return pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary())


def set_table(docs: DataFrame, id_col: str, text: str, size: int, percent: int) -> DataFrame:
    """(id, n, key, small, counted, large): size, digest, and the first members, by hash.

    Sets of up to `WHOLE` members have all of them in `small`, under hashes of their own. Larger
    ones, and those that could match a larger one, have `large`: its first `counted` members are
    those of the counted range. Small and large are joined apart, each under its own order.
    """
    edge, salt = np.uint64(min(int(counted_range(percent) * 2**64), 2**64 - 1)), np.uint64(0x5BD1E995)
    none = np.empty(0, np.uint64)

    def run(batches):
        hashed = WordHash(MOST_WORDS)
        for batch in steps(batches):
            sets = [shingle_set(t, size, hashed) for t in batch.column(text).to_pylist()]
            small = [mix(s ^ salt) if len(s) <= WHOLE else none for s in sets]
            large = [s if len(s) * 100 > WHOLE * percent else none for s in sets]
            counted = [int(np.searchsorted(s, edge)) for s in large]
            large = [s[: max(c, len(s) - least_overlap(len(s), percent) + SUBSET)] for s, c in zip(large, counted)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col), pa.array([len(s) for s in sets], pa.int64()),
                    keys_of(sets), arrow_lists(small), pa.array(counted, pa.int32()), arrow_lists(large),
                ],
                ["id", "n", "key", "small", "counted", "large"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    return rows.mapInArrow(run, "id long, n long, key binary, small array<long>, counted int, large array<long>")


def whole_sets(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """(id, key, members) of every row; `key` as in `set_table`."""

    def run(batches):
        hashed = WordHash(MOST_WORDS)
        for batch in steps(batches):
            sets = [shingle_set(t, size, hashed) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), keys_of(sets), arrow_lists(sets)], ["id", "key", "members"])

    return docs.select(F.col(id_col).cast("long").alias("id"), text).mapInArrow(run, "id long, key binary, members array<long>")


def in_full(begun: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """`begun` with the large sets' beginnings under the order of all of their members.

    Only large sets that are in `begun` can have a partner. Their members are counted among them,
    without a range, so those that a set has alone all come first: a set with too many is dropped,
    and the others' shared members stand at their true places, which is what `reachable` goes by.
    """
    large = members.join(begun.filter(F.col("zone") == LARGE).select("id", "n"), "id")
    none = F.array().cast("array<long>")
    sets = large.select("id", "n", none.alias("small"), F.col("n").cast("int").alias("counted"), F.col("members").alias("large"))
    return begun.filter(F.col("zone") == SMALL).unionByName(beginnings(sets, percent))


def spare(percent: int):
    """Members that a set of size `n` may have beyond the least overlap."""
    return F.expr(f"n * {100 - percent} div 100")


def beginnings(sets: DataFrame, percent: int) -> DataFrame:
    """(id, zone, n, first): the members of each set's beginning that another set has too, in order.

    `first` is an array of (at, seen, member): place in the set's order, sets counted, member.
    The order: counted members by the power of two of their count, then by hash; the others
    after them, by hash. A member that no other set's head has cannot lead to a pair. A set may
    come twice, once among the small and once among the large.
    """
    small = sets.select("id", "n", F.lit(SMALL).alias("zone"), F.size("small").alias("counted"), F.posexplode("small").alias("idx", "member"))
    large = sets.select("id", "n", F.lit(LARGE).alias("zone"), "counted", F.posexplode("large").alias("idx", "member"))
    rows = small.unionByName(large)
    seen = rows.groupBy("member").agg(F.count("*").alias("seen")).filter("seen > 1")
    ranged = F.col("idx") < F.col("counted")
    level = F.when(ranged, F.floor(F.log2("seen")).cast("int")).otherwise(1000)
    shared = rows.join(seen, "member").select("id", "zone", "n", "counted", "idx", "seen", "member", level.alias("level"))
    own = Window.partitionBy("id", "zone")  # one set's head at most
    turn = F.row_number().over(own.orderBy("level", "idx"))
    alone = F.col("counted") - F.count(F.when(F.col("level") < 1000, 1)).over(own)
    placed = shared.withColumns({"turn": turn, "alone": alone})
    at = F.when(F.col("level") < 1000, F.col("alone") + F.col("turn") - 1).otherwise(F.col("idx")).cast("int")
    begun = placed.withColumn("at", at).filter(F.col("at") < spare(percent) + SUBSET)
    entry = F.struct("at", "seen", "member")
    return begun.groupBy("id", "zone", "n").agg(F.array_sort(F.collect_list(entry)).alias("first"))


def size_class(percent: int):
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100.0 / percent)).cast("int")


def boundary(begun: DataFrame, percent: int) -> int:
    """Largest size of a light set: least total of what is listed and scanned.

    A heavy set scans the lists of its members; a light one lists its subsets and scans their
    lists, each taken to hold one in `TOGETHER` of the shorter of its two members' lists. In a list a set
    meets the leaders of the first turns, not all others. Sizes are taken in classes that grow by `100 / percent`, so the table has at most a few
    hundred rows for any data.
    """
    met = lambda seen: F.least(seen, F.lit(1 + GROWTH))
    listed = F.aggregate(
        F.transform("first", lambda r, i: (F.size("first") - 1 - i) * (1 + met(r["seen"] / TOGETHER))), F.lit(0.0), lambda a, x: a + x
    )  # members come with the rarer first
    scanned = F.aggregate(
        F.filter("first", lambda r: r["at"] < spare(percent) + 1), F.lit(0).cast("long"), lambda a, r: a + met(r["seen"])
    )
    costs = begun.select("n", size_class(percent).alias("kind"), listed.alias("listed"), scanned.alias("scanned"))
    table = (
        costs.groupBy("kind")
        .agg(F.max("n").alias("largest"), F.sum("listed").alias("listed"), F.sum("scanned").alias("scanned"))
        .orderBy("kind").collect()
    )
    best, cost = 0, sum(r["scanned"] for r in table)
    total = cost
    for r in table:
        total += r["listed"] - r["scanned"]
        if total < cost:
            best, cost = r["largest"], total
    return best


def index_rows(begun: DataFrame, light: int, percent: int) -> DataFrame:
    """(sig, family, id, n, at): subsets of light sets, single members of heavy sets and of those they could match.

    `at` is the place of the (first) member in the set's order; lists of one `family` are under
    one order. A list holds sets of like size
    only: sizes are in classes that grow by `100 / percent`, similar sets are in the same or
    the next class, and every set is listed for its own class and the next.
    """
    pairs = F.flatten(F.transform("first", lambda x, i: F.transform(
        F.slice("first", i + 2, F.size("first")),
        lambda y: F.struct(F.xxhash64(F.lit("subset"), x["member"], y["member"]).alias("sig"), x["at"].alias("at")),
    )))
    singles = F.transform(F.filter("first", lambda r: r["at"] < spare(percent) + 1), lambda r: F.struct(r["member"].alias("sig"), r["at"].alias("at")))
    family = F.col("zone") * 2
    of_light = begun.filter(F.col("n") <= light).select(family.alias("family"), "id", "n", F.inline(pairs))
    of_heavy = begun.filter(F.col("n") * 100 >= F.lit(light) * percent).select(
        (family + 1).alias("family"), "id", "n", F.inline(singles)
    )
    own = size_class(percent)
    listed = of_light.unionByName(of_heavy).withColumn("kind", F.explode(F.array(own, own + 1)))
    return listed.withColumn("sig", F.xxhash64("sig", "kind")).drop("kind")


def reachable(percent: int):
    """Whether two sets that meet in `sig` could still be similar if it is the first that they share.

    Then they share no more than what follows in either set's order. Of any similar pair, the
    list of the first shared member (or first two) passes, so no pair is lost.
    """
    rest = F.least(F.col("n") - F.col("at"), F.col("o") - F.col("o_at"))
    return rest * (100 + percent) >= (F.col("n") + F.col("o")) * percent


def verified(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Those (a, b) whose whole sets are similar enough."""
    a = members.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    b = members.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - both
    return pairs.join(b, "b").join(a, "a").filter(both * 100 >= union * percent).select("a", "b")


def joined(index: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the ids that some verified link joins.

    Of the lists of one family that hold the same ids, the first in the order stands for all: a
    pair that passes `reachable` in any of them passes there.
    """
    lists = index.groupBy("sig", "family").agg(
        F.count("*").alias("m"), F.min("id").alias("least"), F.sum("at").alias("places"),
        F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"),
    ).filter("m > 1")
    lists = lists.groupBy("family", "m", "least", "x", "y").agg(F.min(F.struct("places", "sig")).alias("one"))
    index = cut_lineage(index.join(lists.select(F.col("one.sig").alias("sig"), "family", "m", "least"), ["sig", "family"]))
    found = None
    turn = 0
    rows = index.withColumn("component", F.col("id"))
    while True:
        lead = rows.select("sig", F.col("id").alias("leader"), F.col("n").alias("o"), F.col("at").alias("o_at"), F.col("component").alias("c"), "m", "least")
        if turn == 0:
            lead = lead.filter("leader = least")
        else:  # those that have led before need not lead again
            share = F.pmod(F.xxhash64("leader"), F.lit(1 << 30)) / float(1 << 30) * F.col("m")
            fresh = F.col("leader") != F.col("least") if turn == 1 else share >= float(GROWTH ** (turn - 1))
            lead = lead.filter((share < float(GROWTH**turn)) & fresh)
        pairs = (
            rows.join(lead.drop("m", "least"), "sig")
            .filter((F.col("id") != F.col("leader")) & (F.col("component") != F.col("c")) & reachable(percent))
            .select(F.least("id", "leader").alias("a"), F.greatest("id", "leader").alias("b")).distinct()
        )
        links = verified(pairs, members, percent)
        if found is not None:
            links = links.unionByName(found.select(F.col("component").alias("a"), F.col("id").alias("b")))
        found = cut_lineage(components(links))
        turn += 1
        done = 2 if turn == 1 else GROWTH ** (turn - 1)
        labelled = (
            index.filter(F.col("m") > done).join(found, "id", "left")
            .withColumn("component", F.coalesce("component", "id"))
        )
        split = (
            labelled.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("sig")
        )
        rows = cut_lineage(labelled.join(split, "sig"))
        if rows.isEmpty():
            return found


def similar_groups(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, percent: int = 90
) -> DataFrame:
    """Per row of `docs`: id, `n_shingles` and `component_id`, the least id that links lead to.

    Null, empty and blank texts have an empty set and link with nothing, not even each other.
    A row with a null id gets a null component. Rows that repeat an id are one document: each
    has its own size, and what one of them links to all of them do. Equal texts are linked.
    """
    sets = cut_lineage(set_table(docs, id_col, text, size, percent))
    named = sets.filter("key is not null and id is not null")
    twice = cut_lineage(sets.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select("id"))
    classes = named.groupBy("key").agg(F.min("id").alias("rep"))
    repeated = not twice.isEmpty()
    classes = with_nodes(cut_lineage(classes)) if repeated else classes.withColumn("node", F.col("rep"))
    member = cut_lineage(
        sets.select("id", "n", "key").join(classes, "key", "left")
        .withColumns({c: F.when(F.col("id").isNotNull(), F.coalesce(c, "id")) for c in ("rep", "node")}).drop("key")
    )
    copies = checked_broadcast(cut_lineage(member.filter("id <> rep").select("id").distinct()))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text)

    def one_of_each_set(found: DataFrame, seldom: DataFrame) -> DataFrame:
        """Of each set one row of `found`, under its node; `seldom` are the rows whose id others have too."""
        again = seldom.join(classes, "key").filter("id = rep").dropDuplicates(["key"]).withColumn("id", F.col("node"))
        return found.unionByName(again.select(*found.columns)) if repeated else found

    def apart(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        if not repeated:
            return df, df
        several = checked_broadcast(twice)
        return df.join(several, "id", "left_anti"), df.join(several, "id", "left_semi")

    single, seldom = apart(named)
    begun = cut_lineage(beginnings(one_of_each_set(single.join(copies, "id", "left_anti"), seldom), percent))
    wanted = checked_broadcast(cut_lineage(begun.select("id").distinct()))
    single, seldom = apart(rows)
    whole = whole_sets(single.join(wanted, "id", "left_semi"), "id", text, size)
    if repeated:
        whole = one_of_each_set(whole, whole_sets(seldom, "id", text, size)).join(wanted, "id", "left_semi")
    members = cut_lineage(whole.select("id", "members"))
    begun = cut_lineage(in_full(begun, members, percent))
    light = boundary(begun, percent)
    index = cut_lineage(index_rows(begun, light, percent))
    found = joined(index, members, percent)
    if repeated:
        found = under_ids(found, member)
    labels = found.withColumnRenamed("id", "node")
    return member.join(labels, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )


def with_nodes(classes: DataFrame) -> DataFrame:
    """(key, rep, node) of (key, rep): the node is `rep`, or a number below all ids where several sets have that `rep`."""
    below = min(0, classes.agg(F.min("rep")).first()[0] or 0)
    shared = classes.groupBy("rep").agg(F.count("*").alias("sets")).filter("sets > 1").select("rep")
    numbered = cut_lineage(classes.join(shared, "rep").select("key", (F.lit(below - 1) - F.monotonically_increasing_id()).alias("node")))
    return cut_lineage(classes.join(numbered, "key", "left").withColumn("node", F.coalesce("node", "rep")))


def under_ids(found: DataFrame, member: DataFrame) -> DataFrame:
    """(id, component) of the nodes, with all rows of an id linked and each component named by its least id."""
    several = member.filter("id is not null").groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    repeats = member.join(several, "id").select("a", F.col("node").alias("b"))
    whole = cut_lineage(components(repeats.unionByName(found.select(F.col("component").alias("a"), F.col("id").alias("b")))))
    ids = member.filter("node is not null").groupBy("node").agg(F.min("rep").alias("rep"))
    named = whole.join(ids, F.col("id") == F.col("node"))
    least = named.groupBy("component").agg(F.min("rep").alias("least"))
    return named.join(least, "component").select("id", F.col("least").alias("component"))


def one_of_each(docs: DataFrame, groups: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """`docs` without those whose group has a smaller id; rows with a null id stay."""
    gone = cut_lineage(groups.filter(F.col("component_id") < F.col(id_col)).select(id_col).distinct())
    return docs.join(checked_broadcast(gone), id_col, "left_anti").select(*docs.columns)
