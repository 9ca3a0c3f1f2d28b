"""Benchmark decontamination: passages of documents within a few edits of a test item.

Pigeonhole matching: an item that may differ by `k` edits is cut into `k + 1` pieces, and any
passage within `k` edits holds at least one piece unchanged. An Aho-Corasick pass over each
document finds the exact piece hits; around every hit Myers' bit-parallel algorithm measures
the edit distance of the whole item to the best passage. Nothing is sampled or capped, so the
result is exactly the passages within the error budget.

Texts and items are compared with A-Z in lower case and runs of white space as one space.
Items are a stated query set: they are taken in blocks of bounded size, each block one pass
over the documents, which are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hemolens.llm.common import attach, lower_words

HIT = "array<struct<item_id:bigint,distance:int,start:int,end:int,item_chars:int>>"


def plain(text: str | None) -> str:
    return b" ".join(lower_words(text)).decode("utf-8", "surrogatepass")


def bit_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def nearest(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """(least distance of the pattern to any part of `text`, first end of such a part)."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, at = m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph = down | (full & ~(xh | up))
        mh = up & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, at = score, j
        ph = ph << 1 & full
        up = (mh << 1 & full) | (full & ~(xv | ph))
        down = ph & xv
    return best, at


class ItemBlock:
    """Searcher for some items [(item_id, text), ...] with an error budget of `rate` of the length."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = []
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            item = plain(text)
            if not item:
                continue
            m, k = len(item), int(rate * len(item))
            edges = [m * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(edges, edges[1:]):
                pieces.setdefault(item[a:b], []).append((len(self.items), b))
            self.items.append((item_id, item, k, bit_masks(item), bit_masks(item[::-1])))
        self.automaton = None
        if pieces:
            self.automaton = ahocorasick.Automaton()
            for piece, where in pieces.items():
                self.automaton.add_word(piece, where)
            self.automaton.make_automaton()

    def search(self, text: str | None) -> list[tuple[int, int, int, int, int]]:
        """The best passage of each item within its budget: (item_id, distance, start, end, length)."""
        text = plain(text)
        if not text or self.automaton is None:
            return []
        begins: dict[int, set[int]] = {}
        for end, where in self.automaton.iter(text):
            for index, offset in where:
                begins.setdefault(index, set()).add(end + 1 - offset)
        hits = []
        for index in sorted(begins):
            found = self.verify(index, text, sorted(begins[index]))
            if found:
                hits.append(found)
        return hits

    def verify(self, index: int, text: str, begins: list[int]):
        item_id, item, k, masks, mirrored = self.items[index]
        m = len(item)
        exact = text.find(item)
        if exact >= 0:
            return item_id, 0, exact, exact + m, m
        windows: list[list[int]] = []
        for b in begins:
            low, high = max(0, b - k), min(len(text), b + m + k)
            if windows and low <= windows[-1][1]:
                windows[-1][1] = high
            else:
                windows.append([low, high])
        best = None
        for low, high in windows:
            distance, end = nearest(masks, m, text[low:high])
            if distance <= k and (best is None or distance < best[0]):
                best = distance, low + end
        if best is None:
            return None
        distance, end = best
        low = max(0, end - m - k)
        _, back = nearest(mirrored, m, text[low:end][::-1])
        return item_id, distance, end - back, end, m


def item_blocks(items: DataFrame, id_col: str, text: str, most_chars: int) -> Iterator[list[tuple[int, str]]]:
    rows = items.select(F.col(id_col).cast("long"), text).filter(F.col(text).isNotNull() & F.col(id_col).isNotNull())
    block, size = [], 0
    for item_id, t in rows.orderBy(id_col, text).toLocalIterator():
        if block and size + len(t) > most_chars:
            yield block
            block, size = [], 0
        block.append((item_id, t))
        size += len(t)
    if block:
        yield block


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    rate: float = 0.08, out: str = "item_hits", block_chars: int = 4_000_000,
) -> DataFrame:
    """`docs` with the array `out` of the items found in each text, its best passage each.

    Hits carry item_id, distance, start and end in the normalised text, and the item's length;
    they are ordered by item id. Null or empty texts hit nothing, null or blank items are
    ignored, equal items under several ids are each reported, an empty table on either side
    gives empty arrays; an input column named like `out` is replaced.
    """
    parts = []
    for n, block in enumerate(item_blocks(items, item_id, item_text, block_chars)):

        def make(block=block):
            searcher = ItemBlock(block, rate)
            return lambda batch: [[
                [dict(zip(("item_id", "distance", "start", "end", "item_chars"), h)) for h in searcher.search(t)]
                for t in batch.column(text).to_pylist()
            ]]

        parts.append(f"_hits_{n}")
        docs = attach(docs, f"`{parts[-1]}` {HIT}", make)
    none = F.array().cast(HIT)
    return docs.withColumn(out, F.array_sort(F.concat(none, *map(F.col, parts))) if parts else none).drop(*parts)


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of `docs` in which no item is found."""
    found = find_items(docs, items, out="_item_hits", **how)
    return found.filter(F.size("_item_hits") == 0).drop("_item_hits")
