"""Exact encoding and decoding with a merge-type (BPE) SentencePiece model, by backtracking.

An Aho-Corasick pass lists the pieces at every position. The encoder takes the longest piece
there, checks that it stands next to the piece before it (re-merging the two together gives
the two again), and otherwise goes on to a shorter piece; when none is left it gives the
position up, marks it in a bitfield and takes the last piece back. The sequence of pieces in
which all neighbours are compatible is the one that merging makes, so no merge queue runs
over the text.

Merging never joins two characters that stand side by side in no piece of the vocabulary.
Texts are cut there (before every space mark to begin with), and the cuts are encoded once
and remembered, in bounded tables.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from hemolens.llm.common import attach

MARK = "▁"
REMEMBERED = 400_000
SHORT = 48


class PieceCodec:
    """Encoder and decoder for one model, given as the bytes of its file.

    Needs a BPE model with byte fallback, identity normalisation and a leading space mark; any
    other is refused. The library is used to read the vocabulary only.
    """

    def __init__(self, model: bytes):
        lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = lib.get_piece_size()
        self.bos, self.eos = lib.bos_id(), lib.eos_id()
        self.byte_ids, self.ids, self.scores, texts = {}, {}, {}, []
        for i in range(size):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                texts.append(bytes([int(piece[1:-1], 16)]))
            elif lib.is_control(i) or lib.is_unknown(i):
                texts.append(None)
            else:
                self.ids[piece] = i
                self.scores[piece] = lib.get_score(i)
                texts.append(piece.replace(MARK, " ").encode())
        self.piece_bytes, self.byte_set = texts, frozenset(self.byte_ids.values())
        self.unknown = lib.unk_id()
        probe = sentencepiece.SentencePieceNormalizer(model_proto=model).normalize(" À  é\tＡ ")
        if len(self.byte_ids) != 256 or probe != f"{MARK}{MARK}À{MARK}{MARK}é\tＡ{MARK}":
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        if not {c for p in self.ids for c in p} <= set(self.ids):
            raise ValueError("a piece has a character that is not itself a piece")
        self.mark_joins = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids)
        self.pairs = {a + b for p in self.ids for a, b in zip(p, p[1:])}
        self.names = {i: p for p, i in self.ids.items()}
        self.lengths = [len(self.names.get(i, "")) for i in range(size)]
        self.automaton = ahocorasick.Automaton()
        reachable = {p: i for p, i in self.ids.items() if len(self.merged(p)) == 1}
        for piece, i in reachable.items():
            self.automaton.add_word(piece, i)
        self.automaton.make_automaton()
        #: id -> the next shorter piece that begins it, -1 for none
        self.shorter = [-1] * size
        for piece, i in reachable.items():
            self.shorter[i] = next((reachable[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in reachable), -1)
        self.reachable = reachable
        self.fits: dict[int, dict[int, bool]] = {i: {} for i in reachable.values()}
        self.memo: dict[str, tuple[bytes, bytes]] = {}
        self.parts: dict[str, list[int]] = {}

    def forget(self) -> None:
        self.memo.clear()
        self.parts.clear()

    def merged(self, text: str) -> list[str]:
        """Merge the best-scored pair, the leftmost of equal ones, until no pair is a piece."""
        if len(text) > SHORT:
            return self.merged_long(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged_long(self, text: str) -> list[str]:
        """`merged` in n log n steps: a heap of the pairs, by score, then place, and links between neighbours."""
        parts, scores = list(text), self.scores
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def pair(k: int):
            j = after[k] if k >= 0 else n
            score = scores.get(parts[k] + parts[j]) if j < n else None
            return None if score is None else (-score, k, len(parts[k]), len(parts[j]))

        waiting = [x for x in map(pair, range(n)) if x]
        heapify(waiting)
        while waiting:
            _, k, left, right = heappop(waiting)
            j = after[k]
            if len(parts[k]) != left or j >= n or len(parts[j]) != right:
                continue  # one of the two has been merged since
            parts[k], parts[j] = parts[k] + parts[j], ""
            after[k] = after[j]
            if after[j] < n:
                before[after[j]] = k
            for x in (pair(before[k]), pair(k)):
                if x:
                    heappush(waiting, x)
        return [x for x in parts if x]

    def compatible(self, left: int, right: int) -> bool:
        a, b = self.names[left], self.names[right]
        found = self.fits[left][right] = self.merged(a + b) == [a, b]
        return found

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text of known characters."""
        whole = self.reachable.get(text)
        if whole is not None:
            return [whole]
        n = len(text)
        longest, lengths, shorter, fits = [-1] * n, self.lengths, self.shorter, self.fits
        for end, i in self.automaton.iter(text):
            longest[end - lengths[i] + 1] = i  # lengths rise with the end
        failed, pos, before, piece = bytearray(n // 8 + 1), 0, -1, longest[0]
        path: list[int] = []
        while True:
            if piece >= 0:
                end = pos + lengths[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    fit = True if before < 0 else fits[before].get(piece)
                    if fit is None:
                        fit = self.compatible(before, piece)
                    if fit:
                        path.append(piece)
                        if end == n:
                            return path
                        pos, before, piece = end, piece, longest[end]
                        continue
                piece = shorter[piece]
            else:
                if not path:
                    raise AssertionError("no sequence of compatible pieces")
                failed[pos >> 3] |= 1 << (pos & 7)
                piece = path.pop()
                pos -= lengths[piece]
                before = path[-1] if path else -1
                piece = shorter[piece]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a text that merging never joins to its surroundings."""
        if part not in self.ids and len(part) == 1:
            ids = [self.byte_ids[b] for b in part.encode("utf-8", "replace")]
        elif part.startswith(MARK * 2):  # the scores of these pieces tie, so order decides
            ids = [self.ids[p] for p in self.merged(part)]
        else:
            ids = self.backtrack(part)
        if len(self.parts) >= REMEMBERED // 2:
            self.parts.clear()
        self.parts[part] = ids
        return ids

    def remember(self, cut: str) -> tuple[bytes, bytes]:
        pairs, parts, start, ids = self.pairs, self.parts, 0, []
        for k in [k for k in range(1, len(cut)) if cut[k - 1 : k + 1] not in pairs]:
            ids += parts.get(cut[start:k]) or self.encode_part(cut[start:k])
            start = k
        ids += parts.get(cut[start:]) or self.encode_part(cut[start:])
        if len(self.memo) >= REMEMBERED:
            self.memo.clear()
        made = self.memo[cut] = array("I", ids).tobytes(), self.join(ids)
        return made

    def join(self, ids: list[int]) -> bytes:
        return b"".join([self.piece_bytes[i] for i in ids])

    def cuts(self, text: str) -> list[str]:
        marked = MARK + text.replace(" ", MARK)
        if self.mark_joins:
            return [marked]
        if MARK * 2 in marked:
            return re.findall(f"{MARK}+[^{MARK}]*", marked)
        return [MARK + w for w in marked.split(MARK)[1:]]

    def encode(self, text: str | None) -> tuple[bytes, bytes]:
        """(ids without begin and end as little-endian unsigned 32-bit, decoded UTF-8 text)."""
        if not text:
            return b"", b""
        memo = self.memo
        cuts = self.cuts(text)
        made = [m or self.remember(c) for c, m in zip(cuts, map(memo.get, cuts))]
        return b"".join([m[0] for m in made]), b"".join([m[1] for m in made])[1:]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: control pieces vanish, one leading space goes, broken bytes become U+FFFD."""
        out, run, first = [], b"", True
        for i in [*ids, None]:
            if i is not None and i in self.byte_set:
                run += self.piece_bytes[i]
                first = False
                continue
            if run:
                out.append(lone_bytes(run))
                run = b""
            if i is None:
                break
            if i == self.unknown:
                out.append(" ⁇ ")
                first = False
                continue
            piece = self.piece_bytes[i]
            if piece is None:
                continue
            text = piece.decode()
            out.append(text[1:] if first and text.startswith(" ") else text)
            first = False
        return "".join(out)


def lone_bytes(run: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that starts no whole character."""
    out, k = [], 0
    while k < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[k : k + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        k += size
    return "".join(out)


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def encode_pieces(
    df: DataFrame, model: bytes, text: str = "text", ids: str = "piece_ids", decoded: str = "decoded", remember: bool = True
) -> DataFrame:
    """`df` with `ids` (binary: little-endian unsigned 32-bit, begin and end included) and `decoded`.

    Row by row, without a shuffle. A null or empty text gives begin and end alone and an empty
    decoded text. Repeated rows each get their result, an empty table an empty one; extra
    columns stay, but for those named like an output, which are replaced. A worker keeps the cuts it
    has seen for its next task; without `remember` it gives their memory back (some 160 MB at most).
    """

    def make():
        c = codec(model)
        begin, end = c.bos.to_bytes(4, "little"), c.eos.to_bytes(4, "little")

        def f(batch):
            made = [c.encode(t) for t in batch.column(text).to_pylist()]
            return [
                pa.array([begin + m[0] + end for m in made], pa.binary()),
                pa.array([m[1].decode("utf-8", "replace") for m in made], pa.string()),
            ]

        if not remember:
            f.close = c.forget
        return f

    return attach(df, f"`{ids}` binary, `{decoded}` string", make)
