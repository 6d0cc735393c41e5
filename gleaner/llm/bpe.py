"""Byte-level BPE in two tiers.

A minimal perfect hash over the vocabulary resolves pre-tokens that are tokens themselves. All others go to a heap
over linked bytes, which joins the neighbours of the lowest rank first, the leftmost of equals. The misses of a piece of
texts are joined side by side: each has its own heap, a tournament tree over its places, and numpy pops and mends all of
them in step. Texts are encoded by their distinct words (:mod:`gleaner.llm.words`).

The regex engines of Python and of the tiktoken library know different versions of Unicode. Characters about whose
class they disagree are found once, and texts that hold one are cut with stand-ins of the library's class.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import column, map_arrow, pieces
from gleaner.llm.words import Words, arrow_class, code_points, ranges, whites

#: Words that a generation of a worker's table holds, and bytes of text that are encoded together.
MEMO, PIECE = 3 << 17, 4 << 20
#: Keys per bucket of the perfect hash.
PER_BUCKET = 2
#: Lengths in bytes up to which misses are joined side by side (a longer one has a heap for itself), and how many at once.
WIDTHS, TOGETHER = (8, 16, 32, 64), 20_000
#: What no rank is as large as.
NEVER = np.int32(2**31 - 1)
MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15
#: What byte-level BPE commonly cuts a text into (fixed value).
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A stand-in for each class of characters: letters, numbers, white space, others. None occurs in a contraction.
STAND_INS = {"L": "a", "N": "0", "s": "\x0b", "": "\x01"}


@lru_cache(1)
def disputed() -> dict[int, str]:
    """The characters that the tiktoken library and Python's engines class differently, each with its stand-in."""
    every = code_points()
    single = {bytes([b]): b for b in range(256)}
    kinds: dict[str, set[str]] = {}
    differ: set[str] = set()
    for name, own in (("L", str.isalpha), ("N", None), ("s", str.isspace)):
        pattern = r"\s" if name == "s" else rf"\p{{{name}}}"
        theirs = tiktoken.Encoding(f"class {name}", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        kinds[name] = set(bytes(theirs.encode_ordinary(every)).decode())
        differ |= kinds[name] ^ set(regex.findall(pattern, every))
        if name == "s":
            differ |= kinds[name] ^ set(re.findall(r"\s", every))
        if own:
            differ |= kinds[name] ^ {c for c in every if own(c)}
    return {ord(c): STAND_INS[next((k for k, held in kinds.items() if c in held), "")] for c in differ}


class PerfectHash:
    """A minimal perfect hash by displacement: n keys fill the slots 0 to n-1, each bucket with one displacement."""

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, -(-n // PER_BUCKET))
        hashes = [xxhash.xxh3_64_intdigest(k) for k in keys]
        held: list[list[int]] = [[] for _ in range(self.buckets)]
        for i, h in enumerate(hashes):
            held[h % self.buckets].append(i)
        self.shift = [0] * self.buckets
        taken, self.order = bytearray(n), [0] * n
        free = n - 1
        for b in sorted(range(self.buckets), key=lambda b: -len(held[b])):
            if len(held[b]) < 2:
                # A lone key takes any free slot; the displacement names it.
                for i in held[b]:
                    while taken[free]:
                        free -= 1
                    taken[free], self.order[free], self.shift[b] = 1, i, -free - 1
                continue
            d = 0
            while True:
                slots = {self._slot(hashes[i], d) for i in held[b]}
                if len(slots) == len(held[b]) and not any(taken[s] for s in slots):
                    break
                d += 1
            self.shift[b] = d
            for i in held[b]:
                s = self._slot(hashes[i], d)
                taken[s], self.order[s] = 1, i

    def _slot(self, h: int, d: int) -> int:
        x = (h ^ (d * STEP)) & MASK
        x = ((x ^ (x >> 31)) * 0xBF58476D1CE4E5B9) & MASK
        return (x >> 32) % self.n

    def __call__(self, key: bytes) -> int:
        """The slot of ``key``, if it is a key; else some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        return -d - 1 if d < 0 else self._slot(h, d)


def cutter(pattern: str) -> Callable[[str], Sequence[str]]:
    """The function that cuts a chunk into pre-tokens. With the common pattern a word, alone or before a full stop or
    comma, needs no regex."""
    find = regex.compile(pattern).findall
    if pattern != PRE_TOKEN:
        return find

    def cut(chunk: str) -> Sequence[str]:
        body = chunk[1:] if chunk[:1] == " " else chunk
        if body.isalpha():
            return (chunk,)
        if body[-1:] in (".", ",") and body[:-1].isalpha():
            return (chunk[:-1], chunk[-1])
        return find(chunk)

    return cut


class PairTable:
    """What pairs of tokens join to: ``held``, and the same as arrays, an open-addressed table of pairs and ranks."""

    def __init__(self, held: dict[int, int]) -> None:
        self.held = held
        self.shift = np.uint64(64 - max(4, (4 * len(held)).bit_length()))
        self.mask = np.int64((1 << (64 - int(self.shift))) - 1)
        self.pair, self.rank = np.full(int(self.mask) + 1, -1, "int64"), np.full(int(self.mask) + 1, -1, "int32")
        pairs, ranks_ = np.fromiter(held, "int64", len(held)), np.fromiter(held.values(), "int32", len(held))
        place = self._place(pairs)
        while len(pairs):
            free = self.pair[place] < 0
            self.pair[place[free]] = pairs[free]  # of several pairs at one place the last takes it
            taken = self.pair[place] == pairs
            self.rank[place[taken]] = ranks_[taken]
            pairs, ranks_, place = pairs[~taken], ranks_[~taken], (place[~taken] + 1) & self.mask

    def _place(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view("uint64") * np.uint64(STEP) >> self.shift).view("int64")

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The rank that each pair joins to, with its place in the lowest six bits; NEVER for those that do not join."""
        pairs = left.astype("int64") << 20 | right.astype("int64")  # negative if either is
        pairs, shape = pairs.reshape(-1), pairs.shape
        at = self._place(pairs)
        found, rank = self.pair[at], self.rank[at]
        todo = np.flatnonzero((found != pairs) & (found >= 0))
        rank[found != pairs] = -1
        at = at[todo]
        while len(todo):
            at = (at + 1) & self.mask
            found = self.pair[at]
            hit = found == pairs[todo]
            rank[todo[hit]] = self.rank[at[hit]]
            on = ~hit & (found >= 0)
            todo, at = todo[on], at[on]
        rank = rank.reshape(shape)
        return np.where(rank >= 0, rank << 6 | place, NEVER).astype("int32")


def groups(pieces: list[bytes], known: list[bytes | None]) -> Iterator[tuple[int, list[int]]]:
    """The places of the pieces that are not known by the least of WIDTHS that holds them; 0 for longer ones."""
    by: dict[int, list[int]] = {w: [] for w in (*WIDTHS, 0)}
    for i, (p, k) in enumerate(zip(pieces, known, strict=True)):
        if k is None:
            n = len(p)
            by[next((w for w in WIDTHS if n <= w), 0)].append(i)
    yield from by.items()


class Encoder:
    """Ranks of byte strings and the pattern that cuts text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks))
        keys = list(ranks)
        self.keys = [keys[i] for i in self.hash.order]
        self.ids = [ranks[k] for k in self.keys]
        self.stand_ins = disputed()
        self._prepare()

    def _prepare(self) -> None:
        """What follows from the vocabulary; made anew where the encoder arrives."""
        self.find = cutter(self.pattern)
        ranks_ = dict(zip(self.keys, self.ids, strict=True))
        self.own = [r.to_bytes(4, "little") for r in self.ids]
        self.bytes = {r: k for k, r in ranks_.items()}
        self.single = np.array([ranks_[bytes([b])] for b in range(256)], "int32")
        self.joined: PairTable | None = None
        self.odd = re.compile(ranges(map(chr, self.stand_ins))).search
        disputed_ones = set(map(chr, self.stand_ins))
        self.words = Words(self.spaced, self.texts, whites() - disputed_ones, [arrow_class(disputed_ones)] if disputed_ones else [], MEMO)

    def pairs(self) -> PairTable:
        """What two neighbouring tokens join to, for every way to part a token in two; made when it is first asked for,
        which is never where ids are only decoded."""
        if self.joined is None:
            ranks = dict(zip(self.keys, self.ids, strict=True))
            self.joined = PairTable(
                {left << 20 | right: r for k, r in ranks.items() for i in range(1, len(k)) if (left := ranks.get(k[:i])) is not None and (right := ranks.get(k[i:])) is not None}
            )
        return self.joined

    def __getstate__(self) -> dict:
        return {k: self.__dict__[k] for k in ("pattern", "hash", "keys", "ids", "stand_ins")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._prepare()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of pre-tokens, as bytes of 32-bit integers."""
        slots = [self.hash(p) for p in pieces]
        known = [self.own[slot] if self.keys[slot] == p else None for p, slot in zip(pieces, slots, strict=True)]
        for width, held in groups(pieces, known):
            for low in range(0, len(held), TOGETHER):
                some = held[low : low + TOGETHER]
                few = [pieces[i] for i in some]
                joined = self.merge_together(few, width) if width else [np.array(self.merge(p), "int32").tobytes() for p in few]
                for i, data in zip(some, joined, strict=True):
                    known[i] = data
        return known

    def merge_together(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The ids of pre-tokens of up to ``width`` bytes, a power of two.

        Row by row: the tokens by place, the next and the last place that is still linked, and a tournament tree whose
        leaves are rank and place of each pair and whose root is the least of them. A step pops every root, joins the
        two tokens, and plays the three places that changed up to the root again.
        """
        count, place = len(pieces), np.arange(width, dtype="int32")
        ends = np.fromiter(map(len, pieces), "int32", count)
        ids = self.single[np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), "uint8")].reshape(count, width)
        ids[place >= ends[:, None]] = -1
        tree = np.full((count, 2 * width), NEVER)
        tree[:, width:-1] = self.pairs().leaves(ids[:, :-1], ids[:, 1:], place[:-1])
        size = width
        while size > 1:
            np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2], out=tree[:, size // 2 : size])
            size //= 2
        after, before = np.tile(place + 1, count), np.tile(place - 1, count)
        flat, heap, leaf = ids.reshape(-1), tree.reshape(-1), self.pairs().leaves
        row = np.arange(count)
        while len(row := row[(top := heap[row * 2 * width + 1]) < NEVER]):
            top = top[top < NEVER]
            at, root = row * width, row * 2 * width
            here, rank = top & 63, top >> 6
            gone = after[at + here]
            right = after[at + gone]
            flat[at + here], flat[at + gone], after[at + here] = rank, -1, right
            linked = right < ends[row]
            right = np.where(linked, right, gone)  # the token that is gone joins with nothing
            before[(at + right)[linked]] = here[linked]
            left = before[at + here]
            first = left < 0
            left = np.where(first, gone, left)
            heap[root + width + gone] = NEVER
            heap[root + width + here] = leaf(rank, flat[at + right], here)
            heap[root + width + left] = leaf(flat[at + left], rank, left)
            changed = [here + width, gone + width, left + width]
            for _ in range(width.bit_length() - 1):
                for i, node in enumerate(changed):
                    changed[i] = node = node >> 1
                    pair = root + 2 * node
                    heap[root + node] = np.minimum(heap[pair], heap[pair + 1])
        held = ids >= 0
        data, stops = ids[held].tobytes(), np.append(0, 4 * np.cumsum(held.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip(stops, stops[1:], strict=False)]

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token, by a heap of (rank, place); an entry whose pair has changed since is passed over."""
        get, n = self.pairs().held.get, len(piece)
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n))
        pair = [get(ids[i] << 20 | ids[i + 1], -1) for i in range(n - 1)] + [-1]  # the rank that each place joins to
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            top = pop(heap)
            rank, i = top >> 32, top & 0xFFFFFFFF
            if pair[i] != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], pair[gone] = rank, -1, -1
            after[i] = right = after[gone]
            if right < n:
                before[right] = i
                pair[i] = r = get(rank << 20 | ids[right], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                pair[i] = -1
            left = before[i]
            if left >= 0:
                pair[left] = r = get(ids[left] << 20 | rank, -1)
                if r >= 0:
                    push(heap, r << 32 | left)
        return [x for x in ids if x >= 0]

    def spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before them."""
        return self.texts([" " + w for w in words])

    def texts(self, some: list[str]) -> list[bytes]:
        """The ids of texts as bytes of 32-bit integers: a memo of them then holds nothing that Python must trace."""
        find, odd = self.find, self.odd
        lists = [self.parted(t) if odd(t) else find(t) for t in some]
        known = list(dict.fromkeys(chain.from_iterable(lists)))
        get = dict(zip(known, self.pieces([p.encode() for p in known]), strict=True)).__getitem__
        return [b"".join(map(get, found)) for found in lists]

    def parted(self, text: str) -> list[str]:
        """The pre-tokens of a text that holds a disputed character: found with stand-ins, cut from the text itself."""
        return [text[m.start() : m.end()] for m in regex.finditer(self.pattern, text.translate(self.stand_ins))]

    def encode_batch(self, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another as 32-bit integers, and where each begins, and the last ends."""
        return self.words.ids(pa.array(some, pa.string()))

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


@lru_cache(4)
def load_encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return Encoder({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


def _lists(batches: Iterator[pa.RecordBatch], coder: Encoder) -> Iterator[tuple[pa.Array, pa.ListArray]]:
    for piece in pieces(batches, most=PIECE):
        flat, ends = coder.words.ids(column(piece, "text"))
        yield column(piece, "doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype("int32")), pa.array(flat))


def _decoded(ids: pa.ListArray, coder: Encoder) -> pa.Array:
    get, ends, flat = coder.bytes.__getitem__, ids.offsets.to_numpy(), ids.values.to_numpy()
    held = ids.is_valid().to_numpy(zero_copy_only=False)
    return pa.array([b"".join(map(get, flat[a:b].tolist())) if ok else b"" for a, b, ok in zip(ends, ends[1:], held, strict=False)], pa.binary())


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, encoder: Broadcast) -> DataFrame:
    """doc_id and ids (array of int) for each row of ``docs`` (doc_id, text); a null or empty text has no ids.

    ``encoder``: a broadcast :class:`Encoder`; its size is that of the vocabulary. Rows keep their number, repeated
    ones too, and so do those without doc_id; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _lists(batches, encoder.value):
            yield pa.RecordBatch.from_arrays([doc_id, ids], ["doc_id", "ids"])

    return map_arrow(_columns(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, encoder: Broadcast) -> DataFrame:
    """The columns doc_id and ids of ``encoded`` and ``decoded``, the bytes that the ids stand for (null ids: none)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ids = column(part, "ids")
                yield pa.RecordBatch.from_arrays([column(part, "doc_id"), ids, _decoded(ids, encoder.value)], ["doc_id", "ids", "decoded"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, ids array<int>, decoded binary")


def round_trip(docs: DataFrame, encoder: Broadcast) -> DataFrame:
    """What :func:`decode` gives for the result of :func:`encode`, by one worker: a task then holds one encoder, not two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, ids in _lists(batches, encoder.value):
            yield pa.RecordBatch.from_arrays([doc_id, ids, _decoded(ids, encoder.value)], ["doc_id", "ids", "decoded"])

    return map_arrow(_columns(docs), run, "doc_id long, ids array<int>, decoded binary")
