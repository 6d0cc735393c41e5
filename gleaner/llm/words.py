"""Encoding texts by their distinct words.

A pre-token of byte-level BPE never spans a space that a non-space follows, so a text falls into words that can be
encoded apart: the first as it stands, each other one with the space before it. Arrow parts the texts of a piece at
their spaces and numbers the distinct words; only those that a bounded table lacks are encoded, all of a piece at once, and
numpy puts the ids of the texts together. Words that are known never become Python objects.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Words that a generation of the table holds at most (some 50 MB), and bytes of the longest that it holds.
MEMO, LONGEST = 3 << 18, 23
#: Bytes of text whose distinct words are looked up together.
PIECE = 8 << 20
#: Texts to bytes of 32-bit ids.
Make = Callable[[list[str]], Sequence[bytes]]


def code_points() -> str:
    """Every character that UTF-8 can encode."""
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))


def ranges(chars: Iterable[str], form: str = "\\U{:08x}") -> str:
    """A character class for ``chars``, each written in ``form``; one that matches nothing, if there are none."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, chars)):
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{form.format(a)}-{form.format(b)}" for a, b in runs) + "]" if runs else r"[^\x00-\x{10FFFF}]" if "{{" in form else "(?!)"


def arrow_class(chars: Iterable[str]) -> str:
    """A character class in the syntax of Arrow's engine."""
    return ranges(chars, r"\x{{{:x}}}")


class Table:
    """Words of up to LONGEST bytes and their ids, open-addressed. A key is the word itself, in three 64-bit integers of
    which the last has its length, plus one, in its highest byte; 0 is a free slot."""

    def __init__(self, most: int) -> None:
        slots = 1 << max(4, (4 * most // 3 - 1).bit_length())
        self.count, self.mask, self.shift = 0, np.int64(slots - 1), np.uint64(65 - slots.bit_length())
        self.keys = [np.zeros(slots, "uint64") for _ in range(3)]
        self.start, self.size, self.owner = np.zeros(slots, "int32"), np.zeros(slots, "uint8"), np.zeros(slots, "int32")
        self.ids, self.used = np.empty(1 << 10, "int32"), 0

    @staticmethod
    def packed(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
        """The keys of the words of ``size`` bytes, LONGEST at most, that begin at ``begin`` in ``data``."""
        data = np.append(data, np.zeros(24, "uint8"))
        eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
        lows = np.array([(1 << 8 * i) - 1 for i in range(9)], "uint64")
        out = [eights[begin + 8 * i] & lows[np.clip(size - 8 * i, 0, 8)] for i in range(3)]
        out[2] |= (size + 1).astype("uint64") << np.uint64(56)
        return out

    def _places(self, keys: list[np.ndarray]) -> np.ndarray:
        h = (keys[0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (keys[2] * np.uint64(0x165667B19E3779F9))
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return (h >> self.shift).view("int64")

    def find(self, keys: list[np.ndarray]) -> np.ndarray:
        """The slot of each key, -1 where it is not there."""
        found, todo, at = np.full(len(keys[0]), -1, "int64"), np.arange(len(keys[0])), self._places(keys)
        while len(todo):
            last = self.keys[2][at]
            hit = (last == keys[2][todo]) & (self.keys[0][at] == keys[0][todo]) & (self.keys[1][at] == keys[1][todo])
            found[todo[hit]] = at[hit]
            on = ~hit & (last != 0)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return found

    def add(self, keys: list[np.ndarray], size: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Adds distinct new keys whose ids, ``size`` of each, stand one after another in ``ids``; gives their slots."""
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        start, slots = self.used + np.cumsum(size) - size, np.empty(len(size), "int64")
        self.used, self.count = self.used + len(ids), self.count + len(size)
        todo, at = np.arange(len(size)), self._places(keys)
        while len(todo):
            free = self.keys[2][at] == 0
            self.owner[at[free]] = todo[free]  # of several keys at one slot one wins
            won = free & (self.owner[at] == todo)
            new, place = todo[won], at[won]
            for own, key in zip(self.keys, keys, strict=True):
                own[place] = key[new]
            self.start[place], self.size[place], slots[new] = start[new], size[new], place
            todo, at = todo[~won], (at[~won] + 1) & self.mask
        return slots


def codes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word of an array of strings or bytes; words of up to LONGEST bytes take no Python objects."""
    n = len(words)
    offsets = np.frombuffer(words.buffers()[1], "int32", n + 1, 4 * words.offset)
    data = np.frombuffer(words.buffers()[2] or b"", "uint8")
    size, out = np.diff(offsets), np.empty(n, "uint64")
    short, h = np.flatnonzero(size <= LONGEST), np.uint64(0)
    for key in Table.packed(data, offsets[short].astype("int64"), size[short]):
        h = (h ^ key) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(31)
    out[short] = h
    for i in np.flatnonzero(size > LONGEST).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[offsets[i] : offsets[i + 1]].tobytes())
    return out


class Words:
    """``make``: the ids of words that a space stands before; ``whole``: those of texts that are not cut.

    A text is not cut if ``odd``, a pattern of Arrow's engine, finds anything in it, or where white space (``blanks``)
    follows a space.
    """

    def __init__(self, make: Make, whole: Make, blanks: Iterable[str], odd: Sequence[str] = (), most: int = MEMO) -> None:
        self.make, self.whole, self.most = make, whole, most
        self.new, self.old = Table(most), Table(0)
        self.odd = "|".join([" " + arrow_class(blanks), *odd])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after another as 32-bit integers, and where each text begins, and the last ends; a null
        counts as empty."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False)
        if not odd.any():
            return self._cut(texts)
        flat, ends = self._cut(texts.filter(pa.array(~odd)))
        parts: list[np.ndarray | None] = [None] * len(texts)
        for i, a, b in zip(np.flatnonzero(~odd).tolist(), ends.tolist(), ends[1:].tolist(), strict=False):
            parts[i] = flat[a:b]
        for i, data in zip(np.flatnonzero(odd).tolist(), self.whole(texts.filter(pa.array(odd)).to_pylist()), strict=True):
            parts[i] = np.frombuffer(data, "int32")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def _resolve(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and where those of each of the distinct words begin in them and how many they are."""
        n = len(words)
        offsets = np.frombuffer(words.buffers()[1], "int32", n + 1, 4 * words.offset)
        data = np.frombuffer(words.buffers()[2] or b"", "uint8")
        size = np.diff(offsets)
        short = np.flatnonzero(size <= LONGEST)
        if self.new.count + len(short) > self.most:
            self.old, self.new = self.new, Table(self.most)
        keys = Table.packed(data, offsets[short].astype("int64"), size[short])
        slots = self.new.find(keys)
        lost = np.flatnonzero(slots < 0)
        if len(lost):
            older = self.old.find([k[lost] for k in keys])
            again, lost = lost[older >= 0], lost[older < 0]
            older = older[older >= 0]
            made = self.make(words.take(pa.array(short[lost])).to_pylist())
            kept, count = self.old.size[older].astype("int64"), np.fromiter(map(len, made), "int64", len(made)) >> 2
            ids = np.concatenate([spread(self.old.ids, self.old.start[older], kept), np.frombuffer(b"".join(made), "int32")])
            both, count = np.append(again, lost), np.append(kept, count)
            # What does not fit stays out of the table: a piece with more words than a generation holds.
            fit = max(0, self.most - self.new.count)
            upto = int(count[:fit].sum())
            slots[both[:fit]] = self.new.add([k[both[:fit]] for k in keys], count[:fit], ids[:upto])
            out, out_ids, out_count = both[fit:], ids[upto:], count[fit:]
        else:
            out, out_ids, out_count = lost, np.empty(0, "int32"), np.empty(0, "int64")
        begin, length = np.zeros(n, "int64"), np.zeros(n, "int64")
        inside = slots >= 0
        begin[short[inside]], length[short[inside]] = self.new.start[slots[inside]], self.new.size[slots[inside]]
        long = np.flatnonzero(size > LONGEST)
        made = self.make(words.take(pa.array(long)).to_pylist()) if len(long) else []
        count = np.append(out_count, np.fromiter(map(len, made), "int64", len(made)) >> 2)
        extra = np.append(short[out], long)
        begin[extra], length[extra] = self.new.used + np.cumsum(count) - count, count
        return np.concatenate([self.new.ids[: self.new.used], out_ids, np.frombuffer(b"".join(made), "int32")]), begin, length

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not len(texts):
            return np.empty(0, "int32"), np.zeros(1, "int64")
        lists = pc.split_pattern(texts, " ")
        starts = lists.offsets.to_numpy()
        words = lists.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
        starts = (starts - starts[0]).astype("int64")
        place = words.indices.to_numpy().copy()
        # The first word of a text has no space before it: it is a word of its own kind, behind the others.
        kinds, first = np.unique(place[starts[:-1]], return_inverse=True)
        place[starts[:-1]] = len(words.dictionary) + first
        flat, begin, length = self._resolve(words.dictionary)
        made = self.whole(words.dictionary.take(pa.array(kinds)).to_pylist())
        count = np.fromiter(map(len, made), "int64", len(made)) >> 2
        begin, length = np.append(begin, len(flat) + np.cumsum(count) - count), np.append(length, count)
        sizes = length[place]
        out = spread(np.append(flat, np.frombuffer(b"".join(made), "int32")), begin[place], sizes)
        return out, np.append(0, np.cumsum(sizes))[starts]


def spread(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``size`` items that begin at ``begin`` in ``flat``, one after another."""
    upto = np.cumsum(size)
    total = int(upto[-1]) if len(upto) else 0
    kind = "int32" if max(total, len(flat)) < 2**31 else "int64"
    source = np.repeat((begin - upto + size).astype(kind), size)
    source += np.arange(total, dtype=kind)
    return flat[source]


def whites() -> set[str]:
    """What Python takes for white space."""
    return set(re.findall(r"\s", code_points())) | {c for c in code_points() if c.isspace()}
