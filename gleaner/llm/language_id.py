"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the n-grams of all languages: each of its places is a mask with a bit per language,
and the conjunction of the places of an n-gram is the set of languages that contain it. The bits are counted over all
n-grams of a text, each language's count is corrected for the false positives that the fill of its slice lets through,
and the highest corrected share decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.arrow import column, map_arrow, pieces, texts

#: Documents of each language that are learned from, about.
SAMPLE = 1500
#: Lengths of n-grams, letters and word ends; places of the filter (a power of two); hashes.
LENGTHS, LOG_PLACES, HASHES = (2, 3, 4), 20, 3
#: How often a language's sample has an n-gram that the language counts as containing: what is rarer may be a slip.
LEAST = 3
UNKNOWN = "und"
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], "uint64")
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_hashes(text: str) -> np.ndarray:
    """Hashes of the n-grams of a text in lower case; whatever is not a letter counts as one word end."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "uint32")
    letter = _is_letter()[codes]
    if not letter.any():
        return np.empty(0, "uint64")
    kept = letter | np.concatenate([[True], letter[:-1]])  # one end per run of others
    codes = np.concatenate([[32], np.where(letter, codes, 32)[kept], [32]]).astype("uint64")
    out = []
    for n in LENGTHS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, "uint64")
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out) if out else np.empty(0, "uint64")


@dataclass
class LanguageFilter:
    """``masks``: the places, each a mask with bit i for languages[i]; ``further``: the same for each 64 languages after the first."""

    languages: list[str]
    masks: np.ndarray
    further: tuple[np.ndarray, ...] = ()

    @staticmethod
    def build(grams: dict[str, np.ndarray]) -> LanguageFilter:
        languages = sorted(grams)
        masks = [np.zeros(1 << LOG_PLACES, "uint64") for _ in range(max(1, -(-len(languages) // 64)))]
        for i, name in enumerate(languages):
            for places in LanguageFilter.places(grams[name]):
                masks[i // 64][places] |= np.uint64(1 << i % 64)
        return LanguageFilter(languages, masks[0], tuple(masks[1:]))

    @staticmethod
    def places(hashes: np.ndarray) -> list[np.ndarray]:
        return [((hashes ^ (hashes >> np.uint64(31))) * _STEPS[k] >> np.uint64(64 - LOG_PLACES)).astype("int64") for k in range(HASHES)]

    def false_positives(self) -> np.ndarray:
        """For each language, the chance that an n-gram that is not in its slice seems to be."""
        tables = (self.masks, *self.further)
        return np.array([(((tables[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) ** HASHES for i in range(len(self.languages))])

    def shares(self, text: str, chance: np.ndarray) -> np.ndarray | None:
        """For each language, the corrected share of the text's n-grams that it contains; None without a letter."""
        hashes = gram_hashes(text)
        if not len(hashes):
            return None
        p, hits = self.places(hashes), np.zeros(len(self.languages))
        for word, masks in enumerate((self.masks, *self.further)):
            found = masks[p[0]]
            for x in p[1:]:
                found &= masks[x]
            kinds, counts = np.unique(found, return_counts=True)
            for i in range(64 * word, min(64 * word + 64, len(hits))):
                hits[i] = counts[(kinds >> np.uint64(i % 64)) & np.uint64(1) == 1].sum()
        return np.clip((hits / len(hashes) - chance) / np.maximum(1 - chance, 1e-9), 0, 1)

    def predict(self, text: str, chance: np.ndarray) -> tuple[str, float]:
        """The language with the highest share, ties to the first by name, and its part of all shares."""
        if not self.languages or (shares := self.shares(text, chance)) is None:
            return UNKNOWN, 0.0
        best = int(np.argmax(shares))
        return self.languages[best], float(shares[best] / total) if (total := shares.sum()) else 0.0


def train(docs: DataFrame, use: Column | None = None, sample: int = SAMPLE) -> LanguageFilter:
    """The filter of ``docs`` (doc_id, text, lang).

    ``use`` picks the rows that may be learned from (all, if None). About ``sample`` documents of each language are
    learned from, chosen by a hash of doc_id, whole texts each. Rows without text or lang are left out; every language
    gets a slice, and each 64 languages take a table of masks. Every n-gram that a language's sample has LEAST times or
    more is in its slice, whatever other languages have it. N-grams are counted, and the masks of the filter's places put
    together, on the executors; what comes back are the places, a number that is fixed.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = (rows if use is None else rows.filter(use)).filter("text is not null and lang is not null")
    counts = rows.groupBy("lang").count().collect()  # a row for each language
    if not counts:
        return LanguageFilter.build({})
    shares = {r["lang"]: min(1.0, sample / r["count"]) for r in counts}
    names = sorted(shares)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_003))
    bars = docs.sparkSession.createDataFrame([(n, int(shares[n] * 1_000_003)) for n in names], "lang string, bar int")
    wanted = rows.join(F.broadcast(bars), "lang").filter(draw < F.col("bar"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = {n: i for i, n in enumerate(names)}
        for piece in pieces(batches):
            by: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(column(piece, "lang").to_pylist(), texts(piece), strict=True):
                by.setdefault(index[lang], []).append(gram_hashes(text))
            for i, x in by.items():
                grams, n = np.unique(np.concatenate(x), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), i, "int32")), pa.array(grams.view("int64")), pa.array(n.astype("int64"))], ["lang", "gram", "n"])

    found = map_arrow(wanted.select("lang", "text"), run, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = column(batch, "lang").to_numpy()
            bit = (np.uint64(1) << (lang % 64).astype("uint64")).view("int64")
            for places in LanguageFilter.places(column(batch, "gram").to_numpy().view("uint64")):
                yield pa.RecordBatch.from_arrays([pa.array(lang // 64), pa.array(places), pa.array(bit)], ["word", "place", "mask"])

    masks = map_arrow(found, place, "word int, place long, mask long").groupBy("word", "place").agg(F.bit_or("mask").alias("mask")).toPandas()
    model = LanguageFilter.build(dict.fromkeys(names, np.empty(0, "uint64")))
    for word, own in masks.groupby("word"):
        (model.masks, *model.further)[word][own.place.to_numpy()] = own["mask"].to_numpy("int64").view("uint64")
    return model


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) for each row of ``docs`` (doc_id, text), from the whole text alone.

    A text that is null or has no letter is "und" with score 0, and so is any without a language learned. Every row counts,
    repeated ones and those without doc_id too; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 8 MB for each 64 languages, whatever was learned

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chance = shared.value.false_positives()
        for piece in pieces(batches):
            found = [shared.value.predict(t, chance) for t in texts(piece)]
            yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, lang_pred string, score double")
