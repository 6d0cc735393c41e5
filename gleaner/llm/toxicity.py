"""Toxicity by multiple-instance learning.

Labels are known for documents only. Each sentence gets a score, a logistic function of the telling words that it
holds, and 0 without any; a document is toxic if any of its sentences is, so its score is the noisy-or of theirs with a
leak, 1 - (1 - leak) prod(1 - p). As sentences without telling words add nothing, a long clean document scores no higher
than a short one. The weights are trained through that noisy-or from the labels of whole documents, and the sentence
scores then show where the offence is.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from gleaner.llm import store
from gleaner.llm.arrow import column, map_arrow, pieces, texts

#: Labelled documents that are learned from, about; documents that a word needs to get a weight; the log likelihood ratio
#: that it needs (8: a chance of 6 in 100,000 for a word that has nothing to do with the label).
SAMPLE, LEAST, GAIN = 8000, 4, 8.0
#: Lengths (in bytes) of the beginnings of words that are features beside whole words: they catch inflected forms.
STEMS = (4, 5, 6)
STEPS, RATE, DECAY = 400, 0.1, 3e-5
#: Words that a worker remembers the features of.
MEMO = 150_000
#: Bytes of lower-case text: what ends a sentence becomes a line break, other ASCII than letters and digits a space.
_TABLE = bytes(
    10 if c in b".!?\n\r" else c if c >= 128 or chr(c).isalnum() and not 65 <= c <= 90 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)


def sentences(text: str) -> list[list[bytes]]:
    """The words of each sentence that has any."""
    return [w for s in text.encode().translate(_TABLE).split(b"\n") if (w := s.split())]


def features(word: bytes) -> list[bytes]:
    """The word and, marked, its beginnings."""
    return [word, *(b"^" + word[:n] for n in STEMS if len(word) > n)]


@dataclass
class Model:
    """``bias`` and ``weights``: the log-odds of a sentence by its distinct telling words; ``leak``: the log-odds of a
    document in which no sentence tells."""

    bias: float
    weights: dict[bytes, float]
    leak: float
    memo: dict[bytes, tuple[bytes, ...]] = field(default_factory=dict, compare=False, repr=False)

    def telling(self, words: list[bytes]) -> set[bytes]:
        """The features with a weight that the words have."""
        found: set[bytes] = set()
        for w in words:
            if (known := self.memo.get(w)) is None:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                known = self.memo[w] = tuple(f for f in features(w) if f in self.weights)
            if known:
                found.update(known)
        return found

    def sentence_logits(self, text: str) -> list[float]:
        """The log-odds of each sentence, minus infinity for those without telling words."""
        return [self.bias + sum(self.weights[f] for f in sorted(found)) if (found := self.telling(s)) else -math.inf for s in sentences(text)]

    def score(self, text: str) -> float:
        return -math.expm1(-(_softplus(self.leak) + sum(map(_softplus, self.sentence_logits(text)))))

    def to_json(self) -> str:
        return json.dumps([self.bias, {w.hex(): x for w, x in self.weights.items()}, self.leak])

    @staticmethod
    def from_json(content: str) -> Model:
        bias, weights, leak = json.loads(content)
        return Model(bias, {bytes.fromhex(w): x for w, x in weights.items()}, leak)


def _softplus(z: float) -> float:
    if z == -math.inf:
        return 0.0
    return z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))


def document_features(text: str) -> set[bytes]:
    return {f for w in {w for s in sentences(text) for w in s} for f in features(w)}


def gain(seen: Column, hit: Column, n: int, pos: int) -> Column:
    """The log likelihood ratio of a feature's presence (in ``seen`` documents, ``hit`` of them toxic) and the label, among
    ``n`` documents of which ``pos`` are toxic; 0 for a feature that speaks against it."""
    cells = ((hit, seen, pos), (seen - hit, seen, n - pos), (pos - hit, n - seen, pos), (n - pos - seen + hit, n - seen, n - pos))
    parts = [F.when(k > 0, k * F.ln(k.cast("double") * n / (row.cast("double") * col))).otherwise(0.0) for k, row, col in cells]
    return F.when(hit * n > seen * pos, parts[0] + parts[1] + parts[2] + parts[3]).otherwise(0.0)


def telling_sentences(text: str, index: dict[bytes, int]) -> list[list[int]]:
    """The telling features of each sentence that has any, as numbers."""
    lists = (sorted({index[f] for w in s for f in features(w) if f in index}) for s in sentences(text))
    return [x for x in lists if x]


def optimised(known: list[bytes], split: list[list[list[int]]], labels: list[int]) -> Model:
    """Weights of the ``known`` features that make the noisy-or of the sentences fit the labels of the documents, given the
    features of each document's telling sentences; without both labels, only a leak."""
    y = np.array(labels, float)
    n, pos = len(y), float(y.sum())
    if not 0 < pos < n:
        rate = min(max(pos / n if n else 0.0, 1e-3), 1 - 1e-3)
        return Model(0.0, {}, min(math.log(rate / (1 - rate)), -1.0))
    doc, sent, feat = [], [], []
    for d, s in enumerate(split):
        for x in s:
            sent += [len(doc)] * len(x)
            feat += x
            doc.append(d)
    doc, sent, feat = (np.array(x, np.int64) for x in (doc, sent, feat))
    # Parameters: the weights, the bias and the leak.
    theta = np.append(np.zeros(len(known)), [0.0, math.log(0.1 * pos / n)])
    mean, square = np.zeros(len(theta)), np.zeros(len(theta))
    for step in range(1, STEPS + 1):
        z = theta[-2] + np.bincount(sent, theta[feat], minlength=len(doc))
        heat = np.bincount(doc, np.logaddexp(0, z), minlength=n) + np.logaddexp(0, theta[-1])
        # d(-log likelihood)/dz: p for a clean document, -p (1-P)/P for a toxic one
        pull = np.where(y > 0, -1 / np.maximum(np.expm1(np.minimum(heat, 50)), 1e-9), 1.0) / n
        g = pull[doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(feat, g[sent], minlength=len(known)) + DECAY * theta[:-2], [g.sum(), pull.sum() / (1 + math.exp(-theta[-1]))])
        mean = 0.9 * mean + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        theta = theta - RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return Model(float(theta[-2]), dict(zip(known, theta[:-2].tolist(), strict=True)), float(theta[-1]))


def train(docs: DataFrame, labels: DataFrame, use: Column | None = None, sample: int = SAMPLE) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    ``use`` picks the label rows that may be learned from (all, if None). Of these about ``sample`` are learned from,
    chosen by a hash of doc_id, whole texts each. A repeated label row counts once, toxic if any of them is; each document
    row of a labelled doc_id is learned from. Rows without doc_id, label or text are left out; without any label row the
    model gives every text a low score.

    Features are counted and chosen on the executors, and texts stay there: the one task that fits the weights sees the
    numbers of the telling features only.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    known = known if use is None else known.filter(use)
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    share = min(1.0, sample / max(known.count(), 1))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_003)) < int(share * 1_000_003))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    chosen = store.written(rows.join(known, "doc_id").select("doc_id", "text", "toxic"), "toxicity-sample")
    n, pos = chosen.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            seen, hit = Counter(), Counter()
            for text, toxic in zip(texts(piece), column(piece, "toxic").to_pylist(), strict=True):
                found = document_features(text)
                seen.update(found)
                if toxic:
                    hit.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64()), pa.array([hit[f] for f in seen], pa.int64())], ["feature", "seen", "hit"])

    counts = map_arrow(chosen, count, "feature binary, seen long, hit long").groupBy("feature").agg(F.sum("seen").alias("seen"), F.sum("hit").alias("hit"))
    told = counts.filter(F.col("seen") >= LEAST).filter(gain(F.col("seen"), F.col("hit"), n, pos) >= GAIN)
    names = sorted(bytes(r.feature) for r in told.select("feature").collect())
    shared = spark.sparkContext.broadcast({f: i for i, f in enumerate(names)})
    lists = pa.list_(pa.list_(pa.int32()))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = [telling_sentences(t, shared.value) for t in texts(piece)]
            yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), column(piece, "toxic"), pa.array(found, lists)], ["doc_id", "toxic", "sentences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, list[list[int]], int]] = []
        for batch in batches:
            held += zip(*(column(batch, c).to_pylist() for c in ("doc_id", "sentences", "toxic")), strict=True)
        held.sort()
        yield pa.RecordBatch.from_arrays([pa.array([optimised(sorted(shared.value), [h[1] for h in held], [h[2] for h in held]).to_json()])], ["model"])

    numbered = map_arrow(chosen, number, "doc_id long, toxic int, sentences array<array<int>>")
    found = map_arrow(numbered.repartition(1), run, "model string").collect()
    return Model.from_json(found[0].model) if found else optimised([], [], [])


def with_scores(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` with the toxicity of ``text`` in the column ``name``, in the place of one that has that name already: 0 to 1.

    Null and empty texts have a score too. Every row counts, repeated ones and those without doc_id too; other columns
    stay as they are; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    if name == "text":
        raise ValueError("the score cannot stand in the place of the text")
    docs = docs.drop(name)
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array([score(t) for t in texts(piece)], pa.float64())], [*fields, name])

    return map_arrow(docs, run, StructType([*docs.schema.fields]).add(name, DoubleType()))


def toxic_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """doc_id, sentence (its number), score and the words of every sentence that scores ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            out = []
            for d, t in zip(column(piece, "doc_id").to_pylist(), texts(piece), strict=True):
                for i, (z, s) in enumerate(zip(shared.value.sentence_logits(t), sentences(t), strict=True)):
                    p = 0.0 if z == -math.inf else math.exp(-_softplus(-z))
                    if p >= least:
                        out.append((d, i, p, b" ".join(s).decode()))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "sentence", "score", "words"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, sentence int, score double, words string")


def fold(key: Column, of: int) -> Column:
    """crc32 of the key as text, modulo ``of``; a null key counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % of
