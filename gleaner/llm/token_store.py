"""A content-addressed store of token ids.

A rolling hash over the last ids cuts each document's id stream into chunks, so equal passages give equal chunks
wherever they stand. A chunk is stored once, under the hash of its bytes. A document's recipe lists its chunks and
ends in a Merkle root; the recipes are in ascending doc_id order, each with the number of ids before it.

Files of a store (Parquet folders below its path):

* ``rows``: the chunks, hash (16 bytes), n (ids), data (the ids as little-endian unsigned 32-bit integers), and the
  recipes as they were made, in rows without data;
* ``recipes``: part, doc_id, start, n_tokens, lengths (ids of each chunk), hashes (of each chunk, one after another),
  root; parts ascend by doc_id, and so do the rows of a part;
* ``manifest``: part, documents, tokens, root (over the roots of the part's recipes).

Reading checks each chunk's bytes against its hash and each recipe against its root. The checksum of a document
comes from those of its chunks (a CRC of joined bytes is an exclusive or of shifted CRCs), so a chunk that many
documents share is read once, and no document's ids meet in one place.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions.ship import ship
from gleaner.llm import store
from gleaner.llm.arrow import column, map_arrow, pieces
from gleaner.llm.words import MEMO, PIECE, Words, code_points, whites

#: Ids that the rolling hash sees; a chunk's least and largest length; one place in MEAN ends a chunk.
WINDOW, LEAST, MEAN, MOST = 8, 128, 512, 2048
HASH_BYTES = 16
#: The polynomial of CRC-32, lowest power first (fixed value of the format).
POLYNOMIAL = 0xEDB88320
#: What stands for a space in byte-level vocabularies (fixed value); chunks that one call of the library encodes.
SPACE, CALL = "\u0120", 1000


class TextEncoder:
    """The tokenizers library, asked for distinct words (:mod:`gleaner.llm.words`).

    Texts are cut into words where the tokenizer's file says that this changes nothing (byte-level BPE, nothing that
    normalises or adds a prefix) and the text holds neither an added token nor a character that only one of Python and
    the library takes for white space. The words of a piece that are new go to the library in one text: every id whose
    token begins with a space begins a word. Any other text goes to the library whole.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.tokenizer, made = Tokenizer.from_str(content), json.loads(content)
        kind = made.get("pre_tokenizer") or {}
        plain = not made.get("normalizer") and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        cuts = plain and made["model"].get("type") == "BPE" and not (made.get("truncation") or made.get("padding"))
        blanks = pre_tokenizers.Split(Regex(r"\S+"), "removed").pre_tokenize_str(code_points())
        blanks = whites() | set("".join(x for x, _ in blanks))
        added = [re.escape(t["content"]) for t in made.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(1 + max(vocabulary.values(), default=0), bool)
        self.starts[[i for t, i in vocabulary.items() if t.startswith(SPACE)]] = True
        self.words = Words(self.spaced, self.whole, blanks, added if cuts else ["(?s)."])

    def whole(self, some: list[str]) -> list[bytes]:
        """The ids of each text by a call for itself."""
        return [np.array(x.ids, "uint32").tobytes() for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]

    def spaced(self, words: list[str]) -> list[bytes]:
        """The ids of words with a space before them."""
        found: list[bytes] = []
        for low in range(0, len(words), CALL):
            some = words[low : low + CALL]
            ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "uint32")
            at = np.flatnonzero(self.starts[ids])
            if len(at) != len(some) or at[0] or "" in some:
                found += self.whole([" " + w for w in some])
                continue
            data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            found += [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        return found


_encoders: dict[int, TextEncoder] = {}


def _encoder(content: Broadcast) -> TextEncoder:
    key = hash(content.value)
    if key not in _encoders:
        _encoders[key] = TextEncoder(content.value)
    return _encoders[key]


def chunk_places(ids: np.ndarray) -> np.ndarray:
    """Where a chunk may end: behind each id at which the rolling hash over the last WINDOW ids is low."""
    mixed = ids.astype("uint32") * np.uint32(0x9E3779B1) ^ (ids.astype("uint32") >> np.uint32(7)) * np.uint32(0x85EBCA6B)
    rolled = np.zeros(len(ids), "uint32")
    for k in range(WINDOW):  # the sum of the window's ids, each times a power of an odd number
        rolled[k:] += mixed[: max(0, len(ids) - k)] * np.uint32(pow(0x01000193, k, 1 << 32))
    rolled ^= rolled >> np.uint32(15)
    return np.flatnonzero(rolled * np.uint32(0xC2B2AE35) < np.uint32((1 << 32) // MEAN)) + 1


def chunk_ends(n: int, places: list[int]) -> list[int]:
    """Where the chunks of a stream of ``n`` ids end, given where they may. As none ends before LEAST ids, the places may
    come from a window that reaches back over the beginning of the stream."""
    ends, start = [], 0
    for p in places:
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= LEAST:
            ends.append(start := p)
    while n - start > MOST:
        start += MOST
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def chunk_hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=HASH_BYTES).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """The root of a binary hash tree; an odd node goes up as it is; no leaves: a hash of nothing."""
    level = leaves or [chunk_hash(b"")]
    while len(level) > 1:
        level = [chunk_hash(b"\x01" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The product of polynomials modulo POLYNOMIAL, bit-reversed as in CRC-32."""
    a, out = a.copy(), np.zeros_like(a)
    for i in range(31, -1, -1):
        out ^= np.where((b >> np.uint32(i)) & np.uint32(1), a, np.uint32(0))
        a = (a >> np.uint32(1)) ^ np.where(a & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return out


def shifted_crc(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What bytes with the CRC ``crc`` add to the CRC of a text in which ``after`` more bytes follow."""
    power = np.full(1, 1 << 23, "uint32")  # x to the 8th: one byte
    crc, after = crc.astype("uint32"), after.astype("uint64")
    while after.any():
        odd = (after & np.uint64(1)).astype(bool)
        crc[odd] = _product(crc[odd], np.broadcast_to(power, odd.sum()))
        power, after = _product(power, power), after >> np.uint64(1)
    return crc


@dataclass
class TokenStore:
    spark: SparkSession
    path: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 0) -> TokenStore:
    """Encodes ``docs`` (doc_id, text) and writes a store to ``path``, a folder in any store that Spark writes.

    ``tokenizer``: the content of a tokenizer's JSON file. Every text is encoded whole, without special tokens of the
    library, and ``end_id`` follows; a null counts as empty. Repeated rows are documents of their own, a null doc_id
    comes first; other columns are ignored; an empty table gives a store without chunks or recipes.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = _encoder(shared), set()
        for piece in pieces(batches, most=PIECE):
            ids, ends = coder.words.ids(column(piece, "text"))
            ids, ends = np.insert(ids.view("uint32"), ends[1:], np.uint32(end_id)).astype("<u4"), ends + np.arange(len(ends))
            places = chunk_places(ids)
            bounds = np.searchsorted(places, ends, "right")
            data = memoryview(ids.tobytes())
            hashes, sizes, datas, recipes = [], [], [], []
            for i, (low, high) in enumerate(zip(ends.tolist(), ends[1:].tolist(), strict=False)):
                stops = chunk_ends(high - low, (places[bounds[i] : bounds[i + 1]] - low).tolist())
                own = []
                for a, b in zip([0, *stops], stops, strict=False):
                    part = data[4 * (low + a) : 4 * (low + b)]
                    own.append(chunk_hash(part))
                    if own[-1] not in seen:
                        seen.add(own[-1])
                        hashes.append(own[-1]), sizes.append(b - a), datas.append(bytes(part))
                recipes.append((high - low, np.diff([0, *stops]).tolist(), b"".join(own), merkle_root(own)))
            if len(seen) > MEMO:
                seen.clear()
            k, m = len(hashes), len(recipes)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashes + [r[3] for r in recipes], pa.binary()),
                    pa.array([*sizes, *(r[0] for r in recipes)], pa.int64()),
                    pa.array(datas + [None] * m, pa.binary()),
                    pa.concat_arrays([pa.nulls(k, pa.int64()), column(piece, "doc_id")]),
                    pa.array([None] * k + [r[1] for r in recipes], pa.list_(pa.int32())),
                    pa.array([None] * k + [r[2] for r in recipes], pa.binary()),
                ],
                ["hash", "n", "data", "doc_id", "lengths", "hashes"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = map_arrow(rows, run, "hash binary, n long, data binary, doc_id long, lengths array<int>, hashes binary")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of neighbouring rows with equal chunks, the first. Recipes pass."""
        before, kept = None, None  # hash and data of the row before the batch, if it is a chunk
        for batch in batches:
            keys, data = column(batch, "hash"), column(batch, "data")
            n, offset = batch.num_rows, int(np.frombuffer(keys.buffers()[1], "int32")[keys.offset])
            halves = np.frombuffer(keys.buffers()[2], "uint64", 2 * n, offset).reshape(n, 2)
            chunk = data.is_valid().to_numpy(zero_copy_only=False)
            again = np.zeros(n, bool)
            again[1:] = (halves[1:] == halves[:-1]).all(axis=1) & chunk[1:] & chunk[:-1]
            twins = np.flatnonzero(again)
            same = pc.all(pc.equal(data.take(pa.array(twins)), data.take(pa.array(twins - 1)))).as_py() is not False
            if n and chunk[0] and before == keys[0].as_py():
                again[0], same = True, same and kept == data[0].as_py()
            if not same:
                raise ValueError("two chunks have one hash")
            if n:
                before, kept = (keys[-1].as_py(), data[-1].as_py()) if chunk[-1] else (None, None)
            yield batch.filter(pa.array(~again))

    # Chunks and recipes take one shuffle together: the texts are encoded once.
    # Chunks go by their hash; recipes by doc_id too, as equal documents have equal roots.
    dealt = made.repartition("hash", "doc_id").sortWithinPartitions("hash", F.col("data").isNull())
    dealt = map_arrow(dealt, once, "hash binary, n long, data binary, doc_id long, lengths array<int>, hashes binary")
    dealt.write.option("compression", "zstd").parquet(f"{path}/rows")
    both = spark.read.schema(dealt.schema).parquet(f"{path}/rows")
    recipes = both.filter("data is null").select("doc_id", F.col("n").alias("n_tokens"), "lengths", "hashes", F.col("hash").alias("root"))
    ordered = recipes.repartitionByRange("doc_id", "n_tokens", "root").sortWithinPartitions("doc_id", "n_tokens", "root")
    ordered = store.written(ordered.withColumn("part", F.spark_partition_id().cast("long")), "recipes")
    totals = ordered.groupBy("part").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    bases = totals.select("part", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("doc_id", "n_tokens", "root").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("base") + F.sum("n_tokens").over(inside) - F.col("n_tokens")
    placed = ordered.join(F.broadcast(bases), "part").withColumn("start", start).select("part", "doc_id", "start", "n_tokens", "lengths", "hashes", "root")
    placed.write.option("compression", "zstd").parquet(f"{path}/recipes")
    store.drop(ordered)

    files = TokenStore(spark, path)
    _manifest(files).write.parquet(f"{path}/manifest")
    return files


def _manifest(files: TokenStore) -> DataFrame:
    """part, documents, tokens and root of each part, from its recipes."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The chained root of each part's recipes, in their order."""
        at, state, n, tokens = None, b"", 0, 0
        for batch in batches:
            for part, root, size in zip(column(batch, "part").to_pylist(), column(batch, "root").to_pylist(), column(batch, "n_tokens").to_pylist(), strict=True):
                if part != at:
                    if at is not None:
                        yield pa.RecordBatch.from_pylist([{"part": at, "documents": n, "tokens": tokens, "root": state}])
                    at, state, n, tokens = part, b"", 0, 0
                state, n, tokens = chunk_hash(b"\x02" + state + root), n + 1, tokens + size
        if at is not None:
            yield pa.RecordBatch.from_pylist([{"part": at, "documents": n, "tokens": tokens, "root": state}])

    listed = files.table("recipes").select("part", "start", "root", "n_tokens").repartition("part").sortWithinPartitions("part", "start")
    return map_arrow(listed, roots, "part long, documents long, tokens long, root binary")


def verify(files: TokenStore) -> None:
    """Raises an error if a part's recipes are not those of its manifest: lost, repeated, swapped or added ones."""
    got, want = _manifest(files), files.table("manifest")
    same = [F.col(f"got.{c}").eqNullSafe(F.col(f"want.{c}")) for c in ("part", "documents", "tokens", "root")]
    both = got.alias("got").join(want.alias("want"), F.col("got.part") == F.col("want.part"), "full")
    wrong = both.filter(~(same[0] & same[1] & same[2] & same[3])).select(F.coalesce("got.part", "want.part").alias("part")).head(1)
    if wrong:
        raise ValueError(f"the recipes of part {wrong[0].part} do not match its manifest")


def _chunks(files: TokenStore) -> DataFrame:
    return files.table("rows").filter("data is not null").select("hash", "n", "data")


def references(files: TokenStore) -> DataFrame:
    """A row for each chunk of each document: doc_id, start, n_tokens, place, hash, n, after (ids of the document after it).

    A recipe that does not match its root raises an error, and so does a part that does not match its manifest.
    """
    verify(files)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "place", "hash", "n", "after"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                rows: list[tuple] = []
                for r in batch.slice(low, 2000).to_pylist():
                    own = [r["hashes"][i : i + HASH_BYTES] for i in range(0, len(r["hashes"]), HASH_BYTES)]
                    if merkle_root(own) != r["root"] or sum(r["lengths"]) != r["n_tokens"]:
                        raise ValueError(f"the recipe of document {r['doc_id']} does not match its root")
                    left = r["n_tokens"]
                    for place, (h, n) in enumerate(zip(own, r["lengths"], strict=True)):
                        left -= n
                        rows.append((r["doc_id"], r["start"], r["n_tokens"], place, h, n, left))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, types, strict=True)], names)

    recipes = files.table("recipes").select("doc_id", "start", "n_tokens", "lengths", "hashes", "root")
    return map_arrow(recipes, run, "doc_id long, start long, n_tokens long, place int, hash binary, n int, after long")


def read_checksums(files: TokenStore) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store's files.

    A chunk whose bytes do not give its hash raises an error; a chunk that is missing leaves ids_crc32 null.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, datas = column(batch, "hash"), column(batch, "data").to_pylist()
            for key, data in zip(keys.to_pylist(), datas, strict=True):
                if chunk_hash(data) != key:
                    raise ValueError(f"the chunk {key.hex()} does not match its hash")
            yield pa.RecordBatch.from_arrays([keys, pa.array([zlib.crc32(d) for d in datas], pa.int64())], ["hash", "crc"])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = column(batch, "crc")
            known = np.array(crc.fill_null(0).to_numpy(zero_copy_only=False), "uint32")
            moved = shifted_crc(known, 4 * column(batch, "after").to_numpy())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "start"), column(batch, "n_tokens"), pa.array(moved.astype("int64")), crc.is_null()], ["doc_id", "start", "n_tokens", "part", "lost"])

    sums = map_arrow(_chunks(files).select("hash", "data"), check, "hash binary, crc long")
    joined = references(files).join(sums, "hash", "left").select("doc_id", "start", "n_tokens", "after", "crc")
    moved = map_arrow(joined, shift, "doc_id long, start long, n_tokens long, part long, lost boolean")
    found = moved.groupBy("doc_id", "start", "n_tokens").agg(F.bit_xor("part").alias("ids_crc32"), F.bool_or("lost").alias("lost"))
    return found.select("doc_id", "start", "n_tokens", F.when(~F.col("lost"), F.col("ids_crc32")).alias("ids_crc32"))


def read_ids(files: TokenStore, start: int, end: int) -> DataFrame:
    """The chunks that hold the ids ``start`` to ``end`` of the whole stream: first (of the chunk in the stream), ids."""
    refs = references(files).withColumn("first", F.col("start") + F.col("n_tokens") - F.col("after") - F.col("n"))
    refs = refs.filter((F.col("first") < end) & (F.col("first") + F.col("n") > start))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(d, "<u4").astype("int64") for d in column(batch, "data").to_pylist()]
            yield pa.RecordBatch.from_arrays([column(batch, "first"), pa.array(ids, pa.list_(pa.int64()))], ["first", "ids"])

    return map_arrow(refs.join(_chunks(files).select("hash", "data"), "hash").select("first", "data"), unpack, "first long, ids array<long>")
