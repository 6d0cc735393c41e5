"""Exact Jaccard join of word shingles in their metric space.

The Jaccard distance d = 1 - |x & y| / |x | y| is a metric, and documents link at d <= r.

* A sample of documents, thinned out until they lie apart, are the pivots. A document that is near a pivot (d <= t, with
  t = (1 - r) / 2) is at home in the Voronoi cell of its nearest one. By the triangle inequality a partner of it is within
  d <= t + r of that pivot, and if it is near a pivot itself, within its own distance plus 2 r: into the cells that it is
  so close to, and no others, every document is replicated. What is within r of a pivot links with it at once. In a
  cell, only pairs with one document at home count, and the window |d(x, p) - d(y, p)| <= r rules pairs out. What is near
  no pivot is at home in the far cell: texts of different origin are at distance 1 from all pivots, where no window is
  narrow enough.
* A cell, the far one too, is cut further by pivots that are single shingles. A document's nearest ones are its own
  shingles, all at one distance, and a fixed order over all shingles, rare ones first, breaks the tie: its region is that of
  its first shingle. The triangle inequality (of set differences) bounds how many of its first shingles a partner can
  miss, so it is replicated into the regions of its first n - ceil(s n) + 1 shingles and no others (s the least
  similarity); two documents that link share one of these regions in the cell of one of them.
* A region is joined by recursion. Documents of it become pivots; every other document is compared with them, unless
  sizes, places, or the triangle inequality over the distances to the cell's pivot, or in the far cell to the region's
  first, rule the pair out. Links join documents to components, and a region is finished when all that were not pivots
  yet belong to one component. Pivots per round grow by a factor, so the rounds are few.

Documents with equal sets are one vertex. A comparison first bounds the symmetric difference from below by parity
bitmaps (about two bits per shingle); what passes is compared in full. Shingles are 64-bit hashes: within a pair of n
shingles in all, two differ and collide with a chance of n*n / 2**65 (n = 40,000: 4e-11). Vertices carry 64 bits of a
128-bit digest; collisions of the shorter are found by the longer, and another seed is taken.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import store
from gleaner.llm.arrow import column, map_arrow, pieces
from gleaner.llm.components import components
from gleaner.llm.words import codes, spread

#: Counters of shingle frequencies (they only order shingles; 8 MB where they are broadcast) and bits of the filter of
#: vertices with partners (it only saves work; 4 MB): fixed sizes, whatever the corpus.
LOG_COUNTERS, LOG_BITS = 22, 25
#: Counters, or bytes of bits, in a slice.
SLICE = 2048
#: Documents that are sampled as pivots, and the least distance between those that are kept.
PIVOTS, APART = 256, 0.6
#: The number of the far cell.
FAR = -1
#: Pivots of a region round by round, from its largest component; then this factor more each time, from the smallest.
GROWING, FACTOR = (1, 2, 4, 24), 8
#: Pivots up to which each row of a region is given them as a list; beyond, they are joined.
LISTED = 4
#: Vertices that a task remembers as dealt with.
MEMO = 1_600_000
#: Rows of a few numbers each that are broadcast (16 MB).
BROADCAST_ROWS = 400_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, words: int) -> list[np.ndarray]:
    """The distinct shingles of ``words`` words of each text as sorted 64-bit hashes; fewer words are one shingle; a null
    text, and one without words, has none."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))  # A to Z, and the six blanks of ASCII
    starts = parts.offsets.to_numpy().astype("int64")
    every = parts.values.slice(starts[0], starts[-1] - starts[0]).dictionary_encode()
    place, code = every.indices.to_numpy(), codes(every.dictionary)
    real = pc.binary_length(every.dictionary).to_numpy()[place] > 0  # blanks at the ends leave empty words
    starts = np.append(0, np.cumsum(real))[starts - starts[0]]
    flat = code[place[real]]
    whole = _rolled(flat, words) if len(flat) >= words else np.empty(0, "uint64")
    out = []
    for low, high in zip(starts.tolist(), starts[1:].tolist(), strict=False):
        n = high - low
        out.append(np.unique(whole[low : high - words + 1]) if n >= words else _rolled(flat[low:high], n) if n else np.empty(0, "uint64"))
    return out


def _rolled(codes: np.ndarray, words: int) -> np.ndarray:
    n = len(codes) - words + 1
    h = np.full(n, words, "uint64")
    for k in range(words):
        h = (h ^ codes[k : k + n]) * _MIX
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Pivots:
    """Sets of shingles that lie apart: their vertices and sizes, and for each of their shingles which of them have it."""

    names: list[int]
    sizes: np.ndarray
    tokens: np.ndarray
    begin: np.ndarray
    owners: np.ndarray

    @staticmethod
    def build(sets: list[np.ndarray], names: list[int]) -> Pivots:
        every = np.concatenate([*sets, np.empty(0, "uint64")])
        owners = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        order = np.argsort(every, kind="stable")
        tokens, begin = np.unique(every[order], return_index=True)
        return Pivots(names, np.array([len(x) for x in sets], "int64"), tokens, np.append(begin, len(every)), owners[order])

    def common(self, x: np.ndarray) -> np.ndarray:
        """How many shingles ``x`` has in common with each pivot."""
        if not len(self.tokens) or not len(x):
            return np.zeros(len(self.names), "int64")
        at = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
        at = at[self.tokens[at] == x]
        held = spread(self.owners, self.begin[at], self.begin[at + 1] - self.begin[at])
        return np.bincount(held, minlength=len(self.names))

    def cells(self, x: np.ndarray, part: int, whole: int) -> list[tuple[int, float, bool, bool]]:
        """The cells that a document belongs to: the pivot, its distance, whether the document is at home there, and
        whether it links with the pivot. Without a home among them it is at home in the far cell."""
        common = self.common(x)
        if not common.any():
            return []
        union = self.sizes + len(x) - common
        d, r = 1 - common / union, 1 - part / whole
        near, reach = (1 - r) / 2, (1 + r) / 2
        home = int(np.argmin(d))
        if d[home] <= near:
            reach = min(reach, d[home] + 2 * r)
        return [(int(i), float(d[i]), bool(i == home and d[home] <= near), bool(whole * common[i] >= part * union[i])) for i in np.flatnonzero(d <= reach + 1e-9)]


def sample_pivots(rows: DataFrame, words: int, seed: int) -> Pivots:
    """PIVOTS documents by a hash of doc_id, without those that are nearer than APART to an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in shingle_sets(column(piece, "text"), words)], pa.binary())], ["shingles"])

    drawn = rows.filter("text is not null").orderBy(F.xxhash64("doc_id", F.lit("pivot")), "doc_id").limit(PIVOTS)
    sets = sorted({r.shingles for r in map_arrow(drawn.select("text"), run, "shingles binary").collect()}, key=lambda x: hashlib.blake2b(x).digest())
    kept: list[np.ndarray] = []
    for x in (np.frombuffer(s, "uint64") for s in sets if s):
        common = np.array([len(np.intersect1d(x, y, assume_unique=True)) for y in kept], "int64")
        union = np.array([len(y) for y in kept], "int64") + len(x) - common
        if not (1 - common / np.maximum(union, 1) < APART).any():
            kept.append(x)
    return Pivots.build(kept, [vertex(x, seed)[0] for x in kept])


def vertex(shingles: np.ndarray, seed: int) -> tuple[int, bytes]:
    digest = hashlib.blake2b(shingles.tobytes(), digest_size=16, salt=seed.to_bytes(16, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True), digest


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap in which every shingle flips one bit; its size is the power of two above twice their number."""
    bits = 1 << max(6, int(2 * len(shingles) - 1).bit_length())
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype("int64"), minlength=bits) & 1
    return np.packbits(flips.astype("uint8"), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of the sets behind two bitmaps; the larger is folded."""
    x, y = (np.frombuffer(v, "uint8") for v in ((a, b) if len(a) <= len(b) else (b, a)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _slices(table: np.ndarray) -> list[tuple[int, bytes]]:
    """The slices of a table that hold anything, packed."""
    rows = table.reshape(-1, SLICE)
    return [(int(i), zlib.compress(rows[i].tobytes(), 1)) for i in np.flatnonzero(rows.any(axis=1))]


def _gathered(rows: DataFrame, kind: str, length: int, join: np.ufunc) -> np.ndarray:
    """A table of fixed size from its slices (slice, counts), joined by ``join`` on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(column(batch, "slice").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                got = np.frombuffer(zlib.decompress(data), kind)
                held[i] = join(held[i], got) if i in held else got
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in held.values()], pa.binary())], ["slice", "counts"])

    out = np.zeros(length, kind)
    for r in map_arrow(rows.select("slice", "counts").repartition("slice"), run, "slice int, counts binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), kind)
    return out


def jaccard_components(docs: DataFrame, words: int = 5, part: int = 80, whole: int = 100, carry: str | None = None) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    Two documents link when whole * |x & y| >= part * |x | y| for their sets of shingles of ``words`` words, in ASCII
    lower case; component_id is the smallest doc_id that links reach, the own included. A null or empty text has an
    empty set and links with nothing. Rows are documents of their own: repeated rows have equal sets and so one
    component; a null doc_id counts only where a component has no other. Other columns are ignored; an empty table
    gives an empty result.

    With ``carry``, the name of a text column, that column follows, and ``component_key``: a number that two rows share if
    they are of one component, also where a doc_id stands for several texts; null for empty sets.
    """
    if not 0 < part <= whole:
        raise ValueError("the least similarity must be above 0 and at most 1")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.col(carry) if carry else F.lit(None)).cast("string").alias("carried"))
    seed = 0
    while True:
        pivots = sample_pivots(rows, words, seed)
        read = store.written(_sets(rows, pivots, words, part, whole, seed), "jaccard-documents")
        sets = read.filter("slice is null")
        classes = sets.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("rep"), F.min("digest").alias("low"), F.max("digest").alias("high"))
        classes = store.written(classes, "jaccard-classes")
        if not classes.filter("low <> high").count():
            break
        seed += 1
    near = sets.filter("exists(cells, c -> c.linked)").select("id", F.explode(F.transform(F.filter("cells", lambda c: c["linked"]), lambda c: c["cell"])).alias("cell")).distinct()
    links = _links(rows, classes.select("id", "rep"), near, pivots, read.filter("slice is not null"), words, part, whole, seed)
    named = classes.select("id", "rep").join(links.withColumnRenamed("node", "id"), "id", "left")
    least = named.filter("root is not null").groupBy("root").agg(F.min("rep").alias("least"))
    named = store.written(named.join(least, "root", "left").select("id", F.when(F.col("root").isNull(), F.col("rep")).otherwise(F.col("least")).alias("component"), F.coalesce("root", "id").alias("key")), "jaccard-components")
    store.drop(classes)
    out = sets.select("doc_id", "n", "id", "carried").join(named, "id", "left")
    more = [F.col("carried").alias(carry), F.when(F.col("n") > 0, F.col("key")).alias("component_key")] if carry else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), *more)


REGION_COLUMNS = ("token", "id", "n", "place", "early", "near", "far", "home")
CELLS = "array<struct<cell:int,d:double,home:boolean,linked:boolean>>"


def _sets(rows: DataFrame, pivots: Pivots, words: int, part: int, whole: int, seed: int) -> DataFrame:
    """Each document's set size, vertex and cells; and, in rows with a slice, how often shingles of each counter occur."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)
    cell = pa.list_(pa.struct([("cell", pa.int32()), ("d", pa.float64()), ("home", pa.bool_()), ("linked", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, mask = np.zeros(1 << LOG_COUNTERS, "uint32"), np.uint64((1 << LOG_COUNTERS) - 1)
        kinds = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("digest", pa.binary()), ("carried", pa.string()), ("cells", cell), ("slice", pa.int32()), ("counts", pa.binary())])
        names_ = ("cell", "d", "home", "linked")
        for piece in pieces(batches):
            found = shingle_sets(column(piece, "text"), words)
            np.add.at(table, (np.concatenate(found) & mask).astype("int64"), np.uint32(1))
            names = [vertex(x, seed) for x in found]
            empty = pa.nulls(len(found), pa.int32()), pa.nulls(len(found), pa.binary())
            sizes = pa.array([len(x) for x in found], pa.int64())
            cells = pa.array([[dict(zip(names_, c, strict=True)) for c in shared.value.cells(x, part, whole)] for x in found], cell)
            yield pa.RecordBatch.from_arrays([column(piece, "doc_id"), sizes, pa.array([v[0] for v in names], pa.int64()), pa.array([v[1] for v in names], pa.binary()), column(piece, "carried"), cells, *empty], schema=kinds)
        held = _slices(table)
        for i in range(0, len(held), 256):
            some = held[i : i + 256]
            none = pa.nulls(len(some), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.string()), pa.nulls(len(some), cell), pa.array([s[0] for s in some], pa.int32()), pa.array([s[1] for s in some], pa.binary())], schema=kinds)

    return map_arrow(rows, run, f"doc_id long, n long, id long, digest binary, carried string, cells {CELLS}, slice int, counts binary")


def _links(rows: DataFrame, classes: DataFrame, near: DataFrame, pivots: Pivots, slices: DataFrame, words: int, part: int, whole: int, seed: int) -> DataFrame:
    """node and root for every vertex that links with another; ``slices`` are those of the counts of shingles."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    level = spark.sparkContext.broadcast(np.minimum(_gathered(slices, "uint32", 1 << LOG_COUNTERS, np.add), 65535).astype("uint16"))

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A document in each region that it may have partners in: cell and shingle as one key, vertex, size, place, and the
        distance d to the cell's pivot: null in the far cell, negative where the document is not at home; ``early``: its
        partner may be larger."""
        mask, seen = np.uint64((1 << LOG_COUNTERS) - 1), set()
        for piece in pieces(batches):
            out: list[tuple[np.ndarray, int, int, int, float]] = []
            for x in shingle_sets(column(piece, "text"), words):
                name = vertex(x, seed)[0]
                if not len(x) or name in seen:
                    continue
                seen.add(name)
                n = len(x)
                # Of sets that link, the smaller shares part/whole of the larger; 2 part/(whole+part) of its own size.
                late, early = n + (-part * n // whole) + 1, n + (-2 * part * n // (whole + part)) + 1
                found = shared.value.cells(x, part, whole)
                cells = [(c, d if home else -d) for c, d, home, _ in found]
                if not any(home for _, _, home, _ in found):
                    cells.append((FAR, np.nan))
                x = x[np.argsort(level.value[(x & mask).astype("int64")], kind="stable")[:late]]
                for c, d in cells:
                    key = x if c == FAR else (x ^ np.uint64(c + 1)) * _MIX
                    out.append((key.view("int64"), name, n, early, d))
            if len(seen) > MEMO:
                seen.clear()
            if out:
                size = [len(o[0]) for o in out]
                place = np.concatenate([np.arange(s, dtype="int32") for s in size])
                ids, sizes, early_, d = (np.repeat(np.array([o[k] for o in out], kind), size) for k, kind in ((1, "int64"), (2, "int32"), (3, "int32"), (4, "float64")))
                cols = (np.concatenate([o[0] for o in out]), ids, sizes, place, place < early_)
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(d, mask=np.isnan(d))], ["token", "id", "n", "place", "early", "d"])

    placed = map_arrow(rows.select("text"), replicate, "token long, id long, n int, place int, early boolean, d double")
    regions = store.written(_open_regions(placed, "id").select("token", "id", "n", "place", "early", "d").distinct(), "jaccard-regions")
    level.destroy(), shared.destroy()
    del level  # 8 MB of the driver
    centres = spark.createDataFrame([(i, name) for i, name in enumerate(pivots.names)], "cell int, centre long")
    roots = _merged(None, near.join(F.broadcast(centres), "cell").filter("id <> centre").select(F.col("id").alias("a"), F.col("centre").alias("b")))
    members = _members(rows, classes, regions, words, seed)
    done, known = [regions, members], None
    far = {"near": F.coalesce(F.abs("d"), F.lit(0.0)), "far": F.coalesce(F.abs("d"), F.lit(1.0)), "home": F.coalesce(F.col("d") >= 0, F.lit(True))}
    active = _with_components(regions.withColumns(far).select(*REGION_COLUMNS), roots)
    limit = 1 - part / whole + 1e-9
    store.give_back(spark)
    for step in range(10_000):
        # First a pass that compares each document with one pivot only; most links are found there.
        probe, rising = step == 0, step <= len(GROWING)
        pivots = 1 if probe else GROWING[step - 1] if rising else GROWING[-1] * FACTOR ** (step - len(GROWING))
        # All windows of a round share one shuffle by region. One order for all regions: neighbours choose the same pivots.
        order = Window.partitionBy("token").orderBy(F.desc("kin") if rising else F.asc("kin"), F.xxhash64("id"), "id")
        ranked = _open_regions(active, "comp").withColumn("kin", F.count("*").over(Window.partitionBy("token", "comp"))).withColumn("rank", F.row_number().over(order))
        listed = pivots <= LISTED
        if listed:
            pivot = F.when(F.col("rank") <= pivots, F.struct(*[F.col(c).alias(f"p_{c}") for c in ("id", "n", "place", "early", "near", "far", "home", "comp", "rank")]))
            ranked = ranked.withColumn("p", F.collect_list(pivot).over(Window.partitionBy("token")))
        ranked = store.written(ranked.drop("kin"), "jaccard-ranked")
        done.append(ranked)
        if not ranked.head(1):
            break
        if listed:
            pair = ranked.withColumn("p", F.explode("p")).select("*", "p.*").drop("p").filter((F.col("rank") > F.col("p_rank")) & (F.col("comp") != F.col("p_comp")))
        else:
            p = ranked.filter(F.col("rank") <= pivots).select(*[F.col(c).alias(f"p_{c}") for c in ranked.columns])
            pair = ranked.join(p, (F.col("token") == F.col("p_token")) & (F.col("rank") > F.col("p_rank")) & (F.col("comp") != F.col("p_comp")))
        pair = pair.filter(_may_link(part, whole)).filter((F.col("near") - F.col("p_far") <= limit) & (F.col("p_near") - F.col("far") <= limit))
        pair = pair.filter(F.col("home") | F.col("p_home"))
        if probe:
            pair = pair.groupBy("id").agg(F.min(F.struct(F.xxhash64("p_id").alias("h"), F.col("p_id").alias("p"))).alias("m")).select("id", F.col("m.p").alias("p_id"))
        pair = pair.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
        if known is not None:
            pair = pair.join(known.select("a", "b"), ["a", "b"], "left_anti")
        pair = store.written(pair, "jaccard-pairs")
        known, found = _with_compared(known, pair, members, words, part, whole, done)
        roots = _merged(roots, found.filter("linked").select("a", "b"))
        rest = ranked if probe else ranked.filter(F.col("rank") > pivots)
        if step == 1:
            # In the far cell, bounds of the distance to the region's first pivot stay with each document of the region.
            bounds = known.select(F.col("a").alias("x"), F.col("b").alias("y"), "low", "high").union(known.select("b", "a", "low", "high"))
            rest = rest.join(_small(bounds), (F.col("id") == F.col("x")) & (F.col("p")[0]["p_id"] == F.col("y")), "left")
            open_ = F.col("near") < F.col("far")
            rest = rest.withColumns({"near": F.when(open_, F.coalesce("low", "near")).otherwise(F.col("near")), "far": F.when(open_, F.coalesce("high", "far")).otherwise(F.col("far"))})
        active = _with_components(rest.select(*REGION_COLUMNS), roots)
        store.give_back(spark)  # the broadcasts of a round are not kept beside those of the next
    for table in done:  # the roots are a table of their own
        store.drop(table)
    return roots if roots is not None else spark.createDataFrame([], "node long, root long")


def _merged(roots: DataFrame | None, fresh: DataFrame) -> DataFrame | None:
    """The roots (node, root) of all vertices that links join, those in ``fresh`` (a, b) added."""
    if roots is not None:
        fresh = _renamed(fresh, roots)
    merged = components(fresh)
    if not merged.head(1):
        return roots
    if roots is not None:
        moved = roots.withColumnRenamed("root", "was").join(merged.withColumnRenamed("node", "was"), "was", "left")
        merged = moved.select("node", F.coalesce("root", "was").alias("root")).union(merged.join(roots, "node", "left_anti"))
    return store.written(merged, "jaccard-roots")


def _with_components(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``rows`` with the root of each id, itself where it links with nothing yet, in ``comp``."""
    if roots is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(_small(roots.withColumnRenamed("node", "id")), "id", "left").withColumn("comp", F.coalesce("root", "id")).drop("root")


def _open_regions(rows: DataFrame, comp: str) -> DataFrame:
    """The rows of regions that hold two components or more and a document that may meet a larger one."""
    region = Window.partitionBy("token")
    out = rows.repartition("token").withColumn("low", F.min(comp).over(region)).withColumn("high", F.max(comp).over(region)).withColumn("open", F.bool_or("early").over(region))
    return out.filter("low <> high and open").drop("low", "high", "open")


def _small(table: DataFrame) -> DataFrame:
    """``table``, marked for a broadcast if it has few rows; beyond, the same join shuffles."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _may_link(part: int, whole: int) -> Column:
    """Whether sizes and places let the documents of a pair link, if no shingle before theirs is common to them.

    The smaller one must have the shingle among its early ones, sizes must be near, and what is left behind the
    shingle, it included, must make up the least overlap.
    """
    small, large = F.least("n", "p_n").cast("long"), F.greatest("n", "p_n").cast("long")
    early = (F.col("early") & (F.col("n") <= F.col("p_n"))) | (F.col("p_early") & (F.col("p_n") <= F.col("n")))
    room = F.least(F.col("n") - F.col("place"), F.col("p_n") - F.col("p_place")).cast("long")
    return early & (whole * small >= part * large) & ((whole + part) * room >= part * (small + large))


def _members(rows: DataFrame, classes: DataFrame, active: DataFrame, words: int, seed: int) -> DataFrame:
    """id, size, parity bitmap and text of the vertices in ``active`` (and few others), once or, seldom, more often.

    Texts are not shuffled for this: each task looks up its documents in a filter of fixed size over (vertex, doc_id that
    stands for it).
    """
    bits = np.uint64((1 << LOG_BITS) - 1)

    def places(ids: np.ndarray, reps: np.ndarray) -> list[np.ndarray]:
        h = (ids.view("uint64") ^ (reps.view("uint64") * _MIX)) * _MIX
        return [((h >> np.uint64(s)) & bits).astype("int64") for s in (3, 21, 38)]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << LOG_BITS - 3, "uint8")
        for batch in batches:
            ids, reps = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "rep"))
            for p in places(ids.astype("int64"), reps.astype("int64")):
                np.bitwise_or.at(table, p >> 3, (1 << (p & 7)).astype("uint8"))
        held = _slices(table)
        yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in held], pa.int32()), pa.array([s[1] for s in held], pa.binary())], ["slice", "counts"])

    wanted = classes.join(active.select("id").distinct(), "id").select("id", F.coalesce("rep", F.lit(0).cast("long")).alias("rep"))
    table = _gathered(map_arrow(wanted, mark, "slice int, counts binary"), "uint8", 1 << LOG_BITS - 3, np.bitwise_or)
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = shingle_sets(column(piece, "text"), words)
            ids = np.array([vertex(x, seed)[0] for x in sets], "int64")
            reps = column(piece, "doc_id").fill_null(0).to_numpy()
            keep = np.ones(len(ids), bool)
            for p in places(ids, reps.astype("int64")):
                keep &= (shared.value[p >> 3] >> (p & 7).astype("uint8") & 1).astype(bool)
            kept = [i for i in np.flatnonzero(keep) if len(sets[i])]
            sizes = pa.array([len(sets[i]) for i in kept], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids[kept]), sizes, pa.array([parity_bits(sets[i]) for i in kept], pa.binary()), column(piece, "text").take(pa.array(kept, pa.int64()))], ["id", "n", "bits", "text"])

    out = store.written(map_arrow(rows, run, "id long, n long, bits binary, text string"), "jaccard-members")
    shared.destroy()
    return out


def _compared(pairs: DataFrame, members: DataFrame, words: int, part: int, whole: int) -> DataFrame:
    """a, b, low and high (bounds of the distance) and linked for the ``pairs`` (a, b).

    Bitmaps give a bound for every pair; where it lets the pair link, the sets give the distance. What is moved for
    that are the texts: they are shorter than their hashes.
    """

    def sides(pairs: DataFrame, kind: str) -> DataFrame:
        """Both sides' ``kind`` for each pair. Few pairs go to the members, so that only what is asked for moves."""
        few = _small(pairs.select("a", "b"))
        left = members.join(few, members["id"] == few["a"]).select("a", "b", "n", F.col(kind).alias("x"))
        right = members.join(few, members["id"] == few["b"]).select("a", "b", F.col("n").alias("m"), F.col(kind).alias("y"))
        return left.join(right, ["a", "b"])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = column(batch, "n").to_numpy() + column(batch, "m").to_numpy()
            apart = np.fromiter((least_difference(x, y) for x, y in zip(column(batch, "x").to_pylist(), column(batch, "y").to_pylist(), strict=True)), "int64", len(total))
            # Of n + m shingles, at most the part (whole - part) / (whole + part) is in one set alone, if they link.
            may = (whole + part) * apart <= (whole - part) * total
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), pa.array(2 * apart / (total + apart)), pa.array(may)], ["a", "b", "low", "may"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(pieces(batches, "x"), "y"):
            far, linked = [], []
            for one, two in zip(shingle_sets(column(batch, "x"), words), shingle_sets(column(batch, "y"), words), strict=True):
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int((two[at] == one).sum())
                union = len(one) + len(two) - common
                far.append(1 - common / union), linked.append(whole * common >= part * union)
            d = pa.array(far, pa.float64())
            yield pa.RecordBatch.from_arrays([column(batch, "a"), column(batch, "b"), d, d, pa.array(linked, pa.bool_())], ["a", "b", "low", "high", "linked"])

    bounds = store.written(map_arrow(sides(pairs, "bits"), bound, "a long, b long, low double, may boolean").distinct(), "jaccard-bounds")
    apart = bounds.filter("not may").select("a", "b", "low", F.lit(1.0).alias("high"), F.lit(False).alias("linked"))
    return map_arrow(sides(bounds.filter("may").select("a", "b"), "text"), exact, "a long, b long, low double, high double, linked boolean").distinct().union(apart)


def _with_compared(known: DataFrame | None, pairs: DataFrame, members: DataFrame, words: int, part: int, whole: int, done: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All pairs compared so far, read as one table, and those of ``pairs``; both tables are noted in ``done``."""
    found = store.written(_compared(pairs, members, words, part, whole), "jaccard-compared")
    done += [pairs, found]
    paths = [*(known.gleaner_paths if known is not None else ()), found.gleaner_path]
    both = found.sparkSession.read.schema(found.schema).parquet(*paths)
    both.gleaner_paths = paths
    return both, found


def _renamed(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges`` between the roots of their ends."""
    left, right = (roots.select(F.col("node").alias(c), F.col("root").alias(f"r_{c}")) for c in ("a", "b"))
    out = edges.join(left, "a", "left").join(right, "b", "left")
    return out.select(F.coalesce("r_a", "a").alias("a"), F.coalesce("r_b", "b").alias("b")).filter("a <> b").distinct()
