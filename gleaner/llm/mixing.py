"""Mixing sources to target weights, in DataFrame operations only.

The words of a source, its documents in a pseudorandom order, form one stream that is packed into blocks of a fixed
number of words. The mix is a row of slots per source, as many as its target needs. Slot j of a source takes the block
that a pseudorandom permutation of the source's blocks, another for each epoch, gives for it; the last slot is cut so
that the words add up to the target. How many slots of each source an output shard gets is drawn: the shards are halved
again and again, and each time the slots that a source has in a half are a binomial of one half. So a source's counts
over the shards are multinomial, their sums are the source's slots, and no shard needs to know another's.

The permutation is "swap or not" (Hoang, Morris, Rogaway 2012): a chain of involutions that permutes any number of
blocks, so each slot finds its block alone, and the reverse chain finds the slot of a block.

No step depends on the size of a single source: the n documents of a source are numbered in about sqrt(n) buckets with
the buckets' totals summed up before, and slots are dealt out by source and shard before they are unfolded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import store

#: What parts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a small table that may be broadcast; beyond, the same join shuffles.
BROADCAST_ROWS = 50_000
#: Slots that a task makes, about.
TASK_SLOTS = 100_000
ROUNDS = 12
#: Levels of halves that are drawn between two exchanges; the largest count whose half is drawn coin by coin (beyond,
#: by the normal distribution, which is as near as 1 in 100 there).
LEVELS, COINS = 8, 1 << 13


@dataclass
class Mix:
    """``documents``: a row for each of the input's; ``sources``: targets; ``draws``: how many slots of each source an
    output shard got; ``slots``: what it holds."""

    documents: DataFrame
    sources: DataFrame
    draws: DataFrame
    slots: DataFrame


def permuted(x: Column, n: Column, seed: Column, reverse: bool = False) -> Column:
    """The place of ``x`` in a pseudorandom permutation of 0 to n-1, or with ``reverse`` what is in that place."""
    rounds = F.sequence(F.lit(ROUNDS), F.lit(1)) if reverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def swap_or_not(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - at, n)
        swap = F.pmod(F.xxhash64(seed, r, F.greatest(at, other)), F.lit(2)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(rounds, x.cast("long"), swap_or_not)


def _bucket(key: str, rows: str) -> Column:
    """One of about sqrt(rows) buckets: as many as each has rows, so neither level of a running sum outgrows the other."""
    return F.pmod(F.col(key), F.ceil(F.sqrt(F.col(rows).cast("double"))))


def half(n: Column, *key: Column) -> Column:
    """A draw from the binomial distribution of ``n`` fair coins: the ones among ``n`` hashed bits, or from COINS on by the
    normal distribution of that mean and variance. Equal keys give equal draws."""
    coins = F.least(n, F.lit(COINS))
    whole, rest = F.floor(coins / 64), (coins % 64).cast("int")
    full = F.when(whole > 0, F.sequence(F.lit(1).cast("long"), whole)).otherwise(F.array().cast("array<long>"))
    ones = F.aggregate(full, F.lit(0).cast("long"), lambda at, w: at + F.bit_count(F.xxhash64(*key, w)))
    last = F.call_function("shiftrightunsigned", F.xxhash64(*key, F.lit(0).cast("long")), F.lit(64) - rest)
    ones = ones + F.when(rest > 0, F.bit_count(last)).otherwise(0)
    even = [(F.pmod(F.xxhash64(*key, F.lit(f"normal {i}")), F.lit(1 << 52)) + 1) / F.lit(float((1 << 52) + 1)) for i in (0, 1)]
    normal = F.sqrt(-2 * F.log(even[0])) * F.cos(2 * F.pi() * even[1])
    near = F.round(n / 2 + F.sqrt(n.cast("double")) / 2 * normal).cast("long")
    return F.when(n <= COINS, ones).otherwise(F.greatest(F.lit(0).cast("long"), F.least(n, near))).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def source_targets(sized: DataFrame, most: int = 3) -> DataFrame:
    """For each source of ``sized`` (source, size): its number, weight, rows, source_size and target.

    Sources by code point, null last, weigh 1, 2, 3, repeating. A target is the weight's share of all words, but not
    above ``most`` times the source's size; what is over goes to the others by weight. The level at which the rest
    share comes from one ordering by capacity per weight: sources fill up in that order.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    totals = totals.withColumn("number", F.row_number().over(order).cast("long") - 1).withColumn("weight", F.col("number") % 3 + 1)
    fill = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    room = F.lit(most) * F.col("source_size")
    spent = F.coalesce(F.sum(room).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) - spent) / open_weight.cast("double")
    totals = totals.withColumn("place", F.row_number().over(fill)).withColumn("level", level)
    first_open = F.min(F.when(F.col("level") * F.col("weight") <= room, F.struct("place", "level"))).over(whole)
    target = F.least(room.cast("double"), F.coalesce(first_open["level"], F.lit(0.0)) * F.col("weight"))
    return totals.select("source", "number", "weight", "rows", "source_size", target.alias("target"))


def mix(docs: DataFrame, block_words: int = 128, shard_slots: int = 4096, seed: int = 20240601, most: int = 3) -> Mix:
    """Mixes ``docs`` (doc_id, source, text) to the targets of :func:`source_targets`.

    documents: doc_id, source, size (words of the text; null or empty: 0), source_size, target (of its source), start
    (its first word in the source's stream), taken (words that the mix takes, repeats counted). slots: shard, number (of the
    source), slot, epoch, block, words. Every row counts, repeated ones and those with a null doc_id too; a null source is
    a source. Words taken of a source are its target, rounded; no document gives over ``most`` times its size. Other
    columns are ignored, an empty table gives empty results, and reruns agree.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
    )
    sized = store.written(sized, "mix-sizes")
    sources = store.written(source_targets(sized, most), "mix-sources")
    key = F.xxhash64(F.lit(seed), "doc_id")
    rows = sized.join(_small(sources).withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named")))
    rows = rows.drop("named").withColumn("key", key).withColumn("bucket", _bucket("key", "rows"))
    # Two levels of running sums give each document's first word in the stream of its source.
    totals = rows.groupBy("number", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("number", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("number", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.join(totals, ["number", "bucket"]).withColumn("start", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    rows = store.written(rows.select("doc_id", "source", "size", "number", "source_size", "target", "start"), "mix-starts")
    plan, draws = _draws(sources, block_words, shard_slots, seed)
    draws = store.written(draws, "mix-draws")
    slots = store.written(_slots(plan, draws, block_words, seed), "mix-slots")  # its size is then known to the planner
    uses = slots.groupBy("number", "block").agg(
        F.count(F.when(F.col("cut") == 0, 1)).alias("whole"), F.max("cut").alias("cut")
    )
    width, end = F.lit(block_words), F.col("start") + F.col("size")
    parts = rows.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))))
    from_, first = F.greatest(F.col("start"), F.col("block") * width), F.col("block") * width
    words = F.least(end, first + width) - from_
    cut = F.greatest(F.lit(0), F.least(end, first + F.col("cut")) - from_)
    taken = F.coalesce(F.col("whole") * words + F.when(F.col("cut") > 0, cut).otherwise(0), F.lit(0))
    keys = ["doc_id", "source", "size", "number", "source_size", "target", "start"]
    documents = parts.join(uses, ["number", "block"], "left").groupBy(*keys).agg(F.sum(taken).cast("long").alias("taken"))
    documents = documents.unionByName(rows.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
    return Mix(documents, sources, draws, slots.drop("cut"))


def copies(mixed: Mix, seed: int = 20240601) -> DataFrame:
    """How often whole documents stand for the words that the mix takes of them: doc_id, source, times (over 0).

    A document has floor(taken / size) copies, and the fractional parts are the chances of one more: they are summed up
    along the documents of a source, bands of like size one after another, and where the sum passes a whole number the
    document has the further copy. So copies of every length add up to what the mix takes, and the words of a source to
    its target but for about the longest document. No document has over ``most`` copies. Rows of one doc_id and source
    count as one document; documents without words are not in the mix and have none.
    """
    unit = 1 << 30  # fractions as whole numbers, so that sums do not depend on their order
    docs = mixed.documents.filter("size > 0").groupBy("doc_id", "source", "number").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size"))
    docs = store.written(docs, "mix-wholes")
    held = docs.groupBy("number").agg(F.count(F.lit(1)).alias("rows"))
    docs = docs.join(_small(held), "number")
    key = F.xxhash64(F.lit(seed + 2), "doc_id")
    docs = docs.withColumn("part", F.floor((F.col("taken") % F.col("size")) * F.lit(unit).cast("double") / F.col("size")))
    docs = docs.withColumn("key", key).withColumn("band", F.floor(F.log2("size") * 4)).withColumn("bucket", _bucket("key", "rows"))
    # Two levels of running sums, as in mix().
    totals = docs.groupBy("number", "band", "bucket").agg(F.sum("part").alias("parts"))
    before = Window.partitionBy("number").orderBy("band", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = F.pmod(F.xxhash64(F.lit(seed + 3), "number"), F.lit(unit))
    totals = totals.select("number", "band", "bucket", (first + F.coalesce(F.sum("parts").over(before), F.lit(0))).alias("base"))
    inside = Window.partitionBy("number", "band", "bucket").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    docs = docs.join(totals, ["number", "band", "bucket"]).withColumn("upto", F.col("base") + F.sum("part").over(inside))
    more = F.shiftright("upto", 30) - F.shiftright(F.col("upto") - F.col("part"), 30)
    times = (F.floor(F.col("taken") / F.col("size")) + more).cast("int")
    return docs.select("doc_id", "source", times.alias("times")).filter("times > 0")


def _draws(sources: DataFrame, block_words: int, shard_slots: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The slots that each source needs, and how many of them each output shard gets: shard, number, first, count.

    There are as many shards, a power of two, as give ``shard_slots`` slots to each or fewer, on average.
    """
    width = F.lit(block_words).cast("long")
    words = F.greatest(F.col("source_size"), F.lit(1))  # rows may be computed before they are filtered
    plan = sources.filter("source_size > 0 and target > 0").select("number", "source_size", F.round("target").cast("long").alias("need"))
    plan = (
        plan.withColumn("blocks", F.greatest(F.ceil(words / width), F.lit(1)))
        .withColumn("last", words - (F.col("blocks") - 1) * width)
        .withColumn("epochs", F.floor(F.col("need") / words))
        .withColumn("rest", F.col("need") % words)
        .withColumn("last_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.xxhash64(F.lit(seed), "number", "epochs"), reverse=True))
    )
    # Words before slot i of an epoch: i whole blocks, less what the source's last block lacks once it is past.
    lead, rest = F.col("last_at") * width, F.col("rest")
    late = rest + width - F.col("last")
    full = F.when(rest < lead, F.floor(rest / width)).when(rest < lead + F.col("last"), F.col("last_at")).otherwise(F.floor(late / width))
    cut = F.when(rest < lead, rest % width).when(rest < lead + F.col("last"), rest - lead).otherwise(late % width)
    plan = plan.withColumn("full", full.cast("long")).withColumn("cut_words", cut.cast("long"))
    plan = plan.withColumn("slots", (F.col("epochs") * F.col("blocks") + F.col("full") + F.when(F.col("cut_words") > 0, 1).otherwise(0)).cast("long"))
    plan = store.written(plan.filter("slots > 0"), "mix-plan")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    levels = max(0, -(-total // shard_slots) - 1).bit_length()
    rows = plan.select("number", F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("first"), F.col("slots").alias("count"))
    for level in range(levels):
        if level and level % LEVELS == 0:
            rows = rows.repartition("number", "shard")
        left = half(F.col("count"), F.lit(seed + 1), F.col("number"), F.lit(level), F.col("shard"))
        rows = rows.withColumn("left", left)
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("first").alias("first"), F.col("left").alias("count")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), (F.col("first") + F.col("left")).alias("first"), (F.col("count") - F.col("left")).alias("count")),
        )
        rows = rows.select("number", F.inline(halves)).filter("count > 0")
    return plan, rows.select("shard", "number", "first", "count")


def _slots(plan: DataFrame, draws: DataFrame, block_words: int, seed: int) -> DataFrame:
    """One row for each slot of the mix. ``cut``: words of the slot that is cut off, else 0."""
    width = F.lit(block_words).cast("long")
    total = plan.agg(F.sum("slots")).first()[0] or 0
    runs = draws.join(_small(plan), "number").repartition(1 + total // TASK_SLOTS, "number", "shard")  # a number that is asked for stays
    slots = runs.withColumn("slot", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("count") - 1)))
    slots = slots.withColumn("epoch", F.floor(F.col("slot") / F.col("blocks"))).withColumn("at", F.col("slot") % F.col("blocks"))
    slots = slots.withColumn("block", permuted(F.col("at"), F.col("blocks"), F.xxhash64(F.lit(seed), "number", "epoch")))
    is_cut = (F.col("cut_words") > 0) & (F.col("slot") == F.col("slots") - 1)
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("last")).otherwise(width)
    return slots.select(
        "shard",
        "number",
        "slot",
        "epoch",
        "block",
        F.when(is_cut, F.col("cut_words")).otherwise(length).alias("words"),
        F.when(is_cut, F.col("cut_words")).otherwise(F.lit(0)).alias("cut"),
    )


def block_texts(docs: DataFrame, mixed: Mix, block_words: int = 128) -> DataFrame:
    """The mix itself: shard, number, slot and the words of each slot, blocks joined by (source, index).

    ``docs`` must be the table that ``mixed`` was made from, with doc_id as its key.
    """
    width = F.lit(block_words)
    words = F.expr(r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")
    rows = docs.select("doc_id", words.alias("all")).join(mixed.documents.filter("size > 0").select("doc_id", "number", "start", "size"), "doc_id")
    end = F.col("start") + F.col("size")
    rows = rows.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((end - 1) / width))))
    first = F.greatest(F.col("start"), F.col("block") * width)
    part = F.slice("all", (first - F.col("start") + 1).cast("int"), (F.least(end, (F.col("block") + 1) * width) - first).cast("int"))
    blocks = rows.groupBy("number", "block").agg(F.sort_array(F.collect_list(F.struct(first.alias("first"), part.alias("part")))).alias("parts"))
    blocks = blocks.select("number", "block", F.flatten(F.col("parts.part")).alias("all"))
    held = mixed.slots.join(blocks, ["number", "block"])
    return held.select("shard", "number", "slot", "epoch", "block", F.slice("all", F.lit(1), F.col("words").cast("int")).alias("tokens"))
