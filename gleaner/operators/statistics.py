"""Statistics as aggregates and Column arithmetic: intervals, effect sizes, tests, decompositions, agreement, terms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z95 = 1.959963984540054


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by the rational approximation 26.2.17 of Abramowitz and Stegun (error below 1e-7)."""
    x = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * x)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    return 2 * poly * F.exp(-x * x / 2) / math.sqrt(2 * math.pi)


def wilson(k: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The Wilson score interval of a proportion, null over no trials."""
    k, n = k.cast("double"), n.cast("double")
    p = F.try_divide(k, n)
    centre = p + F.try_divide(F.lit(z * z), 2 * n)
    spread = z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z / 4), n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    # At the ends the interval is exact, which rounding would miss by a sign.
    low = F.when(k == 0, 0.0).otherwise((centre - spread) / scale)
    return F.when(n > 0, low), F.when(k == n, F.when(n > 0, 1.0)).otherwise((centre + spread) / scale)


def fisher_interval(r: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """The interval of a correlation by Fisher's transformation; null for n <= 3."""
    half = F.when(n > 3, z / F.sqrt(n - 3))
    return F.tanh(F.atanh(r) - half), F.tanh(F.atanh(r) + half)


def prefix_sums(df: DataFrame, order: str, values: Sequence[str], keys: Sequence[str] = (), parts: int = 64) -> DataFrame:
    """``df`` with the sum of each of ``values`` over the rows before (``_before``) and over all rows (``_all``) of its key.

    ``order`` is a numeric column, distinct within a key. Rows are dealt into ranges of it by approximate quantiles, summed
    up within a range and over the few ranges, so that no task sees a whole key.
    """
    edges = sorted(set(df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.005)))
    part = F.lit(0)
    if edges:
        part = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(order)))
    rows = df.withColumn("_part", part)
    totals = rows.groupBy(*keys, "_part").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    group = Window.partitionBy(*(keys or [F.lit(0)]))
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_q"),
        *[F.coalesce(F.sum(f"_{v}").over(before), F.lit(0)).alias(f"_base_{v}") for v in values],
        *[F.sum(f"_{v}").over(group).alias(f"{v}_all") for v in values],
    )
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_in_{v}") for v in values])
    same = F.col("_part") == F.col("_q")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(totals, same)
    return out.select(*df.columns, *[(F.col(f"_in_{v}") + F.col(f"_base_{v}")).alias(f"{v}_before") for v in values], *[f"{v}_all" for v in values])


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, value, the number of its rows (c) and their rank from 1, ties sharing their mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    return prefix_sums(counts, value, ["c"], keys).select(*keys, value, "c", (F.col("c_before") + (F.col("c") + 1) / 2).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """Spearman's rank correlation per group; null where a side is constant. Equal pairs are counted before they meet their ranks."""
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("_n"))
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    for c, r in ((x, "_rx"), (y, "_ry")):
        ranks = average_ranks(rows, c, keys).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(c).alias("_v"), F.col("rank").alias(r))
        same = F.col(c) == F.col("_v")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        cells = cells.join(ranks, same).drop("_v", *[f"_k_{k}" for k in keys])
    n, rx, ry = F.col("_n"), F.col("_rx"), F.col("_ry")
    sums = cells.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * rx * ry).alias("xy"), F.sum(n * rx).alias("sx"), F.sum(n * ry).alias("sy"), F.sum(n * rx * rx).alias("xx"), F.sum(n * ry * ry).alias("yy"))
    m = F.col("n")
    vx, vy = F.col("xx") - F.col("sx") * F.col("sx") / m, F.col("yy") - F.col("sy") * F.col("sy") / m
    rho = F.when((vx > 1e-9) & (vy > 1e-9), (F.col("xy") - F.col("sx") * F.col("sy") / m) / F.sqrt(vx * vy))
    return sums.select(*keys, "n", F.round(rho, 6).alias("rho"))


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation from sums, null (not an error) where a side is constant."""
    n = F.count(F.lit(1))
    cov = F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y) / n
    vx, vy = (F.sum(F.col(c) * F.col(c)) - F.sum(c) * F.sum(c) / n for c in (x, y))
    return F.when((vx > 1e-9) & (vy > 1e-9), cov / F.sqrt(vx * vy))


def cohen_d(m1: Column, m2: Column, v1: Column, v2: Column, n1: Column, n2: Column) -> Column:
    pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2)
    return F.try_divide(m1 - m2, F.sqrt(pooled))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    p = F.try_divide((k1 + k2).cast("double"), n1 + n2)
    return F.try_divide(F.try_divide(k1.cast("double"), n1) - F.try_divide(k2.cast("double"), n2), F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2)))


def welch_t(m1: Column, m2: Column, v1: Column, v2: Column, n1: Column, n2: Column) -> tuple[Column, Column]:
    """Welch's t and its degrees of freedom."""
    a, b = v1 / n1, v2 / n2
    return F.try_divide(m1 - m2, F.sqrt(a + b)), F.try_divide((a + b) * (a + b), a * a / (n1 - 1) + b * b / (n2 - 1))


def minimum_effect(n1: Column, n2: Column, p: Column, z_alpha: float = Z95, z_power: float = 0.8416212335729143) -> Column:
    """The smallest difference of proportions that is found with the given power."""
    return (z_alpha + z_power) * F.sqrt(p * (1 - p) * (1 / n1 + 1 / n2))


def minimum_mean_effect(n1: Column, n2: Column, sd: Column, z_alpha: float = Z95, z_power: float = 0.8416212335729143) -> Column:
    """The smallest difference of means that is found with the given power, for values of one standard deviation."""
    return (z_alpha + z_power) * sd * F.sqrt(1 / n1 + 1 / n2)


def signal_flag(ratio: Column) -> Column:
    return F.when(F.abs(ratio) >= 2, "strong").when(F.abs(ratio) >= 1, "moderate").otherwise("weak")


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's statistic of a contingency table, its degrees of freedom and Cramer's V."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    rows, cols, all_ = (Window.partitionBy(*k) for k in ([a], [b], [F.lit(0)]))
    cells = cells.withColumn("r", F.sum("o").over(rows)).withColumn("c", F.sum("o").over(cols)).withColumn("n", F.sum("o").over(all_))
    # Absent cells add their expectation; all expectations add up to n, so the sum over present cells is enough.
    expected = F.col("r") * F.col("c") / F.col("n")
    out = cells.agg(
        F.sum(F.pow(F.col("o") - expected, 2) / expected).alias("s"), F.sum(expected).alias("e"), F.max("n").alias("n"), F.count_distinct(a).alias("i"), F.count_distinct(b).alias("j")
    )
    stat = F.col("s") + F.col("n") - F.col("e")
    return out.select(F.round(stat, 4).alias("chi2"), ((F.col("i") - 1) * (F.col("j") - 1)).alias("dof"), F.round(F.sqrt(F.try_divide(stat, F.col("n") * F.least(F.col("i") - 1, F.col("j") - 1))), 6).alias("cramers_v"))


def rank_sum(df: DataFrame, value: str, group: Column, keys: Sequence[str]) -> DataFrame:
    """Mann and Whitney's U of the rows where ``group`` holds against the others, its z and the share of wins."""
    rows = df.filter(F.col(value).isNotNull()).select(*keys, value, group.alias("_g"))
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"), F.count_if("_g").alias("a"))
    ranked = prefix_sums(counts, value, ["c"], keys).withColumn("_r", F.col("c_before") + (F.col("c") + 1) / 2)
    out = ranked.groupBy(*keys).agg(F.sum(F.when(F.col("a") > 0, F.col("a") * F.col("_r"))).alias("rs"), F.sum("a").alias("n1"), F.sum(F.col("c") - F.col("a")).alias("n2"))
    n1, n2 = F.col("n1"), F.col("n2")
    out = out.withColumn("u", F.col("rs") - n1 * (n1 + 1) / 2)
    return out.select(*keys, "n1", "n2", F.round("u", 1).alias("u"), F.round(F.try_divide(F.col("u") - n1 * n2 / 2, F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)), 6).alias("z"), F.round(F.try_divide(F.col("u"), n1 * n2), 6).alias("auc"))


def kolmogorov(df: DataFrame, value: str, group: Column) -> DataFrame:
    """The largest distance between the distribution functions of two groups."""
    steps = df.filter(F.col(value).isNotNull()).select(F.col(value).alias("v"), group.alias("g")).groupBy("v").agg(F.count_if("g").alias("a"), F.count_if(~F.col("g")).alias("b"))
    upto = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.col(f"{c}_all")
    gap = F.abs(upto("a") - upto("b"))
    return prefix_sums(steps, "v", ["a", "b"]).select(gap.alias("d")).agg(F.round(F.max("d"), 6).alias("ks"))


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Adjusted p-values over all rows: a test per row, so few."""
    up = Window.orderBy(p)
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    raw = df.withColumn("_q", F.col(p) * n / F.row_number().over(up))
    down = Window.orderBy(F.desc(p)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.withColumn(name, F.least(F.min("_q").over(down), F.lit(1.0))).drop("_q")


def decomposition(df: DataFrame, unit: str, later: Column, value: Column) -> DataFrame:
    """The change of a mean between two eras, split over units in a within and a between part (symmetric weights).

    Units of one era only count as entry and exit. within + between + turnover = change.
    """
    groups = df.groupBy(unit).agg(
        F.count(F.when(~later, 1)).alias("n0"), F.count(F.when(later, 1)).alias("n1"), F.avg(F.when(~later, value)).alias("m0"), F.avg(F.when(later, value)).alias("m1")
    )
    whole = groups.agg(F.sum("n0").alias("all_0"), F.sum("n1").alias("all_1"))
    g = groups.crossJoin(F.broadcast(whole)).withColumn("s0", F.col("n0") / F.col("all_0")).withColumn("s1", F.col("n1") / F.col("all_1"))
    both = F.col("m0").isNotNull() & F.col("m1").isNotNull()
    within = F.when(both, (F.col("s0") + F.col("s1")) / 2 * (F.col("m1") - F.col("m0")))
    between = F.when(both, (F.col("m0") + F.col("m1")) / 2 * (F.col("s1") - F.col("s0")))
    before, after = F.coalesce(F.col("s0") * F.col("m0"), F.lit(0.0)), F.coalesce(F.col("s1") * F.col("m1"), F.lit(0.0))
    return g.agg(
        F.count_if(both).alias("units"),
        F.round(F.sum(after) - F.sum(before), 6).alias("change"),
        F.round(F.sum(within), 6).alias("within"),
        F.round(F.sum(between), 6).alias("between"),
        F.round(F.sum(F.when(~both, after - before).otherwise(0.0)), 6).alias("turnover"),
    )


def diff_in_diff(df: DataFrame, treated: Column, later: Column, value: Column) -> DataFrame:
    cells = {f"m_{t}{p}": F.avg(F.when((treated if t else ~treated) & (later if p else ~later), value)) for t in (0, 1) for p in (0, 1)}
    out = df.agg(*[c.alias(n) for n, c in cells.items()])
    return out.withColumn("did", F.round((F.col("m_11") - F.col("m_10")) - (F.col("m_01") - F.col("m_00")), 6)).select(*[F.round(n, 6).alias(n) for n in cells], "did")


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two labels over rows that have both."""
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy(F.lit(0))
    cells = cells.withColumn("t", F.sum("n").over(total))
    agree = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("hit"))
    margins = cells.select("a", "n", F.lit(0).alias("side")).union(cells.select("b", "n", F.lit(1).alias("side"))).groupBy("a").agg(
        F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("x"), F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("y")
    )
    chance = margins.agg(F.sum(F.col("x").cast("double") * F.col("y")).alias("xy"))
    out = agree.crossJoin(F.broadcast(chance))
    po, pe = F.col("hit") / F.col("n"), F.col("xy") / (F.col("n").cast("double") * F.col("n"))
    return out.select("n", F.round(po, 6).alias("agreement"), F.round(F.try_divide(po - pe, 1 - pe), 6).alias("kappa"))


def retrieval_scores(truth: Column, predicted: Column) -> list[Column]:
    """tp, fp, fn, precision, recall and f1 as aggregates; rows where either is null do not count."""
    tp, fp, fn = F.count_if(truth & predicted), F.count_if(~truth & predicted), F.count_if(truth & ~predicted)
    return [
        tp.alias("tp"),
        fp.alias("fp"),
        fn.alias("fn"),
        F.round(F.try_divide(tp, tp + fp), 6).alias("precision"),
        F.round(F.try_divide(tp, tp + fn), 6).alias("recall"),
        F.round(F.try_divide(2 * tp, 2 * tp + fp + fn), 6).alias("f1"),
    ]


def term_counts(df: DataFrame, words: Column, corpus: Column) -> DataFrame:
    """Occurrences of each term in the rows where ``corpus`` holds (a) and in the others (b)."""
    return df.select(F.explode(words).alias("term"), corpus.alias("_c")).groupBy("term").agg(F.count_if("_c").alias("a"), F.count_if(~F.col("_c")).alias("b"))


def share_delta(df: DataFrame, terms: str, later: Column) -> DataFrame:
    """term, before, after (rows of each era with it, occurrences counted) and delta, the change of the share of rows."""
    whole = df.agg(F.count_if(~later).alias("_a"), F.count_if(later).alias("_b"))
    counts = df.select(later.alias("_l"), F.explode(terms).alias("term")).groupBy("term").agg(F.count_if(~F.col("_l")).alias("before"), F.count_if("_l").alias("after"))
    delta = F.try_divide(F.col("after"), F.col("_b")) - F.try_divide(F.col("before"), F.col("_a"))
    return counts.crossJoin(F.broadcast(whole)).select("term", "before", "after", F.round(delta, 6).alias("delta"))  # one row


def log_odds(counts: DataFrame, alpha: float = 0.01) -> DataFrame:
    """Log-odds of each term between two corpora with a Dirichlet prior (Monroe et al., 2008) and their z-scores."""
    whole = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"), F.count(F.lit(1)).alias("terms"))
    t = counts.crossJoin(F.broadcast(whole))
    x, y, prior = F.col("a") + alpha, F.col("b") + alpha, F.col("terms") * alpha
    delta = F.ln(x / (F.col("all_a") + prior - x)) - F.ln(y / (F.col("all_b") + prior - y))
    return t.select("term", "a", "b", F.round(delta, 6).alias("log_odds"), F.round(delta / F.sqrt(1 / x + 1 / y), 6).alias("z"))


def jensen_shannon(counts: DataFrame) -> DataFrame:
    """The divergence (in bits) between the term distributions of two corpora."""
    whole = counts.agg(F.sum("a").alias("all_a"), F.sum("b").alias("all_b"))
    t = counts.crossJoin(F.broadcast(whole)).withColumn("p", F.col("a") / F.col("all_a")).withColumn("q", F.col("b") / F.col("all_b"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    return t.agg(F.round(F.sum(part("p") + part("q")) / 2, 6).alias("jsd"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("only_b"), F.count_if((F.col("b") == 0) & (F.col("a") > 0)).alias("only_a"))


def regression(x: Column, y: Column) -> list[Column]:
    """Slope, intercept and r squared of a least-squares line as aggregates."""
    return [F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 4).alias("intercept"), F.round(F.regr_r2(y, x), 6).alias("r2")]


def robust_regression(df: DataFrame, x: Column, y: Column, keys: Sequence[str]) -> DataFrame:
    """Per group the slope of a least-squares line and its HC3 standard error, each residual divided by 1 minus its leverage."""
    rows = df.filter(x.isNotNull() & y.isNotNull()).select(*keys, x.cast("double").alias("x"), y.cast("double").alias("y"))
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.regr_slope("y", "x").alias("b"), F.regr_sxx("y", "x").alias("sxx"))
    both = rows.join(sums, list(keys))
    d = F.col("x") - F.col("mx")
    e = (F.col("y") - F.col("my") - F.col("b") * d) / (1 - 1 / F.col("n") - d * d / F.col("sxx"))
    out = both.groupBy(*keys, "n", "b", "sxx").agg(F.sum(d * d * e * e).alias("m"))
    return out.select(*keys, "n", F.round("b", 6).alias("slope"), F.round(F.sqrt("m") / F.col("sxx"), 6).alias("hc3"))


def kendall(df: DataFrame, x: str, y: str, most: int = 2000) -> DataFrame:
    """Kendall's tau-b of two columns with up to ``most`` values each; more raise an error.

    Pairs are counted from the table of cells by sums over smaller rows and smaller and larger columns; rows never meet.
    """
    cells = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count(F.lit(1)).alias("c"))
    xs, ys = cells.select("x").distinct(), cells.select("y").distinct()
    if max(xs.count(), ys.count()) > most:
        raise ValueError(f"over {most} values: bin them first")
    grid = xs.crossJoin(F.broadcast(ys)).join(cells, ["x", "y"], "left").fillna(0, ["c"])  # at most ``most`` by ``most`` cells
    above = Window.partitionBy("y").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("a", F.coalesce(F.sum("c").over(above), F.lit(0)))
    row = Window.partitionBy("x").orderBy("y")
    less, more = row.rowsBetween(Window.unboundedPreceding, -1), row.rowsBetween(1, Window.unboundedFollowing)
    grid = grid.withColumn("up", F.coalesce(F.sum("a").over(less), F.lit(0))).withColumn("down", F.coalesce(F.sum("a").over(more), F.lit(0)))
    pairs = lambda c: F.sum(c * (c - 1) / 2)
    score = grid.agg(F.sum(F.col("c") * (F.col("up") - F.col("down"))).alias("s"), F.sum("c").alias("n"))
    tx = cells.groupBy("x").agg(F.sum("c").alias("t")).agg(pairs(F.col("t")).alias("tx"))
    ty = cells.groupBy("y").agg(F.sum("c").alias("t")).agg(pairs(F.col("t")).alias("ty"))
    out = score.crossJoin(F.broadcast(tx)).crossJoin(F.broadcast(ty)).withColumn("p", F.col("n") * (F.col("n") - 1) / 2)  # one row each
    return out.select("n", F.round(F.try_divide(F.col("s"), F.sqrt((F.col("p") - F.col("tx")) * (F.col("p") - F.col("ty")))), 6).alias("tau"))


def class_terms(df: DataFrame, words: Column, of: Column, n: int) -> DataFrame:
    """The ``n`` terms of each class that weigh most by class-based TF-IDF: occurrences in the class times ln(1 + mean words
    of a class / occurrences in all)."""
    tf = df.select(of.alias("class"), F.explode(words).alias("term")).filter("class is not null").groupBy("class", "term").agg(F.count(F.lit(1)).alias("tf"))
    whole = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    mean = tf.agg((F.sum("tf") / F.count_distinct("class")).alias("a"))
    rows = tf.join(whole, "term").crossJoin(F.broadcast(mean)).withColumn("w", F.col("tf") * F.ln(1 + F.col("a") / F.col("f")))  # one row
    rank = F.row_number().over(Window.partitionBy("class").orderBy(F.desc("w"), "term"))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= n).select("class", "rank", "term", F.round("w", 4).alias("weight"))


def coherence(df: DataFrame, uid: str, words: Column, topics: DataFrame) -> DataFrame:
    """For each topic (topic, term; few terms each) the mean normalised pointwise mutual information of its pairs of terms
    over the documents, -1 for pairs that never meet, and the diversity: the share of its terms that no other topic has."""
    n = df.count()
    wanted = topics.select("term").distinct()
    held = df.select(F.col(uid).alias("d"), F.explode(F.array_distinct(words)).alias("term")).join(F.broadcast(wanted), "term")
    single = held.groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    inside = held.join(F.broadcast(topics.select("topic", "term").distinct()), "term").groupBy("d", "topic").agg(F.array_sort(F.collect_set("term")).alias("t"))
    i = F.explode(F.expr("flatten(transform(t, (a, i) -> transform(slice(t, i + 2, size(t)), b -> struct(a AS a, b AS b))))"))
    together = inside.select("topic", i.alias("p")).groupBy("topic", "p.a", "p.b").agg(F.count(F.lit(1)).alias("both"))
    listed = topics.select("topic", "term").distinct().join(single, "term", "left").fillna(0, ["k"])
    left, right = (listed.select("topic", F.col("term").alias(c), F.col("k").alias(f"k{c}")) for c in ("a", "b"))
    pairs = left.join(right, "topic").filter("a < b").join(together, ["topic", "a", "b"], "left").fillna(0, ["both"])
    p, pa, pb = F.col("both") / n, F.col("ka") / n, F.col("kb") / n
    npmi = F.when(F.col("both") == 0, -1.0).when(F.col("both") == n, 1.0).otherwise(F.ln(p / (pa * pb)) / -F.ln(p))
    alone = topics.select("topic", "term").distinct().withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("term"))).groupBy("topic").agg(F.avg((F.col("m") == 1).cast("int")).alias("diversity"))
    return pairs.groupBy("topic").agg(F.avg(npmi).alias("npmi")).join(alone, "topic").select("topic", F.round("npmi", 6).alias("npmi"), F.round("diversity", 6).alias("diversity"))
