"""Binary metrics, agreement and bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def threshold_metrics(df: DataFrame, by: tuple[str, ...], score: str, label: str, cut: float = 0.5) -> DataFrame:
    """n, accuracy and F1 at score >= cut; F1 is 0 where it is undefined."""
    y, p = F.col(label) == 1, F.col(score) >= cut
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.avg((y == p).cast("double")).alias("accuracy"))
    f1 = F.when(F.col("tp") == 0, 0.0).otherwise(2.0 * F.col("tp") / (2.0 * F.col("tp") + F.col("fp") + F.col("fn")))
    return c.select(*by, "n", "accuracy", f1.alias("f1"))


def curve(df: DataFrame, by: tuple[str, ...], score: str, label: str) -> DataFrame:
    """Counts by distinct score, then running ones: windows see distinct scores, not rows."""
    g = df.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    w = Window.partitionBy(*by).orderBy(F.desc("s"))
    return g.withColumns({"tp": F.sum("p").over(w), "fp": F.sum("q").over(w)})


def roc_auc(df: DataFrame, by: tuple[str, ...], score: str, label: str) -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties as half; null without both kinds."""
    g = curve(df, by, score, label)
    area = F.sum(F.col("q").cast("double") * (F.col("tp") - F.col("p") * 0.5))
    out = g.groupBy(*by).agg(area.alias("area"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return out.select(*by, F.when((F.col("np") > 0) & (F.col("nq") > 0), F.col("area") / (F.col("np").cast("double") * F.col("nq"))).alias("auc"))


def average_precision(df: DataFrame, by: tuple[str, ...], score: str, label: str) -> DataFrame:
    """Sum over distinct thresholds of the rise in recall times precision; null without positives."""
    g = curve(df, by, score, label)
    out = g.groupBy(*by).agg(F.sum(F.col("p") * F.col("tp").cast("double") / (F.col("tp") + F.col("fp"))).alias("a"), F.sum("p").alias("np"))
    return out.select(*by, F.when(F.col("np") > 0, F.col("a") / F.col("np")).alias("ap"))


def kappa(df: DataFrame, by: tuple[str, ...], a: str, b: str) -> DataFrame:
    """n, raw agreement and Cohen's kappa of two 0/1 columns (rows with both); null where chance agreement is 1."""
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    g = x.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(a) == F.col(b)).cast("double")).alias("po"), F.avg(F.col(a).cast("double")).alias("pa"), F.avg(F.col(b).cast("double")).alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    return g.select(*by, "n", F.col("po").alias("agreement"), F.when(pe < 1, (F.col("po") - pe) / (1 - pe)).alias("kappa"))


def annotator_label(c: str) -> Column:
    """An annotator's word as 0 or 1, whatever its case and surrounding space; anything else is null."""
    x = F.lower(F.trim(F.col(c).cast("string")))
    # Words for either class.
    return F.when(x.isin("1", "fake", "f"), 1).when(x.isin("0", "real", "r"), 0)


def agreement(df: DataFrame, by: tuple[str, ...], a: str, b: str, label: str) -> DataFrame:
    """(by, n, agreement, kappa, consensus, consensus_agreement, consensus_kappa): two annotators' words against one another, and what they agree on
    against the data set's 0/1 label. Without ``by``, one row for all."""
    x = df.withColumns({"_a": annotator_label(a), "_b": annotator_label(b)})
    both = kappa(x, by, "_a", "_b")
    own = kappa(x.where(F.col("_a") == F.col("_b")), by, "_a", label).select(*by, F.col("n").alias("consensus"), F.col("agreement").alias("consensus_agreement"), F.col("kappa").alias("consensus_kappa"))
    return both.join(own, list(by), "left") if by else both.crossJoin(own)  # one row each


def kappa_interval(df: DataFrame, key: str, a: str, b: str, seed: int, draws: int = 2000) -> DataFrame:
    """2.5th and 97.5th percentile of kappa over resamples; rows are drawn by hash of (seed, resample, position).

    Rows count only by their cell of the 2 x 2 table, so a resample draws from four running totals, and no row is
    replicated: work is draws times rows, memory is four numbers.
    """
    x = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    t = x.agg(F.count("*").alias("n"), *(F.count_if((F.col(a) == i) & (F.col(b) == j)).alias(f"c{i}{j}") for i in (0, 1) for j in (0, 1)))
    rows = t.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).repartition(16, "draw").select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("pos"))
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.col("pos").cast("string"))), 1, 12), 16, 10).cast("long") % F.col("n")
    cell = F.when(F.col("h") < F.col("c00"), 0).when(F.col("h") < F.col("c00") + F.col("c01"), 1).when(F.col("h") < F.col("c00") + F.col("c01") + F.col("c10"), 2).otherwise(3)
    d = rows.withColumn("h", h).withColumn("cell", cell).groupBy("draw", "n").agg(*(F.count_if(F.col("cell") == i).cast("double").alias(f"k{i}") for i in range(4)))
    n = F.col("n")
    po, pa, pb = (F.col("k0") + F.col("k3")) / n, (F.col("k2") + F.col("k3")) / n, (F.col("k1") + F.col("k3")) / n
    pe = pa * pb + (1 - pa) * (1 - pb)
    k = d.select(F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))
    return k.agg(F.percentile("kappa", F.lit(0.025)).alias("lo"), F.percentile("kappa", F.lit(0.975)).alias("hi"))
