"""Deterministic, cluster-aware, balanced and length-matched sampling, by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int | str, *keys: str) -> Column:
    """An order that depends on the seed and the keys alone, the same on any number of partitions."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def stratified(df: DataFrame, strata: tuple[str, ...], n: int, seed: int, key: str) -> DataFrame:
    """At most n rows of each stratum, the first in hash order.

    The window keeps n rows of each partition before it exchanges them (a group limit below the shuffle), so a large
    stratum is not gathered in one task.
    """
    rank = F.row_number().over(Window.partitionBy(*strata).orderBy(hash_order(seed, key), key))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def bin_edges(df: DataFrame, n: str, bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, edges): the distinct quantile edges of n (linear interpolation, exact) of each group."""
    q = F.array(*(F.lit(i / bins) for i in range(bins + 1)))
    return df.groupBy(*by).agg(F.array_distinct(F.percentile(n, q)).alias("edges"))


def length_bins(df: DataFrame, n: str, bins: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """df with bin: how many edges of its group n has reached, less one, within the bins. Ties can leave fewer bins."""
    edges = bin_edges(df, n, bins, by)
    x = df.join(edges, list(by)) if by else df.crossJoin(F.broadcast(edges))  # without groups, one row of bins + 1 edges
    at = F.size(F.filter("edges", lambda e: e <= F.col(n))) - 1
    return x.withColumn("bin", F.greatest(F.lit(0), F.least(at, F.size("edges") - 2))).drop("edges")


def length_quota(df: DataFrame, by: tuple[str, ...], label: str, n: int) -> DataFrame:
    """(by, bin, m, total, quota): m is what both classes can give in a bin, quota its share of min(n, total) per class."""
    c = df.groupBy(*by, "bin").agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")).withColumn("m", F.least("n0", "n1"))
    total = c.groupBy(*by).agg(F.sum("m").alias("total"))
    c = c.join(total, list(by)) if by else c.crossJoin(total)
    quota = F.when(F.col("total") > 0, F.floor(F.col("m").cast("double") * F.least(F.lit(n).cast("double"), F.col("total").cast("double")) / F.col("total"))).otherwise(0).cast("long")
    return c.select(*by, "bin", "n0", "n1", "m", "total", quota.alias("quota"))


def draw_balanced(df: DataFrame, by: tuple[str, ...], label: str, n: int, seed: int, key: str) -> DataFrame:
    """The same number of both classes, at most n of each, as the smaller class allows."""
    c = df.groupBy(*by).agg(F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1), F.lit(n)).alias("take"))
    ranked = stratified(df, (*by, label), n, seed, key)
    return ranked.join(c, list(by)).where("rank <= take").drop("take", "rank")


def draw_matched(df: DataFrame, by: tuple[str, ...], label: str, n: int, seed: int, key: str) -> DataFrame:
    """Quota rows of either class from each length bin."""
    quota = length_quota(df, by, label, n).select(*by, "bin", "quota")
    return stratified(df, (*by, "bin", label), n, seed, key).join(quota, [*by, "bin"]).where("rank <= quota").drop("quota", "rank")


def cluster_split(df: DataFrame, by: tuple[str, ...], cluster: str, fraction: float, seed: int) -> DataFrame:
    """df with role: clusters in hash order, the first floor(fraction * clusters) test, the others train."""
    c = df.select(*by, cluster).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(seed, *by, cluster), cluster))
    count = c.groupBy(*by).agg(F.floor(F.count("*") * F.lit(fraction)).alias("k"))
    role = c.withColumn("r", rank).join(count, list(by)).withColumn("role", F.when(F.col("r") <= F.col("k"), "test").otherwise("train")).drop("r", "k")
    return df.join(role, [*by, cluster])


def temporal_split(df: DataFrame, ts: str, cluster: str, q: float) -> DataFrame:
    """df with role by a quantile of time; test rows whose cluster has a train row are dropped. More than a fifth of rows without a time are an error;
    the others of them are dropped."""
    lost = F.count_if(F.col(ts).cast("timestamp").isNull()) > 0.2 * F.count("*")
    cut = df.agg(F.when(lost, F.raise_error(F.lit("more than a fifth of the rows have no time")).cast("double")).otherwise(F.percentile(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(q))).alias("cut"))
    x = df.where(F.col(ts).cast("timestamp").isNotNull()).crossJoin(F.broadcast(cut)).withColumn("role", F.when(F.unix_micros(F.col(ts).cast("timestamp")) <= F.col("cut"), "train").otherwise("test")).drop("cut")
    train = x.where("role = 'train'").select(cluster).distinct()
    return x.where("role = 'train'").unionByName(x.where("role = 'test'").join(train, cluster, "left_anti"))


def water_fill_cap(counts: DataFrame, by: tuple[str, ...], n: str, target: int) -> DataFrame:
    """(by, cap): the least cap at which the sum of min(n, cap) reaches the target, or the greatest n if it can't.

    For counts in order, a cap c keeps all of the smaller ones: sum(n < c) + c * (rows with n >= c). It is solved between
    neighbouring distinct counts, without trying every cap.
    """
    g = counts.groupBy(*by, F.col(n).alias("v")).agg(F.count("*").alias("rows"))
    w = Window.partitionBy(*by).orderBy("v")
    g = g.withColumn("below", F.coalesce(F.sum(F.col("v") * F.col("rows")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    g = g.withColumn("left", F.sum("rows").over(Window.partitionBy(*by).orderBy(F.desc("v"))))
    need = F.greatest(F.lit(1), F.ceil((F.lit(target) - F.col("below")) / F.col("left")))
    return g.groupBy(*by).agg(F.coalesce(F.min_by(need, F.when(need <= F.col("v"), F.col("v"))), F.max("v")).cast("long").alias("cap"))


def water_fill_sample(df: DataFrame, by: tuple[str, ...], outlet: str, target: int, seed: int, key: str) -> DataFrame:
    """At most cap rows of each outlet, then at most target rows of each class, by hash order."""
    counts = df.groupBy(*by, outlet).agg(F.count("*").alias("n"))
    cap = water_fill_cap(counts, by, "n", target)
    rank = F.row_number().over(Window.partitionBy(*by, outlet).orderBy(hash_order(seed, key), key))
    kept = df.withColumn("rank", rank).join(cap, list(by)).where("rank <= cap").drop("rank", "cap")
    return stratified(kept, by, target, seed + 1, key).drop("rank")


def fingerprint(df: DataFrame, by: tuple[str, ...], key: str, label: str, cluster: str) -> DataFrame:
    """(by, rows, sample_sha256): a digest of a sample that does not depend on row order.

    Row digests are combined by sum, so that no group is collected: the sums of the four 15-digit parts of each row's SHA-256.
    """
    h = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (key, label, cluster))), 256)
    part = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).alias(f"p{i}") for i in range(4)]
    x = df.groupBy(*by).agg(F.count("*").alias("rows"), *part)
    return x.select(*by, "rows", F.sha2(F.concat_ws("|", F.col("rows").cast("string"), *(F.col(f"p{i}").cast("string") for i in range(4))), 256).alias("sample_sha256"))


def stream_seed(seed: int | str, *keys: str) -> Column:
    """A seed of 31 bits for a stream of its own: CRC-32 of seed and keys, joined by hyphens."""
    return F.crc32(F.concat_ws("-", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)).cast("binary")) % F.lit(1 << 31)


def manifest(sample: DataFrame, by: tuple[str, ...], key: str, label: str, cluster: str) -> DataFrame:
    """(by, key, label, cluster, row_sha256): what a drawn sample consists of, to be written next to it and compared later."""
    h = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (key, label, cluster))), 256)
    return sample.select(*by, key, label, cluster, h.alias("row_sha256"))


def verify_manifest(recorded: DataFrame, found: DataFrame, by: tuple[str, ...], key: str, label: str, cluster: str, held_out: DataFrame | None = None) -> DataFrame:
    """(by, rows, missing, extra, changed, repeated, unbalanced, shared_clusters, ok): a sample against its manifest, whatever the order of rows.

    unbalanced: how far the classes' counts are apart; shared_clusters: clusters that held_out (by, cluster) has too.
    """
    now = manifest(found, by, key, label, cluster)
    left = recorded.groupBy(*by, key).agg(F.count("*").alias("nr"), F.max("row_sha256").alias("hr"))
    right = now.groupBy(*by, key).agg(F.count("*").alias("nf"), F.max("row_sha256").alias("hf"), F.max(label).alias("y"))
    x = left.join(right, [*by, key], "full")
    n = lambda c, name: F.count_if(c).alias(name)
    out = x.groupBy(*by).agg(n(F.col("nr").isNotNull(), "rows"), n(F.col("nf").isNull(), "missing"), n(F.col("nr").isNull(), "extra"), n(F.col("hr") != F.col("hf"), "changed"), n((F.col("nr") > 1) | (F.col("nf") > 1), "repeated"), F.abs(F.count_if(F.col("y") == 1) - F.count_if(F.col("y") == 0)).alias("unbalanced"))
    if held_out is None:
        out = out.withColumn("shared_clusters", F.lit(0).cast("long"))
    else:
        shared = now.select(*by, cluster).distinct().join(held_out.select(*by, cluster).distinct(), [*by, cluster], "left_semi").groupBy(*by).agg(F.count("*").alias("shared_clusters"))
        out = out.join(shared, list(by), "left").fillna(0, ["shared_clusters"])
    checks = ("missing", "extra", "changed", "repeated", "unbalanced", "shared_clusters")
    ok = F.lit(True)
    for c in checks:
        ok = ok & (F.col(c) == 0)
    return out.withColumn("ok", ok)
