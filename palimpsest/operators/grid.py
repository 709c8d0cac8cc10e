"""The result grid (seed, cond, train, test, kind, metric) and its paired statistics."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Conditions as (source, length, entities, temporal, random control of).
CONDITIONS: dict[str, tuple] = {
    "C0": ("0", 0, 0, 0, None), "S": ("1", 0, 0, 0, None), "L": ("0", 1, 0, 0, None), "E": ("0", 0, 1, 0, None),
    "SL": ("1", 1, 0, 0, None), "SE": ("1", 0, 1, 0, None), "LE": ("0", 1, 1, 0, None), "SLE": ("1", 1, 1, 0, None),
    "R_S": ("0", 0, 0, 0, "S"), "R_E": ("0", 0, 0, 0, "E"), "R_SE": ("0", 0, 0, 0, "SE"),
    "T": ("0", 0, 0, 1, None), "SLET": ("1", 1, 1, 1, None), "R_T": ("0", 0, 0, 0, "T"),
    "S_W": ("W", 0, 0, 0, None), "S_B": ("B", 0, 0, 0, None), "R_W": ("0", 0, 0, 0, "W"), "R_B": ("0", 0, 0, 0, "B"),
    "L_RE": ("0", 1, 0, 0, "E"), "L_RSE": ("0", 1, 0, 0, "SE"),
}
# Planned contrasts (name, condition, against) and further ones.
PLANNED = (("S_vs_R_S", "S", "R_S"), ("E_vs_R_E", "E", "R_E"), ("SE_vs_R_SE", "SE", "R_SE"), ("L_vs_C0", "L", "C0"), ("LE_vs_L_RE", "LE", "L_RE"), ("SLE_vs_L_RSE", "SLE", "L_RSE"))
FURTHER = (("S_vs_C0", "S", "C0"), ("E_vs_C0", "E", "C0"), ("LE_vs_C0", "LE", "C0"), ("SLE_vs_C0", "SLE", "C0"), ("R_SE_vs_C0", "R_SE", "C0"), ("L_RSE_vs_L", "L_RSE", "L"))
FACTORS = ("S", "L", "E")
TERMS = ("S", "L", "E", "SL", "SE", "LE", "SLE")


def conditions(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in CONDITIONS.items()], "cond string, s string, l int, e int, t int, rand_of string")


def pair_name(train: str = "train", test: str = "test") -> Column:
    return F.concat_ws("->", F.col(train).cast("string"), F.col(test).cast("string"))


def with_gap(cells: DataFrame, metric: str = "auc") -> DataFrame:
    """Cross cells with the in-domain metric of their (seed, cond, train) and gap = in - cross; two in-domain cells for a key are an error."""
    inn = cells.where("kind = 'in'").groupBy("seed", "cond", "train").agg(F.max(metric).alias("in_metric"), F.count("*").alias("k"))
    inn = inn.select("seed", "cond", "train", F.when(F.col("k") == 1, F.col("in_metric")).otherwise(F.raise_error(F.lit("more than one in-domain cell")).cast("double")).alias("in_metric"))
    x = cells.where("kind = 'cross'").join(inn, ["seed", "cond", "train"], "left")
    return x.withColumn("gap", F.col("in_metric") - F.col(metric))


def contrast(cells: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """(seed, value): mean over (train, test) cells of metric at condition a less b, where both are there. One shuffle, no self-join."""
    x = cells.where(F.col("cond").isin(a, b)).groupBy("seed", "train", "test")
    d = F.max(F.when(F.col("cond") == a, F.col(metric))) - F.max(F.when(F.col("cond") == b, F.col(metric)))
    return x.agg(d.alias("d")).where("d is not null").groupBy("seed").agg(F.avg("d").alias("value"))


def seed_means(cells: DataFrame, metric: str, *by: str) -> DataFrame:
    """Pairs weigh alike: the mean over pairs of each seed's pair means."""
    return cells.groupBy("seed", *by, "train", "test").agg(F.avg(metric).alias("m")).groupBy("seed", *by).agg(F.avg("m").alias("value"))


def t_cdf(t: float, df: int) -> float:
    """Student's t for whole degrees of freedom, by its finite trigonometric series."""
    if df < 1:
        return math.nan
    theta = math.atan(t / math.sqrt(df))
    s, c = math.sin(theta), math.cos(theta)
    if df % 2:
        total, term = 0.0, c
        for k in range(1, df - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        a = 2 / math.pi * (theta + (s * total if df > 1 else 0.0))
    else:
        total, term = 0.0, 1.0
        for k in range(0, df - 1, 2):
            total += term
            term *= c * c * (k + 1) / (k + 2)
        a = s * total
    return 0.5 + a / 2


def t_quantile(p: float, df: int) -> float:
    lo, hi = -1e4, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_cdf(mid, df) < p else (lo, mid)
    return (lo + hi) / 2


def t_critical(n: Column, most: int = 64, level: float = 0.95) -> Column:
    """The two-sided critical value for samples of n: up to ``most`` from a table made from the quantile, beyond by the expansion of
    Cornish and Fisher around the normal quantile, which is exact to nine digits there."""
    table = F.array(*(F.lit(t_quantile(0.5 + level / 2, k)) for k in range(1, most)))
    z, v = NormalDist().inv_cdf(0.5 + level / 2), (n - 1).cast("double")
    terms = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = F.lit(z)
    for i, t in enumerate(terms):
        far = far + F.lit(t) / F.pow(v, F.lit(i + 1))
    return F.when((n >= 2) & (n <= most), F.element_at(table, (n - 1).cast("int"))).when(n > most, far)


def gap_share(df: DataFrame, changed: str, base: str, least: float = 1e-12) -> DataFrame:
    """df with share, 1 - changed / base; a base near 0 is an error, as the ratio would mean nothing."""
    near = F.raise_error(F.concat(F.lit("gap near zero: "), F.col(base).cast("string"))).cast("double")
    return df.withColumn("share", F.when(F.abs(base) <= least, near).otherwise(1 - F.col(changed) / F.col(base)))


def summarise(values: DataFrame, by: tuple[str, ...], value: str = "value") -> DataFrame:
    """n, mean, sd, t interval, min, max, share of values with the mean's sign; the interval of one value is null."""
    m = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_if(F.col(value) > 0).alias("pos"), F.count_if(F.col(value) < 0).alias("neg"), F.count_if(F.col(value) == 0).alias("zero"))
    half = t_critical(F.col("n")) * F.col("sd") / F.sqrt("n")
    same = F.when(F.col("mean") > 0, F.col("pos")).when(F.col("mean") < 0, F.col("neg")).otherwise(F.col("zero"))
    return m.select(*by, "n", "mean", "sd", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"), "min", "max", same.alias("same_sign"))


def signflip(values: DataFrame, by: tuple[str, ...], value: str = "value", drop_zeros: bool = True, most: int = 20, draws: int = 200_000) -> DataFrame:
    """(by, n, p): two-sided sign-flip test of a zero mean: over all 2^n signs for n up to ``most``, else over ``draws`` random ones by hash."""
    x = values.where(F.col(value).isNotNull() & ((F.col(value) != 0) | F.lit(not drop_zeros)))
    g = x.groupBy(*by).agg(F.array_sort(F.collect_list(value)).alias("v")).withColumn("n", F.size("v"))
    last = F.when(F.col("n") <= most, F.expr(f"shiftleft(1, least(n, {most})) - 1")).otherwise(draws - 1)
    signs = g.withColumn("mask", F.explode(F.sequence(F.lit(0), last)))
    bit = lambda i: F.when(F.col("n") <= most, F.col("mask").bitwiseAND(F.pow(F.lit(2), F.least(i, F.lit(30))).cast("int")) > 0).otherwise(F.xxhash64("mask", i).bitwiseAND(F.lit(1)) > 0)
    total = F.aggregate(F.transform("v", lambda a, i: F.when(bit(i), -a).otherwise(a)), F.lit(0.0), lambda s, a: s + a)
    obs = F.aggregate("v", F.lit(0.0), lambda s, a: s + a)
    p = signs.groupBy(*by, "n").agg(F.avg((F.abs(total) >= F.abs(obs) - 1e-12).cast("double")).alias("p"))
    none = values.select(*by).distinct().join(p, list(by), "left") if by else p
    return none.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(1.0)).alias("p"))


def t_test(summary: DataFrame) -> DataFrame:
    """A summary (n, mean, sd) with p of the two-sided t test of a zero mean; null for one value or without spread. Summaries are few rows."""
    p = F.udf(lambda t, n: 2 * (1 - t_cdf(abs(t), n - 1)), "double")
    ok = (F.col("n") > 1) & (F.col("sd") > 0)
    return summary.withColumn("p", F.when(ok, p(F.when(ok, F.col("mean") / (F.col("sd") / F.sqrt("n"))).otherwise(0.0), F.when(ok, F.col("n")).otherwise(2).cast("int"))))


def said(n: str = "n", mean: str = "mean", lo: str = "lo", hi: str = "hi", same: str = "same_sign", digits: int = 3) -> Column:
    """'+0.123 [+0.100, +0.150] (4/5)'; without an interval 'NA' in its place, without a value 'NA' alone."""
    f = f"%+.{digits}f"
    whole = F.format_string(f"{f} [{f}, {f}] (%d/%d)", mean, lo, hi, same, n)
    return F.when(F.col(n) == 0, "NA").when(F.col(lo).isNull() | F.isnan(lo), F.format_string(f"{f} [NA, NA] (%d/%d)", mean, same, n)).otherwise(whole)


def holm(df: DataFrame, family: tuple[str, ...], p: str = "p", order: str = "label") -> DataFrame:
    """df with p_holm: step-down adjusted within each family; null p are outside of it."""
    fin = df.where(F.col(p).isNotNull())
    w = Window.partitionBy(*family).orderBy(p, order)
    fin = fin.withColumn("_m", F.count("*").over(Window.partitionBy(*family)) - F.row_number().over(w) + 1)
    fin = fin.withColumn("p_holm", F.max(F.least(F.lit(1.0), F.col("_m") * F.col(p))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_m")
    return fin.unionByName(df.where(F.col(p).isNull()).withColumn("p_holm", F.lit(None).cast("double")))


def factorial(cells: DataFrame, metric: str) -> DataFrame:
    """(seed, term, effect): twice the mean of metric times the +-1 code over the eight cells, averaged over pairs."""
    code = {f: F.when(F.instr("cond", f) > 0, 1).otherwise(-1) for f in FACTORS}
    base = cells.withColumns({f"_{f}": F.when(F.col("cond") == "C0", -1).otherwise(code[f]) for f in FACTORS})
    z = {t: [F.col(f"_{f}") for f in t] for t in TERMS}
    prod = {t: (c[0] if len(c) == 1 else c[0] * c[1] if len(c) == 2 else c[0] * c[1] * c[2]) for t, c in z.items()}
    per = base.groupBy("seed", "train", "test").agg(*((2 * F.avg(F.col(metric) * prod[t])).alias(t) for t in TERMS))
    tall = per.select("seed", F.explode(F.array(*(F.struct(F.lit(t).alias("term"), F.col(t).alias("v")) for t in TERMS))).alias("x")).select("seed", "x.term", "x.v")
    return tall.groupBy("seed", "term").agg(F.avg("v").alias("effect"))


def completeness(cells: DataFrame, keys: tuple[str, ...], domains: dict[str, list] | None = None) -> DataFrame:
    """Cells of the full product of each key's values that are missing, keys that are there more than once, and extra ones. Domains are tiny; where
    one is given, values that no cell has are missing and cells of other values are extra."""
    grid = None
    for k in keys:
        d = cells.select(k).distinct()
        if domains and k in domains:
            d = cells.sparkSession.createDataFrame([(v,) for v in domains[k]], [k]).select(F.col(k).cast(cells.schema[k].dataType).alias(k))
        grid = d if grid is None else grid.crossJoin(F.broadcast(d))  # domains of a design: tens of values
    n = cells.groupBy(*keys).agg(F.count("*").alias("n"))
    state = F.when(F.col("due").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").otherwise("once")
    return grid.withColumn("due", F.lit(True)).join(n, list(keys), "full").select(*keys, F.coalesce("n", F.lit(0)).alias("n"), state.alias("state"))


def violations(cells: DataFrame, metric: str = "auc", keys: tuple[str, ...] = ("seed", "cond", "train", "test")) -> DataFrame:
    """One row of counters: repeated keys, kind that contradicts train and test, metric null or outside [0, 1]."""
    twice = cells.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("repeated_keys"))
    kind = F.when(F.col("train") == F.col("test"), "in").otherwise("cross")
    one = cells.agg(F.count("*").alias("cells"), F.count_if(F.col("kind") != kind).alias("wrong_kind"), F.count_if(F.col(metric).isNull()).alias("null_metric"), F.count_if((F.col(metric) < 0) | (F.col(metric) > 1)).alias("out_of_range"))
    return one.crossJoin(twice)


def pending(jobs: DataFrame, done: DataFrame, cells_per_job: int) -> DataFrame:
    """Jobs (seed, cond, train) that are not wholly done; a partial one is to be run again."""
    whole = done.groupBy("seed", "cond", "train").agg(F.count_distinct("test").alias("n")).where(F.col("n") >= cells_per_job)
    return jobs.join(whole, ["seed", "cond", "train"], "left_anti")


def keep_last(df: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """One row for each key, the last by order; combined on the map side."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("x")).select(*keys, "x.*")
