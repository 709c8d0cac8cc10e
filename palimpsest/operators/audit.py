"""Checks of tables: quality counters, recorded claims, differences between files, blinded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators.corpus import is_missing


def quality(df: DataFrame, doc: str, text: str, label: str, cluster: str, dataset: str, n_words: str) -> DataFrame:
    """(check, n): missing texts and labels, invalid labels, wrong word counts, repeated ids, ids with both labels, clusters across datasets."""
    number = F.expr(f"try_cast(cast(`{label}` as string) as decimal(38, 18))")
    one = df.agg(
        F.count("*").alias("rows"),
        F.count_if(is_missing(F.col(text))).alias("missing_text"),
        F.count_if(is_missing(F.col(label))).alias("missing_label"),
        F.count_if(~is_missing(F.col(label)) & ~F.coalesce(number.isin(0, 1), F.lit(False))).alias("invalid_label"),
        F.count_if(T.raw_word_count(text) != F.col(n_words)).alias("n_words_mismatch"),
    )
    ids = df.groupBy(doc).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("both")).agg(F.count_if(F.col("n") > 1).alias("repeated_ids"), F.count_if(F.col("both")).alias("conflicting_ids"))
    across = df.groupBy(cluster).agg(F.count_distinct(dataset).alias("d")).agg(F.count_if(F.col("d") > 1).alias("shared_clusters"))
    x = one.crossJoin(ids).crossJoin(across)  # one row each
    return x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in x.columns))).alias("x")).select("x.*")


def claims(actual: DataFrame, recorded: DataFrame, key: str, value: str) -> DataFrame:
    """Recorded against actual counts: match, mismatch, not_recorded, not_found."""
    a, r = actual.select(key, F.col(value).alias("actual")), recorded.select(key, F.col(value).alias("recorded"))
    state = F.when(F.col("recorded").isNull(), "not_recorded").when(F.col("actual").isNull(), "not_found").when(F.col("actual") == F.col("recorded"), "match").otherwise("mismatch")
    return a.join(r, key, "full_outer").select(key, "actual", "recorded", state.alias("state"))


def table_diff(left: DataFrame, right: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(side, n) rows on one side only, and for each field the common rows in which it differs. Null equals null."""
    l = left.select(key, *(F.sha2(F.col(f).cast("string"), 256).alias(f"l_{f}") for f in fields), F.lit(True).alias("_l"))  # noqa: E741
    r = right.select(key, *(F.sha2(F.col(f).cast("string"), 256).alias(f"r_{f}") for f in fields), F.lit(True).alias("_r"))
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    x = l.join(r, key, "full_outer").agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(both).alias("common"), *(F.count_if(both & ~F.col(f"l_{f}").eqNullSafe(F.col(f"r_{f}"))).alias(f"differs_{f}") for f in fields))
    return x.select(F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("n")) for c in x.columns))).alias("x")).select("x.*")


def within_report(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Counters of a hashed table (n_words, h_text_light, h_text_strip, h_title_light, is_fake) by dataset: rows, short rows, repeated texts and conflicting groups."""
    base = df.groupBy(dataset).agg(F.count("*").alias("raw"), F.count_if(F.col("n_words") < 20).alias("short"), F.sum((F.col("n_words") >= 20).cast("long")).alias("kept_length"))
    out = base
    for h, name in (("h_text_light", "light"), ("h_text_strip", "strip"), ("h_title_light", "title")):
        g = df.where((F.col("n_words") >= 20) & F.col(h).isNotNull()).groupBy(dataset, h).agg(F.count("*").alias("n"), (F.min("is_fake") != F.max("is_fake")).alias("c"))
        s = g.groupBy(dataset).agg(F.sum(F.col("n") - 1).alias(f"{name}_surplus"), F.count_if(F.col("n") > 1).alias(f"{name}_groups"), F.count_if(F.col("c")).alias(f"{name}_conflicts"))
        out = out.join(s, dataset, "left")
    return out.na.fill(0)


def cluster_stats(df: DataFrame, cluster: str, label: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    g = df.groupBy(*by, cluster).agg(F.count("*").alias("n"), (F.min(label) != F.max(label)).alias("c"))
    return g.groupBy(*by).agg(F.count_if(F.col("n") > 1).alias("clusters"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("docs"), F.max("n").alias("largest"), F.count_if(F.col("c")).alias("label_conflicts"))


def class_gate(df: DataFrame, by: tuple[str, ...], label: str, least: int, share: float) -> DataFrame:
    """n by class, the smaller class's share, and whether both conditions hold."""
    g = df.groupBy(*by).agg(F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1"))
    low = F.least("n0", "n1")
    return g.select(*by, "n0", "n1", (low / (F.col("n0") + F.col("n1"))).alias("min_share"), ((low >= least) & (low / (F.col("n0") + F.col("n1")) >= share)).alias("passes"))
