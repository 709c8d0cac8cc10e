"""Building clean corpora: standard documents, hashes, short and duplicate rows, statistics, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T

#: Light-normalised words below which a document is dropped.
MIN_WORDS = 20
# Texts that stand for a missing value.
MISSING = ("", "#n/a", "#na", "<na>", "n/a", "na", "nan", "none", "null")


def standardize(df: DataFrame, dataset: Column, title: Column, body: Column, label: Column, order: Column) -> DataFrame:
    """(dataset, doc_id, title, text, is_fake): missing texts as empty, ids '<dataset>-<position>', labels 0 or 1 or an error."""
    pos = F.row_number().over(Window.partitionBy("dataset").orderBy("ordinal")) - 1
    flat = df.select(dataset.alias("dataset"), F.coalesce(title, F.lit("")).alias("title"), F.coalesce(body, F.lit("")).alias("text"), label.cast("int").alias("is_fake"), order.alias("ordinal"))
    ok = F.when(F.col("is_fake").isin(0, 1), F.col("is_fake")).otherwise(F.raise_error(F.lit("label outside 0/1")).cast("int"))
    return flat.select("dataset", F.concat_ws("-", "dataset", pos).alias("doc_id"), "title", "text", ok.cast("tinyint").alias("is_fake"), "ordinal")


def label_from(c: Column, fakes: tuple[str, ...]) -> Column:
    """1 for the given values, whatever their case and surrounding space, else 0."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin(*fakes), 1).otherwise(0)


def union_sources(parts: list[tuple[DataFrame, int]]) -> DataFrame:
    """Sources with one label each, as one table."""
    out = None
    for df, label in parts:
        df = df.withColumn("is_fake", F.lit(label))
        out = df if out is None else out.unionByName(df)
    return out


def clean_labels(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys trimmed and in lower case, values as numbers; nulls dropped, one row (the smallest value) for each key."""
    x = df.select(F.lower(F.trim(F.col(key).cast("string"))).alias("key"), F.expr(f"try_cast(`{value}` as double)").alias("value")).dropna()
    return x.groupBy("key").agg(F.min("value").alias("value"))


def with_hashes(df: DataFrame, title: str = "title", body: str = "body") -> DataFrame:
    """n_words, text_ns, six hashes (text, title, both; light and stripped) and the prefix hash."""
    x = df.withColumns({"_tl": T.norm_light(body), "text_ns": T.norm_strip(body), "_il": T.norm_light(title), "_is": T.norm_strip(title)})
    both = lambda a, b: F.when(F.col(b) != "", F.md5(F.concat(F.col(a), F.lit(" | "), F.col(b))))
    return x.withColumns({
        "n_words": F.size(T.words("_tl")),
        "h_text_light": T.digest("_tl"), "h_text_strip": T.digest("text_ns"),
        "h_title_light": T.digest("_il"), "h_title_strip": T.digest("_is"),
        "h_both_light": both("_il", "_tl"), "h_both_strip": both("_is", "text_ns"),
        "prefix": F.when(F.length("text_ns") >= T.PREFIX_CHARS, F.md5(F.substring("text_ns", 1, T.PREFIX_CHARS))),
    }).drop("_tl", "_il", "_is")


HASHES = ("h_text_light", "h_text_strip", "h_title_light", "h_title_strip", "h_both_light", "h_both_strip")


def exact_dedup(df: DataFrame, key: str, label: str, order: str, by: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Within each dataset: groups of equal key with both labels go whole, of the others the first stays.

    Counts by key come first and combine on the map side; only keys that repeat are looked at again, so a hot key is
    never gathered in a window. A null key is a key of its own for each row.
    """
    g = df.where(F.col(key).isNotNull()).groupBy(*by, key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    out = df.join(g, [*by, key], "left")
    return out.where(F.col("_n").isNull() | ((F.col("_lo") == F.col("_hi")) & (F.col(order) == F.col("_first")))).drop("_lo", "_hi", "_first", "_n")


def is_missing(c: Column) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*MISSING)


def strict_label(c: Column) -> Column:
    """0 or 1 if that is what the text says as a number, else null."""
    n = F.expr(f"try_cast({c._jc.toString()} as decimal(38, 18))")
    return F.when(n == 0, 0).when(n == 1, 1)


def length_stats(df: DataFrame, by: tuple[str, ...], n: str, title: str) -> DataFrame:
    """Counts, share, mean, median, 5th and 95th percentile of lengths, share of rows with a title."""
    total = df.groupBy(by[0]).agg(F.count("*").alias("_all"))
    out = df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(n).alias("mean_words"), *(F.percentile(n, F.lit(q)).alias(a) for q, a in ((0.5, "median_words"), (0.05, "p5_words"), (0.95, "p95_words"))), F.avg((F.col(title) != "").cast("int")).alias("title_present"))
    return out.join(total, by[0]).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def describe(df: DataFrame, by: tuple[str, ...], n: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count(n).alias("n"), F.avg(n).alias("mean"), F.stddev_samp(n).alias("sd"), F.min(n).alias("min"), *(F.percentile(n, F.lit(q)).alias(f"q{round(100 * q)}") for q in (0.25, 0.5, 0.75)), F.max(n).alias("max"))


def profile(df: DataFrame) -> DataFrame:
    """One row for each column: type, nulls, distinct values, median text length. One pass; distinct counts are exact."""
    kinds = dict(df.dtypes)
    agg = [F.count("*").alias("rows")]
    for i, c in enumerate(df.columns):
        agg += [F.count_if(F.col(c).isNull()).alias(f"nulls{i}"), F.count_distinct(F.col(c)).alias(f"distinct{i}")]
        agg.append((F.percentile(F.length(c), F.lit(0.5)) if kinds[c] == "string" else F.lit(None).cast("double")).alias(f"length{i}"))
    one = df.agg(*agg)
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(kinds[c]).alias("type"), F.col("rows"), F.col(f"nulls{i}").alias("nulls"), F.col(f"distinct{i}").alias("distinct_values"), F.col(f"length{i}").alias("median_length")) for i, c in enumerate(df.columns)]
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def repeated_lines(df: DataFrame, doc: str, body: str, least_words: int = 8) -> DataFrame:
    """(line hash, docs): lines of enough normalised words that more than one document has."""
    lines = df.select(doc, F.explode(F.split(F.col(body), "\n")).alias("line")).withColumn("norm", T.norm_light("line"))
    lines = lines.where(F.size(T.words("norm")) >= least_words).select(doc, F.md5("norm").alias("line_hash")).distinct()
    return lines.groupBy("line_hash").agg(F.count("*").alias("docs")).where("docs > 1")
