"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, media, mixing, neardup, quality, secrets, sharding, tokencount, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: five-word shingles, containment 0.8."""
    return decontam.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to weights 5, 2, 1; besides, the nested mix of half of every target."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), fractions=(0.5, 1.0))
    return out.select("doc_id", "size", "source_size", "target", "taken", "taken_50")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, by the separator scan over its flattened token files."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log weight, Gumbel key and whether the resampling keeps it, for every document."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a document is a repository and its source the owner."""
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recordings, rendered from all embeddings: class, and alignment with the recordings whose id is divisible by 50."""
    return media.align_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", rendered=True)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8, over all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15, counts at most one apart."""
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES: dict[str, Query] = {
    "op1_decontamination": op1_decontamination,
    "op2_mixing": op2_mixing,
    "op3_token_counts": op3_token_counts,
    "op4_quality": op4_quality,
    "op5_toxicity": op5_toxicity,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_media": op8_media,
    "op9_near_dedup": op9_near_dedup,
    "op10_sharding": op10_sharding,
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def shingle_sql(key: str, source: str, pattern: str, k: int) -> str:
    """Distinct k-word shingles (sh) by key of a table; with fewer words, the whole sequence as one."""
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {k} THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - {k - 2}), lambda i: array_to_string(ws[i:i + {k - 1}], ' ')) END) AS sh
    FROM (SELECT {key}, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{pattern}') AS ws FROM {source})"""


ALNUM = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def runs_sql(ws: str, k: str) -> str:
    """All runs of k words of a list of at least k."""
    return f"list_transform(range(1, (len({ws}) - {k} + 2)::BIGINT), lambda i: array_to_string({ws}[i:i + {k} - 1], ' '))"


SQL: dict[str, str] = {
    "op1_decontamination": rf"""
WITH w AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS ws FROM benchmark),
i AS (SELECT DISTINCT item_id, k, unnest({runs_sql("ws", "k")}) AS sh FROM (SELECT *, least(len(ws), 5) AS k FROM w) WHERE k > 0),
v AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '{ALNUM}') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest({runs_sql("ws", "k")}) AS sh FROM v, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k),
n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*) AS matched FROM d JOIN i USING (k, sh) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, matched, n_shingles, matched / n_shingles AS containment FROM m JOIN n USING (item_id)
WHERE matched >= ceil(0.8 * n_shingles - 1e-9)
""",
    "op2_mixing": r"""
WITH b AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS c,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM b GROUP BY source),
f AS (
  SELECT *, row_number() OVER o AS i,
    (sum(source_size) OVER () - coalesce(sum(c) OVER p, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS share
  FROM s WINDOW o AS (ORDER BY c::DOUBLE / w, source NULLS LAST),
    p AS (ORDER BY c::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min(share, i) AS level FROM f WHERE share <= c::DOUBLE / w),
t AS (SELECT source, source_size, least(c::DOUBLE, coalesce(level * w, c::DOUBLE)) AS target FROM f, l),
g AS (
  SELECT *, name * target AS want, CASE WHEN source_size > 0 THEN least(floor(name * target / source_size), 3) ELSE 0 END AS copies
  FROM t, (VALUES (0.5::DOUBLE), (1.0::DOUBLE)) v(name)),
r AS (
  SELECT b.doc_id, b.source, b.h, b.size, g.source_size, g.target, g.name, g.copies, g.want - g.copies * g.source_size AS budget,
    sum(b.size) OVER (PARTITION BY b.source, g.name ORDER BY b.h RANGE UNBOUNDED PRECEDING) AS upto,
    sum(b.size) OVER (PARTITION BY b.source, g.name, b.h) AS own
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source),
k AS (
  SELECT doc_id, h, size, source_size, target, name,
    size * (copies + CASE WHEN upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own)) THEN 1 ELSE 0 END) AS taken
  FROM r)
SELECT doc_id, size, source_size, target, max(taken) FILTER (name = 1)::BIGINT AS taken, max(taken) FILTER (name = 0.5)::BIGINT AS taken_50
FROM k GROUP BY doc_id, size, source_size, target
""",
    "op9_near_dedup": rf"""
WITH RECURSIVE s AS ({shingle_sql("doc_id", "documents", r"[^\x20\x09-\x0D]+", 4)}),
n AS (SELECT documents.doc_id, count(sh) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY documents.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)
""",
}
