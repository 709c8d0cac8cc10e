"""The library's own queries: each applies operators to the test tables; SQL gives the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import audit, corpus, grid, masks, metrics, overlap, sampling, tfidf
from palimpsest.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table. Documents whose file has fewer row groups than there are cores are spread over the cores, as the work on texts outweighs
    moving them; a table with more splits is read as it is."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name == "documents" and df.rdd.getNumPartitions() < cores else df


def docs(spark: SparkSession, d: str) -> DataFrame:
    """Documents as three corpora by source: A below 12, B below 15, C. Title is the first line; the label is the id's parity."""
    n = F.substring("source", 4, 9).cast("int")
    x = read(spark, d, "documents").select("doc_id", F.when(n < 12, "A").when(n < 15, "B").otherwise("C").alias("dataset"), T.title_of("text").alias("title"), T.body_of("text").alias("body"), "text", (F.col("doc_id") % 2).cast("int").alias("is_fake"), "source", "lang")
    return x


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return corpus.with_hashes(docs(spark, d))


def normed(spark: SparkSession, d: str) -> DataFrame:
    x = docs(spark, d).withColumn("ns", T.norm_strip("text"))
    return x.withColumn("n_words", F.size(T.words("ns")))


def r9(*cols: str):
    return [F.round(c, 9).alias(c) for c in cols]


# SQL pieces -------------------------------------------------------------------------------------------------------
C = """c AS (SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INT) < 12 THEN 'A' WHEN CAST(substr(source, 4) AS INT) < 15 THEN 'B' ELSE 'C' END AS dataset,
  split_part(text, chr(10), 1) AS title, CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END AS body,
  text, CAST(doc_id % 2 AS INT) AS is_fake, source, lang FROM documents)"""


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def strip(x: str) -> str:
    for p, to, f in ((r"https?://\S+|www\.\S+", " ", "gi"), (r"^\s*[A-Za-z .,''/&-]{1,40}\(\s*(?:reuters|ap|afp|upi)\s*\)\s*[-–—:]*\s*", "", "i"), (r"\(\s*(?:reuters|ap|afp|upi)\s*\)", " ", "gi"), (r"[@#][\p{L}\p{N}_]+", " ", "g"), (r"\breuters\b", " ", "gi")):
        x = f"regexp_replace({x}, '{p}', '{to}', '{f}')"
    return x


def ws(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def raw_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{T.WHITE}]+'))"


H = f"""{C}, h0 AS (SELECT *, {norm("body")} AS tl, {norm(strip("body"))} AS text_ns, {norm("title")} AS il, {norm(strip("title"))} AS isx FROM c),
h AS (SELECT doc_id, dataset, title, body, text, is_fake, source, text_ns, len({ws("tl")}) AS n_words,
  CASE WHEN tl <> '' THEN md5(tl) END AS h_text_light, CASE WHEN text_ns <> '' THEN md5(text_ns) END AS h_text_strip,
  CASE WHEN il <> '' THEN md5(il) END AS h_title_light, CASE WHEN isx <> '' THEN md5(isx) END AS h_title_strip,
  CASE WHEN tl <> '' THEN md5(il || ' | ' || tl) END AS h_both_light, CASE WHEN text_ns <> '' THEN md5(isx || ' | ' || text_ns) END AS h_both_strip,
  CASE WHEN length(text_ns) >= 300 THEN md5(substr(text_ns, 1, 300)) END AS prefix FROM h0)"""
N = f"""{C}, n0 AS (SELECT *, {norm(strip("text"))} AS ns FROM c), n AS (SELECT *, len({ws("ns")}) AS n_words FROM n0)"""


def shingle_sql(src: str, key: str, x: str, k: int, head: bool = False) -> str:
    w = f"({ws(x)})[1:100]" if head else ws(x)
    return f"""SELECT DISTINCT {key}, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END) AS sh FROM (SELECT {key}, {w} AS w FROM {src})"""


def near_sql(name: str, src: str, k: int, thr: float, least: int = 50, views: tuple[str, ...] = ("full", "head")) -> str:
    out = []
    for v in views:
        out.append(f"""{name}_{v}s AS ({shingle_sql(src, "doc_id", "ns", k, v == "head")}),
{name}_{v}n AS (SELECT doc_id, count(*) AS n FROM {name}_{v}s GROUP BY doc_id),
{name}_{v}p AS (SELECT x.doc_id AS i, y.doc_id AS j, count(*) AS b FROM {name}_{v}s x JOIN {name}_{v}s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY 1, 2),
{name}_{v} AS (SELECT i, j, b / (x.n + y.n - b) AS jaccard, CASE WHEN least(x.n, y.n) >= {least} THEN b / least(x.n, y.n) ELSE 0.0 END AS containment
  FROM {name}_{v}p JOIN {name}_{v}n x ON x.doc_id = i JOIN {name}_{v}n y ON y.doc_id = j)""")
    union = " UNION ALL ".join(f"SELECT * FROM {name}_{v} WHERE jaccard >= {thr} OR containment >= 0.9" for v in views)
    return ",\n".join(out) + f",\n{name} AS (SELECT i, j, max(jaccard) AS jaccard, max(containment) AS containment FROM ({union}) GROUP BY i, j)"


def reach_sql(name: str, nodes: str, edges: str) -> str:
    """name(node, cluster): the smallest node that edges(i, j) lead to. Needs WITH RECURSIVE."""
    return f"""{name}_e AS (SELECT i, j FROM {edges} UNION SELECT j, i FROM {edges}),
{name}_r AS (SELECT doc_id AS a, doc_id AS b FROM {nodes} UNION SELECT r.a, e.j FROM {name}_r r JOIN {name}_e e ON r.b = e.i),
{name} AS (SELECT a AS node, min(b) AS cluster FROM {name}_r GROUP BY a)"""


# Sources ------------------------------------------------------------------------------------------------------------
@query(f"WITH {C} SELECT doc_id, dataset, title, length(body) AS body_chars, is_fake FROM c")
def scan_documents(spark, d):
    return docs(spark, d).select("doc_id", "dataset", "title", F.length("body").alias("body_chars"), "is_fake")


@query("SELECT doc_id, lang, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS is_fake FROM documents WHERE lang IN ('en', 'fr')")
def union_labelled_sources(spark, d):
    x = read(spark, d, "documents").select("doc_id", "lang")
    return corpus.union_sources([(x.where("lang = 'en'"), 1), (x.where("lang = 'fr'"), 0)])


@query(f"""WITH {C} SELECT dataset, dataset || '-' || (row_number() OVER (PARTITION BY dataset ORDER BY doc_id) - 1) AS doc_id,
  title, md5(body) AS body_hash, is_fake FROM c""")
def standardize_docs(spark, d):
    x = docs(spark, d)
    out = corpus.standardize(x, F.col("dataset"), F.col("title"), F.col("body"), F.col("is_fake"), F.col("doc_id"))
    return out.select("dataset", "doc_id", "title", F.md5("text").alias("body_hash"), F.col("is_fake").cast("int").alias("is_fake"))


@query("SELECT event_type, CASE WHEN lower(trim(event_type)) IN ('click', 'view') THEN 1 ELSE 0 END AS is_fake, count(*) AS n FROM events GROUP BY 1, 2")
def label_mapping(spark, d):
    return read(spark, d, "events").select("event_type", corpus.label_from(F.col("event_type"), ("click", "view")).alias("is_fake")).groupBy("event_type", "is_fake").agg(F.count("*").alias("n"))


@query(r"SELECT doc_id, trim(regexp_extract(text, '^\s*([^\n]*)', 1)) AS title, md5(regexp_replace(text, '^\s*[^\n]*\n?', '')) AS body_hash FROM documents")
def headline_body_split(spark, d):
    return read(spark, d, "documents").withColumns(readers.headline("text")).select("doc_id", "title", F.md5("body").alias("body_hash"))


@query(f"""WITH {C}, m AS (SELECT doc_id FROM c WHERE dataset = 'B' AND is_fake = 1) SELECT doc_id, length(text) AS chars FROM documents JOIN m USING (doc_id)""")
def two_phase_fetch(spark, d):
    chosen = docs(spark, d).where("dataset = 'B' and is_fake = 1").select("doc_id")
    return read(spark, d, "documents").join(chosen, "doc_id", "left_semi").select("doc_id", F.length("text").alias("chars"))


@query("SELECT lower(trim(event_type)) AS key, min(value) AS value FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1")
def load_labels_clean(spark, d):
    return corpus.clean_labels(read(spark, d, "events"), "event_type", "value")


@query(f"WITH {C} SELECT doc_id, dataset FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def exclude_flagged(spark, d):
    ids = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return docs(spark, d).join(ids, "doc_id", "left_anti").select("doc_id", "dataset")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def merge_shards_keep_last(spark, d):
    x = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_quantity").alias("o"), "l_suppkey", "l_quantity")
    return grid.keep_last(x, ("l_orderkey", "l_linenumber"), "o").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")


# Text ----------------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, {norm('text')} AS norm FROM documents")
def norm_light(spark, d):
    return read(spark, d, "documents").select("doc_id", T.norm_light("text").alias("norm"))


@query(f"SELECT doc_id, {norm(strip('text'))} AS norm FROM documents")
def norm_strip(spark, d):
    return read(spark, d, "documents").select("doc_id", T.norm_strip("text").alias("norm"))


@query(f"SELECT doc_id, len({ws(norm('text'))}) AS norm_words, {raw_words('text')} AS raw_words FROM documents")
def word_counts(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.words(T.norm_light("text"))).alias("norm_words"), T.raw_word_count("text").alias("raw_words"))


@query(f"WITH {H} SELECT doc_id, h_text_light, h_text_strip, h_title_light, h_title_strip, h_both_light, h_both_strip, prefix FROM h")
def content_hashes(spark, d):
    return hashed(spark, d).select("doc_id", *corpus.HASHES, "prefix")


@query(f"WITH {N}, s AS ({shingle_sql('n', 'doc_id', 'ns', 5)}) SELECT n.doc_id, count(sh) AS shingles FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id")
def shingle_counts(spark, d):
    return normed(spark, d).select("doc_id", F.size(T.shingles(T.words("ns"), 5)).cast("long").alias("shingles"))


@query(r"""WITH a AS (SELECT doc_id, text, length(regexp_extract(text, '(?is)^(.*?)\bthe\b', 1)) AS b, regexp_matches(text, '(?i)\bthe\b') AS m FROM documents),
s AS (SELECT doc_id, b + 1 AS pos, text FROM a WHERE m)
SELECT doc_id, replace(substr(text, greatest(pos - 70, 1)::INT, (least(pos - 1, 70) + 3 + 70)::INT), chr(10), '⏎') AS line FROM s ORDER BY doc_id LIMIT 100""")
def kwic(spark, d):
    return read(spark, d, "documents").select("doc_id", T.kwic("text", "the").alias("line")).where("line is not null").orderBy("doc_id").limit(100)


@query(f"SELECT doc_id, replace(substr(text, 1, 200), chr(10), ' ') AS preview FROM documents")
def text_preview(spark, d):
    return read(spark, d, "documents").select("doc_id", T.preview("text", 200).alias("preview"))


@query(r"SELECT conv_id, turn, array_to_string(list_filter(string_split(trim(regexp_replace('@ ' || text || ' @@ x@y', '\s+', ' ', 'g')), ' '), lambda w: NOT regexp_full_match(w, '@+')), ' ') AS clean FROM conversations")
def at_token_scrub(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.scrub_at(F.concat(F.lit("@ "), F.col("text"), F.lit(" @@ x@y"))).alias("clean"))


@query(f"WITH {C} SELECT doc_id, md5(title || chr(10) || body) AS joined FROM c")
def title_body_roundtrip(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.title_and_body("title", "body")).alias("joined"))


@query("SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN source ELSE 'sha256:' || sha256(source) END AS source FROM documents")
def redact_ids(spark, d):
    return read(spark, d, "documents").select("doc_id", T.redact_id("source", "^src[0-9]$").alias("source"))


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in (k, *x)) + ")" for k, x in grid.CONDITIONS.items()) + ") t(cond, s, l, e, t, rand_of)")
def condition_catalog(spark, d):
    return grid.conditions(spark)


# Filters -------------------------------------------------------------------------------------------------------------
@query(f"WITH {H} SELECT doc_id, dataset, n_words FROM h WHERE n_words >= 20")
def filter_short(spark, d):
    return hashed(spark, d).where(F.col("n_words") >= corpus.MIN_WORDS).select("doc_id", "dataset", "n_words")


@query(f"""WITH {C}, x AS (SELECT doc_id, dataset, text, is_fake, source, {raw_words('text')} - CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS n_words FROM c),
i AS (SELECT doc_id, count(*) AS n, min(is_fake) <> max(is_fake) AS b FROM x GROUP BY doc_id), s AS (SELECT lower(lang) AS k, count(DISTINCT dataset) AS n FROM c GROUP BY 1)
SELECT 'rows' AS "check", count(*) AS n FROM x UNION ALL SELECT 'missing_text', count(*) FILTER (text IS NULL OR lower(trim(text)) IN ('', 'nan', 'none', 'null', 'na', 'n/a')) FROM x
UNION ALL SELECT 'missing_label', count(*) FILTER (is_fake IS NULL) FROM x UNION ALL SELECT 'invalid_label', count(*) FILTER (is_fake NOT IN (0, 1)) FROM x
UNION ALL SELECT 'n_words_mismatch', count(*) FILTER (n_words <> {raw_words('text')}) FROM x UNION ALL SELECT 'repeated_ids', count(*) FILTER (n > 1) FROM i
UNION ALL SELECT 'conflicting_ids', count(*) FILTER (b) FROM i UNION ALL SELECT 'shared_clusters', count(*) FILTER (n > 1) FROM s""")
def quality_audit(spark, d):
    x = docs(spark, d).withColumn("n_words", T.raw_word_count("text") - (F.col("doc_id") % 10 == 0).cast("int")).withColumn("cluster", F.lower("lang"))
    return audit.quality(x, "doc_id", "text", "is_fake", "cluster", "dataset", "n_words")


def _re2(p: str, f: str) -> str:
    """A source pattern for SQL engines without look-around: whether a text matches, not where, is the same."""
    p = p.replace("(?=sources?", "(?:sources?").replace(r"(?<!\w)[@#]", r"(?:^|[^\p{L}\p{N}_])[@#]").replace("'", "''")
    return (f"(?{f})" if f else "") + p


@query(f"WITH {C} " + " UNION ALL ".join(f"SELECT dataset, is_fake, '{n}' AS pattern, round(100.0 * avg(CASE WHEN regexp_matches(text, '{_re2(p, f)}') THEN 1.0 ELSE 0.0 END), 1) AS share FROM c GROUP BY 1, 2" for n, p, f in masks.SOURCE))
def pattern_coverage(spark, d):
    return masks.coverage(docs(spark, d), ("dataset", "is_fake"), "text")


# Families of words that deserve a look.
FLAGS = {
    "fact_check": r"\b(?:gossip\s*cop|fact[- ]check\w*|debunk\w*|not true|untrue|false (?:claim|report|rumor|rumour)\w*|no truth|fabricat\w*)\b",
    "publisher": r"\b(?:gossip\s*cop|radar\s*online|radaronline|hollywood\s*life|hollywoodlife|national enquirer|rolling stone|people magazine|entertainment weekly|tmz|vogue|e! news|us weekly)\b",
    "boilerplate": r"\b(?:subscribe|read more|share this|all rights reserved|click here|follow us|advertisement)\b",
    "historical_1974": r"\b1974\b",
    "license": r"\b(?:license|licence|copyright|rights reserved)\b",
}


@query(" UNION ALL ".join(f"SELECT doc_id, '{n}' AS family, len(m) AS hits, array_to_string(list_sort(list_distinct(m)), '|') AS terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '{p}') AS m FROM documents) WHERE len(m) > 0" for n, p in FLAGS.items()))
def language_flags(spark, d):
    x = read(spark, d, "documents")
    rows = [F.struct(F.lit(n).alias("family"), F.regexp_extract_all(F.lower("text"), F.lit(p), F.lit(0)).alias("m")) for n, p in FLAGS.items()]
    x = x.select("doc_id", F.explode(F.array(*rows)).alias("x")).where(F.size("x.m") > 0)
    return x.select("doc_id", "x.family", F.size("x.m").alias("hits"), F.array_join(F.array_sort(F.array_distinct("x.m")), "|").alias("terms"))


@query(f"SELECT doc_id, {raw_words('text')} AS n FROM documents WHERE {raw_words('text')} > 3000")
def long_articles(spark, d):
    return read(spark, d, "documents").select("doc_id", T.raw_word_count("text").alias("n")).where("n > 3000")


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN (SELECT min(ts) + INTERVAL 5 DAY FROM events) AND (SELECT min(ts) + INTERVAL 12 DAY FROM events)")
def date_range_filter(spark, d):
    x = read(spark, d, "events")
    lo = x.agg(F.min("ts").alias("lo"))
    return x.crossJoin(F.broadcast(lo)).where("ts between lo + interval 5 days and lo + interval 12 days").select("event_id", "user_id")  # one row


# Near-duplicates -----------------------------------------------------------------------------------------------------
@query(f"WITH {N}, {near_sql('p', 'n', 5, 0.8)} SELECT i, j, round(jaccard, 9) AS jaccard, round(containment, 9) AS containment FROM p")
def near_dup_pairs(spark, d):
    return overlap.near_pairs(normed(spark, d), "doc_id", "ns").select("i", "j", *r9("jaccard", "containment"))


@query(f"WITH {N}, {near_sql('p', 'n', 3, 0.5)}, {near_sql('q', 'n', 5, 0.8)} SELECT i, j, round(jaccard, 9) AS jaccard FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.i = p.i AND q.j = p.j)")
def near_dup_sensitivity(spark, d):
    x = normed(spark, d)
    primary, wide = overlap.near_tiers(x, "doc_id", "ns", ((overlap.PRIMARY_K, overlap.PRIMARY), (overlap.SENSITIVE_K, overlap.SENSITIVE)))
    return wide.join(primary, ["i", "j"], "left_anti").select("i", "j", *r9("jaccard"))


@query(f"WITH {N}, {near_sql('p', 'n', 3, 0.5)}, {near_sql('q', 'n', 5, 0.8)} SELECT i, j, round(jaccard, 9) AS jaccard, 'sensitivity' AS tier FROM p WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.i = p.i AND q.j = p.j) UNION ALL SELECT i, j, round(jaccard, 9), 'primary' FROM q WHERE jaccard >= 0.75 AND jaccard < 0.8")
def borderline_pairs(spark, d):
    return overlap.borderline(normed(spark, d), "doc_id", "ns").select("i", "j", *r9("jaccard"), "tier")


@query(f"WITH {N}, {near_sql('p', 'n', 5, 0.8, 0, ('full',))} SELECT i, j, round(jaccard, 9) AS jaccard, round(containment, 9) AS containment FROM p")
def near_dup_screen(spark, d):
    return overlap.near_pairs(normed(spark, d), "doc_id", "ns", least_set=0, views=("full",)).select("i", "j", *r9("jaccard", "containment"))


# Documents of at least 20 words, without groups of copies of both labels, one of each other group; and links within a dataset.
CLEAN = f"""{H}, g0 AS (SELECT *, min(is_fake) OVER w AS lo, max(is_fake) OVER w AS hi, row_number() OVER (PARTITION BY dataset, h_text_light ORDER BY doc_id) AS r FROM h WHERE n_words >= 20 WINDOW w AS (PARTITION BY dataset, h_text_light)),
n AS (SELECT doc_id, dataset, is_fake, text_ns AS ns FROM g0 WHERE lo = hi AND r = 1), {near_sql('p0', 'n', 5, 0.8)},
p AS (SELECT p0.* FROM p0 JOIN n a ON a.doc_id = i JOIN n b ON b.doc_id = j WHERE a.dataset = b.dataset)"""


def clustered(spark: SparkSession, d: str) -> DataFrame:
    x = corpus.exact_dedup(hashed(spark, d).where("n_words >= 20"), "h_text_light", "is_fake", "doc_id").select("doc_id", "dataset", "is_fake", T.norm_strip("body").alias("ns"))
    return overlap.clusters_within(x, "doc_id", "ns", "dataset")


@query(f"WITH RECURSIVE {CLEAN}, {reach_sql('k', 'n', 'p')} SELECT node AS doc_id, dataset, dataset || '-c' || cluster AS cluster_id FROM k JOIN n ON n.doc_id = node")
def near_dup_clusters(spark, d):
    return clustered(spark, d).select("doc_id", "dataset", F.concat(F.col("dataset"), F.lit("-c"), F.col("cluster").cast("string")).alias("cluster_id"))


@query(f"""WITH RECURSIVE {CLEAN}, {reach_sql('k', 'n', 'p')}, g AS (SELECT dataset, cluster, count(*) AS n, min(is_fake) <> max(is_fake) AS c FROM k JOIN n ON n.doc_id = node GROUP BY 1, 2)
SELECT dataset, count(*) FILTER (n > 1) AS clusters, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS docs, max(n) AS largest, count(*) FILTER (c) AS label_conflicts FROM g GROUP BY dataset""")
def cluster_stats(spark, d):
    return audit.cluster_stats(clustered(spark, d), "cluster", "is_fake")


@query(f"""WITH RECURSIVE {N}, {near_sql('p', 'n', 5, 0.8)}, {reach_sql('k', 'n', 'p')}, w AS (SELECT doc_id, 'toxic' AS reason FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'short' FROM n WHERE n_words < 20),
f AS (SELECT cluster, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM w JOIN k ON node = doc_id GROUP BY cluster) SELECT node AS doc_id, reasons FROM k JOIN f USING (cluster)""")
def component_exclusions(spark, d):
    x = normed(spark, d)
    why = read(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit("toxic").alias("reason")).unionByName(x.where("n_words < 20").select("doc_id", F.lit("short").alias("reason")))
    return overlap.closure(x, "doc_id", overlap.near_pairs(x, "doc_id", "ns"), why)


@query()
def near_dup_lsh(spark, d):
    return overlap.lsh_pairs(normed(spark, d), "doc_id", "ns").select("i", "j", *r9("jaccard", "containment"))


@query()
def minhash_signature(spark, d):
    return overlap.minhash(normed(spark, d), "doc_id", "ns")


@query(f"""WITH {N}, b AS (SELECT item_id, {norm(strip('text'))} AS ns FROM benchmark), x AS ({shingle_sql('n', 'doc_id', 'ns', 5)}), y AS ({shingle_sql('b', 'item_id', 'ns', 5)}),
xn AS (SELECT doc_id, count(*) AS n FROM x GROUP BY 1), yn AS (SELECT item_id, count(*) AS n FROM y GROUP BY 1), p AS (SELECT item_id, doc_id, count(*) AS b FROM x JOIN y USING (sh) GROUP BY 1, 2)
SELECT item_id, doc_id, round(b / (xn.n + yn.n - b), 9) AS jaccard, round(b / least(xn.n, yn.n), 9) AS containment FROM p JOIN xn USING (doc_id) JOIN yn USING (item_id) WHERE b / (xn.n + yn.n - b) >= 0.8 OR b / least(xn.n, yn.n) >= 0.9""")
def target_contamination(spark, d):
    items = read(spark, d, "benchmark").withColumn("ns", T.norm_strip("text"))
    return overlap.contamination(normed(spark, d), "doc_id", "ns", items, "item_id", "ns", least_set=0).select("item_id", "doc_id", *r9("jaccard", "containment"))


def evidence_sql() -> str:
    """Shingle tables of both sides for each field, tier and view, and the rows that each yields; then equal texts and beginnings."""
    tables, rows = [], []
    for field, src in (("body", "eb"), ("title_body", "et")):
        for tier, k, thr in (("primary", 5, 0.8), ("sensitivity", 3, 0.5)):
            for view in ("full", "head100"):
                x = f"{src}_{tier}_{view}"
                tables += [f"{x}x AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM ({shingle_sql(src, 'doc_id', 'ns', k, view != 'full')}))", f"{x}y AS (SELECT *, count(*) OVER (PARTITION BY item_id) AS n FROM ({shingle_sql('ei', 'item_id', 'ns', k, view != 'full')}))"]
                tables += [f"{x} AS (SELECT item_id, doc_id, count(*) AS b, x.n AS n, y.n AS m FROM {x}x x JOIN {x}y y USING (sh) GROUP BY ALL)"]
                rows += [f"SELECT item_id, doc_id, '{field}' AS field, '{tier}_{view}' AS method, round(b / (n + m - b), 9) AS jaccard, round(b / least(n, m), 9) AS containment FROM {x} WHERE b / (n + m - b) >= {thr} OR b / least(n, m) >= 0.9"]
        for method, a in (("exact_light", "nl"), ("exact_strip", "ns")):
            rows += [f"SELECT item_id, doc_id, '{field}', '{method}', 1.0::DOUBLE, 1.0::DOUBLE FROM {src} x JOIN ei y ON x.{a} = y.{a} WHERE x.{a} <> ''"]
        rows += [f"SELECT item_id, doc_id, '{field}', 'prefix300', 1.0::DOUBLE, 1.0::DOUBLE FROM {src} x JOIN ei y ON substr(x.ns, 1, 300) = substr(y.ns, 1, 300) WHERE length(x.ns) >= 300 AND length(y.ns) >= 300"]
    views = [f"{n} AS (SELECT {k}, {norm(c)} AS nl, {norm(strip(c))} AS ns FROM {src})" for n, k, c, src in (("eb", "doc_id", "body", "c"), ("et", "doc_id", "text", "c"), ("ei", "item_id", "text", "benchmark"))]
    return f"WITH {C}, {', '.join(views + tables)} {' UNION ALL '.join(rows)}"


@query(evidence_sql())
def contamination_evidence(spark, d):
    x = overlap.evidence(docs(spark, d), "doc_id", read(spark, d, "benchmark"), "item_id", {"body": ("body", "text"), "title_body": ("text", "text")}, least_set=0)
    return x.select("item_id", "doc_id", "field", "method", *r9("jaccard", "containment"))


# Exact overlap -------------------------------------------------------------------------------------------------------
_TALL = "t AS (" + " UNION ALL ".join(f"SELECT doc_id, dataset, is_fake, '{h}' AS evidence, {h} AS h FROM h" for h in corpus.HASHES) + ")"
_PAIRS = "x AS (SELECT a.dataset || '~' || b.dataset AS pair, a.evidence, a.doc_id AS i, b.doc_id AS j, a.is_fake <> b.is_fake AS c FROM t a JOIN t b ON a.evidence = b.evidence AND a.h = b.h AND a.dataset < b.dataset)"


@query(f"WITH {H}, {_TALL}, {_PAIRS} SELECT pair, evidence, count(*) AS pairs, count(DISTINCT i) AS docs_a, count(DISTINCT j) AS docs_b, count(*) FILTER (c) AS conflicts FROM x GROUP BY 1, 2")
def exact_overlap(spark, d):
    return overlap.exact_overlap(hashed(spark, d), corpus.HASHES)


@query(f"WITH {H}, {_TALL}, {_PAIRS} SELECT pair, evidence, count(*) FILTER (c) AS conflicts FROM x GROUP BY 1, 2 HAVING count(*) FILTER (c) > 0")
def label_conflicts(spark, d):
    return overlap.exact_overlap(hashed(spark, d), corpus.HASHES).where("conflicts > 0").select("pair", "evidence", "conflicts")


@query(f"""WITH {H}, {_TALL}, {_PAIRS}, g AS (SELECT pair, evidence, count(*) AS pairs FROM x GROUP BY 1, 2), e AS (SELECT DISTINCT evidence FROM t)
SELECT evidence, coalesce(max(pairs) FILTER (pair = 'A~B'), 0) AS "A~B", coalesce(max(pairs) FILTER (pair = 'A~C'), 0) AS "A~C", coalesce(max(pairs) FILTER (pair = 'B~C'), 0) AS "B~C" FROM e LEFT JOIN g USING (evidence) GROUP BY evidence""")
def overlap_report(spark, d):
    x = overlap.exact_overlap(hashed(spark, d), corpus.HASHES)
    names = spark.createDataFrame([(h,) for h in corpus.HASHES], "evidence string")
    return names.join(x.groupBy("evidence").pivot("pair", ["A~B", "A~C", "B~C"]).sum("pairs"), "evidence", "left").na.fill(0)


@query(f"WITH {H} SELECT doc_id FROM h WHERE dataset = 'C' AND prefix IN (SELECT prefix FROM h WHERE dataset <> 'C' AND prefix IS NOT NULL)")
def prefix_overlap(spark, d):
    return overlap.flags(hashed(spark, d), {"prefix": "prefix"}, "C").select("doc_id")


_FLAGGED = "f AS (" + " UNION ALL ".join(f"SELECT doc_id, '{n}' AS evidence FROM h WHERE dataset = 'C' AND {c} IN (SELECT {c} FROM h WHERE dataset <> 'C' AND {c} IS NOT NULL)" for c, n in (("h_text_strip", "exact"), ("prefix", "prefix300"))) + ")"


@query(f"WITH {H}, {_FLAGGED} SELECT doc_id, evidence FROM f")
def exact_prefix_flags(spark, d):
    return overlap.flags(hashed(spark, d), {"h_text_strip": "exact", "prefix": "prefix300"}, "C")


@query(f"""WITH {H}, {_FLAGGED} SELECT dataset, is_fake, count(*) AS n, count(*) FILTER (doc_id IN (SELECT doc_id FROM f)) AS removed, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM f)) AS remaining FROM h GROUP BY 1, 2""")
def trim_dry_run(spark, d):
    x = hashed(spark, d)
    f = overlap.flags(x, {"h_text_strip": "exact", "prefix": "prefix300"}, "C").select("doc_id").distinct().withColumn("hit", F.lit(1))
    return x.join(f, "doc_id", "left").groupBy("dataset", "is_fake").agg(F.count("*").alias("n"), F.count("hit").alias("removed"), F.count_if(F.col("hit").isNull()).alias("remaining"))


@query(f"WITH {H}, {_FLAGGED}, s AS (SELECT doc_id, 'degenerate' AS evidence FROM h WHERE len({ws('text_ns')}) < 20), u AS (SELECT * FROM f UNION ALL SELECT * FROM s) SELECT doc_id, arg_min(evidence, CASE evidence WHEN 'degenerate' THEN 0 WHEN 'exact' THEN 1 ELSE 2 END) AS reason FROM u GROUP BY doc_id")
def flag_reasons(spark, d):
    x = hashed(spark, d)
    u = overlap.flags(x, {"h_text_strip": "exact", "prefix": "prefix300"}, "C").unionByName(x.where(F.size(T.words("text_ns")) < 20).select("doc_id", F.lit("degenerate").alias("evidence")))
    return overlap.first_reason(u, "doc_id", "evidence", {"degenerate": 0, "exact": 1, "prefix300": 2})


_ORDER = " ".join(f"WHEN '{r}' THEN {n}" for n, r in enumerate(overlap.REASONS))


@query(f"""WITH {N}, {near_sql('p', 'n', 5, 0.8)}, {near_sql('q', 'n', 3, 0.5)}, z AS (SELECT dataset, count(*) AS size FROM n GROUP BY 1), m AS (SELECT doc_id, dataset, size, ns FROM n JOIN z USING (dataset)),
e AS (SELECT a.doc_id AS i, b.doc_id AS j, 'exact' AS reason FROM m a JOIN m b ON a.ns = b.ns AND a.doc_id < b.doc_id WHERE a.ns <> ''
  UNION ALL SELECT a.doc_id, b.doc_id, 'prefix300' FROM m a JOIN m b ON substr(a.ns, 1, 300) = substr(b.ns, 1, 300) AND a.doc_id < b.doc_id WHERE length(a.ns) >= 300 AND length(b.ns) >= 300
  UNION ALL SELECT i, j, 'near_primary' FROM p UNION ALL SELECT i, j, 'near_sens' FROM q),
f AS (SELECT CASE WHEN a.size >= b.size THEN i ELSE j END AS doc_id, reason FROM e JOIN m a ON a.doc_id = i JOIN m b ON b.doc_id = j WHERE a.dataset <> b.dataset UNION ALL SELECT doc_id, 'degenerate' FROM n WHERE n_words < 20)
SELECT doc_id, arg_min(reason, CASE reason {_ORDER} END) AS reason FROM f GROUP BY doc_id""")
def drop_flagged(spark, d):
    return overlap.drop_flagged(normed(spark, d), "doc_id", "ns", "dataset")


@query(f"""WITH {H}, g AS (SELECT *, min(is_fake) OVER w AS lo, max(is_fake) OVER w AS hi, row_number() OVER (PARTITION BY dataset, h_text_light ORDER BY doc_id) AS r FROM h WHERE n_words >= 20 WINDOW w AS (PARTITION BY dataset, h_text_light))
SELECT doc_id, dataset FROM g WHERE lo = hi AND r = 1""")
def exact_dedup(spark, d):
    return corpus.exact_dedup(hashed(spark, d).where("n_words >= 20"), "h_text_light", "is_fake", "doc_id").select("doc_id", "dataset")


_REPORT = ", ".join(f"coalesce((SELECT sum(n - 1) FROM g_{a} WHERE g_{a}.dataset = h.dataset), 0)::BIGINT AS {a}_surplus, (SELECT count(*) FILTER (n > 1) FROM g_{a} WHERE g_{a}.dataset = h.dataset) AS {a}_groups, (SELECT count(*) FILTER (c) FROM g_{a} WHERE g_{a}.dataset = h.dataset) AS {a}_conflicts" for a in ("light", "strip", "title"))
_GROUPS = ", ".join(f"g_{a} AS (SELECT dataset, {c}, count(*) AS n, min(is_fake) <> max(is_fake) AS c FROM h WHERE n_words >= 20 AND {c} IS NOT NULL GROUP BY 1, 2)" for a, c in (("light", "h_text_light"), ("strip", "h_text_strip"), ("title", "h_title_light")))


@query(f"WITH {H}, {_GROUPS}, b AS (SELECT dataset, count(*) AS raw, count(*) FILTER (n_words < 20) AS short, count(*) FILTER (n_words >= 20) AS kept_length FROM h GROUP BY dataset) SELECT h.*, {_REPORT} FROM b h")
def within_report(spark, d):
    return audit.within_report(hashed(spark, d))


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), m AS (SELECT DISTINCT doc_id, md5({norm('line')}) AS line_hash FROM l WHERE len({ws(norm('line'))}) >= 8)
SELECT line_hash, count(*) AS docs FROM m GROUP BY 1 HAVING count(*) > 1""")
def repeated_lines(spark, d):
    return corpus.repeated_lines(read(spark, d, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_byte_groups(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


@query(f"WITH {C}, e AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT dataset, count(*) FILTER (c.doc_id IS NOT NULL) AS found, count(*) FILTER (c.doc_id IS NULL) AS missing FROM (SELECT doc_id FROM e UNION ALL SELECT doc_id + 100000000 FROM e) x LEFT JOIN c USING (doc_id) GROUP BY dataset")
def contamination_report(spark, d):
    ids = read(spark, d, "labels").where("toxic = 1").select("doc_id")
    ids = ids.unionByName(ids.select((F.col("doc_id") + 100000000).alias("doc_id")))
    x = ids.join(docs(spark, d).select("doc_id", "dataset"), "doc_id", "left")
    return x.groupBy("dataset").agg(F.count("dataset").alias("found"), F.count_if(F.col("dataset").isNull()).alias("missing"))


@query(f"WITH {C}, r AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN title || '!' ELSE title END AS title, is_fake FROM c WHERE doc_id % 11 <> 0), j AS (SELECT c.doc_id AS l, r.doc_id AS r, c.title <> r.title AS t, c.is_fake <> r.is_fake AS f FROM (SELECT * FROM c WHERE doc_id % 13 <> 0) c FULL JOIN r ON c.doc_id = r.doc_id) SELECT 'left_only' AS side, count(*) FILTER (r IS NULL) AS n FROM j UNION ALL SELECT 'right_only', count(*) FILTER (l IS NULL) FROM j UNION ALL SELECT 'common', count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) FROM j UNION ALL SELECT 'differs_title', count(*) FILTER (t) FROM j UNION ALL SELECT 'differs_is_fake', count(*) FILTER (f) FROM j")
def table_diff(spark, d):
    x = docs(spark, d)
    right = x.where("doc_id % 11 <> 0").withColumn("title", F.when(F.col("doc_id") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")))
    return audit.table_diff(x.where("doc_id % 13 <> 0"), right, "doc_id", ("title", "is_fake"))


@query("SELECT a.n || '~' || b.n AS pair FROM (VALUES ('A'), ('B'), ('C')) a(n), (VALUES ('A'), ('B'), ('C')) b(n) WHERE a.n < b.n")
def dataset_pairs(spark, d):
    a = docs(spark, d).select(F.col("dataset").alias("a")).distinct()
    return a.join(F.broadcast(a.withColumnRenamed("a", "b")), F.col("a") < F.col("b")).select(F.concat_ws("~", "a", "b").alias("pair"))  # names of corpora


# Masks ---------------------------------------------------------------------------------------------------------------
def masked(spark, d, letters):
    x = masks.mask(read(spark, d, "documents"), "text", letters)
    return x.select("doc_id", F.size("spans").alias("n_spans"), F.md5("masked").alias("masked"))


@query()
def mask_source(spark, d):
    return masked(spark, d, "S")


@query()
def mask_temporal(spark, d):
    return masked(spark, d, "T")


@query()
def mask_entities_fallback(spark, d):
    return masked(spark, d, "E")


@query()
def mask_condition(spark, d):
    return masked(spark, d, "SET")


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[0-9]+') THEN trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '\s+', ' ', 'g')) ELSE text END AS masked, len(regexp_extract_all(text, '[0-9]+')) AS n_spans FROM documents")
def remove_spans(spark, d):
    x = read(spark, d, "documents").withColumn("spans", masks.regex_spans(F.col("text"), "[0-9]+"))
    return x.select("doc_id", masks.cut(F.col("text"), F.col("spans")).alias("masked"), F.size("spans").alias("n_spans"))


_DROP = r"""WITH w AS (SELECT doc_id, text, list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' '), lambda x: x <> '') AS w, (doc_id % 4 * 5)::INT AS m FROM documents),
p AS (SELECT doc_id, w[i] AS v, i - 1 AS i, row_number() OVER (PARTITION BY doc_id ORDER BY md5('7|' || doc_id || '|' || (i - 1))) AS r FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
k AS (SELECT p.doc_id, string_agg(v, ' ' ORDER BY i) AS t FROM p JOIN w USING (doc_id) WHERE r > greatest(0, least(m, len(w) - {one})) GROUP BY p.doc_id)
SELECT doc_id, m, md5(CASE WHEN m <= 0 THEN text ELSE coalesce(t, '') END) AS dropped FROM w LEFT JOIN k USING (doc_id)"""


def dropped(spark, d, keep_one):
    x = read(spark, d, "documents").withColumn("m", (F.col("doc_id") % 4 * 5).cast("int"))
    return masks.drop_words(x, "doc_id", "text", "m", 7, keep_one).select("doc_id", "m", F.md5("dropped").alias("dropped"))


@query(_DROP.format(one=1))
def random_drop_legacy(spark, d):
    return dropped(spark, d, True)


@query(_DROP.format(one=0))
def random_drop_paired(spark, d):
    return dropped(spark, d, False)


@query(rf"""WITH x AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '[0-9]+') THEN trim(regexp_replace(regexp_replace(text, '[0-9]+', '', 'g'), '\s+', ' ', 'g')) ELSE text END AS m FROM documents)
SELECT doc_id, {raw_words('text')} - {raw_words('m')} AS removed FROM x""")
def deletion_counts(spark, d):
    x = read(spark, d, "documents").withColumn("m", masks.cut(F.col("text"), masks.regex_spans(F.col("text"), "[0-9]+")))
    return x.select("doc_id", (T.raw_word_count("text") - T.raw_word_count("m")).alias("removed"))


# Aggregates ----------------------------------------------------------------------------------------------------------
@query(f"WITH {C} SELECT dataset, is_fake, count(*) AS n FROM c GROUP BY 1, 2")
def class_counts(spark, d):
    return docs(spark, d).groupBy("dataset", "is_fake").agg(F.count("*").alias("n"))


@query(f"WITH {H} SELECT dataset, is_fake, count(*) AS n, round(avg(n_words), 9) AS mean_words, quantile_cont(n_words, 0.5) AS median_words, quantile_cont(n_words, 0.05) AS p5_words, quantile_cont(n_words, 0.95) AS p95_words, round(avg((title <> '')::INT), 9) AS title_present, round(count(*) / any_value(a.k), 9) AS share FROM h JOIN (SELECT dataset, count(*) AS k FROM h GROUP BY 1) a USING (dataset) GROUP BY 1, 2")
def corpus_stats(spark, d):
    x = corpus.length_stats(hashed(spark, d), ("dataset", "is_fake"), "n_words", "title")
    return x.select("dataset", "is_fake", "n", *r9("mean_words"), "median_words", "p5_words", "p95_words", *r9("title_present", "share"))


@query(f"WITH {N} SELECT dataset, count(*) AS n, round(avg(n_words), 9) AS mean, round(stddev_samp(n_words), 6) AS sd, min(n_words) AS min, quantile_cont(n_words, 0.25) AS q25, quantile_cont(n_words, 0.5) AS q50, quantile_cont(n_words, 0.75) AS q75, max(n_words) AS max FROM n GROUP BY 1")
def length_describe(spark, d):
    return corpus.describe(normed(spark, d), ("dataset",), "n_words").withColumns({"mean": F.round("mean", 9), "sd": F.round("sd", 6)})


@query(" UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS type, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS distinct_values, {'quantile_cont(length(' + c + '), 0.5)' if t == 'string' else 'NULL::DOUBLE'} AS median_length FROM documents" for c, t in (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))))
def profile_table(spark, d):
    return corpus.profile(read(spark, d, "documents"))


@query(f"WITH {C}, g AS (SELECT dataset, count(*) FILTER (is_fake = 0) AS n0, count(*) FILTER (is_fake = 1) AS n1 FROM c GROUP BY 1) SELECT dataset, n0, n1, round(least(n0, n1) / (n0 + n1), 9) AS min_share, least(n0, n1) >= 100 AND least(n0, n1) / (n0 + n1) >= 0.4 AS passes FROM g")
def class_gate(spark, d):
    return audit.class_gate(docs(spark, d), ("dataset",), "is_fake", 100, 0.4).withColumn("min_share", F.round("min_share", 9))


@query("WITH a AS (SELECT lang AS key, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT lang AS key, count(*) FILTER (doc_id % 50 <> 0 OR lang <> 'en') AS n FROM documents WHERE lang <> 'fr' GROUP BY 1) SELECT key, a.n AS actual, r.n AS recorded, CASE WHEN r.n IS NULL THEN 'not_recorded' WHEN a.n IS NULL THEN 'not_found' WHEN a.n = r.n THEN 'match' ELSE 'mismatch' END AS state FROM a FULL JOIN r USING (key)")
def claims_check(spark, d):
    x = read(spark, d, "documents").withColumnRenamed("lang", "key")
    rec = x.where("key <> 'fr'").groupBy("key").agg(F.count_if((F.col("doc_id") % 50 != 0) | (F.col("key") != "en")).alias("n"))
    return audit.claims(x.groupBy("key").agg(F.count("*").alias("n")), rec, "key", "n")
