"""The library's own queries, continued: sampling, grid statistics, metrics, sets, checks and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import grid, metrics, sampling, tfidf
from palimpsest.plans.scratch import Scratch
from palimpsest.plans.catalog import C, N, docs, norm, normed, query, r9, raw_words, read, strip, ws


_CELLS = """(SELECT l_linenumber AS seed, {cond} AS cond, s_nationkey % 3 AS train, c_nationkey % 3 AS test, CASE WHEN s_nationkey % 3 = c_nationkey % 3 THEN 'in' ELSE 'cross' END AS kind,
  sum(CAST(round(l_discount * 100) AS BIGINT)) / (count(*) * 10.0::DOUBLE) AS auc, count(*) AS n_test
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""
C3 = "cells AS " + _CELLS.format(cond="l_returnflag")
C8 = "cells AS " + _CELLS.format(cond="['C0', 'S', 'L', 'E', 'SL', 'SE', 'LE', 'SLE'][l_orderkey % 8 + 1]")
G8 = f"""{C8}, x AS (SELECT a.*, b.auc AS in_metric, b.auc - a.auc AS gap FROM cells a LEFT JOIN cells b ON b.kind = 'in' AND a.seed = b.seed AND a.cond = b.cond AND a.train = b.train WHERE a.kind = 'cross')"""


def _cells(spark, d, cond):
    li = read(spark, d, "lineitem").select("l_linenumber", "l_orderkey", "l_suppkey", "l_returnflag", "l_discount")
    x = li.join(read(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    x = x.join(read(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    train, test = F.col("s_nationkey") % 3, F.col("c_nationkey") % 3
    g = x.groupBy(F.col("l_linenumber").alias("seed"), cond.alias("cond"), train.alias("train"), test.alias("test"))
    out = g.agg((F.sum(F.round(F.col("l_discount") * 100).cast("long")) / (F.count("*") * F.lit(10.0))).alias("auc"), F.count("*").alias("n_test"))
    return out.select("seed", "cond", "train", "test", F.when(F.col("train") == F.col("test"), "in").otherwise("cross").alias("kind"), "auc", "n_test")


def cells3(spark, d) -> DataFrame:
    return _cells(spark, d, F.col("l_returnflag"))


def cells8(spark, d) -> DataFrame:
    names = F.array(*(F.lit(c) for c in ("C0", "S", "L", "E", "SL", "SE", "LE", "SLE")))
    return _cells(spark, d, F.element_at(names, (F.col("l_orderkey") % 8 + 1).cast("int")))


def contrast_sql(a: str, b: str, metric: str = "auc", src: str = "x", where: str = "true") -> str:
    return f"(SELECT seed, avg(d) AS value FROM (SELECT seed, train, test, max({metric}) FILTER (cond = '{a}') - max({metric}) FILTER (cond = '{b}') AS d FROM {src} WHERE {where} GROUP BY ALL) WHERE d IS NOT NULL GROUP BY seed)"


CONTRASTS = (("S_vs_C0", "S", "C0"), ("L_vs_C0", "L", "C0"), ("E_vs_C0", "E", "C0"), ("SL_vs_L", "SL", "L"), ("LE_vs_L", "LE", "L"), ("SLE_vs_C0", "SLE", "C0"))
V8 = G8 + ", v AS (" + " UNION ALL ".join(f"SELECT '{n}' AS label, seed, round(value, 9) AS value FROM {contrast_sql(a, b)}" for n, a, b in CONTRASTS) + ")"


def contrasts(spark, d) -> DataFrame:
    x = grid.with_gap(cells8(spark, d))
    return reduce(DataFrame.unionByName, (grid.contrast(x, a, b, "auc").select(F.lit(n).alias("label"), "seed", *r9("value")) for n, a, b in CONTRASTS))


# Grid ----------------------------------------------------------------------------------------------------------------
@query(f"WITH {G8} SELECT seed, cond, train, test, round(in_metric, 9) AS in_metric, round(auc, 9) AS auc, round(gap, 9) AS gap FROM x")
def gap_join(spark, d):
    return grid.with_gap(cells8(spark, d)).select("seed", "cond", "train", "test", *r9("in_metric", "auc", "gap"))


@query(f"WITH {V8} SELECT * FROM v")
def paired_contrast(spark, d):
    return contrasts(spark, d)


@query(f"WITH {C8} SELECT seed, cond, round(avg(m), 9) AS value FROM (SELECT seed, cond, train, test, avg(auc) AS m FROM cells GROUP BY ALL) GROUP BY seed, cond")
def seed_pair_mean(spark, d):
    return grid.seed_means(cells8(spark, d), "auc", "cond").select("seed", "cond", *r9("value"))


_T = "[" + ", ".join(repr(grid.t_quantile(0.975, k)) for k in range(1, 20)) + "]"
_SUMMARY = f"SELECT label, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, {_T}[count(value) - 1] * stddev_samp(value) / sqrt(count(value)) AS half, min(value) AS min, max(value) AS max, CASE WHEN avg(value) > 0 THEN count(*) FILTER (value > 0) WHEN avg(value) < 0 THEN count(*) FILTER (value < 0) ELSE count(*) FILTER (value = 0) END AS same_sign FROM v GROUP BY label"


@query(f"WITH {V8} SELECT label, n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(mean - half, 8) AS lo, round(mean + half, 8) AS hi, min, max, same_sign FROM ({_SUMMARY})")
def summarise_ci(spark, d):
    return grid.summarise(contrasts(spark, d), ("label",)).select("label", "n", *(F.round(c, 8).alias(c) for c in ("mean", "sd", "lo", "hi")), "min", "max", "same_sign")


@query(f"WITH {V8} SELECT label, format('{{:+.3f}} [{{:.3f}}, {{:.3f}}] ({{}}/{{}})', round(mean, 8), round(mean - half, 8), round(mean + half, 8), same_sign, n) AS said FROM ({_SUMMARY})")
def format_summary(spark, d):
    x = grid.summarise(contrasts(spark, d), ("label",))
    return x.select("label", F.format_string("%+.3f [%.3f, %.3f] (%d/%d)", F.round("mean", 8), F.round("lo", 8), F.round("hi", 8), "same_sign", "n").alias("said"))


_CODE = {f: f"(CASE WHEN cond = 'C0' THEN -1 WHEN contains(cond, '{f}') THEN 1 ELSE -1 END)" for f in "SLE"}


@query(f"WITH {C8} SELECT seed, term, round(avg(e), 9) AS effect FROM (" + " UNION ALL ".join(f"SELECT seed, train, test, '{t}' AS term, 2 * avg(auc * {' * '.join(_CODE[f] for f in t)}) AS e FROM cells GROUP BY seed, train, test" for t in grid.TERMS) + ") GROUP BY seed, term")
def factorial_effects(spark, d):
    return grid.factorial(cells8(spark, d), "auc").select("seed", "term", *r9("effect"))


@query(f"WITH {G8}, m AS (SELECT seed, avg(gap) FILTER (cond = 'C0') AS base, avg(gap) FILTER (cond = 'SLE') AS sle FROM x GROUP BY seed) SELECT seed, round(1 - sle / base, 6) AS share FROM m")
def gap_share(spark, d):
    x = grid.with_gap(cells8(spark, d)).groupBy("seed").agg(F.avg(F.when(F.col("cond") == "C0", F.col("gap"))).alias("base"), F.avg(F.when(F.col("cond") == "SLE", F.col("gap"))).alias("full"))
    return grid.gap_share(x, "full", "base").select("seed", F.round("share", 6).alias("share"))


@query(f"WITH {G8} SELECT train || '->' || test AS pair, round(avg(gap) FILTER (cond = 'C0'), 9) AS c0, round(avg(gap) FILTER (cond = 'SLE'), 9) AS sle, round(avg(gap) FILTER (cond = 'SLE') - avg(gap) FILTER (cond = 'C0'), 9) AS change FROM x GROUP BY 1")
def pair_gap_change(spark, d):
    x = grid.with_gap(cells8(spark, d)).groupBy(grid.pair_name().alias("pair")).pivot("cond", ["C0", "SLE"]).agg(F.avg("gap"))
    return x.withColumn("change", F.col("SLE") - F.col("C0")).select("pair", F.round("C0", 9).alias("c0"), F.round("SLE", 9).alias("sle"), *r9("change"))


@query(f"WITH {C8}, o AS (SELECT * FROM cells WHERE seed % 2 = 0), p AS (SELECT * FROM cells WHERE seed % 2 = 1) SELECT o.cond, o.train, o.test, count(*) AS compared, count(*) FILTER (o.n_test <> p.n_test) AS unequal FROM o JOIN p ON o.seed + 1 = p.seed AND o.cond = p.cond AND o.train = p.train AND o.test = p.test GROUP BY 1, 2, 3")
def pairing_check(spark, d):
    x = cells8(spark, d)
    o, p = x.where("seed % 2 = 0"), x.where("seed % 2 = 1").select((F.col("seed") - 1).alias("seed"), "cond", "train", "test", F.col("n_test").alias("other"))
    return o.join(p, ["seed", "cond", "train", "test"]).groupBy("cond", "train", "test").agg(F.count("*").alias("compared"), F.count_if(F.col("n_test") != F.col("other")).alias("unequal"))


@query(f"WITH {G8}, a AS {contrast_sql('SLE', 'C0', where='test <> 0')}, b AS {contrast_sql('SLE', 'C0', where='test = 0')} SELECT seed, round(a.value - b.value, 9) AS difference FROM a JOIN b USING (seed)")
def model_difference(spark, d):
    x = grid.with_gap(cells8(spark, d))
    b = grid.contrast(x.where("test = 0"), "SLE", "C0", "auc").withColumnRenamed("value", "other")
    return grid.contrast(x.where("test <> 0"), "SLE", "C0", "auc").join(b, "seed").select("seed", F.round(F.col("value") - F.col("other"), 9).alias("difference"))


@query(f"WITH {V8}, k AS (SELECT label, seed, value, value + ((seed % 3) - 1) * 0.01::DOUBLE AS clean FROM v) SELECT label, count(*) AS seeds, round(avg(clean - value), 9) AS mean_change, round(max(abs(clean - value)), 9) AS max_change, round(quantile_cont(abs(clean - value), 0.5), 9) AS median_change, count(*) FILTER (sign(clean) <> sign(value)) AS flips FROM k GROUP BY label")
def contamination_delta(spark, d):
    x = contrasts(spark, d).withColumn("clean", F.col("value") + ((F.col("seed") % 3) - 1) * F.lit(0.01))
    c = F.abs(F.col("clean") - F.col("value"))
    return x.groupBy("label").agg(F.count("*").alias("seeds"), F.round(F.avg(F.col("clean") - F.col("value")), 9).alias("mean_change"), F.round(F.max(c), 9).alias("max_change"), F.round(F.percentile(c, F.lit(0.5)), 9).alias("median_change"), F.count_if(F.signum("clean") != F.signum("value")).alias("flips"))


@query(f"WITH {G8} SELECT * FROM (" + " UNION ALL ".join(f"SELECT {k} AS left_out, seed, round(value, 9) AS value FROM {contrast_sql('SLE', 'C0', where=f'train <> {k} AND test <> {k}')}" for k in range(3)) + ")")
def loo_contrast(spark, d):
    x = grid.with_gap(cells8(spark, d))
    return reduce(DataFrame.unionByName, (grid.contrast(x.where((F.col("train") != k) & (F.col("test") != k)), "SLE", "C0", "auc").select(F.lit(k).alias("left_out"), "seed", *r9("value")) for k in range(3)))


@query(f"WITH {C8} SELECT cond, train, kind, count(auc) AS n, round(avg(auc), 9) AS mean, round(stddev_samp(auc), 8) AS sd, min(auc) AS min, max(auc) AS max, count(*) FILTER (auc > 0.5) AS above FROM cells GROUP BY 1, 2, 3")
def source_variability(spark, d):
    return cells8(spark, d).groupBy("cond", "train", "kind").agg(F.count("auc").alias("n"), F.round(F.avg("auc"), 9).alias("mean"), F.round(F.stddev_samp("auc"), 8).alias("sd"), F.min("auc").alias("min"), F.max("auc").alias("max"), F.count_if(F.col("auc") > 0.5).alias("above"))


_P = f"""{V8}, z AS (SELECT label, list(value ORDER BY value) AS v FROM v WHERE value <> 0 GROUP BY label), q AS (SELECT label, v, unnest(range(0, (1 << len(v)))) AS m FROM z),
t AS (SELECT label, abs(list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (m >> (i - 1)::INT) & 1 = 1 THEN -v[i] ELSE v[i] END))) AS s, abs(list_sum(v)) AS o FROM q),
p AS (SELECT label, avg(CASE WHEN s >= o - 1e-12 THEN 1.0 ELSE 0.0 END) AS p FROM t GROUP BY label)"""


@query(f"WITH {_P} SELECT label, len(v) AS n, p FROM p JOIN z USING (label)")
def signflip_test(spark, d):
    return grid.signflip(contrasts(spark, d), ("label",))


@query(f"WITH {_P}, f AS (SELECT label, p, CASE WHEN label < 'L' THEN 'a' ELSE 'b' END AS family FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, label) AS r, count(*) OVER (PARTITION BY family) AS m FROM f) SELECT family, label, p, max(least(1.0, (m - r + 1) * p)) OVER (PARTITION BY family ORDER BY p, label ROWS UNBOUNDED PRECEDING) AS p_holm FROM r")
def holm_adjust(spark, d):
    x = grid.signflip(contrasts(spark, d), ("label",)).withColumn("family", F.when(F.col("label") < "L", "a").otherwise("b"))
    return grid.holm(x, ("family",)).select("family", "label", "p", "p_holm")


@query(f"WITH {C3}, k AS (SELECT * FROM cells WHERE NOT (seed = 3 AND cond = 'A' AND train = 1)), g AS (SELECT s.seed, c.cond, t.train, u.test FROM (SELECT DISTINCT seed FROM k) s, (SELECT DISTINCT cond FROM k) c, (SELECT DISTINCT train FROM k) t, (SELECT DISTINCT test FROM k) u) SELECT g.*, count(k.auc) AS n, CASE WHEN count(k.auc) = 0 THEN 'missing' WHEN count(k.auc) > 1 THEN 'repeated' ELSE 'once' END AS state FROM g LEFT JOIN k USING (seed, cond, train, test) GROUP BY ALL")
def grid_completeness(spark, d):
    return grid.completeness(cells3(spark, d).where("not (seed = 3 and cond = 'A' and train = 1)"), ("seed", "cond", "train", "test"))


@query(f"WITH {C3}, b AS (SELECT * FROM cells UNION ALL SELECT seed, cond, train, test, 'in', CASE WHEN seed = 2 THEN NULL ELSE 1.5 END, n_test FROM cells WHERE cond = 'A' AND seed <= 2) SELECT count(*) AS cells, count(*) FILTER (kind <> CASE WHEN train = test THEN 'in' ELSE 'cross' END) AS wrong_kind, count(*) FILTER (auc IS NULL) AS null_metric, count(*) FILTER (auc < 0 OR auc > 1) AS out_of_range, (SELECT count(*) FROM (SELECT 1 FROM b GROUP BY seed, cond, train, test HAVING count(*) > 1)) AS repeated_keys FROM b")
def grid_validate(spark, d):
    x = cells3(spark, d)
    bad = x.where("cond = 'A' and seed <= 2").withColumn("kind", F.lit("in")).withColumn("auc", F.when(F.col("seed") == 2, F.lit(None)).otherwise(F.lit(1.5)))
    return grid.violations(x.unionByName(bad))


@query(f"WITH {C3}, d AS (SELECT seed, cond, train FROM cells WHERE NOT (seed = 4 AND test = 2) AND seed <> 6 GROUP BY 1, 2, 3 HAVING count(DISTINCT test) >= 3) SELECT DISTINCT seed, cond, train FROM cells c WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.seed = c.seed AND d.cond = c.cond AND d.train = c.train)")
def pending_jobs(spark, d):
    x = cells3(spark, d)
    return grid.pending(x.select("seed", "cond", "train").distinct(), x.where("not (seed = 4 and test = 2) and seed <> 6"), 3)


@query("SELECT DISTINCT l_suppkey % 50 AS k FROM lineitem WHERE l_returnflag = 'A' AND l_suppkey % 50 < 40 EXCEPT SELECT DISTINCT l_suppkey % 50 FROM lineitem WHERE l_suppkey % 50 > 20")
def set_difference(spark, d):
    k = read(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("k"), "l_returnflag")
    return k.where("l_returnflag = 'A' and k < 40").select("k").subtract(k.where("k > 20").select("k"))


@query("SELECT DISTINCT l_suppkey % 50 AS k FROM lineitem WHERE l_suppkey % 50 < 40 INTERSECT SELECT DISTINCT l_suppkey % 50 FROM lineitem WHERE l_suppkey % 50 > 20")
def set_intersection(spark, d):
    k = read(spark, d, "lineitem").select((F.col("l_suppkey") % 50).alias("k"))
    return k.where("k < 40").intersect(k.where("k > 20"))


@query("WITH k(o, v) AS (VALUES ('click', 0), ('view', 0), ('purchase', 1)), x AS (SELECT event_type AS o, (avg(value) > 50)::INT AS got FROM events GROUP BY 1) SELECT o AS outlet, v AS known, got, v <> got AS inverted FROM k JOIN x USING (o)")
def label_direction(spark, d):
    known = spark.createDataFrame([("click", 0), ("view", 0), ("purchase", 1)], "outlet string, known int")
    x = read(spark, d, "events").groupBy(F.col("event_type").alias("outlet")).agg((F.avg("value") > 50).cast("int").alias("got"))
    return x.join(F.broadcast(known), "outlet").select("outlet", "known", "got", (F.col("known") != F.col("got")).alias("inverted"))  # three rows


# Sampling ------------------------------------------------------------------------------------------------------------
U = f"""{C}, u0 AS (SELECT *, {raw_words("text")} AS n_words, row_number() OVER (PARTITION BY dataset, is_fake ORDER BY md5('42|' || doc_id), doc_id) AS r FROM c), u1 AS (SELECT * FROM u0 WHERE r <= 60),
q AS (SELECT dataset, list_distinct(quantile_cont(n_words, [0.0, 0.25, 0.5, 0.75, 1.0])) AS d FROM u1 GROUP BY dataset), e AS (SELECT dataset, list_sort(d) AS edges FROM q),
u AS (SELECT u1.*, greatest(0, least(len(list_filter(edges, lambda x: x <= n_words)) - 1, len(edges) - 2)) AS bin FROM u1 JOIN e USING (dataset))"""
UQ = f"""{U}, b0 AS (SELECT dataset, bin, count(*) FILTER (is_fake = 0) AS n0, count(*) FILTER (is_fake = 1) AS n1 FROM u GROUP BY 1, 2), b1 AS (SELECT *, least(n0, n1) AS m FROM b0), t AS (SELECT dataset, sum(m)::BIGINT AS total FROM b1 GROUP BY 1),
lq AS (SELECT dataset, bin, n0, n1, m, total, CASE WHEN total > 0 THEN floor(m::DOUBLE * least(25.0::DOUBLE, total::DOUBLE) / total) ELSE 0 END::BIGINT AS quota FROM b1 JOIN t USING (dataset))"""


def universe(spark, d) -> DataFrame:
    x = docs(spark, d).withColumn("n_words", T.raw_word_count("text"))
    return sampling.length_bins(sampling.stratified(x, ("dataset", "is_fake"), 60, 42, "doc_id").drop("rank"), "n_words", 4, ("dataset",))


@query(f"WITH {U} SELECT doc_id, dataset, is_fake FROM u1")
def universe_sample(spark, d):
    return sampling.stratified(normed(spark, d), ("dataset", "is_fake"), 60, 42, "doc_id").select("doc_id", "dataset", "is_fake")


@query(f"WITH {U} SELECT doc_id, n_words, bin FROM u")
def length_bins(spark, d):
    return universe(spark, d).select("doc_id", "n_words", "bin")


@query(f"WITH {UQ} SELECT * FROM lq")
def length_quota(spark, d):
    return sampling.length_quota(universe(spark, d), ("dataset",), "is_fake", 25)


@query(f"WITH {U}, k AS (SELECT dataset, least(count(*) FILTER (is_fake = 0), count(*) FILTER (is_fake = 1), 25) AS take FROM u GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY dataset, is_fake ORDER BY md5('7|' || doc_id), doc_id) AS rr FROM u) SELECT doc_id, dataset, is_fake FROM r JOIN k USING (dataset) WHERE rr <= take")
def draw_balanced(spark, d):
    return sampling.draw_balanced(universe(spark, d), ("dataset",), "is_fake", 25, 7, "doc_id").select("doc_id", "dataset", "is_fake")


_MATCHED = f"{UQ}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, bin, is_fake ORDER BY md5('7|' || doc_id), doc_id) AS rr FROM u), dm AS (SELECT r.* FROM r JOIN lq USING (dataset, bin) WHERE rr <= quota)"


def matched(spark, d):
    return sampling.draw_matched(universe(spark, d), ("dataset",), "is_fake", 25, 7, "doc_id")


@query(f"WITH {_MATCHED} SELECT doc_id, dataset, bin, is_fake FROM dm")
def draw_length_matched(spark, d):
    return matched(spark, d).select("doc_id", "dataset", "bin", "is_fake")


@query(f"WITH {_MATCHED} SELECT row_number() OVER (ORDER BY dataset, doc_id) AS pos, doc_id, dataset, is_fake FROM dm WHERE dataset <> 'C'")
def select_sample(spark, d):
    from pyspark.sql import Window

    m = matched(spark, d).select("doc_id", "dataset").withColumn("pos", F.row_number().over(Window.orderBy("dataset", "doc_id")))  # a drawn sample: at most n rows a class
    return docs(spark, d).select("doc_id", "is_fake").join(m.where("dataset <> 'C'"), "doc_id").select("pos", "doc_id", "dataset", "is_fake").orderBy("pos")


_PART = [f"sum(('0x' || substr(h, {1 + 15 * i}, 15))::BIGINT)::HUGEINT" for i in range(4)]


@query(f"WITH {_MATCHED}, hh AS (SELECT dataset, sha256(doc_id || '|' || is_fake || '|' || bin) AS h FROM dm) SELECT dataset, count(*) AS rows, sha256(count(*) || '|' || {' || chr(124) || '.join(_PART)}) AS sample_sha256 FROM hh GROUP BY dataset")
def sample_fingerprint(spark, d):
    return sampling.fingerprint(matched(spark, d), ("dataset",), "doc_id", "is_fake", "bin")


@query(f"WITH {_MATCHED}, l AS (SELECT item_id, len({ws(norm(strip('text')))}) AS n FROM benchmark) SELECT bin, count(*) AS eligible, (SELECT count(*) FROM l) AS targets FROM dm GROUP BY bin")
def target_selection(spark, d):
    n = read(spark, d, "benchmark").select("item_id").agg(F.count("*").alias("targets"))
    return matched(spark, d).groupBy("bin").agg(F.count("*").alias("eligible")).crossJoin(F.broadcast(n))  # one row


@query(f"WITH {C}, k AS (SELECT DISTINCT dataset, source FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('5|' || dataset || '|' || source), source) AS r, count(*) OVER (PARTITION BY dataset) AS n FROM k) SELECT dataset, source, CASE WHEN r <= floor(n * 0.25) THEN 'test' ELSE 'train' END AS role, count(*) AS n FROM c JOIN r USING (dataset, source) GROUP BY 1, 2, 3")
def cluster_split(spark, d):
    return sampling.cluster_split(docs(spark, d), ("dataset",), "source", 0.25, 5).groupBy("dataset", "source", "role").agg(F.count("*").alias("n"))


@query("WITH q AS (SELECT quantile_cont(epoch_us(ts), 0.8) AS cut FROM events), x AS (SELECT event_id, user_id, CASE WHEN epoch_us(ts) <= cut THEN 'train' ELSE 'test' END AS role FROM events, q) SELECT role, count(*) AS n, count(DISTINCT user_id) AS clusters FROM x WHERE role = 'train' OR user_id NOT IN (SELECT user_id FROM x WHERE role = 'train') GROUP BY 1")
def temporal_split(spark, d):
    return sampling.temporal_split(read(spark, d, "events"), "ts", "user_id", 0.8).groupBy("role").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("clusters"))


_CAP = "o AS (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2), k AS (SELECT event_type, unnest(range(1, 1 + max(n))) AS cap FROM o GROUP BY event_type), s AS (SELECT event_type, cap, sum(least(n, cap)) AS got FROM k JOIN o USING (event_type) GROUP BY 1, 2), w AS (SELECT event_type, coalesce(min(cap) FILTER (got >= 900), max(cap)) AS cap FROM s GROUP BY 1)"


@query(f"WITH {_CAP} SELECT * FROM w")
def water_fill_cap(spark, d):
    x = read(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return sampling.water_fill_cap(x, ("event_type",), "n", 900)


@query(f"WITH {_CAP}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY md5('3|' || event_id), event_id) AS r FROM events), t AS (SELECT r.event_id, r.event_type, row_number() OVER (PARTITION BY r.event_type ORDER BY md5('4|' || event_id), event_id) AS rr FROM r JOIN w USING (event_type) WHERE r <= cap) SELECT event_id, event_type FROM t WHERE rr <= 900")
def outlet_cap(spark, d):
    return sampling.water_fill_sample(read(spark, d, "events"), ("event_type",), "user_id", 900, 3, "event_id").select("event_id", "event_type")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, d):
    return read(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50)


@query(f"WITH {C}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, is_fake ORDER BY md5('9|' || doc_id), doc_id) AS r FROM c) SELECT doc_id, replace(substr(text, 1, 600), chr(10), ' ') AS preview FROM r WHERE r <= 20 ORDER BY md5('10|' || doc_id)")
def blind_sample(spark, d):
    x = sampling.stratified(docs(spark, d), ("dataset", "is_fake"), 20, 9, "doc_id")
    return x.orderBy(sampling.hash_order(10, "doc_id")).select("doc_id", T.preview("text", 600).alias("preview"))


# Metrics -------------------------------------------------------------------------------------------------------------
S = f"{N}, s AS (SELECT dataset, is_fake, (n_words % 40) / 40.0::DOUBLE AS score FROM n)"


def scored(spark, d) -> DataFrame:
    return normed(spark, d).select("doc_id", "dataset", "is_fake", ((F.col("n_words") % 40) / F.lit(40.0)).alias("score"))


@query(f"WITH {S}, cm AS (SELECT dataset, count(*) AS n, avg((is_fake = (score >= 0.5)::INT)::INT) AS accuracy, count(*) FILTER (is_fake = 1 AND score >= 0.5) AS tp, count(*) FILTER (is_fake = 0 AND score >= 0.5) AS fp, count(*) FILTER (is_fake = 1 AND score < 0.5) AS fn FROM s GROUP BY 1) SELECT dataset, n, round(accuracy, 9) AS accuracy, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END, 9) AS f1 FROM cm")
def binary_metrics(spark, d):
    return metrics.threshold_metrics(scored(spark, d), ("dataset",), "score", "is_fake").select("dataset", "n", *r9("accuracy", "f1"))


@query(f"WITH {S} SELECT a.dataset, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END), 9) AS auc FROM s a JOIN s b ON a.dataset = b.dataset AND a.is_fake = 1 AND b.is_fake = 0 GROUP BY 1")
def roc_auc(spark, d):
    return metrics.roc_auc(scored(spark, d), ("dataset",), "score", "is_fake").select("dataset", *r9("auc"))


@query(f"WITH {S}, g AS (SELECT dataset, score, sum(is_fake) AS p, count(*) AS k FROM s GROUP BY 1, 2), r AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS n FROM g WINDOW w AS (PARTITION BY dataset ORDER BY score DESC)) SELECT dataset, round(sum(p * (tp / n)) / sum(p), 9) AS ap FROM r GROUP BY 1")
def average_precision(spark, d):
    return metrics.average_precision(scored(spark, d), ("dataset",), "score", "is_fake").select("dataset", *r9("ap"))


_K = f"{C}, k AS (SELECT dataset, quality AS a, CASE WHEN c.doc_id % 5 = 0 THEN 1 - quality ELSE quality END AS b FROM c JOIN labels USING (doc_id))"


def rated(spark, d) -> DataFrame:
    x = docs(spark, d).join(read(spark, d, "labels").select("doc_id", F.col("quality").alias("a")), "doc_id")
    return x.withColumn("b", F.when(F.col("doc_id") % 5 == 0, 1 - F.col("a")).otherwise(F.col("a")))


@query(f"WITH {_K}, g AS (SELECT dataset, count(*) AS n, avg((a = b)::INT) AS po, avg(a) AS pa, avg(b) AS pb FROM k GROUP BY 1), h AS (SELECT *, pa * pb + (1 - pa) * (1 - pb) AS pe FROM g) SELECT dataset, n, round(po, 9) AS agreement, round(CASE WHEN pe < 1 THEN (po - pe) / (1 - pe) END, 9) AS kappa FROM h")
def kappa(spark, d):
    return metrics.kappa(rated(spark, d), ("dataset",), "a", "b").select("dataset", "n", *r9("agreement", "kappa"))


@query(f"""WITH {_K}, t AS (SELECT count(*) AS n, count(*) FILTER (a = 0 AND b = 0) AS c00, count(*) FILTER (a = 0 AND b = 1) AS c01, count(*) FILTER (a = 1 AND b = 0) AS c10 FROM k),
r AS (SELECT draw, n, ('0x' || substr(md5('1|' || draw || '|' || pos), 1, 12))::BIGINT % n AS h, c00, c01, c10 FROM t, range(1, 2001) a(draw), range(1, (SELECT n + 1 FROM t)) b(pos)),
s AS (SELECT draw, n, count(*) FILTER (h < c00) AS k0, count(*) FILTER (h >= c00 AND h < c00 + c01) AS k1, count(*) FILTER (h >= c00 + c01 AND h < c00 + c01 + c10) AS k2, count(*) FILTER (h >= c00 + c01 + c10) AS k3 FROM r GROUP BY 1, 2),
p AS (SELECT (k0 + k3) / n AS po, (k2 + k3) / n AS pa, (k1 + k3) / n AS pb FROM s), e AS (SELECT po, pa * pb + (1 - pa) * (1 - pb) AS pe FROM p), q AS (SELECT (po - pe) / (1 - pe) AS kappa FROM e WHERE pe < 1)
SELECT round(quantile_cont(kappa, 0.025), 9) AS lo, round(quantile_cont(kappa, 0.975), 9) AS hi FROM q""")
def kappa_bootstrap(spark, d):
    return metrics.kappa_interval(rated(spark, d), "doc_id", "a", "b", 1).select(*r9("lo", "hi"))


# Models --------------------------------------------------------------------------------------------------------------
@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM t),
f AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM documents), v AS (SELECT term, count(*) AS df FROM f GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.95 * (SELECT n FROM n)),
w AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS x FROM f JOIN v USING (term), n), l AS (SELECT doc_id, sqrt(sum(x * x)) AS z FROM w GROUP BY 1)
SELECT doc_id, count(*) AS terms, round(sum(x / z), 6) AS total, round(max(x / z), 6) AS most FROM w JOIN l USING (doc_id) GROUP BY 1""")
def tfidf_weights(spark, d):
    w = tfidf.weights(read(spark, d, "documents"), "doc_id", "text")
    return w.groupBy("doc_id").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 6).alias("total"), F.round(F.max("weight"), 6).alias("most"))


@query()
def top_tokens(spark, d):
    """Words and pairs of words with the greatest and the least coefficients of each corpus."""
    return tfidf.top_terms(docs(spark, d), "dataset", "doc_id", "text", "is_fake").withColumn("coefficient", F.round("coefficient", 6))


#: Labels that are broadcast at most.
RATED = 1_000_000


def _rated(spark, d) -> DataFrame:
    y = read(spark, d, "labels").select("doc_id", F.col("quality").alias("y"))
    if y.count() <= RATED:  # else the texts would be shuffled for it
        y = F.broadcast(y)
    x = docs(spark, d).join(y, "doc_id")
    return x.select("doc_id", "dataset", "text", (1 - F.col("y")).cast("double").alias("is_fake"))


@query()
def lr_cross_eval(spark, d):
    """A model for each corpus, tested on its held-out part and on the other corpora."""
    s = Scratch(spark)
    x = s.keep(_rated(spark, d).withColumn("role", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 0, "test").otherwise("train")), "rated")
    return tfidf.cross_cells(x, tuple("ABC"), scratch=s)


@query()
def grid_run_small(spark, d):
    """The runner over two seeds and the conditions C0, S and R_S: a first run leaves off after C0, the second does what is not yet done."""
    x = Scratch(spark).keep(_rated(spark, d), "rated")
    first = tfidf.run_grid(x, (1, 2), ("C0",))
    rest = tfidf.run_grid(x, (1, 2), ("C0", "S", "R_S"), done=first)
    shards = first.withColumn("ordinal", F.lit(0)).unionByName(rest.withColumn("ordinal", F.lit(1)))
    return grid.keep_last(shards, ("seed", "cond", "train", "test"), "ordinal").drop("ordinal")
