"""Literal edge cases and invariants of the library's operators."""

import hashlib
import io
import json
import re
import zlib
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import corpus, grid, masks, metrics, overlap, sampling
from palimpsest.operators.graph import connected_components
from palimpsest.sources import readers


def test_normalisation(spark):
    rows = [("‘Smart’ — quotes…", "smart quotes"), ("½ a² b_c d", "½ a² b_c d"), ("", ""), ("!!", "")]
    got = spark.createDataFrame(rows, "t string, want string").select(T.norm_light("t").alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)
    strip = [("WASHINGTON (Reuters) - The senate (AP) said reuters @josé http://x.y/z", "the senate said"), ("no marks", "no marks")]
    got = spark.createDataFrame(strip, "t string, want string").select(T.norm_strip("t").alias("n"), "want").collect()
    assert all(r.n == r.want for r in got)


def test_shingles_and_hashes(spark):
    df = spark.createDataFrame([("",), ("a b",), ("a b c d e",), ("a b c d e f",)], "t string")
    assert [r.n for r in df.select(F.size(T.shingles(T.words("t"), 5)).alias("n")).collect()] == [0, 1, 1, 2]
    x = corpus.with_hashes(spark.createDataFrame([("", "http://only.url"), ("t", "x" * 300), ("t", "x" * 299)], "title string, body string")).collect()
    assert x[0].h_text_light and x[0].h_text_strip is None and x[1].prefix and x[2].prefix is None


def test_exact_dedup_drops_conflicts_whole(spark):
    rows = [("A", 1, "k", 0), ("A", 2, "k", 1), ("A", 3, "m", 1), ("A", 4, "m", 1), ("A", 5, None, 0), ("A", 6, None, 1), ("B", 7, "k", 0)]
    got = corpus.exact_dedup(spark.createDataFrame(rows, "dataset string, id int, h string, y int"), "h", "y", "id").collect()
    assert sorted(r.id for r in got) == [3, 5, 6, 7]


def test_near_pairs_by_containment_only(spark):
    w = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(w[:85])), (2, " ".join(w[:385])), (3, " ".join(w[:53])), (4, "z " * 30), (5, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    got = {(r.i, r.j): r for r in overlap.near_pairs(df, "id", "t", views=("full",)).collect()}
    assert set(got) == {(1, 2)} and got[1, 2].jaccard < 0.8 and got[1, 2].containment == 1.0
    assert (1, 3) in {(r.i, r.j) for r in overlap.near_pairs(df, "id", "t", views=("full",), least_set=0).collect()}


def test_drop_flagged_takes_the_larger_datasets_document(spark):
    def words(tag, n=30):
        return " ".join(f"{tag}{i}" for i in range(n))

    near = words("n").split()
    rows = [(1, "A", words("e")), (2, "B", words("e")), (3, "A", words("p", 120)), (4, "C", words("p", 120) + " tail of its own that is much longer " + words("t", 900))]
    rows += [(5, "A", " ".join(near)), (6, "B", " ".join(near[:-1] + ["other"])), (7, "A", words("s")), (8, "C", " ".join(words("s").split()[:-7]) + " " + words("z", 7))]
    rows += [(9, "B", "too few words"), (10, "A", None), (11, "A", words("k")), (12, "A", words("k")), (13, None, words("e")), (14, "B", words("tie")), (15, "C", words("tie")), (16, "C", words("alone"))]
    df = spark.createDataFrame(rows, "id long, ds string, ns string")  # A holds 7, B and C 4 each
    got = {r.id: r.reason for r in overlap.drop_flagged(df, "id", "ns", "ds").collect()}
    assert got == {1: "exact", 3: "prefix300", 5: "near_primary", 7: "near_sens", 9: "degenerate", 10: "degenerate", 14: "exact"}
    assert overlap.drop_flagged(df.limit(0), "id", "ns", "ds").count() == 0


def test_evidence_of_each_kind(spark):
    long = " ".join(f"w{i}" for i in range(130))
    docs = [(1, "Title", long), (2, "T", long.upper() + " @tag"), (3, "T", long + " and a tail " + " ".join(f"x{i}" for i in range(400))), (4, "", None), (5, "T", "nothing of it"), (6, "", "")]
    x = spark.createDataFrame(docs, "d long, title string, body string").withColumn("both", F.concat_ws(" ", "title", "body"))
    items = spark.createDataFrame([(70, long), (71, ""), (72, None)], "t long, text string")
    got = {}
    for r in overlap.evidence(x, "d", items, "t", {"body": ("body", "text"), "title_body": ("both", "text")}).collect():
        assert r.t == 70 and 0 < r.jaccard <= 1 and 0 < r.containment <= 1
        got.setdefault((r.d, r.field), set()).add(r.method)
    near = {"primary_full", "primary_head100", "sensitivity_full", "sensitivity_head100"}
    assert got[1, "body"] == near | {"exact_light", "exact_strip", "prefix300"} and got[1, "title_body"] == near
    assert got[2, "body"] == near | {"exact_strip", "prefix300"} and got[2, "title_body"] == near
    assert got[3, "body"] == near | {"prefix300"} and got[3, "title_body"] == near
    assert {d for d, _ in got} == {1, 2, 3}
    assert overlap.evidence(x.limit(0), "d", items, "t", {"body": ("body", "text")}).count() == 0


def test_lsh_pairs_are_all_near_pairs(spark):
    w = [f"w{i}" for i in range(300)]
    edit = lambda v, *at: " ".join("x" + x if i in at else x for i, x in enumerate(v))
    rows = [(i, edit(w, 20 * i)) for i in range(4)]  # one bucket of four: neither leads nor neighbours only
    rows += [(10 + i, edit([f"v{x}" for x in range(400)], i)) for i in range(300)]  # a bucket beyond one block
    rows += [(400 + i, " ".join([f"h{x}" for x in range(100)] + [f"t{i}_{x}" for x in range(150)])) for i in range(3)]  # the head view only
    rows += [(500, edit([f"c{x}" for x in range(70)])), (501, edit([f"c{x}" for x in range(92)]))]  # containment only
    rows += [(600 + i, "same few words of a text") for i in range(4)] + [(700, ""), (701, "")]
    df = spark.createDataFrame(rows, "id int, t string")
    key = lambda x: {(r.i, r.j, round(r.jaccard, 9), round(r.containment, 9)) for r in x.collect()}
    got = key(overlap.lsh_pairs(df, "id", "t"))
    assert got == key(overlap.near_pairs(df, "id", "t")) and len(got) == 6 + 300 * 299 // 2 + 3 + 1 + 6


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3), (7, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(60))
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_spans(spark):
    rows = [("abcdef", [(1, 3), (2, 4)], "aef"), ("abc  d", [], "abc  d"), ("ab cd ef", [(3, 5)], "ab ef"), ("abcd", [(0, 4), (1, 2)], "")]
    df = spark.createDataFrame(rows, f"t string, s {masks.SPANS}, want string")
    assert all(r.got == r.want for r in df.select(masks.cut(F.col("t"), F.col("s")).alias("got"), "want").collect())
    df = spark.createDataFrame([("LONDON (Reuters) - On Monday, May 5, 2016 it may rain. Follow us on Twitter",)], "t string")
    assert masks.mask(df, "t", "S").first().masked == "On Monday, May 5, 2016 it may rain."
    assert "Monday" not in (m := masks.mask(df, "t", "T").first().masked) and "2016" not in m and "it may rain" in m
    assert len(masks.patterns("W")) == 3 and len(masks.patterns("S", ("my site",))) == len(masks.SOURCE) + 1


def test_random_deletion(spark):
    df = spark.createDataFrame([(i, "a b  c d e", m) for i, m in enumerate((0, 2, 5, 9, -1))], "id int, t string, m int")
    new = [r.dropped for r in masks.drop_words(df, "id", "t", "m", 1, False).orderBy("id").collect()]
    assert new[0] == new[4] == "a b  c d e" and len(new[1].split()) == 3 and new[2] == new[3] == ""
    assert [len(r.dropped.split()) for r in masks.drop_words(df, "id", "t", "m", 1, True).orderBy("id").collect()] == [5, 3, 1, 1, 5]


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 37).cast("int").alias("n"), (F.col("id") / 4).cast("int").alias("c"), F.lit("A").alias("d"))
    one = {r.id for r in sampling.stratified(df, ("y",), 30, 1, "id").collect()}
    assert one == {r.id for r in sampling.stratified(df.repartition(7), ("y",), 30, 1, "id").collect()} and len(one) == 60
    binned = sampling.length_bins(df, "n", 5)
    got = sampling.draw_matched(binned, ("d",), "y", 100, 1, "id").groupBy("bin", "y").count().collect()
    assert len({(r.bin, r["count"]) for r in got}) == len({r.bin for r in got})
    split = sampling.cluster_split(df, ("d",), "c", 0.2, 3)
    assert split.groupBy("c").agg(F.count_distinct("role").alias("k")).where("k > 1").count() == 0
    assert split.where("role = 'test'").select("c").distinct().count() == 50
    flat = sampling.length_bins(df.withColumn("n", F.lit(3)), "n", 5)
    assert flat.select("bin").distinct().count() == 1


def test_statistics(spark):
    assert abs(grid.t_quantile(0.975, 7) - 2.364624) < 1e-6 and abs(grid.t_quantile(0.975, 4) - 2.776445) < 1e-6
    v = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 5.0), ("z", 0.0), ("z", 0.0)], "label string, value double")
    s = {r.label: r for r in grid.summarise(v, ("label",)).collect()}
    assert s["b"].lo is None and s["a"].same_sign == 3 and s["z"].same_sign == 2
    p = {r.label: r.p for r in grid.signflip(v, ("label",)).collect()}
    assert p["a"] == 0.25 and p["b"] == 1.0 and p["z"] == 1.0
    h = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "label string, p double")
    assert {r.label: r.p_holm for r in grid.holm(h, ()).collect()} == {"a": 0.03, "c": 0.06, "b": 0.06, "d": None}


def test_grid_checks(spark):
    rows = [(s, c, a, b, "in" if a == b else "cross", 0.5 + a / 10) for s in (0, 1) for c in ("C0", "S") for a in range(3) for b in range(3)]
    df = spark.createDataFrame(rows, "seed int, cond string, train int, test int, kind string, auc double")
    assert grid.completeness(df, ("seed", "cond", "train", "test")).where("state <> 'once'").count() == 0
    assert grid.completeness(df.where("not (seed = 1 and test = 2 and train = 0 and cond = 'S')"), ("seed", "cond", "train", "test")).where("state = 'missing'").count() == 1
    bad = df.withColumn("kind", F.lit("in")).unionByName(df.limit(1))
    assert grid.violations(bad).first().asDict() == {"cells": 37, "wrong_kind": 24, "null_metric": 0, "out_of_range": 0, "repeated_keys": 1}
    with pytest.raises(Exception, match="more than one"):
        grid.with_gap(df.unionByName(df.where("seed = 0 and cond = 'C0' and train = 0 and test = 0"))).collect()


def test_metrics_with_ties(spark):
    df = spark.createDataFrame([("x", 0.5, 1), ("x", 0.5, 0), ("x", 0.9, 1), ("x", 0.1, 0), ("y", 0.1, 1), ("y", 0.2, 1)], "g string, s double, y int")
    assert {r.g: r.auc for r in metrics.roc_auc(df, ("g",), "s", "y").collect()} == {"x": 0.875, "y": None}
    assert {r.g: r.f1 for r in metrics.threshold_metrics(df, ("g",), "s", "y").collect()} == {"x": 0.8, "y": 0.0}
    same = spark.createDataFrame([(1, 1), (1, 1)], "a int, b int")
    assert metrics.kappa(same, (), "a", "b").first().kappa is None


def test_vocabulary_comes_from_the_training_texts(spark):
    from palimpsest.operators import tfidf

    rows = [(1, "aa bb cc"), (2, "aa bb dd"), (3, "bb cc"), (4, "dd")]
    df = spark.createDataFrame(rows, "id int, t string")
    w, t = tfidf.weights(df, "id", "t"), tfidf.terms(df, "id", "t")
    want = {i: sorted(round(r.weight, 9) for r in w.collect() if r.id == i) for i in range(1, 5)}
    voc = tfidf.fit(t)
    got = {r.doc: r.features for r in tfidf.transform(t, voc).collect()}
    assert {i: sorted(round(float(x), 9) for x in v.values) for i, v in got.items()} == want
    assert all(v.size == w.select("term").distinct().count() for v in got.values())
    few = tfidf.fit(t.where("doc <= 2"), most_share=1.0)
    assert {r.term for r in few.collect()} == {"aa", "bb", "aa bb"}
    assert {r.doc for r in tfidf.transform(t, few).collect()} == {1, 2, 3}


def test_grid_runner_resumes_and_tokens_follow_the_label(spark):
    from palimpsest.operators import tfidf

    rows = [(100 * c + i, "AB"[c], f"https://x.y/{i} " + ("alpha beta" if i % 2 else "gamma delta") + f" common w{i % 5} " + "pad " * (i % 9), float(i % 2)) for c in range(2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id int, dataset string, text string, is_fake double").persist()
    first = tfidf.run_grid(df, (1,), ("C0",), n=20, bins=2).persist()
    cells = first.collect()
    assert sorted((r.train, r.test, r.kind) for r in cells) == [("A", "A", "in"), ("A", "B", "cross"), ("B", "A", "cross"), ("B", "B", "in")]
    assert all(r.auc == 1.0 and r.n_train == 40 for r in cells)
    rest = tfidf.run_grid(df, (1,), ("C0", "R_S", "L"), done=first.where("not (train = 'B' and test = 'A')"), n=20, bins=2).collect()
    assert {(r.cond, r.train) for r in rest} == {("C0", "B"), ("R_S", "A"), ("R_S", "B"), ("L", "A"), ("L", "B")}
    assert tfidf.run_grid(df, (1,), ("C0",), done=first).count() == 0
    top = tfidf.top_terms(df, "dataset", "doc_id", "text", "is_fake", k=3, most_share=0.5).collect()
    assert {r.term for r in top if r.side == "fake"} <= {"alpha", "beta", "alpha beta", "beta common"} and {r.term for r in top if r.side == "real"} <= {"gamma", "delta", "gamma delta", "delta common"}


def _least(x, y, size):
    """The coefficients (constant last) of least |w|^2 / 2 + log loss by plain Newton steps over a dense matrix."""
    w = np.zeros(size + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ w))
        w = w - np.linalg.solve(np.eye(size + 1) + (x.T * (p * (1 - p))) @ x, w + x.T @ (p - y))
    return w


def _labelled_texts(spark):
    # Three ones in four are of class 0, so that the constant counts.
    rows = [(100 * c + i, "AB"[c], ("alpha beta" if i % 4 == 0 else "gamma delta") + f" common w{i % 5} x{i % 7} " + "pad " * (i % 9), float(i % 4 == 0)) for c in range(2) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id int, dataset string, text string, is_fake double")


def test_models_of_one_task_and_of_all_are_the_same(spark):
    from palimpsest.operators import tfidf
    from palimpsest.plans.scratch import Scratch

    df = _labelled_texts(spark)
    far = tfidf.fit_far(df, "dataset", "text", "is_fake", Scratch(spark), features=30)
    here = {k: m for (_, k), m in tfidf.fit_here(df.withColumn("seed", F.lit(1)), "seed", "dataset", "text", "is_fake", features=30).items()}
    assert sorted(far) == sorted(here) == ["A", "B"]
    own = df.where("dataset = 'A'")
    voc = tfidf.fit(tfidf.terms(own, "doc_id", "text"))
    dense = {r.doc: r.features.toArray() for r in tfidf.transform(tfidf.terms(own, "doc_id", "text"), voc).collect()}
    rows = own.orderBy("doc_id").collect()
    want = _least(np.array([[*dense[r.doc_id], 1.0] for r in rows]), np.array([r.is_fake for r in rows]), voc.count())
    whole = tfidf.fit_far(own, "dataset", "text", "is_fake", Scratch(spark))["A"]
    assert np.allclose(sorted(whole.coef), sorted(want[:-1]), atol=5e-3) and abs(whole.bias - want[-1]) < 5e-3 and want[-1] < -0.1
    for k in far:
        assert len(far[k].terms) == 30 and (far[k].terms == here[k].terms).all() and np.allclose(far[k].idf, here[k].idf) and far[k].n == here[k].n == 60
        assert np.allclose(far[k].coef, here[k].coef, atol=5e-3) and abs(far[k].bias - here[k].bias) < 5e-3
    x, _ = tfidf.score_all(own, "text", [whole], "doc_id")
    got = {r.doc_id: r.scores[0] for r in x.collect()}
    assert all(abs(got[k] - 1 / (1 + np.exp(-(v @ want[:-1] + want[-1])))) < 5e-3 for k, v in dense.items())


def test_a_grid_is_few_passes_whatever_its_models(spark):
    from palimpsest.operators import tfidf

    df = _labelled_texts(spark).persist()
    spark.sparkContext.setJobGroup("grid", "grid")
    cells = tfidf.run_grid(df, (1, 2, 3), ("C0", "S"), n=20).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(cells) == 24 and all(r.n_test == (15 if r.kind == "in" else 60) for r in cells)
    # A model fitted by distributed steps alone takes tens of jobs; here are twelve models.
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid")) < 150


def test_condition_texts(spark):
    df = spark.createDataFrame([(1, "see https://a.b/c now (Reuters) on Monday please"), (2, "plain words only")], "id int, t string")
    of = lambda c: [r.condition_text for r in masks.condition_texts(df, "id", "t", c, 3).orderBy("id").collect()]
    assert of("C0") == of("L") == [r.t for r in df.orderBy("id").collect()]
    s, r = of("S"), of("R_S")
    assert s == ["see now on Monday please", "plain words only"] and len(r[0].split()) == len(s[0].split()) and r[1] == "plain words only"
    assert "Monday" not in of("T")[0] and "Reuters" not in of("S_W")[0] and "https" in of("S_W")[0]


def test_agreement_seeds_and_summaries(spark):
    df = spark.createDataFrame([(" Fake", "f", 1), ("real", "R", 0), ("1", "0", 1), ("maybe", "1", 1), ("0", "real", 1), (None, "0", 0)], "a string, b string, y int")
    r = metrics.agreement(df, (), "a", "b", "y").first()
    assert (r.n, r.agreement, r.consensus) == (4, 0.75, 3) and r.consensus_agreement == pytest.approx(2 / 3) and r.kappa == pytest.approx(0.5)
    got = spark.createDataFrame([("d1", "R")], "doc string, r string").select(sampling.stream_seed(42, "doc", "r").alias("s")).first().s
    assert got == zlib.crc32(b"42-d1-R") % 2**31
    v = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 6)] + [("b", 2.0)], "k string, value double")
    out = {r.k: r for r in grid.t_test(grid.summarise(v, ("k",))).withColumn("said", grid.said()).collect()}
    assert out["a"].p == pytest.approx(0.0206, abs=2e-4) and out["b"].p is None
    assert out["b"].said == "+2.000 [NA, NA] (1/1)" and out["a"].said.startswith("+3.200 [+0.") and out["a"].said.endswith("(5/5)")


def test_signflips_beyond_enumeration(spark):
    import random

    rng = random.Random(1)
    v = [rng.gauss(0.5, 1) for _ in range(24)]
    df = spark.createDataFrame([(x,) for x in v], "value double").withColumn("k", F.lit("x"))
    got = grid.signflip(df, ("k",)).first()
    draws = [abs(sum(x * rng.choice((-1, 1)) for x in v)) >= abs(sum(v)) for _ in range(40_000)]
    assert got.n == 24 and got.p == pytest.approx(sum(draws) / len(draws), abs=0.01)
    exact = grid.signflip(df.limit(12), ("k",)).first().p
    assert grid.signflip(df.limit(12), ("k",), most=5).first().p == pytest.approx(exact, abs=0.005)


def test_grid_domains(spark):
    cells = spark.createDataFrame([(1, "C0"), (1, "S"), (9, "C0")], "seed int, cond string")
    got = {(r.seed, r.cond): r.state for r in grid.completeness(cells, ("seed", "cond"), {"seed": [1, 2]}).collect()}
    assert got == {(1, "C0"): "once", (1, "S"): "once", (2, "C0"): "missing", (2, "S"): "missing", (9, "C0"): "extra"}


def test_manifest_and_time_split(spark):
    rows = [("A", i, i % 2, f"c{i // 2}") for i in range(10)]
    df = spark.createDataFrame(rows, "dataset string, id int, y int, cluster string")
    args = (("dataset",), "id", "y", "cluster")
    old = sampling.manifest(df, *args)
    assert sampling.verify_manifest(old, df.orderBy(F.desc("id")), *args).first().ok
    bad = df.where("id <> 3").withColumn("y", F.when(F.col("id") == 5, 0).otherwise(F.col("y"))).unionByName(spark.createDataFrame([("A", 77, 1, "c9")], df.schema))
    r = sampling.verify_manifest(old, bad, *args, held_out=spark.createDataFrame([("A", "c9"), ("A", "c1")], "dataset string, cluster string")).first()
    assert (r.rows, r.missing, r.extra, r.changed, r.unbalanced, r.shared_clusters, r.ok) == (10, 1, 1, 1, 2, 2, False)
    late = spark.createDataFrame([("x", 1), (None, 2), ("2020-01-01", 3)], "ts string, c int")
    with pytest.raises(Exception, match="no time|CAST"):
        sampling.temporal_split(late.withColumn("ts", F.expr("try_cast(ts as timestamp)")), "ts", "c", 0.8).collect()


def test_sealed_records_frozen_files_and_bundles(spark, tmp_path):
    r = readers.sealed({"b": 1, "a": [1.5, "é"]})
    assert readers.check_record(r) == r
    with pytest.raises(ValueError):
        readers.check_record({**r, "b": 2})
    src, dst = tmp_path / "in", tmp_path / "out"
    (src / "sub").mkdir(parents=True)
    (src / "a.txt").write_text("one")
    (src / "sub" / "b.txt").write_text("two")
    got = {x.path: x.sha256 for x in readers.freeze(spark, str(src), str(dst)).collect()}
    assert got == {n: hashlib.sha256(t).hexdigest() for n, t in (("a.txt", b"one"), ("sub/b.txt", b"two"))}
    assert readers.verify_frozen(spark, str(dst)).count() == 0
    assert (dst / "files" / "a.txt").stat().st_mode & 0o777 == 0o444
    with pytest.raises(FileExistsError):
        readers.freeze(spark, str(src), str(dst))
    (dst / "files" / "sub" / "b.txt").unlink()
    (dst / "files" / "c.txt").write_text("new")
    assert {(x.path, x.state) for x in readers.verify_frozen(spark, str(dst)).collect()} == {("sub/b.txt", "missing"), ("c.txt", "extra")}
    one = readers.bundle({"b": b"2", "a": b"1"})
    assert one == readers.bundle({"a": b"1", "b": b"2"})
    with zipfile.ZipFile(io.BytesIO(one)) as z:
        assert z.namelist() == ["SHA256SUMS", "a", "b"] and z.read("SHA256SUMS").decode().splitlines()[0] == hashlib.sha256(b"1").hexdigest() + "  a"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("d/t.csv", 'k,v\n1,caf\xe9\n2,"a\nb"\n3,\n'.encode("latin-1"))
    assert sorted((x.k, x.v) for x in readers.read_csv_in_zip(spark, str(tmp_path / "x.zip"), "d/t.csv").collect() if x.v) == [("1", "café"), ("2", "a\nb")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,text,label\n"x","line one\nline two ""q""",FAKE\ny,,REAL\n')
    df = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert df.count() == 2 and df.first().text == 'line one\nline two "q"'
    assert readers.locate(spark, f"file://{tmp_path}", "a.csv", "corpus").endswith("a.csv")
    for folder, name, data in (("fake", "001fake.txt", b"Head\n\nbody\n"), ("legit", "002legit.txt", b"\n Title \nrest"), ("fake", "003legit.txt", b"\xff\xfe\xff")):
        (tmp_path / "tree" / folder).mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / folder / name).write_bytes(data)
    t = {r.number: r for r in readers.read_tree(spark, str(tmp_path / "tree")).collect()}
    assert t["001"].title == "Head" and t["001"].body == "\nbody\n" and t["002"].title == "Title" and t["003"].decoding_error and not t["003"].label_ok
    with zipfile.ZipFile(tmp_path / "ok.zip", "w") as z:
        z.writestr("d/a.txt", "A")
    assert readers.read_zip(spark, str(tmp_path / "ok.zip")).first().member == "d/a.txt"
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../a.txt", "A")
    with pytest.raises(Exception, match="unsafe"):
        readers.read_zip(spark, str(tmp_path / "bad.zip")).collect()
    (tmp_path / "m.json").write_text(json.dumps({"a": [1, {"b": 2}]}))
    assert dict(readers.visit(readers.read_json(spark, str(tmp_path / "m.json")))) == {("a", 0): 1, ("a", 1, "b"): 2}
    readers.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exist"):
        readers.write_new(df, str(tmp_path / "out"))
    assert readers.protocol_guard(spark, str(tmp_path / "p"), {"a": 1}) == readers.protocol_guard(spark, str(tmp_path / "p"), {"a": 1})
    with pytest.raises(ValueError, match="protocol"):
        readers.protocol_guard(spark, str(tmp_path / "p"), {"a": 2})


def test_labels_and_quality(spark):
    lab = spark.createDataFrame([(" BBC ", "1"), ("bbc", "0"), ("x", "nope"), (None, "1")], "k string, v string")
    assert [tuple(r) for r in corpus.clean_labels(lab, "k", "v").collect()] == [("bbc", 0.0)]
    got = spark.createDataFrame([("2",), ("-1",), ("0.5",), ("FAKE",), ("NaN",), ("",), ("1.0",), ("0",)], "l string").select(corpus.strict_label(F.col("l")).alias("x")).collect()
    assert [r.x for r in got] == [None] * 6 + [1, 0]


def test_stream_of_new_documents(spark, tmp_path):
    from palimpsest.streaming.incremental import watch

    text = "one two three four five six seven"
    spark.createDataFrame([(1, text), (2, "nothing alike in here at all")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    items = spark.createDataFrame([(9, text)], "item_id long, text string")
    out = []
    watch(spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in")), items, lambda df, n: out.extend(df.collect()), str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.item_id, r.doc_id) for r in out] == [(9, 1)]


def test_bins_are_those_of_each_dataset(spark):
    rows = [("A", n) for n in range(1, 11)] + [("B", n) for n in range(100, 200, 10)]
    got = sampling.length_bins(spark.createDataFrame(rows, "dataset string, n int"), "n", 2, ("dataset",)).collect()
    assert {(r.dataset, r.n): r.bin for r in got} == {(d, n): int(n >= (5.5 if d == "A" else 145)) for d, n in rows}


def test_clusters_stay_within_a_dataset(spark):
    from palimpsest.operators import overlap

    w = [f"w{i}" for i in range(60)]
    text = lambda i: " ".join([*(f"x{j}" for j in range(i)), *w[i:]])
    # 1 and 3 of A are linked through 2 of B alone.
    rows = [(1, "A", text(0)), (2, "B", text(5)), (3, "A", text(10)), (4, "A", text(1)), (5, "B", text(6))]
    got = {r.doc_id: r.cluster for r in overlap.clusters_within(spark.createDataFrame(rows, "doc_id long, dataset string, ns string"), "doc_id", "ns", "dataset").collect()}
    assert got[4] == 1 and got[5] == 2 and got[2] == 2
    whole = {r.doc_id: r.cluster for r in overlap.clusters(spark.createDataFrame(rows, "doc_id long, dataset string, ns string"), overlap.near_pairs(spark.createDataFrame(rows, "doc_id long, dataset string, ns string"), "doc_id", "ns"), "doc_id").collect()}
    assert whole[2] == 1


def test_intervals_beyond_the_table(spark):
    from palimpsest.operators import grid

    got = {r.n: r.t for r in spark.createDataFrame([(n,) for n in (2, 64, 65, 70, 200, 5000)], "n int").select("n", grid.t_critical(F.col("n")).alias("t")).collect()}
    assert all(abs(t - grid.t_quantile(0.975, n - 1)) < 1e-8 for n, t in got.items())


def test_a_gap_near_zero_is_an_error(spark):
    import pytest

    from palimpsest.operators import grid

    of = lambda *rows: grid.gap_share(spark.createDataFrame(rows, "sle double, c0 double"), "sle", "c0").collect()
    assert of((0.2, 0.4))[0].share == 0.5
    with pytest.raises(Exception, match="near zero"):
        of((0.2, 0.4), (0.1, 1e-13))


def test_white_space_beyond_ascii(spark):
    from palimpsest.functions import text

    rows = ["one\u00a0two\u3000three", "\x1ca\x1fb\u2028c ", "", " \t"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.raw_word_count("t")).collect()]
    assert got == [len(x.split()) for x in rows]


def test_components_end_in_one_task_or_in_rounds(spark, monkeypatch):
    import random

    from palimpsest.operators import graph

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(180)] + [(5, 5), (None, 3)]
    root = {x: x for e in edges for x in e if x is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((find(a), find(b)))
            root[q] = p
    want = {x: find(x) for a, b in edges if a is not None and a != b for x in (a, b)}
    df = spark.createDataFrame(edges, "a long, b long")
    for few in (0, 40, 16_384):
        monkeypatch.setattr(graph, "FEW", few)
        assert {r.node: r.component for r in graph.connected_components(df).collect()} == want


def _python_spans(text, letters):
    """Spans by Python's re, pattern by pattern, on the original text."""
    flag = lambda f: (re.I if "i" in f else 0) | (re.M if "m" in f else 0)
    pats = []
    for c in letters:
        pats += [re.compile(p, flag(f)) for _, p, f in masks.SOURCE] if c == "S" else [re.compile(p, flag(f)) for p, f in masks.TEMPORAL] if c == "T" else [re.compile(masks.ENTITY)]
    return sorted(m.span() for p in pats for m in p.finditer(text))


def _python_cut(text, found):
    if not found:
        return text
    out, last = [], 0
    for a, b in found:
        out.append(text[last:a] if a > last else "")
        last = max(last, b)
    return " ".join("".join([*out, text[last:]]).split())


@pytest.mark.parametrize("letters", ["S", "T", "E", "SET"])
def test_masks_equal_python(spark, sf, letters):
    made = ["", "nothing here", "WASHINGTON (Reuters) - On May 5, 2016 at 5:30 p.m. CNN said\nShare:\r\nSource: AP\n😀 @josé #tag a@b see www.x.org", "NEW YORK (AP) — Featured image via Getty Images more\u0085end", "| source: Reuters | sources: x (source)", "é@no a@yes", "ПО 12.03.2019 Mr. José Ángel of the UN", "x " * 3000 + "https://a.b/c " * 300]
    docs = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(made)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))
    for r in masks.mask(docs, "text", letters).collect():
        if r.text is None:
            assert r.spans == [] and r.masked is None
            continue
        want = _python_spans(r.text, letters)
        assert [(s.start, s.end) for s in r.spans] == want, r.text[:300]
        assert r.masked == _python_cut(r.text, want)


def test_near_pairs_write_no_shingle_of_one_text_alone(spark):
    """Texts of their own, copies and one near pair: what is kept grows with what texts share, not with all their shingles."""
    from palimpsest.plans.scratch import Scratch

    class Counted(Scratch):
        rows = 0

        def keep(self, df, name="t"):
            out = super().keep(df, name)
            self.rows += out.count()
            return out

    texts = [" ".join(f"t{i}_{j}" for j in range(500)) for i in range(60)]
    near = " ".join(["other", *texts[0].split()[1:]])
    df = spark.createDataFrame([*enumerate(texts), (60, near), (61, texts[1]), (62, texts[1])], "id long, t string")
    s = Counted(spark)
    got = {(r.i, r.j): round(r.jaccard, 6) for r in overlap.near_pairs(df, "id", "t", scratch=s).collect()}
    assert got == {(0, 60): round(495 / 497, 6), (1, 61): 1.0, (1, 62): 1.0, (61, 62): 1.0}
    assert s.rows < 60 * 496 / 4


def test_near_pairs_of_a_large_family_and_large_numbers(spark, monkeypatch):
    """Against brute force, with few pairs a task, few postings at once and ids that are strings."""
    from palimpsest.operators import setjoin

    monkeypatch.setattr(setjoin, "PAIRS", 50)
    monkeypatch.setattr(setjoin, "FLUSH", 500)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(130)]
    rows = [(f"d{i}", " ".join(w if rng.random() > 0.01 else f"x{rng.integers(50)}" for w in base[: 130 - i % 60])) for i in range(40)]
    grams = {k: {" ".join(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in rows}
    heads = {k: {" ".join(t.split()[i : i + 5]) for i in range(min(100, len(t.split())) - 4)} for k, t in rows}
    want = {}
    for a, _ in rows:
        for b, _ in rows:
            for sets in (grams, heads):
                x, y = sets[a], sets[b]
                j, c = len(x & y) / len(x | y), len(x & y) / min(len(x), len(y)) if min(len(x), len(y)) >= 50 else 0.0
                if a < b and (j >= 0.8 or c >= 0.9):
                    was = want.get((a, b), (0, 0))
                    want[a, b] = (max(was[0], round(j, 9)), max(was[1], round(c, 9)))
    got = {(r.i, r.j): (round(r.jaccard, 9), round(r.containment, 9)) for r in overlap.near_pairs(spark.createDataFrame(rows, "id string, t string").repartition(1), "id", "t").collect()}
    assert got == want and len(want) > 100
