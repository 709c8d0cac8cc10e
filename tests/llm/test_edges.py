"""Nulls, empty and very long texts, ties and repeated rows, empty tables, extra columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontam, langid, media, mixing, neardup, quality, secrets, sharding, tokencount, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, label string, node string, n int, key string, h int, source_size int, plan_times int, start int, id string"
LONG = " ".join(f"w{i % 997} x{i % 31}" for i in range(120_000))


def row(i, text, lang="en", source="s"):
    return (i, text, lang, source, None, 7, "x", "y", 3, "k", 5, 9, 4, 2, "z")


ROWS = [
    row(1, "the quick brown fox jumps over the lazy dog again and again"),
    row(1, "the quick brown fox jumps over the lazy dog again and again"),
    row(2, None),
    row(3, ""),
    row(4, " \n\t "),
    row(None, "the quick brown fox jumps over the lazy dog again and again"),
    row(None, None, None, None),
    row(5, LONG, None, None),
    row(6, LONG + " end"),
    row(7, "q" * 50_000, "fr"),
    row(8, "THE quick brown fox jumps over the lazy dog again and AGAIN", "fr", "t"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "c"), (1, 0, 1, "c"), (None, 1, 1, "c"), (5, 1, None, "c"), (6, None, 1, "c"), (8, 0, 0, "c")], "doc_id long, quality int, toxic int, text string")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, "!!"), (None, "fox jumps"), (1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")


def test_near_duplicates(odd, none):
    r = neardup.near_duplicates(odd, 4).collect()
    assert len(r) == len(ROWS)
    by = {x.doc_id: x for x in r if x.doc_id is not None}
    assert by[1].component_id == by[8].component_id == 1 and by[1].kept and not by[8].kept
    assert by[5].component_id == by[6].component_id == 5
    assert by[2].n_shingles == by[3].n_shingles == by[4].n_shingles == 0
    assert [by[i].component_id for i in (2, 3, 4)] == [2, 3, 4]
    assert all(x.component_id is None and x.kept for x in r if x.doc_id is None)
    assert neardup.near_duplicates(none).count() == 0


@pytest.mark.parametrize("held", [1_000_000, 0])
def test_keep_one(odd, none, held, monkeypatch):
    monkeypatch.setattr(neardup, "HELD", held)
    r = neardup.keep_one(odd, 5)
    assert r.columns == odd.columns
    assert sorted(x.doc_id for x in r.collect() if x.doc_id is not None) == [1, 2, 3, 4, 5, 7]
    assert neardup.keep_one(none).count() == 0


def test_contained(odd, none, items):
    r = decontam.find_contained(odd, items).collect()
    assert {x.doc_id for x in r if x.item_id == 1} == {1, 8, None} and sum(x.item_id == 1 for x in r) == 8
    assert {x.doc_id for x in r if x.item_id is None} == {1, 8, None}
    left = decontam.decontaminate(odd, items)
    assert left.columns == odd.columns and sorted(x.doc_id or 0 for x in left.collect()) == [0, 2, 3, 4, 5, 6, 7]
    assert decontam.find_contained(none, items).count() == 0 == decontam.find_contained(odd, items.limit(0)).count()
    assert decontam.find_contained(odd, items, held=1).count() == len(r)


def test_mixing(odd, none):
    r = mixing.mix_sources(odd).collect()
    assert len(r) == len(ROWS) and all(x.taken <= 3 * x.size for x in r)
    assert {x.source for x in r} == {"s", "t", None}
    m = mixing.mixed(odd)
    assert m.columns == odd.columns
    words = sum(len((x.text or "").split()) for x in m.collect())
    assert words == sum(x.taken for x in r)
    assert mixing.mix_sources(none).count() == 0 == mixing.mixed(none).count()


def test_tokens(odd, none):
    r = tokencount.count_tokens(odd, block=1000).collect()
    assert sorted((x.doc_id or 0, x.n_tokens) for x in r) == sorted((x[0] or 0, len(tokencount.encode(x[1]))) for x in ROWS)
    assert tokencount.count_tokens(none).count() == 0


def test_quality(odd, none, labels):
    r = quality.resample(odd, labels)[0].collect()
    assert len(r) == len(ROWS)
    assert quality.resample(none, labels)[0].count() == 0
    assert all(x.kept for x in quality.resample(odd, labels.limit(0))[0].collect())
    for k in range(len(ROWS) + 1):  # rows 1 and 1 are of equal key: kept or left together
        got = quality.resample(odd, labels, k=k)[0].collect()
        last = sorted((x.key for x in got), reverse=True)[:k]
        assert abs(sum(x.kept for x in got) - k) <= (k > 0 and sum(x.key == last[-1] for x in got) > 1) and all(x.kept for x in got if last and x.key > last[-1])
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_toxicity(odd, none, labels):
    r = toxicity.score_toxicity(odd, labels).collect()
    assert len(r) == len(ROWS) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in r)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert all(x.score == 0 for x in toxicity.score_toxicity(odd, labels.limit(0)).collect())


def test_secrets(odd, none):
    r = secrets.secret_digest(odd).collect()
    assert len(r) == len(ROWS) and all(x.spans == "" and x.n_assign == 0 for x in r)
    assert secrets.secret_digest(none).count() == 0


def test_language(odd, none):
    r = langid.identify(odd).collect()
    assert len(r) == len(ROWS)
    assert all((x.lang_pred == "und") == (x.doc_id in (2, 3, 4) or (x.doc_id is None and x.score == 0)) for x in r)
    assert langid.identify(none).count() == 0
    assert all(x.lang_pred == "und" for x in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect())


def test_media(spark):
    schema = "vec_id long, audio binary, id int, codes string"
    rows = [(0, None, 1, "a"), (50, b"no wave", 1, "a"), (None, b"", 1, "a"), (1, media.render(__import__("numpy").zeros(2)), 1, "a")]
    got = media.align_recordings(spark.createDataFrame(rows, schema), "vec_id", "audio").collect()
    assert len(got) == len(rows) and all(r.class_id is None and r.n_links == 0 and r.query_id is None for r in got)
    tone = media.render(__import__("numpy").arange(40) % 7 / 8)
    got = media.align_recordings(spark.createDataFrame([(50, tone, 1, "a"), (50, tone, 1, "a"), (None, tone, 1, "a"), (7, tone, 1, "a")], schema), "vec_id", "audio").collect()
    assert sorted((r.id or 0, r.class_id, r.n_links, r.query_id, r.errors) for r in got) == [(0, 7, 2, 50, 0.0), (7, 7, 2, 50, 0.0), (50, 7, 1, 50, 0.0), (50, 7, 1, 50, 0.0)]
    assert media.align_recordings(spark.createDataFrame([], schema), "vec_id", "audio").count() == 0


def test_sharding(odd, none):
    r = sharding.shard_documents(odd, 3, 8).collect()
    assert len(r) == len(ROWS)
    count = [sum(x.shard == s for x in r) for s in range(3)]
    assert max(count) - min(count) <= 1
    for s in range(3):
        assert sorted(x.slot for x in r if x.shard == s) == list(range(count[s]))
    assert sharding.shard_documents(none, 3).count() == 0
