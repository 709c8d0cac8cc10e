"""The corpus pipeline, stage by stage, against brute force; on an empty table; and as a whole."""

import hashlib
import random
import zlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

from test_against_brute_force import by_hand, components, low, sets  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    rng = random.Random(12)
    good = [f"word{i}" for i in range(80)]
    bad = ["BUY", "now", "$$$", "Click", "12345", "!!", "FREE"]
    item = " ".join(rng.choice(good) for _ in range(14))
    texts = []
    for i in range(150):
        w = [rng.choice(bad if i % 5 == 0 else good) for _ in range(rng.randrange(12, 90))]
        if i % 11 == 1:
            w[3:3] = item.split()
        texts.append(" ".join(w))
        if i % 7 == 2:
            texts.append(texts[-1].upper())
        if i % 13 == 3 and len(w) > 60:
            texts.append(" ".join([*w[:-1], "changed"]))
    texts += ["", None]
    docs = [(i * 3 % 401, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    labels = [(d[0], 0 if (d[1] or "").lower().count("free") + (d[1] or "").count("$$$") > 2 else 1, 0) for d in docs[::2]]
    return docs, labels, [(1, item), (2, "never to be found in here at all"), (3, None)]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("sf"))
    docs, labels, items = make()
    for name, rows, schema in (("documents", docs, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{top}/{name}.parquet")
    return top, docs, labels, items


def stage(spark, i, rows, top):
    return pipeline.STAGES[i][1](spark, spark.createDataFrame(rows, SCHEMA).repartition(3), top)


def ids(rows):
    return sorted(r[0] for r in rows)


def test_quality(spark, world):
    top, docs, labels, _ = world
    out = stage(spark, 0, docs, top)
    assert out.columns == COLUMNS
    share = sum(y for _, y, _ in labels) / len(labels)
    k = round(len(docs) * min(1, share + 2 * (share * (1 - share) / len(labels)) ** 0.5))
    keys = [key for _, key in by_hand([d[:2] for d in docs], {i: y for i, y, _ in labels})]
    best = sorted(range(len(docs)), key=lambda i: -keys[i])[:k]
    assert ids(out.collect()) == sorted(docs[i][0] for i in best) and 0 < k < len(docs)


def test_near_duplicates(spark, world):
    top, docs, *_ = world
    out = stage(spark, 1, docs, top)
    of = components({d[0]: sets(d[1], 5) for d in docs})
    assert out.columns == COLUMNS and ids(out.collect()) == sorted(i for i, c in of.items() if i == c) and len(set(of.values())) < len(of)


def test_decontamination(spark, world):
    top, docs, _, items = world
    out = stage(spark, 2, docs, top)

    def holds(text):
        own = sets(low(text or ""), 5)
        return any(q and len(sets(q, 5) & own) >= 0.8 * len(sets(q, 5)) for _, q in items)

    want = sorted(d[0] for d in docs if not holds(d[1]))
    assert out.columns == COLUMNS and ids(out.collect()) == want and len(want) < len(docs)


def test_mixing(spark, world):
    top, docs, *_ = world
    out = stage(spark, 3, docs, top)
    size = {d[0]: len((d[1] or "").split()) for d in docs}
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append(d)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, s or "")))}
    whole = {s: sum(size[d[0]] for d in rows) for s, rows in by.items()}
    target, free, left = {}, set(by), sum(whole.values())
    while free:  # sources beyond three times their size are full; the others share the rest
        full = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > 3 * whole[s]]
        target |= {s: 3 * whole[s] for s in full} or {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        free = free - set(full) if full else set()
        left -= sum(3 * whole[s] for s in full)
    want = []
    for s, rows in by.items():
        copies = int(min(3, target[s] // whole[s]))
        budget, total, best = target[s] - copies * whole[s], 0, 0
        rows = sorted(rows, key=lambda d: hashlib.md5(f"{d[0]}:{hashlib.md5((d[1] or '').encode()).hexdigest()}".encode()).hexdigest()[:15])
        for i, d in enumerate(rows):
            total += size[d[0]]
            if total <= budget or total - budget < budget - (total - size[d[0]]) and total - size[d[0]] <= budget:
                best = i + 1
        for i, d in enumerate(rows):
            want += [d[0]] * (copies + (i < best) if size[d[0]] else 1)
    assert out.columns == COLUMNS and ids(out.collect()) == sorted(want)


def test_sharding(spark, world):
    top, docs, *_ = world
    out = stage(spark, 4, docs, top).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in out) == sorted((d[0], len((d[1] or "").encode()) + 1, zlib.crc32((d[1] or "").encode())) for d in docs)
    count = [sum(r.shard == s for r in out) for s in range(16)]
    assert max(count) - min(count) <= 1 and all(sorted(r.slot for r in out if r.shard == s) == list(range(count[s])) for s in range(16))


def test_empty_tables(spark, world):
    rows = []
    for i in range(5):
        assert stage(spark, i, rows, world[0]).count() == 0


def test_the_whole_is_its_stages(spark, world):
    top, docs, *_ = world
    for i in range(4):
        docs = [tuple(r) for r in stage(spark, i, docs, top).collect()]
    want = sorted((r.doc_id, r.size, r.text_crc32) for r in stage(spark, 4, docs, top).collect())
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in pipeline.run(spark, top).collect()) == want and 0 < len(want)
