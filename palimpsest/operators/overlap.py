"""Overlap within and between corpora: exact, prefix and near-duplicate pairs, clusters, exclusions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.operators import setjoin
from palimpsest.operators.graph import connected_components
from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Similarity and shingle length of the primary and of the sensitivity tier; containment and the least set it counts for.
PRIMARY, PRIMARY_K, SENSITIVE, SENSITIVE_K, CONTAINED, LEAST_SET = 0.8, 5, 0.5, 3, 0.9, 50
#: Reasons to leave a document out of a cleaned universe, the first that holds is given.
REASONS = ("degenerate", "exact", "prefix300", "near_primary", "near_sens")
#: Rows and shingles of a block in which members of LSH buckets are verified.
BLOCK_ROWS, BLOCK_WEIGHT = 256, 200_000


def shingle_rows(df: DataFrame, doc: str, words: Column, k: int, within: str | None = None) -> DataFrame:
    """(doc, sh, n): the distinct shingles of each document as hashes, and how many it has. within: a column that goes into the
    hashes, so that documents that differ in it share nothing."""
    x = df.select(F.col(doc).alias("doc"), *([F.col(within).alias("within")] if within else []), T.shingles(words, k).alias("s"))
    own = ["within"] if within else []
    return x.select("doc", *own, F.size("s").alias("n"), F.explode("s").alias("sh")).select("doc", F.xxhash64(*own, "sh").alias("sh"), "n")


def near_pairs(df: DataFrame, doc: str, norm: str, k: int = PRIMARY_K, threshold: float = PRIMARY, scratch: Scratch | None = None, least_set: int = LEAST_SET, views: tuple[str, ...] = ("full", "head"), within: str | None = None) -> DataFrame:
    """(i, j, jaccard, containment), i < j: near-duplicates in either view (whole text, first words).

    A pair qualifies by Jaccard >= threshold, or by containment >= 0.9 if the smaller set has at least least_set shingles; it shows
    the greatest values over the views in which it qualifies, containment 0 where the smaller set is too small. within: only pairs
    that are equal in this column.
    """
    return near_tiers(df, doc, norm, ((k, threshold),), scratch, least_set, views, within)[0]


def near_tiers(df: DataFrame, doc: str, norm: str, tiers: tuple[tuple[int, float], ...], scratch: Scratch | None = None, least_set: int = LEAST_SET, views: tuple[str, ...] = ("full", "head"), within: str | None = None) -> list[DataFrame]:
    """near_pairs for each (k, threshold), over texts that are normalised and written once."""
    s = scratch or Scratch(df.sparkSession)
    texts = setjoin.numbered(df, doc, norm, within, s)
    heads = tuple(0 if view == "full" else T.HEAD_WORDS for view in views)
    return [setjoin.similar(texts, s, k, threshold, CONTAINED, least_set, heads) for k, threshold in tiers]


def clusters(nodes: DataFrame, pairs: DataFrame, doc: str, scratch: Scratch | None = None) -> DataFrame:
    """nodes with cluster: the smallest document that pairs lead to."""
    comp = connected_components(pairs, "i", "j", scratch)
    return nodes.join(comp.select(F.col("node").alias(doc), "component"), doc, "left").withColumn("cluster", F.coalesce("component", doc)).drop("component")


def clusters_within(nodes: DataFrame, doc: str, norm: str, dataset: str, scratch: Scratch | None = None) -> DataFrame:
    """nodes with cluster, as near-duplicates of the same dataset lead: clusters never cross datasets."""
    return clusters(nodes, near_pairs(nodes, doc, norm, within=dataset, scratch=scratch), doc, scratch)


def borderline(df: DataFrame, doc: str, norm: str, scratch: Scratch | None = None) -> DataFrame:
    """(i, j, jaccard, containment, tier): pairs to look at: those of the sensitivity tier alone, and primary ones (by containment) whose
    Jaccard lies up to 0.05 below the threshold."""
    s = scratch or Scratch(df.sparkSession)
    primary, wide = near_tiers(df, doc, norm, ((PRIMARY_K, PRIMARY), (SENSITIVE_K, SENSITIVE)), s)
    primary = s.keep(primary, "primary")
    wide = wide.join(primary, ["i", "j"], "left_anti").withColumn("tier", F.lit("sensitivity"))
    return wide.unionByName(primary.where((F.col("jaccard") >= PRIMARY - 0.05) & (F.col("jaccard") < PRIMARY)).withColumn("tier", F.lit("primary")))


def exact_overlap(df: DataFrame, hashes: tuple[str, ...], doc: str = "doc_id", label: str = "is_fake", dataset: str = "dataset") -> DataFrame:
    """(pair, evidence, pairs, docs_a, docs_b, conflicts) of equal hashes between datasets.

    Counted from hash x dataset totals: a hash that thousands share is a product of counts, never thousands squared rows. Null
    hashes match nothing.
    """
    tall = df.select(dataset, label, F.explode(F.map_from_arrays(F.array(*map(F.lit, hashes)), F.array(*hashes))).alias("evidence", "h")).where("h is not null")
    by = tall.groupBy("evidence", "h", F.col(dataset).alias("d")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("fake"))
    a, b = (by.select("evidence", "h", *(F.col(c).alias(c + x) for c in ("d", "n", "fake"))) for x in "ab")
    p = a.join(b, ["evidence", "h"]).where("da < db")
    conflict = F.col("fakea") * (F.col("nb") - F.col("fakeb")) + F.col("fakeb") * (F.col("na") - F.col("fakea"))
    return p.groupBy(F.concat_ws("~", "da", "db").alias("pair"), "evidence").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.sum("na").alias("docs_a"), F.sum("nb").alias("docs_b"), F.sum(conflict).alias("conflicts"))


def flags(df: DataFrame, hashes: dict[str, str], trim: str, doc: str = "doc_id", dataset: str = "dataset") -> DataFrame:
    """(doc, evidence): documents of the trim dataset of which another dataset has the same hash."""
    out = []
    for col, name in hashes.items():
        others = df.where((F.col(dataset) != trim) & F.col(col).isNotNull()).select(col).distinct()
        out.append(df.where(F.col(dataset) == trim).join(others, col, "left_semi").select(doc, F.lit(name).alias("evidence")))
    return reduce(DataFrame.unionByName, out)


def closure(docs: DataFrame, doc: str, links: DataFrame, reasons: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc, reasons): every document that links lead to from one with a reason, with all reasons of its component."""
    comp = connected_components(links, "i", "j", scratch)
    all_docs = docs.select(F.col(doc).alias("node")).join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    why = all_docs.join(reasons.select(F.col(doc).alias("node"), "reason"), "node").groupBy("component").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))
    return all_docs.join(why, "component").select(F.col("node").alias(doc), "reasons")


def first_reason(candidates: DataFrame, doc: str, reason: str, priority: dict[str, int]) -> DataFrame:
    """One reason for each document: the first in order of priority."""
    rank = F.create_map(*(F.lit(x) for kv in priority.items() for x in kv))[F.col(reason)]
    return candidates.groupBy(doc).agg(F.min_by(reason, rank).alias("reason"))


def drop_flagged(df: DataFrame, doc: str, norm: str, dataset: str, least_words: int = 20, prefix: int = 300, scratch: Scratch | None = None) -> DataFrame:
    """(doc, reason): documents to leave out so that no two datasets overlap, with the first reason in order of REASONS.

    A text of fewer words is degenerate. Of two documents of different datasets that are equal, begin alike or are
    near-duplicates in either tier, the one of the larger dataset goes, of equally large ones the one of the smaller id. Equal texts
    are judged by their group's datasets (one entry for each), never by pairs. A null text is degenerate; a row without a
    dataset meets no other.
    """
    s = scratch or Scratch(df.sparkSession)
    sizes = df.groupBy(F.col(dataset).alias("ds")).agg(F.count("*").alias("size"))
    x = df.select(F.col(doc).alias("doc"), F.col(dataset).alias("ds"), F.col(norm).alias("ns")).join(sizes, "ds", "left")
    x = s.keep(x.select("doc", "ds", "size", "ns"), "sized")
    found = [x.where(F.coalesce(F.size(T.words("ns")), F.lit(0)) < least_words).select("doc", F.lit("degenerate").alias("reason"))]

    x = x.where("ds is not null")
    keys = F.array(*(F.struct(F.lit(r).alias("reason"), F.when(ok, F.md5(of)).alias("h")) for r, ok, of in (("exact", F.col("ns") != "", F.col("ns")), ("prefix300", F.length("ns") >= prefix, F.substring("ns", 1, prefix)))))
    tall = x.select("doc", "ds", "size", F.inline(keys)).where("h is not null")
    groups = tall.groupBy("reason", "h", "ds", "size").agg(F.max("doc").alias("last")).groupBy("reason", "h").agg(F.collect_list(F.struct("ds", "size", "last")).alias("m")).where("size(m) > 1")
    goes = F.exists("m", lambda m: (m["ds"] != F.col("ds")) & ((m["size"] < F.col("size")) | ((m["size"] == F.col("size")) & (m["last"] > F.col("doc")))))
    found.append(tall.join(groups, ["reason", "h"]).where(goes).select("doc", "reason"))

    side = [x.select(F.col("doc").alias(c), F.col("ds").alias(f"d{c}"), F.col("size").alias(f"s{c}")) for c in "ij"]
    tiers = near_tiers(x, "doc", "ns", ((PRIMARY_K, PRIMARY), (SENSITIVE_K, SENSITIVE)), s)
    for reason, pairs in zip(("near_primary", "near_sens"), tiers, strict=True):
        p = pairs.select("i", "j").join(side[0], "i").join(side[1], "j").where("di <> dj")
        found.append(p.select(F.when(F.col("si") >= F.col("sj"), F.col("i")).otherwise(F.col("j")).alias("doc"), F.lit(reason).alias("reason")))
    every = reduce(DataFrame.unionByName, found)
    return first_reason(every, "doc", "reason", {r: n for n, r in enumerate(REASONS)}).withColumnRenamed("doc", doc)


def contamination(corpus: DataFrame, doc: str, norm: str, targets: DataFrame, target: str, target_norm: str, k: int = PRIMARY_K, threshold: float = PRIMARY, least_set: int = LEAST_SET, small: int = 2_000_000) -> DataFrame:
    """(target, doc, jaccard, containment): an exhaustive match of few targets against a large corpus by posting lists.

    The targets' postings are broadcast only if they are counted to be few; else the same join shuffles by shingle.
    """
    post = shingle_rows(targets, target, T.words(target_norm), k).select(F.col("doc").alias("t"), "sh", F.col("n").alias("nt"))
    few = post.limit(small + 1).count() <= small
    hit = shingle_rows(corpus, doc, T.words(norm), k).join(F.broadcast(post) if few else post, "sh")
    p = hit.groupBy("t", "doc", "n", "nt").agg(F.count("*").alias("both"))
    low = F.least("n", "nt")
    c = F.when(low >= least_set, F.col("both") / low).otherwise(F.lit(0.0))
    return p.select(F.col("t").alias(target), F.col("doc").alias(doc), (F.col("both") / (F.col("n") + F.col("nt") - F.col("both"))).alias("jaccard"), c.alias("containment")).where((F.col("jaccard") >= threshold) | (F.col("containment") >= CONTAINED))


def evidence(corpus: DataFrame, doc: str, targets: DataFrame, target: str, fields: dict[str, tuple[str, str]], prefix: int = 300, least_set: int = LEAST_SET, small: int = 2_000_000) -> DataFrame:
    """(target, doc, field, method, jaccard, containment): every kind of evidence that a document holds a target.

    fields: of each field the corpus's column and the targets'. Methods are equal texts after either normalisation, equal beginnings, and
    both near-duplicate tiers over whole texts and over first words; equality shows 1 and 1. All tiers, views and fields of a document meet
    the targets' postings in one join, as field and method go into the shingles' hashes; the postings are broadcast only if
    counted to be few. A null or blank text meets nothing.
    """
    tiers = {"primary": (PRIMARY_K, PRIMARY), "sensitivity": (SENSITIVE_K, SENSITIVE)}

    def normed(df: DataFrame, key: str, side: int) -> DataFrame:
        texts = F.array(*(F.struct(F.lit(f).alias("field"), F.col(c[side]).alias("text")) for f, c in fields.items()))
        return df.select(F.col(key).alias("id"), F.inline(texts)).select("id", "field", T.norm_light("text").alias("light"), T.norm_strip("text").alias("strip"))

    def equal(x: DataFrame) -> DataFrame:
        kinds = (("exact_light", F.col("light") != "", F.col("light")), ("exact_strip", F.col("strip") != "", F.col("strip")), (f"prefix{prefix}", F.length("strip") >= prefix, F.substring("strip", 1, prefix)))
        return x.select("id", "field", F.inline(F.array(*(F.struct(F.lit(m).alias("method"), F.when(ok, F.md5(of)).alias("h")) for m, ok, of in kinds)))).where("h is not null")

    def posts(x: DataFrame) -> DataFrame:
        cuts = {"full": F.col("w"), f"head{T.HEAD_WORDS}": F.slice("w", 1, T.HEAD_WORDS)}
        sets = F.array(*(F.struct(F.lit(f"{tier}_{view}").alias("method"), T.shingles(w, k).alias("s")) for tier, (k, _) in tiers.items() for view, w in cuts.items()))
        x = x.where("strip is not null").select("id", "field", T.words("strip").alias("w")).select("id", "field", F.inline(sets))
        return x.select("id", "field", "method", F.size("s").alias("n"), F.explode("s").alias("sh")).withColumn("sh", F.xxhash64("field", "method", "sh"))

    ours, theirs = normed(corpus, doc, 0), normed(targets, target, 1)
    one = F.lit(1.0)
    same = equal(ours).join(equal(theirs).withColumnRenamed("id", "t"), ["field", "method", "h"]).select("t", "id", "field", "method", one.alias("jaccard"), one.alias("containment"))
    post = posts(theirs).select(F.col("id").alias("t"), "sh", F.col("n").alias("nt"))
    few = post.limit(small + 1).count() <= small
    p = posts(ours).join(F.broadcast(post) if few else post, "sh").groupBy("t", "id", "field", "method", "n", "nt").agg(F.count("*").alias("both"))
    low = F.least("n", "nt")
    p = p.withColumn("jaccard", F.col("both") / (F.col("n") + F.col("nt") - F.col("both"))).withColumn("containment", F.col("both") / low)
    least = F.when(F.startswith("method", F.lit("primary")), F.lit(PRIMARY)).otherwise(F.lit(SENSITIVE))
    near = p.where((F.col("jaccard") >= least) | ((F.col("containment") >= CONTAINED) & (low >= least_set))).select("t", "id", "field", "method", "jaccard", "containment")
    return same.unionByName(near).withColumnsRenamed({"t": target, "id": doc})


def minhash(df: DataFrame, doc: str, norm: str, k: int = PRIMARY_K, perms: int = 128) -> DataFrame:
    """(doc, signature): for each of ``perms`` seeds the least hash of the document's shingles; null without shingles."""
    x = df.select(F.col(doc).alias("doc"), F.transform(T.shingles(T.words(norm), k), lambda s: F.xxhash64(s)).alias("s"))
    sig = F.transform(F.sequence(F.lit(1), F.lit(perms)), lambda p: F.array_min(F.transform("s", lambda h: F.xxhash64(p, h))))
    return x.select(F.col("doc").alias(doc), F.when(F.size("s") > 0, sig).alias("signature"))


def _blocks(members: DataFrame) -> DataFrame:
    """(gid, key, sub, one, other, node) of members (key, node, n): bounded groups of which one holds any two members of a bucket.

    Small buckets are packed together; a large one is cut into blocks, and any two blocks, and each by itself, make a group.
    """
    by = members.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("n") / F.lit(BLOCK_WEIGHT))).cast("long").alias("nb"), F.sum("n").alias("w"))
    packs = max(1, -(-(by.where("nb = 1").agg(F.sum("w")).first()[0] or 0) // BLOCK_WEIGHT))
    m = members.join(by.select("key", "nb"), "key").withColumn("sub", F.pmod(F.xxhash64("node"), F.col("nb")))
    zero = F.lit(0).cast("long")
    little = m.where("nb = 1").select(F.pmod(F.xxhash64("key"), F.lit(packs)).alias("gid"), "key", "sub", zero.alias("one"), zero.alias("other"), "node")
    side = F.explode(F.sequence(zero, F.col("nb") - 1)).alias("with")
    large = m.where("nb > 1").select("key", "sub", "node", side).withColumn("one", F.least("sub", "with")).withColumn("other", F.greatest("sub", "with"))
    return little.unionByName(large.select(F.xxhash64("key", "one", "other").alias("gid"), "key", "sub", "one", "other", "node"))


def _intersections(value: np.ndarray, doc: np.ndarray, docs: int, wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets given as (element, document), by products of 0/1 blocks of columns."""
    _, col, count = np.unique(value, return_inverse=True, return_counts=True)
    shared = count[col] > 1
    col, doc = (np.cumsum(count > 1) - 1)[col[shared]], doc[shared]
    order = np.argsort(col, kind="stable")
    col, doc = col[order], doc[order]
    out = np.zeros((docs, docs))
    for lo in range(0, int(col.max(initial=-1)) + 1, wide):
        i, j = np.searchsorted(col, [lo, lo + wide])
        x = np.zeros((docs, wide), np.float32)
        x[doc[i:j], col[i:j] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _band_keys(bands: int, rows: int):
    """Adds keys: a hash of each band of the MinHash values, which are least values of multiply-add hashes."""
    rng = np.random.default_rng(20)
    mul, add = (rng.integers(0, 1 << 63, bands * rows, np.uint64) for _ in "ab")
    mul, mix = mul | np.uint64(1), np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros((batch.num_rows, bands), np.uint64)
            for i, x in enumerate(batch.column(1)):
                h = x.values.to_numpy(zero_copy_only=False).view(np.uint64)
                least = np.array([((h * m + a) >> np.uint64(32)).min() for m, a in zip(mul, add, strict=True)]).reshape(bands, rows)
                key = np.arange(1, bands + 1, dtype=np.uint64)
                for r in range(rows):
                    key = (key ^ least[:, r]) * mix
                    key ^= key >> np.uint64(29)
                keys[i] = key
            flat = pa.array(keys.reshape(-1).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * bands), flat)], ["node", "s", "keys"])

    return run


def _verify(threshold: float, least_set: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, one, other, sub, node, band = (table.column(c).to_numpy() for c in ("key", "one", "other", "sub", "node", "band"))
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        sets = [np.array(x.values.to_numpy(zero_copy_only=False)) for x in table.column("s")]
        size = np.array([len(x) for x in sets])
        order = np.lexsort((node, key, other, one))
        cut = np.flatnonzero((np.diff(key[order]) != 0) | (np.diff(one[order]) != 0) | (np.diff(other[order]) != 0)) + 1
        got = []
        for part in np.split(order, cut):
            i, j = np.triu_indices(len(part), 1)
            x, y = part[i], part[j]
            ok = (one[x] == other[x]) | (sub[x] != sub[y])  # two of one block meet in the group of that block alone
            ok &= np.minimum(size[x], size[y]) >= np.minimum(threshold * np.maximum(size[x], size[y]), least_set)
            for b in range(int(band[part[0]])):  # a pair is judged in the first band that it shares
                ok &= keys[x, b] != keys[y, b]
            x, y, i, j = x[ok], y[ok], i[ok], j[ok]
            if not len(x):
                continue
            if len(part) <= 4:
                both = np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(x, y, strict=True)])
            else:
                both = _intersections(np.concatenate([sets[p] for p in part]), np.repeat(np.arange(len(part)), size[part]), len(part))[i, j]
            low = np.minimum(size[x], size[y])
            jaccard = both / (size[x] + size[y] - both)
            containment = np.where(low >= least_set, both / low, 0.0)
            ok = (jaccard >= threshold) | (containment >= CONTAINED)
            got.append((node[x[ok]], node[y[ok]], jaccard[ok], containment[ok]))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)] if got else [[], [], [], []]
        return pa.table([pa.array(c, kind) for c, kind in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["a", "b", "jaccard", "containment"])

    return run


def lsh_pairs(df: DataFrame, doc: str, norm: str, k: int = PRIMARY_K, threshold: float = PRIMARY, bands: int = 32, rows: int = 4, least_set: int = LEAST_SET, views: tuple[str, ...] = ("full", "head"), scratch: Scratch | None = None) -> DataFrame:
    """(i, j, jaccard, containment), i < j: as near_pairs, of the pairs that share a band of MinHash values in a view.

    Documents with equal sets are one class, represented by the smallest. All pairs of different classes in a bucket, whatever
    its size, are verified by their full sets in bounded blocks, each in the first band it shares; then pairs of classes become pairs
    of documents, among them all pairs within a class. Ids are whole numbers; rows with a null id take part in nothing.
    """
    s = scratch or Scratch(df.sparkSession)
    ship(df.sparkSession)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = []
    for view in views:
        w = T.words(norm) if view == "full" else F.slice(T.words(norm), 1, T.HEAD_WORDS)
        x = df.where(F.col(doc).isNotNull()).select(F.col(doc).cast("long").alias("doc"), T.shingles(w, k).alias("g")).where("size(g) > 0")
        x = x.select("doc", F.array_sort(F.array_distinct(F.transform("g", lambda g: F.xxhash64(g)))).alias("s"))
        sets = s.keep(x, "sets").select("doc", "s", F.xxhash64("s").alias("d1"), F.xxhash64(F.lit(7), "s").alias("d2"))
        member = s.keep(sets.groupBy("d1", "d2").agg(F.min("doc").alias("class")).join(sets.select("doc", "d1", "d2", F.size("s").alias("n")), ["d1", "d2"]).select("class", "doc", "n"), "classes")
        lead = sets.join(member.where("class = doc").select("doc").distinct(), "doc", "left_semi").dropDuplicates(["doc"])
        node = s.keep(lead.select(F.col("doc").alias("node"), "s").mapInArrow(_band_keys(bands, rows), "node long, s array<long>, keys array<long>"), "signatures")

        member_of = node.select("node", F.size("s").alias("n"), F.posexplode("keys").alias("band", "key"))
        total = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
        bucket = member_of.groupBy("band", "key").agg(F.count("*").alias("c"), F.min("node").alias("lo"), F.max("node").alias("hi"), total.alias("t")).where("c > 1")
        # Of buckets with the same members the first is enough: two members that first meet in one meet in no earlier one.
        bucket = bucket.groupBy("c", "lo", "hi", "t").agg(F.min(F.struct("band", "key")).alias("first")).select("first.*")
        held = s.keep(member_of.join(bucket, ["band", "key"]), "buckets")
        grouped = _blocks(held.select("key", "node", F.col("n").cast("long").alias("n"))).join(held.select("key", "band").distinct(), "key").join(node, "node")
        pair = grouped.repartition(spread, "gid").groupBy("gid").applyInArrow(_verify(threshold, least_set), "a long, b long, jaccard double, containment double")
        pair = s.keep(pair, "pairs")

        a, b = (member.select(F.col("class").alias(c), F.col("doc").alias(to), F.col("n").alias(f"n{c}")) for c, to in (("a", "x"), ("b", "y")))
        apart = pair.join(a.drop("na"), "a").join(b.drop("nb"), "b").select(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "jaccard", "containment")
        copies = a.join(b, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias("i"), F.col("y").alias("j"), F.lit(1.0).alias("jaccard"), F.when(F.col("na") >= least_set, 1.0).otherwise(0.0).alias("containment"))
        found += [apart.where("i < j"), copies]
    return reduce(DataFrame.unionByName, found).groupBy("i", "j").agg(F.max("jaccard").alias("jaccard"), F.max("containment").alias("containment"))
