"""Quality by importance resampling: hashed n-gram generative models of target and raw text, sampled by Gumbel top-k.

Two bags of hashed n-grams are counted: the raw one over all documents, the target one over those labelled good.
N-grams are runs of one and two words, and of one to three word shapes (lower, Capitalised, UPPER, digits, the very
characters of punctuation, and whether a word repeats one of the two before it); each kind has buckets of its own. A
document's log weight is the sum of log(target / raw) over its n-grams. Weight plus Gumbel noise, drawn from a hash of the id,
is the key; the k largest keys are a sample without replacement in proportion to the weights. The k-th key is
found by nested histograms (mixing.thresholds), not by sorting.

k is given; by default it is the target's size: the share of good ones among the labelled, of all documents, at the upper end of its 95 %
interval, as a lost good document is worse than a kept bad one. No label has a say in which documents the k are, but through the counts.

Target counts come from at most MOST_GOOD good rows, taken by a hash of the id; raw counts always cover all documents.

Defined results: a null or blank text has log weight 0 and no n-gram, and its key is noise alone; a null id draws its noise from the text;
documents labelled more than once count as good only if every label says so; without a good label all weights are 0
and, if k isn't given, all documents are kept; rows of equal key (equal id and weight) are kept or left together, whichever comes
nearer to k; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import mixing
from palimpsest.llm import textops as T
from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Buckets of word n-grams and of shape n-grams.
WORD_BITS, SHAPE_BITS = 16, 14
BUCKETS = (1 << WORD_BITS) + (1 << SHAPE_BITS)
#: Good labelled rows that the target is counted from, in the mean: what is broadcast is bounded by it.
MOST_GOOD = 200_000

_SPACE, _WORD, _SIGN = 0, 1, 2
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[32, *range(9, 14)]] = _SPACE
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = _WORD
_UPPER, _LOWER, _DIGIT = (np.zeros(256, bool) for _ in range(3))
_UPPER[65:91] = _LOWER[97:123] = _LOWER[128:] = _DIGIT[48:58] = True
_KEEP = T._KEEP


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word hash, shape, document) of every run of word characters and every run of signs."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _CLASS[data]
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = off[1:-1]
    new[inner[inner < n]] = True
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    kind = kind[start]
    use = kind != _SPACE
    start, size, kind = start[use], size[use], kind[use]
    doc = np.searchsorted(off, start, "right") - 1
    eight = np.ndarray((n + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    h = size.astype(np.uint64) * T._GOLD
    live = np.arange(len(start))
    for i in range(0, min(T.LONG_WORD, int(size.max(initial=0))), 8):
        live = live[size[live] > i]
        h[live] = ((h[live] ^ (h[live] >> T.U(29))) ^ (eight[start[live] + i] & _KEEP[np.minimum(size[live] - i, 8)])) * T._STEP
    h = T.mix(h)
    up = np.concatenate([[0], np.cumsum(_UPPER[data])])
    low = np.concatenate([[0], np.cumsum(_LOWER[data])])
    dig = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    end = start + size
    ups, lows, digs = up[end] - up[start], low[end] - low[start], dig[end] - dig[start]
    first = _UPPER[data[start]]
    shape = np.select([digs > 0, (ups > 1) & (lows == 0), first & (ups <= 1), ups > 0], [1, 2, 3, 4], 5).astype(np.uint64)
    sign = kind == _SIGN
    shape[sign] = (h[sign] & T.U(0xFFFFFFFF)) | T.U(1 << 40)
    for back in (1, 2):
        again = np.zeros(len(h), bool)
        again[back:] = (h[back:] == h[:-back]) & (doc[back:] == doc[:-back])
        shape[again & ~sign] |= T.U(1 << (40 + back))
    return h, shape, doc


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, document) of every n-gram."""
    h, shape, doc = tokens(data, off)
    out, at = [], []
    for seq, most, bits, base in ((h, 2, WORD_BITS, 0), (shape, 3, SHAPE_BITS, 1 << WORD_BITS)):
        for width in range(1, most + 1):
            if len(seq) < width:
                break
            m = len(seq) - width + 1
            g = np.full(m, width, np.uint64)
            for i in range(width):
                g = T.mix(g ^ seq[i : m + i])
            same = doc[:m] == doc[width - 1 :]
            out.append(((g >> T.U(64 - bits)).astype(np.int64) + base)[same])
            at.append(doc[:m][same])
    return (np.concatenate(out), np.concatenate(at)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        label = np.asarray(batch.column(1).fill_null(0))
        for i, data, off in T.pieces(batch.column(0)):
            bucket, doc = grams(data, off)
            raw += np.bincount(bucket, minlength=BUCKETS)
            good += np.bincount(bucket[label[i + doc] == 1], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(good[some])], ["bucket", "raw", "good"])


#: Counts added to both sides of a bucket's ratio, for words and for shapes: a document's own n-grams must not outweigh the corpus.
SMOOTH = (400.0, 20.0)


def log_ratios(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """log(target / raw) by bucket, each kind of n-gram a distribution of its own; small counts are drawn to 0."""
    out = np.zeros(BUCKETS)
    if not good.sum():
        return out
    for part, add in zip((slice(0, 1 << WORD_BITS), slice(1 << WORD_BITS, BUCKETS)), SMOOTH, strict=True):
        expected = raw[part] * (good[part].sum() / max(1, raw[part].sum()))
        out[part] = np.log(good[part] + add) - np.log(expected + add)
    return np.clip(out, -6, 6)


def weights(data: np.ndarray, off: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    bucket, doc = grams(data, off)
    return np.bincount(doc, weights=ratio[bucket], minlength=len(off) - 1)


def noise(ids: pa.Array, texts: pa.Array, seed: int) -> np.ndarray:
    """Standard Gumbel values from hashes of the ids (of the text for a null id)."""
    import xxhash

    key = [xxhash.xxh64_intdigest(str(i) if i is not None else f"null:{t}", seed) for i, t in zip(ids.to_pylist(), (t.as_py() if i is None else None for i, t in zip(ids.to_pylist(), texts, strict=True)), strict=True)]
    u = ((np.array(key, np.uint64) >> T.U(11)).astype(float) + 0.5) * 2.0**-53
    return -np.log(-np.log(u))


def agreed(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """One row for each labelled id: 1 only if every label is 1."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label"))


def target_rows(labels: DataFrame, good: int) -> DataFrame:
    """The good ones of labels, of which there are ``good``, or about MOST_GOOD of them by a hash of the id."""
    rows = labels.where("label = 1").select("label_id", "label")
    return rows if good <= MOST_GOOD else rows.where(F.pmod(F.xxhash64(F.col("label_id").cast("string"), F.lit("target")), F.lit(1 << 30)) < int(MOST_GOOD / good * (1 << 30)))


def target_share(good: int, labelled: int) -> float:
    """The upper end of the 95 % interval of the share of good documents."""
    p = good / labelled
    return min(1.0, p + 2 * (p * (1 - p) / labelled) ** 0.5)


def fit(docs: DataFrame, target: DataFrame) -> np.ndarray:
    """The log ratios, from counts over all documents and over those in target, which is bounded (see target_rows) and so broadcast."""
    marked = docs.select("doc_id", "text").join(F.broadcast(target), F.col("doc_id") == F.col("label_id"), "left")
    counts = marked.select("text", "label").mapInArrow(_count, "bucket int, raw long, good long")
    raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect():  # BUCKETS rows at most
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    return log_ratios(raw, good)


def _keyed(ratio, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ratio.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, data, off in T.pieces(batch.column(1)):
                z[i : i + len(off) - 1] = weights(data, off, table)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z), pa.array(z + noise(batch.column(0), batch.column(1), seed))], ["doc_id", "log_weight", "key"])

    return run


def code(key):
    """A 60-bit integer that falls as the key rises."""
    return F.floor((1e6 - F.greatest(F.lit(-9e5), F.least(F.lit(9e5), F.col(key)))) * float(1 << 38)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", scratch: Scratch | None = None) -> tuple[DataFrame, object, int | None]:
    """(doc_id, log_weight, key, kept) for every row, the broadcast log ratios, and the largest kept code (None: all)."""
    spark = docs.sparkSession
    ship(spark)
    s = scratch or Scratch(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lab = s.keep(agreed(labels, label_id, label_col), "labels")
    held = lab.agg(F.count("*").alias("all"), F.count_if(F.col("label") == 1).alias("good")).first()
    ratio = spark.sparkContext.broadcast(fit(src, target_rows(lab, held["good"])))
    kind = dict(src.dtypes)["doc_id"]
    keyed = s.keep(src.mapInArrow(_keyed(ratio, seed), f"doc_id {kind}, log_weight double, key double").withColumn("code", code("key")), "keys")
    if k is None:
        k = keyed.count()
        k = round(k * target_share(held["good"], held["all"])) if held["good"] else k
    base = keyed.select(F.lit("all").alias("source"), F.lit(1).cast("long").alias("size"), F.col("code").alias("h"))
    budget = spark.createDataFrame([("all", 1.0, float(k))], "source string, name double, budget double")
    top = mixing.thresholds(base, budget, s).first()["cut"]
    return keyed.withColumn("kept", F.col("code") <= F.lit(top)).drop("code"), ratio, top


def keep_good(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, that the resampling keeps; the key is computed again in the filter's own pass."""
    _, ratio, top = resample(docs, labels, k, seed, id_col, text_col, scratch=scratch)
    where = [docs.columns.index(id_col), docs.columns.index(text_col)]

    def run(batches):
        table = ratio.value
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, data, off in T.pieces(batch.column(where[1])):
                z[i : i + len(off) - 1] = weights(data, off, table)
            key = z + noise(batch.column(where[0]), batch.column(where[1]), seed)
            code = np.floor((1e6 - np.clip(key, -9e5, 9e5)) * float(1 << 38)).astype(np.int64)
            yield batch.filter(pa.array(code <= top))

    return docs.mapInArrow(run, docs.schema)
