"""Language identification by error-correcting output codes.

Every language has a codeword of bits; for each bit a binary n-gram classifier (logistic, over hashed two- and
three-byte strings of the text in lower case) learns to tell the languages whose bit is 1 from the others. A text is decoded to the language
whose codeword costs least, where a bit costs the logistic loss of its classifier, weighted by how well
that classifier did on rows of its own that it was not fitted on. A small lead of the best codeword over the next marks the answer as ambiguous.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is any text where nothing could be
learned (no labelled rows); with one language learned it is the answer for every text with a letter. Repeated rows get
equal answers; a null id is held out of learning.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import textops as T
from palimpsest.plans.ship import ship

#: Buckets of hashed n-grams.
BITS = 12
BUCKETS = 1 << BITS
#: The bounded sample that the classifiers are fitted on: rows of each language, rows and characters in all.
ROWS_PER_LANG, SAMPLE_ROWS, SAMPLE_CHARS = 1500, 200_000, 12_000_000
#: Languages up to which their counts are broadcast; more are joined by a shuffle.
LANGS = 100_000
#: Texts and bytes whose n-grams are counted at once.
PIECE_ROWS, PIECE_BYTES = 500, 1 << 20
#: Below this lead in weighted loss an answer is ambiguous.
AMBIGUOUS = 0.15
_WORDLIKE = re.compile(r"[^\W\d_]+")


def has_letter(text: str | None) -> bool:
    """Whether a character of the text is a letter; number characters such as a raised two are none."""
    return any(c.isalpha() for m in _WORDLIKE.finditer(text or "") for c in m.group())


def codebook(langs: int, seed: int = 11) -> np.ndarray:
    """Codewords (langs x bits): all splits for few languages, else the random code of the widest least distance."""
    if langs <= 1:
        return np.ones((langs, 1), np.int8)
    if langs <= 6:
        bits = (1 << (langs - 1)) - 1
        return np.array([[1] * bits] + [[(b + 1) >> i & 1 for b in range(bits)] for i in range(langs - 1)], np.int8)
    rng = np.random.default_rng(seed)
    best, wide = None, -1
    for _ in range(200):
        c = rng.integers(0, 2, (langs, int(np.ceil(12 * np.log2(langs)))), np.int8)
        c = c[:, (c.sum(axis=0) > 0) & (c.sum(axis=0) < langs)]
        d = (c[:, None, :] != c[None, :, :]).sum(axis=2)
        least = d[np.triu_indices(langs, 1)].min()
        if least > wide:
            best, wide = c, least
    return best


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Shares of hashed n-grams by document (documents x BUCKETS, float32)."""
    docs, n = len(off) - 1, len(data)
    out = np.zeros(docs * BUCKETS)
    _, low = T._CLASSES["space"]
    for lo in range(0, n, PIECE_BYTES):  # n-grams that begin here; a long text adds up over several rounds
        part = data[lo : lo + PIECE_BYTES + 2]
        x = low[part].astype(np.uint32)
        x[(part <= 13) & (part >= 9)] = 32
        doc = np.searchsorted(off, np.arange(lo, lo + len(part)), "right") - 1
        for width in (2, 3):
            m = min(PIECE_BYTES, len(part) - width + 1)
            if m <= 0:
                continue
            g = np.full(m, width, np.uint32)
            for i in range(width):
                g = (g ^ x[i : m + i]) * np.uint32(0x9E3779B1)
                g ^= g >> np.uint32(15)
            same = doc[:m] == doc[width - 1 : m + width - 1]
            out += np.bincount(doc[:m][same] * BUCKETS + (g >> np.uint32(32 - BITS))[same].astype(np.int64), minlength=docs * BUCKETS)
    out = out.reshape(docs, BUCKETS)
    return (out / np.maximum(1, out.sum(axis=1, keepdims=True))).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.w, self.bias, self.trust = langs, code, w, bias, trust

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of every codeword (documents x languages)."""
        z = x @ self.w + self.bias
        one, zero = np.logaddexp(0, -z) * self.trust, np.logaddexp(0, z) * self.trust
        return (one @ self.code.T + zero @ (1 - self.code.T)) / max(1e-9, self.trust.sum())


def train(x: np.ndarray, y: np.ndarray, code: np.ndarray, steps: int = 300, seed: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, biases and trust of the bits' classifiers; languages weigh alike. A fifth of the rows only measures trust."""
    rng = np.random.default_rng(seed)
    out = rng.permutation(len(y)) % 5 == 0 if len(y) >= 50 else np.zeros(len(y), bool)
    scale = np.sqrt(BUCKETS)
    xs, t = x[~out] * scale, code[y[~out]].astype(np.float32)
    weight = (1 / np.maximum(1, np.bincount(y[~out], minlength=len(code))))[y[~out]]
    weight = (weight / weight.sum())[:, None].astype(np.float32)
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)
    for i in range(1, steps + 1):
        g = (1 / (1 + np.exp(-(xs @ w + b))) - t) * weight
        gw, gb = xs.T @ g + 1e-5 * w, g.sum(axis=0)
        for p, m, v, d in ((w, mw, vw, gw), (b, mb, vb, gb)):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            p -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
    check = out if out.any() else ~out
    right = ((x[check] * scale @ w + b > 0) == (code[y[check]] == 1)).mean(axis=0)
    return w * scale, b, np.clip(np.log((right + 1e-3) / (1 - right + 1e-3)), 0.05, None).astype(np.float32)


def sample(docs: DataFrame, remainder: int = 1, parts: int = 3) -> tuple[list, list]:
    """Texts and languages of a bounded sample of the rows that may be learned from."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    may = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc % parts != remainder) & (F.length("text") > 0))
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    may = may.select("doc_id", "lang", "text", order.alias("o"), F.xxhash64("text").alias("mark"))
    ids = may.select("doc_id", "lang", "o", "mark", F.length("text").alias("c"))
    # Hash thresholds bound the rows of a language before any are ranked; none is ranked beyond the sample.
    count = ids.groupBy("lang").agg(F.count("*").alias("rows"))
    langs = count.limit(LANGS + 1).collect()
    most = max(1, min(ROWS_PER_LANG, SAMPLE_ROWS // max(1, len(langs))))
    if langs and len(langs) <= LANGS:
        count = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["rows"]) for r in langs], "lang string, rows long"))
    share = F.least(F.lit(1.0), F.lit(2.0 * most) / F.col("rows"))
    few = ids.join(count, "lang").where((F.col("o").cast("double") / 2.0**64 + 0.5) <= share).dropDuplicates(["lang", "doc_id", "mark"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("o", "doc_id", "mark"))
    chosen = sorted(few.withColumn("r", rank).where(F.col("r") <= most).select("r", "lang", "doc_id", "o", "c", "mark").collect())
    room, pick = SAMPLE_CHARS, []
    for r in chosen:
        if r["c"] <= room:
            room -= r["c"]
            pick.append((r["doc_id"], r["lang"], r["mark"]))
    if not pick:
        return [], []
    kind = dict(docs.dtypes)["doc_id"]
    got = may.join(F.broadcast(docs.sparkSession.createDataFrame(pick, f"doc_id {kind}, lang string, mark long")), ["doc_id", "lang", "mark"])
    got = got.groupBy("doc_id", "lang", "mark").agg(F.first("text").alias("text")).select("text", "lang").collect()  # one row for each picked
    got.sort()
    return [r["text"] for r in got], [r["lang"] for r in got]


def fit(docs: DataFrame) -> Model:
    texts, names = sample(docs)
    langs = sorted(set(names))
    code = codebook(len(langs))
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BUCKETS, code.shape[1] if langs else 1), np.float32), np.zeros(1, np.float32), np.ones(1, np.float32))
    x = np.concatenate([features(data, off) for _, data, off in T.pieces(pa.array(texts, pa.large_string()), rows=PIECE_ROWS)])
    y = np.searchsorted(langs, names)
    return Model(langs, code, *train(x, y, code))


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            lang, score, lead = [], [], []
            texts = batch.column(1)
            for i, data, off in T.pieces(texts, rows=PIECE_ROWS):
                docs = len(off) - 1
                letter = [has_letter(t) for t in texts.slice(i, docs).to_pylist()]
                if not m.langs:
                    letter = [False] * docs
                if len(m.langs) > 1:
                    loss = m.losses(features(data, off))
                    best = loss.argmin(axis=1)
                    two = np.sort(loss, axis=1)[:, :2]
                    gap = two[:, 1] - two[:, 0]
                    p = 1 / np.exp(-4 * (loss - two[:, :1])).sum(axis=1)
                else:
                    best, gap, p = np.zeros(docs, int), np.full(docs, 9.0), np.ones(docs)
                lang += [m.langs[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score += np.where(letter, p, 0.0).tolist()
                lead += np.where(letter, gap, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pc.less(pa.array(lead, pa.float64()), AMBIGUOUS)], ["doc_id", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) for every row; learns from two thirds of the rows, by id."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    held = spark.sparkContext.broadcast(model or fit(src))
    out = src.select("doc_id", "text").mapInArrow(_predict(held), f"doc_id {dict(src.dtypes)['doc_id']}, lang_pred string, score double, ambiguous boolean")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return out.select("doc_id", F.coalesce(crc % 3 == 1, F.lit(True)).alias("held_out"), "lang_pred", "score", "ambiguous")
