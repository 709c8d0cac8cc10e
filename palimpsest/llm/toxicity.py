"""Toxicity by a convolutional text classifier trained in numpy.

A word is embedded by several hashed views of itself (the whole word, its first four, six and eight bytes), each with
a table of its own; convolutions of widths 1, 2 and 3 run over whole texts, ReLU and max pooling over all positions
leave one number for each filter, and a logistic layer gives the score. Max pooling passes gradients to one position for each
filter only, so training is cheap however long texts are. The first coordinate of a view starts at the smoothed log
odds of its bucket, from which training goes on. The score is shifted so that 0.5 is the cut that does best on labelled rows
kept from fitting; besides, a cut is calibrated for each language, which decides ``flagged`` but is no input of a score.

Every labelled row is used, whole: four in five (by hash of the id) for the log odds and the fit, the fifth for the cuts. The rows
are written once in shards of about ROWS_A_SHARD. In each epoch every shard is learned from by a task of its own, which goes on
from the common net; what the shards changed is averaged, for a bucket over the shards that changed it. No row goes to the driver:
it gets sums by bucket and a histogram of scores, both bounded by the parameters below.

Defined results: a null or blank text has the score of a text without words; without labels of both kinds all scores
are 0; documents labelled more than once are toxic if any label says so; repeated rows count as often as they occur and get equal
scores; a null id or text is never learned from; a language without enough labels uses the cut of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import textops as T
from palimpsest.plans.scratch import CLEANUP, Scratch
from palimpsest.plans.ship import ship

#: Buckets of a view, coordinates of an embedding, widths and filters of each width.
BITS, DIM, WIDTHS, FILTERS = 17, 4, (1, 2, 3), 6
VIEWS = 4
#: Labelled rows that one task learns from between two averages; passes over them, rows of a step.
ROWS_A_SHARD, EPOCHS, BATCH = 4000, 6, 64
#: Labelled rows from which on a fifth is kept from fitting, for the cuts.
LEAST_TO_PART = 100
#: Words of 64 bits that tell documents without a label.
WORDS = 1 << 19
#: Buckets that are summed at once; steps of the cuts' grid, in the score's log odds.
PART, GRID = 1 << 16, 256
#: Bytes of text that are scored at once.
PIECE = 400_000
#: Labelled rows of either kind that a language needs for a cut of its own.
LEAST_FOR_CUT = 20


def views(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every view of every word, document): words are runs of letters, digits and characters beyond ASCII."""
    h, doc, start, end = T.words(data, off, "alnum")
    _, low = T._CLASSES["alnum"]
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate([low[data], np.zeros(8, np.uint8)]), 0, (1,)) if len(data) else np.zeros(1, np.uint64)
    out = np.empty((len(h), VIEWS), np.int32)
    out[:, 0] = h >> T.U(64 - BITS)
    for v, keep in ((1, 4), (2, 6), (3, 8)):
        out[:, v] = T.mix((eight[start] & T._KEEP[np.minimum(end - start, keep)]) + T.U(v)) >> T.U(64 - BITS)
    return out, doc


class Net:
    """E: tables of the views; W, b: filters by width; o, c: the logistic layer."""

    def __init__(self, tables: np.ndarray, filters: list[np.ndarray], bias: list[np.ndarray], out: np.ndarray, shift: float):
        self.tables, self.filters, self.bias, self.out, self.shift = tables, filters, bias, out, shift

    def copy(self) -> Net:
        return Net(self.tables.copy(), [x.copy() for x in self.filters], [x.copy() for x in self.bias], self.out.copy(), self.shift)

    def dense(self) -> np.ndarray:
        """All but the tables in one row of numbers."""
        return np.concatenate([x.ravel() for x in (*self.filters, *self.bias, self.out)] + [[self.shift]])

    def add_dense(self, change: np.ndarray) -> None:
        at = 0
        for x in (*self.filters, *self.bias, self.out):
            x += change[at : at + x.size].reshape(x.shape).astype(x.dtype)
            at += x.size
        self.shift += float(change[at])

    def pooled(self, ids: np.ndarray, bound: np.ndarray, where: bool = False, goes_on: bool = False):
        """Max over each document of every filter (documents x filters); with ``where`` also the positions. ``goes_on``: the last
        document has further words, so that filters that reach beyond these have no value yet."""
        docs = len(bound) - 1
        total = len(WIDTHS) * FILTERS
        top, at = np.zeros((docs, total), np.float32), np.full((docs, total), -1, np.int64)
        if not len(ids):
            return (top, at) if where else top
        x = np.concatenate([self.tables[v][ids[:, v]] for v in range(VIEWS)], axis=1)
        live = np.flatnonzero(np.diff(bound) > 0)
        start = bound[:-1][live]
        last = np.zeros(len(ids), np.int64)
        last[bound[1:][live] - 1] = 1
        for i, width in enumerate(WIDTHS):
            z = x @ self.filters[i][0]
            for t in range(1, width):
                y = x[t:] @ self.filters[i][t]
                z[: len(ids) - t] += y * (self._inside(bound, len(ids), t)[: len(ids) - t, None])
            if goes_on and width > 1:
                z[max(0, len(ids) - width + 1) :] = -np.inf
            best = np.maximum.reduceat(z, start, axis=0)
            cols = slice(i * FILTERS, (i + 1) * FILTERS)
            top[live, cols] = np.maximum(best + self.bias[i], 0)
            if where:
                for f in range(FILTERS):
                    hit = np.flatnonzero(z[:, f] == np.repeat(best[:, f], np.diff(bound)[live]))
                    d = np.searchsorted(bound, hit, "right") - 1
                    first = np.r_[True, d[1:] != d[:-1]]
                    at[d[first], i * FILTERS + f] = hit[first]
        return (top, at) if where else top

    @staticmethod
    def _inside(bound: np.ndarray, n: int, t: int) -> np.ndarray:
        """1 where the word t places on is of the same document."""
        ok = np.ones(n, np.float32)
        for back in range(1, t + 1):
            edge = bound[1:] - back
            ok[edge[(edge >= 0) & (edge < n)]] = 0
        return ok

    def score(self, ids: np.ndarray, bound: np.ndarray) -> np.ndarray:
        return self.judge(self.pooled(ids, bound))

    def logit(self, top: np.ndarray) -> np.ndarray:
        return np.clip(top @ self.out + self.shift, -30, 30)

    def judge(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logit(top)))

    def peaks(self, ids: np.ndarray, bound: np.ndarray, goes_on: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Max of every filter, and the words it was met at (documents x filters x words x views; -1: beyond the text or the filter)."""
        top, at = self.pooled(ids, bound, where=True, goes_on=goes_on)
        if not len(ids):
            return top, np.full((*top.shape, max(WIDTHS), VIEWS), -1, np.int32)
        pos = at[:, :, None] + np.arange(max(WIDTHS))
        ok = (at[:, :, None] >= 0) & (pos < bound[1:, None, None]) & (np.arange(max(WIDTHS)) < np.repeat(WIDTHS, FILTERS)[:, None])
        return top, np.where(ok[..., None], ids[np.where(ok, pos, 0)], -1)

    def peaks_long(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``peaks`` of one long text."""
        top, win = self.peaks(np.zeros((0, VIEWS), np.int32), np.zeros(2, np.int64))
        for ids, goes_on in self.stretches(data):
            t, w = self.peaks(ids, np.array([0, len(ids)]), goes_on)
            win = np.where((t > top)[..., None, None], w, win)
            top = np.maximum(top, t)
        return top, win

    def score_long(self, data: np.ndarray) -> np.ndarray:
        return self.judge(self.pooled_long(data))

    def pooled_long(self, data: np.ndarray) -> np.ndarray:
        top = np.zeros((1, len(WIDTHS) * FILTERS), np.float32)
        for ids, goes_on in self.stretches(data):
            top = np.maximum(top, self.pooled(ids, np.array([0, len(ids)]), goes_on=goes_on))
        return top

    @staticmethod
    def stretches(data: np.ndarray) -> Iterator[tuple[np.ndarray, bool]]:
        """The views of one long text, PIECE bytes at a time: pieces end at the end of a word, and the last words go into the next piece."""
        sep, _ = T._CLASSES["alnum"]
        carry, lo = np.zeros((0, VIEWS), np.int32), 0
        while lo < len(data):
            hi = min(len(data), lo + PIECE)
            while hi < len(data) and not sep[data[hi]]:
                gap = np.flatnonzero(sep[data[hi : hi + PIECE]])
                hi = hi + int(gap[0]) if len(gap) else min(len(data), hi + PIECE)
            ids = np.concatenate([carry, views(data[lo:hi], np.array([0, hi - lo]))[0]])
            yield ids, hi < len(data)
            carry, lo = ids[max(0, len(ids) - max(WIDTHS) + 1) :], hi


def _bounds(doc: np.ndarray, docs: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(docs + 1))


def start(met: np.ndarray, n1: int, n0: int, seed: int = 5) -> tuple[Net, Net]:
    """The net before training and its Adagrad sums (one for each row of a table), from the toxic and clean documents of each bucket."""
    rng = np.random.default_rng(seed)
    p, q = met.reshape(VIEWS, 1 << BITS, 2).transpose(2, 0, 1)
    tables = rng.normal(0, 0.05, (VIEWS, 1 << BITS, DIM)).astype(np.float32)
    odds = np.log((p + 0.5) / (n1 + 1)) - np.log((q + 0.5 * n0 / n1 + 0.5) / (n0 + 1))
    tables[:, :, 0] = np.where(p + q >= 3, np.clip(odds, -3, 3), 0) / 3
    filters = [rng.normal(0, 0.1, (w, VIEWS * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, ::DIM] += 1
    net = Net(tables, filters, [np.full(FILTERS, -0.5, np.float32) for _ in WIDTHS], np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.5)
    few = np.float32(1e-3)
    return net, Net(np.full(tables.shape[:2], few), [np.full_like(f, few) for f in filters], [np.full_like(b, few) for b in net.bias], np.full_like(net.out, few), 1e-3)


def learn(net: Net, acc: Net, data: np.ndarray, off: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator) -> None:
    """Adagrad over the log loss of a piece of texts, in steps of BATCH documents."""
    docs = len(y)
    if docs == 1 and len(data) > PIECE:
        step(net, acc, *net.peaks_long(data), y, weight)
        return
    ids, doc = views(data, off)
    bound = _bounds(doc, docs)
    order = rng.permutation(docs)
    for pick in np.array_split(order, -(-docs // BATCH)):
        pick = np.sort(pick)
        rows = np.concatenate([np.arange(bound[d], bound[d + 1]) for d in pick])
        step(net, acc, *net.peaks(ids[rows], np.r_[0, np.cumsum(bound[pick + 1] - bound[pick])]), y[pick], weight[pick])


def step(net: Net, acc: Net, top: np.ndarray, win: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
    """One step: ``top`` and ``win`` are the documents' peaks."""

    def move(p, a, g, rate):
        a += g * g
        p -= rate * g / np.sqrt(a)

    g = ((net.judge(top) - y) * weight / BATCH).astype(np.float32)
    back = g[:, None] * net.out[None, :] * (top > 0)
    move(net.out, acc.out, top.T @ g + 1e-4 * net.out, 0.05)
    acc.shift += float(g.sum()) ** 2
    net.shift -= 0.05 * float(g.sum()) / np.sqrt(acc.shift)
    touched, amount = [], []
    for i, width in enumerate(WIDTHS):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        gb, gf = back[:, cols], np.zeros_like(net.filters[i])
        for t in range(width):
            met = win[:, cols, t]
            d, f = np.nonzero((met[..., 0] >= 0) & (gb != 0))
            if not len(d):
                continue
            word, e = met[d, f], gb[d, f]
            x = np.concatenate([net.tables[v][word[:, v]] for v in range(VIEWS)], axis=1)
            for k in range(FILTERS):
                gf[t, :, k] += (x[f == k] * e[f == k, None]).sum(axis=0)
            touched.append(word)
            amount.append(e[:, None] * net.filters[i][t][:, f].T)
        move(net.filters[i], acc.filters[i], gf, 0.02)
        move(net.bias[i], acc.bias[i], gb.sum(axis=0), 0.02)
    if touched:
        word, amt = np.concatenate(touched), np.concatenate(amount)
        for v in range(VIEWS):
            u, inv = np.unique(word[:, v], return_inverse=True)
            gv = np.zeros((len(u), DIM), np.float32)
            np.add.at(gv, inv, amt[:, v * DIM : (v + 1) * DIM])
            acc.tables[v, u] += (gv * gv).mean(axis=1)
            net.tables[v, u] -= 0.05 * gv / np.sqrt(acc.tables[v, u])[:, None]


def best_cut(at: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The log odds that part the kinds with the best F1, in the middle of the best stretch: step ``at`` of the grid has ``n`` rows."""
    order = np.argsort(-at)
    at, n, toxic = at[order], n[order], toxic[order]
    i = int(np.argmax(2 * np.cumsum(toxic) / (np.cumsum(n) + max(1, toxic.sum()))))
    # The stretch begins above step i + 1 and ends where step i begins; its middle is that of the scores.
    edges = np.array([(at[i + 1] + 1) / GRID if i + 1 < len(at) else -np.inf, at[i] / GRID])
    middle = np.clip((1 / (1 + np.exp(-edges))).mean(), 1e-13, 1 - 1e-13)
    return float(np.clip(np.log(middle / (1 - middle)), *edges))


def labelled(docs: DataFrame, labels: DataFrame, label_id: str, label_col: str, parts: int = 5) -> tuple[DataFrame, DataFrame]:
    """The documents that may be learned from, nearly all others without a label left out, and the labels by id: joined, every labelled row."""
    may = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != 0
    lab = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null")
    lab = lab.where(may).groupBy("doc_id").agg(F.max("label").cast("int").alias("label")).where("label in (0, 1)")
    # Bits of hashed ids, so that texts without a label needn't move: at most WORDS rows, whatever the number of labels.
    h = F.xxhash64(F.col("doc_id").cast("string"), F.lit("bit"))
    word, bit = F.pmod(h, F.lit(WORDS)).alias("word"), F.expr("shiftleft(1L, cast(at as int))")
    bits = lab.select(word, F.pmod(F.shiftright(h, 40), F.lit(64)).alias("at")).groupBy("word").agg(F.bit_or(bit).alias("bits"))
    docs = docs.where("text is not null and doc_id is not null").where(may).withColumns({"word": word, "at": F.pmod(F.shiftright(h, 40), F.lit(64))})
    docs = docs.join(F.broadcast(bits), "word").where(F.col("bits").bitwiseAND(bit) != 0)
    return docs.select("doc_id", "text", "lang"), lab


class Shards:
    """The labelled rows (text, lang, label, o, kept_back), o in random order, written once, one file for each shard."""

    def __init__(self, spark: SparkSession, docs: DataFrame, lab: DataFrame):
        self.spark, self.scratch = spark, Scratch(spark)
        count = docs.select("doc_id").join(lab.select("doc_id"), "doc_id").count()
        # Both sides in the shards' partitions: texts move once. A join would spread them over the session's number if that were larger.
        shards = max(1, -(-count // ROWS_A_SHARD))
        docs, lab = (x.repartition(shards, "doc_id") for x in (docs, lab))
        name = F.col("doc_id").cast("string")
        rows = docs.join(lab, "doc_id").select("text", "lang", "label", F.xxhash64(name, "text").alias("o"), (F.pmod(F.xxhash64(name, F.lit("toxic")), F.lit(5)) == 4).alias("kept_back"))
        with self.settings({"spark.sql.shuffle.partitions": shards}):
            self.rows = self.scratch.keep(rows.sortWithinPartitions("o", "lang"), "labelled")

    def collect(self, df: DataFrame) -> list:
        """Rows of ``df``, where a task reads one file, whole; what was shuffled for it goes at once."""
        with self.settings({CLEANUP: "true", "spark.sql.files.maxPartitionBytes": 1 << 50, "spark.sql.files.openCostInBytes": 1 << 50}):
            return df.collect()

    @contextmanager
    def settings(self, conf: dict) -> Iterator[None]:
        held = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, str(v))
        try:
            yield
        finally:
            for k, v in held.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def sums(self, rows: DataFrame, run, width: int, size: int) -> np.ndarray:
        """Sums (size x width) of what ``run`` yields for each shard by ``blobs``, added up in the shards' order."""
        out = np.zeros((size, width))
        got = rows.mapInArrow(run, BLOB).repartition(-(-size // PART), "part").sortWithinPartitions("part", "shard").mapInArrow(_add(width), BLOB)
        for r in self.collect(got):
            out[np.frombuffer(r["at"], np.int32)] = np.frombuffer(r["amount"], np.float64 if width == 2 else np.float32).reshape(-1, width)
        return out


BLOB = "part int, shard long, at binary, amount binary"


def blobs(shard: int, at: np.ndarray, amount: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ascending indexes and their numbers, cut into parts of PART indexes."""
    for part in np.unique(at // PART).tolist():
        lo, hi = np.searchsorted(at, [part * PART, (part + 1) * PART])
        cells = [pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([at[lo:hi].astype(np.int32).tobytes()], pa.binary()), pa.array([amount[lo:hi].tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(cells, ["part", "shard", "at", "amount"])


def _add(width: int):
    kind = np.float64 if width == 2 else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, at = np.zeros((PART, width)), None
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(0)[i].as_py()
                if part != at:
                    if at is not None:
                        some = np.flatnonzero(total.any(axis=1))
                        yield from blobs(0, some + at * PART, total[some].astype(kind))
                    total[:], at = 0, part
                total[np.frombuffer(batch.column(2)[i].as_buffer(), np.int32) - part * PART] += np.frombuffer(batch.column(3)[i].as_buffer(), kind).reshape(-1, width)
        if at is not None:
            some = np.flatnonzero(total.any(axis=1))
            yield from blobs(0, some + at * PART, total[some].astype(kind))

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clean and toxic documents (columns 1 and 0) of each bucket."""
    size = 1 << BITS
    met, shard = np.zeros((VIEWS * size, 2)), None
    for batch in batches:
        if batch.num_rows and shard is None:
            shard = batch.column(2)[0].as_py()
        y = np.asarray(batch.column(1))
        for i, data, off in T.pieces(batch.column(0)):
            docs = len(off) - 1
            if docs == 1 and len(data) > PIECE:
                seen = np.zeros((VIEWS, size), bool)
                for ids, _ in Net.stretches(data):
                    seen[np.arange(VIEWS), ids] = True
                met[:, 1 - y[i]] += seen.ravel()
                continue
            ids, doc = views(data, off)
            for v in range(VIEWS if len(ids) else 0):
                key = np.sort(doc * size + ids[:, v])
                key = key[np.r_[True, key[1:] != key[:-1]]]
                toxic = y[i + key // size] == 1
                for k, own in ((0, key[toxic]), (1, key[~toxic])):
                    met[v * size : (v + 1) * size, k] += np.bincount(own % size, minlength=size)
    if shard is not None:
        some = np.flatnonzero(met.any(axis=1))
        yield from blobs(shard, some, met[some])


def _learn(model, epoch: int, n1: int, n0: int):
    """What a shard changes, times its documents: the change (tables: DIM numbers), that of the Adagrad sum, and the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, acc, docs, shard = None, None, 0, None
        rng = np.random.default_rng([5, epoch])
        for batch in batches:
            if not batch.num_rows:
                continue
            if net is None:
                (net, acc), shard = (x.copy() for x in model.value), batch.column(2)[0].as_py()
            y = np.asarray(batch.column(1)).astype(np.int64)
            weight = np.where(y == 1, (n1 + n0) / (2 * n1), (n1 + n0) / (2 * n0))
            for i, data, off in T.pieces(batch.column(0)):
                own = slice(i, i + len(off) - 1)
                learn(net, acc, data, off, y[own], weight[own], rng)
            docs += batch.num_rows
        if net is None:
            return
        was, had = model.value
        moved = (net.tables - was.tables).reshape(-1, DIM)
        some = np.flatnonzero(moved.any(axis=1))
        dense = net.dense() - was.dense()
        amount = np.zeros((len(some) + len(dense), DIM + 2), np.float32)
        amount[: len(some), :DIM], amount[: len(some), DIM] = moved[some], (acc.tables - had.tables).ravel()[some]
        amount[len(some) :, 0], amount[len(some) :, DIM] = dense, acc.dense() - had.dense()
        amount[:, DIM + 1] = 1
        yield from blobs(shard, np.r_[some, len(moved) + np.arange(len(dense))], amount * np.float32(docs))

    return run


def train(shards: Shards, rows: DataFrame, n1: int, n0: int) -> Net:
    """The net after EPOCHS passes over all rows; both kinds weigh alike."""
    sc, size = shards.spark.sparkContext, VIEWS << BITS
    rows = rows.select("text", "label", "o")
    net, acc = start(shards.sums(rows, _count, 2, size), n1, n0)
    for epoch in range(EPOCHS):
        model = sc.broadcast((net, acc))
        change = shards.sums(rows, _learn(model, epoch, n1, n0), DIM + 2, size + len(net.dense()))
        model.destroy()
        change[:, : DIM + 1] /= np.maximum(change[:, DIM + 1 :], 1)
        net.tables += change[:size, :DIM].reshape(net.tables.shape).astype(np.float32)
        acc.tables += change[:size, DIM].reshape(acc.tables.shape).astype(np.float32)
        net.add_dense(change[size:, 0])
        acc.add_dense(change[size:, DIM])
    return net


def _grid(model):
    """(whole, lang, step of the grid, rows, toxic ones), for all rows and by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in batches:
            at = np.floor(_scores(net, batch.column(0), net.logit) * GRID).astype(np.int64)
            x = pa.table({"whole": np.zeros(len(at), bool), "lang": batch.column(2), "at": at, "toxic": np.asarray(batch.column(1)).astype(np.int64)})
            every = x.set_column(0, "whole", pa.array(np.ones(len(at), bool))).set_column(1, "lang", pa.nulls(len(at), pa.string()))
            x = pa.concat_tables([every, x.set_column(1, "lang", x["lang"].cast(pa.string())).filter(x["lang"].is_valid())])
            x = x.group_by(["whole", "lang", "at"]).aggregate([("toxic", "count"), ("toxic", "sum")])
            yield from x.rename_columns(["whole", "lang", "at", "n", "toxic"]).combine_chunks().to_batches()

    return run


def find_cuts(shards: Shards, rows: DataFrame, net: Net) -> dict:
    """The best cut of all rows (None) and of each language with enough of them, in log odds."""
    model = shards.spark.sparkContext.broadcast(net)
    grid = rows.select("text", "label", "lang").mapInArrow(_grid(model), "whole boolean, lang string, at long, n long, toxic long")
    grid = grid.groupBy("whole", "lang", "at").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    grid = grid.groupBy("whole", "lang").agg(F.sum("toxic").alias("y1"), F.sum("n").alias("y"), F.collect_list(F.struct("at", "n", "toxic")).alias("x"))
    got = shards.collect(grid.where(f"whole or (y1 >= {LEAST_FOR_CUT} and y - y1 >= {LEAST_FOR_CUT})"))
    model.destroy()
    return {None if r["whole"] else r["lang"]: best_cut(*np.array(r["x"]).reshape(-1, 3).T) for r in got}


def fit(docs: DataFrame, labels: DataFrame, label_id: str = "doc_id", label_col: str = "toxic") -> tuple[Net | None, dict]:
    """The net and the cuts by language (None: of all)."""
    shards = Shards(docs.sparkSession, *labelled(docs, labels, label_id, label_col))
    try:
        n = {(r["kept_back"], r["label"]): r["count"] for r in shards.rows.groupBy("kept_back", "label").count().collect()}
        n1, n0 = (n.get((False, y), 0) for y in (1, 0))
        all1, all0 = (k + n.get((True, y), 0) for k, y in ((n1, 1), (n0, 0)))
        if not all1 or not all0:
            return None, {None: 0.5}
        fitted = check = shards.rows
        if n1 and n0 and all1 + all0 >= LEAST_TO_PART:
            fitted = shards.rows.where("not kept_back")
            check = shards.rows.where("kept_back") if all1 > n1 and all0 > n0 else fitted
        else:
            n1, n0 = all1, all0
        net = train(shards, fitted, n1, n0)
        cuts = find_cuts(shards, check, net)
    finally:
        shards.scratch.drop(shards.rows)
    # 0.5 is to be the best cut.
    net.shift -= cuts[None]
    return net, {k: float(1 / (1 + np.exp(cuts[None] - v))) for k, v in cuts.items()}


def _scores(net: Net, texts: pa.Array, judge) -> np.ndarray:
    out = np.zeros(len(texts))
    for i, data, off in T.pieces(texts, PIECE):
        if len(off) == 2 and len(data) > PIECE:
            out[i] = judge(net.pooled_long(data))[0]
            continue
        ids, doc = views(data, off)
        out[i : i + len(off) - 1] = judge(net.pooled(ids, _bounds(doc, len(off) - 1)))
    return out


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, cuts = model.value
        for batch in batches:
            out = np.zeros(batch.num_rows) if net is None else _scores(net, batch.column(1), net.judge)
            cut = [cuts.get(x, cuts[None]) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array(cut, pa.float64())], ["doc_id", "score", "lang_cut"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_cut, flagged) for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(src, labels, label_id, label_col))
    out = src.mapInArrow(_score(model), f"doc_id {dict(src.dtypes)['doc_id']}, score double, lang_cut double")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    return out.select("doc_id", F.coalesce(crc % 5 == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "lang_cut", (F.col("score") >= F.col("lang_cut")).alias("flagged"))
