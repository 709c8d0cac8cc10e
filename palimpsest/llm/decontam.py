"""Benchmark decontamination by size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size (the number of their distinct shingles, by powers of two). Each partition turns the containment
threshold into a sketch: the smallest hashes (bottom-k MinHash) of an item, with k from the partition's largest size u. An
item with n shingles that a document holds to at least the threshold misses at most n - ceil(threshold * n) of
them; k is more than that for every n up to u, so a contained item always shows some of its minima, and how many
at least is known. A document of any length is one stream of shingles probed for the minima of all items; there is
no sketch of the long side that short items would drown in. What shows enough minima is verified: distinct shingles
of the item in the document, over distinct shingles of the item. Documents are only read, never shuffled.

Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z as a-z. An item with fewer than k words
is one shingle of all its words, sought among the runs of that many words of a document.

Defined results: null or wordless items match nothing, null or blank texts hold nothing; repeated rows give repeated
rows; empty tables give empty results; a null id is carried as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import textops as T
from palimpsest.plans.ship import ship

#: Shingles of items that are held at once (8 bytes each, and a table of their minima); further items take further passes.
HELD = 4_000_000
#: Minima beyond those that a contained item may miss.
SPARE = 2
_FLAGS = 1 << 20


def _item_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, off in T.pieces(batch.column(1)):
                h, doc, _, _ = T.words(data, off, "alnum")
                out, at = T.shingles(h, doc, k)
                order = np.lexsort((out, at))
                out, at = out[order], at[order]
                new = np.r_[True, (out[1:] != out[:-1]) | (at[1:] != at[:-1])] if len(out) else np.zeros(0, bool)
                out, at = out[new], at[new]
                docs = len(off) - 1
                count = np.bincount(doc, minlength=docs)
                bound = np.searchsorted(at, np.arange(docs + 1))
                sets = T.ragged([out[a:b].view(np.int64) for a, b in zip(bound[:-1], bound[1:], strict=True)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, docs), pa.array(np.minimum(count, k).astype(np.int32)), pa.array(np.diff(bound).astype(np.int64)), sets], ["item_id", "width", "n", "shingles"])

    return run


def sketch_size(n: int, threshold: float) -> int:
    """k of the partition of an item with n shingles, whose largest size is the next power of two less one."""
    u = (1 << n.bit_length()) - 1
    return u - math.ceil(threshold * u - 1e-9) + 1 + SPARE


class Index:
    """The minima and the full sets of a bounded block of items."""

    def __init__(self, sets: list[np.ndarray], widths: list[int], threshold: float):
        self.sets, self.widths, self.threshold = sets, np.array(widths), threshold
        need = [math.ceil(threshold * len(x) - 1e-9) for x in sets]
        minima = [np.sort(T.mix(x))[: sketch_size(len(x), threshold)] for x in sets]
        # A contained item misses at most n - need of its shingles.
        self.least = np.array([max(1, len(m) - (len(x) - q)) for m, x, q in zip(minima, sets, need, strict=True)])
        self.need = np.array(need)
        flat = np.concatenate(minima) if minima else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(m) for m in minima])
        order = np.argsort(flat, kind="stable")
        self.hash, self.owner = flat[order], owner[order]
        self.flag = np.zeros(_FLAGS, bool)
        self.flag[(self.hash >> T.U(44)).astype(np.int64)] = True

    def search(self, data: np.ndarray, off: np.ndarray, k: int) -> list[tuple[int, int, int]]:
        """(document of the chunk, item, shingles of the item in the document) where the threshold is reached."""
        h, doc, _, _ = T.words(data, off, "alnum")
        out = []
        for width in sorted({*self.widths.tolist()} | {k}):
            seen, at = T.shingles(h, doc, int(width), whole=False) if width == k else _runs(h, doc, int(width), k)
            m = T.mix(seen)
            hit = np.flatnonzero(self.flag[(m >> T.U(44)).astype(np.int64)])
            lo = np.searchsorted(self.hash, m[hit], "left")
            hi = np.searchsorted(self.hash, m[hit], "right")
            hit, lo, hi = hit[hi > lo], lo[hi > lo], hi[hi > lo]
            if not len(hit):
                continue
            times = hi - lo
            row = np.repeat(np.arange(len(hit)), times)
            item = self.owner[lo[row] + (np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times))]
            key = np.unique(np.stack([at[hit][row], item, m[hit][row].view(np.int64)], axis=1), axis=0)
            pair, shown = np.unique(key[:, :2], axis=0, return_counts=True)
            bound = np.searchsorted(at, [pair[:, 0], pair[:, 0] + 1]) if (at[1:] >= at[:-1]).all() else None
            for j, (d, i) in enumerate(pair):
                if self.widths[i] != width or shown[j] < self.least[i]:
                    continue
                own = seen[bound[0][j] : bound[1][j]] if bound is not None else seen[at == d]
                both = int(np.isin(self.sets[i], own).sum())
                if both >= self.need[i]:
                    out.append((int(d), int(i), both))
        return out


def _runs(h: np.ndarray, doc: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of width < k words, hashed as shingles() hashes a whole sequence of that many words."""
    n = len(h)
    if n < width:
        return h[:0], doc[:0]
    coef = T.mix(np.arange(1, k + 1, dtype=np.uint64) * T.U(2)) | T.U(1)
    full = doc[: n - width + 1] == doc[width - 1 :]
    s = np.full(n - width + 1, width, np.uint64) * T.U(0x9E3779B97F4A7C15)
    for i in range(width):
        s = s + h[i : n - width + 1 + i] * coef[i]
    return T.mix(s[full]), doc[: n - width + 1][full]


def indexes(items: DataFrame, k: int, threshold: float, id_col: str = "item_id", text_col: str = "text", held: int = HELD) -> Iterator[tuple[list, Index]]:
    """(ids, Index) of blocks of items, each of at most about ``held`` shingles (or one item)."""
    ship(items.sparkSession)
    kind = dict(items.dtypes)[id_col]
    sets = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(_item_sets(k), f"item_id {kind}, width int, n long, shingles array<long>").where("n > 0")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // held)
    for b in range(blocks):
        rows = (sets if blocks == 1 else sets.where(F.pmod(F.xxhash64("shingles"), F.lit(blocks)) == b)).collect()
        yield [r["item_id"] for r in rows], Index([np.array(r["shingles"], np.int64).view(np.uint64) for r in rows], [r["width"] for r in rows], threshold)


def find_contained(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", held: int = HELD) -> DataFrame:
    """(doc_id, item_id, matched, n_shingles, containment) of every document that holds an item to the threshold."""
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[id_col], dict(items.dtypes)[item_col]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, matched long, n_shingles long, containment double"
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for ids, index in indexes(items, k, threshold, item_col, item_text, held):
        held_out = spark.sparkContext.broadcast((ids, index))

        def run(batches, held_out=held_out):
            ids, index = held_out.value
            for batch in batches:
                for i, data, off in T.pieces(batch.column(1)):
                    got = index.search(data, off, k)
                    if got:
                        n = [len(index.sets[x]) for _, x, _ in got]
                        rows = [batch.column(0).take(pa.array([i + d for d, _, _ in got])), pa.array([ids[x] for _, x, _ in got]), pa.array([m for _, _, m in got], pa.int64()), pa.array(n, pa.int64()), pa.array([m / z for (_, _, m), z in zip(got, n, strict=True)])]
                        yield pa.RecordBatch.from_arrays(rows, ["doc_id", "item_id", "matched", "n_shingles", "containment"])

        part = src.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", held: int = HELD) -> DataFrame:
    """The rows of docs, all columns, that hold no item; one pass over the documents, no shuffle."""
    spark = docs.sparkSession
    at = docs.columns.index(text_col)
    for _, index in indexes(items, k, threshold, item_col, item_text, held):
        held_out = spark.sparkContext.broadcast(index)

        def run(batches, held_out=held_out):
            index = held_out.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for i, data, off in T.pieces(batch.column(at)):
                    for d, _, _ in index.search(data, off, k):
                        keep[i + d] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
