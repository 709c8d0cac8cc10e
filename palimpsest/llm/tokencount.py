"""Token counts by a separator scan over flat, unindexed token files.

A token file is nothing but little-endian ids, documents one after another, each followed by the end-of-document id. It comes
as blocks of fixed size that pay no heed to where documents end. Each block is searched on its own, in one
vectorised comparison: where the separators are gives the lengths of the documents inside it, the tokens before its
first separator (head) and after its last (tail). Blocks are stitched by a prefix scan: a block's first document continues what the
blocks before it left open, and its documents are numbered on from theirs. The scan is associative, so it runs over superblocks of
bounded length first and over their sums second; no task sees all blocks of a large file.

flatten() makes such blocks from a text column with a public tokenizer (a tiktoken rank file, whose path is a
parameter); read_token_files() reads them from files. Both give (file, block, data), data of whole ids.

Defined results: a null or blank text is a document of 0 tokens; tokens after a file's last separator are an
unfinished document, reported with complete = false if there are any; an empty file has no documents; repeated rows are counted
each; a null id is carried as it is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Free in that vocabulary.
END = 50256
#: Ids of a block, and blocks of a superblock.
BLOCK, SUPER = 1 << 18, 1024
# Fixed value: how the byte-level vocabulary's texts are cut before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Longer texts are encoded in pieces cut at line or word borders, so that no single call grows with the longest text.
PIECE = 200_000


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_BREAK = re.compile(r"(?<=[^\s])(?=\s[^\s])")


def encode(text: str | None, path: str = RANKS) -> list[int]:
    """Ids of a whole text; pieces of a long one are cut where the pattern cuts anyway, before a lone white space."""
    enc = encoding(path)
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out, lo = [], 0
    while len(text) - lo > PIECE:
        m = _BREAK.search(text, lo + PIECE)
        if not m:
            break
        out += enc.encode_ordinary(text[lo : m.start()])
        lo = m.start()
    return out + enc.encode_ordinary(text[lo:])


def _flatten(path: str, end: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        file, number = TaskContext.get().partitionId(), 0
        held, size, ids = [], 0, []

        def cut(flat: np.ndarray, ids: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([flat.tobytes()], pa.binary()), pa.array([ids], kind)], ["file", "block", "data", "ids"])

        kind = pa.list_(pa.int64())
        for batch in batches:
            kind = pa.list_(batch.column(0).type)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.array([*encode(text.as_py(), path), end], "<u2")
                at = 0
                while size + len(got) - at >= block:
                    part = got[at : at + block - size]
                    at += len(part)
                    if at == len(got):
                        ids.append(doc)
                    yield cut(np.concatenate([*held, part]), ids)
                    number, held, size, ids = number + 1, [], 0, []
                if at < len(got):
                    held.append(got[at:])
                    size += len(got) - at
                    ids.append(doc)
        if size:
            yield cut(np.concatenate(held), ids)

    return run


def flatten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, block, data, ids): one flat file for each partition. ids: the documents whose separators lie in the block, in order; the scan
    does not look at them."""
    ship(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return src.mapInArrow(_flatten(path, end, block), f"file long, block long, data binary, ids array<{dict(src.dtypes)['doc_id']}>")


def read_token_files(spark: SparkSession, path: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of real files, through Spark's binary reader; a file may hold up to 2 GB."""
    ship(spark)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer()
                step = block * width
                for i, lo in enumerate(range(0, raw.size // width * width, step)):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i], pa.int64()), pa.array([raw.slice(lo, min(step, raw.size // width * width - lo)).to_pybytes()], pa.binary())], ["file", "block", "data"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, block long, data binary")


def _search(end: int, width: int, carried: list[str]):
    kind = np.dtype(f"<u{width}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            head, tail, count, size, inner = [], [], [], [], []
            for data in batch.column(2):
                flat = np.frombuffer(data.as_buffer(), kind)
                at = np.flatnonzero(flat == end)
                size.append(len(flat))
                count.append(len(at))
                head.append(int(at[0]) if len(at) else len(flat))
                tail.append(len(flat) - 1 - int(at[-1]) if len(at) else len(flat))
                inner.append((np.diff(at) - 1).tolist())
            rest = [batch.column(batch.schema.get_field_index(c)) for c in carried]
            cols = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (size, count, head, tail)), pa.array(inner, pa.list_(pa.int64())), *rest]
            yield pa.RecordBatch.from_arrays(cols, ["file", "block", "size", "seps", "head", "tail", "inner", *carried])

    return run


def scan(blocks: DataFrame, end: int = END, width: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(file, ordinal, n_tokens, complete[, id]) of every document of the files."""
    s = scratch or Scratch(blocks.sparkSession)
    carried = [c for c in ("ids",) if c in blocks.columns]
    kinds = dict(blocks.dtypes)
    extra = "".join(f", {c} {kinds[c]}" for c in carried)
    schema = f"file {kinds['file']}, block long, size long, seps long, head long, tail long, inner array<long>{extra}"
    found = s.keep(blocks.select("file", "block", "data", *carried).mapInArrow(_search(end, width, carried), schema), "blocks")

    # open: tokens that are open after a stretch of blocks; the open ones before it go on only if it has no separator.
    sup = F.floor(F.col("block") / SUPER)
    inside = Window.partitionBy("file", "super").orderBy("block")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    b = found.select("file", "block", "size", "seps", "head", "tail", sup.alias("super"))
    last = F.max(F.when(F.col("seps") > 0, F.struct("block", "upto", "tail"))).over(before)
    b = b.withColumn("upto", F.sum("size").over(inside))
    b = b.withColumn("prior", F.coalesce(F.sum("seps").over(before), F.lit(0))).withColumn("sofar", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("last", last)
    # Tokens open before a block, of its superblock alone, and whether a separator of the superblock came before.
    b = b.withColumn("own", F.when(F.col("last").isNotNull(), F.col("sofar") - F.col("last.upto") + F.col("last.tail")).otherwise(F.col("sofar"))).withColumn("closed", F.col("last").isNotNull())
    ends = F.max_by(F.struct("upto", "prior", "seps", "closed", "own", "size", "tail"), "block").alias("x")
    top = b.groupBy("file", "super").agg(ends).select("file", "super", F.col("x.upto").alias("size"), (F.col("x.prior") + F.col("x.seps")).alias("seps"), F.when(F.col("x.seps") > 0, F.col("x.tail")).otherwise(F.col("x.own") + F.col("x.size")).alias("tail"))
    inside = Window.partitionBy("file").orderBy("super")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("upto", F.sum("size").over(inside)).withColumn("sofar", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn("base", F.coalesce(F.sum("seps").over(before), F.lit(0)))
    top = top.withColumn("last", F.max(F.when(F.col("seps") > 0, F.struct("super", "upto", "tail"))).over(before))
    top = top.select("file", "super", "base", F.when(F.col("last").isNotNull(), F.col("sofar") - F.col("last.upto") + F.col("last.tail")).otherwise(F.col("sofar")).alias("carry"))
    stitched = b.join(top, ["file", "super"]).select("file", "block", (F.col("base") + F.col("prior")).alias("first"), (F.col("own") + F.when(F.col("closed"), 0).otherwise(F.col("carry"))).alias("open"))

    rows = found.join(stitched, ["file", "block"])
    lengths = F.concat(F.array(F.col("open") + F.col("head")), F.col("inner"))
    doc = F.arrays_zip(lengths.alias("n"), F.col("ids").alias("id")) if carried else F.arrays_zip(lengths.alias("n"))
    done = rows.where("seps > 0").select("file", "first", F.posexplode(doc).alias("i", "d"))
    done = done.select("file", (F.col("first") + F.col("i")).alias("ordinal"), F.col("d.n").alias("n_tokens"), F.lit(True).alias("complete"), *([F.col("d.id").alias("id")] if carried else []))
    ends = rows.groupBy("file").agg(F.max_by(F.struct((F.col("first") + F.col("seps")).alias("ordinal"), F.when(F.col("seps") > 0, F.col("tail")).otherwise(F.col("open") + F.col("size")).alias("n_tokens")), "block").alias("x"))
    rest = ends.where("x.n_tokens > 0").select("file", "x.ordinal", "x.n_tokens", F.lit(False).alias("complete"), *([F.lit(None).cast(kinds["ids"][6:-1]).alias("id")] if carried else []))
    return done.unionByName(rest)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, end: int = END, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row: flattened to token files, then counted by the scan alone."""
    out = scan(flatten(docs, id_col, text_col, path, end, block), end, 2, scratch)
    return out.select(F.col("id").alias("doc_id"), "n_tokens")
