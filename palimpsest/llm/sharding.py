"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points of a 64-bit ring; a document belongs to the arc that ends at the next point clockwise, and so to that
point's shard. A shard takes at most its capacity; what overflows goes on clockwise to the next point of a shard that is
not full. The arcs' counts (one row for each of shards * vnodes arcs) settle all of it on the driver: in rounds,
every shard takes what comes to it, in ring order, until it is full, and turns away whole arcs or the end of one arc. An arc is thus cut into a
few pieces by rank, and each piece has a shard and a first slot; documents need only their rank within their arc.

Ranks follow position, then the text's CRC. Rows that are equal in id, size and CRC are counted as one and given back in the end; a position is
ranked in up to 1024 parts by the high bits of the CRC, whose counts are summed up along the arc. So an id that very many rows share, with one text or
with many, fills neither a window nor a task's memory.

With load 1 capacities are exact: counts of shards differ by one at most (law ``rows``). With load above 1 fewer documents
leave their first shard, and shards hold at most that multiple of the mean.

Defined results: a null or blank text has size 1 and its own CRC (0); a null id is placed by the text's CRC; rows that
repeat are placed one by one, next to one another. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Copies of an equal row that one array gives back.
CHUNK = 100_000


def ring(shards: int, vnodes: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(points in order, shard of each); a shard's points don't depend on how many shards there are."""
    point = np.array([[xxhash.xxh64_intdigest(f"{seed}:{s}:{v}") for v in range(vnodes)] for s in range(shards)], np.uint64).view(np.int64)
    order = np.argsort(point.reshape(-1), kind="stable")
    return point.reshape(-1)[order], np.repeat(np.arange(shards), vnodes)[order]


def capacities(total: int, loads: list[int], load: float) -> list[int]:
    """Rows that each shard may hold; with load 1 the surplus rows go where most documents belong."""
    n = len(loads)
    if load > 1:
        return [-(-int(total * load) // n) + 1] * n
    most = sorted(range(n), key=lambda s: (-loads[s], s))[: total % n]
    return [total // n + (s in most) for s in range(n)]


def place(counts: np.ndarray, owner: np.ndarray, shards: int, load: float) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot) pieces that cover every arc; counts: documents by arc."""
    loads = np.bincount(owner, weights=counts, minlength=shards).astype(int).tolist()
    left = capacities(int(counts.sum()), loads, load)
    filled = [0] * shards
    todo = [(arc, 0, int(c), arc) for arc, c in enumerate(counts) if c]  # arc, ranks, point that it has come to
    out = []
    while todo:
        free = [x > 0 for x in left]
        later = []
        for arc, lo, hi, at in todo:
            while not free[owner[at]]:
                at = (at + 1) % len(owner)
            s = int(owner[at])
            take = min(hi - lo, left[s])
            if take:
                out.append((arc, lo, lo + take, s, filled[s]))
                left[s] -= take
                filled[s] += take
            if lo + take < hi:
                later.append((arc, lo + take, hi, at))
        todo = later
    return out


def _arcs(points: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            arc = np.searchsorted(points, b.column("pos").to_numpy(), "left") % len(points)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(arc.astype(np.int32))], [*b.schema.names, "arc"])

    return run


def shard_documents(docs: DataFrame, shards: int = 16, vnodes: int = 128, load: float = 1.0, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, home, shard, slot) of every row; home is the shard of the ring alone."""
    spark = docs.sparkSession
    ship(spark)
    s = scratch or Scratch(spark)
    points, owner = ring(shards, vnodes)
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    key = key.withColumn("pos", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_crc32").cast("string")))))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key.schema)
    keys = s.keep(key.mapInArrow(_arcs(points), f"{schema}, arc int"), "keys")
    part = F.shiftright("text_crc32", 22).alias("part")
    rows = s.keep(keys.groupBy("arc", "pos", part, "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    s.drop(keys)
    parts_of = s.keep(rows.groupBy("arc", "pos", "part").agg(F.sum("n").alias("m")), "parts")
    counts = np.zeros(len(points), np.int64)
    for row in parts_of.groupBy("arc").agg(F.sum("m").alias("m")).toLocalIterator():
        counts[row["arc"]] = row["m"]
    pieces = place(counts, owner, shards, load)
    parts = spark.createDataFrame(pieces, "arc int, lo long, hi long, shard int, slot0 long") if pieces else spark.createDataFrame([], "arc int, lo long, hi long, shard int, slot0 long")
    homes = F.element_at(F.array(*(F.lit(int(x)) for x in owner)), F.col("arc") + 1) if len(owner) <= 4096 else F.lit(None).cast("int")
    before = F.sum("m").over(Window.partitionBy("arc").orderBy("pos", "part")) - F.col("m")
    within = F.sum("n").over(Window.partitionBy("arc", "pos", "part").orderBy("text_crc32", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    first = rows.withColumn("within", within).join(parts_of.withColumn("before", before).drop("m"), ["arc", "pos", "part"]).withColumn("first", F.col("before") + F.col("within"))
    chunk = first.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(CHUNK)))))
    copy = F.explode(F.sequence(F.col("c") * CHUNK, F.least(F.col("n"), (F.col("c") + 1) * CHUNK) - 1))
    ranked = chunk.withColumn("i", copy).withColumn("rank", F.col("first") + F.col("i"))
    # The pieces are at most the arcs and one cut for each shard and round: bounded by the parameters, not by the data.
    out = ranked.join(F.broadcast(parts), "arc").where("rank >= lo and rank < hi")
    return out.select("doc_id", "size", "text_crc32", homes.alias("home"), "shard", (F.col("slot0") + F.col("rank") - F.col("lo")).alias("slot"))
