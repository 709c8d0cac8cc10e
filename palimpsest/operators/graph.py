"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Edges that one task finishes by itself.
FEW = 16_384


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, to): the smallest node reachable, for at most FEW edges. Labels fall along edges and jump to their labels' labels."""
    edges = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if edges:
        nodes, at = np.unique(np.concatenate(edges, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, root[a], root[b])
            np.minimum.at(low, root[b], root[a])
            low = low[low]
            if (low == root).all():
                break
            root = low
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "to"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None, rounds: int = 60) -> DataFrame:
    """(node, component) for every node on an edge; component is the smallest node reachable.

    Each round every node points at the first of itself and its neighbours, in an order by hash that changes with the
    round; pointers are followed twice more, edges are contracted to what they point at, and loops and repeats go. The edge
    table shrinks by a constant factor in expectation, whatever the graph's shape, so long chains and large
    stars both end after about log n rounds. Minima combine on the map side; joins are plain equi-joins that adaptive execution may
    split at a hub. Once FEW edges are left, one task finishes them. Each round's tables are written to shared storage. Null ends and loops are ignored; an empty
    table gives an empty result.
    """
    s = scratch or Scratch(edges.sparkSession)
    ship(edges.sparkSession)
    e = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(f"`{a}` is not null and `{b}` is not null and a <> b")
    e = s.keep(e.distinct(), "edges")
    steps = []
    whole = all(kind in ("bigint", "int") for _, kind in e.dtypes)
    for k in range(rounds):
        left = e.count()
        if whole and left <= FEW:
            if left:
                steps.append(s.keep(e.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_finish, "node long, to long"), "rest"))
            s.drop(e) if left else None
            break
        if not left:
            break
        rank = lambda c, k=k: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("to"))
        both = e.select(F.col("a").alias("node"), rank("b").alias("r")).unionByName(e.select(F.col("b").alias("node"), rank("a").alias("r")))
        point = s.keep(both.groupBy("node").agg(F.min("r").alias("r")).select("node", F.least("r", rank("node"))["to"].alias("to")), "points")
        one, two = (point.select(F.col("node").alias(f"n{i}"), F.col("to").alias(f"t{i}")) for i in (1, 2))
        far = s.keep(point.join(one, F.col("to") == F.col("n1")).join(two, F.col("t1") == F.col("n2")).select("node", F.col("t2").alias("to")), "far")
        s.drop(point)
        steps.append(far)
        ends = [far.select(F.col("node").alias(c), F.col("to").alias(f"{c}to")) for c in "ab"]
        new = s.keep(e.join(ends[0], "a").join(ends[1], "b").where("ato <> bto").select(F.least("ato", "bto").alias("a"), F.greatest("ato", "bto").alias("b")).distinct(), "edges")
        s.drop(e)
        e = new
    else:
        raise RuntimeError("components did not settle")
    if not steps:
        return e.select(F.col("a").alias("node"), F.col("a").alias("component"))
    if len(steps) == 1 and whole and left:
        return steps[0].select("node", F.col("to").alias("component"))
    root = steps[0].select("node", F.col("to").alias("root"))
    root = reduce(lambda r, far: r.join(far.select(F.col("node").alias("root"), "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), steps[1:], root)
    root = s.keep(root, "roots")
    least = root.groupBy("root").agg(F.min("node").alias("component"))
    return s.keep(root.join(least, "root").select("node", "component"), "components")
