"""Near-duplicate documents by SetSketch: band registers, estimate jointly by likelihood, then verify on full sets.

Equal sets are one class, by a digest of two 64-bit codes; the first is the class's code (classes whose first codes clash are told
apart by the second), so copies never meet one another. Classes go through
    bands        classes that share a band are joined to the smallest of it (a star: linear, not all pairs);
                 what hangs together is a family
    likelihood   inside a family, pairs whose registers speak against the threshold are cut; what still hangs
                 together is a smaller family
    verification inside a smaller family, the exact similarity of the full shingle sets decides
Each of the last two returns a spanning forest of the links that it found, never the pairs. A family beyond a block is first cut
into blocks at random, twice; what those rounds tie together needs no further look at itself, so that only blocks of different
components are then held against one another: a family that hangs together ships each of its members a few times,
however large it is. No link is lost: every pair of members of different components whose sizes allow the threshold is looked at.

Registers are written by the pass that signs and read from there. Texts, registers and band rows meet the keys that they are wanted for by
broadcast, up to HELD keys; beyond, each of these joins shuffles its large side once.

Defined results: a null or blank text has the empty set and links with nothing. A row whose id is null
takes part in nothing: its component is null and it is kept. Rows that share an id but not the text are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import setsketch as S
from palimpsest.llm import textops as T
from palimpsest.operators.graph import connected_components
from palimpsest.plans.scratch import Scratch
from palimpsest.plans.ship import ship

#: Rows and weight (registers or shingles) of a block, and random rounds before blocks are held against one another.
BLOCK_ROWS, BLOCK_WEIGHT, ROUNDS = 256, 200_000, 2
#: Keys (two numbers each) that texts, registers or band rows are joined with by broadcast; more are joined by a shuffle.
HELD = 1_000_000
_EDGES = "a long, b long"


def joined(big: DataFrame, few: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """big, which is not to be shuffled if it can be helped, joined with a written table: broadcast only if that has been counted to HELD rows at most."""
    return big.join(F.broadcast(few) if few.count() <= HELD else few, on, how)


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, off in T.pieces(batch.column(2)):
                docs = len(off) - 1
                h, at, _, _ = T.words(data, off)
                one, where = T.shingles(h, at, k)
                two, _ = T.shingles(h, at, k, seed=1)
                value, doc, bound = T.sets(one, where, docs)
                n = np.diff(bound)
                regs = S.sketches(value, doc, docs)
                # Sums over the set, and its least hashes in all their bits: two sets of one shingle each differ in 64 bits twice.
                total = lambda x: np.add.reduceat(np.r_[x, T.U(0)], np.minimum(bound[:-1], len(x))) * (n > 0).astype(np.uint64)  # noqa: B023, E731
                code, d2 = (T.mix(T.mix(total(T.mix(value ^ T.U(salt))) ^ n.astype(np.uint64)) ^ T.least(x, where, docs)).view(np.int64) for salt, x in ((0, one), (0x5DEECE66D1CE4E5B, two)))
                blob = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer((np.arange(docs + 1) * 2 * S.M).astype(np.int32)), pa.py_buffer(regs.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, docs), batch.column(1).slice(i, docs), pa.array(n), pa.array(code), pa.array(d2), blob], ["id", "mark", "n", "code", "d2", "regs"])

    return run


def _registers(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), S.M)


def _bands(lo: int, hi: int):
    """Keys of bands lo to hi of the batch's different classes, with the node that stands for the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.take(pa.array(np.unique(batch.column(0).to_numpy(), return_index=True)[1]))
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                keys = S.band_keys(_registers(part.column(2)), lo, hi).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part.column(1).to_numpy(), hi - lo))], ["key", "node"])

    return run


def families(signed: DataFrame, s: Scratch, steps: tuple[int, ...] = (16, S.BANDS)) -> DataFrame:
    """(code, family) of the classes in signed (code, regs) that share bands, directly or through others.

    The first bands are joined first; classes that they tie together count as one in the buckets of the other bands, so
    that a large group, which fills a bucket in most bands, is not linked again in each.
    """
    label, lo = None, 0
    for hi in steps:
        own = signed.withColumn("node", F.col("code")) if label is None else joined(signed, label, "code", "left").withColumn("node", F.coalesce("family", "code"))
        rows = own.select("code", "node", "regs").mapInArrow(_bands(lo, hi), "key long, node long")
        stars = s.keep(rows.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last"), "stars")
        more = joined(rows, stars, "key").where("node <> lead and node <> last").select(F.col("lead").alias("a"), F.col("node").alias("b"))
        edges = stars.select(F.col("lead").alias("a"), F.col("last").alias("b")).unionByName(more)
        got = connected_components(edges, scratch=s).select(F.col("node").alias("old"), F.col("component").alias("new"))
        s.drop(stars)
        if label is None:
            label = s.keep(got.select(F.col("old").alias("code"), F.col("new").alias("family")), "families")
        else:
            kept = label.join(got, F.col("family") == F.col("old"), "left").select("code", F.coalesce("new", "family").alias("family"))
            fresh = got.join(label.select(F.col("code").alias("old")), "old", "left_anti").select(F.col("old").alias("code"), F.col("new").alias("family"))
            label = s.keep(kept.unionByName(fresh), "families")
        lo = hi
    return label


def _forest(adjacent: np.ndarray, nodes: np.ndarray, out: list) -> None:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    fresh = np.ones(len(nodes), bool)
    for root in range(len(nodes)):
        if not fresh[root]:
            continue
        fresh[root] = False
        stack = [root]
        while stack:
            x = stack.pop()
            got = np.flatnonzero(adjacent[x] & fresh)
            fresh[got] = False
            stack.extend(got.tolist())
            out.extend((int(nodes[x]), int(nodes[y])) for y in got)


def _families(table: pa.Table) -> Iterator[np.ndarray]:
    fam = table.column("family").to_numpy()
    order = np.argsort(fam, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(fam[order])) + 1):
        if len(part) > 1:
            yield part


def _edges(out: list) -> pa.Table:
    a = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": a[:, 0], "b": a[:, 1]})


def _screen(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        out: list = []
        nodes, n, regs = table.column("code").to_numpy(), table.column("n").to_numpy(), _registers(table.column("payload"))
        for part in _families(table):
            f, r, size = len(part), regs[part], n[part]
            i, j = np.triu_indices(f, 1)
            above, below, same = (np.concatenate(x) for x in zip(*(S.compare(r, x) for x in range(f - 1)), strict=True))
            ok = np.zeros((f, f), bool)
            ok[i, j] = S.plausible(above, below, same, size[i], size[j], threshold)
            _forest(ok | ok.T, nodes[part], out)
        return _edges(out)

    return run


def intersections(value: np.ndarray, doc: np.ndarray, docs: int, wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets given as (element, document), by products of 0/1 blocks of columns."""
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    new = np.r_[True, value[1:] != value[:-1]] if len(value) else np.zeros(0, bool)
    col = np.cumsum(new) - 1
    count = np.bincount(col) if len(col) else np.zeros(0, int)
    shared = count[col] > 1
    rank = np.cumsum(count > 1) - 1
    col, doc = rank[col[shared]], doc[shared]
    out = np.zeros((docs, docs))
    for lo in range(0, int(col.max(initial=-1)) + 1, wide):
        i, j = np.searchsorted(col, [lo, lo + wide])
        x = np.zeros((docs, min(wide, int(col.max()) + 1 - lo)), np.float32)
        x[doc[i:j], col[i:j] - lo] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _verify(k: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        out: list = []
        nodes = table.column("code").to_numpy()
        value, doc = [], []
        for i, data, off in T.pieces(table.column("payload").combine_chunks()):
            v, d, _ = T.shingle_sets(data, off, k)
            value.append(v)
            doc.append(d + i)
        value, doc = np.concatenate(value), np.concatenate(doc)
        bound = np.searchsorted(doc, np.arange(len(nodes) + 1))
        for part in _families(table):
            size = bound[part + 1] - bound[part]
            if len(part) == 2:
                x, y = (value[bound[p] : bound[p + 1]] for p in part)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both) and nodes[part[0]] != nodes[part[1]]:
                    out.append((int(nodes[part[0]]), int(nodes[part[1]])))
                continue
            v = np.concatenate([value[bound[p] : bound[p + 1]] for p in part])
            both = intersections(v, np.repeat(np.arange(len(part)), size), len(part))
            link = 100 * both >= percent * (size[:, None] + size[None, :] - both)
            np.fill_diagonal(link, False)
            _forest(link, nodes[part], out)
        return _edges(out)

    return run


def _blocks(rows: DataFrame, by: list[str], node_hash) -> DataFrame:
    """rows with their block within the groups of ``by``: BLOCK_ROWS and BLOCK_WEIGHT, in the mean."""
    need = rows.groupBy(*by).agg(F.greatest(F.ceil(F.count("*") / F.lit(BLOCK_ROWS)), F.ceil(F.sum("w") / F.lit(BLOCK_WEIGHT))).cast("long").alias("nb"))
    return rows.join(need, by).withColumn("sub", F.pmod(node_hash, F.col("nb"))).drop("nb")


def random_groups(large: DataFrame, step: float) -> DataFrame:
    """(code, family, gid): each member of a large family in ROUNDS random blocks of members of like size."""
    out = None
    for r in range(ROUNDS):
        c = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(r / ROUNDS)).cast("int")
        own = _blocks(large.withColumn("c", c), ["family", "c"], F.xxhash64("code", F.lit(r)))
        own = own.select("code", "family", F.xxhash64(F.lit(r), "family", "c", "sub").alias("gid"))
        out = own if out is None else out.unionByName(own)
    return out


def cross_groups(large: DataFrame, step: float, s: Scratch) -> DataFrame:
    """(code, family, gid): blocks of members in pairs, so that any two members of a family that are of different components (column
    comp) and whose sizes allow the threshold share a group. Blocks of one component are not held against one another."""
    whole = large.groupBy("family", "comp").agg(F.count("*").alias("of")).join(large.groupBy("family").agg(F.count("*").alias("all")), "family").where("of < all")
    rows = large.join(whole.drop("all"), ["family", "comp"]).withColumn("c", F.floor(F.log(F.col("n").cast("double")) / F.lit(step)).cast("int"))
    # A large component has blocks of its own; the others share theirs.
    rows = rows.withColumn("kind", F.when(F.col("of") >= BLOCK_ROWS, F.col("comp")))
    rows = s.keep(_blocks(rows.withColumn("kind", F.coalesce("kind", F.lit(0))).withColumn("mixed", F.col("of") < BLOCK_ROWS), ["family", "c", "kind", "mixed"], F.xxhash64("code")), "cross")
    block = rows.groupBy("family", "c", "kind", "mixed", "sub").agg(F.count("*").alias("rows"))
    other = block.select("family", *(F.col(x).alias(f"{x}2") for x in ("c", "kind", "mixed", "sub")))
    order = [F.struct(*(F.col(f"{x}{i}") for x in ("kind", "mixed", "sub"))) for i in ("", "2")]
    pair = block.join(other, "family").where((F.col("c2") == F.col("c") + 1) | ((F.col("c2") == F.col("c")) & (order[0] <= order[1])))
    pair = pair.where("mixed or mixed2 or kind <> kind2").withColumn("gid", F.xxhash64("family", "c", "kind", "mixed", "sub", "c2", "kind2", "mixed2", "sub2"))
    sides = pair.select("family", "c", "kind", "mixed", "sub", "gid")
    sides = sides.unionByName(pair.where("c <> c2 or kind <> kind2 or mixed <> mixed2 or sub <> sub2").select("family", *(F.col(f"{x}2").alias(x) for x in ("c", "kind", "mixed", "sub")), "gid"))
    return rows.join(sides, ["family", "c", "kind", "mixed", "sub"]).select("code", "family", "gid")


def settle(members: DataFrame, payload: DataFrame, judge: Callable[[pa.Table], pa.Table], threshold: float, s: Scratch) -> DataFrame:
    """(node, component) of what judge links within the families of members (code, family, n, w); payload: code, payload.

    Groups that judge is given are bounded blocks; see the module's docstring for how large families are looked at."""
    # Groups are small in bytes and long in work: not to be merged into few tasks.
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    step = float(np.log(1 / threshold))
    node = members.select("code", "n").join(payload, "code")

    def links(groups: DataFrame) -> DataFrame:
        return groups.join(node, "code").repartition(spread, "gid").groupBy("gid").applyInArrow(judge, _EDGES)

    by = members.groupBy("family").agg(F.count("*").alias("rows"), F.sum("w").alias("weight"))
    small_rule = (F.col("rows") <= BLOCK_ROWS) & (F.col("weight") <= BLOCK_WEIGHT)
    m = s.keep(members.join(by.where("rows > 1").withColumn("small", small_rule).select("family", "small"), "family"), "members")
    total = m.agg(F.count_if("small").alias("r"), F.sum(F.when(F.col("small"), F.col("w"))).alias("w"), F.count_if(~F.col("small")).alias("large")).first()
    packs = max(1, -(-(total["r"] or 0) // BLOCK_ROWS), -(-(total["w"] or 0) // BLOCK_WEIGHT))
    groups = m.where("small").select("code", "family", F.pmod(F.xxhash64("family"), F.lit(packs)).alias("gid"))
    if not total["large"]:
        return connected_components(links(groups), scratch=s)
    large = m.where("not small").drop("small")
    first = s.keep(links(groups.unionByName(random_groups(large, step))), "links")
    comp = connected_components(first, scratch=s).select(F.col("node").alias("code"), F.col("component").alias("comp"))
    large = s.keep(large.join(comp, "code", "left").withColumn("comp", F.coalesce("comp", "code")), "large")
    more = links(cross_groups(large, step, s))
    return connected_components(first.unionByName(more), scratch=s)


def apart(signed: DataFrame, s: Scratch) -> DataFrame:
    """signed with other codes for the classes whose codes are equal but whose second codes are not."""
    clash = s.keep(signed.groupBy("code").agg(F.min("d2").alias("least"), F.max("d2").alias("most")).where("least < most").select("code", "least"), "clashes")
    if not clash.count():
        return signed
    other = F.when(F.col("d2") > F.col("least"), F.xxhash64("code", "d2")).otherwise(F.col("code"))
    return s.keep(signed.join(clash, "code", "left").withColumn("code", F.coalesce(other, "code")).drop("least"), "sketches")


def components(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, s: Scratch) -> DataFrame:
    """(id, mark, n, code, component, least, least_mark) for every row of docs: mark is a hash of id and text; component is the smallest id
    reachable, (least, least_mark) the id and mark of the row that stands for the component."""
    ship(docs.sparkSession)
    threshold = percent / 100
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"), F.col(text_col).alias("text"))
    sig = apart(s.keep(src.mapInArrow(_sign(k), "id long, mark long, n long, code long, d2 long, regs binary"), "sketches"), s)
    live = sig.where("n > 0 and id is not null")
    classes = s.keep(live.groupBy("code").agg(F.min(F.struct("id", "mark")).alias("row"), F.first("n").alias("n")).select("code", "row.*", "n"), "classes")

    members = s.keep(families(live.select("code", "regs"), s).join(classes, "code"), "family")
    regs = s.keep(joined(live.select("id", "mark", "regs"), members.select("id", "mark", "code"), ["id", "mark"]).groupBy("code").agg(F.first("regs").alias("payload")), "registers")
    family = settle(members.select("code", "family", "n", F.lit(S.M).cast("long").alias("w")), regs, _screen(threshold), threshold, s)

    members = s.keep(family.select(F.col("node").alias("code"), F.col("component").alias("family")).join(members.drop("family"), "code"), "plausible")
    texts = s.keep(joined(src, members.select("id", "mark", "code"), ["id", "mark"]).groupBy("code").agg(F.first("text").alias("payload")), "texts")
    linked = settle(members.select("code", "family", "n", F.col("n").alias("w")), texts, _verify(k, percent), threshold, s)
    for t in (regs, texts):
        s.drop(t)

    label = classes.join(linked.withColumnRenamed("node", "code"), "code", "left").withColumn("component", F.coalesce("component", "code"))
    heads = label.groupBy("component").agg(F.min(F.struct("id", "mark")).alias("head"))
    label = s.keep(label.select("code", "component").join(heads, "component").select("code", F.col("head.id").alias("least"), F.col("head.mark").alias("least_mark")), "labels")
    rows = sig.select("id", "mark", "n", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("code")).alias("code"))
    return rows.join(label, "code", "left")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    k: words of a shingle; percent: documents are linked if 100 * intersection >= percent * union.
    See the module's docstring for the method and for nulls, empty texts and repeated rows.
    """
    found = components(docs, k, percent, id_col, text_col, scratch or Scratch(docs.sparkSession))
    found = found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("component_id"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, without all but one of each group of near-duplicates.

    Rows are told apart by id and text: of rows that share an id but not the text, only those go that are near-duplicates. Of rows
    with equal id and text one stays. Rows with a null id or without a word stay all.
    Up to HELD rows that go are broadcast; beyond, the rows are shuffled once.
    """
    s = scratch or Scratch(docs.sparkSession)
    found = s.keep(components(docs, k, percent, id_col, text_col, s).where("least is not null").select("id", "mark", "least", "least_mark"), "found")
    stays = (F.col("id") == F.col("least")) & (F.col("mark") == F.col("least_mark"))
    gone = s.keep(found.where(~stays).select("id", "mark").distinct(), "gone")
    twice = s.keep(found.where(stays).groupBy("id", "mark").count().where("count > 1").select("id", "mark"), "repeated")
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("mark"))
    out = joined(row, gone, ["id", "mark"], "left_anti")
    if not twice.count():
        return out.select("row.*")
    again = out.join(twice, ["id", "mark"], "left_semi").groupBy("id", "mark").agg(F.min("row").alias("row"))
    return out.join(twice, ["id", "mark"], "left_anti").select("row.*").unionByName(again.select("row.*"))
