"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id and text. Words are summed by source and by the hash's leading bits; the
running sum finds the bucket in which a source's budget ends; only that boundary bucket is split by the next bits, again and again,
until it holds one hash. The threshold so found takes documents by a plain comparison, without sorting any of them. Budgets
of one source use one hash, so the documents of a smaller budget are among those of a larger one (nested).

Defined results: a null or blank text has size 0 and takes 0 words; a null source is a source of its own, last in
order; rows with one id and text share a hash and are taken together; a source whose documents are all empty gets target 0;
an empty table gives an empty result. Other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of the hash, and bits by which a histogram or a boundary bucket is split.
HASH_BITS, STEP_BITS = 60, 12


def spot(id_col: str, text_col: str) -> Column:
    """The hash of a row's id and text: rows without an id, or of one id, are told apart by their texts."""
    own = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), own)), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, h): words and hash of every row."""
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.expr(f"regexp_count(coalesce(`{text_col}`, ''), r'{WORD}')").cast("long").alias("size"),
        spot(id_col, text_col).alias("h"),
    )


def targets(base: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, source_size, target): the total size shared by weight, no source above cap times its size.

    Sources take the weights in turn, by code point, null last. Filling up to the caps has a closed form: with sources
    sorted by cap / weight, the first i are full and the others share the rest by weight, for the least i at which
    that share is below the next cap. One row for each source goes through the windows here, never documents.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = base.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("w", w).withColumn("c", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy((F.col("c").cast("double") / F.col("w")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    rest = (F.sum("source_size").over(everything) - F.coalesce(F.sum("c").over(before), F.lit(0))).cast("double")
    s = s.withColumn("share", rest / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("i", F.row_number().over(order))
    s = s.withColumn("level", F.min(F.when(F.col("share") <= F.col("c").cast("double") / F.col("w"), F.struct("i", "share"))).over(everything)["share"])
    return s.select("source", "source_size", F.least(F.col("c").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("c").cast("double"))).alias("target"))


def thresholds(base: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """(source, name, cut): documents of a source with h <= cut come nearest to its budget.

    budgets: (source, name, budget). base: see sized(). cut is -1 where nothing is to be taken.
    """
    by = Window.partitionBy("source", "name").orderBy("bucket")
    done = None
    # At each level: open budgets, the bucket that they end in, and the words before that bucket.
    state = budgets.select("source", "name", "budget", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("before"))
    bits = 0
    while True:
        bits += STEP_BITS
        shift = HASH_BITS - bits
        if bits == STEP_BITS:
            hist = base.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("most"))
            hist = scratch.keep(hist, "histogram").withColumnRenamed("source", "s")
            hist = state.join(hist, F.col("s").eqNullSafe(F.col("source"))).drop("s")
        else:
            # Only what lies in a boundary bucket; several budgets may end in one.
            edge = state.select(F.col("source").alias("s"), F.col("prefix").alias("p")).distinct()
            inner = base.withColumn("p0", F.shiftright("h", shift + STEP_BITS)).join(edge, F.col("s").eqNullSafe(F.col("source")) & (F.col("p0") == F.col("p")), "left_semi")
            hist = inner.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("least"), F.max("h").alias("most"))
            hist = scratch.keep(hist, "boundary").withColumnRenamed("source", "s")
            hist = state.join(hist, F.col("s").eqNullSafe(F.col("source")) & (F.shiftright("bucket", STEP_BITS) == F.col("prefix"))).drop("s")
        run = hist.withColumn("upto", F.col("before") + F.sum("size").over(by))
        # The boundary is the first bucket beyond the budget.
        over = run.where(F.col("upto") > F.col("budget")).groupBy("source", "name").agg(F.min_by(F.struct("budget", "bucket", (F.col("upto") - F.col("size")).alias("before"), "upto", "least", "most"), "bucket").alias("x")).select("source", "name", "x.*")
        over = scratch.keep(over, "edges")
        single = over.where("least = most").select("source", "name", F.when(F.col("upto") - F.col("budget") < F.col("budget") - F.col("before"), F.col("least")).otherwise(F.col("least") - 1).alias("cut"))
        done = single if done is None else done.unionByName(single)
        state = over.where("least < most").select("source", "name", "budget", F.col("bucket").alias("prefix"), "before")
        if bits >= HASH_BITS or not state.limit(1).count():
            break
    # A budget that no running sum exceeds takes the whole source.
    rest = budgets.select("source", "name").join(done.withColumnRenamed("source", "s").withColumnRenamed("name", "n"), F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("name")), "left")
    return rest.select("source", "name", F.coalesce("cut", F.lit((1 << HASH_BITS) - 1)).alias("cut"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, fractions: tuple[float, ...] = (1.0,), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, source, h, size, source_size, target, taken, taken_<percent> for each fraction below 1).

    A source whose target is r times its size gives every document floor(r) times and, of the rest, those below its
    hash threshold once more. fractions: nested mixes of those parts of every target.
    """
    s = scratch or Scratch(docs.sparkSession)
    base = s.keep(sized(docs, id_col, text_col, source_col), "sizes")
    goal = s.keep(targets(base, weights, cap), "targets")
    part = goal.select("*", F.explode(F.array(*map(F.lit, fractions))).alias("name")).withColumn("want", F.col("target") * F.col("name"))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("want") / F.col("source_size")), F.lit(cap))).otherwise(0).cast("long")
    part = part.withColumn("copies", whole).withColumn("budget", F.col("want") - F.col("copies") * F.col("source_size"))
    cut = thresholds(base, part.select("source", "name", "budget"), s)
    cut = cut.select(F.col("source").alias("s"), F.col("name").alias("n"), "cut")
    plan = part.join(cut, F.col("s").eqNullSafe(F.col("source")) & (F.col("n") == F.col("name"))).groupBy("source", "source_size", "target")
    plan = s.keep(plan.agg(*(F.max(F.when(F.col("name") == f, F.struct("copies", "cut"))).alias(f"plan{i}") for i, f in enumerate(fractions))), "plan")
    label = ["taken" if f == 1 else f"taken_{round(100 * f)}" for f in fractions]
    plan = plan.withColumnRenamed("source", "s")
    out = base.join(plan, F.col("s").eqNullSafe(F.col("source")))
    return out.select("doc_id", "source", "h", "size", "source_size", "target", *((F.col("size") * (F.col(f"plan{i}.copies") + (F.col("h") <= F.col(f"plan{i}.cut")).cast("long"))).alias(c) for i, c in enumerate(label)))


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it (0 to cap times); empty texts once.

    The thresholds are computed once; the filter is then a comparison in a pass over the documents, without a join by id.
    """
    s = scratch or Scratch(docs.sparkSession)
    base = s.keep(sized(docs, id_col, text_col, source_col), "sizes")
    goal = s.keep(targets(base, weights, cap), "targets")
    plan = goal.withColumn("name", F.lit(1.0)).withColumn("copies", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(cap))).otherwise(1).cast("int"))
    cut = thresholds(base, plan.select("source", "name", (F.col("target") - F.col("copies") * F.col("source_size")).alias("budget")), s)
    plan = s.keep(plan.select(F.col("source").alias("plan_source"), F.col("copies").alias("plan_copies")).join(cut.select(F.col("source").alias("cut_source"), F.col("cut").alias("plan_cut")), F.col("plan_source").eqNullSafe(F.col("cut_source"))).drop("cut_source"), "plan")
    h = spot(id_col, text_col)
    empty = ~F.coalesce(F.col(text_col), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    # The row goes along as one column, so that no name of it can clash.
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col(source_col).alias("row_source"), h.alias("row_h"), empty.alias("row_empty"))
    out = row.join(plan, F.col("row_source").eqNullSafe(F.col("plan_source")))
    times = F.when(F.col("row_empty"), 1).otherwise(F.col("plan_copies") + (F.col("row_h") <= F.col("plan_cut")).cast("int"))
    return out.select("row", times.alias("times")).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")
