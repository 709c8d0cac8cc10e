"""Secrets in whole texts, judged by corpus-wide ownership frequency; DataFrame functions only.

Candidates are found by patterns, kind by kind. A text is cut at a kind's matches once; a match starts where
the lengths of what came before end, which a running sum over the document's few matches gives. Every candidate's hash is
counted over the whole corpus by distinct owners and by distinct repositories of owners: what many owners hold is a widely copied example, what
one owner holds and looks random is a live-looking credential.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one unnamed; rows that repeat (same id and text) count
once in the frequencies and each get their result; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.plans.scratch import Scratch

# Kinds in their order, with pattern, group of the secret's value, least length of the value, and
# what a text must contain (in lower case for ``assign``) for the pattern to be tried.
KINDS: tuple[tuple[str, str, int, int, tuple[str, ...]], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, ("password", "passwd", "secret", "token", "apikey", "api_key")),
    ("access", r"AKIA[A-Z0-9]+", 0, 20, ("AKIA",)),
    ("hex", r"[0-9a-f]{24,}", 0, 24, ()),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, ("eyJ",)),
    ("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 27, ("PRIVATE KEY-----",)),
)
BASE_KINDS = ("assign", "access", "hex")
#: Whether a row of candidates() has a match.
SOME = " or ".join(f"size({k[0]}) > 1" for k in KINDS)


def _tried(kind: str, pattern: str, needles: tuple[str, ...], text: Column, low: Column) -> Column:
    if not needles:
        return text.rlike(pattern)
    found = [F.contains(low if kind == "assign" else text, F.lit(x)) for x in needles]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def candidates(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(doc_id, owner, mark, <kind> for each kind): for a text in which a kind is tried, the lengths of the pieces
    between matches, the lengths of the matches and the values."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("text"))
    base = base.withColumn("low", F.lower(text))
    cols = []
    for kind, pattern, group, _, needles in KINDS:
        p = F.lit(pattern)
        parts = F.arrays_zip(
            F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
            F.transform(F.regexp_extract_all(text, p, 0), lambda x: F.length(x)).alias("size"),
            F.regexp_extract_all(text, p, group).alias("value"),
        )
        cols.append(F.when(_tried(kind, pattern, needles, text, F.col("low")), parts).alias(kind))
    return base.select("doc_id", "owner", F.xxhash64(text).alias("mark"), *cols)


def occurrences(cand: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, start, end, value): every match that is long enough, once for each (doc_id, text)."""
    each = [F.struct(F.lit(i).alias("kind"), F.col(k[0]).alias("parts")) for i, k in enumerate(KINDS)]
    some = cand.where(SOME).dropDuplicates(["doc_id", "mark"])
    rows = some.select("doc_id", "mark", F.explode(F.array(*each)).alias("k")).select("doc_id", "mark", "k.kind", F.posexplode("k.parts").alias("pos", "p"))
    rows = rows.select("doc_id", "mark", "kind", "pos", "p.gap", F.col("p.size").alias("size"), F.col("p.value").alias("value"))
    upto = F.sum(F.col("gap") + F.coalesce("size", F.lit(0))).over(Window.partitionBy("doc_id", "mark", "kind").orderBy("pos"))
    rows = rows.withColumn("end", upto.cast("long")).where("size is not null")
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("kind") + 1)
    rows = rows.where(F.length("value") >= least)
    return rows.select("doc_id", "mark", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "value")


def ownership(found: DataFrame, cand: DataFrame) -> DataFrame:
    """(hash, owners, repositories): how many distinct owners, and distinct repositories of owners, hold a value. All owners of
    an id and text count, however often the two occur."""
    held = cand.where(SOME).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "owner").distinct()
    once = found.select("hash", "doc_id", "mark").distinct().join(held, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")))
    once = once.select("hash", "owner", "doc_id").distinct()
    return once.groupBy("hash", "owner").agg(F.count("*").alias("r")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories"))


def looks_random(value: Column) -> Column:
    """Digits and letters, at least eight different characters and no long run of one."""
    different = F.size(F.array_distinct(F.split(value, "")))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (different >= 8) & ~value.rlike(r"(.)\1{5}")


def secret_spans(docs: DataFrame, many_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", scratch: Scratch | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, spans). rows: doc_id, mark of every input row. spans: doc_id, mark, kind, start, end, value's SHA-256, owners,
    repositories, verdict. A repository is a document, its owner the document's source; ``copied``: held by many_owners or more;
    ``live``: held by one and random-looking; else ``unclear``."""
    s = scratch or Scratch(docs.sparkSession)
    cand = s.keep(candidates(docs, id_col, text_col, owner_col), "candidates")
    found = s.keep(occurrences(cand).withColumn("hash", F.sha2("value", 256)).withColumn("random", looks_random(F.col("value"))).drop("value"), "occurrences")
    held = ownership(found, cand)
    verdict = F.when(F.col("owners") >= many_owners, "copied").when((F.col("owners") == 1) & F.col("random"), "live").otherwise("unclear")
    return cand.select("doc_id", "mark"), found.join(held, "hash").withColumn("verdict", verdict)


def secret_digest(docs: DataFrame, many_owners: int = 3, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", scratch: Scratch | None = None) -> DataFrame:
    """One row for each input row: counts and positions of the spans, and how many values are copied or live-looking."""
    rows, spans = secret_spans(docs, many_owners, id_col, text_col, owner_col, scratch)
    name = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("kind") + 1)
    spot = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"))
    count = lambda kind: F.count_if(F.col("kind") == [k[0] for k in KINDS].index(kind))
    values = lambda verdict: F.size(F.collect_set(F.when(F.col("verdict") == verdict, F.col("hash")))).cast("long")
    by = spans.groupBy("doc_id", "mark").agg(*(count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sort_array(F.collect_list(spot)).alias("spots"), values("copied").alias("n_copied"), values("live").alias("n_live"))
    say = lambda a: F.array_join(F.transform(a, lambda x: x["said"]), ",")
    by = by.withColumnRenamed("doc_id", "d").withColumnRenamed("mark", "m")
    out = rows.join(by, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left")
    spots = F.coalesce("spots", F.array().cast("array<struct<start:bigint,kind:int,said:string>>"))
    return out.select(
        "doc_id",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*(f"n_{k}" for k in BASE_KINDS),)),
        F.sha2(say(F.filter(spots, lambda x: x["kind"] < len(BASE_KINDS))), 256).alias("base_sha256"),
        say(spots).alias("spans"),
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_copied", "n_live")),
    )
