"""Reading raw corpora, label files, archives' trees, manifests and result grids; writing guarded outputs."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = T.StructType([T.StructField(c, T.StringType()) for c in ("title", "text", "label")])


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, encoding: str = "UTF-8", strict: bool = False) -> DataFrame:
    """CSV with quoted line breaks; malformed rows fail (strict) or are kept in _corrupt_record. Without a schema all columns are strings."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding)
    if schema is None:
        return reader.csv(path)
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").csv(path)
    return reader.schema(T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])).option("columnNameOfCorruptRecord", "_corrupt_record").csv(path)


def parse_report(df: DataFrame) -> DataFrame:
    """(rows, malformed) of a permissive read."""
    return df.agg(F.count("*").alias("rows"), F.count_if(F.col("_corrupt_record").isNotNull()).alias("malformed"))


def locate(spark: SparkSession, base: str, name: str, corpus: str) -> str:
    """The file in the folder itself or in the corpus's own folder, whichever is there."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in (f"{base}/{name}", f"{base}/{corpus}/{name}"):
        at = jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(conf).exists(at):
            return p
    raise FileNotFoundError(f"{name} is neither in {base} nor in {base}/{corpus}")


def read_tree(spark: SparkSession, path: str, pattern: str = r"([^/]+)/(\d+)([a-z]+)\.txt$") -> DataFrame:
    """Text files of an extracted tree: (path, folder, number, suffix, label_ok, sha256, text, title, body, decoding_error).

    A file's folder and the suffix of its name must agree on the label. The title is the first line that isn't blank, the body what follows untouched.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.expr("try_validate_utf8(cast(content as string))")
    x = df.select("path", *(F.regexp_extract("path", pattern, i).alias(n) for i, n in ((1, "folder"), (2, "number"), (3, "suffix"))), F.sha2("content", 256).alias("sha256"), text.alias("text"))
    return x.withColumns({"label_ok": F.col("folder") == F.col("suffix"), "decoding_error": F.col("text").isNull(), **headline("text")})


def headline(text: str) -> dict:
    """title: the first line that isn't blank; body: all that follows its line break."""
    return {"title": F.trim(F.regexp_extract(text, r"^\s*([^\n]*)", 1)), "body": F.regexp_replace(text, r"^\s*[^\n]*\n?", "")}


def read_zip(spark: SparkSession, path: str) -> DataFrame:
    """(archive, member, sha256, content) of ZIP files; unsafe or repeated member names and damaged archives are errors."""
    schema = "archive string, member string, sha256 string, content binary"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    members = [m for m in z.namelist() if not m.endswith("/")]
                    bad = [m for m in members if PurePosixPath(m).is_absolute() or ".." in PurePosixPath(m).parts]
                    if bad or len(set(members)) != len(members) or z.testzip():
                        raise ValueError(f"unsafe, repeated or damaged members in {name}")
                    for m in members:
                        content = z.read(m)
                        yield pd.DataFrame({"archive": [name], "member": [m], "sha256": [hashlib.sha256(content).hexdigest()], "content": [content]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


def read_labels(spark: SparkSession, path: str, value: str | None = None) -> DataFrame:
    """(key, value) of a label file: the first column is the key, the value column is found by its name unless it is given."""
    from palimpsest.operators.corpus import clean_labels

    df = read_csv(spark, path)
    named = [c for c in df.columns[1:] if "label" in c.lower() or "aggreg" in c.lower()]
    return clean_labels(df, df.columns[0], value or (named[0] if named else df.columns[1]))


def read_ids(spark: SparkSession, path: str, name: str = "doc_id") -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "").distinct()


def read_grid(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Result files as one table, columns that a file lacks as null; NaN as null."""
    out = None
    for p in paths:
        df = spark.read.option("header", True).option("inferSchema", True).csv(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select(*(F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes))


def read_json(spark: SparkSession, path: str) -> dict:
    """A manifest or configuration (small, for the driver), through Spark's own reader."""
    return json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect()))


def visit(value, keys: tuple = ()) -> Iterator[tuple[tuple, object]]:
    """Every leaf of nested JSON with its path."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from visit(v, (*keys, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            yield from visit(v, (*keys, i))
    else:
        yield keys, value


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of the files below a path: the table that freezing inputs rests on."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_new(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write to a path that must not exist."""
    df.write.mode("errorifexists").option("header", True).format(kind).save(path)


def write_version(df: DataFrame, base: str, version: str, kind: str = "parquet") -> str:
    """Write a whole version next to earlier ones; readers see it only when Spark's commit has put _SUCCESS there."""
    write_new(df, f"{base}/version={version}", kind)
    return f"{base}/version={version}"


def write_text_free(df: DataFrame, path: str, texts: tuple[str, ...] = ("text", "body", "title", "text_i", "text_j")) -> None:
    """The table without any column that holds text."""
    write_new(df.drop(*texts), path)


def canonical_sha256(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces, UTF-8."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def protocol_guard(spark: SparkSession, path: str, protocol: dict) -> str:
    """Write the protocol's digest where a run begins, or fail if the run there began under another one."""
    digest = canonical_sha256(protocol)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(conf).exists(at):
        if spark.read.json(path).first()["sha256"] != digest:
            raise ValueError("the run was begun under another protocol")
    else:
        spark.createDataFrame([(digest, json.dumps(protocol, sort_keys=True))], "sha256 string, protocol string").coalesce(1).write.json(path)
    return digest


def sealed(record: dict) -> dict:
    """A result record with its checksum, that of its canonical JSON without one."""
    body = {k: v for k, v in record.items() if k != "sha256"}
    return {**body, "sha256": canonical_sha256(body)}


def check_record(record: dict) -> dict:
    """A sealed record, or an error if what it holds is not what was sealed."""
    if "sha256" not in record or sealed(record)["sha256"] != record["sha256"]:
        raise ValueError("the record's checksum is missing or wrong")
    return record


def freeze(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy the files below source to target, which must not exist, read-only, and write their manifest (path, bytes, sha256; paths relative to target)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = dst.getFileSystem(conf)
    if fs.exists(dst):
        raise FileExistsError(target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, fs, jvm.org.apache.hadoop.fs.Path(f"{target}/files"), False, conf)
    files = fs.listFiles(jvm.org.apache.hadoop.fs.Path(f"{target}/files"), True)
    while files.hasNext():
        fs.setPermission(files.next().getPath(), jvm.org.apache.hadoop.fs.permission.FsPermission("0444"))
    write_new(_relative(spark, target), f"{target}/manifest")
    return spark.read.parquet(f"{target}/manifest")


def _relative(spark: SparkSession, target: str) -> DataFrame:
    return file_hashes(spark, f"{target}/files").withColumn("path", F.regexp_extract("path", r"/files/(.*)$", 1))


def verify_frozen(spark: SparkSession, target: str) -> DataFrame:
    """(path, state) of frozen files that are missing, extra or changed; none if all is as it was."""
    old, new = spark.read.parquet(f"{target}/manifest"), _relative(spark, target).select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("sha256").isNull(), "extra").when(F.col("sha256") != F.col("now"), "changed")
    return old.join(new, "path", "full").select("path", state.alias("state")).where("state is not null")


def bundle(files: dict[str, bytes]) -> bytes:
    """A ZIP of small files that depends on their names and contents alone, with SHA256SUMS among them."""
    if "SHA256SUMS" in files:
        raise ValueError("SHA256SUMS is written by the bundle")
    sums = "".join(f"{hashlib.sha256(files[n]).hexdigest()}  {n}\n" for n in sorted(files)).encode()
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in sorted({**files, "SHA256SUMS": sums}.items()):
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            z.writestr(info, data)
    return out.getvalue()


def read_csv_in_zip(spark: SparkSession, path: str, member: str, encodings: tuple[str, ...] = ("utf-8-sig", "latin-1")) -> DataFrame:
    """Rows of a CSV inside ZIP files, columns as strings and empty fields as null; the first encoding that fits is taken and lines that don't parse are left out.

    An archive is one task, as its members cannot be split.
    """

    def parse(data: bytes) -> pd.DataFrame:
        for e in encodings:
            try:
                return pd.read_csv(io.StringIO(data.decode(e)), dtype=str, on_bad_lines="skip")
            except UnicodeDecodeError:
                continue
        raise ValueError(f"no encoding fits {member}")

    files = read_zip(spark, path).where(F.col("member") == member).select("content")
    first = files.select(F.substring("content", 1, 1 << 16)).first()
    if first is None:
        raise FileNotFoundError(f"{member} is not in {path}")
    columns = list(parse(bytes(first[0]).rsplit(b"\n", 1)[0] + b"\n").columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                x = parse(data).reindex(columns=columns).astype(object)
                yield x.where(x.notna(), None)

    return files.mapInPandas(run, T.StructType([T.StructField(c, T.StringType()) for c in columns]))
