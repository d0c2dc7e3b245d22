"""Record logs: JSON lines in and out, bindings, manifests."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, raw and record (variant; null if raw is no JSON object) of every line that is not blank.

    A path that does not exist is an empty log.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "path string, raw string").withColumn("record", F.try_parse_json("raw"))
    lines = spark.read.text(there).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")).where(F.trim("raw") != "")
    value = F.try_parse_json("raw")
    return lines.withColumn("record", F.when(F.schema_of_variant(value).startswith("OBJECT"), value))


def strict(lines: DataFrame) -> DataFrame:
    """The records of a scan; raises with a count, never with content, if a line is bad."""
    bad = lines.where("record IS NULL").count()
    if bad:
        raise ValueError(f"{bad} lines are not JSON objects")
    return lines


def typed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Records of a fixed schema; a record that does not fit fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def selected(lines: DataFrame, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """name -> (path, type): only these leaves, typed; a wrong type or a missing leaf is null.

    A boolean is no integer: the leaf's own type is tested before the cast.
    """
    out = []
    for name, (path, kind) in fields.items():
        leaf = F.try_variant_get("record", path, "variant")
        fits = {"bigint": F.schema_of_variant(leaf) == "BIGINT", "string": F.schema_of_variant(leaf) == "STRING", "boolean": F.schema_of_variant(leaf) == "BOOLEAN"}.get(kind, F.lit(True))
        out.append(F.when(fits, F.try_variant_get("record", path, kind)).alias(name))
    return lines.select("path", *out)


def closed_keys(raw: Column, allowed: list[str], required: list[str]) -> Column:
    """Violations of a closed schema: unknown keys and missing ones, sorted, as codes."""
    keys = F.json_object_keys(raw)
    unknown = F.transform(F.array_except(keys, F.array(*map(F.lit, allowed))), lambda k: F.concat(F.lit("unknown:"), F.sha2(k, 256)))
    missing = F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda k: F.concat(F.lit("missing:"), k))
    return F.when(keys.isNull(), F.array(F.lit("not_an_object"))).otherwise(F.array_sort(F.concat(unknown, missing)))


def append_new(existing: DataFrame, incoming: DataFrame, id_col: str) -> DataFrame:
    """The incoming rows that an append adds: a null id raises, a known id adds nothing."""
    if not incoming.where(F.col(id_col).isNull()).isEmpty():
        raise ValueError("a record has no id")
    return incoming.join(existing.select(id_col), id_col, "left_anti").dropDuplicates([id_col])


def publish(df: DataFrame, path: str, order: list | None = None, single: bool = False) -> None:
    """JSON lines at path, all or nothing: written beside it, then renamed; an existing path is refused.

    single gives one file and is meant for small results, reports and manifests.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    if fs.exists(target):
        raise FileExistsError(path)
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
    rows = df.orderBy(*order) if order else df
    (rows.coalesce(1) if single else rows).write.json(staging)
    if not fs.rename(_fs(spark, staging)[1], target):
        raise OSError(f"{path} could not be published")


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes and sha256 of every file below path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(files: DataFrame, root: str) -> DataFrame:
    """One digest of a tree: hashes of its files in the order of their relative paths."""
    relative = F.regexp_replace("path", f"^.*?{root}/?", "")
    pairs = files.select(F.concat_ws(":", relative, "sha256").alias("p"))
    return pairs.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("p")), "\n"), 256).alias("digest"), F.count("*").alias("files"))


def binding(spark: SparkSession, path: str) -> dict:
    """records, bytes and sha256 (over the sorted file hashes) of a published log."""
    records = spark.read.text(path).where(F.trim("value") != "").count()
    own = file_hashes(spark, path).agg(F.sum("bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("sha256")).first()
    return {"records": records, "bytes": own.bytes, "sha256": own.sha256}


def manifest(content: dict) -> tuple[str, str]:
    """(canonical JSON, its SHA-256) of a small driver-side manifest."""
    text = json.dumps(content, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return text, hashlib.sha256(text.encode()).hexdigest()


def verify_manifest(text: str, digest: str) -> dict:
    if hashlib.sha256(text.encode()).hexdigest() != digest:
        raise ValueError("the manifest does not match its digest")
    return json.loads(text)


def metrics_csv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.option("header", True).csv(path)  # one row an arm and metric
