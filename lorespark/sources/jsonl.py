"""JSON lines and prefixed text in; JSON lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import let


def _lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, ord (the line number, from 1) and line of every file, without blank lines. A large file is read in many tasks:
    lines are counted by byte range first, sums of the ranges before give the number of a range's first line."""
    reader = spark.read.option("lineSep", "\n")
    if recursive:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl")
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    rows = reader.text(path).select(*place, F.monotonically_increasing_id().alias("id"), "value")
    ranges = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))  # a row a byte range
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")
    starts = ranges.select("file", "block", (before - F.col("first") + 1).alias("shift"))
    held = rows.where(F.trim(F.regexp_replace("value", r"\r$", "")) != "").join(starts, ["file", "block"])
    return held.select("file", (F.col("id") + F.col("shift")).alias("ord"), F.regexp_replace("value", r"\r$", "").alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = True, recursive: bool = False) -> DataFrame:
    """Rows with file and ord. Strict: a broken line is an error that names its number; else it is left out."""
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    parsed = F.from_json("line", T.StructType([*schema.fields, T.StructField("_broken", T.StringType())]), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"})
    whole = lambda r: F.struct(r.alias("row"), (r.isNull() | r["_broken"].isNotNull()).alias("broken"))
    rows = _lines(spark, path, recursive).withColumn("_p", let(parsed, whole)).select("file", "ord", "_p.*")
    broken = F.col("broken")
    if strict:
        error = F.raise_error(F.concat(F.lit("invalid JSON on line "), F.col("ord").cast("string"), F.lit(" of "), F.col("file")))
        rows = rows.withColumn("ord", F.when(broken, error.cast("long")).otherwise(F.col("ord")))
    else:
        rows = rows.where(~broken)
    return rows.select("file", "ord", *[F.col(f"row.{f.name}").alias(f.name) for f in schema.fields])


def read_chat(spark: SparkSession, path: str) -> DataFrame:
    """S3: chat pairs; an absent or empty source is `chat-auto`."""
    rows = read_jsonl(spark, path, "user string, assistant string, source string, timestamp string", strict=False)
    return rows.withColumn("source", F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("chat-auto")))


def pair_prefixed(lines: DataFrame, human: str = "人:", reply: str = "AI:") -> DataFrame:
    """User and assistant from lines (ord, line) with alternating prefixes; # lines are comments, a later human line
    replaces the one that waits. lines: also file, if there are several."""
    keys = [F.col("file")] if "file" in lines.columns else []
    kept = lines.where(~F.col("line").startswith("#") & (F.col("line").startswith(human) | F.col("line").startswith(reply)))
    before = F.lag("line").over(Window.partitionBy(*keys).orderBy("ord"))
    rows = kept.withColumn("before", before).where(F.col("line").startswith(reply) & F.col("before").startswith(human))
    cut = lambda c, prefix: F.trim(F.substr(c, F.lit(len(prefix) + 1)))
    return rows.select(*keys, "ord", cut(F.col("before"), human).alias("user"), cut(F.col("line"), reply).alias("assistant"))


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """One object a line; overwriting goes to a new path that must not be the one being read."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_snapshot(df: DataFrame, root: str, stamp: str, note: str = "") -> DataFrame:
    """The rows in a new folder root/stamp, and their manifest: stamp, note, n and a checksum that does not depend on
    order. A stamp that exists is an error, so a snapshot never changes; a folder without a manifest is an unfinished one."""
    df.write.mode("error").parquet(f"{root}/{stamp}/rows")
    rows = df.sparkSession.read.parquet(f"{root}/{stamp}/rows")
    checksum = F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)")).cast("string")
    manifest = rows.agg(F.count("*").alias("n"), checksum.alias("checksum")).select(F.lit(stamp).alias("stamp"), F.lit(note).alias("note"), "n", "checksum")
    manifest.write.mode("error").json(f"{root}/{stamp}/manifest")
    return df.sparkSession.read.schema("stamp string, note string, n long, checksum string").json(f"{root}/{stamp}/manifest")


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """The distinct trained fingerprints of state documents."""
    rows = spark.read.schema("trained_fingerprints array<string>").option("multiLine", True).json(path)
    return rows.select(F.explode("trained_fingerprints").alias("fingerprint")).distinct()


def read_corpus(spark: SparkSession, path: str, fallback: str | None = None) -> DataFrame:
    """File, ord and line of a text corpus at path, or at fallback if there is nothing at path; neither is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in (path, fallback):
        if p is not None:
            at = jvm.org.apache.hadoop.fs.Path(p)
            if at.getFileSystem(conf).globStatus(at):
                return _lines(spark, p)
    raise FileNotFoundError(f"no corpus at {path}" + (f" or {fallback}" if fallback else ""))
