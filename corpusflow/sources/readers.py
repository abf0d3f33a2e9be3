"""Scans. Paths are Hadoop paths, so any store that Spark knows will do."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..operators import dedup

#: What a source may be called, in the order in which it is looked for.
CANDIDATES = ("content.parquet", "content.jsonl", "content.json", "content.jsonl.gz")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def discover(spark: SparkSession, folder: str, candidates: tuple[str, ...] = CANDIDATES) -> str:
    """The first candidate that is there."""
    for name in candidates:
        if exists(spark, f"{folder}/{name}"):
            return f"{folder}/{name}"
    raise FileNotFoundError(f"none of {', '.join(candidates)} in {folder}")


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
    """Parquet, or line-delimited JSON (.json, .jsonl, gzipped or not); only these columns are read."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if ".json" in name:
        df = (spark.read.schema(schema) if schema else spark.read).json(path)
    else:
        df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_ids(spark: SparkSession, path: str, key: str = "id") -> DataFrame:
    """The ids only, as strings."""
    if ".json" in path.rstrip("/").rsplit("/", 1)[-1]:
        return spark.read.schema(f"`{key}` string").json(path)
    return spark.read.parquet(path).select(F.col(key).cast("string").alias(key))


PLACE = ("_file", "_block", "_row")


def with_place(df: DataFrame) -> DataFrame:
    """Adds _file, _block and _row: rows ordered by them stand as in their files. Tables that aren't files have one place order."""
    row = F.monotonically_increasing_id().alias("_row")
    try:
        return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), row)
    except AnalysisException:  # not a scan
        return df.select("*", F.lit("").alias("_file"), F.lit(0).cast("long").alias("_block"), row)


def read_fixes(spark: SparkSession, path: str) -> DataFrame:
    """Hand-made articles: a JSON array or one object (.json), or lines (.jsonl). A missing file is an empty table."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.ARTICLES)
    if path.endswith(".jsonl"):
        return spark.read.schema(schemas.ARTICLES).json(path)
    if path.endswith(".json"):
        return spark.read.schema(schemas.ARTICLES).json(path, multiLine=True)
    raise ValueError(f"fixes are .json or .jsonl files, not {path}")


def read_summary_log(spark: SparkSession, path: str) -> DataFrame:
    """chunk_id, short, key, seq and the place of the lines that are whole records with an id. Missing log: an empty table.

    Appends made here carry ``seq``, from 1 up; lines that another program wrote have none and come before them, by place.
    """
    if not exists(spark, path):
        return with_place(spark.createDataFrame([], schemas.SUMMARY_LOG))
    lines = with_place(spark.read.text(path).filter("trim(value) <> ''"))
    record = F.from_json("value", schemas.SUMMARY_LOG, {"mode": "PERMISSIVE"})
    rows = lines.withColumn("r", record).filter("r is not null and coalesce(r.chunk_id, '') <> ''")
    return rows.select("r.chunk_id", F.coalesce("r.short", F.lit("")).alias("short"), F.coalesce("r.key", F.array().cast("array<string>")).alias("key"), "r.seq", *PLACE)


def next_seq(log: DataFrame) -> int:
    """The number of the append after all that the log holds."""
    return 1 + (log.agg(F.max("seq")).first()[0] or 0)


def content_of(content: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """id (string) and html: content_html, else content, else ''. Of an id's rows the first with a body counts.

    ``ids`` (a table with id): only these are looked up. The others go before any body is shuffled.
    """
    have = set(content.columns)
    parts = [F.nullif(F.col(c), F.lit("")) for c in ("content_html", "content") if c in have]
    rows = with_place(content).select(F.col("id").cast("string").alias("id"), F.coalesce(*parts, F.lit("")).alias("html"), *PLACE)
    if ids is not None:
        rows = rows.join(ids.select(F.col("id").cast("string").alias("id")).distinct(), "id", "left_semi")
    return dedup.first_of(rows, ["id"], [(F.col("html") == "").asc(), *(F.col(c).asc() for c in PLACE)]).select("id", "html")


@dataclass(frozen=True)
class Paths:
    """Where a run's tables lie."""

    root: str

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        return f"{self.root}/{name}"
