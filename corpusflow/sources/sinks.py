"""Sinks. Spark's commit protocol writes a table whole or not at all."""

from __future__ import annotations

import json
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Records of a submission that the driver holds at most; it has one per question.
MOST_RECORDS = 100_000


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_failures(df: DataFrame, path: str) -> bool:
    """JSON lines, unescaped UTF-8; nothing is written when there is no failure."""
    if not df.limit(1).count():
        return False
    df.write.mode("overwrite").json(path)
    return True


def append_summaries(df: DataFrame, path: str, seq: int) -> None:
    """Appends chunk_id, short, key to the log; ``seq`` orders this append after earlier ones."""
    df.select("chunk_id", "short", "key").withColumn("seq", F.lit(seq).cast("long")).write.mode("append").json(path)


def write_submission(results: DataFrame, folder: str) -> Path:
    """results.json, a JSON array ordered by id, and submission.zip with it at its root. A few records, on the driver's disk."""
    rows = results.orderBy("id").limit(MOST_RECORDS + 1).collect()
    if len(rows) > MOST_RECORDS:
        raise ValueError(f"a submission has {MOST_RECORDS} records at most")
    at = Path(folder)
    at.mkdir(parents=True, exist_ok=True)
    (at / "results.json").write_text(json.dumps([r.asDict(recursive=True) for r in rows], ensure_ascii=False, indent=1), encoding="utf-8")
    with zipfile.ZipFile(at / "submission.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.write(at / "results.json", "results.json")
    return at / "submission.zip"
