"""Scratch tables in the folder that driver and executors share. They cut lineage: a lost executor costs no more than its own tasks."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._conf.get("corpusflow.scratch")
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="corpusflow-")
        sc._conf.set("corpusflow.scratch", path)
    return path.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables written to the shared folder; what is left of them goes when the process ends."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str):
        Scratch.opened.append(self)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count, self.live = 0, set()
        atexit.register(self._quiet_drop)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/t{self.count}"
        self.count += 1
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.live.add(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result reads any more."""
        for t in tables:
            drop_path(self.spark, t.scratch_path)
            self.live.discard(t.scratch_path)

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        for path in self.live - {t.scratch_path for t in tables}:
            drop_path(self.spark, path)
        self.live = {t.scratch_path for t in tables}

    def close(self) -> None:
        """Delete all tables. Results that still read them can't be worked out any more."""
        drop_path(self.spark, self.root)
        self.live = set()
        Scratch.opened.remove(self)
        atexit.unregister(self._quiet_drop)

    def _quiet_drop(self) -> None:
        try:
            drop_path(self.spark, self.root)
        except Exception:  # the session may be gone by now  # noqa: BLE001
            pass


@contextmanager
def closed_after() -> Iterator[None]:
    """Scratch tables that operators open within go at the end: for results that are written by then."""
    before = list(Scratch.opened)
    yield
    for s in [x for x in Scratch.opened if x not in before]:
        s.close()
