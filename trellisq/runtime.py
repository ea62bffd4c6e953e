"""Lineage cuts: tables written into the checkpoint folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a local temporary one only in local mode without it."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
    named = "file://" + tempfile.mkdtemp(prefix="trellisq-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


#: Folders of this program's calls, removed when it ends.
_roots: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    for spark, root in _roots:
        try:
            delete(spark, root)
        except Exception:  # noqa: BLE001 - the session has ended before; the folder is left to the cluster
            return


class Scratch:
    """Written intermediate tables of one operator call.

    ``cut`` writes a table and reads it back, so that an iterative plan stays short and a lost executor
    costs one stage. ``drop`` removes a table that a later one has replaced.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        _roots.append((spark, self.root))
        self.n = 0
        self.paths: dict[int, str] = {}
        self.kept: list[DataFrame] = []

    def cut(self, df: DataFrame, replaces: DataFrame | None = None) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:04d}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        self.kept.append(out)  # so that its id stays its own
        if replaces is not None:
            self.drop(replaces)
        return out

    def cut_counted(self, df: DataFrame, where: str = "true", replaces: DataFrame | None = None) -> tuple[DataFrame, int]:
        """A cut with its number of rows for which a condition holds, counted while it is written."""
        seen = Observation()
        out = self.cut(df.observe(seen, F.count_if(F.expr(where)).alias("n")), replaces)
        return out, seen.get["n"]

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path is not None:
            delete(self.spark, path)

    def finish(self, result: DataFrame) -> DataFrame:
        """The result, which reads some of the tables; all others are removed now, these when the program ends."""
        read = {f.rpartition("/")[0].rpartition("/")[2] for f in result.inputFiles() if f"/{self.root.rpartition('/')[2]}/" in f}
        for key, path in list(self.paths.items()):
            if path.rpartition("/")[2] not in read:
                del self.paths[key]
                delete(self.spark, path)
        self.kept.clear()
        return result
