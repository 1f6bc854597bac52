"""Session plumbing shared by the corpus operators."""

from __future__ import annotations

import atexit
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of whole documents that one Arrow batch holds at most.
ROWS_PER_BATCH = 400

#: A side with at most this many narrow rows (about 16 bytes each) may be broadcast.
BROADCAST_ROWS = 1_000_000

#: Spark's setting to delete the files of a query's shuffles when it ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: The white space that separates words: U+0020 and U+0009 to U+000D.
BLANKS = " \t\n\x0b\f\r"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python and bound Arrow batches; harmless when repeated."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_PER_BATCH))
    sc = spark.sparkContext
    if getattr(sc, "_emberline_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    place = os.path.join(tempfile.mkdtemp(), "emberline_package.zip")
    Path(place).write_bytes(data.getvalue())
    sc.addPyFile(place)  # served by the driver; executors fetch it
    sc._emberline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    sc = spark.sparkContext
    if not getattr(sc, "_emberline_dir", None):
        sc._emberline_dir = "file://" + tempfile.mkdtemp(prefix="emberline-")
    return sc._emberline_dir


class Scratch:
    """Tables written under the shared folder; they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def keep(self, df: DataFrame, tag: str, options: dict[str, str] | None = None) -> DataFrame:
        """df, written with Parquet's options and read again. Its shuffles' files go at once."""
        path = f"{self.root}/{tag}"
        before = self.spark.conf.get(CLEAN_UP, None)
        self.spark.conf.set(CLEAN_UP, "true")
        try:
            df.write.mode("overwrite").options(**options or {}).parquet(path)
        finally:
            self.spark.conf.set(CLEAN_UP, before) if before is not None else self.spark.conf.unset(CLEAN_UP)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tags: str) -> None:
        for tag in tags:
            self._delete(f"{self.root}/{tag}")

    def close(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session has ended; the folder's owner clears it
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, to be broadcast if a count shows that it is small enough; otherwise Spark joins it by shuffle."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text, blanks: str = BLANKS):
    """Array of a text's words; a null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(blanks))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def bind(value, body):
    """body(value) with value evaluated once, also where body uses it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one, that df has no column of."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name
