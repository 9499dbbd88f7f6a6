"""Helpers that the corpus operators share: reading, splits, shared-folder tables and a small union-find."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space (Java and DuckDB spelling).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null stays null."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a fresh local one where that is unset and the master is local."""
    given = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not given:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        given = tempfile.mkdtemp(prefix="ringwatch-")
        spark.sparkContext.setCheckpointDir(given)
    return given.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the table of a materialized DataFrame that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.written_to)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows (all, if fewer) picked by a hash of `key`: the same rows on every run."""
    n = df.count()
    if n <= most:
        return df
    span = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(span)) < int(span * most / n))


#: A key is hot above this share of all rows, and above so many rows: at most 1 / HOT_SHARE keys are.
HOT_SHARE, HOT_ROWS = 1 / 1000, 16


def hot_limit(rows: int) -> int:
    """Rows of a key above which it is hot in a table of so many rows."""
    return max(HOT_ROWS, int(rows * HOT_SHARE))


def join_skewed(rows: DataFrame, table: DataFrame, keys: list[str], hot: Column) -> DataFrame:
    """rows joined with a table that has one row per key. The table's rows where `hot` holds are broadcast, so that the
    rows of a hot key stay where they are; the others meet by a shuffle. The caller sees to it that few keys are hot:
    by hot_limit at most 1 / HOT_SHARE. Rows with a null key are dropped."""
    some = F.broadcast(table.filter(hot))
    rest = rows.join(some.select(*keys), keys, "left_anti").join(table.filter(~hot), keys)
    return rows.join(some, keys).unionByName(rest)


def with_least(rows: DataFrame, key: str, value: str, name: str, n: int) -> DataFrame:
    """The n rows with the least value of their key as a new column. Minima are combined before the shuffle, and no
    key's rows meet in one task."""
    least = rows.groupBy(key).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("_rows"))
    return join_skewed(rows, least, [key], F.col("_rows") > hot_limit(n)).drop("_rows")


class Forest:
    """Union-find over positions 0..n-1 fed with numpy edge arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[i], label[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while True:
                flat = label[label]
                if (flat == label).all():
                    break
                label[:] = flat

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """One (member, smallest position of its group) per member that isn't the smallest."""
        i = np.flatnonzero(self.label != np.arange(len(self.label)))
        return i, self.label[i]
