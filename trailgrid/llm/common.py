"""What the operators of this subpackage share: reading, cutting lineage, hashing and columns."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session whose executors are threads of the driver gets a folder of its own; any other
    session is refused, because its executors could not read what the driver's disk holds.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='trailgrid-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Parquet files in the shared folder. They cut lineage: a lost executor costs only the stage that runs.

    keep() writes a frame and reads it back; drop() removes what no later plan reads. What a returned frame
    still reads stays until the caller has consumed the frame; clear() then removes the folder, and a cluster
    that never calls it must empty spark.checkpoint.dir between jobs, as with Spark's own checkpoints.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        to = f"{self.at}/{name}"
        df.write.mode("overwrite").parquet(to)
        return self.spark.read.schema(df.schema).parquet(to)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def clear(self) -> None:
        self.drop("")

    def release(self) -> None:
        """Lets Spark drop the shuffle files of frames that nothing refers to any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], total: int, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key and `n`, how many rows of left have it; how: inner or left; n goes.

    Keys with over a 512th of left's rows (and 1000) are fewer than 512, so their side is broadcast and their rows stay
    where they are, spread over all tasks; null keys, which meet nothing, stay too. Only the rest is shuffled by key.
    """
    limit = max(1000, total // 512)
    hot, rest = F.broadcast(right.where(F.col("n") > limit).drop("n")), right.where(F.col("n") <= limit).drop("n")
    known = left.where(" and ".join(f"{k} is not null" for k in keys))
    out = known.join(hot, keys).unionByName(known.join(hot.select(*keys), keys, "left_anti").join(rest, keys, how))
    return out.unionByName(left.where(" or ".join(f"{k} is null" for k in keys)), allowMissingColumns=True) if how == "left" else out


def tidy(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A function over batches that gives its memory back to the system when a partition ends: workers live on, and the
    next stage's heap needs the room."""

    @functools.wraps(run)
    def tidied(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    """The words of a text as WORD has them; str.split() would also cut at other white space."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_SPACES).split(" ") if w]


_SPACES = {c: " " for c in (9, 10, 11, 12, 13)}


def word_count(text) -> F.Column:
    """Number of words of a text column; null has none."""
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def unit(*cols) -> F.Column:
    """A number in [0, 1) from a hash of the columns."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11)).cast("double") / F.lit(float(1 << 53))
