"""Tables written between steps.

A step that is read several times, or that a driver loop builds on, is written to the shared
folder the cluster names. Losing executors then costs nothing that was already computed, the
plan stays short, and later reads take only the columns they need.
"""

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_rows: "WeakKeyDictionary[DataFrame, int]" = WeakKeyDictionary()
_paths: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only for a local master."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="pressroom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return own


def keep(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it from there."""
    return keep_in_files(df, 0)


def keep_in_files(df: DataFrame, file_rows: int) -> DataFrame:
    """``keep``; with ``file_rows`` no file has more rows.

    Spark reads files by their bytes, so of a table of a few bytes a row one task
    reads tens of millions, and holds them all where it deals them into more parts than it can write side by side.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pressroom-{uuid.uuid4().hex}"
    counted = Observation()
    _paths.append(path)
    df.observe(counted, F.count(F.lit(1)).alias("rows")).write.option("maxRecordsPerFile", file_rows).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    rows = counted.get["rows"]
    if not spark.sparkContext.master.split("[")[0] == "local":
        check_rows(stored, rows, path)
    _rows[stored] = rows
    return stored


def check_rows(stored: DataFrame, rows: int, path: str) -> None:
    """Fail if a table read back lacks rows: then the executors do not share the folder it lies in."""
    found = stored.count()
    if found < rows:
        raise RuntimeError(f"{rows} rows were written to {path}, {found} are there: is the folder shared?")


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Delete the tables stored within this block when it ends; write what is to last before that."""
    before = len(_paths)
    try:
        yield
    finally:
        files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for path in _paths[before:]:
            place = files(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        del _paths[before:]


def stored_rows(df: DataFrame) -> int | None:
    """How many rows a table from ``keep`` has; None for any other."""
    return _rows.get(df)
