"""Written tables that cut lineage, in the folder all executors share.

The folder is the one the session names in ``spark.checkpoint.dir``. Where that is unset, a local session
gets a temporary folder of its own; a cluster without it is refused, as executors would not see each other's files.
Tables are left until the driver's process ends, since a returned DataFrame may still read them.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for written tables."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="murmurate-")
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/murmurate/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet and read back: later stages and retries start from the files."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark's setting for the rows that a task decodes at once from Parquet; 4096 unless it is set.
BATCH_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """What is written inside reads Parquet by so few rows, as a batch of whole texts lies in the executor's memory in one piece."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, min(rows, int(before)))
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


@atexit.register
def _remove() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  the session may be gone already; the cluster clears the folder then
            return
