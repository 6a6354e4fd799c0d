"""Intermediate tables: written to the folder that all executors share, and deleted when a run is over."""

from __future__ import annotations

import atexit
import functools
import hashlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _own_dir() -> str:
    """For local sessions that name none; it goes with this process."""
    path = tempfile.mkdtemp(prefix="notewright-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where that is unset a local session gets a folder of its own; on a cluster it is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        in_code = spark.sparkContext._jsc.sc().getCheckpointDir()
        if in_code.isDefined():
            named = in_code.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = _own_dir()
        else:
            raise ValueError("spark.checkpoint.dir is unset: on a cluster it has to name a folder that the driver and all executors share")
    return named.rstrip("/")


#: Rows of a few numbers that make a file.
FILE_ROWS = 200_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows that go to Python at once; the default of 10,000 texts is a lot beside an executor's other memory.
BATCH_ROWS = 512


def lean(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows if they are larger.  Operators call it, as their plans run later."""
    if int(spark.conf.get(_BATCH)) > BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def files_mark(spark: SparkSession, *paths: str) -> str:
    """A short text that changes with the files of some tables: their names, lengths and times."""
    jvm, seen = spark.sparkContext._jvm, []
    for path in paths:
        place = jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.listStatus(place))
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


def delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The tables of one run, in a folder of their own.

    A table cuts its lineage: lost executors cost only their own tasks.  Those of a run that its result no longer
    needs can be deleted one by one; a result that is itself written lets all the others go.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/notewright/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, None] = {}
        self.made = 0

    def write(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """rows: about how many there are, so that a small table is not cut into as many files as a shuffle has partitions."""
        if rows is not None:
            df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
        path = f"{self.root}/{self.made}-{name}"
        self.made += 1
        self.paths[path] = None
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._notewright_path = path  # type: ignore[attr-defined]
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for t in tables:
            self._delete(t._notewright_path)  # type: ignore[attr-defined]

    def drop_all_but(self, *tables: DataFrame) -> None:
        stay = {t._notewright_path for t in tables}  # type: ignore[attr-defined]
        for path in [p for p in self.paths if p not in stay]:
            self._delete(path)

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the result, and deletes all other tables of the run."""
        out = self.write(df, name)
        self.drop_all_but(out)
        return out

    def _delete(self, path: str) -> None:
        self.paths.pop(path, None)
        delete(self.spark, path)
