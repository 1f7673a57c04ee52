"""What the operators share: words, tables in the shared folder, checked broadcasts."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. On UTF-8 bytes, bytes.split() cuts the same way.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a batch that goes to Python while an operator's steps run: whole documents come in it, on both sides.
BATCH_ROWS = 512
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: What a step shuffles goes when the step is written, not when the driver happens to collect its garbage: no later step reads it.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock = threading.Lock()
_settings: dict[int, tuple[int, dict[str, str | None]]] = {}  # session: operators at work, its settings of _BATCH and _CLEAN before
_results: dict[int, list[str]] = defaultdict(list)  # session: tables of lasting()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a local session gets a temporary one; a cluster must name it, for its machines share no temporary folder."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quern-checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def _written(df: DataFrame) -> tuple[str, DataFrame]:
    path = f"{shared_folder(df.sparkSession)}/quern-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path, df.sparkSession.read.schema(df.schema).parquet(path)


def _session(spark: SparkSession) -> int:
    return spark._jsparkSession.hashCode()


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def lasting(df: DataFrame) -> DataFrame:
    """`df`, computed once and written to the shared folder, for results whose steps are deleted before they are read. release() or Spark's exit deletes it."""
    path, kept = _written(df)
    files, where = _files(df.sparkSession, path)
    files.deleteOnExit(where)
    with _lock:
        _results[_session(df.sparkSession)].append(path)
    return kept


def release(spark: SparkSession) -> int:
    """Deletes the tables behind all results that this session's operators have returned, and says how many.

    For long sessions, once results are written out or collected: frames returned before cannot be read after it.
    """
    with _lock:
        paths = _results.pop(_session(spark), [])
    for path in paths:
        files, where = _files(spark, path)
        files.delete(where, True)
        files.cancelDeleteOnExit(where)
    return len(paths)


class Scratch:
    """Tables in the shared folder for the steps of one operator, as compressed Parquet: lineage ends there, and a lost executor takes nothing along.

    with Scratch(spark) as scratch: what is kept in it goes at the end of the block, so what leaves the block must not read it.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame) -> DataFrame:
        path, kept = _written(df)
        self.paths[id(kept)] = (path, kept)
        return kept

    def drop(self, *frames: DataFrame) -> None:
        for frame in frames:
            self._delete(self.paths.pop(id(frame))[0])

    def _delete(self, path: str) -> None:
        files, where = _files(self.spark, path)
        files.delete(where, True)

    def __enter__(self) -> Scratch:
        with _lock:  # the first of a session's operators changes the settings, the last one resets them
            conf = self.spark.conf
            count, before = _settings.get(_session(self.spark), (0, {}))
            if not count:
                before = {_BATCH: conf.get(_BATCH), _CLEAN: conf.get(_CLEAN, None)}
                conf.set(_BATCH, str(min(BATCH_ROWS, max(int(before[_BATCH]), 0) or BATCH_ROWS)))
                conf.set(_CLEAN, "true")
            _settings[_session(self.spark)] = (count + 1, before)
        return self

    def __exit__(self, *_) -> None:
        with _lock:
            count, before = _settings.pop(_session(self.spark))
            if count > 1:
                _settings[_session(self.spark)] = (count - 1, before)
            else:
                for key, value in before.items():
                    if value is None:
                        self.spark.conf.unset(key)
                    else:
                        self.spark.conf.set(key, value)
        for path, _frame in self.paths.values():
            self._delete(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, which must be cheap to count, marked for broadcast if it has at most `rows` rows; beyond that a shuffled join is left to Spark."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def uniform(*columns: Column) -> Column:
    """A number in [0, 1) that depends only on the columns, so that reruns and lost tasks agree."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11) / F.lit(float(2**53))
