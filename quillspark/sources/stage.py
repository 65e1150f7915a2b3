"""Stage boundaries: tables that a later step reads more than once are written to the shared folder."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a query's shuffle files are removed at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: list[str] = []
_registered: list = []
_lock = threading.Lock()
#: Writes under way, by application, and what the setting was before the first of them.
_cleaning: dict[str, tuple[int, str]] = {}
#: Open scopes of each thread.
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where it is unset and the master is local."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; what is there goes when the session's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _registered:
        _registered.append(atexit.register(_remove))
    _written.append(path)
    return path


@contextmanager
def _clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go with their query inside; writes in other threads may overlap, the last one restores the setting."""
    own = spark.sparkContext.applicationId
    with _lock:
        n, before = _cleaning.get(own, (0, spark.conf.get(CLEANUP, "false")))
        _cleaning[own] = n + 1, before
        spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            n, before = _cleaning[own]
            if n > 1:
                _cleaning[own] = n - 1, before
            else:
                del _cleaning[own]
                spark.conf.set(CLEANUP, before)


def staged(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` written and read again. Plans above stay small, and lost executors cost no recomputation of what is below.

    The shuffle files of the write go when it ends: nothing but the table is read later.
    """
    path = new_path(df.sparkSession, name)
    with _clean_shuffles(df.sparkSession):
        df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    scopes = getattr(_scopes, "open", [])
    if scopes:
        scopes[-1].tables.append(out)
    return out


class Scope:
    """Tables staged while a scope is open; all but those that are kept go when it ends."""

    def __init__(self) -> None:
        self.tables: list[DataFrame] = []

    def keep(self, *tables: DataFrame) -> None:
        """Leave tables to the scope around this one, or to the session."""
        mine = {t._staged_at for t in tables}
        self.tables = [t for t in self.tables if t._staged_at not in mine]
        if len(_scopes.open) > 1:
            _scopes.open[-2].tables.extend(tables)


@contextmanager
def scope() -> Iterator[Scope]:
    """Delete at its end what was staged inside by this thread. What the block returns must not read those tables any more."""
    if not hasattr(_scopes, "open"):
        _scopes.open = []
    own = Scope()
    _scopes.open.append(own)
    try:
        yield own
    finally:
        _scopes.open.pop()
        discard(*[t for t in own.tables if t._staged_at in _written])


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that no later step reads."""
    for df in tables:
        if df._staged_at in _written:
            _written.remove(df._staged_at)
        _delete(df.sparkSession, df._staged_at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    spark = SparkSession.getActiveSession()
    while spark is not None and _written:
        try:
            _delete(spark, _written.pop())
        except Exception:  # the session ended meanwhile
            return
