"""Tables between the steps of a plan, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

#: Paths saved in the temporary() that is open in this thread or task, if any, with the session they belong to.
_open: ContextVar[tuple[int, list[str]] | None] = ContextVar("open", default=None)
#: Paths saved outside of any, by session.
_kept: dict[int, list[str]] = {}
_lock = Lock()


def _session(spark: SparkSession) -> int:
    return spark._jsparkSession.hashCode()


def _paths(spark: SparkSession) -> list[str]:
    """The list that a new path of a session goes to: another thread's or another session's is never this one."""
    session, group = _session(spark), _open.get()
    return group[1] if group and group[0] == session else _kept.setdefault(session, [])


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  Where that is unset, a local master gets one of its own;
    on a cluster that is an error, since executors don't see each other's disks."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="linework-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing stands under."""
    path = f"{shared_dir(spark)}/linework/{name}-{uuid.uuid4().hex}"
    with _lock:
        _paths(spark).append(path)
    return path


def put(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet under path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def save(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet: what uses it several times doesn't compute it again, and a lost
    executor costs no more than the step at hand.  It stays until its temporary() ends or clear()."""
    return put(df, fresh_path(df.sparkSession, name))


#: Rows of a saved table up to which joins may send it to every task.
FEW_ROWS = 100_000


def sized(saved: DataFrame) -> DataFrame:
    """A saved table of few columns that asks for the join its rows call for: by its files' size, which are compressed, Spark would
    broadcast millions of rows, and it shuffles what it meets before it knows that a table is small."""
    return saved.hint("broadcast" if saved.count() <= FEW_ROWS else "merge")


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete saved tables that nothing reads any more; the lists of the session and of the open temporary() forget them."""
    _delete(spark, list(paths))
    group = _open.get()
    with _lock:
        for held in (_kept.get(_session(spark), []), group[1] if group else []):
            held[:] = [p for p in held if p not in paths]


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside, by this thread and session, are removed at the end: what is needed later must have been put()
    elsewhere.  Blocks may be nested."""
    group: list[str] = []
    token = _open.set((_session(spark), group))
    try:
        yield
    finally:
        _open.reset(token)
        _delete(spark, group)


def clear(spark: SparkSession) -> None:
    """Remove every table that the session has saved outside of temporary(); results not yet collected can't be read after it."""
    with _lock:
        paths = _kept.pop(_session(spark), [])
    _delete(spark, paths)
