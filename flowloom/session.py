"""Session defaults and durable intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "flowloom", master: str | None = None, **conf) -> SparkSession:
    """SparkSession with the settings the library is tuned for; callers may override any."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session's executors, once a session."""
    context = spark.sparkContext
    if getattr(context, "_flowloom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="flowloom-code-"), "flowloom-code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._flowloom_shipped = True


def _shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a new one where the driver is the only machine."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="flowloom-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


_scope: ContextVar[str | None] = ContextVar("flowloom_scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A scope for intermediate tables: what ``durable`` and ``scratch_path`` make inside goes when the scope ends.

    Results that are still to be read from such tables must be written before the end::

        with scratch(spark):
            write_flow_csv(flow_features(packets), target)
    """
    folder = f"{_scope.get() or _shared_folder(spark).rstrip('/')}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield folder
    finally:
        _scope.reset(token)
        remove(spark, folder)


def _path_of(spark: SparkSession, path: str):
    """The file system of a path and the path, as Spark's own readers see them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder that this library has made; none there is no error."""
    fs, at = _path_of(spark, path)
    fs.delete(at, True)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, at = _path_of(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def files_in(spark: SparkSession, path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of a folder whose names end so, in the order of names."""
    fs, at = _path_of(spark, path)
    found = [(f.getPath(), f.getLen()) for f in fs.listStatus(at) if not f.isDirectory()] if fs.exists(at) else []
    named = [(p.toString(), n) for p, n in found if p.getName().endswith(endings) or fs.getFileStatus(at).isFile()]
    return sorted((p.removeprefix("file:") if p.startswith("file:/") else p, n) for p, n in named)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replaces a small file as a whole: readers see the old text or the new one."""
    fs, at = _path_of(spark, path)
    part = at.suffix(f".{uuid.uuid4().hex}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at):
        fs.delete(at, False)
    if not fs.rename(part, at):
        raise OSError(f"can't write {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, None if it isn't there."""
    fs, at = _path_of(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def durable(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it back.

    Used where several later steps read one expensive result; as a columnar table each reader
    loads only what it needs. Without a shared folder on a cluster this is an error. The table goes with the
    ``scratch`` scope around the call; outside any scope it stays until the shared folder is cleared. ``compression`` is that of
    Parquet, by default the session's.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name on storage that every executor can reach, inside the current ``scratch`` scope if any."""
    return f"{_scope.get() or _shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
