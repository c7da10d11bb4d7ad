"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import atexit
import contextlib
import functools
import re
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Jobs that run at once.
SIDE_BY_SIDE = 4
_local: list[str] = []
_made: dict[str, SparkSession] = {}
#: The tables of this thread that ``cleared`` deletes.
_here = threading.local()
#: Whether Spark deletes a query's shuffle files when it ends; else they wait for the driver to collect garbage.
_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_releasing = threading.Lock()
_releases: dict[SparkSession, tuple[int, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where that is unset and all run on one machine.

    Raises RuntimeError on a cluster without one, as no other folder is known to be shared.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="graphloom-"))
    return f"file://{_local[0]}"


@contextlib.contextmanager
def released(spark: SparkSession):
    """Queries that are begun within leave no shuffle files behind; afterwards the session's setting is what it was."""
    with _releasing:
        depth, before = _releases.get(spark, (0, ""))
        if not depth:
            before = spark.conf.get(_RELEASE)
            spark.conf.set(_RELEASE, "true")
        _releases[spark] = depth + 1, before
    try:
        yield
    finally:
        with _releasing:
            depth, before = _releases.pop(spark)
            if depth > 1:
                _releases[spark] = depth - 1, before
            else:
                with contextlib.suppress(Exception):  # a session that has ended
                    spark.conf.set(_RELEASE, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _made[path] = df.sparkSession
    if getattr(_here, "depth", 0):
        _here.paths.append(path)
    with released(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._graphloom_path = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df`` as ``written`` makes it, and its number of rows, counted while they are written."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    return out, seen.get.get("rows") or 0


def together(*writes: Callable[[], object]) -> None:
    """Runs jobs that don't depend on each other side by side; raises what the first that failed raised."""
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        for done in [pool.submit(w) for w in writes]:
            done.result()


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _made.pop(name, None)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._graphloom_path)


def cleared(work):
    """Decorates a method whose result is elsewhere: the tables that its thread writes meanwhile are deleted, but for those
    that ``keep`` spares."""

    @functools.wraps(work)
    def run(*args, **kwargs):
        _here.depth = getattr(_here, "depth", 0) + 1
        before, _here.paths = getattr(_here, "paths", []), []
        try:
            return work(*args, **kwargs)
        finally:
            for path in _here.paths:
                if path in _made:
                    _delete(_made[path], path)
            _here.paths, _here.depth = before, _here.depth - 1

    return run


def keep(df: DataFrame) -> DataFrame:
    """``df``, a table made by ``written``, which stays when the method that is ``cleared`` ends."""
    if getattr(_here, "depth", 0):
        _here.paths.remove(df._graphloom_path)
    return df


@atexit.register
def _clear() -> None:
    """Deletes what is left of a driver that ends, as far as its session still runs."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):
            if spark.sparkContext._jsc is None:
                break
            _delete(spark, path)
    for folder in _local:
        shutil.rmtree(folder, ignore_errors=True)
