"""Session helpers: shipping the package to executors and the shared work folder."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_runscope_shipped"


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package, once per session."""
    sc = spark.sparkContext
    if getattr(sc, _SHIPPED, False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="runscope-ship-")) / "runscope_pkg.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    setattr(sc, _SHIPPED, True)


#: Bytes that Spark hands to a Python worker at once.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to BATCH_BYTES at most.

    For an application to call: whole texts come and go in several copies, and with
    batches of 64 MB (the default) the workers of an executor need a gigabyte more.
    The library's own functions leave the session's settings alone.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def work_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named by ``spark.checkpoint.dir``, or the context's checkpoint
    folder.  Where neither is set a temporary folder takes its place on one machine
    (a local master); on a cluster that raises, as executors would not see it.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="runscope-ckpt-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir() or root
    return root.rstrip("/")


#: The paths that the innermost ``scratch`` of this thread has to remove.
_scope: contextvars.ContextVar[set[str] | None] = contextvars.ContextVar("runscope_scratch", default=None)


def _written(spark: SparkSession) -> dict[str, object]:
    """The tables of this context that nothing has removed yet, by path; they go when the driver ends."""
    sc = spark.sparkContext
    if not hasattr(sc, "_runscope_written"):
        sc._runscope_written = {}
        atexit.register(_remove_all, sc._runscope_written)
    return sc._runscope_written


def _remove_all(written: dict[str, object]) -> None:
    for path in list(written):
        remove = written.pop(path, None)
        with contextlib.suppress(Exception):  # the virtual machine may be gone before the driver
            if remove:
                remove()


def scratch_path(spark: SparkSession, name: str, also: Callable[[], None] | None = None) -> str:
    """A new path in the shared folder; what is written there is removed when the driver ends, or by the ``scratch`` that it was made in.

    ``also`` is called before the removal.
    """
    folder = f"{work_dir(spark)}/runscope-{uuid.uuid4().hex[:12]}"
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    conf = spark._jsc.hadoopConfiguration()
    path = f"{folder}/{name}"

    def remove() -> None:
        if also:
            also()
        target.getFileSystem(conf).delete(target, True)

    _written(spark)[path] = remove
    if (own := _scope.get()) is not None:
        own.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` once as Parquet in the shared folder and reread it.

    A lost executor never loses the table, and every later reader starts from
    the files instead of recomputing what stands above.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Removes at its end what was written within it, but for the tables that data frames handed to the function it gives read.

    A path belongs to the ``scratch`` of the thread that made it: what other threads
    write meanwhile stays.  Tables that are kept pass to the ``scratch`` around this one.
    """
    folder = re.compile(r"/(runscope-[0-9a-f]{12})/")
    own, kept = set(), set()
    outer = _scope.get()
    token = _scope.set(own)
    try:
        yield lambda df: kept.update(folder.search(f)[1] for f in df.inputFiles() if folder.search(f))
    finally:
        _scope.reset(token)
        stay = {p for p in own if folder.search(p)[1] in kept}
        if outer is not None:
            outer |= stay
        for path in own - stay:
            if remove := _written(spark).pop(path, None):
                remove()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, in whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet") if "://" not in sf_dir else f"{sf_dir}/{name}.parquet")
