"""Session defaults, table loading and the shared folder for written tables."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
#: Tables below this size are worth spreading.
SMALL_BYTES = 64 << 20
#: The setting for the bytes of an Arrow batch, and what is used where a session does not set it.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
#: Folders of our own by application, for local sessions without a shared folder.
_OWN: dict[str, str] = {}
#: What ``stored`` has built, by application and name.
_STORED: dict[tuple[str, str], tuple[Any, list[str]]] = {}
#: Written tables of the scopes that are open, innermost last.
_SCOPES: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the folder ``sf_dir``, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores, for steps that cost far more than moving it: a small file is read by one task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else df


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session sends Arrow batches of a bounded size from now on, unless it has a setting of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_SETTING, None) is None:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``). Where it is unset, a local session (one machine) gets a
    folder of our own that goes with the process; on a cluster that would not be shared, so it is an error."""
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder there that the driver and all executors share")
    if context.applicationId not in _OWN:
        folder = tempfile.mkdtemp(prefix="loomwright-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[context.applicationId] = f"file://{folder}"
    return _OWN[context.applicationId]


def _on_disk(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, label: str, compact: bool = True) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors
    and gives the planner true sizes, so that joins broadcast only what has been measured.
    ``compact`` first gathers small partitions, so that a small table is not a file per task.

    The table goes with the ``scratch`` scope that is open, or at the latest with the driver's process."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/loomwright-{spark.sparkContext.applicationId}"
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if compact else df).write.parquet(path)
    files, where = _on_disk(spark, root)
    files.deleteOnExit(where)
    if _SCOPES:
        _SCOPES[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, name: str, build: Callable[[], T]) -> T:
    """What ``build`` writes, once per application and name; for tables that do not change while it runs. Outlives
    all scopes; built again if its files are gone."""
    key = spark.sparkContext.applicationId, name
    if key in _STORED:
        found, paths = _STORED[key]
        if all(files.exists(where) for files, where in (_on_disk(spark, p) for p in paths)):
            return found
    open_, paths = _SCOPES[:], []
    _SCOPES[:] = [paths]
    try:
        _STORED[key] = build(), paths
    finally:
        _SCOPES[:] = open_
    return _STORED[key][0]


class Scratch:
    """The tables written inside a ``scratch`` scope."""

    def __init__(self, paths: list[str]):
        self._paths = paths

    def keep(self, df: DataFrame, label: str, compact: bool = True) -> DataFrame:
        """``df`` written as a table that outlives the scope."""
        out = materialise(df, label, compact)
        path = self._paths.pop()
        if len(_SCOPES) > 1:
            _SCOPES[-2].append(path)
        return out


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Removes the tables that are written inside, but for those kept. What leaves the scope must not read them."""
    paths: list[str] = []
    _SCOPES.append(paths)
    try:
        yield Scratch(paths)
    finally:
        _SCOPES.pop()
        for path in paths:
            files, where = _on_disk(spark, path)
            files.delete(where, True)
