"""Session helpers: shared checkpoint folder, lineage cuts, cheap size checks.

Executors may be lost at any time and do not share local disks, so lineage is
cut only through files in the folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_KEY = "spark.checkpoint.dir"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the driver's JVM delete a folder of intermediates when it ends."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def shared_dir(spark: SparkSession) -> str:
    """Folder shared by driver and executors.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session without that
    setting (tests, notebooks) gets a temporary folder; on a cluster a missing
    setting is an error, because a machine-local folder would lose data.
    """
    sc = spark.sparkContext
    configured = sc.getConf().get(_KEY) or spark.conf.get(_KEY, None)
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
            delete_on_exit(spark, sc.getCheckpointDir())
        return configured
    if sc.getCheckpointDir() is not None:
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(f"set {_KEY} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="framequery-")
    atexit.register(shutil.rmtree, path, True)
    sc.setCheckpointDir(path)
    return path


#: Settings for the time of a step that is materialised: its shuffle files go as soon as it has ended, since nothing
#: reads them again, and Python workers get whole texts in batches of bounded size.
_STEP = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


#: Steps that run now in each session, and the settings before the first of them.
_RUNNING: dict[str, tuple[int, dict[str, str | None]]] = {}
_TURN = threading.Lock()


@contextmanager
def _step(spark: SparkSession) -> Iterator[None]:
    """The session as it was, but for the settings of a step; they are put back when its last step ends, also if threads share it."""
    session = spark._jsparkSession.sessionUUID()
    with _TURN:
        running, before = _RUNNING.get(session, (0, None))
        if before is None:
            before = {key: spark.conf.get(key, None) for key in _STEP}
            for key, value in _STEP.items():
                if not (key.endswith("maxRecordsPerBatch") and 0 < int(before[key] or 0) < int(value)):
                    spark.conf.set(key, value)
        _RUNNING[session] = running + 1, before
    try:
        yield
    finally:
        with _TURN:
            running, before = _RUNNING.pop(session)
            if running > 1:
                _RUNNING[session] = running - 1, before
            else:
                for key, value in before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with ``checkpoint()``: for small or medium results."""
    shared_dir(df.sparkSession)
    with _step(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def spill(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Like ``cut`` but columnar, compressed and prunable: for large intermediates
    that several later steps read with different columns.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    with _step(spark):
        df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint if it has so many (short) rows at most; else as it is, to be joined by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only reads files, or rows kept by ``cut``, with filters and JVM expressions: cheap to run twice."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.getClass().getSimpleName() in ("Project", "Filter"):
        plan = plan.children().head()
    return plan.getClass().getSimpleName() in ("LogicalRelation", "LogicalRDD", "DataSourceV2ScanRelation")


def free_name(base: str, taken) -> str:
    """``base``, or ``base`` with a suffix, so that no column of ``taken`` clashes."""
    lowered = {c.lower() for c in taken}
    name, k = base, 0
    while name.lower() in lowered:
        k += 1
        name = f"{base}_{k}"
    return name
