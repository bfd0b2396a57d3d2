"""Tables staged in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
#: Paths staged inside each open ``scratch``.
_OPEN: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir`` of the session.  Only where that is unset and the session
    runs in one JVM (tests), a temporary folder takes its place; on a cluster that is an error.
    """
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="needlework-")
    return _LOCAL_DIRS[context.applicationId]


def new_path(spark: SparkSession, label: str) -> str:
    """A path in this application's part of the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/needlework/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back; ``drop`` removes it again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    if _OPEN:
        _OPEN[-1].append(path)
    df.write.parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._needlework_path = path
    return staged


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop(*staged: DataFrame) -> None:
    """Remove staged tables that no plan will read again; other tables are left alone."""
    for df in staged:
        path = getattr(df, "_needlework_path", None)
        if path:
            _delete(df.sparkSession, path)
            del df._needlework_path


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is staged meanwhile goes at the end: write the result elsewhere before, by ``write`` or inside ``kept``."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            _delete(spark, path)


def kept(df: DataFrame, label: str) -> DataFrame:
    """``stage``, but not for the scratch that is open."""
    staged = stage(df, label)
    if _OPEN:
        _OPEN[-1].remove(staged._needlework_path)
    return staged


def clean(spark: SparkSession) -> None:
    """Remove all that this application has staged, once its results are written elsewhere."""
    _delete(spark, f"{shared_dir(spark)}/needlework/{spark.sparkContext.applicationId}")
