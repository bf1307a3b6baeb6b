"""Sessions, shipping this package to executors that don't have it, and folders that all executors see."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Folders that an application has made, in order.
_MADE: dict[str, list[str]] = {}
#: Most bytes of an Arrow batch where the session says nothing; a batch has a copy or two on both sides of the socket.
ARROW_BYTES = 8 << 20


def builder(master: str = "local[*]", shuffle_partitions: int = 8) -> SparkSession.Builder:
    return (
        SparkSession.builder.master(master)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.cteRecursionLevelLimit", "-1")  # a version may have any number of ancestors
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )


def ship(spark: SparkSession) -> None:
    """Gives the executors' Python this package, once an application, and bounds Arrow batches where the session doesn't."""
    app = spark.sparkContext.applicationId
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) in ("67108864b", str(64 << 20)):  # the default
        spark.conf.set(key, str(ARROW_BYTES))
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="palimpsest-")) / "palimpsest.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    spark.sparkContext.addPyFile(str(to))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that all executors see, under ``spark.checkpoint.dir``.

    Where that is unset a local session gets a temporary folder; on a cluster that is an error, since no executor would
    see the others' files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='palimpsest-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/palimpsest/{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> int:
    """How many shared folders this application has made and not discarded."""
    return len(_MADE.get(spark.sparkContext.applicationId, []))


def discard(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Removes the shared folders made since ``made`` gave that number, but those of ``keep``.

    Frames that read them can't be used any more; write what is wanted of them first.
    """
    own = _MADE.get(spark.sparkContext.applicationId, [])
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in own[since:]:
        if path not in keep:
            to = jvm.org.apache.hadoop.fs.Path(path)
            to.getFileSystem(conf).delete(to, True)
    own[since:] = [p for p in own[since:] if p in keep]
