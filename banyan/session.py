"""Session settings, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(cores: int = 8, memory: str = "16g", **conf: str) -> SparkSession:
    """A local session with the settings that tests and bench use."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("banyan")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, wherever the driver was started."""
    sc, root = spark.sparkContext, str(Path(__file__).resolve().parents[1])
    paths = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), *sc.environment.get("PYTHONPATH", "").split(os.pathsep)]
    if root in paths:
        return
    sc.environment["PYTHONPATH"] = os.pathsep.join([root, *(p for p in paths if p)])
    if not sc.master.startswith("local["):  # executors may not see the driver's disk
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "banyan"), "zip", root, "banyan"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local one is made only for a local master where the session names none."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="banyan-checkpoint-")
        atexit.register(shutil.rmtree, at, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def _drop(path: str) -> None:
    if path.startswith("file:") or path.startswith("/"):
        shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)
        return
    import pyarrow.fs as pafs

    fs, q = pafs.FileSystem.from_uri(path)
    if fs.get_file_info(q).type != pafs.FileType.NotFound:
        fs.delete_dir(q)


_scratch: set[str] = set()


def scratch_dir(spark: SparkSession) -> str:
    """A folder within the shared one for this application's tables; it is removed when the driver ends."""
    at = f"{shared_dir(spark)}/banyan-{spark.sparkContext.applicationId}"
    if at not in _scratch:
        _scratch.add(at)
        atexit.register(_drop, at)
    return at


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Plans made within it drop their shuffle files when they have run; else these stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def durable(df: DataFrame) -> DataFrame:
    """The rows of df cut from their lineage by a reliable checkpoint."""
    shared_dir(df.sparkSession)
    with shuffles_dropped(df.sparkSession):
        df = df.select("*")  # a plan of its own, whose shuffles nothing else reads
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of df written to the shared folder as a columnar table and read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Words that stand for "nothing" in the string columns.
STAND_INS = ("", "-", "---", "?", "n/a", "na", "none", "null", "nan", "unknown", "không có", "không rõ", "chưa rõ", "đang cập nhật", "chưa cập nhật", "<na>")


def real_text(c):
    """The trimmed text of c, null where it is blank or a stand-in word."""
    t = F.trim(c)
    return F.when(~F.lower(t).isin(*STAND_INS), t)


def real_place(lat, lng):
    """True where lat and lng make a place: between 8 and 24 N and 100 and 112 E."""
    return F.coalesce(lat.between(8, 24) & lng.between(100, 112) & ~F.isnan(lat) & ~F.isnan(lng), F.lit(False))
