"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors share.

    Only a local session, as in tests, may do without: it gets a temporary
    folder. On a cluster a missing setting is an error, as every executor would
    write to a disk of its own.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not set_dir:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            set_dir = known.get()
        elif spark.sparkContext.master.startswith("local"):
            set_dir = tempfile.mkdtemp(prefix="tidemark-")
            spark.sparkContext.setCheckpointDir(set_dir)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return set_dir.rstrip("/")


#: Tables written by this process that clean() removes.
_written: list[str] = []


def clean(spark: SparkSession) -> int:
    """Remove the tables this process wrote to the shared folder; frames that read them can't be used any more."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(hadoop).delete(p, True)
    n = len(_written)
    _written.clear()
    return n


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    Cuts the lineage with columnar, compressed files that survive the loss of
    any executor, and lets several consumers share one computation.
    """
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tidemark-code-")) / "tidemark.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(path))
    sc._tidemark_shipped = True
