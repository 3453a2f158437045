"""Session settings and the durable cut of a long lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_local: dict[str, str] = {}


def build_session(app: str = "chainwright", cores: str | int = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; on a cluster the caller brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CHAINWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; any other session is refused,
    because a machine's own disk is not seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local($|\[)", spark.conf.get("spark.master", "local")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _local:
        _local["root"] = Path(tempfile.mkdtemp(prefix="chainwright-")).as_uri()
    return _local["root"]


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage by files in the shared folder, which outlive any executor; the frame is computed once."""
    return stash(df, "cut")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files, under the shared folder the session names."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet into the shared folder and read it again: a cut of the lineage with known sizes."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of stashes that nothing reads any more, neither a lazy frame nor a later step."""
    for df in frames:
        spark = df.sparkSession
        jvm = spark._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
            if where.getParent().toUri().getPath() != root.toUri().getPath():
                raise ValueError(f"{folder} is not a stash")
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
