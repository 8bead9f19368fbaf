"""Session, table access and the shared scratch folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "glossoloom", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the engine relies on (UTC, AQE)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("GLOSSOLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, however the driver came to know it. Done once per context."""
    sc = spark.sparkContext
    if getattr(sc, "_glossoloom_shipped", False):
        return
    package = Path(__file__).resolve().parent
    paths = [p for p in sc.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if str(package.parent) not in paths:
        sc.environment["PYTHONPATH"] = os.pathsep.join([str(package.parent), *paths])
    if not sc.master.startswith("local"):
        archive = Path(tempfile.mkdtemp()) / "glossoloom.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        sc.addPyFile(str(archive))
    sc._glossoloom_shipped = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, taken from ``spark.checkpoint.dir``.

    Only where that is unset and the master is local is a temporary folder made, since driver and executors are
    then one machine; elsewhere an unset folder is an error, as data kept on one machine would not survive it.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set; it must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="glossoloom-")
    sc.setCheckpointDir(made)
    return made


#: Written tables by application, kept until its end because results that read them are lazy.
_written: dict[str, list[str]] = {}


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives the loss of executors.

    The tables of an application are deleted when its driver ends, or by :func:`clear_scratch`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _written:
        _written[app] = []
        atexit.register(_clear_quietly, spark)
    _written[app].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession) -> int:
    """Delete what this application has materialized; results that still read it fail afterwards. Gives the number of tables."""
    sc = spark.sparkContext
    if sc._jsc is None:  # stopped already
        return 0
    paths = _written.pop(sc.applicationId, [])
    for p in paths:
        path = sc._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def _clear_quietly(spark: SparkSession) -> None:
    """At the end of the driver its JVM may be gone already, and with it the means to delete anything."""
    with contextlib.suppress(Exception):
        clear_scratch(spark)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Partition by keys into as many parts as shuffles have, for costly work per key on few bytes, which adaptive
    execution would otherwise gather into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
