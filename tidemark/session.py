"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


# folders of local sessions that name none; the setting itself is fixed once a session runs
_LOCAL: dict[str, str] = {}


def build_session(app: str = "tidemark", cores: str = "8", memory: str = "8g") -> SparkSession:
    """A local session with the settings the library expects (a cluster brings its own)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores if cores != "*" else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage, read from ``spark.checkpoint.dir``.

    Only a local session may fall back to a folder of this machine: on a cluster such a folder
    is lost with its executor, so an unset value is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _LOCAL[app]


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The table survives the loss of executors, gives the next plan a size to decide broadcasts
    by, and fixes values that would differ if the plan ran twice (partition ids).
    """
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``materialise`` plus the row count, observed during the same write."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{uuid.uuid4().hex}"
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), int(seen.get["n"])
