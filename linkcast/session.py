"""Session settings and the shared folder where intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", name: str = "linkcast") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_ROOTS: dict[str, str] = {}


def stage_root(spark: SparkSession) -> str:
    """The cluster's shared folder; where it is unset, a temporary one, on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[context.applicationId] = tempfile.mkdtemp(prefix="linkcast-")
    return _LOCAL_ROOTS[context.applicationId]


def stage(df: DataFrame, name: str = "stage", by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Each file is sorted by ``by``, so that filters on those columns skip pages
    without a folder (and a small file per task) for every value.

    Cuts the lineage at a shuffle whose result must not change between two
    actions, survives the loss of executors, and lets later readers prune
    columns.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark)}/linkcast-{name}-{uuid.uuid4().hex}"
    (df.sortWithinPartitions(*by) if by else df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
