"""Session defaults, and intermediate tables in the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "pricemill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; a cluster's own settings win unless given in ``conf``."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables, shared by the driver and all executors.

    It is the one the cluster names in ``spark.checkpoint.dir``; only a local session without that
    setting (a test) gets a temporary folder, once per session.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="pricemill-work-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/pricemill-{spark.sparkContext.applicationId}"


def stage(df: DataFrame, name: str = "stage", **options: str) -> DataFrame:
    """Write ``df`` as parquet to the work folder and continue from the written table.

    Used where several passes would recompute an expensive plan. The table outlives lost executors
    because it does not sit on them, keeps file statistics, and later reads take only the columns
    they need. ``options`` go to the writer. The tables of an application lie in one folder, to be removed when it has ended.
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
