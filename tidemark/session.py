"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_BUCKET_KEY = "tidemark.rank.rowsPerBucket"
MAX_CUTS_KEY = "tidemark.rank.maxCuts"
CO_PARTITION_KEY = "spark.sql.requireAllClusterKeysForCoPartition"
FOLDER_KEY = "tidemark.folder"
_RUN_KEY = "tidemark.run"


def local_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A single-machine session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(CO_PARTITION_KEY, "false")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def use_folder(spark: SparkSession, folder: str) -> None:
    """Keep intermediate tables of this session under ``folder``, where the session names no spark.checkpoint.dir."""
    spark.conf.set(FOLDER_KEY, folder)


def configured_folder(spark: SparkSession) -> str | None:
    """The folder named by spark.checkpoint.dir, else by ``use_folder``."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(FOLDER_KEY, None)


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables; there is none by default, on any master."""
    folder = configured_folder(spark)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def run_folder(spark: SparkSession) -> str:
    """This session's own folder under the shared one; ``release`` removes it."""
    run = spark.conf.get(_RUN_KEY, None)
    if run is None:
        run = uuid.uuid4().hex
        spark.conf.set(_RUN_KEY, run)
    return f"{checkpoint_root(spark)}/tidemark/{run}"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a columnar table in the shared folder and read it back.

    Several consumers then scan pruned parquet columns in place of recomputing the lineage, and a lost
    executor costs one re-read.
    """
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").partitionBy(*(partition_by or [])).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this session has stored; frames read from them are no longer usable."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    spark.conf.unset(_RUN_KEY)


def rows_per_bucket(spark: SparkSession) -> int:
    """Upper aim for the rows of one sort bucket in a distributed rank."""
    return int(spark.conf.get(ROWS_PER_BUCKET_KEY, "1000000"))


def max_cuts(spark: SparkSession) -> int:
    """Most cut points of one level of a distributed rank; they travel with a group's rows."""
    return int(spark.conf.get(MAX_CUTS_KEY, "2048"))


def by_entity(df: DataFrame, entity: str = "ts_code") -> DataFrame:
    """Partition a panel by entity, where the session lets joins on (entity, date) use that.

    An entity has at most one row per day, so the partitions stay even. All later joins and windows of the
    panel then run where its rows already are. With the session's default every such join asks for both
    keys and would move the rows again, so nothing is done.
    """
    if df.sparkSession.conf.get(CO_PARTITION_KEY, "true").lower() == "true":
        return df
    return df.repartition(entity)
