import pytest
from pyspark.sql import functions as F

from tidemark import session


class Unconfigured:
    """A session that names no folder."""

    class sparkContext:  # noqa: N801
        master = "local[8]"

        @staticmethod
        def getConf():  # noqa: N802
            return {}

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default


def test_no_folder_by_default():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.checkpoint_root(Unconfigured)


def test_stored_tables_are_released(spark):
    run = spark.conf.get("tidemark.run", None)
    spark.conf.unset("tidemark.run")
    try:
        kept = session.stage(spark.range(10).withColumn("part", F.col("id") % 2), "numbers", ["part"])
        assert kept.where("part = 1").count() == 5 and kept.columns == ["id", "part"]
        session.release(spark)
        assert spark.conf.get("tidemark.run", None) is None
        with pytest.raises(Exception):  # noqa: B017
            spark.read.parquet(kept.inputFiles()[0]).count()
    finally:
        if run:
            spark.conf.set("tidemark.run", run)
