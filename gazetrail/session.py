"""A local session with the settings that the library expects; clusters bring their own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    conf = {"spark.sql.shuffle.partitions": partitions, "spark.driver.memory": memory, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("gazetrail")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
