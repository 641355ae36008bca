"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table of the folder named by spark.checkpoint.dir, so that what reads them several times computes them once; a local folder only where the session names none (local tests).

    A lost executor costs a re-read. The table stays until the folder is cleared. It is joined by merge: the rows of such tables pack so well that Spark, which
    goes by the size of their files, would broadcast tables of any size through the driver.
    """
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"{tempfile.gettempdir()}/quirelab-checkpoints"
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/quirelab/{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path).hint("merge")
