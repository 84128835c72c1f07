"""Tables: the supplied parquet tables, and the engine's own fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(14, 2)
QUANTITY = T.DecimalType(14, 3)

#: One row a drawn primitive, in paper millimetres with y down; color is 0xRRGGBB or -1.
PRIMITIVES = """kind string, method string, `group` int, layer string, color int, linetype string, lineweight float, closed boolean,
points array<double>, cx double, cy double, radius double, start_angle double, end_angle double, text string, height double,
rotation double, confidence float, block string, value double, minx double, miny double, maxx double, maxy double"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_primitives(spark: SparkSession, path: str) -> DataFrame:
    """Primitives partitioned by bid_id and sheet_id: a filter on either reads only its folders."""
    return spark.read.schema(f"{PRIMITIVES}, bid_id string, sheet_id string").parquet(path)


def write_primitives(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Written once (a second write to the path fails unless asked for), dealt so that a sheet's rows share a file."""
    df.repartition("bid_id", "sheet_id").write.mode(mode).option("compression", "zstd").partitionBy("bid_id", "sheet_id").parquet(path)


def write_months(df: DataFrame, at: str, path: str) -> None:
    """Gzipped JSON lines, one folder a month."""
    df.withColumn("month", F.date_format(at, "yyyy-MM")).repartition("month").write.mode("errorifexists").partitionBy("month").option("compression", "gzip").json(path)


def write_csv_page(df: DataFrame, order: list, limit: int, path: str) -> None:
    """An ordered, capped export with a header line."""
    df.orderBy(*order).limit(limit).write.mode("errorifexists").option("header", True).csv(path)


def unseen(inputs: DataFrame, done: DataFrame, *key: str) -> DataFrame:
    """A stage cache: inputs whose digest is not among those that are done."""
    return inputs.join(done.select(*key).distinct(), list(key), "left_anti")
