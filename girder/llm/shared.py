"""What the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from girder.operators.checkpoints import checkpoint_folder, checkpointed  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that df does not have."""
    have, names = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in have:
            name = "_" + name
        names.append(name)
        have.add(name.lower())
    return names


def utf8(column: str):
    return F.col(column).cast("string")


def whole_ids(docs: DataFrame, doc_id: str) -> Column:
    """The id column as long, for operators whose result follows the order of ids; other ids than whole numbers raise."""
    kind = docs.schema[doc_id].dataType
    if not isinstance(kind, T.IntegralType):
        raise TypeError(f"{doc_id} has to be a whole number, as its order counts, and is {kind.simpleString()}")
    return F.col(doc_id).cast("long")
