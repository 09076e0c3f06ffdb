"""Answers of providers kept under the hash of what was asked: equal requests are sent once, answered ones never again.

The store is a table of (key, answer) in a folder that the cluster shares. Requests whose key it has are not sent; the others are sent in batches, each different
one once, and what came back is written to the store before anything reads it. So a second run, and what is computed again after a lost executor, find the
answers of every task that was committed. Failed requests are not stored and are answered by what they asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .joins import join_frequent
from .providers import Provider, ask

SCHEMA = "key string, answer string"


def key_of(request: Column, model: str) -> Column:
    """What an answer is kept under: the hash of the model's name and version, and the request."""
    return F.sha2(F.concat(F.lit(model), F.lit("\0"), request).cast("binary"), 256)


def kept(spark: SparkSession, store: str) -> DataFrame:
    """The answers of a store, one for each key; of a store that does not exist, none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    # two runs at once may both have asked
    return spark.read.schema(SCHEMA).parquet(store).groupBy("key").agg(F.min("answer").alias("answer"))


def ask_kept(rows: DataFrame, request: str, provider: Provider, model: str, store: str, answer: str = "answer", batch: int = 16) -> DataFrame:
    """rows with the answer to the column request and whether there was one; null requests are not sent and have none.

    A request that very many rows share is asked once, and its rows are not gathered in one place.
    """
    spark = rows.sparkSession
    keyed = rows.withColumn("__key", key_of(F.col(request), model))
    asked = keyed.where(F.col(request).isNotNull()).groupBy("__key").agg(F.first(request).alias("__request"), F.count("*").alias("__rows"))
    fresh = asked.join(kept(spark, store).select(F.col("key").alias("__key")), "__key", "left_anti").select("__key", "__request")
    got = ask(fresh, "__request", provider, "__answer", batch).where("answered")
    got.select(F.col("__key").alias("key"), F.col("__answer").alias("answer")).write.mode("append").parquet(store)
    known = asked.select("__key", "__rows").join(kept(spark, store).withColumnRenamed("key", "__key"), "__key", "left")
    known = known.select("__key", "__rows", F.col("answer").alias("__answer"))
    found = join_frequent(keyed.where(F.col(request).isNotNull()), known, "__key", "__rows").drop("__rows")
    rest = keyed.where(F.col(request).isNull()).withColumn("__answer", F.lit(None).cast("string"))
    out = found.unionByName(rest)
    return out.select(*rows.columns, F.coalesce("__answer", request).alias(answer), F.col("__answer").isNotNull().alias("answered"))
