"""A stream of contacts, resolved batch by batch: only what new contacts touch is analysed again.

Contacts that share a key (a number, its tail, an email, a name with an initial) are connected; what is connected is
resolved by itself, for pairs, shared identifiers and the sizes of name blocks never reach out of it. Of each batch
the keys, the components (id, label) and all groups are kept below the store, under the batch's number, so a batch that
runs again after a failure replaces what it wrote. Name keys that were over the cap before the batch connect nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.constants import MAX_BLOCK
from ..operators.blocking import block_keys, named
from ..operators.checkpoints import checkpoint
from ..operators.components import components
from ..operators.prepare import prepare
from ..plans.analyze import analyze
from ..schema import CONTACT, CONTACT_DDL

GROUP_DDL = "`group` long, members array<long>, score float, tier string"


def until(batch: DataFrame, path: str, ddl: str, number: int) -> DataFrame:
    """Rows of all batches up to a number."""
    return batch.sparkSession.read.schema(f"{ddl}, batch long").parquet(path).where(F.col("batch") <= number).drop("batch")


def resolve_batch(batch: DataFrame, number: int, store: str, groups: str, region: str = "US", cap: int = MAX_BLOCK) -> DataFrame:
    """Adds a batch to the store and writes the groups of all contacts so far; returns the ids that were analysed."""
    spark = batch.sparkSession
    batch.select(*CONTACT).write.mode("overwrite").parquet(f"{store}/contacts/batch={number}")
    new = spark.read.schema(CONTACT_DDL).parquet(f"{store}/contacts/batch={number}")
    prepare(new, region).select("id", F.explode(block_keys()).alias("key")).write.mode("overwrite").parquet(f"{store}/keys/batch={number}")
    fresh = spark.read.schema("id long, key string").parquet(f"{store}/keys/batch={number}")
    keys = until(batch, f"{store}/keys", "id long, key string", number)
    before = f"batch={number - 1}"
    labels = spark.read.schema("id long, label long").parquet(f"{store}/labels/{before}") if number else spark.createDataFrame([], "id long, label long")
    old = spark.read.schema(GROUP_DDL).parquet(f"{groups}/{before}") if number else spark.createDataFrame([], GROUP_DDL)

    sizes = keys.where(named(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    added = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("added"))
    changed = checkpoint(added.join(sizes, "key", "left").select("key", F.coalesce(F.col("n") - F.col("added") > cap, F.lit(False)).alias("was_over")))
    met = keys.join(changed.where(~F.col("was_over")).select("key"), "key", "left_semi").select("id").distinct()
    touched = labels.join(labels.join(met, "id", "left_semi").select("label").distinct(), "label", "left_semi").select("id")
    again = checkpoint(touched.union(new.select("id")).distinct())

    over = checkpoint(sizes.where(F.col("n") > cap).select("key"))
    book = until(batch, f"{store}/contacts", CONTACT_DDL, number).join(again, "id", "left_semi")
    found = analyze(book, region, cap=cap, large=over).groups
    kept = old.join(again.withColumnRenamed("id", "group"), "group", "left_anti")
    found.select("group", "members", "score", "tier").unionByName(kept).write.mode("overwrite").parquet(f"{groups}/batch={number}")

    own = checkpoint(keys.join(again, "id", "left_semi").join(over, "key", "left_anti"))
    firsts = own.groupBy("key").agg(F.min("id").alias("first"))
    joined = components(own.join(firsts, "key").select(F.col("first").alias("a"), F.col("id").alias("b")))
    now = again.join(joined.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("label", "id").alias("label"))
    now.unionByName(labels.join(again, "id", "left_anti")).write.mode("overwrite").parquet(f"{store}/labels/batch={number}")
    return again


def resolve_stream(stream: DataFrame, store: str, groups: str, region: str = "US") -> DataStreamWriter:
    """Appends each micro-batch to the contacts in `store` and writes the groups of all of them to `groups`/batch=N.

    Start it with .start(); set checkpointLocation for recovery.
    """

    def step(batch: DataFrame, number: int) -> None:
        resolve_batch(batch, number, store, groups, region)

    return stream.writeStream.foreachBatch(step)
