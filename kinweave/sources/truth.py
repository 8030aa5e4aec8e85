"""The truth of a generated book: which entry is whose, what was done to it, and which people were made alike on purpose."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checkpoints import checkpoint

SCHEMA = (
    "seed long, people long, files array<string>,"
    "entries array<struct<file:string,index:bigint,person:bigint,empty:boolean,damage:array<string>>>,"
    "traps array<struct<kind:string,persons:array<bigint>>>"
)


class Truth(NamedTuple):
    """files: ord, file. entries: file, index, person, empty, damage. traps: kind, person1, person2 (all pairs of a trap's people)."""

    files: DataFrame
    entries: DataFrame
    traps: DataFrame


def read_truth(spark: SparkSession, path: str) -> Truth:
    """A JSON document with seed, people, files, entries and traps."""
    whole = spark.read.schema(SCHEMA).option("multiLine", True).json(path)
    files = whole.select(F.posexplode("files").alias("ord", "file"))
    entries = whole.select(F.explode("entries").alias("e")).select("e.*")
    traps = whole.select(F.posexplode("traps").alias("n", "t")).select("n", "t.kind", F.posexplode("t.persons").alias("k", "person"))
    first, second = (traps.select("n", "kind", F.col("k").alias("k" + s), F.col("person").alias("person" + s)) for s in "12")
    return Truth(files, entries, first.join(second, ["n", "kind"]).where("k1 < k2").select("kind", "person1", "person2"))


def of_contacts(truth: Truth, contacts: DataFrame) -> DataFrame:
    """id, person and tags of each contact of a book, by file and place in it; an error unless entries and contacts match one to one."""
    place = contacts.select("id", F.col("source.file").alias("file"), F.col("source.index").alias("index"))
    both = checkpoint(place.join(truth.entries.select("file", "index", "person", F.coalesce("damage", F.array().cast("array<string>")).alias("tags")), ["file", "index"], "full"))
    wrong = both.groupBy("file", "index").agg(F.count("id").alias("contacts"), F.count("person").alias("entries")).where("contacts <> 1 or entries <> 1")
    found = wrong.orderBy("file", "index").limit(3).collect()
    if found:
        raise ValueError("contacts and entries don't match: " + "; ".join(f"{r['file']} {r['index']}: {r['contacts']} contacts, {r['entries']} entries" for r in found))
    return both.select("id", "person", "tags")
