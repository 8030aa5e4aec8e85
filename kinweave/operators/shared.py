"""Numbers and emails that different people hold.

Whether all holders of an identifier are one person is asked of the names: two that could be one person's are joined,
directly or through another holder's. Only "more than one?" matters, so a walk starts at one name and stops when
no name is left, or none that it can reach. Identifiers of up to SMALL names are walked in one Arrow batch, those of more
in rounds over the whole table, FRONT names a round and identifier, however many names there are.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import NameKey, compare
from ..functions.udfs import compare_names
from .checkpoints import checkpoint

#: Names that one batch row may hold, and names walked on from in one round beyond.
SMALL, FRONT = 500, 16


def holders(prepared: DataFrame) -> DataFrame:
    """(key, display, id, place, name): who holds which identifier; phones and emails share one key space."""
    phones = prepared.select("id", "name", F.posexplode("phones").alias("place", "p")).select(F.col("p.key").alias("key"), F.col("p.display").alias("display"), "id", "place", "name")
    emails = prepared.select("id", "name", F.posexplode("emails").alias("place", "e")).select(F.col("e").alias("key"), F.col("e").alias("display"), "id", (F.col("place") + 1_000_000).alias("place"), "name")
    return phones.unionByName(emails)


def one_person(names: list[NameKey]) -> bool:
    """Whether all names could be one person's, directly or through others."""
    left, todo = list(range(1, len(names))), [0]
    while todo and left:
        x = names[todo.pop()]
        near = [i for i in left if compare(x, names[i]) != "different"]
        if near:
            todo += near
            gone = set(near)
            left = [i for i in left if i not in gone]
    return not left


def walked_at_once(names: DataFrame) -> DataFrame:
    """names: key, names (an array). The keys of more than one person."""

    def run(batches):
        for b in batches:
            found = [[NameKey(*(n[f] for f in NameKey._fields)) for n in row] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([not one_person(n) for n in found], pa.bool_()))], names=["key"])

    return names.mapInArrow(run, "key string")


def walked_in_rounds(nodes: DataFrame) -> DataFrame:
    """nodes: key, name, copy. The keys of more than one person; each round holds FRONT reached names against all others."""
    node = F.struct("name", "copy")
    left = checkpoint(nodes)
    front = left.groupBy("key").agg(F.min(node).alias("x")).select("key", "x.name", "x.copy")  # one name is the start
    front = checkpoint(front)
    left = checkpoint(left.join(front, ["key", "name", "copy"], "left_anti"))
    several = None
    while not left.isEmpty():
        dealt = front.groupBy("key", F.pmod(F.xxhash64("name", "copy"), F.lit(FRONT)).alias("slot")).agg(F.min(node).alias("x"))
        picked = checkpoint(dealt.select("key", F.col("x.name").alias("from_name"), F.col("x.copy").alias("from_copy")))
        stuck = left.join(picked.select("key"), "key", "left_anti").select("key").distinct()  # names left, but none to walk on from
        several = checkpoint(stuck if several is None else several.union(stuck))
        met = left.join(picked, "key").where(compare_names(F.col("from_name"), F.col("name")) != "different")
        near = checkpoint(met.select("key", "name", "copy").distinct())
        rest = front.join(picked.select("key", F.col("from_name").alias("name"), F.col("from_copy").alias("copy")), ["key", "name", "copy"], "left_anti")
        front = checkpoint(rest.union(near))
        left = checkpoint(left.join(near, ["key", "name", "copy"], "left_anti").join(several, "key", "left_anti"))
    return several if several is not None else nodes.select("key").limit(0)


def shared_identifiers(prepared: DataFrame) -> DataFrame:
    """key, display (the first holder's), contacts (sorted): identifiers held by more than one person, judged by name.

    Holders with one name are one node before names meet (two, if the name doesn't even fit itself), so a key has
    as many nodes as different names.
    """
    held = holders(prepared)
    many = held.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    held = checkpoint(held.join(many, "key", "left_semi"))
    people = held.where("name.kind = 'person'").groupBy("key", "name").agg(F.min("id").alias("a"), F.max("id").alias("b"))
    twice = (F.col("a") < F.col("b")) & (F.col("name.given") == "")  # only a name without a given word doesn't fit itself
    copies = F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    nodes = checkpoint(people.select("key", "name", F.explode(copies).alias("copy")))
    sizes = nodes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    few = nodes.join(sizes.where(F.col("n") <= SMALL).select("key"), "key", "left_semi").groupBy("key").agg(F.collect_list("name").alias("names"))
    judged = walked_at_once(few)
    large = checkpoint(nodes.join(sizes.where(F.col("n") > SMALL).select("key"), "key", "left_semi"))
    if not large.isEmpty():
        judged = judged.union(walked_in_rounds(large))
    summed = held.join(judged, "key", "left_semi").groupBy("key").agg(F.min_by("display", F.struct("id", "place")).alias("display"), F.sort_array(F.collect_set("id")).alias("contacts"))
    return summed.select("key", "display", "contacts")


def with_shared(prepared: DataFrame, shared: DataFrame) -> DataFrame:
    """prepared with the shared ones of each contact's identifiers."""
    own = shared.select("key", F.explode("contacts").alias("id")).groupBy("id").agg(F.collect_set("key").alias("shared"))
    return prepared.join(own, "id", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
