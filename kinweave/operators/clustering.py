"""Groups of contacts: strongest pairs first, and no two that can't be one person together."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import tier_of
from ..functions.names import NameKey, compare
from ..functions.udfs import compare_names
from .checkpoints import checkpoint
from .components import components


def conflict(a: dict, b: dict) -> bool:
    """Clearly different names, or different days of birth."""
    if compare(a["name"], b["name"]) == "different":
        return True
    x, y = a["birthday"], b["birthday"]
    return x is not None and y is not None and x != y


def agglomerate(people: dict[int, dict], pairs: list[tuple[int, int, float]], apart: set[tuple[int, int]]) -> dict[int, tuple[list[int], float]]:
    """Joins groups along pairs (by score, then a, b) unless a member of one conflicts with one of the other.

    The result has the members and the weakest joining score of each group of two and more.
    """
    home = {i: i for i in people}
    members = {i: [i] for i in people}
    weakest = dict.fromkeys(people, np.float32(np.inf))
    known: dict[tuple[int, int], bool] = {}

    def clash(x: int, y: int) -> bool:
        pair = (min(x, y), max(x, y))
        if pair not in known:
            known[pair] = pair in apart or conflict(people[pair[0]], people[pair[1]])
        return known[pair]

    for a, b, score in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        x, y = home[a], home[b]
        if x == y or any(clash(i, j) for i in members[x] for j in members[y]):
            continue
        keep, gone = (x, y) if len(members[x]) >= len(members[y]) else (y, x)
        weakest[keep] = min(weakest[keep], weakest[gone], np.float32(score))
        for i in members[gone]:
            home[i] = keep
        members[keep] += members.pop(gone)
    return {g: (sorted(m), float(weakest[g])) for g, m in members.items() if len(m) > 1}


def cluster(pairs: DataFrame, prepared: DataFrame, not_duplicates: DataFrame | None = None) -> DataFrame:
    """group (its least member), members, score and tier.

    Groups never leave their connected component of scored pairs, and the order of pairs within one is that of all, so
    each component is agglomerated by itself, in parallel, with the same result. Components of two are one comparison;
    larger ones are a row of an Arrow batch each. not_duplicates: (a, b) never to be joined, in either order.
    """
    edges = checkpoint(pairs.select("a", "b", "score"))
    label = checkpoint(components(edges))
    sizes = label.groupBy("label").agg((F.count(F.lit(1)) == 2).alias("two"))
    home = label.join(sizes, "label").select(F.col("node").alias("id"), "label", "two")
    people = checkpoint(prepared.select("id", "name", "birthday").join(home, "id"))
    inside = edges.join(home.withColumnRenamed("id", "a"), "a").withColumn("apart", F.lit(False))
    if not_duplicates is not None:
        pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
        apart = not_duplicates.select(*pair).distinct()
        near = apart.join(home.withColumnRenamed("id", "a"), "a").select("a", "b", F.lit(0).cast("float").alias("score"), "label", "two", F.lit(True).alias("apart"))
        inside = inside.unionByName(near)
    inside = checkpoint(inside)

    side = lambda s: people.where("two").select(F.col("id").alias(s), F.col("name").alias("n" + s), F.col("birthday").alias("d" + s))
    both = inside.where("two").groupBy("a", "b").agg(F.max("score").alias("score"), F.max("apart").alias("apart"), F.min("apart").alias("only"))
    both = both.where("not apart and not only").join(side("a"), "a").join(side("b"), "b")
    days = F.coalesce((F.col("da.m") != F.col("db.m")) | (F.col("da.d") != F.col("db.d")), F.lit(False))
    alone = both.where(~days).where(compare_names(F.col("na"), F.col("nb")) != "different")
    least = F.least("a", "b")
    couples = alone.select(least.alias("group"), F.array(least, F.greatest("a", "b")).alias("members"), "score")

    found = inside.where("not two").groupBy("label").agg(F.collect_list(F.struct("a", "b", "score", "apart")).alias("edges"))
    who = people.where("not two").groupBy("label").agg(F.collect_list(F.struct("id", "name", "birthday")).alias("people"))

    def run(batches):
        day = lambda b: None if b is None else (b["m"], b["d"])
        schema = pa.schema([("group", pa.int64()), ("members", pa.list_(pa.int64())), ("score", pa.float32())])
        for batch in batches:
            out = []
            for rows, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                known = {n["id"]: {"name": NameKey(*(n["name"][f] for f in NameKey._fields)), "birthday": day(n["birthday"])} for n in nodes}
                joined = agglomerate(known, [(r["a"], r["b"], r["score"]) for r in rows if not r["apart"]], {(r["a"], r["b"]) for r in rows if r["apart"]})
                out += [(m[0], m, s) for m, s in joined.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    larger = found.join(who, "label").select("edges", "people").mapInArrow(run, "group long, members array<long>, score float")
    return couples.unionByName(larger).withColumn("tier", tier_of(F.col("score")))


def ordered(groups: DataFrame) -> DataFrame:
    """Sure ones first, then by the least member."""
    rank = F.array_position(F.array(*map(F.lit, ("sure", "likely", "check"))), F.col("tier"))
    return groups.orderBy(rank, "group")


def group_pairs(groups: DataFrame, pairs: DataFrame) -> DataFrame:
    """The scored pairs inside each group: group, and the columns of pairs."""
    of = groups.select("group", F.explode("members").alias("id"))
    a, b = of.select(F.col("id").alias("a"), "group"), of.select(F.col("id").alias("b"), F.col("group").alias("other"))
    return pairs.join(a, "a").join(b, "b").where("group = other").drop("other")


def member_pairs(groups: DataFrame) -> DataFrame:
    """All pairs a < b of each group's members."""
    of = groups.select("group", F.explode("members").alias("id"))
    return of.select("group", F.col("id").alias("a")).join(of.select("group", F.col("id").alias("b")), "group").where("a < b").select("a", "b")
