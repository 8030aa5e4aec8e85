"""Candidate pairs: a multi-key blocking self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_names
from ..functions.constants import MAX_BLOCK
from .checkpoints import checkpoint


def block_keys() -> Column:
    """The set of a prepared contact's keys: numbers, tails, emails, and family word with given initial both ways round."""
    name = F.col("name")
    numbers = F.flatten(F.transform("phones", lambda p: F.array(F.concat(F.lit("p:"), p["key"]), F.concat(F.lit("t:"), p["tail"]))))
    emails = F.transform("emails", lambda e: F.concat(F.lit("e:"), e))
    words = F.filter(F.split(name["family"], " "), lambda w: F.octet_length(w) > 1)
    first = lambda s: F.left(s, F.lit(1))
    two = lambda w, g: F.array(F.concat(F.lit("n:"), w, F.lit("|"), first(g)), F.concat(F.lit("n:"), g, F.lit("|"), first(w)))
    given = F.filter(canonical_names(name["given"]), lambda g: g != "")
    person = F.flatten(F.transform(words, lambda w: F.flatten(F.transform(given, lambda g: two(w, g)))))
    by_name = F.when(name["kind"] == "person", person).when(name["kind"] == "company", F.array(F.concat(F.lit("c:"), name["org"]))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(numbers, emails, by_name))


def named(key: Column) -> Column:
    """Name and company keys: the ones that the cap is for."""
    return F.left(key, F.lit(2)).isin("n:", "c:")


def capped_keys(prepared: DataFrame, cap: int = MAX_BLOCK, large: DataFrame | None = None) -> DataFrame:
    """(id, key) without name and company keys of more than `cap` contacts: such a key says little. large: keys that are known to have more."""
    keys = prepared.select("id", F.explode(block_keys()).alias("key"))
    over = keys.where(named(F.col("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cap).select("key")
    over = over if large is None else over.union(large.select("key"))
    return keys.join(over, "key", "left_anti")


def candidates(prepared: DataFrame, cap: int = MAX_BLOCK, large: DataFrame | None = None) -> DataFrame:
    """Distinct pairs (a < b) that share a key."""
    keys = checkpoint(capped_keys(prepared, cap, large))
    a, b = keys.select("key", F.col("id").alias("a")), keys.select("key", F.col("id").alias("b"))
    return a.join(b, "key").where("a < b").select("a", "b").distinct()
