"""Merging groups of contacts into one each, and applying merges to a book."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import survivors
from ..functions.columns import is_empty_contact
from ..schema import CONTACT
from ..sinks.vcard import as_row

CHOICES = "struct<" + ",".join(f"{f}:bigint" for f in survivors.FIELDS) + ">"
ALTERNATIVES = "struct<" + ",".join(f"{f}:array<struct<from:array<bigint>,value:string>>" for f in survivors.FIELDS) + ">"
CONTACT_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in CONTACT.items()) + ">"


class Applied(NamedTuple):
    contacts: DataFrame
    summary: DataFrame


def golden_records(contacts: DataFrame, merges: DataFrame, region: str = "US") -> DataFrame:
    """merges: merge, members (two and more ids, disjoint) and choices (may be null). A row a merge: contact, choices used, alternatives."""
    of = merges.select("merge", "choices", F.explode("members").alias("id"))
    row = F.struct(*[F.col(k) for k in CONTACT])
    groups = contacts.join(of, "id").groupBy("merge").agg(F.collect_list(row).alias("rows"), F.first("choices", ignorenulls=True).alias("choices"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for merge, rows, choices in zip(pdf["merge"], pdf["rows"], pdf["choices"], strict=True):
                members = sorted((as_row(r) for r in rows), key=lambda r: r["id"])
                wanted = {k: int(v) for k, v in as_row(choices).items() if v is not None and v == v} if choices is not None else None
                contact, picks, offered = survivors.merge(members, region, wanted)
                out.append({"merge": merge, "contact": contact, "choices": picks, "alternatives": offered})
            yield pd.DataFrame(out, columns=["merge", "contact", "choices", "alternatives"], dtype=object)

    return groups.select("merge", "rows", "choices").mapInPandas(run, f"merge long, contact {CONTACT_STRUCT}, choices {CHOICES}, alternatives {ALTERNATIVES}")


def claimed(spark: SparkSession, merges: list[tuple[list[int], dict | None]], known: set[int] | None = None) -> DataFrame:
    """User merges as a table: the first that lists an id has it; one left with fewer than two frees them again."""
    taken: set[int] = set()
    rows = []
    for n, (ids, choices) in enumerate(merges):
        own = [i for i in ids if i not in taken and (known is None or i in known)]
        if len(own) >= 2:
            taken |= set(own)
            rows.append((n, sorted(set(own)), {f: (choices or {}).get(f) for f in survivors.FIELDS}))
    return spark.createDataFrame(rows, f"merge long, members array<bigint>, choices {CHOICES}")


def from_groups(groups: DataFrame, level: str = "sure") -> DataFrame:
    """Merges of the groups of a level: sure, likely (and surer) or all."""
    tiers = {"sure": ["sure"], "likely": ["sure", "likely"], "all": ["sure", "likely", "check"]}[level]
    return groups.where(F.col("tier").isin(tiers)).select(F.col("group").alias("merge"), "members", F.lit(None).cast(CHOICES).alias("choices"))


def apply_merges(contacts: DataFrame, merges: DataFrame, region: str = "US") -> Applied:
    """The clean book: merged groups in the place of their first member, empty contacts left out; and its counts."""
    gold = golden_records(contacts, merges, region).select("contact.*")
    inside = merges.select(F.explode("members").alias("id"))
    rest = contacts.join(inside, "id", "left_anti").select(*CONTACT)
    kept = rest.where(~is_empty_contact())
    clean = gold.unionByName(kept)
    number = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    summary = number(contacts, "contacts_in").crossJoin(number(clean, "contacts_out")).crossJoin(number(merges, "groups_merged")).crossJoin(number(rest.where(is_empty_contact()), "empty_dropped"))  # four rows of one
    return Applied(clean.orderBy("id"), summary)
