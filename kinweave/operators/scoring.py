"""Weighing pairs: evidence with texts, summed in 32 bits."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import float_sum, tier_of
from ..functions.constants import EVIDENCE, NAME_WEIGHTS
from ..functions.udfs import compare_names

KIND = "array<struct<text:string,weight:float>>"


def said(weight: float | Column, text: str, **parts: Column) -> Column:
    """Evidence of a weight: one of the fixed texts, with its parts filled in."""
    pieces = []
    for plain, name, *_ in string.Formatter().parse(EVIDENCE[text]):
        pieces += ([F.lit(plain)] if plain else []) + ([parts[name]] if name else [])
    return F.struct(F.concat(*pieces).alias("text"), (weight if isinstance(weight, Column) else F.lit(weight)).cast("float").alias("weight"))


def only_if(condition: Column, evidence: Column) -> Column:
    return F.when(condition, F.array(evidence)).otherwise(F.array().cast(KIND))


def name_evidence(names: Column, a: Column, b: Column) -> Column:
    both = F.when(a == b, a).otherwise(F.concat(a, F.lit(" / "), b))
    out = F.when((names == "exact") & (a == b), F.array(said(NAME_WEIGHTS["exact"], "exact", both=a)))
    out = out.when(names == "exact", F.array(said(NAME_WEIGHTS["exact"], "written", both=both)))
    for kind, weight in NAME_WEIGHTS.items():
        if kind != "exact":
            out = out.when(names == kind, F.array(said(weight, kind, both=both)))
    return out.otherwise(F.array().cast(KIND))


def counted(common: Column, shared: Column, key, strong: float, text: str, parts) -> Column:
    """Identifiers in common: the first that isn't shared by other people counts in full, all others little."""
    is_shared = lambda x: F.array_contains(shared, key(x))
    earlier = lambda i: F.exists(F.slice(common, F.lit(1), i), lambda y: ~is_shared(y))

    def one(x: Column, i: Column) -> Column:
        full = said(F.when(earlier(i), F.lit(0.1)).otherwise(F.lit(strong)), text, **parts(x))
        return F.when(is_shared(x), said(0.1, "shared", what=parts(x)["what"])).otherwise(full)

    return F.transform(common, one)


def possible_tails(a: Column, b: Column) -> Column:
    """Numbers that would be one if the copy without a country code is of the other's country: as shown, local and international."""
    fits = lambda p, q: (p["key"] != q["key"]) & (p["tail"] == q["tail"]) & (F.length(p["tail"]) == 9) & ~(p["has_country"] & q["has_country"])
    shown = lambda p, q: F.struct(
        F.when(p["has_country"], q["display"]).otherwise(p["display"]).alias("local"), F.when(p["has_country"], p["display"]).otherwise(q["display"]).alias("intl")
    )
    return F.flatten(F.transform(a, lambda p: F.transform(F.filter(b, lambda q: fits(p, q)), lambda q: shown(p, q))))


def score(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """a, b, score (float), names and evidence of each pair. prepared: with_shared()."""
    side = lambda s: prepared.select(F.col("id").alias(s), F.struct("name", "display", "phones", "emails", "birthday", "shared").alias("p" + s))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b = F.col("pa"), F.col("pb")
    both = both.withColumn("names", compare_names(a["name"], b["name"]))
    both = both.withColumn("phones", F.filter(a["phones"], lambda p: F.exists(b["phones"], lambda q: q["key"] == p["key"])))
    both = both.withColumn("emails", F.filter(a["emails"], lambda e: F.array_contains(b["emails"], e)))
    both = both.withColumn("tail", F.get(possible_tails(a["phones"], b["phones"]), F.lit(0)))
    none = F.size("phones") == 0
    shared, x, y = a["shared"], a["birthday"], b["birthday"]
    known = x.isNotNull() & y.isNotNull()
    same_day = (x["m"] == y["m"]) & (x["d"] == y["d"])
    same_year = (x["y"] != 0) & (x["y"] == y["y"])
    people = (a["name"]["kind"] == "person") & (b["name"]["kind"] == "person")
    evidence = F.concat(
        name_evidence(F.col("names"), a["display"], b["display"]),
        counted(F.col("phones"), shared, lambda p: p["key"], 0.6, "phone", lambda p: {"kind": p["kind"], "what": p["display"]}),
        only_if(none & F.col("tail").isNotNull(), said(0.45, "tail", local=F.col("tail.local"), intl=F.col("tail.intl"))),
        only_if(none & F.col("tail").isNull() & (F.size(a["phones"]) > 0) & (F.size(b["phones"]) > 0), said(-0.15, "no phone")),
        counted(F.col("emails"), shared, lambda e: e, 0.5, "email", lambda e: {"what": e}),
        only_if((F.size("emails") == 0) & (F.size(a["emails"]) > 0) & (F.size(b["emails"]) > 0), said(-0.15, "no email")),
        only_if(known & ~same_day, said(-1.0, "birthdays")),
        only_if(known & same_day & same_year, said(0.3, "birthday")),
        only_if(known & same_day & ~same_year, said(0.15, "day")),
        only_if((a["name"]["org"] != "") & (a["name"]["org"] == b["name"]["org"]) & people, said(0.1, "company")),
    )
    both = both.select("a", "b", "names", evidence.alias("evidence"))
    return both.select("a", "b", float_sum(F.transform("evidence", lambda e: e["weight"])).alias("score"), "names", "evidence")


def scored_pairs(pairs: DataFrame, prepared: DataFrame) -> DataFrame:
    """Pairs that reach a tier."""
    return score(pairs, prepared).withColumn("tier", tier_of(F.col("score"))).where("tier is not null").drop("tier")
