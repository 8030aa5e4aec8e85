"""From contacts to groups: prepare, shared identifiers, scored pairs, clusters, problems."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions.constants import MAX_BLOCK
from ..operators.blocking import candidates
from ..operators.checkpoints import checkpoint
from ..operators.clustering import cluster, group_pairs
from ..operators.prepare import prepare
from ..operators.scoring import scored_pairs
from ..operators.shared import shared_identifiers, with_shared


class Problems(NamedTuple):
    no_name: DataFrame
    no_country: DataFrame
    empty: DataFrame


class Analysis(NamedTuple):
    prepared: DataFrame
    shared: DataFrame
    pairs: DataFrame
    groups: DataFrame
    problems: Problems


def problems(contacts: DataFrame, region: str = "US") -> Problems:
    """Ids without a name, numbers without a country code (one row a number), and empty contacts, which the others leave out."""
    from ..functions.udfs import phone_keys

    rows = contacts.withColumn("void", K.is_empty_contact())
    full = rows.where(~F.col("void"))
    named = K.display_name(F.col("formatted_name"), F.col("name"), F.col("org")) != ""
    saved = full.select("id", "phones", phone_keys(F.transform("phones", lambda p: p["value"]), region).alias("keys"))
    numbers = saved.select("id", F.explode(F.zip_with("phones", "keys", lambda p, k: F.struct(p["value"].alias("number"), k["has_country"].alias("has")))).alias("n"))
    return Problems(full.where(~named).select("id"), numbers.where("n.has = false").select("id", "n.number"), rows.where("void").select("id"))


def analyze(
    contacts: DataFrame, region: str = "US", not_duplicates: DataFrame | None = None, *, cap: int = MAX_BLOCK,
    large: DataFrame | None = None,
) -> Analysis:
    """not_duplicates: (a, b) of contacts that a user said are different people. large: keys over the cap in a book that contacts are a part of."""
    prepared = checkpoint(prepare(contacts, region))
    shared = checkpoint(shared_identifiers(prepared))
    known = checkpoint(with_shared(prepared, shared))
    pairs = checkpoint(scored_pairs(candidates(prepared, cap, large), known))
    groups = checkpoint(cluster(pairs, prepared, not_duplicates))
    return Analysis(prepared, shared, pairs, groups, problems(contacts, region))


def shown_ids(analysis: Analysis) -> DataFrame:
    """Contacts that a review shows: group members, problems and holders of shared identifiers."""
    p = analysis.problems
    parts = [analysis.groups.select(F.explode("members").alias("id")), p.no_name.select("id"), p.no_country.select("id"), p.empty.select("id"), analysis.shared.select(F.explode("contacts").alias("id"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out.distinct()


def explained_groups(analysis: Analysis) -> DataFrame:
    """Groups with their pairs and evidence, in order of the pairs."""
    own = group_pairs(analysis.groups, analysis.pairs).groupBy("group").agg(F.sort_array(F.collect_list(F.struct("a", "b", "score", "names", "evidence"))).alias("pairs"))
    return analysis.groups.join(own, "group")
