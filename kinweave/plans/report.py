"""Reports of an analysis: JSON and text."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_name
from ..operators.clustering import ordered
from .analyze import Analysis, explained_groups, shown_ids


def round2(score: Column) -> Column:
    return F.round(score.cast("double") * 100) / 100


def group_rows(analysis: Analysis, contacts: DataFrame) -> DataFrame:
    """Groups in order, with named members and the texts of their evidence."""
    who = contacts.select("id", display_name(F.col("formatted_name"), F.col("name"), F.col("org")).alias("name"), F.col("source.file").alias("file"), F.col("source.line").alias("line"))
    members = analysis.groups.select("group", F.explode("members").alias("id")).join(who, "id")
    members = members.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("id", "name", "file", "line"))).alias("members"))
    texts = F.transform("pairs", lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.transform(p["evidence"], lambda e: e["text"]).alias("evidence")))
    rows = explained_groups(analysis).select("group", "tier", round2(F.col("score")).alias("score"), texts.alias("pairs")).join(members, "group")
    return ordered(rows)


def json_report(
    analysis: Analysis, contacts: DataFrame, issues: DataFrame, files: DataFrame, region: str,
    top: int | None = None, summary: DataFrame | None = None,
) -> str:
    """The report as JSON. top: at most so many groups (all by default); the driver holds what is reported. summary: of apply_merges."""
    groups = group_rows(analysis, contacts)
    groups = groups.limit(top) if top is not None else groups
    rows = lambda df: [json.loads(r) for r in df.toJSON().collect()]
    p = analysis.problems
    report = {
        "files": rows(files), "issues": rows(issues), "region": region, "groups": rows(groups), "shared": rows(analysis.shared.orderBy("key")),
        "problems": {"no_name": rows(p.no_name.orderBy("id")), "no_country": rows(p.no_country.orderBy("id", "number")), "empty": rows(p.empty.orderBy("id"))},
    }
    if summary is not None:
        report["summary"] = summary.first().asDict()
    return json.dumps(report)


def many(n: int, one: str, more: str) -> str:
    return f"{n} {one if n == 1 else more}"


def text_report(analysis: Analysis, contacts: DataFrame, top: int = 10, summary: DataFrame | None = None) -> str:
    """Groups per tier, the first groups with up to three explained pairs, problems, up to five shared identifiers with four holders, and the summary."""
    counts = {r["tier"]: r["n"] for r in analysis.groups.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).collect()}
    out = ["groups: " + ", ".join(f"{counts.get(t, 0)} {t}" for t in ("sure", "likely", "check"))]
    for g in group_rows(analysis, contacts).limit(top).collect():
        out.append(f"[{g['tier']}] {g['score']:.2f} " + "; ".join(f"{m['name']} ({m['file']}:{m['line']})" for m in g["members"]))
        names = {m["id"]: m["name"] for m in g["members"]}
        for p in g["pairs"][:3]:
            which = f"{names[p['a']]} and {names[p['b']]}: " if len(names) > 2 else ""
            out.append("    " + which + "; ".join(p["evidence"]))
        if len(g["pairs"]) > 3:
            out.append(f"    and {len(g['pairs']) - 3} pairs more")
    if sum(counts.values()) > top:
        out.append(f"and {sum(counts.values()) - top} groups more")
    p = analysis.problems
    n = [df.count() for df in (p.no_name, p.no_country, p.empty)]
    found = [many(n[0], "contact without a name", "contacts without a name"), many(n[1], "number that lacks its country", "numbers that lack their country"), many(n[2], "contact with nothing in it", "contacts with nothing in them")]
    if any(n):
        out.append("problems: " + ", ".join(t for t, k in zip(found, n, strict=True) if k))
    for s in analysis.shared.orderBy("key").limit(5).collect():
        out.append(f"shared: {s['display']} by {', '.join(map(str, s['contacts'][:4]))}{' and others' if len(s['contacts']) > 4 else ''}")
    if summary is not None:
        r = summary.first()
        out.append(f"summary: {r['contacts_in']} contacts in, {r['contacts_out']} out, {many(r['groups_merged'], 'group', 'groups')} merged, {r['empty_dropped']} empty left out")
    return "\n".join(out)


def described(analysis: Analysis, contacts: DataFrame) -> DataFrame:
    """The contacts that a review shows, as JSON, pictures replaced by links."""
    rows = contacts.join(shown_ids(analysis), "id", "left_semi")
    link = F.when(F.col("photo.kind") == "data", F.concat(F.lit("photo/"), F.col("id").cast("string"))).otherwise(F.col("photo.uri"))
    return rows.select("id", F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "photo"], link.alias("photo"))).alias("json"))
