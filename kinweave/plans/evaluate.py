"""How good groups are, against a book whose people are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import display_name, percent
from ..operators.clustering import member_pairs

LEVELS = {"sure": ["sure"], "sure+likely": ["sure", "likely"], "all": ["sure", "likely", "check"]}


def true_pairs(truth: DataFrame) -> DataFrame:
    """(a, b) of entries (id, person) of one person."""
    return truth.select("person", F.col("id").alias("a")).join(truth.select("person", F.col("id").alias("b")), "person").where("a < b").select("a", "b")


def pair_sets(entries: DataFrame) -> DataFrame:
    """entries: id, group, person; an id that comes again has the same ones, and a null group or person pairs with none.

    The pairs a < b of one group (found) and of one person (true), counted without making them: all found and true ones, the different
    ones in both, and those found (true) that are left after as many true (found) ones are taken away.
    """
    each = entries.where("id is not null").groupBy("group", "person", "id").agg(F.count(F.lit(1)).alias("n"))
    cells = each.groupBy("group", "person").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"), F.count(F.lit(1)).alias("ids"))
    pairs = F.expr("(n * n - same) div 2")
    n = lambda df, *columns: df.agg(*[F.coalesce(F.sum(value), F.lit(0)).alias(name) for name, value in columns])
    by = lambda column: cells.where(F.col(column).isNotNull()).groupBy(column).agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    both = n(cells.where("group is not null and person is not null"), ("n_right", F.expr("ids * (ids - 1) div 2")), ("both", pairs))
    counted = n(by("group"), ("n_found", pairs)).crossJoin(n(by("person"), ("n_true", pairs))).crossJoin(both)
    return counted.select("n_found", "n_true", "n_right", (F.col("n_found") - F.col("both")).alias("n_wrong"), (F.col("n_true") - F.col("both")).alias("n_missed"))


def pair_quality(groups: DataFrame, truth: DataFrame) -> DataFrame:
    """For each cumulative level: pairs found, right and true, precision and recall, and groups that are exactly a person's entries."""
    true = true_pairs(truth)
    people = truth.groupBy("person").agg(F.sort_array(F.collect_list("id")).alias("members")).where(F.size("members") > 1)
    out = None
    for level, tiers in LEVELS.items():
        own = groups.where(F.col("tier").isin(tiers))
        found = member_pairs(own)
        n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        row = n(found, "found").crossJoin(n(found.intersect(true), "right")).crossJoin(n(true, "true")).crossJoin(n(own.join(people, "members", "left_semi"), "exact")).crossJoin(n(people, "people"))
        row = row.select(F.lit(level).alias("level"), "*", percent(F.col("right"), F.col("found")).alias("precision"), percent(F.col("right"), F.col("true")).alias("recall"))
        out = row if out is None else out.union(row)
    return out


def wrong_and_missed(groups: DataFrame, truth: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs found that aren't of one person, and pairs of one person that weren't found."""
    found, true = member_pairs(groups), true_pairs(truth)
    return found.exceptAll(true), true.exceptAll(found)


def first_missed(groups: DataFrame, truth: DataFrame, contacts: DataFrame, limit: int) -> DataFrame:
    """The first pairs of one person that weren't found, in id order, with what a reader needs to see why."""
    who = lambda s: contacts.select(F.col("id").alias(s), F.struct(display_name(F.col("formatted_name"), F.col("name"), F.col("org")).alias("name"), F.transform("phones", lambda p: p["value"]).alias("phones"), F.transform("emails", lambda e: e["value"]).alias("emails")).alias("contact_" + s))
    missed = wrong_and_missed(groups, truth)[1].orderBy("a", "b").limit(limit)
    return missed.join(who("a"), "a").join(who("b"), "b").orderBy("a", "b")


def first_wrong(groups: DataFrame, pairs: DataFrame, truth: DataFrame, limit: int) -> DataFrame:
    """The first pairs of different people that stand in one group, in id order, with the group's tier and the pair's evidence, if it was scored."""
    wrong = wrong_and_missed(groups, truth)[0].orderBy("a", "b").limit(limit)
    tier = groups.select("tier", F.explode("members").alias("a"))
    why = pairs.select("a", "b", F.array_join(F.transform("evidence", lambda e: e["text"]), "; ").alias("why"))
    return wrong.join(tier, "a").join(why, ["a", "b"], "left").select("a", "b", "tier", "why").orderBy("a", "b")


def trap_table(groups: DataFrame, truth: DataFrame, traps: DataFrame) -> DataFrame:
    """traps: kind, person1, person2. For each kind: pairs of people, grouped together at all, and as sure."""
    of = groups.select("group", "tier", F.explode("members").alias("id")).join(truth, "id").select("group", "tier", "person")
    a, b = of.select("group", "tier", F.col("person").alias("person1")), of.select("group", F.col("person").alias("person2"))
    together = a.join(b, "group").groupBy("person1", "person2").agg(F.max(F.col("tier") == "sure").alias("sure"))
    judged = traps.join(together, ["person1", "person2"], "left")
    return judged.groupBy("kind").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("sure").isNotNull()).alias("wrong"), F.count_if(F.coalesce("sure", F.lit(False))).alias("wrong_as_sure"))


def missed_by_damage(groups: DataFrame, truth: DataFrame, damage: DataFrame) -> DataFrame:
    """damage: id, tags. True pairs and missed ones by each tag that either copy has (none without)."""
    found = member_pairs(groups).withColumn("hit", F.lit(True))
    tags = lambda s: damage.select(F.col("id").alias(s), F.col("tags").alias("t" + s))
    pairs = true_pairs(truth).join(tags("a"), "a").join(tags("b"), "b").join(found, ["a", "b"], "left")
    both = F.array_union("ta", "tb")
    tagged = pairs.select("hit", F.explode(F.when(F.size(both) == 0, F.array(F.lit("none"))).otherwise(both)).alias("tag"))
    return tagged.groupBy("tag").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("hit").isNull()).alias("missed"))
