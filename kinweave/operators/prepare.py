"""What matching needs of a contact, computed once: keys, not photos or notes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as K
from ..functions import udfs


def spread(df: DataFrame) -> DataFrame:
    """A table that Spark estimates to be small is dealt out to all cores, as Python functions follow; larger ones have partitions enough."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < cores * (64 << 20) else df


def prepare(contacts: DataFrame, region: str = "US") -> DataFrame:
    """id, name (kind, given, family, org), display, phones (key, display, has_country, tail, kind), emails, birthday (y, m, d).

    Phones are distinct by key, the first copy wins; of emails only neighbours that are equal are one.
    """
    c = F.col
    df = spread(contacts).select(
        "id",
        udfs.name_key(c("name"), c("formatted_name"), c("org")).alias("name"),
        K.display_name(c("formatted_name"), c("name"), c("org")).alias("display"),
        "phones",
        udfs.phone_keys(F.transform("phones", lambda p: p["value"]), region).alias("keys"),
        F.filter(F.transform("emails", lambda e: K.email_key(e["value"])), lambda e: e.isNotNull()).alias("emails"),
        K.birthday_triple(c("birthday")).alias("birthday"),
    )
    both = F.zip_with(
        "phones",
        "keys",
        lambda p, k: F.when(
            k.isNotNull(),
            F.struct(k["key"].alias("key"), k["display"].alias("display"), k["has_country"].alias("has_country"), K.phone_tail(p["value"]).alias("tail"), K.phone_kind(p["types"], p["label"]).alias("kind")),
        ),
    )
    df = df.withColumn("known", F.filter(both, lambda p: p.isNotNull()))
    first = F.filter("known", lambda p, i: ~F.exists(F.slice(c("known"), F.lit(1), i), lambda q: q["key"] == p["key"]))
    runs = F.filter("emails", lambda e, i: (i == 0) | (e != F.get(c("emails"), i - 1)))
    return df.select("id", "name", "display", first.alias("phones"), runs.alias("emails"), "birthday")
