"""Normalisation as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ADDRESS_PARTS
from .constants import NICKNAMES, TIERS

c = F.col


def nonblank(x: Column) -> Column:
    return F.trim(x) != ""


def email_key(raw: Column) -> Column:
    """Lower case, no mailto:, Gmail without dots and tags; null where this isn't an address."""
    e = F.trim(F.regexp_replace(F.lower(F.trim(raw)), "^mailto:", ""))
    local, domain = F.regexp_extract(e, "(?s)^(.*)@", 1), F.regexp_extract(e, "(?s)@([^@]*)$", 1)
    gmail = F.concat(F.replace(F.split_part(local, F.lit("+"), F.lit(1)), F.lit("."), F.lit("")), F.lit("@gmail.com"))
    return F.when(~e.contains("@") | (local == "") | ~domain.contains("."), None).when(domain.isin("gmail.com", "googlemail.com"), gmail).otherwise(e)


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def phone_tail(raw: Column) -> Column:
    """The last nine digits as saved."""
    return F.right(digits(raw), F.lit(9))


def phone_kind(types: Column, label: Column) -> Column:
    said = F.lower(F.coalesce(label, F.lit("")))
    has = lambda t: F.array_contains(types, t)
    return (
        F.when(has("cell") | said.contains("mobile") | (said == "iphone"), "mobile")
        .when(has("fax"), "fax")
        .when(has("home") | said.contains("home"), "home number")
        .when(has("work") | said.contains("work") | said.contains("office") | (said == "main"), "work number")
        .otherwise("number")
    )


def birthday_triple(date: Column) -> Column:
    """(year, month, day), year 0 where unknown; null where these aren't numbers."""
    yearless, full = r"^--(\+?[0-9]+)-(\+?[0-9]+)$", r"^(\+?[0-9]+)-(\+?[0-9]+)-(\+?[0-9]+)(?:-.*)?$"
    part = lambda rule, k: F.regexp_extract(date, rule, k).try_cast("int")
    y = F.when(date.rlike(yearless), F.lit(0)).when(date.rlike(full), part(full, 1))
    m = F.when(date.rlike(yearless), part(yearless, 1)).when(date.rlike(full), part(full, 2))
    d = F.when(date.rlike(yearless), part(yearless, 2)).when(date.rlike(full), part(full, 3))
    fits = (y <= 65535) & (m <= 255) & (d <= 255)
    return F.when(fits, F.struct(y.alias("y"), m.alias("m"), d.alias("d")))


def joined_parts(parts: list[Column], by: str) -> Column:
    return F.array_join(F.filter(F.transform(F.array(*parts), lambda s: F.trim(s)), lambda s: s != ""), by)


def display_name(formatted: Column, name: Column, org: Column) -> Column:
    """The formatted name, else the name's parts in reading order, else the organisation."""
    parts = joined_parts([name[p] for p in ("prefix", "given", "additional", "family", "suffix")], " ")
    return F.when(nonblank(formatted), F.trim(formatted)).when(parts != "", parts).otherwise(F.trim(org))


def address_display(a: Column) -> Column:
    return joined_parts([a[p] for p in ADDRESS_PARTS], ", ")


def address_line(a: Column) -> Column:
    """For people: place, region and postal code stand together without commas."""
    city = joined_parts([a[p] for p in ("locality", "region", "postal_code")], " ")
    return joined_parts([a["po_box"], a["extended"], a["street"], city, a["country"]], ", ")


def work_line(title: Column, org: Column, department: Column) -> Column:
    """Job, company and department."""
    return joined_parts([title, org, department], ", ")


def birthday_text(date: Column) -> Column:
    """A date as it is; one without a year in words."""
    month = F.date_format(F.to_date(F.concat(F.lit("2000-"), F.substring(date, 3, 2), F.lit("-01"))), "MMMM")
    return F.when(date.rlike("^--(0[1-9]|1[0-2])-[0-9]{2}$"), F.concat(F.substring(date, 6, 2).cast("int").cast("string"), F.lit(" "), month, F.lit(", no year"))).otherwise(date)


def photo_url(photo: Column) -> Column:
    """A picture as a data: URL, or its link."""
    data = F.concat(F.lit("data:"), photo["mime"], F.lit(";base64,"), F.replace(F.base64(photo["bytes"]), F.lit("\r\n"), F.lit("")))
    return F.when(photo["kind"] == "data", data).otherwise(photo["uri"])


def is_empty_contact() -> Column:
    """Nothing worth keeping in a contact row."""
    none = lambda col: F.forall(c(col), lambda f: ~nonblank(f["value"]))
    nothing = none("phones") & none("emails") & F.forall(c("addresses"), lambda a: address_display(a["value"]) == "") & (F.size("urls") == 0)
    return (display_name(c("formatted_name"), c("name"), c("org")) == "") & nothing & ~nonblank(c("note")) & c("birthday").isNull() & c("photo").isNull()


def tier_of(score: Column) -> Column:
    """sure, likely, check or null, by 32-bit comparison."""
    s, out = score.cast("float"), F.lit(None).cast("string")
    for name, least in reversed(TIERS):
        out = F.when(s >= F.lit(least).cast("float"), name).otherwise(out)
    return out


def float_sum(weights: Column) -> Column:
    """Weights added left to right in 32 bits."""
    return F.aggregate(weights, F.lit(0).cast("float"), lambda total, w: (total + w).cast("float"))


def canonical_names(given: Column) -> Column:
    """The given name and the full names that it may be short for."""
    table = F.create_map(*[x for k, v in NICKNAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_union(F.array(given), F.coalesce(F.try_element_at(table, given), F.array().cast("array<string>")))


def percent(n: Column, d: Column) -> Column:
    """n of d with one decimal, or n/a."""
    return F.when(d == 0, "n/a").otherwise(F.concat(F.format_number(100 * n / d, 1), F.lit("%")))


def field_label(types: Column, label: Column) -> Column:
    """The label, else the known types as words, fax last."""
    words = F.create_map(*[F.lit(x) for x in ("cell", "Mobile", "home", "Home", "work", "Work", "fax", "Fax", "pager", "Pager", "main", "Main")])
    known = F.array_distinct(F.filter(F.transform(types, lambda t: F.try_element_at(words, t)), lambda w: w.isNotNull()))
    return F.coalesce(label, F.array_join(F.concat(F.filter(known, lambda w: w != "Fax"), F.filter(known, lambda w: w == "Fax")), " "))
