"""A generated book with known answers: people, their entries in four exports, damage to copies, and traps.

Everything follows from a person's number by hashes and arithmetic, so a book of any size is made where its rows are
made, and the same seed gives the same book. Traps are people whose numbers stand together: households (a landline and
an address), families (an email and a family name), namesakes, and offices (a switchboard).
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADDRESS, ADDRESS_PARTS, CONTACT, EXTRAS, NAME_PARTS, PHOTO, labelled

FILES = ("icloud.vcf", "google.csv", "android.vcf", "outlook.csv")
GIVEN = "Aarav Aditi Amelia Anil Arthur Beatriz Bruno Carmen Clara Deepa Diego Elena Emma Felix Greta Harish Helena Ingrid Isha Javier Jonas Kavita Klara Lakshmi Lorenzo Lucia Magnus Manoj Marta Meera Nikhil Nora Oliver Oscar Pablo Pooja Rafael Rohan Rosa Sanjay Sofia Stefan Tanvi Tobias Ursula Vikram Yasmin Zoe".split()
SHORT = {"Robert": "Bob", "William": "Bill", "Elizabeth": "Liz", "Michael": "Mike", "Katherine": "Kate", "James": "Jim", "Thomas": "Tom", "Richard": "Rick", "Margaret": "Peggy", "Benjamin": "Ben"}
FAMILY_HEADS = "Al Ban Bel Car Chan Dal Dev Esh Fer Gar Gol Han Hol Iyer Jad Kal Ker Lin Mal Mor Nand Oli Pat Per Qua Ram Ros Sal Sen Tan Ull Var Wal Yad Zim".split()
FAMILY_TAILS = "a ari berg da dorf er es ez gar ia ini ira kar man mann nath o one oni ov sen son stein ström ta ti ton wala".split()
DAMAGE = ("nickname", "initial", "swapped", "typo", "missing_field", "work_copy", "case", "accents", "first_name_only", "sparse", "honorific", "number_only", "note")


class Generated(NamedTuple):
    """contacts: rows of the schema, ids dense over files. truth: id, person, tags. traps: kind, person1, person2."""

    contacts: DataFrame
    truth: DataFrame
    traps: DataFrame


def generate(spark: SparkSession, people: int, seed: int = 1) -> Generated:
    c, lit, cat = F.col, F.lit, F.concat
    draw = lambda what, n, of="person": F.pmod(F.xxhash64(lit(seed), lit(what), c(of)), lit(n)).cast("int")
    pick = lambda words, at: F.get(F.array(*map(lit, words)), at)
    digits = lambda what, n, of="person": F.lpad(F.pmod(F.xxhash64(lit(seed), lit(what), c(of)), lit(10**n)).cast("string"), n, "0")
    trap = c("person") % 100
    base = spark.range(people).select(c("id").alias("person"))
    # the person whose value it is: in a trap the first of those who share it
    base = base.select(
        "person",
        F.when(trap.isin(1, 2, 3), c("person") - trap + 1).when(trap.isin(11, 12), c("person") - trap + 11).otherwise(c("person")).alias("home"),
        F.when(trap == 22, c("person") - 1).otherwise(c("person")).alias("named"),
        F.when(trap >= 90, F.floor(c("person") / 400) * 400).alias("office"),
    )
    names = [*GIVEN, *SHORT]
    base = base.withColumn("given", pick(names, draw("given", len(names), "named")))
    owner = F.when((trap >= 1) & (trap <= 12), c("home")).otherwise(c("named"))
    base = base.withColumn("owner", owner)
    base = base.withColumn("family", cat(pick(FAMILY_HEADS, draw("head", len(FAMILY_HEADS), "owner")), pick(FAMILY_TAILS, draw("tail", len(FAMILY_TAILS), "owner"))))
    base = base.withColumn("mobile", cat(lit("+91 "), pick(["6", "7", "8", "9"], draw("m", 4)), digits("mobile", 4), lit(" "), digits("mobile5", 5)))
    plain = F.translate(F.lower(cat(c("given"), lit("."), c("family"))), "ö", "o")
    base = base.withColumn("email", F.when(trap.isin(11, 12), cat(lit("family."), F.translate(F.lower("family"), "ö", "o"), c("home").cast("string"), lit("@mail.example"))).when(draw("has email", 4) > 0, cat(plain, c("person").cast("string"), lit("@gmail.com"))).otherwise(""))
    base = base.withColumn("landline", F.when(trap.isin(1, 2, 3), cat(lit("+91 22 2"), digits("line", 7, "home"))).when(c("office").isNotNull(), cat(lit("+91 80 4"), digits("office", 7, "office"))))
    base = base.withColumn("org", F.when(c("office").isNotNull(), cat(lit("Office "), c("office").cast("string"), lit(" Ltd"))).otherwise(""))
    month, day = F.lpad((draw("month", 12) + 1).cast("string"), 2, "0"), F.lpad((draw("day", 28) + 1).cast("string"), 2, "0")
    base = base.withColumn("birthday", F.when(draw("has birthday", 5) < 2, cat((draw("year", 60) + 1945).cast("string"), lit("-"), month, lit("-"), day)))
    # entries: about four in ten people have a second one, some a third
    copies = F.when(draw("copies", 10) < 6, 1).when(draw("copies", 10) < 9, 2).otherwise(3)
    entry = base.select("*", F.explode(F.sequence(lit(0), copies - 1)).alias("copy")).withColumn("entry", c("person") * 4 + c("copy"))
    entry = entry.withColumn("damage", F.when(c("copy") > 0, pick(DAMAGE, draw("damage", len(DAMAGE), "entry"))))
    is_ = lambda *kinds: c("damage").isin(*kinds)
    short = F.try_element_at(F.create_map(*[lit(x) for kv in SHORT.items() for x in kv]), c("given"))
    entry = entry.withColumn("damage", F.when(is_("nickname") & short.isNull(), "case").otherwise(c("damage")))
    slip = lambda w: cat(F.left(w, lit(2)), F.substring(w, 4, 1), F.substring(w, 3, 1), F.substr(w, lit(5)))  # noqa: E731  two letters swapped
    title = lambda x: F.coalesce(x, lit(""))
    given = F.when(is_("nickname"), short).when(is_("initial"), cat(F.left("given", lit(1)), lit("."))).when(is_("swapped"), c("family")).when(is_("case"), F.upper("given")).when(is_("number_only"), "").otherwise(c("given"))
    family = F.when(is_("swapped"), c("given")).when(is_("typo"), slip(c("family"))).when(is_("case"), F.upper("family")).when(is_("accents"), F.translate("family", "aeo", "áéö")).when(is_("first_name_only", "number_only"), "").otherwise(c("family"))
    entry = entry.withColumns({"wg": title(given), "wf": title(family)})
    keeps_phone = ~is_("missing_field") | (draw("which", 2, "entry") == 0)
    local = F.regexp_replace(cat(lit("0"), F.substr("mobile", lit(5))), " ", "")
    number = F.when(c("copy") == 0, c("mobile")).when(draw("style", 3, "entry") == 0, local).otherwise(F.regexp_replace("mobile", " ", ""))
    of = lambda value, types, label=None: F.struct(value.alias("value"), F.array(*map(lit, types)).cast("array<string>").alias("types"), lit(label).cast("string").alias("label"))
    none = F.array().cast(labelled())
    phones = F.when(is_("work_copy"), F.when(c("landline").isNotNull(), F.array(of(c("landline"), ["work"]), of(number, ["cell"]))).otherwise(F.array(of(number, ["cell"]))))
    phones = phones.when(F.coalesce(keeps_phone, lit(True)), F.when(c("landline").isNotNull(), F.array(of(number, ["cell"]), of(c("landline"), ["home"]))).otherwise(F.array(of(number, ["cell"])))).otherwise(none)
    keeps_email = (c("email") != "") & ~F.coalesce(is_("sparse", "number_only", "first_name_only") | (is_("missing_field") & keeps_phone), lit(False))
    emails = F.when(keeps_email, F.array(of(c("email"), []))).otherwise(none)
    file = F.when(c("copy") == 0, pick(FILES, draw("file", 4))).otherwise(pick(FILES, draw("file", 4, "entry")))
    entry = entry.withColumns({"file": file, "some_phones": phones.cast(labelled()), "some_emails": emails.cast(labelled())})
    # ids are dense in the order of files and entries: counts by file and slot of entries, and places within a slot
    entry = entry.withColumn("slot", F.floor(c("entry") / 100_000))
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("file", "slot").orderBy("entry")) - 1
    counts = entry.groupBy("file", "slot").agg(F.count(lit(1)).alias("n"))
    order = F.array_position(F.array(*map(lit, FILES)), c("file"))
    before = Window.orderBy("ord", "slot").rowsBetween(Window.unboundedPreceding, -1)  # a row a file and slot
    of_file = Window.partitionBy("file").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    running = counts.withColumn("ord", order).select("file", "slot", F.coalesce(F.sum("n").over(before), lit(0)).alias("before"), F.coalesce(F.sum("n").over(of_file), lit(0)).alias("in_file"))
    entry = entry.withColumn("place", inside).join(F.broadcast(running), ["file", "slot"])
    blank, void = lit(""), lit(None).cast("string")
    shown = F.trim(cat(F.when(is_("honorific"), "Dr. ").otherwise(""), c("wg"), lit(" "), c("wf")))
    parts = {"family": c("wf"), "given": c("wg"), "additional": blank, "prefix": F.when(is_("honorific"), "Dr.").otherwise(""), "suffix": blank}
    columns = {
        "id": c("before") + c("place"), "source": F.struct(c("file"), (c("in_file") + c("place")).alias("index"), (c("in_file") + c("place") + 1).alias("line")),
        "formatted_name": F.coalesce(shown, blank), "name": F.struct(*[F.coalesce(parts[p], blank).alias(p) for p in NAME_PARTS]), "nicknames": F.array().cast("array<string>"),
        "org": F.when(is_("sparse", "number_only"), "").otherwise(c("org")), "department": blank, "title": blank, "phones": c("some_phones"), "emails": c("some_emails"),
        "addresses": F.when(trap.isin(1, 2, 3) & (c("copy") == 0), F.array(F.struct(F.struct(*[(cat(digits("house", 2, "home"), lit(" Lake Road")) if p == "street" else lit("Pune") if p == "locality" else blank).alias(p) for p in ADDRESS_PARTS]).alias("value"), F.array(lit("home")).alias("types"), void.alias("label")))).otherwise(F.array()).cast(labelled(ADDRESS)),
        "urls": none, "birthday": F.when(is_("sparse", "number_only"), void).otherwise(c("birthday")), "note": F.when(is_("note"), "met at the fair").otherwise(""),
        "photo": lit(None).cast(PHOTO), "categories": F.array().cast("array<string>"), "uid": void, "extra": F.array().cast(EXTRAS),
    }
    made = entry.select("person", "damage", *[columns[k].alias(k) for k in CONTACT])
    truth = made.select("id", "person", F.when(c("damage").isNull(), F.array().cast("array<string>")).otherwise(F.array("damage")).alias("tags"))
    return Generated(made.select(*CONTACT), truth, traps(spark, people))


def traps(spark: SparkSession, people: int) -> DataFrame:
    """kind, person1, person2: the pairs of each trap."""
    p = spark.range(people).select(F.col("id").alias("person1"))
    of = lambda kind, first, others: p.where(F.col("person1") % 100 == first).select(F.lit(kind).alias("kind"), "person1", F.explode(F.array(*[F.col("person1") + k for k in others])).alias("person2"))
    small = of("household", 1, [1, 2]).union(of("household", 2, [1])).union(of("family_email", 11, [1])).union(of("same_name", 21, [1]))
    office = p.where(F.col("person1") % 100 >= 90).withColumn("office", F.floor(F.col("person1") / 400))
    pairs = office.join(office.withColumnRenamed("person1", "person2"), "office").where("person1 < person2").select(F.lit("switchboard").alias("kind"), "person1", "person2")  # forty people an office
    return small.union(pairs).where(F.col("person2") < people)


# --- exports ----------------------------------------------------------------------------------------


def csv_line(cells: list[Column]) -> Column:
    return F.concat_ws(",", *[F.when(x.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x) for x in cells])


def nth(column: str, n: int) -> Column:
    return F.coalesce(F.get(F.col(column), F.lit(n))["value"], F.lit(""))


GOOGLE_HEADER = "First Name,Middle Name,Last Name,Organization Name,Birthday,Notes,E-mail 1 - Label,E-mail 1 - Value,Phone 1 - Label,Phone 1 - Value,Phone 2 - Label,Phone 2 - Value"
OUTLOOK_HEADER = "First Name,Middle Name,Last Name,Company,Birthday,Notes,E-mail Address,Mobile Phone,Home Phone,Business Phone"


def google_lines(contacts: DataFrame) -> DataFrame:
    """id and line of a Google CSV, below GOOGLE_HEADER."""
    label = lambda n: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in ("cell", "Mobile", "home", "Home", "work", "Work")]), F.get(F.get("phones", F.lit(n))["types"], F.lit(0))), F.lit(""))
    blank = F.lit("")
    cells = [F.col("name.given"), blank, F.col("name.family"), F.col("org"), F.coalesce("birthday", blank), F.col("note"), blank, nth("emails", 0), label(0), nth("phones", 0), label(1), nth("phones", 1)]
    return contacts.select("id", csv_line(cells).alias("line"))


def outlook_lines(contacts: DataFrame) -> DataFrame:
    """id and line of an Outlook CSV, below OUTLOOK_HEADER; its files are Windows-1252."""
    typed = lambda t: F.coalesce(F.get(F.filter("phones", lambda p: F.array_contains(p["types"], t)), F.lit(0))["value"], F.lit(""))
    day = F.coalesce(F.date_format(F.try_to_timestamp(F.col("birthday"), F.lit("yyyy-MM-dd")), "M/d/yyyy"), F.lit("0/0/00"))
    cells = [F.col("name.given"), F.lit(""), F.col("name.family"), F.col("org"), day, F.col("note"), nth("emails", 0), typed("cell"), typed("home"), typed("work")]
    return contacts.select("id", csv_line(cells).alias("line"))


def quoted_printable(text: Column) -> Column:
    """UTF-8 bytes as =XX, but for letters and digits."""
    bytes_ = F.transform(F.sequence(F.lit(0), F.octet_length(text) - 1), lambda i: F.substring(F.hex(F.encode(text, "UTF-8")), i * 2 + 1, F.lit(2)))
    plain = lambda h: F.decode(F.unhex(h), "UTF-8")
    shown = F.transform(bytes_, lambda h: F.when(h.between("30", "39") | h.between("41", "5A") | h.between("61", "7A"), plain(h)).otherwise(F.concat(F.lit("="), h)))
    return F.when(text == "", "").otherwise(F.array_join(shown, ""))


def android_cards(contacts: DataFrame) -> DataFrame:
    """id and card of a vCard 2.1 file with quoted-printable names."""
    e = F.lit("\r\n")
    qp = ";CHARSET=UTF-8;ENCODING=QUOTED-PRINTABLE:"
    phones = F.array_join(F.transform("phones", lambda p: F.concat(F.lit("TEL;"), F.upper(F.coalesce(F.get(p["types"], F.lit(0)), F.lit("voice"))), F.lit(":"), p["value"], e)), "")
    emails = F.array_join(F.transform("emails", lambda p: F.concat(F.lit("EMAIL;INTERNET:"), p["value"], e)), "")
    optional = lambda name, value: F.when(value != "", F.concat(F.lit(name), value, e)).otherwise("")
    card = F.concat(
        F.lit("BEGIN:VCARD"), e, F.lit("VERSION:2.1"), e, F.lit("N" + qp), quoted_printable(F.col("name.family")), F.lit(";"), quoted_printable(F.col("name.given")), F.lit(";;"), quoted_printable(F.col("name.prefix")), F.lit(";"), e,
        F.lit("FN" + qp), quoted_printable(F.col("formatted_name")), e, phones, emails, optional("ORG:", F.col("org")), optional("BDAY:", F.coalesce("birthday", F.lit(""))), optional("NOTE:", F.col("note")), F.lit("END:VCARD"), e,
    )
    return contacts.select("id", card.alias("card"))
