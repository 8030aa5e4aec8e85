"""The engine's operators as queries over the driver's tables, with DuckDB SQL where SQL can express them.

The tables hold no contacts, so most queries run over a view of `customer`: three copies of each person, by integer
arithmetic that both engines do alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .engine_sql import GROUPS, SCORED, SHARED, WORDS, compared, golden, groups
from .functions import columns as K
from .functions import udfs
from .functions.names import outside_brackets
from .functions.survivors import name_quality, url_key
from .operators.blocking import candidates, capped_keys
from .operators.checkpoints import checkpoint, own_dir
from .operators.clustering import group_pairs
from .operators.components import components
from .operators.prepare import prepare
from .operators.shared import shared_identifiers
from .operators.survivorship import CHOICES, apply_merges, from_groups, golden_records
from .plans.analyze import analyze, problems, shown_ids
from .plans.evaluate import first_missed, first_wrong, missed_by_damage, pair_quality, pair_sets, trap_table
from .plans.report import group_rows
from .schema import ADDRESS, EXTRAS, NAME_PARTS, PHOTO, labelled
from .sinks.vcard import cards, escaped, quoted
from .sources.book import book, read_book
from .sources.dates import clean_date
from .sources.vcard import apple_label, telephone

CLEAN_DATE, URL_KEY = udfs.each(clean_date), udfs.each(url_key)

GIVEN = "Robert Bob Priya Daniel Elizabeth Liz Michael Mike Sunita Jonathan Jonathon Ravi Thomas Anna Carlos Vijay".split()
#: What the second copy may be written as: short forms, slips and other names.
OTHER_GIVEN = "Bob Robert Pryia Danny Beth Elizabeth Micheal Michael Suneeta Jonathon Jonathan Rvai Tom Ana Carols Vijai".split()
OTHER_FAMILY = "Smyth Sha Wever Gracia Kapor Metha Tailor Waker Browne Lopes Kumaar Jenson Schmitt Rosi Martinez Desia".split()
FAMILY = "Smith Shah Weber Garcia Kapoor Mehta Taylor Walker Brown Lopez Kumar Jensen Schmidt Rossi Martin Desai".split()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def person_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, pid, copy and a contact's plain values; wg and wf: the names as written, in the second copy in one of four ways."""
    n = F.col("c_custkey")
    base = read(spark, sf_dir, "customer").select(n.alias("id"), F.floor(n / 3).cast("long").alias("pid"), (n % 3).cast("int").alias("copy"))
    pick = lambda words, at: F.get(F.array(*map(F.lit, words)), at.cast("int"))
    base = base.withColumn("given", pick(GIVEN, F.col("pid") % 16)).withColumn("family", pick(FAMILY, F.floor(F.col("pid") / 16) % 16))
    base = base.withColumn("kind", ((F.col("pid") + F.floor(F.col("pid") / 16)) % 4).cast("int"))
    second = F.col("copy") == 1
    base = base.withColumn("wg", F.when(second & (F.col("kind") == 0), F.left("given", F.lit(1))).when(second & (F.col("kind") == 1), pick(OTHER_GIVEN, F.col("pid") % 16)).otherwise(F.col("given")))
    base = base.withColumn("wf", F.when(second & (F.col("kind") == 2), pick(OTHER_FAMILY, F.floor(F.col("pid") / 16) % 16)).otherwise(F.col("family")))
    c, s = F.col, F.concat
    by_copy = lambda a, b, d: F.when(c("copy") == 0, a).when(c("copy") == 1, b).otherwise(d)
    pid, text = c("pid"), c("pid").cast("string")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    month, day, year = pid % 12 + 1, pid % 28 + 1, (pid % 60 + 1940).cast("string")
    nine = F.lpad(text, 9, "0")
    return base.select(
        "id", "pid", "copy", "given", "family", "wg", "wf",
        by_copy(s("given", F.lit(" "), "family"), s("wg", F.when(F.col("kind") == 0, ". ").otherwise(" "), "wf"), s(F.upper("family"), F.lit(", "), F.upper("given"))).alias("formatted_name"),
        by_copy(s(F.lit("+91 9"), nine), s(F.lit("0091-9"), nine), s(F.lit("+91 22 2"), F.lpad((F.floor(pid / 4) % 10000).cast("string"), 7, "0"))).alias("phone"),
        by_copy(s("given", F.lit("."), "family", text, F.lit("@gmail.com")), s("given", "family", text, F.lit("+x@GoogleMail.com")), F.lit("")).alias("email"),
        by_copy(s(year, F.lit("-"), two(month), F.lit("-"), two(day)), s(F.lit("--"), two(month), two(day)), s(month.cast("string"), F.lit("/"), day.cast("string"), F.lit("/"), year)).alias("birthday"),
        F.when(pid % 5 == 0, s(F.lit("Acme ("), text, F.lit(") "), F.get(F.array(*map(F.lit, ("Ltd", "Trading Co", "Logistics GmbH"))), (pid % 3).cast("int")))).otherwise("").alias("org"),
        by_copy(s(F.lit("https://www.Example.com/p"), text, F.lit("/")), s(F.lit("HTTP://example.com/p"), text), F.lit("")).alias("url"),
    )


VIEW = f"""
b AS (SELECT c_custkey AS id, CAST(floor(c_custkey / 3) AS BIGINT) AS pid, CAST(c_custkey % 3 AS INTEGER) AS copy FROM customer),
g AS (SELECT *, {GIVEN}[pid % 16 + 1] AS given, {FAMILY}[CAST(floor(pid / 16) AS BIGINT) % 16 + 1] AS family, lpad(pid::VARCHAR, 9, '0') AS nine,
      pid % 12 + 1 AS mo, pid % 28 + 1 AS da, (pid % 60 + 1940)::VARCHAR AS ye, (pid + CAST(floor(pid / 16) AS BIGINT)) % 4 AS kind,
      {OTHER_GIVEN}[pid % 16 + 1] AS og, {OTHER_FAMILY}[CAST(floor(pid / 16) AS BIGINT) % 16 + 1] AS of FROM b),
h AS (SELECT *, CASE WHEN copy = 1 AND kind = 0 THEN left(given, 1) WHEN copy = 1 AND kind = 1 THEN og ELSE given END AS wg, CASE WHEN copy = 1 AND kind = 2 THEN of
    ELSE family END AS wf FROM g),
v AS (SELECT id, pid, copy, given, family, wg, wf,
  CASE copy WHEN 0 THEN given || ' ' || family WHEN 1 THEN wg || CASE WHEN kind = 0 THEN '. ' ELSE ' ' END || wf ELSE upper(family) || ', ' || upper(given)
      END AS formatted_name,
  CASE copy WHEN 0 THEN '+91 9' || nine WHEN 1 THEN '0091-9' || nine ELSE '+91 22 2' || lpad((CAST(floor(pid / 4) AS BIGINT) % 10000)::VARCHAR, 7, '0') END AS phone,
  CASE copy WHEN 0 THEN given || '.' || family || pid || '@gmail.com' WHEN 1 THEN given || family || pid || '+x@GoogleMail.com' ELSE '' END AS email,
  CASE copy WHEN 0 THEN ye || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(da::VARCHAR, 2, '0') WHEN 1 THEN '--' || lpad(mo::VARCHAR, 2, '0') || lpad(da::VARCHAR, 2,
      '0') ELSE mo || '/' || da || '/' || ye END AS birthday,
  CASE WHEN pid % 5 = 0 THEN 'Acme (' || pid || ') ' || ['Ltd', 'Trading Co', 'Logistics GmbH'][pid % 3 + 1] ELSE '' END AS org,
  CASE copy WHEN 0 THEN 'https://www.Example.com/p' || pid || '/' WHEN 1 THEN 'HTTP://example.com/p' || pid ELSE '' END AS url FROM h)"""


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as contact rows."""
    v = person_view(spark, sf_dir)
    c = F.col
    one = lambda value, types, label: F.when(value != "", F.array(F.struct(value.alias("value"), types.alias("types"), label.alias("label")))).otherwise(F.array()).cast(labelled())
    none = F.array().cast("array<string>")
    kinds = F.when(c("copy") == 0, F.array(F.lit("cell"))).when(c("copy") == 2, F.array(F.lit("home"))).otherwise(none)
    label = F.when(c("copy") == 1, F.lit("Office"))
    blank, void = F.lit(""), F.lit(None).cast("string")
    return v.select(
        "id", F.struct(F.lit("customer").alias("file"), c("id").alias("index"), (c("id") + 1).alias("line")).alias("source"), "formatted_name",
        F.struct(*[blank.alias(p) for p in NAME_PARTS]).alias("name"), none.alias("nicknames"), "org", blank.alias("department"), blank.alias("title"),
        one(c("phone"), kinds, label).alias("phones"), one(c("email"), none, void).alias("emails"), F.array().cast(labelled(ADDRESS)).alias("addresses"), one(c("url"), none, void).alias("urls"),
        CLEAN_DATE(c("birthday")).alias("birthday"), F.concat(F.lit("Note "), c("pid").cast("string")).alias("note"), F.lit(None).cast(PHOTO).alias("photo"), none.alias("categories"), void.alias("uid"), F.array().cast(EXTRAS).alias("extra"),
    )


def awkward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contacts without a name, without a number, with numbers that lack a country code, and with nothing at all."""
    n, blank = F.col("c_custkey"), F.lit("")
    tail = F.concat(F.lit("91234"), F.lpad((n % 100000).cast("string"), 5, "0"))
    of = lambda *values: F.array(*[F.struct(v.alias("value"), F.array().cast("array<string>").alias("types"), F.lit(None).cast("string").alias("label")) for v in values]).cast(labelled())
    phones = F.when(n % 3 == 0, of(F.concat(F.lit("0"), tail))).when(n % 3 == 1, of(F.concat(F.lit("+91 "), tail), F.concat(F.lit("0"), tail))).otherwise(of())
    base = contacts(spark, sf_dir).join(read(spark, sf_dir, "customer").select(n.alias("id"), phones.alias("some"), (n % 5 == 0).alias("nameless")), "id")
    named = lambda column: F.when(F.col("nameless"), blank).otherwise(F.col(column))
    return base.withColumns({"phones": F.col("some"), "formatted_name": named("formatted_name"), "org": blank, "emails": of(), "urls": of(), "birthday": F.lit(None).cast("string"), "note": blank}).drop("some", "nameless")


Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("$VIEW", VIEW)
        return f

    return add


@query("WITH $VIEW SELECT * FROM v")
def er_contact_view(spark, sf_dir):
    return person_view(spark, sf_dir)


EMAIL_SQL = """
e AS (SELECT *, trim(regexp_replace(lower(trim(email)), '^mailto:', '')) AS m FROM v),
k AS (SELECT *, CASE WHEN m NOT LIKE '%_@%.%' THEN NULL WHEN regexp_matches(m, '@(gmail|googlemail)\\.com$') THEN replace(split_part(regexp_extract(m, '^(.*)@', 1), '+',
    1), '.', '') || '@gmail.com' ELSE m END AS email_key,
  CASE WHEN phone LIKE '00%' THEN '+' || regexp_replace(substr(phone, 3), '[^0-9]', '', 'g') ELSE '+' || regexp_replace(phone, '[^0-9]', '', 'g') END AS phone_key FROM e)"""


@query(f"WITH $VIEW, {EMAIL_SQL} SELECT id, email_key FROM k")
def er_email_key(spark, sf_dir):
    return person_view(spark, sf_dir).select("id", K.email_key(F.col("email")).alias("email_key"))


@query(f"WITH $VIEW, {EMAIL_SQL} SELECT id, phone_key, right(regexp_replace(phone, '[^0-9]', '', 'g'), 9) AS tail, CASE copy WHEN 0 THEN 'mobile' WHEN 1 THEN 'work number' ELSE 'home number' END AS kind FROM k")
def er_phone_key(spark, sf_dir):
    saved = contacts(spark, sf_dir).select("id", F.col("phones")[0].alias("p"), udfs.phone_keys(F.transform("phones", lambda p: p["value"]), "IN").alias("k"))
    return saved.select("id", F.col("k")[0]["key"].alias("phone_key"), K.phone_tail(F.col("p.value")).alias("tail"), K.phone_kind(F.col("p.types"), F.col("p.label")).alias("kind"))


@query("""WITH $VIEW, d AS (SELECT id, CASE copy WHEN 0 THEN birthday WHEN 1 THEN '--' || substr(birthday, 3, 2) || '-' || substr(birthday, 5, 2)
  ELSE split_part(birthday, '/', 3) || '-' || lpad(split_part(birthday, '/', 1), 2, '0') || '-' || lpad(split_part(birthday, '/', 2), 2, '0') END AS date FROM v)
SELECT id, date, CASE WHEN date LIKE '--%' THEN 0 ELSE CAST(left(date, 4) AS INTEGER) END AS y, CAST(substr(right(date, 5), 1, 2) AS INTEGER) AS m, CAST(right(date,
    2) AS INTEGER) AS d FROM d""")
def er_dates(spark, sf_dir):
    v = person_view(spark, sf_dir).select("id", CLEAN_DATE(F.col("birthday")).alias("date"))
    return v.select("id", "date", K.birthday_triple(F.col("date")).alias("t")).select("id", "date", "t.*")


@query("SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '^(https://)*(http://)*(www\\.)*', ''), '/+$', '') AS url_key FROM pages")
def er_url_key(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", URL_KEY(F.col("url")).alias("url_key"))


FOLD_SQL = "trim(regexp_replace(regexp_replace(replace(strip_accents(lower({x})), 'ß', 'ss'), '[''`’]', '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({FOLD_SQL.format(x='text')}) AS folded, length({FOLD_SQL.format(x='text')})::BIGINT AS n FROM documents")
def er_fold(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", udfs.fold("text").alias("f")).select("doc_id", F.md5("f").alias("folded"), F.length("f").cast("long").alias("n"))


KEY_SQL = """
n AS (SELECT *, 'person' AS kind, lower(wg) AS g, lower(wf) AS f,
  CASE WHEN org = '' THEN '' ELSE trim(regexp_replace(regexp_replace(' ' || replace(lower(regexp_replace(org, '\\([^)]*\\) *', '')), ' ', '  ') || ' ',
      ' (ltd|co|gmbh) ', ' ', 'g'), ' +', ' ', 'g')) END AS o FROM k)"""


@query(f"WITH $VIEW, {EMAIL_SQL}, {KEY_SQL} SELECT id, kind, g AS given, f AS family, o AS org FROM n")
def er_name_key(spark, sf_dir):
    c = contacts(spark, sf_dir)
    return c.select("id", udfs.name_key(F.col("name"), F.col("formatted_name"), F.col("org")).alias("k")).select("id", "k.*")


WORDS_SQL = "w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS x FROM part)"


@query(f"WITH {WORDS_SQL} SELECT a.x AS a, b.x AS b, damerau_levenshtein(a.x, b.x)::INTEGER AS dl, round(jaro_winkler_similarity(a.x, b.x), 6) AS jw FROM w a JOIN w b ON a.x < b.x")
def er_distances(spark, sf_dir):
    w = read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("a")).distinct()  # the few words of part names
    pairs = w.join(w.withColumnRenamed("a", "b"), F.col("a") < F.col("b"))
    return pairs.select("a", "b", udfs.damerau_levenshtein("a", "b").alias("dl"), F.round(udfs.jaro_winkler("a", "b"), 6).alias("jw"))


NICK_SQL = "x AS (SELECT *, list_distinct([g] || CASE g WHEN 'bob' THEN ['robert'] WHEN 'liz' THEN ['elizabeth'] WHEN 'beth' THEN ['elizabeth'] WHEN 'mike' THEN ['michael'] WHEN 'danny' THEN ['daniel'] WHEN 'tom' THEN ['thomas'] ELSE [] END) AS gs FROM n)"
BLOCK_SQL = f"""WITH $VIEW, {EMAIL_SQL}, {KEY_SQL}, {NICK_SQL},
keys AS (SELECT id, 'p:' || phone_key AS key FROM x UNION SELECT id, 't:' || right(phone_key, 9) FROM x UNION SELECT id, 'e:' || email_key FROM x
    WHERE email_key IS NOT NULL
  UNION SELECT id, 'n:' || f || '|' || left(y, 1) FROM x, unnest(gs) AS t(y) WHERE octet_length(encode(f)) > 1 UNION SELECT id, 'n:' || y || '|' || left(f, 1) FROM x,
      unnest(gs) AS t(y) WHERE octet_length(encode(f)) > 1),
sized AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM keys), capped AS (SELECT id, key FROM sized WHERE n <= 300 OR left(key, 2) NOT IN ('n:', 'c:'))"""


@query(BLOCK_SQL + " SELECT id, key FROM capped")
def er_block_keys(spark, sf_dir):
    return capped_keys(prepare(contacts(spark, sf_dir), "IN")).select("id", "key")


@query(BLOCK_SQL + " SELECT DISTINCT a.id AS a, b.id AS b FROM capped a JOIN capped b USING (key) WHERE a.id < b.id")
def er_candidates(spark, sf_dir):
    return candidates(prepare(contacts(spark, sf_dir), "IN"))


@query(f"""WITH RECURSIVE $VIEW, {EMAIL_SQL}, e AS (SELECT a.id AS x, b.id AS y FROM k a JOIN k b ON a.id <> b.id AND (a.phone_key = b.phone_key OR a.email_key = b.email_key)),
r(x, y) AS (SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x) SELECT x AS node, min(y) AS label FROM r GROUP BY x""".replace(", e AS (SELECT a.id", ", edges AS (SELECT a.id").replace("SELECT x, x FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x", "SELECT x, x FROM edges UNION SELECT r.x, edges.y FROM r JOIN edges ON r.y = edges.x"))
def er_components(spark, sf_dir):
    p = prepare(contacts(spark, sf_dir), "IN")
    keys = p.select("id", F.explode(F.concat(F.transform("phones", lambda x: x["key"]), F.col("emails"))).alias("key"))
    firsts = keys.groupBy("key").agg(F.min("id").alias("first"))
    return components(keys.join(firsts, "key").select(F.col("first").alias("a"), F.col("id").alias("b")))


QUALITY_SQL = """q AS (SELECT *, 14 - CASE WHEN length(g) = 1 THEN 5 ELSE 0 END - CASE WHEN copy = 2 THEN 1 ELSE 0 END - CASE WHEN len(gs) > 1 THEN 2
    ELSE 0 END + CAST(floor(least(length(g), 8) / 3) AS INTEGER) AS quality FROM x)"""


# --- the heart of the engine ------------------------------------------------------------------------

CHAIN = BLOCK_SQL.removeprefix("WITH ")


def analysed(spark, sf_dir):
    return analyze(contacts(spark, sf_dir), "IN")


def by_person(spark, sf_dir) -> DataFrame:
    """A merge of each person's copies."""
    of = person_view(spark, sf_dir).groupBy("pid").agg(F.sort_array(F.collect_list("id")).alias("members")).where(F.size("members") > 1)
    return of.select(F.col("pid").alias("merge"), "members", F.lit(None).cast(CHOICES).alias("choices"))


BY_PERSON_SQL = f"WITH {CHAIN}, {QUALITY_SQL}, mg AS (SELECT pid AS merge, list(id ORDER BY id) AS members FROM v GROUP BY pid HAVING count(*) > 1), {golden('mg')}"
ids_of = lambda column: F.array_join(F.col(column).cast("array<string>"), ",")


@query(f"WITH {CHAIN}, {SCORED} SELECT CASE WHEN score >= 1::FLOAT THEN 'sure' WHEN score >= 0.7::FLOAT THEN 'likely' ELSE 'check' END AS tier, count(*) AS n FROM scored GROUP BY 1")
def er_identifier_tiers(spark, sf_dir):
    """The flagship: contacts prepared, blocked, scored and sorted into tiers."""
    return analysed(spark, sf_dir).pairs.groupBy(K.tier_of(F.col("score")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHAIN}, {WORDS}, {SHARED} SELECT phone_key AS key, '+91 ' || substr(phone_key, 4, 5) || ' ' || substr(phone_key, 9) AS display, string_agg(id::VARCHAR,
    ',' ORDER BY id) AS contacts
  FROM x WHERE phone_key IN (SELECT phone_key FROM sh) GROUP BY phone_key
  UNION ALL SELECT email_key, email_key, string_agg(id::VARCHAR, ',' ORDER BY id) FROM x WHERE email_key IN (SELECT email_key FROM she) GROUP BY email_key""")
def er_shared_identifiers(spark, sf_dir):
    found = shared_identifiers(checkpoint(prepare(contacts(spark, sf_dir), "IN")))
    return found.select("key", "display", ids_of("contacts").alias("contacts"))


@query(f"WITH {CHAIN}, {SCORED} SELECT a, b, round(score::DOUBLE, 4) AS score, names, evidence FROM scored")
def er_scored_pairs(spark, sf_dir):
    texts = F.array_join(F.transform("evidence", lambda e: e["text"]), "; ")
    return analysed(spark, sf_dir).pairs.select("a", "b", F.round(F.col("score").cast("double"), 4).alias("score"), "names", texts.alias("evidence"))


@query(f"WITH {CHAIN}, {WORDS}, cand AS (SELECT DISTINCT a.id AS a, b.id AS b FROM capped a JOIN capped b USING (key) WHERE a.id < b.id), cmp AS ({compared('cand')}) SELECT names, count(*) AS n FROM cmp GROUP BY names")
def er_name_relations(spark, sf_dir):
    prepared = checkpoint(prepare(contacts(spark, sf_dir), "IN"))
    side = lambda s: prepared.select(F.col("id").alias(s), F.col("name").alias("n" + s))
    both = candidates(prepared).join(side("a"), "a").join(side("b"), "b")
    return both.groupBy(udfs.compare_names(F.col("na"), F.col("nb")).alias("names")).agg(F.count(F.lit(1)).alias("n"))


GROUP_SQL = f"WITH RECURSIVE {CHAIN}, {GROUPS}"


@query(GROUP_SQL + " SELECT grp AS \"group\", array_to_string(members, ',') AS members, round(score::DOUBLE, 4) AS score, tier FROM tiered")
def er_groups(spark, sf_dir):
    return analysed(spark, sf_dir).groups.select("group", ids_of("members").alias("members"), F.round(F.col("score").cast("double"), 4).alias("score"), "tier")


@query(GROUP_SQL + ", u AS (SELECT grp, unnest(members) AS id FROM tiered) SELECT p.grp AS \"group\", a, b FROM scored JOIN u p ON p.id = a JOIN u q ON q.id = b WHERE p.grp = q.grp")
def er_group_pairs(spark, sf_dir):
    a = analysed(spark, sf_dir)
    return group_pairs(a.groups, a.pairs).select("group", "a", "b")


@query(GROUP_SQL + " SELECT unnest(members) AS id FROM tiered UNION SELECT id FROM x WHERE phone_key IN (SELECT phone_key FROM sh) OR email_key IN (SELECT email_key FROM she)")
def er_shown_contacts(spark, sf_dir):
    return shown_ids(analysed(spark, sf_dir))


@query(GROUP_SQL + """, top AS (SELECT * FROM tiered ORDER BY list_position(['sure', 'likely', 'check'], tier), grp LIMIT 10)
SELECT grp AS "group", tier, round(score::DOUBLE * 100) / 100 AS score, (SELECT string_agg(formatted_name, '; ' ORDER BY id) FROM v WHERE list_contains(members,
    id)) AS members FROM top""")
def er_top_groups(spark, sf_dir):
    """The first ten groups of the report, in its order."""
    rows = group_rows(analysed(spark, sf_dir), contacts(spark, sf_dir)).limit(10)  # a top-k report
    return rows.select("group", "tier", "score", F.array_join(F.transform("members", lambda m: m["name"]), "; ").alias("members"))


def golden_columns(gold: DataFrame, merge: str = "merge") -> DataFrame:
    values = lambda column: F.array_join(F.transform(f"contact.{column}", lambda p: p["value"]), ",")
    return gold.select(F.col(merge).alias("merge"), "contact.formatted_name", values("phones").alias("phones"), values("emails").alias("emails"), "contact.birthday", "contact.org", "contact.note")


GOLD_COLUMNS = "formatted_name, phones, emails, birthday, org, note"


@query(GROUP_SQL + f", {QUALITY_SQL}, mg AS (SELECT grp AS merge, members FROM tiered), {golden('mg')} SELECT merge, {GOLD_COLUMNS} FROM gold")
def er_golden_records(spark, sf_dir):
    c = contacts(spark, sf_dir)
    return golden_columns(golden_records(c, from_groups(analyze(c, "IN").groups, "all"), "IN"))


@query(GROUP_SQL + f""", {QUALITY_SQL}, mg AS (SELECT grp AS merge, members FROM tiered WHERE tier IN ('sure', 'likely')), {golden('mg')}
SELECT merge AS id, {GOLD_COLUMNS} FROM gold UNION ALL SELECT q.id, q.formatted_name, q.phone, q.email, CASE q.copy WHEN 0 THEN v.birthday
    WHEN 1 THEN '--' || substr(v.birthday, 3, 2) || '-' || substr(v.birthday, 5, 2)
  ELSE split_part(v.birthday, '/', 3) || '-' || lpad(split_part(v.birthday, '/', 1), 2, '0') || '-' || lpad(split_part(v.birthday, '/', 2), 2, '0') END, q.org,
      'Note ' || q.pid FROM q JOIN v USING (id) WHERE q.id NOT IN (SELECT id FROM of)""")
def er_clean_book(spark, sf_dir):
    c = contacts(spark, sf_dir)
    clean = apply_merges(c, from_groups(analyze(c, "IN").groups, "likely"), "IN").contacts
    return golden_columns(clean.select("id", F.struct(*clean.columns).alias("contact")), "id").withColumnRenamed("merge", "id")


@query(GROUP_SQL + """, u AS (SELECT grp, tier, unnest(members) AS id FROM tiered), found AS (SELECT p.grp, p.tier, p.id AS a, q.id AS b FROM u p JOIN u q ON p.grp = q.grp AND p.id < q.id),
truth AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.pid = b.pid AND a.id < b.id), people AS (SELECT list(id ORDER BY id) AS members FROM v
    GROUP BY pid HAVING count(*) > 1),
levels AS (SELECT unnest(['sure', 'sure+likely', 'all']) AS level, unnest([['sure'], ['sure', 'likely'], ['sure', 'likely', 'check']]) AS tiers),
counted AS (SELECT level, (SELECT count(*) FROM found WHERE list_contains(tiers, tier)) AS found, (SELECT count(*) FROM found JOIN truth USING (a, b)
    WHERE list_contains(tiers, tier)) AS "right", (SELECT count(*) FROM truth) AS "true",
  (SELECT count(*) FROM tiered JOIN people USING (members) WHERE list_contains(tiers, tier)) AS exact, (SELECT count(*) FROM people) AS people FROM levels)
SELECT *, CASE WHEN found = 0 THEN 'n/a' ELSE printf('%.1f%%', 100.0 * "right" / found) END AS precision, printf('%.1f%%', 100.0 * "right" / "true") AS recall
    FROM counted""")
def er_pair_quality(spark, sf_dir):
    truth = person_view(spark, sf_dir).select("id", F.col("pid").alias("person"))
    return pair_quality(analysed(spark, sf_dir).groups, truth)


@query(BY_PERSON_SQL + " SELECT merge AS pid, pick, formatted_name FROM gold")
def er_golden_name(spark, sf_dir):
    """Which copy's name each person keeps: quality and agreement with the other copies, ties to the lowest id."""
    gold = golden_records(contacts(spark, sf_dir), by_person(spark, sf_dir), "IN")
    return gold.select(F.col("merge").alias("pid"), F.col("choices.name").alias("pick"), "contact.formatted_name")


@query(BY_PERSON_SQL + """ SELECT merge AS pid, min(CASE WHEN date = (SELECT date FROM gbd WHERE gbd.merge = gm.merge) THEN id END) AS birthday, min(CASE WHEN org <> '' THEN id END) AS org
     FROM gm GROUP BY merge""")
def er_most_common(spark, sf_dir):
    """The copies whose birthday and organisation each person keeps."""
    gold = golden_records(contacts(spark, sf_dir), by_person(spark, sf_dir), "IN")
    return gold.select(F.col("merge").alias("pid"), "choices.birthday", "choices.org")


@query(BY_PERSON_SQL + """, alt AS (SELECT merge, CASE copy WHEN 2 THEN f || ' ' || g ELSE g || ' ' || f END AS folded, list({'q': quality, 'i': id, 'n': formatted_name} ORDER BY quality DESC,
    id) AS held FROM gm GROUP BY 1, 2)
SELECT merge AS pid, string_agg(held[1].n, '; ' ORDER BY held[1].q DESC, held[1].i) AS names, string_agg(array_to_string(list_transform(held, lambda h: h.i), ','),
    '; ' ORDER BY held[1].q DESC, held[1].i) AS ids FROM alt GROUP BY merge""")
def er_alternatives(spark, sf_dir):
    """The different names to choose from, best first, and the copies that have them."""
    gold = golden_records(contacts(spark, sf_dir), by_person(spark, sf_dir), "IN")
    names = F.transform("alternatives.name", lambda a: a["value"])
    ids = F.transform("alternatives.name", lambda a: F.array_join(a["from"].cast("array<string>"), ","))
    return gold.select(F.col("merge").alias("pid"), F.array_join(names, "; ").alias("names"), F.array_join(ids, "; ").alias("ids"))


@query(f"WITH $VIEW, {EMAIL_SQL}, {KEY_SQL}, {NICK_SQL}, {QUALITY_SQL} SELECT id, quality FROM q")
def er_name_quality(spark, sf_dir):
    quality = udfs.each(name_quality, T.IntegerType())
    return contacts(spark, sf_dir).select("id", quality(F.struct("formatted_name", "name", "org"), True).alias("quality"))


AWKWARD_SQL = """a AS (SELECT c_custkey AS id, c_custkey % 5 = 0 AS nameless, c_custkey % 3 AS m, '91234' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS tail FROM customer)"""


@query(f"""WITH {AWKWARD_SQL} SELECT 'no_country' AS problem, id, '0' || tail AS number FROM a WHERE m < 2 UNION ALL SELECT 'no_name', id, NULL FROM a WHERE nameless AND m < 2
UNION ALL SELECT 'empty', id, NULL FROM a WHERE nameless AND m = 2""")
def er_problems(spark, sf_dir):
    p = problems(awkward(spark, sf_dir), "IN")
    row = lambda df, kind, number: df.select(F.lit(kind).alias("problem"), "id", number.alias("number"))
    none = F.lit(None).cast("string")
    return row(p.no_country, "no_country", F.col("number")).union(row(p.no_name, "no_name", none)).union(row(p.empty, "empty", none))


@query(f"WITH $VIEW, {AWKWARD_SQL} SELECT id, CASE WHEN nameless THEN '' ELSE trim(formatted_name) END AS display, nameless AND m = 2 AS void FROM a JOIN v USING (id)")
def er_display(spark, sf_dir):
    return awkward(spark, sf_dir).select("id", K.display_name(F.col("formatted_name"), F.col("name"), F.col("org")).alias("display"), K.is_empty_contact().alias("void"))


@query("WITH $VIEW SELECT id, CASE copy WHEN 0 THEN 'Mobile' WHEN 1 THEN 'Office' ELSE 'Home' END AS label FROM v")
def er_field_label(spark, sf_dir):
    return contacts(spark, sf_dir).select("id", K.field_label(F.col("phones")[0]["types"], F.col("phones")[0]["label"]).alias("label"))


APART_SQL = groups("m.pid % 7 = 0 AND n.pid = m.pid AND m.copy + n.copy = 2")


@query(f"WITH RECURSIVE {CHAIN}, {APART_SQL} SELECT grp AS \"group\", array_to_string(members, ',') AS members, round(score::DOUBLE, 4) AS score, tier FROM tiered")
def er_groups_kept_apart(spark, sf_dir):
    """Groups when a user has said of each seventh person that the first and the last copy are different people, the later one named first."""
    v = person_view(spark, sf_dir).where("pid % 7 = 0 and copy <> 1")
    first, last = v.where("copy = 0").select("pid", F.col("id").alias("b")), v.where("copy = 2").select("pid", F.col("id").alias("a"))
    found = analyze(contacts(spark, sf_dir), "IN", first.join(last, "pid").select("a", "b")).groups
    return found.select("group", ids_of("members").alias("members"), F.round(F.col("score").cast("double"), 4).alias("score"), "tier")


@query(GROUP_SQL + """, u AS (SELECT grp, unnest(members) AS id FROM tiered WHERE tier IN ('sure', 'likely'))
SELECT (SELECT count(*) FROM v) AS contacts_in, (SELECT count(*) FROM v) - (SELECT count(*) FROM u) + (SELECT count(DISTINCT grp) FROM u) AS contacts_out, (SELECT count(DISTINCT grp) FROM u) AS groups_merged, 0::BIGINT AS empty_dropped""")
def er_summary(spark, sf_dir):
    c = contacts(spark, sf_dir)
    return apply_merges(c, from_groups(analyze(c, "IN").groups, "likely"), "IN").summary


AWKWARD_SUMMARY_SQL = """SELECT count(*) AS contacts_in, count(*) FILTER (NOT (nameless AND m = 2)) AS contacts_out, 0::BIGINT AS groups_merged, count(*) FILTER (nameless AND m = 2) AS empty_dropped FROM a"""


@query(f"WITH {AWKWARD_SQL} {AWKWARD_SUMMARY_SQL}")
def er_empty_dropped(spark, sf_dir):
    """The summary of a book in which nothing is merged and empty contacts are left out."""
    none = by_person(spark, sf_dir).limit(0)
    return apply_merges(awkward(spark, sf_dir), none, "IN").summary


TRUTH_SQL = """u AS (SELECT grp, tier, unnest(members) AS id FROM tiered), found AS (SELECT p.grp, p.tier, p.id AS a, q.id AS b FROM u p JOIN u q ON p.grp = q.grp AND p.id < q.id),
truth AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.pid = b.pid AND a.id < b.id)"""


def truth_of(spark, sf_dir) -> DataFrame:
    return person_view(spark, sf_dir).select("id", F.col("pid").alias("person"))


@query(GROUP_SQL + f""", {TRUTH_SQL}, missed AS (SELECT a, b FROM truth EXCEPT SELECT a, b FROM found WHERE tier = 'likely' ORDER BY a, b LIMIT 5)
SELECT a, b, m.formatted_name AS name_a, n.formatted_name AS name_b, m.phone AS phone_a, n.email AS email_b FROM missed JOIN v m ON m.id = a JOIN v n ON n.id = b""")
def er_first_missed(spark, sf_dir):
    """The first five pairs of one person that likely groups don't hold."""
    c = contacts(spark, sf_dir)
    rows = first_missed(analyze(c, "IN").groups.where("tier = 'likely'"), truth_of(spark, sf_dir), c, 5)  # a report of the first few
    one = lambda column: F.coalesce(F.get(column, F.lit(0)), F.lit(""))
    name = lambda s: F.col(f"contact_{s}.name").alias(f"name_{s}")
    return rows.select("a", "b", name("a"), name("b"), one(F.col("contact_a.phones")).alias("phone_a"), one(F.col("contact_b.emails")).alias("email_b"))


@query(GROUP_SQL + f""", {TRUTH_SQL},
wrong AS (SELECT a, b, grp FROM found WHERE NOT EXISTS (SELECT 1 FROM v m JOIN v n ON m.pid = n.pid AND m.copy <> 2 AND n.copy <> 2 WHERE m.id = a AND n.id = b) ORDER BY a, b LIMIT 7)
SELECT a, b, tier, evidence AS why FROM wrong JOIN tiered USING (grp) LEFT JOIN scored USING (a, b)""")
def er_first_wrong(spark, sf_dir):
    """The first seven wrong pairs against a truth in which the last copies are people of their own."""
    found = analysed(spark, sf_dir)
    person = F.when(F.col("copy") == 2, -1 - F.col("id")).otherwise(F.col("pid"))
    truth = person_view(spark, sf_dir).select("id", person.alias("person"))
    return first_wrong(found.groups, found.pairs, truth, 7)  # a report of the first few


@query(GROUP_SQL + """, u AS (SELECT grp, tier, unnest(members) AS id FROM tiered), who AS (SELECT grp, tier, CASE copy WHEN 2 THEN -1 - pid ELSE pid END AS person FROM u JOIN v USING (id)),
traps AS (SELECT DISTINCT CASE pid % 2 WHEN 0 THEN 'even' ELSE 'odd' END AS kind, -1 - pid AS person1, pid AS person2 FROM v),
pairs AS (SELECT p.person AS person1, q.person AS person2, bool_or(p.tier = 'sure') AS sure FROM who p JOIN who q ON p.grp = q.grp GROUP BY 1, 2)
SELECT kind, count(*) AS total, count(sure) AS wrong, count(*) FILTER (sure) AS wrong_as_sure FROM traps LEFT JOIN pairs USING (person1, person2) GROUP BY kind""")
def er_trap_table(spark, sf_dir):
    """Traps: each person's last copy as another person who must not be grouped with them."""
    person = F.when(F.col("copy") == 2, -1 - F.col("pid")).otherwise(F.col("pid"))
    truth = person_view(spark, sf_dir).select("id", person.alias("person"))
    kind = F.when(F.col("pid") % 2 == 0, "even").otherwise("odd")
    traps = person_view(spark, sf_dir).select(kind.alias("kind"), (-1 - F.col("pid")).alias("person1"), F.col("pid").alias("person2")).distinct()
    return trap_table(analysed(spark, sf_dir).groups, truth, traps)


@query(GROUP_SQL + f""", {TRUTH_SQL}, tags AS (SELECT id, CASE copy WHEN 1 THEN ['name', 'kind' || (pid + CAST(floor(pid / 16) AS BIGINT)) % 4] WHEN 2 THEN ['case'] ELSE [] END AS t FROM v),
pairs AS (SELECT a, b, list_distinct(list_concat(m.t, n.t)) AS t, EXISTS (SELECT 1 FROM found f WHERE f.a = truth.a AND f.b = truth.b) AS hit FROM truth JOIN tags m ON m.id = a JOIN tags n ON n.id = b)
SELECT tag, count(*) AS total, count(*) FILTER (NOT hit) AS missed FROM (SELECT hit, unnest(CASE WHEN len(t) = 0 THEN ['none'] ELSE t END) AS tag FROM pairs) GROUP BY tag""")
def er_missed_by_damage(spark, sf_dir):
    v = person_view(spark, sf_dir)
    kind = F.concat(F.lit("kind"), ((F.col("pid") + F.floor(F.col("pid") / 16)) % 4).cast("string"))
    none = F.array().cast("array<string>")
    tags = F.when(F.col("copy") == 1, F.array(F.lit("name"), kind)).when(F.col("copy") == 2, F.array(F.lit("case"))).otherwise(none)
    return missed_by_damage(analysed(spark, sf_dir).groups, truth_of(spark, sf_dir), v.select("id", tags.alias("tags")))


@query(BY_PERSON_SQL + """, base AS (SELECT gname.merge, q.g, q.gs FROM gname JOIN q ON q.id = pick),
nick AS (SELECT gm.merge, gm.g, min(gm.id) AS id, arg_min(CASE gm.copy WHEN 2 THEN upper(gm.given) ELSE gm.wg END, gm.id) AS word FROM gm JOIN base ON base.merge = gm.merge WHERE gm.g <> base.g AND list_has_any(gm.gs, base.gs) GROUP BY gm.merge, gm.g),
tel AS (SELECT merge, min(id) AS first, CASE WHEN arg_min(phone, id) LIKE '+%' THEN arg_min(phone, id) ELSE coalesce(arg_min(phone, id) FILTER (phone LIKE '+%'), arg_min(phone, id)) END
  || '/' || coalesce(string_agg(CASE copy WHEN 0 THEN 'cell' WHEN 2 THEN 'home' END, ' ' ORDER BY id), '') || '/' || CASE WHEN bool_or(copy = 1) THEN 'Office' ELSE '' END AS t FROM gm GROUP BY merge, phone_key)
SELECT merge AS pid, coalesce((SELECT string_agg(word, ',' ORDER BY id) FROM nick WHERE nick.merge = gold.merge), '') AS nicknames, (SELECT string_agg(t, ';' ORDER BY first) FROM tel WHERE tel.merge = gold.merge) AS phones FROM gold""")
def er_golden_fields(spark, sf_dir):
    """Nicknames won from other copies' names, and numbers with the types and the label of all copies that have them."""
    gold = golden_records(contacts(spark, sf_dir), by_person(spark, sf_dir), "IN")
    phone = lambda p: F.concat_ws("/", p["value"], F.array_join(p["types"], " "), F.coalesce(p["label"], F.lit("")))
    return gold.select(F.col("merge").alias("pid"), F.array_join("contact.nicknames", ",").alias("nicknames"), F.array_join(F.transform("contact.phones", phone), ";").alias("phones"))


# --- files ------------------------------------------------------------------------------------------

FIELD_LINES = """'BEGIN:VCARD' || e || 'VERSION:3.0' || e || 'PRODID:-//kinweave//EN' || e || 'N:;;;;' || e || 'FN:' || replace(formatted_name, ',', '\\,') || e || CASE WHEN org = '' THEN '' ELSE 'ORG:' || org || e END
  || CASE copy WHEN 0 THEN 'TEL;TYPE=CELL:' || phone WHEN 1 THEN 'item1.TEL:' || phone || e || 'item1.X-ABLabel:Office' ELSE 'TEL;TYPE=HOME:' || phone END || e
  || CASE WHEN email = '' THEN '' ELSE 'EMAIL;TYPE=INTERNET:' || email || e END || CASE WHEN url = '' THEN '' ELSE 'URL:' || url || e END
  || CASE copy WHEN 0 THEN 'BDAY:' || birthday WHEN 1 THEN 'BDAY;X-APPLE-OMIT-YEAR=1604:1604-' || substr(birthday, 3, 2) || '-' || substr(birthday, 5, 2)
     ELSE 'BDAY:' || split_part(birthday, '/', 3) || '-' || lpad(split_part(birthday, '/', 1), 2, '0') || '-' || lpad(split_part(birthday, '/', 2), 2, '0') END || e || 'NOTE:Note ' || pid || e || 'END:VCARD' || e"""


@query(f"WITH $VIEW SELECT id, {FIELD_LINES} AS card FROM (SELECT *, chr(13) || chr(10) AS e FROM v)")
def er_cards(spark, sf_dir):
    return cards(contacts(spark, sf_dir))


@query("""WITH $VIEW SELECT row_number() OVER (ORDER BY c_nationkey::VARCHAR, id) - 1 AS id, trim(formatted_name) AS formatted_name, phone, email, org, 'Note ' || pid AS note
    FROM v JOIN customer ON c_custkey = id""")
def er_book(spark, sf_dir):
    """Cards written as files, a folder a nation below a folder with a blank in its name, and read again by a pattern: the ids are dense over the files."""
    out = f"{own_dir(spark, 'book')}/all cards"
    nation = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    written = cards(contacts(spark, sf_dir)).join(nation, "id").repartition("nation").sortWithinPartitions("nation", "id")
    written.select("nation", "card").write.partitionBy("nation").text(out)
    found = read_book(spark, [f"{out}/nation=*"]).contacts
    first = lambda column: F.coalesce(F.get(F.col(column), F.lit(0))["value"], F.lit(""))
    return found.select("id", "formatted_name", first("phones").alias("phone"), first("emails").alias("email"), "org", "note")


@query("SELECT 'd' || min(doc_id) AS file, 0::BIGINT AS n FROM documents GROUP BY coalesce(text, '')")
def er_equal_files(spark, sf_dir):
    """Texts as files that are no exports: a content given twice is read once."""
    files = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    return book(files).files


@query("""SELECT doc_id, regexp_replace(regexp_replace(text, '([\\\\,;])', '\\\\\\1', 'g'), '\\r\\n|\\r|\\n', '\\\\n', 'g') AS escaped, CASE WHEN regexp_matches(text,
    '[:;,]') THEN '"' || replace(text, '"', '''') || '"' ELSE text END AS quoted FROM documents""")
def er_escaping(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", udfs.each(escaped)(F.col("text")).alias("escaped"), udfs.each(quoted)(F.col("text")).alias("quoted"))


@query("""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN '+1 ' || user_id || CASE WHEN user_id % 3 = 0 THEN ' ext. ' || event_id ELSE '' END ELSE 'tel;' || user_id END AS number,
    CASE WHEN user_id % 2 = 0 THEN event_type ELSE '_$!<' || event_type END AS label FROM events""")
def er_uris_and_labels(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    u, i = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    raw = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit(" TEL:+1 "), u, F.lit(";x=1; ext="), F.when(F.col("user_id") % 3 == 0, i).otherwise(""))).otherwise(F.concat(F.lit("tel;"), u))
    label = F.concat(F.lit("_$!<"), F.col("event_type"), F.when(F.col("user_id") % 2 == 0, ">!$_").otherwise(""))
    return e.select("event_id", udfs.each(telephone)(raw).alias("number"), udfs.each(apple_label)(label).alias("label"))


@query("WITH $VIEW SELECT id, regexp_replace(org, '\\([^)]*\\)', '', 'g') AS outside FROM v")
def er_brackets(spark, sf_dir):
    return person_view(spark, sf_dir).select("id", udfs.each(outside_brackets)(F.col("org")).alias("outside"))


# --- set, order and summary operators ---------------------------------------------------------------


@query("""WITH $VIEW, t AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.pid = b.pid AND a.id < b.id),
f AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.given = b.given AND a.family = b.family AND a.id < b.id)
SELECT (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM t) AS n_true, (SELECT count(*) FROM (SELECT * FROM f INTERSECT SELECT * FROM t)) AS n_right,
  (SELECT count(*) FROM (SELECT * FROM f EXCEPT ALL SELECT * FROM t)) AS n_wrong, (SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM f)) AS n_missed""")
def er_pair_sets(spark, sf_dir):
    v = person_view(spark, sf_dir)
    group = F.when(F.col("given").isNotNull() & F.col("family").isNotNull(), F.struct("given", "family"))
    return pair_sets(v.select("id", group.alias("group"), F.col("pid").alias("person")))


@query("SELECT event_type, count(*) AS n, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high, printf('%.1f%%', 100.0 * sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) / count(*)) AS share FROM events GROUP BY event_type")
def er_percent(spark, sf_dir):
    n = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))
    return n.select("event_type", "n", "high", K.percent(F.col("high"), F.col("n")).alias("share"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN s >= 1::FLOAT THEN 'sure' WHEN s >= 0.7::FLOAT THEN 'likely' WHEN s >= 0.4::FLOAT THEN 'check' END AS tier FROM (SELECT l_orderkey, l_linenumber, (l_quantity / 50)::FLOAT + l_tax::FLOAT AS s FROM lineitem)")
def er_tiers(spark, sf_dir):
    s = K.float_sum(F.array((F.col("l_quantity") / 50).cast("float"), F.col("l_tax").cast("float")))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", K.tier_of(s).alias("tier"))


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

