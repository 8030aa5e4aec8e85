import random

import pytest
from pyspark.sql import functions as F

from kinweave.functions import columns as K
from kinweave.functions import names as N
from kinweave.functions import phones as P
from kinweave.functions import survivors as S
from kinweave.functions import udfs
from kinweave.functions.distance import damerau_levenshtein, jaro_winkler
from kinweave.schema import blank
from kinweave.sources.dates import clean_date


def key(text, **more):
    return N.name_key(more.get("given", ""), more.get("family", ""), text, more.get("org", ""))


def test_fold():
    assert N.fold("Ｒené  D'Arcy-Peña") == "rene darcy pena"
    assert N.fold("Große Æble Łódź ’x") == "grosse aeble lodz x"
    assert N.fold("नमस्ते") == "नमसत"


def test_brackets():
    for text, want in {"Ann [old] Lee": "Ann  Lee", "a (b (c) d) e": "a  e", "x) y": "x y", "x (y": "x "}.items():
        assert N.outside_brackets(text) == want


def test_name_keys():
    assert key("Prof. Maria K. Lund Sr.")[:3] == ("person", "maria", "k lund")
    assert key("Lund, Maja (home)")[:3] == ("person", "maja", "lund")
    assert key("Dad mobile").kind == key("Granny").kind == "role"
    assert key("K.").kind == key("").kind == "none"
    assert key("Blue Harbor", org="Blue Harbor Ltd.").kind == "company"
    assert key("", org="Blue Harbor").kind == "company"
    assert key("x", given="Eva Lotte", family="Ruiz Sanz")[:3] == ("person", "eva", "ruiz sanz")
    assert key("", given="Robert Hale")[1:3] == ("robert", "hale")
    assert key("Mr")[:2] == ("person", "mr")


# Pairs of names and how they relate: the contract's table, by example.
RELATIONS = [
    ("Edward Stone", "edward  STONE", "exact"), ("Ted Stone (home)", "Edward Stone", "nickname"), ("Kate Moore", "Kathy Moore", "nickname"), ("E. Stone", "Edward Stone", "initial"),
    ("Stone Edward", "Edward Stone", "swapped"), ("Benjamin Stone", "Benjamim Stone", "different"), ("Gregoyr Stone", "Gregory Stone", "typo"), ("René Müller", "Rene Muller", "exact"),
    ("Eva Ruiz Sanz", "Eva Ruiz", "exact"), ("Eva", "Eva Ruiz", "partial"), ("Eva", "Eva", "partial"), ("Eva Ruiz", "Eva Moore", "family_differs"), ("Eva Ruiz", "Paul Ruiz", "different"),
    ("Mom", "Eva Ruiz", "unknown"), ("Eva", "Paul Ruiz", "different"), ("Simon Berg", "Simone Berg", "different"), ("Lena Berg", "Lina Berg", "different"), ("Victoria Berg", "Vicky Berg", "nickname"),
    ("Ruiz E.", "Eva Ruiz", "swapped"), ("Mike", "Hall Michael", "partial"), ("Paul", "P. Ruiz", "partial"), ("Kiran Kapoor", "Kiran Koaor", "similar"),
]


@pytest.mark.parametrize("a,b,want", RELATIONS)
def test_compare_is_symmetric(a, b, want):
    assert N.compare(key(a), key(b)) == N.compare(key(b), key(a)) == want


def test_companies():
    a, b, c = (key("", org=o) for o in ("Blue Harbor Ltd", "blue harbor", "Blue Habror Inc"))
    assert (N.compare(a, b), N.compare(a, c), N.compare(a, key("", org="Other"))) == ("exact", "typo", "different")


def test_distances():
    assert damerau_levenshtein("ca", "abc") == 2 and damerau_levenshtein("", "abc") == 3
    assert round(jaro_winkler("kapoor", "koaor"), 2) == 0.89 and jaro_winkler("", "a") == 0
    r = random.Random(1)
    for _ in range(200):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(2))
        assert damerau_levenshtein(a, b) == damerau_levenshtein(b, a) and abs(jaro_winkler(a, b) - jaro_winkler(b, a)) < 0.2


@pytest.mark.parametrize(
    "raw,region,want",
    [
        ("091234 56789", "IN", "+919123456789"), ("+91 91234-56789", "US", "+919123456789"), ("0091 9123456789", "US", "+919123456789"), ("(415) 555-0199", "US", "+14155550199"), ("1 415 555 0199", "US", "+14155550199"),
        ("+1-415-555-0199 ext. 7", "IN", "+14155550199"), ("07911 654321", "GB", "+447911654321"), ("0151 98765432", "DE", "+4915198765432"), ("+44 (0)20 7946 0018", "US", "+442079460018"), ("*121#", "IN", None), ("100", "IN", None), ("call me", "IN", None), ("12345678", "ZZ", "#12345678"),
    ],
)
def test_phones(raw, region, want):
    found = P.phone(raw, region)
    assert (found and found.key) == want


def test_phone_display_and_region():
    assert P.phone("09123456789", "IN") == ("+919123456789", "+91 91234 56789", False)
    assert P.phone("+1 415 555 0199", "IN").display == "+1 415-555-0199"
    assert P.default_region({"LC_ALL": "en_IN.UTF-8"}) == "IN" and P.default_region({"LANG": "C"}) == "US" and P.default_region({"LANG": "de_DE@euro"}) == "DE"


DATES = {"1984-03-07": "1984-03-07", "19840307": "1984-03-07", "--0307": "--03-07", "--03-07": "--03-07", "1984-03-07T00:00:00Z": "1984-03-07", "3/7/1984": "1984-03-07", "0/0/00": None, "": None, "spring": "spring", "13/45/1984": "13/45/1984", "19841399": "19841399", "a/7/1984": "a/7/1984", " 12/31/1999 ": "1999-12-31"}
EMAILS = {" Ann.B+news@GoogleMail.com ": "annb@gmail.com", "a.n.n@gmail.com": "ann@gmail.com", "Ann.B+x@Acme.example": "ann.b+x@acme.example", "not an email": None, "MAILTO:Ann@Example.org": "ann@example.org", "a@b@c.d": "a@b@c.d", "@x.y": None, "a@b": None, "+x@gmail.com": "@gmail.com"}
URLS = {" HTTPS://www.A.b/c// ": "a.b/c", "https://https://http://www.www.x": "x", "http://https://x": "https://x"}
TEL = {"tel:+1-555-0100;ext=12": "+1-555-0100 ext. 12", "TEL:+1;phone-context=x": "+1", " 555 ": "555", "tel:5;ext=": "5"}
BIRTHDAYS = {"1984-03-07": (1984, 3, 7), "--03-07": (0, 3, 7), "1984-3-7-x": (1984, 3, 7), "x-1-2": None, "--3": None, "1984": None, "70000-1-1": None}


def test_columns_agree_with_functions(spark):
    def check(table, column, plain=None):
        rows = spark.createDataFrame([(k,) for k in table], "x string").select("x", column(F.col("x")).alias("y")).collect()
        assert {r["x"]: r["y"] if not hasattr(r["y"], "asDict") else tuple(r["y"]) for r in rows} == table
        if plain:
            assert {k: plain(k) for k in table} == table

    from kinweave.sinks.vcard import escaped
    from kinweave.sources.vcard import apple_label, telephone

    check(DATES, udfs.each(clean_date), clean_date)
    check(EMAILS, K.email_key, S.email_key)
    check(URLS, udfs.each(S.url_key), S.url_key)
    check(TEL, udfs.each(telephone), telephone)
    check(BIRTHDAYS, K.birthday_triple)
    check({"Ann [old] Lee": "Ann  Lee", "a (b (c) d) e": "a  e", "x) y": "x y", "x (y": "x ", "": ""}, udfs.each(N.outside_brackets))
    check({t: N.fold(t) for t in ("Ｊosé", "ß", "")}, udfs.fold)
    check({g: N.canonical(g) for g in ("ted", "chris", "anna", "")}, K.canonical_names)
    check({"a,b;c\\d\r\ne\rf\ng": "a\\,b\\;c\\\\d\\ne\\nf\\ng"}, udfs.each(escaped))
    check({"_$!<Mobile>!$_": "Mobile", " x ": "x", "_$!<y": "_$!<y"}, udfs.each(apple_label))


def test_float_scores_and_tiers(spark):
    df = spark.createDataFrame([([0.35, 0.1, -0.15, 0.1],), ([0.3, 0.6, 0.5, -1.0],), ([0.6, 0.1],), ([1.0],), ([],)], "w array<float>")
    got = df.select(K.tier_of(K.float_sum(F.col("w"))).alias("t")).collect()
    assert [r["t"] for r in got] == [None, "check", "likely", "sure", None]


def contact(i, name="", **more):
    return blank() | {"id": i, "formatted_name": name} | more


def field(v, types=(), label=None):
    return {"value": v, "types": list(types), "label": label}


def test_merge_rules():
    a = contact(0, "Bob Hale", phones=[field("098765 43210", ["cell"])], note="Met in Rome\n\nLikes tea", categories=["Friends"], birthday="--03-07")
    b = contact(1, "Robert Hale", phones=[field("+91 98765 43210", ["home"], "Desk")], emails=[field("r.hale@gmail.com")], note="likes TEA", org="Acme", department="Sales", birthday="1984-03-07", uid="u1")
    c = contact(2, "HALE ROBERT", emails=[field("RHale+x@gmail.com", ["work"])], categories=["friends", "Work"], title="Chef")
    out, picks, offered = S.merge([a, b, c], "IN")
    assert out["formatted_name"] == "Robert Hale" and out["nicknames"] == ["Bob"] and out["id"] == 0 and out["uid"] == "u1"
    assert out["phones"] == [field("+91 98765 43210", ["cell", "home"], "Desk")] and out["emails"] == [field("r.hale@gmail.com", ["work"])]
    assert out["note"] == "Met in Rome\n\nLikes tea" and out["categories"] == ["Friends", "Work"] and out["birthday"] == "1984-03-07"
    assert (out["org"], out["department"], out["title"]) == ("Acme", "Sales", "Chef") and offered["org"] == [{"from": [1], "value": "Acme, Sales"}]
    assert picks == {"name": 1, "birthday": 1, "org": 1, "title": 2, "photo": None}
    out, picks, _ = S.merge([a, b, c], "IN", {"name": 0, "birthday": 0, "title": 1})
    assert out["formatted_name"] == "Bob Hale" and out["birthday"] == "--03-07" and picks["title"] == 2


def test_merged_extras_rename_groups():
    e = lambda g, n, v: {"group": g, "name": n, "params": [], "value": v}
    a, b = contact(0, extra=[e("item1", "X-ABDATE", "1"), e("item1", "X-ABLABEL", "L"), e(None, "X", "1")]), contact(1, extra=[e("item1", "X-ABDATE", "2"), e(None, "X", "1")])
    assert [(x["group"], x["value"]) for x in S.merged_extras([a, b])] == [(None, "1"), ("item1", "1"), ("item1", "L"), ("cm1", "2")] or [(x["group"], x["value"]) for x in S.merged_extras([a, b])] == [("item1", "1"), ("item1", "L"), (None, "1"), ("cm1", "2")]
