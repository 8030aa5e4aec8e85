import json

import pytest
from pyspark.sql import functions as F

from kinweave.plans import evaluate, lookup
from kinweave.plans import generate as g
from kinweave.plans.analyze import analyze
from kinweave.schema import CONTACT_DDL, blank
from kinweave.sinks.vcard import cards
from kinweave.sources.book import read_file
from kinweave.sources.truth import of_contacts, read_truth


@pytest.fixture(scope="module")
def made(spark):
    out = g.generate(spark, 600, seed=5)
    return g.Generated(out.contacts.cache(), out.truth.cache(), out.traps.cache())


def test_ids_are_dense_and_the_same_again(spark, made):
    rows = made.contacts.orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(len(rows))) and len(rows) > 750
    assert [r["source"]["file"] for r in rows] == sorted((r["source"]["file"] for r in rows), key=g.FILES.index)
    for f in g.FILES:
        own = [r["source"]["index"] for r in rows if r["source"]["file"] == f]
        assert own == list(range(len(own)))
    again = g.generate(spark, 600, seed=5).contacts.orderBy("id").collect()
    assert again == rows
    kinds = {t for r in made.truth.collect() for t in r["tags"]}
    assert kinds == set(g.DAMAGE)


def test_exports_are_read_back(made):
    want = {r["id"]: r for r in made.contacts.collect()}
    files = {f: [r for r in sorted(want.values(), key=lambda r: r["id"]) if r["source"]["file"] == f] for f in g.FILES}

    def texts(df, column):
        return {r["id"]: r[column] for r in df.collect()}

    google, outlook, android, icloud = texts(g.google_lines(made.contacts), "line"), texts(g.outlook_lines(made.contacts), "line"), texts(g.android_cards(made.contacts), "card"), texts(cards(made.contacts), "card")
    data = {
        "icloud.vcf": "".join(icloud[r["id"]] for r in files["icloud.vcf"]).encode(),
        "google.csv": "\r\n".join([g.GOOGLE_HEADER, *(google[r["id"]] for r in files["google.csv"])]).encode(),
        "android.vcf": "".join(android[r["id"]] for r in files["android.vcf"]).encode(),
        "outlook.csv": "\r\n".join([g.OUTLOOK_HEADER, *(outlook[r["id"]] for r in files["outlook.csv"])]).encode("cp1252"),
    }
    for name, content in data.items():
        rows, issues = read_file(name, content)
        assert not issues
        shown = [r for r in files[name] if name.endswith("vcf") or any((r["name"]["given"], r["name"]["family"], r["phones"], r["emails"]))]
        assert len(rows) == len(shown)
        for got, r in zip(rows, shown, strict=True):
            assert (got["name"]["given"], got["name"]["family"], got["birthday"]) == (r["name"]["given"], r["name"]["family"], r["birthday"])
            assert sorted(p["value"] for p in got["phones"]) == sorted(p["value"] for p in r["phones"])
            assert [e["value"] for e in got["emails"]] == [e["value"] for e in r["emails"]]


def test_quality_on_a_generated_book(made):
    found = analyze(made.contacts, "IN")
    rows = {r["level"]: r for r in evaluate.pair_quality(found.groups, made.truth).collect()}
    share = lambda r, k: float(r[k].rstrip("%"))
    assert share(rows["sure"], "precision") >= 99 and share(rows["all"], "precision") >= 97 and share(rows["all"], "recall") >= 80
    traps = {r["kind"]: r for r in evaluate.trap_table(found.groups, made.truth, made.traps).collect()}
    assert set(traps) == {"household", "family_email", "same_name", "switchboard"} and all(r["wrong_as_sure"] == 0 for r in traps.values())
    missed = evaluate.first_missed(found.groups.where("tier = 'sure'"), made.truth, made.contacts, 3).collect()
    assert len(missed) == 3 and missed == sorted(missed, key=lambda r: (r["a"], r["b"]))
    assert evaluate.first_wrong(found.groups, found.pairs, made.truth, 5).count() <= 5


def test_truth_file(spark, tmp_path):
    truth = {"seed": 1, "people": 2, "files": ["a", "b"], "traps": [{"kind": "household", "persons": [0, 1, 2]}]}
    truth["entries"] = [{"file": f, "index": i, "person": p, "empty": False, "damage": d} for f, i, p, d in (("a", 0, 0, []), ("a", 1, 1, ["case"]), ("b", 0, 0, ["typo"]))]
    (tmp_path / "truth.json").write_text(json.dumps(truth, indent=1))
    t = read_truth(spark, f"{tmp_path}/truth.json")
    assert [tuple(r) for r in t.files.orderBy("ord").collect()] == [(0, "a"), (1, "b")]
    assert sorted(tuple(r) for r in t.traps.collect()) == [("household", 0, 1), ("household", 0, 2), ("household", 1, 2)]
    contact = lambda i, f, k: blank() | {"id": i, "source": {"file": f, "index": k, "line": 1}}
    rows = [contact(0, "a", 0), contact(1, "a", 1), contact(2, "b", 0)]
    book = spark.createDataFrame(rows, CONTACT_DDL)
    assert {r["id"]: (r["person"], r["tags"]) for r in of_contacts(t, book).collect()} == {0: (0, []), 1: (1, ["case"]), 2: (0, ["typo"])}
    with pytest.raises(ValueError, match="don't match"):
        of_contacts(t, book.where("id < 2"))
    with pytest.raises(ValueError, match="don't match"):
        of_contacts(t, spark.createDataFrame([*rows, contact(3, "b", 1)], CONTACT_DDL))


def test_lookup(spark):
    photo = {"kind": "data", "mime": "image/png", "bytes": b"\x89PNGx", "uri": None}
    link = {"kind": "uri", "mime": None, "bytes": None, "uri": "http://x/y"}
    book = spark.createDataFrame([blank() | {"id": 1, "photo": photo}, blank() | {"id": 2, "photo": link}, blank() | {"id": 3}], CONTACT_DDL)
    assert {r["id"] for r in lookup.members(book, [3, 1, 1]).collect()} == {1, 3}
    with pytest.raises(ValueError):
        lookup.members(book, [])
    with pytest.raises(LookupError, match="7"):
        lookup.members(book, [1, 7])
    assert lookup.photo(book, 1) == ("image/png", b"\x89PNGx") and lookup.photo(book, 2) == ("link", "http://x/y") and lookup.photo(book, 3) is None and lookup.photo(book, 9) is None
    from kinweave.functions import columns as K

    assert [r[0] for r in book.orderBy("id").select(K.photo_url(F.col("photo"))).collect()] == ["data:image/png;base64,iVBOR3g=", "http://x/y", None]
