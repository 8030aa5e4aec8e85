import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.functions.names import NameKey, name_key
from kinweave.operators.clustering import agglomerate, cluster
from kinweave.operators.components import components
from kinweave.operators.survivorship import apply_merges, claimed, from_groups
from kinweave.plans import evaluate
from kinweave.plans.analyze import analyze
from kinweave.plans.report import described, json_report, text_report
from kinweave.plans.review import Review
from kinweave.schema import CONTACT, CONTACT_DDL, blank
from kinweave.sinks.vcard import write_vcards
from kinweave.sources.vcard import read as read_vcard


def field(v, types=("cell",)):
    return {"value": v, "types": list(types), "label": None}


def person(i, name, phones=(), emails=(), **more):
    row = blank() | {"id": i, "formatted_name": name, "phones": [field(p) for p in phones], "emails": [field(e, ()) for e in emails]} | more
    return {k: row[k] for k in CONTACT}


PEOPLE = [
    person(0, "Robert Hale", ["+91 91234 50001"], ["bob.hale@gmail.com"], birthday="1984-03-07"),
    person(1, "Bob Hale", ["09123450001"], birthday="--03-07"),
    person(2, "Hale Robert", [], ["bobhale+x@googlemail.com"]),
    person(3, "Eva Ruiz", ["+34 600 000 001"]),
    person(4, "Eva Ruiz", ["600000001"]),
    person(5, "Priya Shah", ["+91 22 2222 2222"]),
    person(6, "Rahul Shah", ["+91 22 2222 2222"]),
    person(7, "", []),
    person(8, "", ["+91 93333 33333"]),
    person(9, "Robert Hale", ["+91 98888 88888"], birthday="1990-01-01"),
]


@pytest.fixture(scope="module")
def book(spark):
    return spark.createDataFrame(PEOPLE, CONTACT_DDL).repartition(3)


@pytest.fixture(scope="module")
def analysis(book):
    return analyze(book, "IN")


def test_pairs_are_explained(analysis):
    pairs = {(r["a"], r["b"]): r for r in analysis.pairs.collect()}
    assert set(pairs) == {(0, 1), (0, 2), (1, 2), (2, 9), (3, 4)}
    assert [e["text"] for e in pairs[0, 1]["evidence"]] == ["names Robert Hale / Bob Hale via nickname", "same mobile +91 91234 50001", "same birthday (day and month)"]
    assert abs(pairs[0, 1]["score"] - 1.15) < 1e-6 and pairs[0, 2]["names"] == "swapped"
    assert [e["text"] for e in pairs[3, 4]["evidence"]][1].startswith("same number if ")


def test_shared_groups_and_problems(analysis):
    assert [(r["key"], r["contacts"]) for r in analysis.shared.collect()] == [("+912222222222", [5, 6])]
    groups = {tuple(r["members"]): r["tier"] for r in analysis.groups.collect()}
    assert set(groups) == {(0, 1, 2), (3, 4)} and groups[3, 4] == "likely"
    p = analysis.problems
    assert [r["id"] for r in p.empty.collect()] == [7] and [r["id"] for r in p.no_name.collect()] == [8]
    assert sorted((r["id"], r["number"]) for r in p.no_country.collect()) == [(1, "09123450001"), (4, "600000001")]


def test_not_duplicates(spark, book):
    apart = spark.createDataFrame([(4, 3), (1, 0)], "a long, b long")
    groups = {tuple(r["members"]) for r in analyze(book, "IN", apart).groups.collect()}
    assert (3, 4) not in groups and not any({0, 1} <= set(g) for g in groups)


def test_clean_book_and_reports(spark, book, analysis, tmp_path):
    done = apply_merges(book, from_groups(analysis.groups, "all"), "IN")
    rows = done.contacts.collect()
    assert [r["id"] for r in rows] == [0, 3, 5, 6, 8, 9] and rows[0]["formatted_name"] == "Robert Hale" and rows[0]["nicknames"] == ["Bob"]
    assert done.summary.first().asDict() == {"contacts_in": 10, "contacts_out": 6, "groups_merged": 2, "empty_dropped": 1}
    out = str(tmp_path / "clean")
    write_vcards(done.contacts, out)
    text = "".join(f.read_bytes().decode() for f in sorted((tmp_path / "clean").glob("part-*")))
    again, issues = read_vcard(text, "clean")
    assert [r["formatted_name"] or r["org"] for r in again] == ["Robert Hale", "Eva Ruiz", "Priya Shah", "Rahul Shah", "", "Robert Hale"] and not issues
    with pytest.raises(Exception, match="(?i)exists"):
        write_vcards(done.contacts, out)
    assert '"tier": "likely"' in json_report(analysis, book, book.select("id").limit(0), book.select("id").limit(0), "IN") and "Eva Ruiz" in text_report(analysis, book)
    assert {r["id"] for r in described(analysis, book).collect()} == {0, 1, 2, 3, 4, 5, 6, 7, 8}


def test_claims(spark):
    rows = {r["merge"]: r["members"] for r in claimed(spark, [([1, 2], None), ([2, 3], None), ([3, 4], {"name": 4}), ([9, 99], None)], {1, 2, 3, 4, 9}).collect()}
    assert rows == {0: [1, 2], 2: [3, 4]}


def test_components_and_clusters_by_component(spark):
    r = random.Random(3)
    words = ["Eva Ruiz", "Ruiz Eva", "E. Ruiz", "Paul Berg", "P. Berg", "Anna Lund", "Mom", "", "Eva Lund"]
    people = {i: {"name": name_key("", "", r.choice(words), ""), "birthday": r.choice([None, None, (1, 1), (2, 2)])} for i in range(60)}
    edges = sorted({(a, b) for a, b in (sorted(r.sample(range(60), 2)) for _ in range(70))})
    pairs = [(a, b, float(np.float32(r.choice([0.4, 0.55, 0.7, 1.1])))) for a, b in edges]
    whole = {tuple(m): s for m, s in agglomerate(people, pairs, set()).values()}
    df = spark.createDataFrame(pairs, "a long, b long, score float")
    prepared = spark.createDataFrame([(i, tuple(p["name"]), None if p["birthday"] is None else (0, *p["birthday"])) for i, p in people.items()], "id long, name struct<kind:string,given:string,family:string,org:string>, birthday struct<y:int,m:int,d:int>")
    got = {tuple(x["members"]): x["score"] for x in cluster(df, prepared).collect()}
    assert got == {k: pytest.approx(v) for k, v in whole.items()}
    root = {i: i for e in edges for i in e}
    for _ in range(60):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {x["node"]: x["label"] for x in components(df).collect()} == root


def test_conflicts_keep_groups_apart():
    n = lambda t: NameKey(*name_key("", "", t, ""))
    people = {0: {"name": n("Eva Ruiz"), "birthday": None}, 1: {"name": n(""), "birthday": None}, 2: {"name": n("Paul Ruiz"), "birthday": None}}
    assert sorted(agglomerate(people, [(0, 1, 0.9), (1, 2, 0.8)], set()).values()) == [([0, 1], pytest.approx(0.9))]


def test_evaluation(spark):
    groups = spark.createDataFrame([(0, [0, 1], 1.1, "sure"), (2, [2, 3, 4], 0.8, "likely")], "group long, members array<long>, score float, tier string")
    truth = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 2)], "id long, person long")
    rows = {r["level"]: (r["found"], r["right"], r["true"], r["exact"], r["precision"], r["recall"]) for r in evaluate.pair_quality(groups, truth).collect()}
    assert rows["sure"] == (1, 1, 3, 1, "100.0%", "33.3%") and rows["all"] == (4, 2, 3, 1, "50.0%", "66.7%")
    wrong, missed = evaluate.wrong_and_missed(groups, truth)
    assert wrong.count() == 2 and [tuple(r) for r in missed.collect()] == [(4, 5)]
    traps = spark.createDataFrame([("k", 1, 2), ("k", 0, 1)], "kind string, person1 long, person2 long")
    assert [tuple(r) for r in evaluate.trap_table(groups, truth, traps).collect()] == [("k", 2, 1, 0)]
    damage = spark.createDataFrame([(0, ["typo"]), (1, []), (2, []), (3, []), (4, ["case", "typo"]), (5, [])], "id long, tags array<string>")
    assert {r["tag"]: (r["total"], r["missed"]) for r in evaluate.missed_by_damage(groups, truth, damage).collect()} == {"typo": (2, 1), "none": (1, 0), "case": (1, 1)}


def test_review():
    r = Review((((0, 1, 2), "sure"), ((3, 4), "likely"), ((5, 6), "sure")))
    r = r.choose("name", 1).split(1).split(2).decide("merge")
    assert r.drafts[0].decision == "apart" and r.drafts[0].choices == () and r.at == 1
    assert r.undo().drafts[0].decision is None and r.accept_sure().counts() == {"merge": 1, "apart": 1, "open": 1}
    r = r.decide("merge")
    assert r.merges() == [([3, 4], {})] and Review(r.groups).load(r.dump()).merges() == r.merges() and Review(r.groups).load("{").counts()["open"] == 3
    for _ in range(300):
        r = r.choose("name", 5)
    assert len(r.history) == 200


def test_stream(spark, tmp_path):
    from kinweave.streaming.incremental import resolve_stream

    source = str(tmp_path / "in")
    spark.createDataFrame(PEOPLE[:5], CONTACT_DDL).coalesce(1).write.parquet(source)
    q = resolve_stream(spark.readStream.schema(CONTACT_DDL).parquet(source), str(tmp_path / "store"), str(tmp_path / "groups"), "IN").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r["members"]) for r in spark.read.parquet(str(tmp_path / "groups")).where(F.col("batch") == 0).collect()} == {(0, 1, 2), (3, 4)}


def test_batches_touch_only_what_they_must(spark, tmp_path):
    """After each batch the groups are those of a whole analysis, and contacts without a key in common stay untouched."""
    from kinweave.streaming.incremental import resolve_batch

    store, out = str(tmp_path / "store"), str(tmp_path / "groups")
    batches = [
        [*PEOPLE[:4], person(20, "Ann Lund", ["+91 95555 00001"]), person(21, "A. Lund", ["+91 95555 00001"])],
        [*PEOPLE[4:8], person(30, "Nils Oberg", ["+91 96666 00001"])],
        [*PEOPLE[8:], person(31, "Nils Oberg", ["+91 96666 00001"]), person(32, "Nora Oberg", ["+91 96666 00002"]), person(33, "Nell Oberg", ["+91 96666 00003"])],
    ]
    seen = []
    for n, rows in enumerate(batches):
        seen += rows
        again = {r["id"] for r in resolve_batch(spark.createDataFrame(rows, CONTACT_DDL), n, store, out, "IN", cap=2).collect()}
        assert not {20, 21} & again or n == 0
        whole = analyze(spark.createDataFrame(seen, CONTACT_DDL), "IN", cap=2).groups.collect()
        got = spark.read.parquet(f"{out}/batch={n}").collect()
        as_set = lambda found: {(tuple(r["members"]), r["score"], r["tier"]) for r in found}
        assert as_set(got) == as_set(whole) and any(r["members"] == [20, 21] for r in got)
    assert {30, 31} <= again


def test_pair_sets_are_counted_not_made(spark, tmp_path):
    from itertools import combinations

    from kinweave import queries

    r = random.Random(4)
    who = [(i, r.choice(["x", "y", None]), r.choice([1, 2, 3, None])) for i in range(60)]
    rows = who + who[:15] + [(None, "x", 1)]
    of = lambda k: sorted((a[0], b[0]) for a, b in combinations(sorted((w for w in rows if w[0] is not None), key=lambda w: w[0]), 2) if a[0] != b[0] and a[k] is not None and a[k] == b[k])
    found, true = of(1), of(2)
    less = lambda x, y: sum(max(0, x.count(p) - y.count(p)) for p in set(x))
    got = evaluate.pair_sets(spark.createDataFrame(rows, "id long, group string, person int")).first()
    assert tuple(got) == (len(found), len(true), len(set(found) & set(true)), less(found, true), less(true, found))
    nothing = evaluate.pair_sets(spark.createDataFrame([], "id long, group string, person int")).first()
    assert tuple(nothing) == (0, 0, 0, 0, 0)
    # 150,000 contacts of one name: 11 thousand million pairs, more than a disk holds
    n = 150_000
    spark.range(n).select((F.floor(F.col("id") / 3) * 768 + F.col("id") % 3).alias("c_custkey")).write.parquet(f"{tmp_path}/customer.parquet")
    assert tuple(queries.queries()["er_pair_sets"](spark, str(tmp_path)).first()) == (n * (n - 1) // 2, n, n, n * (n - 1) // 2 - n, 0)
