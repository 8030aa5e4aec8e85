import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import omh

from .corpus import documents, frame


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def grams(text):
    w = (text or "").encode().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def brute(rows):
    """Classes by all pairs."""
    texts = [(i, grams(t)) for i, t in dict.fromkeys((r[0], r[1]) for r in rows)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(texts)):
        for y in range(x):
            a, b = texts[x][1], texts[y][1]
            if a and b and min(len(a), len(b)) >= 0.79 * max(len(a), len(b)):
                m = lcs(a, b)
                if m >= 0.8 * (len(a) + len(b) - m) - 1e-9:
                    root[find(x)] = find(y)
    out: dict = {}
    for k, (i, _) in enumerate(texts):
        out.setdefault(find(k), set()).add(i)
    return sorted(sorted(c, key=str) for c in out.values())


def near(seed=1, n=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = documents(n=30)
    sources = [[r.choice(words) for _ in range(r.choice([30, 80, 300]))] for _ in range(6)]
    for k in range(n):
        w = list(r.choice(sources))
        for _ in range(r.choice([0, 0, 1, 2, 3])):
            p = r.randrange(len(w))
            w[p : p + 1] = r.choice([[], ["new"], ["two", "words"]])
        rows.append((2000 + k, " ".join(w), "en", "s", "", "", "", 0))
    return rows


def test_common_in_order():
    r = random.Random(2)
    for _ in range(300):
        a, b = ([r.randint(0, 6) for _ in range(r.randint(0, 40))] for _ in range(2))
        assert omh.common_in_order(a, b, 99) == lcs(a, b)


def test_sketches_keep_text_order():
    def made(values):
        v = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return omh.sketches(v, np.array([len(v)]), 4, 2)[:, 0].tolist()

    assert made([1, 2]) != made([2, 1]) and made([1, 2, 3]) == made([1, 2, 3])


def test_repeats_get_their_own_label():
    assert len(set(omh.labelled(np.array([5, 5, 5, 5], np.uint64), np.array([3, 1])).tolist())) == 3


@pytest.mark.parametrize("small", [16, 2])
def test_classes(spark, small):
    rows = near()
    got: dict = {}
    found = omh.near_duplicates(frame(spark, rows), small=small).collect()
    assert len(found) == len(rows)
    for x in found:
        got.setdefault(("null" if x["class_id"] is None else x["class_id"]) if x["doc_id"] not in (1001, 1002, 1003) else -x["doc_id"], set()).add(x["doc_id"])
    assert sorted(sorted(c, key=str) for c in got.values()) == brute(rows)
    for x in found:
        mine = [y for y in found if y["class_id"] == x["class_id"]]
        assert x["class_size"] == len(mine)


def test_large_group_of_copies(spark):
    r = random.Random(4)
    base = [f"w{r.randint(0, 900)}" for _ in range(100)]
    rows = []
    for i in range(150):  # each with one or two words of its own, so most pairs of copies are less alike than each is to the source
        w = list(base)
        for _ in range(i % 3):
            w[r.randrange(100)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", "", "", "", 0))
    rows += [(1000 + i, f"{i} " + " ".join(f"y{r.randint(0, 99999)}" for _ in range(20)), "en", "s", "", "", "", 0) for i in range(50)]
    got = {x["doc_id"]: x["class_id"] for x in omh.near_duplicates(frame(spark, rows, 5)).collect()}
    assert got == {i: 0 if i < 1000 else i for i, *_ in rows}


def test_pairs_that_meet_only_in_large_buckets(spark):
    """Templated pages in one bucket: 40 pairs alike, all other pairs just below the threshold."""
    r = random.Random(9)
    template = [f"t{i}" for i in range(156)]
    rows = []
    for k in range(40):
        page = template + [f"p{k}w{r.randint(0, 9999)}" for _ in range(44)]
        changed = list(page)
        for at in (160, 190):
            changed[at] = f"c{k}"
        rows += [(2 * k, " ".join(page), "en", "s", "", "", "", 0), (2 * k + 1, " ".join(changed), "en", "s", "", "", "", 0)]
    docs = frame(spark, rows)
    words = omh.squeezed(docs, "text")
    linked = omh.links(words.selectExpr("1L AS key", "text"), words, 5, 0.8, omh.SMALL, omh.ROUNDS).collect()
    assert len({(bytes(x["a"]), bytes(x["b"])) for x in linked}) == 40
    assert brute(rows) == [[2 * k, 2 * k + 1] for k in range(40)]


def test_empty(spark):
    assert omh.near_duplicates(frame(spark, [])).count() == 0


def test_prefixes_meet_a_class_by_one_text(spark):
    rows = [(1, b"x", b"x", True, 10, 0)] + [(1, b"y%d" % k, b"L", False, 10, k % 2) for k in range(50)]
    every = spark.createDataFrame(rows, "shingle long, text binary, label binary, minor boolean, n long, rank long")
    assert [tuple(map(bytes, r)) for r in omh.prefix_pairs(every, omh.one_of_each(every), 0.8, False).collect()] == [(b"x", b"y0")]
    assert omh.prefix_pairs(every, every, 0.8, True).count() == 50  # what is left is held against all


@pytest.mark.parametrize("few", [0, omh.FEW])
def test_few_links_and_many(spark, monkeypatch, few):
    """The classes are the same whether one task joins the links and the open buckets, or all of them do."""
    monkeypatch.setattr(omh, "FEW", few)
    rows = near(seed=5, n=60)
    got: dict = {}
    for x in omh.near_duplicates(frame(spark, rows), small=2).where("doc_id >= 2000").collect():
        got.setdefault(x["class_id"], set()).add(x["doc_id"])
    want = [{i for i in c if isinstance(i, int) and i >= 2000} for c in brute(rows)]
    assert sorted(map(sorted, got.values())) == sorted(sorted(c) for c in want if c)
    edges = spark.createDataFrame([(b"b", b"c"), (b"a", b"b"), (b"x", b"y"), (b"z", b"y")], "a binary, b binary")
    assert {bytes(x["text"]): bytes(x["label"]) for x in omh.joined(edges).collect()} == {b"a": b"a", b"b": b"a", b"c": b"a", b"x": b"x", b"y": b"x", b"z": b"x"}


def test_few_rows_take_no_exchange(spark):
    """Tables of few rows are joined and grouped in one task, however many partitions shuffles have."""
    made = spark.range(50).selectExpr("id % 7 AS key", "cast(cast(id AS string) AS binary) AS text")
    held, one = omh.gathered(omh.checkpoint(made.repartition(5)))
    most = held.groupBy("key").agg(F.max("text").alias("m"))
    assert one and held.join(most, "key").distinct().rdd.getNumPartitions() == 1
    assert "Exchange hash" not in held.join(most, "key")._jdf.queryExecution().executedPlan().toString()


def test_tasks_of_many_partitions(spark):
    """The rounds of few rows open no stages of all partitions."""

    def tasks(run):
        sc = spark.sparkContext
        sc.setJobGroup("counted", "")
        run()
        tracker = sc.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(j).stageIds}
        sc.setLocalProperty("spark.jobGroup.id", None)
        return sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)

    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        n = tasks(lambda: omh.near_duplicates(frame(spark, near()), small=2).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert n < 1500
