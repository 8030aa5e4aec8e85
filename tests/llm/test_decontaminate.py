import itertools
import math
import random
import re
import unicodedata

import pytest

from kinweave.llm import decontaminate as d

from .corpus import documents, frame


def words(text):
    out, w = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] in "LMN":
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def test_masks_hit_every_window_with_two_replaced_words():
    for bad in itertools.combinations(range(d.WINDOW), 2):
        assert any(all(c == "0" or o + j not in bad for j, c in enumerate(m)) for m in d.MASKS for o in range(d.WINDOW - len(m) + 1))


def brute(rows, items):
    """All places of all items in all documents, seeded by a mask or, for short items, whole."""
    out = {}
    for i, t, *_ in rows:
        w = words(t)
        for k, text in items:
            iw = words(text)
            n, span = len(iw), min(len(iw), d.WINDOW)
            for o in range(-n, len(w)) if n else ():
                same = [0 <= o + j < len(w) and w[o + j] == x for j, x in enumerate(iw)]
                masks = d.MASKS if n >= 8 else ["1" * n]
                if not any(all(c == "0" or same[p + j] for j, c in enumerate(m)) and o + p >= 0 and o + p + len(m) <= len(w) for m in masks for p in range(n - len(m) + 1)):
                    continue
                best = max((sum(same[s : s + span]), -(o + s)) for s in range(n - span + 1))
                if best[0] >= math.ceil(0.8 * span - 1e-9):
                    out[i, k] = max(out.get((i, k), (-1, 0)), best)
    return {k: (v[0], -v[1]) for k, v in out.items()}


def test_contaminated(spark):
    r = random.Random(5)
    rows = documents()
    source = [words(x[1]) for x in rows if x[1] and len(words(x[1])) > 60]
    items = [(100 + k, " ".join(w[k : k + 30]).upper()) for k, w in enumerate(source[:10])]
    items += [(200, "unheard of words " * 8), (201, None), (202, ""), (203, " ".join(source[0][3:8])), (204, " ".join(source[1][:2])), (205, "...")]
    for k, w in enumerate(source[:6]):
        w = w[5:25]
        for _ in range(3):
            w[r.randrange(20)] = "swapped"
        items.append((300 + k, " ".join(w)))
    items.append(items[0])
    got = d.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len({(x["doc_id"], x["item_id"]) for x in got})
    assert {(x["doc_id"], x["item_id"]): (x["matched"], x["start"]) for x in got} == brute(rows, items)


def brute_whole(rows, items):
    """All places of all items of up to a window's words in all documents, without seeds."""
    out = {}
    for i, t in rows:
        w = words(t)
        for k, text in items:
            iw = words(text)
            for o in range(-len(iw), len(w)):
                same = sum(0 <= o + j < len(w) and w[o + j] == x for j, x in enumerate(iw))
                if same >= math.ceil(0.8 * len(iw) - 1e-9):
                    out[i, k] = max(out.get((i, k), (-1, 0)), (same, -o))
    return {k: (v[0], -v[1]) for k, v in out.items()}


@pytest.mark.parametrize("n", [3, 5, 8, 9, 10, 11, 12])
def test_short_items_with_every_tolerated_replacement(spark, n):
    """A length at a time: the masks of shorter items would help the longer ones."""
    r = random.Random(n)
    w = [f"w{j}" for j in range(n)]
    wrong = n - math.ceil(0.8 * n - 1e-9)
    rows = []
    for k in range(wrong + 2):
        for bad in itertools.combinations(range(n), k):
            rows.append((len(rows), " ".join(["x"] * r.randint(0, 3) + ["y" if j in bad else x for j, x in enumerate(w)] + ["z"] * r.randint(0, 3))))
    for cut in range(1, wrong + 2):  # an item that hangs over the document's ends
        rows += [(len(rows), " ".join(w[cut:] + ["z"])), (len(rows) + 1, " ".join(["x"] + w[:-cut]))]
    items = [(1, " ".join(w))]
    got = d.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = brute_whole(rows, items)
    assert {(x["doc_id"], x["item_id"]): (x["matched"], x["start"]) for x in got} == want


def test_very_long_texts(spark):
    """200,000 words with an item at the start, in the middle and at the end, and an item longer than a document."""
    w = [f"w{i}" for i in range(200_000)]
    item = [f"bench{i}" for i in range(20)]
    for at in (0, 100_000, 199_980):
        w[at : at + 20] = item
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(item[3:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(item + w[20:30_000]))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["matched"], r["start"]) for r in d.contaminated(docs, items).collect()}
    assert got == {(1, 1): (13, 0), (2, 1): (13, 0), (1, 2): (13, 0), (2, 2): (13, 0)}


@pytest.mark.parametrize("share", [10, 0])
def test_hits_beyond_the_broadcast(spark, monkeypatch, share):
    monkeypatch.setattr(d, "BROADCAST_HITS", share)
    monkeypatch.setattr(d, "BROADCAST_ROWS", share)
    rows = documents()
    source = [words(x[1]) for x in rows if x[1] and len(words(x[1])) > 60]
    items = [(k, " ".join(w[k : k + 30])) for k, w in enumerate(source[:6])]
    got = d.contaminated(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): (x["matched"], x["start"]) for x in got} == brute(rows, items)


def test_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(frame(spark), none).count() == 0
    assert d.contaminated(frame(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_native(spark):
    plan = d.contaminated(frame(spark), spark.createDataFrame([(1, "a b c d e f g h i")], "item_id long, text string"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)
