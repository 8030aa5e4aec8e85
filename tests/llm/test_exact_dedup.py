import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinweave.llm import exchange, lines, substrings, suffixes

from .corpus import documents, frame

LOW = -(2**63)


def unique(rows):
    return list(dict.fromkeys((r[0], r[1]) for r in rows))


def brute_suffixes(rows, depth):
    docs = sorted((LOW if i is None else i, (t or "").encode()) for i, t in unique(rows))
    seen, out = set(), {}
    for i, b in docs:
        gone = [False] * len(b)
        for s in range(len(b) - depth + 1):
            w = b[s : s + depth]
            if w in seen:
                gone[s : s + depth] = [True] * depth
            seen.add(w)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out[None if i == LOW else i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest())
    return out


def brute_windows(rows, width):
    docs = [(LOW if i is None else i, (t or "").encode().split()) for i, t in unique(rows)]
    first = {}
    for i, w in docs:
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, i), i)
    out = {}
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] < i:
                gone[s : s + width] = [True] * width
        out[None if i == LOW else i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    return out


@pytest.mark.parametrize("flush,chunk,hot,held", [(3_000_000, 1 << 18, 50_000, 1 << 24), (500, 700, 50_000, 9000), (900, 5000, 2, 20_000)])
def test_suffixes(spark, monkeypatch, flush, chunk, hot, held):
    monkeypatch.setattr(exchange, "FLUSH", flush)
    for name, value in (("CHUNK", chunk), ("HOT", hot), ("HELD", held), ("SORTED", 3 * hot)):
        monkeypatch.setattr(suffixes, name, value)
    rows = documents()
    got = suffixes.dedup_suffixes(frame(spark, rows), depth=40, gram=12, with_text=True).collect()
    want = brute_suffixes(rows, 40)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) == want[r["doc_id"]]
        assert hashlib.sha256(bytes(r["kept"])).hexdigest() == r["kept_sha256"]


def test_radix_groups_equal_strings():
    r = np.random.default_rng(1)
    text = r.integers(0, 2, 4000).astype(np.uint8)
    start, length = r.integers(0, 3900, 800), r.choice([5, 8, 9, 16], 800)
    group = suffixes.radix(np.concatenate((text, np.zeros(8, np.uint8))), start, length, suffixes.numbered(length))
    by = {}
    for s, n, g in zip(start.tolist(), length.tolist(), group.tolist(), strict=True):
        assert by.setdefault(text[s : s + n].tobytes(), g) == g
    assert len(set(by.values())) == len(by)


def test_suffixes_of_a_hot_passage_with_other_neighbours(spark, monkeypatch):
    """The runs at a passage's ends differ in each of very many documents."""
    monkeypatch.setattr(suffixes, "HOT", 20)
    r = random.Random(2)
    own = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    passage = own(180)
    rows = [(i, own(r.randint(0, 120)) + (passage if i % 2 else passage[r.randint(0, 40) :]) + own(r.randint(0, 120)), "en", "s", "", "", "", 0) for i in range(150)]
    got = suffixes.dedup_suffixes(frame(spark, rows, 5)).collect()
    want = brute_suffixes(rows, 100)
    for x in got:
        assert (x["n_bytes"], x["n_removed"], len(x["spans"]), x["kept_sha256"]) == want[x["doc_id"]]


def test_substrings(spark):
    rows = documents()
    got = substrings.dedup_substrings(frame(spark, rows), width=6, with_text=True).collect()
    want = brute_windows(rows, 6)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]]
        assert sum(x["end"] - x["begin"] for x in r["intervals"]) == r["n_removed"]


def test_long_texts_are_hashed_in_pieces():
    text = b" ".join(b"w%d" % (i * i % 97) for i in range(2000))
    whole = {k: h.tolist() for _, k, h in substrings.window_hashes([text], 13)}
    before = exchange.CHUNK, substrings.PIECE
    try:
        exchange.CHUNK, substrings.PIECE = 100, 300
        pieces = [h for _, _, part in substrings.window_hashes([text], 13) for h in part.tolist()]
    finally:
        exchange.CHUNK, substrings.PIECE = before
    assert pieces == whole[0]


def test_hot_copies(spark):
    """A third of all rows hold one passage."""
    passage = " ".join(f"p{i}" for i in range(50))
    rows = [(i, (passage if i % 3 == 0 else "") + f" own {i} " * 9, "en", "s", "", "", "", 0) for i in range(300)]
    got = {r["doc_id"]: r["n_removed"] for r in substrings.dedup_substrings(frame(spark, rows, 7)).collect()}
    want = brute_windows(rows, 13)
    assert got == {i: w[1] for i, w in want.items()}
    got = {r["doc_id"]: r["n_removed"] for r in suffixes.dedup_suffixes(frame(spark, rows, 7)).collect()}
    assert got == {i: w[1] for i, w in brute_suffixes(rows, 100).items()}


def alike(a, b, least):
    if a == b:
        return True
    if max(len(a), len(b)) < least or abs(len(a) - len(b)) > 1:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def brute_lines(rows, least):
    found = sorted((LOW if i is None else i, n, tuple(words)) for i, t in unique(rows) for n, s in enumerate((t or "").split("\n")) if (words := s.replace("\r", " ").split()))
    out = {None if i is None else i: [] for i, _ in unique(rows)}
    for k, (i, n, w) in enumerate(found):
        if any(alike(v, w, least) for j, m, v in found[:k] if (j, m) != (i, n)):
            out[None if i == LOW else i].append(n)
    return {i: sorted(x) for i, x in out.items()}


def test_lines(spark):
    rows = documents()
    rows += [(2000 + i, t, "en", "s", "", "", "", 0) for i, t in enumerate(["a b c d\nx", "a b c d e", "a b c e\na b", "q a b c d e", "a b", "a a b c d", "a b c d e\r", "a c\n\n \nx"])]
    got = {r["doc_id"]: (r["n_removed"], r["removed"]) for r in lines.dedup_lines(frame(spark, rows)).collect()}
    want = brute_lines(rows, 5)
    assert got == {i: (len(x), x) for i, x in want.items()}


def test_lines_native(spark):
    plan = lines.dedup_lines(frame(spark))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


def test_very_long_lines(spark):
    """A line of 60,000 words, the same with one word replaced, deleted and inserted, and with two replaced; and a text of 30,000 lines."""
    w = [f"w{i % 5003}x{i % 7}" for i in range(60_000)]
    changed = [w[:500] + ["other"] + w[501:], w[:-700] + w[-699:], w[:40_000] + ["more"] + w[40_000:], w[:10] + ["other"] + w[11:50_000] + ["another"] + w[50_001:]]
    rows = [(i, " ".join(x)) for i, x in enumerate([w, *changed])]
    rows.append((10, "\n".join(f"line number {i} of a very long text" for i in range(30_000))))
    rows.append((11, "\n".join(f"line number {i} of a very long text" for i in range(0, 30_000, 2)) + "\nlast one"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    decisions = lines.dedup_lines(docs)
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in decisions.collect()}
    assert [got[i][1] for i in range(5)] == [0, 1, 1, 1, 0] and got[11] == (15_001, 15_000) and got[10][0] == 30_000
    left = {r["doc_id"]: r["text"] for r in lines.without_lines(docs, decisions).collect()}
    assert left[11] == "last one" and left[1] == "" and left[0] == rows[0][1]


def test_hashes_of_variants(spark):
    """A line without its i-th word has the hash of the shorter line, whatever its length."""
    r = random.Random(1)
    cases = [[r.choice("ab") for _ in range(n)] for n in (5, 6, 255, 256, 257, 600)]
    rows = [(k, w) for k, w in enumerate(cases)]
    rows += [(1000 * (k + 1) + i, w[:i] + w[i + 1 :]) for k, w in enumerate(cases) for i in {0, 1, len(w) // 2, len(w) - 1}]
    got = {x["k"]: x["v"] for x in spark.createDataFrame(rows, "k long, w array<string>").select("k", lines.variants(F.col("w"), 1).alias("v")).collect()}
    for k, w in enumerate(cases):
        assert len(got[k]) == len(w) + 1
        for i in {0, 1, len(w) // 2, len(w) - 1}:
            assert got[k][1 + i] == got[1000 * (k + 1) + i][0]


def test_lines_leave_texts(spark):
    rows = documents()
    docs = frame(spark, rows)
    decisions = lines.dedup_lines(docs)
    left = lines.without_lines(docs, decisions)
    assert left.columns == docs.columns and left.count() == len(rows)
    removed = {r["doc_id"]: set(r["removed"]) for r in decisions.collect()}
    want = sorted((str(r[0]), str(None if r[1] is None else "\n".join(s for n, s in enumerate(r[1].split("\n")) if n not in removed[r[0]]))) for r in rows)
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left.collect()) == want


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffixes.dedup_suffixes(empty).count() == 0
    assert substrings.dedup_substrings(empty).count() == 0
    assert lines.dedup_lines(empty).count() == 0
