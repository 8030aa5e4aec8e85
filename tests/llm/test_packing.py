import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from kinweave.llm import packing, tokens
from kinweave.llm.tokens import Encoder

from .corpus import documents, frame

TOKENIZER = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_schedule_places_each_token_once():
    r = random.Random(1)
    for _ in range(200):
        totals = {f"s{i}": r.randint(0, 9000) for i in range(r.randint(1, 6))}
        weights = r.choice([None, {q: r.random() * 3 for q in totals if r.random() < 0.8}])
        plan = packing.Schedule(totals, weights, 64)
        seen = np.zeros(sum(totals.values()), int)
        for q, n in totals.items():
            cuts = sorted({0, *(r.randint(0, n) for _ in range(9)), n})
            begin, size = np.array(cuts[:-1], np.int64), np.diff(cuts)
            if len(size):
                which, first, length, place = plan.place(q, begin, size)
                for w, a, k, p in zip(which, first, length, place, strict=True):
                    assert begin[w] <= a and a + k <= begin[w] + size[w]
                    seen[p : p + k] += 1
        assert (seen == 1).all()


def test_windows_hold_the_targets():
    plan = packing.Schedule({"a": 100_000, "b": 100_000, "c": 300_000}, {"a": 1, "b": 2, "c": 1}, 1000)
    share = np.zeros((500, 3))
    for k, q in enumerate("abc"):
        _, _, length, place = plan.place(q, np.array([0]), np.array([[100_000, 100_000, 300_000][k]]))
        np.add.at(share[:, k], place // 1000, length)
    assert np.abs(share[:150] - [250, 500, 250]).max() <= 3
    assert share.sum(axis=1).max() <= 1003


def test_encoder_gives_the_tokenizer_s_ids():
    e = Encoder(TOKENIZER)
    texts = [x[1] or "" for x in documents()] + ["it's they're '' 's 'sx x's's", "ÀÉ İstanbul ǅ ß ŉ", "a<|endoftext|>b <|startoftext|>", "x\x1cy z\x85w\xa0q", "日本語 １２", "ΑΣ ΟΔΟΣ", "x́ é", "½ ² ١٢ a1b2 __ a_b", "\U0001f600 ok", "A​B"]
    assert e.by_chunk
    found = e.encode(pa.array([*texts, None]))
    assert [x.tobytes() for x in found] == [e.whole(t) for t in [*texts, ""]]


def test_encoder_forgets_chunks(monkeypatch):
    monkeypatch.setattr(tokens, "CHUNKS", 50)
    monkeypatch.setattr(tokens, "WORDS", 20)
    monkeypatch.setattr(tokens, "SPLIT_AT_ONCE", 300)
    e = Encoder(TOKENIZER)
    texts = [x[1] or "" for x in documents()] * 2
    assert [x.tobytes() for x in e.encode(pa.array(texts))] == [e.whole(t) for t in texts]
    assert len(e.names) < 5000


@pytest.mark.parametrize("weights", [None, {"src0": 3, "src1": 1}])
def test_round_trip(spark, weights):
    rows = documents()
    got = packing.pack(frame(spark, rows), tokenizer=TOKENIZER, width=128, weights=weights, with_ids=True).collect()
    e = Encoder(TOKENIZER)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    sizes = []
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        sizes.append(at)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    assert sum(s != 128 for s in sizes) <= 1 and max(sizes) <= 128
    want = sorted((-1 if i is None else i, np.append(np.frombuffer(e.whole(t or ""), "<u2"), 1).astype("<u4").tobytes()) for i, t, *_ in rows)
    made: dict = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        made.setdefault((-1 if r["doc_id"] is None else r["doc_id"], r["start"]), []).append((bytes(r["ids"]), r["doc_tokens"]))
    texts: dict = {}
    for (i, start), found in sorted(made.items(), key=lambda x: x[0]):
        for k, (ids, _) in enumerate(found):
            texts.setdefault((i, k), b"")
            texts[i, k] += ids
    # the twice-given row's pieces may be cut at different places, so compare sizes there and ids elsewhere
    once = [i for i, _ in want if sum(j == i for j, _ in want) == 1]
    assert {i: t for (i, _), t in texts.items() if i in once} == {i: t for i, t in want if i in once}
    assert sum(r["length"] for r in got) == sum(len(t) // 4 for _, t in want)


def test_many_sources_share_queues(spark):
    rows = [(i, f"word {i}", "en", f"s{i}", "", "", "", 0) for i in range(50)]
    got = packing.pack(frame(spark, rows), tokenizer=TOKENIZER, width=64, queues=8).collect()
    assert {r["doc_id"] for r in got} == set(range(50)) and all(r["queue"].startswith("#") for r in got)


def test_empty(spark):
    assert packing.pack(frame(spark, []), tokenizer=TOKENIZER).count() == 0


def test_weights_with_more_sources_than_queues(spark):
    from kinweave.llm.queries import tokenizer_path

    names = ["#1", "heavy", *(f"s{i}" for i in range(28))]
    rows = [(i, "some words of a text " * (900 if i < 2 else 200), "en", s, "", "", "", 0) for i, s in enumerate(names)]
    got = packing.pack(frame(spark, rows), tokenizer=tokenizer_path(), weights={"heavy": 20.0, "#1": 12.0}, queues=4).where("sequence_id = 0").collect()
    share = {}
    for x in got:
        share[x["queue"]] = share.get(x["queue"], 0) + x["length"]
    assert abs(share["heavy"] - 2048 * 20 / 60) <= 1 and abs(share["#1"] - 2048 * 12 / 60) <= 1
    assert sum(share.values()) == 2048 and all(x["queue"].startswith("##") for x in got if x["doc_id"] > 1)


def test_each_different_chunk_is_looked_up_once(monkeypatch):
    import pyarrow as pa

    from kinweave.llm import tokens
    from kinweave.llm.queries import tokenizer_path

    asked, real = [], tokens.pc.index_in
    monkeypatch.setattr(tokens.pc, "index_in", lambda values, **k: asked.append(len(values)) or real(values, **k))
    enc = tokens.Encoder(tokenizer_path())
    texts = ["one Two " * 1000, None, "two, one", ""]
    for _ in range(2):
        got = enc.encode(pa.array(texts))
        assert [x.tolist() for x in got] == [enc.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert sum(asked) <= 2 * 4
