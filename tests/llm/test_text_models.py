import itertools
import random
import re

import numpy as np
import pytest

from kinweave.llm import langid, licenses

from .corpus import documents, frame

LANGS = {"aa": "bala kumi tolo reva suna miko", "bb": "strecht plonk gritz vrom schtalt knirps", "cc": "ñañé çigô èlia ûmbra ñolé ärgo"}


def labelled(n=240, seed=2):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(LANGS)[i % 3]
        rows.append((i, " ".join(r.choice(LANGS[lang].split()) for _ in range(r.choice([5, 30, 200]))).capitalize() + ".", lang, "s", "", "", "", 0))
    return rows


def phrases_by_search(text, samples):
    """Greedy longest matches of the whole text by plain search."""
    n = i = 0
    kinds = [re.sub("[^a-zñçèûäéôì]", " ", t.lower()) for t in samples]
    text = re.sub("[^a-zñçèûäéôì]", " ", text.lower())
    while i < len(text):
        k = 1
        while i + k < len(text) and any(text[i : i + k + 1] in s for s in kinds):
            k += 1
        n += 1
        i += k
    return n


@pytest.mark.parametrize("block,head,lanes", [(256, 48, 8192), (16, 5, 7), (40, 1, 3)])
def test_parse_counts_greedy_longest_matches(monkeypatch, block, head, lanes):
    for name, value in (("BLOCK", block), ("HEAD", head), ("LANES", lanes)):
        monkeypatch.setattr(langid, name, value)
    samples = tuple((lang, (text * 3,)) for lang, text in LANGS.items())
    _, classes, tables = langid.model(samples)
    long = (LANGS["aa"] * 3)[:-7]  # phrases longer than a block
    texts = [t for _, t, *_ in labelled(30)] + [long, long + " " + LANGS["bb"] * 2, "", "Ωμέγα bala", "x" * 600]
    counted, chars, alphas = langid.parse(texts, classes, tables)
    for d, t in enumerate(texts[:-2]):
        for k, (_, own) in enumerate(samples):
            assert counted[k, d] == phrases_by_search(t, own)
    assert chars[-1] == 600 and alphas[-3] == 0


def test_held_out_accuracy_and_cases(spark):
    rows = labelled()
    rows += [(1000, None, "aa", "s", "", "", "", 0), (1001, "", "aa", "s", "", "", "", 0), (1002, "123 !?", "bb", "s", "", "", "", 0), (None, "bala kumi", None, None, "", "", "", 0), rows[0]]
    docs = frame(spark, rows)
    got = langid.identify(docs, docs.where(~langid.held_out("doc_id"))).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and all(by[i]["lang_pred"] == "und" for i in (1000, 1001, 1002)) and by[None]["lang_pred"] == "aa"
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:240]]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_are_no_input(spark):
    rows = labelled(60)
    docs = frame(spark, rows)
    other = frame(spark, [(i, t, None, "other", *rest) for i, t, _, _, *rest in rows])
    train = docs.where(~langid.held_out("doc_id"))
    pick = lambda df: sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.identify(df, train).collect())
    assert pick(docs) == pick(other)


def test_large_alphabets(spark):
    """Two learned languages of 500 letters each, most of them beyond the dense classes, alone and through the pipeline's stage."""
    import corpus_pipeline

    r = random.Random(8)
    words = {lang: ["".join(chr(first + r.randrange(500)) for _ in range(2)) for _ in range(400)] for lang, first in (("zh", 0x4E00), ("ko", 0xAC00))}
    rows = [(i, " ".join(r.choice(words[lang]) for _ in range(150)), lang, "s", 0) for i in range(120) for lang in [("zh", "ko")[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x for x in langid.identify(docs, docs.where(~langid.held_out("doc_id"))).collect()}
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    assert corpus_pipeline.language_id(spark, docs, "").count() == len(rows)
    samples = (("zh", tuple(x[1] for x in rows[:40:2])),)
    _, classes, tables = langid.model(samples)
    text = rows[42][1][:200]
    n = at = 0
    while at < len(text):
        k = 1
        while at + k < len(text) and any(text[at : at + k + 1] in t for t in samples[0][1]):
            k += 1
        n, at = n + 1, at + k
    assert langid.parse([text], classes, tables)[0][0, 0] == n


def test_without_labels(spark):
    docs = frame(spark, [(1, "abc", None, None, "", "", "", 0)])
    assert [r["lang_pred"] for r in langid.identify(docs, docs).collect()] == ["und"]
    assert langid.identify(frame(spark, []), frame(spark, [])).count() == 0


def test_suffix_automaton_accepts_substrings_only():
    r = random.Random(1)
    text = [r.randint(2, 4) for _ in range(60)]
    made = langid.Automaton(text, 4)
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(500):
        s, want = 0, tuple(r.randint(2, 4) for _ in range(r.randint(1, 5)))
        ok = all((s := made.move(s, c)) >= 0 for c in want)
        assert ok == (want in inside)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in licenses.BASE_PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        places += found
        labels |= {label} if found else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base(spark):
    r = random.Random(6)
    rows = documents()
    pieces = ["Under the MIT License", "under the mit", "license", "APACHE license, version 2", "cc-by/nc", "CC BY\nNC 4.0", "été", "the", "İ under the mit license"]
    rows += [(5000 + i, " ".join(r.choice(pieces) for _ in range(r.randint(0, 30))), "en", "s", "", "", "", 0) for i in range(80)]
    got = licenses.scan_licenses(frame(spark, rows)).collect()
    want = {x[0]: brute_license(x[1]) for x in rows}
    assert len(got) == len(rows)
    for x in got:
        assert (x["n_words"], x["n_base"], x["first_word"], x["last_word"], x["base_labels"]) == want[x["doc_id"]]
        assert set(filter(None, x["base_labels"].split(","))) <= set(filter(None, x["labels"].split(","))) and 0 <= x["score"] <= 1
        assert all(0 <= s["start"] < s["end"] <= x["n_words"] for s in x["spans"])


@pytest.mark.parametrize("label", sorted(licenses.TEMPLATES))
def test_templates_are_found_whole_and_with_small_changes(spark, label):
    text = max(licenses.TEMPLATES[label], key=len)
    words = text.split()
    changed = words[: len(words) // 2] + ["foo"] + words[len(words) // 2 :]
    docs = frame(spark, [(1, f"before {text} after", "", "", "", "", "", 0), (2, " ".join(changed), "", "", "", "", "", 0), (3, " ".join(words[: max(2, len(words) // 4)]), "", "", "", "", "", 0)])
    got = {x["doc_id"]: x for x in licenses.scan_licenses(docs).collect()}
    assert label in got[1]["labels"].split(",") and got[1]["score"] == 1.0 and label in got[2]["labels"].split(",")
    assert got[1]["spans"][0]["start"] == 1


def test_chains_take_the_best_occurrences():
    """A stray match that stands elsewhere in the template doesn't end a chain."""
    m = licenses.model((("t", "a b c d e f a b c x y z u v w"),), ())
    ids = lambda t: [m.vocabulary.get(w.encode(), -1) for w in t.split()]
    matches = licenses.maximal_matches(m.automaton, ids("d e f a b c"), 0, 3) + licenses.maximal_matches(m.automaton, ids("a b c x y z u v w"), 7, 3)
    (best, *_) = sorted(licenses.chains(m, matches, 4), key=lambda c: -c[1])
    assert best[1:] == (12 / 15, 0, 16) or best[1] == 12 / 15
    r = random.Random(4)
    for _ in range(300):  # against all chains of few matches
        template = [r.choice("abcd") for _ in range(12)]
        m = licenses.model((("t", " ".join(template)),), ())
        text = [r.choice("abcd") for _ in range(8)]
        found = licenses.maximal_matches(m.automaton, [m.vocabulary.get(w.encode(), -1) for w in text], 0, 2) if all(w.encode() in m.vocabulary for w in text) else []
        places = [(s, e, a) for s, e, state in found for a in m.automaton.where[state][0]]

        def total(chain):
            out = chain[0][1] - chain[0][0]
            for (s, e, a), (s2, e2, a2) in zip(chain, chain[1:], strict=False):
                n, n2 = e - s, e2 - s2
                if not (s < s2 and e < e2 and s2 <= e + 2 and a - n < a2 - n2 and a < a2 and a2 - n2 <= a + 2):
                    return 0
                out += n2 - max(0, e - s2, a - (a2 - n2))
            return out

        want = max((total(c) for k in range(1, min(4, len(places)) + 1) for c in itertools.permutations(sorted(places), k)), default=0) if len(places) <= 6 else None
        if want is not None:
            assert round(max((c[1] for c in licenses.chains(m, found, 2)), default=0) * 12) >= want


def test_matching_statistics():
    m = licenses.model(tuple(("t", t) for t in ("a b c d", "b c x a b")), ())
    ids = lambda t: [m.vocabulary[w.encode()] for w in t.split()]
    assert [x[:2] for x in licenses.maximal_matches(m.automaton, ids("x a b c d b c x"), 0, 2)] == [(0, 3), (1, 5), (5, 8)]


def test_empty(spark):
    assert licenses.scan_licenses(frame(spark, [])).count() == 0
