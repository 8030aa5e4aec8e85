"""A small corpus with the awkward cases: nulls, empty and long texts, copies, shared passages, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, id string, t string, words string, line int"


def documents(seed=3, n=60, longest=3000):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(300)] + ["été", "Straße", "it's"]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    line = " ".join(r.choice(vocabulary) for _ in range(12))
    rows = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([1, 3, 8, 40, 200]))]
        text = "".join(w + r.choice([" ", " ", " ", "\n", "\t "]) for w in words)
        if i % 3 == 0:
            text += passage + "\n" + text[:50]
        if i % 4 == 0:
            text += "\n" + line.replace(r.choice(line.split()), "changed", 1) + "\n" + line + "\n"
        if i % 7 == 0 and rows:
            text = r.choice(rows)[1]
        if i % 11 == 0 and rows and rows[-1][1]:
            changed = rows[-1][1].split(" ")
            changed[len(changed) // 2] = "other"
            text = " ".join(changed)
        rows.append((i * 7 % n, text, r.choice(["en", "fr"]), "src0" if i % 2 else f"src{i % 5}", "x", "y", "z", 1))
    rows += [(None, passage, None, None, None, None, None, None), (1001, None, "en", "src1", "a", "b", "c", 2), (1002, "", None, "", "a", "b", "c", 2), (1003, " \n\t\n ", "fr", None, "a", "b", "c", 2)]
    rows.append((1004, " ".join(r.choice(vocabulary) for _ in range(longest)), "en", "src0", "a", "b", "c", 2))
    rows.append(rows[5])  # a row given twice
    r.shuffle(rows)
    return rows


def frame(spark, rows=None, partitions=3):
    return spark.createDataFrame(documents() if rows is None else rows, SCHEMA).repartition(partitions)
