"""Language identification by cross-parsing entropy.

For each language a suffix automaton of sampled labelled text is turned into a dense table. A text is parsed
against it: each phrase is the longest piece from here on that occurs in the language's text, so a phrase
ends where the automaton has no further move. The language that needs the fewest phrases a character wins.
Texts are parsed in blocks of BLOCK characters, many blocks at once, as lanes of one numpy table look-up. A block
is first parsed as if a phrase began there and then, with the state that the block before it ends in, as far as the
two parses differ: phrases run over blocks, and counts are those of the whole text. The table has columns for the most
common letters; moves by any other letter of the samples are looked up in a sorted list.

What is fitted is bounded: at most DOCUMENTS documents a language, EXCERPT characters from the middle of each
(the model's size is the number of languages times that bound). Prediction reads every character of every text.

Cases: null texts and texts without a letter get `und` and score 0; texts of letters that no language
has get the first language by name at score 0; ties go to the first name; with no labelled rows all is `und`;
very long texts are parsed block by block; repeated rows are each answered; an empty table gives an empty
result; a null id is not held out and is not learned from; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import unicodedata
from array import array
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .exchange import give_back

#: Bounds of the labelled sample.
DOCUMENTS, EXCERPT = 64, 640
#: Characters of a block, and blocks parsed at once.
BLOCK, LANES = 256, 8192
#: Characters after which two parses of a block mostly agree.
HEAD = 48
#: Character classes of the dense tables: 0 is a letter that no sample has, 1 whatever isn't a letter. Rarer letters have higher classes.
CLASSES = 64
FLAG = np.int32(1 << 30)


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Automaton:
    """The automaton that accepts the substrings of codes. Moves by codes below `width` stand in one flat array, others by state."""

    def __init__(self, codes: list[int], width: int):
        self.width = width
        none = array("i", [-1]) * width
        self.dense = array("i", none)
        self.rare: dict[int, dict[int, int]] = {}
        link, length, last = [-1], [0], 0
        dense, rare = self.dense, self.rare
        for c in codes:
            new = len(link)
            dense.extend(none)
            link.append(0)
            length.append(length[last] + 1)
            p = last
            if c < width:
                while p >= 0 and dense[p * width + c] < 0:
                    dense[p * width + c] = new
                    p = link[p]
            else:
                while p >= 0 and c not in rare.get(p, ()):
                    rare.setdefault(p, {})[c] = new
                    p = link[p]
            if p >= 0:
                q = self.move(p, c)
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(link)
                    dense.extend(dense[q * width : (q + 1) * width])
                    if q in rare:
                        rare[twin] = dict(rare[q])
                    link.append(link[q])
                    length.append(length[p] + 1)
                    link[q] = link[new] = twin
                    while p >= 0 and self.move(p, c) == q:
                        if c < width:
                            dense[p * width + c] = twin
                        else:
                            rare[p][c] = twin
                        p = link[p]
            last = new
        self.states = len(link)

    def move(self, state: int, c: int) -> int:
        """The next state, or -1."""
        return self.dense[state * self.width + c] if c < self.width else self.rare.get(state, {}).get(c, -1)


class Moves(NamedTuple):
    """A language's moves. Entries are the next state times the width, with FLAG where a phrase starts."""

    dense: np.ndarray  #: by state times `width` plus class
    keys: np.ndarray  #: state times `size` plus class, sorted, for classes from `width` on; a sentinel stands last
    moves: np.ndarray  #: by key
    starts: np.ndarray  #: the move of a class from `width` on where no key has one
    width: int
    size: int  #: classes in all


@functools.lru_cache(maxsize=1)
def model(samples: tuple[tuple[str, tuple[str, ...]], ...]) -> tuple[list[str], np.ndarray, list[Moves]]:
    """Languages, the class of each code point, and the moves of each language."""
    is_letter = letters()
    counts = np.zeros(0x110000, np.int64)
    for _, found in samples:
        for t in found:
            np.add.at(counts, code_points(t), 1)
    counts[~is_letter] = 0
    classes = np.where(is_letter, 0, 1).astype(np.int32)
    used = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    classes[used] = np.arange(2, 2 + len(used))
    size = 2 + len(used)
    width = min(CLASSES, size)
    tables = []
    for _, found in samples:
        codes: list[int] = []
        for t in found:
            codes += classes[code_points(t)].tolist() + [0]  # no text has class 0: no match runs from one text into the next
        made = Automaton(codes, width)
        to = np.frombuffer(made.dense, np.int32).reshape(-1, width)
        start = np.full(size, FLAG, np.int32)
        known = np.flatnonzero(to[0, 1:] >= 0) + 1
        start[known] = FLAG | to[0, known] * width
        for c, state in made.rare.get(0, {}).items():
            start[c] = FLAG | state * width
        dense = np.where(to >= 0, to * np.int32(width), start[None, :width])
        dense[:, 0] = FLAG
        dense[0] = start[:width]
        rare = sorted([(s * size + c, state * width) for s, moves in made.rare.items() if s for c, state in moves.items()] + [(1 << 62, 0)])
        tables.append(Moves(dense.ravel(), np.array([k for k, _ in rare], np.int64), np.array([m for _, m in rare], np.int32), start[width:], width, size))
        del made, to, codes
    return [k for k, _ in samples], classes, tables


def stepped(columns: np.ndarray, sizes: np.ndarray, table: Moves, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that start in each block (a column of codes, sizes descending), and the state after it; state: the one before it."""
    state, count = state.copy(), np.zeros(len(sizes), np.int32)
    steps = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(steps), side="left").tolist()
    odd = table.size > table.width
    for j, n in enumerate(alive):
        codes = columns[j, :n]
        if odd:
            rare = np.flatnonzero(codes >= table.width)
            codes = np.minimum(codes, table.width - 1)
        move = table.dense.take(state[:n] + codes)
        if odd and len(rare):
            c = columns[j, rare]
            key = (state[rare] // table.width).astype(np.int64) * table.size + c
            at = np.searchsorted(table.keys, key)
            move[rare] = np.where(table.keys[at] == key, table.moves[at], table.starts[c - table.width])
        count[:n] += move >> 30
        np.bitwise_and(move, FLAG - 1, out=state[:n])
    return count, state


def phrases(
    columns: np.ndarray, sizes: np.ndarray, before: np.ndarray, after: np.ndarray, table: Moves,
    first: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of blocks that follow one another, and the states after them.

    before, after: the block that stands before or after each in its text, or -1; first: states before those that have none.
    """
    small, large = np.minimum(sizes, HEAD), np.maximum(sizes - HEAD, 0)
    head, middle = stepped(columns[:HEAD], small, table, first)
    rest, end = stepped(columns[HEAD:], large, table, middle)
    todo = np.flatnonzero(before >= 0)
    while len(todo):
        count, state = stepped(columns[:HEAD, todo], small[todo], table, end[before[todo]])
        head[todo] = count
        late = np.flatnonzero(state != middle[todo])
        middle[todo] = state
        todo = todo[late]
        if len(todo):
            was = end[todo]
            rest[todo], end[todo] = stepped(columns[HEAD:, todo], large[todo], table, middle[todo])
            todo = np.sort(after[todo[(end[todo] != was) & (after[todo] >= 0)]])
    return head + rest, end


def parse(batch_texts: list[str], classes: np.ndarray, tables: list[Moves]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrases of each text by language, characters and letters of each text."""
    counted = np.zeros((len(tables), len(batch_texts)), np.int64)
    chars, alphas = np.zeros(len(batch_texts), np.int64), np.zeros(len(batch_texts), np.int64)
    is_letter = letters()
    pending: list[tuple[int, int, np.ndarray]] = []  # text, start, codes
    carried = np.zeros(len(tables), np.int32)  # states after the last block

    def flush():
        if not pending:
            return
        n = len(pending)
        sizes = np.array([len(x) for _, _, x in pending], np.int64)
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        follows = np.array([at > 0 for _, at, _ in pending])
        before, after = np.full(n, -1), np.full(n, -1)
        o = np.flatnonzero(follows[1:]) + 1
        before[place[o]], after[place[o - 1]] = place[o - 1], place[o]
        columns = np.zeros((BLOCK, n), np.int32)
        for i, (_, _, x) in enumerate(pending):
            columns[: len(x), place[i]] = x
        at = np.array([d for d, _, _ in pending])[order]
        for k, table in enumerate(tables):
            first = np.zeros(n, np.int32)
            if follows[0]:
                first[place[0]] = carried[k]
            found, end = phrases(columns, sizes[order], before, after, table, first)
            np.add.at(counted[k], at, found)
            carried[k] = end[place[n - 1]]
        pending.clear()

    for d, text in enumerate(batch_texts):
        points = code_points(text)
        chars[d] = len(points)
        alphas[d] = int(is_letter[points].sum())
        if alphas[d] and tables:
            codes = classes[points]
            for at in range(0, len(codes), BLOCK):
                pending.append((d, at, codes[at : at + BLOCK]))
                if len(pending) >= LANES:
                    flush()
    flush()
    return counted, chars, alphas


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def sample(docs: DataFrame, *, id_col: str, text_col: str, label_col: str, documents: int, excerpt: int) -> tuple:
    """(language, excerpts) of at most `documents` labelled documents a language, chosen by the hash of the id."""
    known = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(label_col).alias("l")).where("i is not null and t is not null and l is not null")
    rows = known.groupBy("l").count().collect()  # a row a language
    if not rows:
        return ()
    wide = 10**9
    bound = F.create_map(*[x for r in rows for x in (F.lit(r["l"]), F.lit(min(wide, 3 * documents * wide // r["count"] + 1)))])
    drawn = F.pmod(F.xxhash64("i"), F.lit(wide))
    size = F.length("t")
    piece = F.substring("t", F.greatest(F.lit(1), ((size - excerpt) / 2).cast("int") + 1), F.lit(excerpt))
    # A sample of about three times the bound at most; the smallest hashes are kept.
    picked = known.where(drawn < bound[F.col("l")]).select("l", F.struct(drawn.alias("h"), F.col("i"), piece.alias("t")).alias("x"))
    picked = picked.groupBy("l").agg(F.slice(F.sort_array(F.collect_list("x")), 1, documents).alias("x")).collect()
    return tuple(sorted((r["l"], tuple(x["t"] for x in r["x"] if x["t"])) for r in picked))


def identify(
    docs: DataFrame, training: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "lang", documents: int = DOCUMENTS, excerpt: int = EXCERPT, keep: tuple[str, ...] = (),
) -> DataFrame:
    """Adds lang_pred, score (the winner's lead over the next language, 0 to 1) and rate (its phrases a character, but for the last).

    training: rows with the label; docs' own label column takes no part in a prediction. keep: columns of
    docs that are returned too, besides the id.
    """
    small_batches(docs.sparkSession)
    samples = sample(training, id_col=id_col, text_col=text_col, label_col=label_col, documents=documents, excerpt=excerpt)

    def predict(batches):
        give_back()
        names, classes, tables = model(samples)
        give_back()  # what making the tables took
        for b in batches:
            counted, chars, alphas = parse(texts(b.column(0)), classes, tables)
            lang, score, rate = [], [], []
            for d in range(b.num_rows):
                if not alphas[d] or not names:
                    lang.append("und")
                    score.append(0.0)
                    rate.append(None)
                    continue
                order = np.argsort(counted[:, d], kind="stable")
                best = int(counted[order[0], d])
                second = int(counted[order[1], d]) if len(names) > 1 else 2 * best
                lang.append(names[order[0]])
                score.append(min(1.0, max(0.0, (second - best) / second)) if second else 0.0)
                rate.append((best - 1) / int(chars[d]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())], names=out_names)

    kept = [id_col, *keep]
    inner = [f"c{i}" for i in range(len(kept))]
    out_names = [*inner, "lang_pred", "score", "rate"]
    narrow = docs.select(F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(kept, inner, strict=True)])
    schema = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, inner, strict=True))
    return narrow.mapInArrow(predict, f"{schema}, lang_pred string, score double, rate double").toDF(*kept, "lang_pred", "score", "rate")
