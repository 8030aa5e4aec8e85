"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line is its words. Two lines are alike if they are equal, or if one word inserted, deleted or replaced makes
them equal and the longer has at least `min_words` words (so a similarity of 0.8 at 5). A line goes if a like
one stands earlier: under a smaller id, or earlier in the document; the earliest stays. Lines are judged on the
input, not on what is left.

1. Equal lines meet by hash; the earliest of each goes on.
2. Lines within one word of each other share their first or their last half. Half keys that only one line has
   rule a line out of what follows (this drops no pair).
3. The others emit the hash of the line and of each variant with one word deleted, with the place of the word.
   Of equal hashes: same place is a replaced word, a whole line an inserted one. The earliest of each is taken by
   a pre-aggregated minimum, so no pairs within a group are made, whatever its size. All hashes of a line take
   steps in proportion to its words.
4. The edit distance to the earliest line found is verified on the words.

Cases: null and empty texts have no lines; lines without words are kept and not counted; a null id counts as the
smallest; rows repeated under one id are one document; ties go to the earlier line; very long lines emit as many
variants as words, and only if they share a half; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, fresh

NO_ID = -(2**63)
MIN_WORDS = 5


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def let(value: Column, use) -> Column:
    """use(value), with the value made once: else it may be put into each step of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def text_of(column: str) -> Column:
    """The text with all white space but line breaks as blanks."""
    t = F.coalesce(F.col(column).cast("string"), F.lit(""))
    odd = F.contains(t, F.lit("\t")) | F.contains(t, F.lit("\x0b")) | F.contains(t, F.lit("\x0c")) | F.contains(t, F.lit("\r"))
    return F.when(odd, F.translate(t, "\t\x0b\x0c\r", "    ")).otherwise(t)


def words_of(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line (from 0), words: the lines that have words."""
    split = docs.select(id_of(id_col).alias("id"), F.posexplode(F.split(text_of(text_col), "\n")).alias("line", "s"))
    # the filter stands before the words: it would else be pushed below them and make them twice
    return split.where(F.col("s").rlike("[^ ]")).select("id", "line", words_of(F.col("s")).alias("words"))


def half_keys(words: Column, n: Column, least: int) -> Column:
    """Hashes of the first and last halves, for partners of n words and more, and of n - 1."""

    def of(size: Column, tag: Column) -> list[Column]:
        half = (size / 2).cast("int")
        return [F.xxhash64(F.lit(0), tag, F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(1), tag, F.slice(words, n - half + 1, half))]

    same, less = of(n, n), of(n - 1, n - 1)
    return F.when(n >= least, F.array(*same, *less)).when(n == least - 1, F.array(*same))


def running(values: Column) -> Column:
    """The exclusive-or of all values before each, and of all as one more. In blocks, so that a very long array takes steps in proportion."""
    block = 256
    zero = F.array(F.lit(0).cast("long"))
    scan = lambda x: F.aggregate(x, zero, lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1).bitwiseXOR(v))))

    def of(x: Column) -> Column:
        pieces = F.transform(F.sequence(F.lit(0), ((F.size(x) - 1) / block).cast("int")), lambda k: scan(F.slice(x, k * block + 1, F.lit(block))))

        def joined(p: Column) -> Column:
            before = scan(F.transform(p, lambda y: F.element_at(y, -1)))
            shifted = F.zip_with(p, F.slice(before, F.lit(1), F.size(p)), lambda y, z: F.transform(F.slice(y, F.lit(1), F.size(y) - 1), lambda v: v.bitwiseXOR(z)))
            return F.concat(F.flatten(shifted), F.slice(before, -1, 1))

        return let(pieces, joined)

    return let(values, of)


def variants(words: Column, least: int) -> Column:
    """Hash of the line, then of the line without its first word, without its second and so on, if it has `least` words.

    A hash is the exclusive-or of the hashes of (word, place); without word i it is that of the words before i at their
    places and of those after it one place lower, so all variants take steps in proportion to the words.
    """
    here = lambda w, i: F.xxhash64(w, i)
    lower = F.transform(words, lambda w, i: here(w, i - 1))
    moved = F.transform(words, lambda w, i: here(w, i).bitwiseXOR(here(w, i - 1)))
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda acc, v: acc.bitwiseXOR(v))

    def made(before: Column) -> Column:
        def cuts(low: Column) -> Column:
            return let(total(low), lambda t: F.concat(
                F.array(t.bitwiseXOR(F.element_at(before, -1))),
                F.zip_with(F.slice(before, F.lit(1), F.size(low)), low, lambda z, v: t.bitwiseXOR(z).bitwiseXOR(v)),
            ))

        return let(lower, cuts)

    all_ = let(running(moved), made)
    return F.when(F.size(words) >= least, all_).otherwise(F.slice(all_, 1, 1))


def repeated_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(id, line) of all lines with words, and of those that stay."""
    n = F.size("words")
    narrow = lines_of(docs, id_col, text_col).select("id", "line", F.xxhash64("words").alias("h"), half_keys(F.col("words"), n, min_words).alias("keys"))
    lines = checkpoint(narrow)  # ids and hashes
    own = F.struct("id", "line")
    firsts = lines.groupBy("h").agg(F.min(F.struct("id", "line", "keys")).alias("x")).select("h", "x.id", "x.line", "x.keys")
    firsts = checkpoint(firsts)
    keyed = firsts.select("h", "id", "line", F.explode("keys").alias("k"))
    shared = keyed.groupBy("k").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("k")
    near = keyed.join(shared, "k", "left_semi").select("id", "line").distinct()
    by_doc = near.groupBy("id").agg(F.collect_list("line").alias("wanted"))
    # the words of the lines that may have a like one
    texts = docs.select(id_of(id_col).alias("id"), text_of(text_col).alias("t")).join(by_doc, "id")
    found = let(F.split("t", "\n"), lambda all_: F.transform("wanted", lambda i: F.struct(i.alias("line"), F.get(all_, i).alias("s"))))
    wanted = texts.select("id", F.explode(found).alias("x")).select("id", "x.line", words_of(F.col("x.s")).alias("words"))
    wanted = checkpoint(wanted.where(F.size("words") >= min_words - 1).distinct())
    # place: -1 for the whole line, else that of the word left out
    emitted = wanted.select("id", "line", F.posexplode(variants(F.col("words"), min_words)).alias("place", "v"))
    emitted = checkpoint(emitted.select("id", "line", (F.col("place") - 1).alias("place"), "v"))
    least = emitted.groupBy("v", "place").agg(F.min(own).alias("least"), F.max(own).alias("most"))
    summed = least.groupBy("v").agg(
        F.min(F.when(F.col("place") < 0, F.col("least"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("least"))).alias("cut"),
        F.min("least").alias("least"), F.max("most").alias("most"),
    )
    summed = checkpoint(summed.where("least < most").select("v", "whole", "cut"))  # hashes of more than one line
    met = checkpoint(emitted.join(summed, "v"))
    same = met.groupBy("v", "place").agg(F.min(own).alias("least"))
    best = F.least("least", F.when(F.col("place") < 0, F.col("cut")).otherwise(F.col("whole")))
    earliest = met.join(same, ["v", "place"]).groupBy("id", "line").agg(F.min(best).alias("first")).where(F.col("first") < own)
    a = wanted.select("id", "line", F.col("words").alias("a"))
    b = wanted.select(F.col("id").alias("i"), F.col("line").alias("l"), F.col("words").alias("b"))
    pairs = earliest.join(a, ["id", "line"]).join(b, (F.col("first.id") == F.col("i")) & (F.col("first.line") == F.col("l")))
    like = verified(F.col("a"), F.col("b"))
    gone = pairs.where(like).select("id", "line")
    return lines.select("id", "line"), firsts.select("id", "line").join(gone, ["id", "line"], "left_anti")


def verified(a: Column, b: Column) -> Column:
    """Whether the word edit distance is at most 1: common first and last words leave at most one word between."""

    def common(x: Column, y: Column) -> Column:
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False)).cast("int")
        return F.when(at > 0, at - 1).otherwise(F.size(x))

    longer = F.greatest(F.size(a), F.size(b))
    return common(a, b) + common(F.reverse(a), F.reverse(b)) >= longer - 1


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """A row an id: n_lines (with words), n_removed and the removed lines' numbers, from 0."""
    id_col = options.get("id_col", "doc_id")
    lines, kept = repeated_lines(docs, **options)
    per = lines.groupBy("id").agg(F.collect_set("line").alias("lines"))
    stay = kept.groupBy("id").agg(F.collect_set("line").alias("kept"))
    none = F.array().cast("array<int>")
    out = docs.select(id_of(id_col).alias("id")).distinct().join(per, "id", "left").join(stay, "id", "left")
    all_lines = F.coalesce("lines", none)
    removed = F.array_sort(F.array_except(all_lines, F.coalesce("kept", none)))
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), F.size(all_lines).cast("long").alias("n_lines"), removed.alias("removed")).withColumn("n_removed", F.size("removed").cast("long")).select(id_col, "n_lines", "n_removed", "removed")


def without_lines(docs: DataFrame, decisions: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the removed lines taken out of their texts; texts that lose none stay as they are."""
    key, removed = fresh(docs, "id", "removed")
    gone = decisions.where("n_removed > 0").select(id_of(id_col).alias(key), F.col("removed").alias(removed))
    both = docs.withColumn(key, id_of(id_col)).join(gone, key, "left")

    def rest(all_: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(removed))
        return F.array_join(F.transform(kept, lambda i: F.get(all_, i)), "\n")

    left = let(F.split(F.col(text_col), "\n"), rest)
    return both.withColumn(text_col, F.when(F.col(removed).isNull(), F.col(text_col)).otherwise(left)).select(*docs.columns)
