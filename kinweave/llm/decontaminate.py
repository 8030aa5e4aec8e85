"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask marks which words of a window count. Each window of the benchmark and of the corpus is hashed once for
each mask over the words that count, and equal hashes are hits: a replaced word under a gap of the mask doesn't
matter. Around each hit the item is laid along the document word by word; a document is contaminated by an item
if, in some WINDOW words of the item (all, if it has fewer), at least SIMILARITY of the places hold the same word.

The two masks of weight 6 hit every window of 13 words with up to two replaced words (shown by a test). Items
with fewer words than a window have masks of their own by their length: cut into two parts more than words may differ,
and a mask for each choice of so many parts that it leaves out. Whichever places differ, one mask has none of them.

The benchmark's side is broadcast up to BROADCAST_ROWS seeds, counted before; beyond, both sides are shuffled. So
are the documents' hits up to BROADCAST_HITS, for which no text is shuffled then.

Cases: null and empty texts, and items without words, match nothing; a null id is passed on; rows repeated under
one id give one row an item; ties between places go to the better, then the earlier one; very long texts are read
whole; empty tables give an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .lines import let

MASKS = ("11110011", "11010111")
WINDOW, SIMILARITY = 13, 0.8
#: Seeds (hash, item, place) up to which the benchmark is broadcast, and hits up to which they are: some 100 and 10 MB.
BROADCAST_ROWS, BROADCAST_HITS = 2_000_000, 200_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text.cast("string")), r"[^\p{L}\p{M}\p{N}]+"), "")


def short_masks(n: int, similarity: float) -> set[str]:
    """Masks for an item of n words: one at least is hit, whichever places differ, as long as the rule accepts the rest."""
    wrong = n - math.ceil(n * similarity - 1e-9)
    parts = min(n, wrong + 2) if wrong else 1
    edges = [p * n // parts for p in range(parts + 1)]
    out = ("".join("01"[p not in left_out] * (edges[p + 1] - edges[p]) for p in range(parts)).strip("0") for left_out in itertools.combinations(range(parts), wrong))
    return {m for m in out if m}


def seeds(words: Column, masks: list[str], wanted: list[Column] | None = None) -> Column:
    """For each mask (that is wanted) and window the hash and the window's first word: array<struct<place, seed>>."""

    def of(k: int, mask: str) -> Column:
        at = [j for j, c in enumerate(mask) if c == "1"]
        hashed = F.transform(F.sequence(F.lit(0), F.size(words) - len(mask)), lambda i: F.struct(i.alias("place"), F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in at]).alias("seed")))
        fits = F.size(words) >= len(mask)
        return F.when(fits & wanted[k] if wanted else fits, hashed).otherwise(F.array().cast("array<struct<place:int,seed:bigint>>"))

    return F.concat(*[of(k, mask) for k, mask in enumerate(masks)])


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] = MASKS,
    window: int = WINDOW, similarity: float = SIMILARITY,
) -> DataFrame:
    """A row a document and item that it holds: matched (equal words in the best window), similarity, start (its first word in the document)."""
    items = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(item_text_col)).alias("iw")).where(F.size("iw") > 0).distinct()
    size = F.size("iw")
    lengths = [r[0] for r in items.where(size < window).select(size).distinct().collect()]  # fewer rows than a window has places
    own = {n: short_masks(n, similarity) for n in lengths}
    short = sorted(set().union(*own.values()))
    of_item = [*[size >= window] * len(masks), *(size.isin([n for n in lengths if m in own[n]]) for m in short)]
    every = [*masks, *short]
    wanted = items.select("item", F.explode(seeds(F.col("iw"), every, of_item)).alias("s")).select("item", F.col("s.place").alias("at"), F.col("s.seed").alias("seed"))
    few = wanted.count() <= BROADCAST_ROWS
    small = F.broadcast if few else (lambda df: df)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    emitted = texts.select("id", words_of(F.col("t")).alias("w")).select("id", F.explode(seeds(F.col("w"), every)).alias("s")).select("id", "s.place", "s.seed")
    sizes = items.select("item", size.alias("n"))
    hits = emitted.join(small(wanted), "seed").select("id", "item", (F.col("place") - F.col("at")).alias("offset")).distinct()
    hits = checkpoint(hits.join(small(sizes), "item"))
    # the words beside each hit, taken out of a document's words at once
    by_doc = hits.groupBy(F.col("id").alias("hit_id")).agg(F.collect_list(F.struct("item", "offset", "n")).alias("hits"))
    by_doc = F.broadcast(by_doc) if hits.count() <= BROADCAST_HITS else by_doc
    both = texts.join(by_doc, F.col("id").eqNullSafe(F.col("hit_id")))
    beside = lambda w: F.transform("hits", lambda h: F.struct(h["item"], h["offset"], F.transform(F.sequence(F.lit(0), h["n"] - 1), lambda j: F.get(w, h["offset"] + j)).alias("w")))
    laid = both.select("id", F.explode(let(words_of(F.col("t")), beside)).alias("h")).select("id", "h.item", "h.offset", "h.w").join(small(items), "item")
    n = F.size("iw")
    span = F.least(n, F.lit(window))
    same = F.zip_with("iw", "w", lambda x, y: F.when(x == y, 1).otherwise(0))
    laid = laid.select("id", "item", "offset", n.alias("n"), span.alias("span"), same.alias("same"))

    def matched(places: Column) -> Column:
        in_window = lambda s: F.aggregate(F.slice(places, s + 1, F.col("span")), F.lit(0), lambda a, x: a + x)
        return F.transform(F.sequence(F.lit(0), F.col("n") - F.col("span")), lambda s: F.struct(in_window(s).alias("matched"), (-(F.col("offset") + s)).alias("back")))

    counts = let(F.col("same"), matched)  # the places are compared once, not for each window
    laid = laid.select("id", "item", "span", F.array_max(counts).alias("best"))
    enough = F.col("best.matched") >= F.ceil(F.col("span") * F.lit(similarity) - F.lit(1e-9))
    best = laid.where(enough).groupBy("id", "item").agg(F.max(F.struct("best.matched", "best.back", "span")).alias("x"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("x.matched").cast("long").alias("matched"), (F.col("x.matched") / F.col("x.span")).alias("similarity"), (-F.col("x.back")).cast("long").alias("start"))
