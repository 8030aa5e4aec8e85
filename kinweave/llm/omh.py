"""Near-duplicate documents by order MinHash.

A document's shingles (SHINGLE words, or all of them if it has fewer) are labelled by their occurrence, so that
a shingle's second copy is a shingle of its own. For each hash function the TAKEN least ones are taken and kept
in text order; that ordered tuple is a sketch, alike for two texts only if they share the shingles in the same
order: it is sensitive to edit similarity, not just to the sets. ROWS sketches make a band; texts that agree in
a band are candidates.

Verification lays the shingles of two texts side by side by a banded alignment (longest common subsequence, with
as many steps off the diagonal as the similarity allows): similarity = common / (all of both - common), a Jaccard
similarity that counts shingles in order. Links are pairs of at least SIMILARITY.

Exact copies (equal words) are one text from the start, however many there are. In a bucket of texts that agree in
a band pairs aren't all made. First each text is held against the bucket's hub, the text with the most company over
all its buckets: mostly the source of the copies. Texts that links connect are one class. Buckets that then still
hold several classes are looked at again: up to SMALL texts with all pairs across classes, larger ones ROUNDS times
with one more hub, the best-connected text of the classes without one. The texts of large buckets that hold several
classes even then are joined by prefixes: similar texts have so many labelled shingles in common that, in any one
order of all shingles, the first n - ceil(SIMILARITY n) + 1 of each hold a common one. The order is by frequency, so
what templates share stands last and in no prefix. All pairs across classes that share a prefix shingle are verified,
but for those of two texts that each belong to the largest class of all their buckets: no link of a large bucket is missed. What is left open after
the first hubs is mostly little: up to FEW rows are gathered, and joined and grouped by one task without any exchange. Texts that have rare shingles in common but differ in order cost a pair each.

With 16 bands of 2 sketches of 2 shingles a pair of similarity 0.8 meets with a probability of about 0.9998, and
surely above 0.95; a link can be missed only there.

Cases: null and empty texts have no words and are each a class of their own; a null id counts as the smallest and is
passed on; rows repeated under one id are one text, or several if their texts differ; ties between hubs go to the
smaller fingerprint; very long texts take memory in proportion to their words; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from .common import checkpoint, mix, raw, small_batches
from .exchange import CHUNK, NO_ID, give_back, id_of, public_id, starts
from .substrings import rolled, word_hashes

SHINGLE, SIMILARITY = 5, 0.8
TAKEN, ROWS, BANDS = 2, 2, 16
SMALL, ROUNDS = 16, 3
#: Rounds of the classes that prefixes are joined by; what is joined further only costs pairs.
NEAR_ROUNDS = 4
#: Counters of shingles by hash: the order of a prefix join needs no exact frequencies.
SLOTS, SLOT_BLOCKS = 1 << 20, 32
#: Bytes of laid out texts that a worker remembers while it compares pairs.
KNOWN = 32_000_000
#: Shingles of minor texts that are broadcast, so that others only emit these: some 4 MB.
WANTED = 500_000
#: Rows of a table that one task works through without any exchange: links to be joined, entries of buckets left open, pairs.
FEW = 100_000


def shingles(words: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of texts that stand one after another, and the number of each text's."""
    counts = np.where(sizes >= width, sizes - width + 1, (sizes > 0).astype(np.int64))
    at = starts(sizes)
    out = np.zeros(int(counts.sum()), np.uint64)
    first = starts(counts)
    full = rolled(words, width)
    long = sizes >= width
    own = np.repeat(long, counts)
    where = np.repeat(at[:-1], counts) + np.arange(len(out)) - np.repeat(first[:-1], counts)
    out[own] = full[where[own]]
    for i in np.flatnonzero((sizes > 0) & ~long):
        out[first[i]] = rolled(words[at[i] : at[i + 1]], int(sizes[i]))[0]
    return out, counts


def labelled(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence in the text mixed in."""
    text = np.repeat(np.arange(len(counts)), counts)
    key = mix(values ^ (text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    occurrence = np.empty(len(k), np.uint64)
    occurrence[order] = (np.arange(len(k)) - lead).astype(np.uint64)
    return mix(values + occurrence * np.uint64(0xC2B2AE3D27D4EB4F))


def sketches(values: np.ndarray, counts: np.ndarray, functions: int, taken: int) -> np.ndarray:
    """For each text with shingles (a column) and function: a hash of the least shingles in text order."""
    some = np.flatnonzero(counts)
    first = starts(counts)[:-1][some]
    n = counts[some]
    out = np.empty((functions, len(some)), np.uint64)
    odd = np.random.default_rng(11).integers(1, 2**63, (functions, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for f in range(functions):
        v = (values ^ odd[f, 0]) * odd[f, 1]
        places = []
        for _ in range(taken):
            least = np.minimum.reduceat(v, first)
            # the place of each text's least value: the first that equals it
            at = np.flatnonzero(v == np.repeat(least, n))
            text = np.searchsorted(first, at, side="right") - 1
            lead = np.concatenate(([True], text[1:] != text[:-1]))
            places.append(at[lead])
            v[at[lead]] = np.uint64(2**64 - 1)
        order = np.sort(np.stack(places), axis=0)  # text order
        h = np.full(len(some), f, np.uint64)
        for row in order:
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + values[row])
        out[f] = h
    return out


def bands_of(texts: list[bytes], shingle: int, taken: int, rows: int, bands: int) -> list[tuple[int, list[int] | None]]:
    """Number of shingles and band hashes (none without words) of each text."""
    buffer = np.frombuffer(b"\n".join(texts), np.uint8)
    words, begin = word_hashes(buffer)
    at = np.searchsorted(begin, starts(np.array([len(t) + 1 for t in texts])))
    values, counts = shingles(words, np.diff(at), shingle)
    if not len(values):
        return [(0, None)] * len(texts)
    own = sketches(labelled(values, counts), counts, rows * bands, taken)
    keys = np.empty((bands, own.shape[1]), np.uint64)
    for b in range(bands):
        h = np.full(own.shape[1], b, np.uint64)
        for r in range(rows):
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + own[b * rows + r])
        keys[b] = h
    found = iter(keys.T.astype(np.int64).tolist())
    return [(int(n), next(found) if n else None) for n in counts]


def common_in_order(a: list[int], b: list[int], off: int) -> int:
    """Longest common subsequence within `off` steps of the diagonal, 64 and more places at a time (bit-parallel)."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    end = 0
    while end < min(len(a), len(b)) - lo and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[lo : len(a) - end], b[lo : len(b) - end]
    if not a or not b:
        return lo + end
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    every = (1 << len(b)) - 1
    row = every
    for i, x in enumerate(a):
        match = masks.get(x, 0)
        if match:
            match &= ((1 << (i + off + 1)) - 1) >> max(0, i - off) << max(0, i - off)  # the band
            u = row & match
            row = ((row + u) | (row - u)) & every
    return lo + end + len(b) - row.bit_count()


def laid_out(t: bytes, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's shingles in order, and its labelled ones sorted."""
    words, _ = word_hashes(np.frombuffer(t, np.uint8))
    values, counts = shingles(words, np.array([len(words)]), shingle)
    return values, np.sort(labelled(values, counts))


def similar(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    """Whether the ordered Jaccard similarity of two texts' shingles, as laid out, is at least `least`."""
    (x, lx), (y, ly) = one, other
    total = len(x) + len(y)
    need = least * total / (1 + least)
    if min(len(x), len(y)) < need - 1e-9:
        return False
    at = np.searchsorted(ly, lx)
    at[at == len(ly)] = 0
    if np.count_nonzero(ly[at] == lx) < need - 1e-9:
        return False
    common = common_in_order(x.tolist(), y.tolist(), int(total - 2 * need) + 1)
    return common >= least * (total - common) - 1e-9


def sketched(docs: DataFrame, id_col: str, text_col: str, shingle: int, taken: int, rows: int, bands: int) -> DataFrame:
    """id, text fingerprint, shingles and band hashes."""
    small_batches(docs.sparkSession)

    def run(batches):
        give_back()
        for b in batches:
            found, made, group, size = raw(b.column(1)), [], [], 0
            for t in [*found, None]:
                if t is None or size >= CHUNK:
                    made += bands_of(group, shingle, taken, rows, bands) if group else []
                    group, size = [], 0
                if t is not None:
                    group.append(t)
                    size += len(t)
            prints = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary()), pa.array([n for n, _ in made], pa.int64()), pa.array([k for _, k in made], pa.list_(pa.int64()))], names=["id", "text", "n", "bands"])
        give_back()

    return docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, text binary, n long, bands array<long>")


def squeezed(docs: DataFrame, text_col: str) -> DataFrame:
    """Fingerprint and compressed words of each row."""

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            words = [b" ".join(t.split()) for t in raw(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in words], pa.binary()), pa.array([squeeze(t) for t in words], pa.binary())], names=["text", "z"])

    return docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "text binary, z binary")


def verified(pairs: DataFrame, words: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of fingerprints whose texts are similar."""

    def run(batches):
        open_up = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        held = 0

        def own(text: bytes, z: bytes) -> tuple[np.ndarray, np.ndarray]:
            nonlocal held
            found = known.get(text)
            if found is None:
                found = laid_out(open_up(z), shingle)
                if held > KNOWN:
                    known.clear()
                    held = 0
                known[text] = found
                held += 16 * len(found[0]) + 500
            return found

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(4)]
            kept = [(x, y) for x, y, p, q in zip(*cols, strict=True) if similar(own(x, p), own(y, q), least)]
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.binary()) for i in range(2)], names=["a", "b"])

    left = words.select(F.col("text").alias("a"), F.col("z").alias("za"))
    right = words.select(F.col("text").alias("b"), F.col("z").alias("zb"))
    if pairs.count() <= FEW:  # only the words of these are dealt out, once
        left = left.join(F.broadcast(pairs), "a")
        right = right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
        return left.join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "za", "zb").mapInArrow(run, "a binary, b binary")


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def prefixes(texts: DataFrame, words: DataFrame, shingle: int, least: float) -> DataFrame:
    """texts: text, label, minor. The rarest shingles (shingle, rank) of each: of two similar texts, one at least minor, the prefixes have one in common."""
    held = checkpoint(texts.join(words, "text").select("text", "label", "minor", "z"))

    def own(z: bytes) -> np.ndarray:
        found, _ = word_hashes(np.frombuffer(zstandard.ZstdDecompressor().decompress(z), np.uint8))
        return labelled(*shingles(found, np.array([len(found)]), shingle))

    size = SLOTS // SLOT_BLOCKS

    def count(batches):
        """The task's counts, a row a block of slots."""
        counts = np.zeros(SLOTS, np.int64)
        for b in batches:
            for z in b.column(0).to_pylist():
                np.add.at(counts, (own(z) % np.uint64(SLOTS)).astype(np.int64), 1)
        used = [k for k in range(SLOT_BLOCKS) if counts[k * size : (k + 1) * size].any()]
        squeeze = zstandard.ZstdCompressor(level=1).compress
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([squeeze(counts[k * size : (k + 1) * size].tobytes()) for k in used], pa.binary())], names=["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        open_up = zstandard.ZstdDecompressor().decompress
        total = np.zeros(size, np.int64)
        for z in table.column("counts").to_pylist():
            total += np.frombuffer(open_up(z), np.int64)
        return pa.table({"block": table.column("block").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    frequency = np.zeros(SLOTS, np.int32)
    counted = held.select("z").mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, counts binary")
    for r in counted.collect():  # SLOTS numbers at most
        frequency[r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["counts"], np.int32)

    def made(texts: DataFrame, wanted: np.ndarray | None) -> DataFrame:
        """The prefixes, shingle by shingle with their ranks from the rarest on; if given, only the wanted (sorted) ones."""

        def run(batches):
            for b in batches:
                first, ranks, many, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [], []
                for z in b.column(3).to_pylist():
                    values = own(z)
                    n = len(values)
                    rarest = np.lexsort((values, frequency[(values % np.uint64(SLOTS)).astype(np.int64)]))
                    found = values[rarest[: n - math.ceil(least * n - 1e-9) + 1]]
                    rank = np.flatnonzero(frequency[(found % np.uint64(SLOTS)).astype(np.int64)] > 1)  # the others no other text has
                    if wanted is not None:
                        rank = rank[np.isin(found[rank], wanted)]
                    found = found[rank]
                    first.append(found)
                    ranks.append(rank)
                    many.append(len(found))
                    sizes.append(n)
                take = pa.array(np.repeat(np.arange(len(many)), many), pa.int64())
                columns = [pa.array(np.concatenate(first).view(np.int64)), *(b.column(i).take(take) for i in range(3)), pa.array(sizes, pa.int64()).take(take), pa.array(np.concatenate(ranks))]
                yield pa.RecordBatch.from_arrays(columns, names=["shingle", "text", "label", "minor", "n", "rank"])

        return texts.select("text", "label", "minor", "z").mapInArrow(run, "shingle long, text binary, label binary, minor boolean, n long, rank long")

    few = checkpoint(made(held.where("minor"), None))
    many = few.select("shingle").distinct()
    wanted = None
    if many.count() <= WANTED:
        wanted = np.sort(np.array([r["shingle"] for r in many.collect()], np.int64).view(np.uint64))
    return checkpoint(few.union(made(held.where("not minor"), wanted)))


def across_labels(every: DataFrame) -> DataFrame:
    """The shingles that several labels and a minor text have."""
    shared = every.groupBy("shingle").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.max("minor").alias("minor")).where("l1 <> l2 and minor").select("shingle")
    return checkpoint(every.join(shared, "shingle", "left_semi"))


def prefix_pairs(every: DataFrame, others: DataFrame, least: float, both_ways: bool) -> DataFrame:
    """All pairs of a minor text and one of the others, across labels, that can be similar by a shingle that their prefixes share.

    both_ways: the others hold every minor text too, so two minor ones would meet twice.
    """
    other = others.select("shingle", F.col("text").alias("text2"), F.col("label").alias("label2"), F.col("n").alias("n2"), F.col("rank").alias("rank2"), F.col("minor").alias("minor2"))
    # at the rarest common shingle all common ones are still to come: as many as two similar texts need must be left in both
    long_enough = F.least(F.col("n") - F.col("rank"), F.col("n2") - F.col("rank2")) >= least / (1 + least) * (F.col("n") + F.col("n2")) - 1e-9
    apart = F.col("label") != F.col("label2")
    if both_ways:
        apart &= ~F.col("minor2") | (F.col("text") < F.col("text2"))
    return every.where("minor").join(other, "shingle").where(apart & long_enough).select(*ordered(F.col("text"), F.col("text2"))).distinct()


def one_of_each(every: DataFrame) -> DataFrame:
    """One text of each class at each shingle: that with the least rank."""
    first = F.min_by(F.struct("text", "n", "rank", "minor"), F.struct("rank", "text"))
    return every.groupBy("shingle", "label").agg(first.alias("o")).select("shingle", "label", "o.*")


def gathered(df: DataFrame) -> tuple[DataFrame, bool]:
    """A table of few rows as one partition, so that joins and groups of it need no exchange; whether it is one."""
    return (checkpoint(df.coalesce(1)).coalesce(1), True) if df.count() <= FEW else (df, False)


def joined(edges: DataFrame, rounds: int | None = None, node: str = "text", kind: str = "binary") -> DataFrame:
    """(text, label): components of the links (a, b); few ones are joined by one task, whole."""
    if edges.count() > FEW:
        return components(edges, rounds=rounds).withColumnRenamed("node", node)
    of = {"binary": pa.binary(), "long": pa.int64()}[kind]

    def run(batches):
        root: dict = {}

        def top(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = top(x), top(y)
                root[max(x, y)] = min(x, y)
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, of), pa.array([top(x) for x in nodes], of)], names=[node, "label"])

    return F.broadcast(checkpoint(edges.select("a", "b").coalesce(1).mapInArrow(run, f"{node} {kind}, label {kind}")))


def links(entries: DataFrame, words: DataFrame, shingle: int, least: float, small: int, rounds: int) -> DataFrame:
    """entries: key, text. Verified pairs, enough to connect each class."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    company = entries.join(sizes, "key")
    degree = company.groupBy("text").agg(F.sum("size").alias("degree"))
    entries = checkpoint(company.join(degree, "text").select("key", "text", "size", "degree"))
    rank = F.struct("degree", "text")
    hubs = entries.groupBy("key").agg(F.max(rank).alias("h")).select("key", F.col("h.text").alias("hub"))
    tried = checkpoint(entries.join(hubs, "key").where("text <> hub").select(*ordered(F.col("text"), F.col("hub"))).distinct())
    found = checkpoint(verified(tried, words, shingle, least))

    def mixed(near: int = 2) -> tuple[DataFrame, bool]:
        """The entries of buckets that hold several classes: what connects those is all that can matter."""
        label = checkpoint(joined(found, near)) if found.count() > FEW else joined(found)  # of many, classes as far as two rounds find them: stars, whole
        classed = checkpoint(entries.join(label, "text", "left").select("key", "text", "size", "degree", F.coalesce("label", "text").alias("label")))
        keys = classed.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("key")
        return gathered(checkpoint(classed.join(keys, "key", "left_semi")))

    for k in range(max(1, rounds)):
        classed, one = mixed()
        entries = classed.drop("label")  # classes only grow together: the other buckets are done
        flat = (lambda df: df.coalesce(1)) if one else (lambda df: df)
        held_by = lambda df: flat(checkpoint(flat(df)))  # noqa: B023, E731
        if k == 0:
            hubs = held_by(entries.groupBy("key").agg(F.max(rank).alias("h")).select("key", F.col("h.text").alias("hub")))
            tried, _ = gathered(tried)
        if one:
            words = checkpoint(words.join(F.broadcast(entries.select("text")), "text", "left_semi").coalesce(12))
        few = classed.where(F.col("size") <= small).select("key", "text", "label")
        other = few.select("key", F.col("text").alias("text2"), F.col("label").alias("label2"))
        across = few.join(other, "key").where("label < label2").select(*ordered(F.col("text"), F.col("text2")))
        many = classed.where(F.col("size") > small)
        seen = hubs.join(many.select("key", F.col("text").alias("hub"), F.col("label").alias("done")), ["key", "hub"]).select("key", F.col("done").alias("label"))
        fresh = many.join(seen, ["key", "label"], "left_anti")
        more = held_by(fresh.groupBy("key").agg(F.max(rank).alias("h")).select("key", F.col("h.text").alias("hub")))
        held = more.join(many.select("key", F.col("text").alias("hub"), F.col("label").alias("hl")), ["key", "hub"])
        star = many.join(held, "key").where("label <> hl").select(*ordered(F.col("text"), F.col("hub")))
        new = held_by(flat(across.union(star)).distinct().join(tried, ["a", "b"], "left_anti"))
        if new.isEmpty():
            break
        tried = held_by(tried.union(new))
        hubs = held_by(hubs.union(more))
        good = checkpoint(verified(new, words, shingle, least))
        if good.isEmpty():
            continue
        found = checkpoint(found.union(good))
    rest = mixed(NEAR_ROUNDS)[0].where(F.col("size") > small)
    # of two texts of different classes in a bucket one isn't of its largest class
    shares = rest.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = shares.groupBy("key").agg(F.max(F.struct("n", "label")).alias("x")).select("key", F.col("x.label").alias("largest"))
    rest = rest.join(largest, "key").groupBy("text", "label").agg(F.max(F.col("label") != F.col("largest")).alias("minor"))
    rest = checkpoint(rest)
    if rest.isEmpty():
        return found
    every = across_labels(prefixes(rest, words, shingle, least))
    # one text of a class for it at each shingle, so that texts that join a large class aren't held against all of it
    new = checkpoint(prefix_pairs(every, one_of_each(every), least, False).join(tried, ["a", "b"], "left_anti"))
    tried = tried.union(new)
    good = checkpoint(verified(new, words, shingle, least))
    if not good.isEmpty():
        found = checkpoint(found.union(good))
        label = joined(found, NEAR_ROUNDS).withColumnRenamed("label", "now")
        every = across_labels(every.join(label, "text", "left").withColumn("label", F.coalesce("now", "label")).drop("now"))
    new = checkpoint(prefix_pairs(every, every, least, True).join(tried, ["a", "b"], "left_anti"))
    return found.union(checkpoint(verified(new, words, shingle, least)))


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
    similarity: float = SIMILARITY, taken: int = TAKEN, rows: int = ROWS, bands: int = BANDS,
    small: int = SMALL, rounds: int = ROUNDS,
) -> DataFrame:
    """A row a row: id, class_id (the smallest id of its class) and class_size (rows of the class)."""
    made = checkpoint(sketched(docs, id_col, text_col, shingle, taken, rows, bands))
    texts = made.where("n > 0").groupBy("text").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.min("bands").alias("bands"))
    texts = checkpoint(texts)
    entries = texts.select("text", F.explode("bands").alias("key"))
    keys = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("key")
    entries = checkpoint(entries.join(keys, "key", "left_semi"))
    wanted = entries.select("text").distinct()
    words = squeezed(docs, text_col).join(wanted, "text", "left_semi").groupBy("text").agg(F.min("z").alias("z"))
    label = joined(links(entries, checkpoint(words), shingle, similarity, small, rounds))
    classes = texts.join(label, "text", "left").select("text", "id", "copies", F.coalesce("label", "text").alias("label"))
    firsts = classes.groupBy("label").agg(F.min("id").alias("class_id"), F.sum("copies").alias("class_size"))
    by_text = classes.join(firsts, "label").select("text", "class_id", "class_size")
    alone = made.where("n = 0").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    out = made.where("n > 0").select("id", "text").join(by_text, "text").select("id", "class_id", "class_size").union(alone)
    return out.select(public_id().alias(id_col), F.when(F.col("class_id") != NO_ID, F.col("class_id")).alias("class_id"), "class_size")
