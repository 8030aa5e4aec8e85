"""Suffix-array dedup by a depth-limited radix sort.

Suffixes (each byte of each document starts one) are ordered only through their first `depth` bytes, by passes from
the most significant digit on; a suffix alone in its group leaves after each pass, and the equal groups of the last
pass are exactly the repeated windows of `depth` bytes. Bytes decide, never a hash of them.

1. Over the whole table, by a first digit that neighbours share: of the GRAM-byte pieces inside the first `depth` bytes
   the one with the least hash. Neighbouring suffixes mostly have the same one, so a run of them is one entry of
   a packed exchange. Runs whose gram no other run has leave; a hash shared by chance only keeps them in.
2. The others send their bytes, a task of equal runs one, and meet by the gram. There runs are sorted by digits of
   8 bytes over all bytes of the run, groups of more than one going on: equal runs are settled whole.
3. What is left of a gram's different runs is taken apart into suffixes, and these are sorted by digits of 8 bytes
   through the depth, those that stand alike about the gram together.

Grams that a quarter of a bucket's runs share, or HOT runs and more, would make a hot task of passes 2 and 3: their
runs are cut into stretches of STRETCH suffixes by their distance from the gram, and dealt out by what all suffixes of
such a stretch have in common, so that equal suffixes still meet.

Cases: null counts as empty; a text shorter than the depth has no suffix; a null id counts as the smallest;
rows repeated under one id are one document and don't remove each other (texts that differ under one id get the places
found in any of them); ties go to the smaller id, then the earlier start; very long texts are cut into pieces that
overlap by depth - 1 bytes; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import INVERSE, checkpoint, mix, partitions, planes, powers, prefix_sums, raw, symbol_values, unplanes

DEPTH, GRAM = 100, 32
#: Bytes of text whose suffixes are digested at once.
CHUNK = 1 << 18
#: Low bits of a hash that give way to the place: more than a chunk and a piece have.
LOW = np.uint64(24)
#: Bytes of runs that a task holds before it sends them, and suffixes that a bucket sorts at once.
HELD, SORTED = 16 << 20, 300_000
#: Runs of a gram from which on it is hot, and the suffixes of a stretch of a hot gram's run.
HOT, STRETCH = 50_000, 8
SEGMENTS = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "docs", "firsts", "keys", "backs", "sizes", "bytes", "done_docs", "done_starts"))])


class Runs:
    """Runs of neighbouring suffixes with one gram, over some pieces of texts: text, first and last start and the gram's start."""

    def __init__(self, pieces: list[tuple[int, int, bytes]], depth: int, gram: int):
        """pieces: number of the text, start in it, bytes; no suffix of `depth` bytes crosses a piece's end."""
        self.depth = depth
        self.buffer = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        n = len(self.buffer)
        sizes = np.array([len(p) for _, _, p in pieces], np.int64)
        edges = exchange.starts(sizes)
        self.sums = prefix_sums(symbol_values()[self.buffer])
        window = depth - gram + 1  # grams of a suffix
        if n < depth:
            self.text = self.first = self.last = self.at = self.base = np.zeros(0, np.int64)
            self.gram = np.zeros(0, np.uint64)
            return
        h = (self.sums[gram:] - self.sums[:-gram]) * powers(INVERSE, n - gram + 1)
        mix(h)
        # The least hash, and of equal ones the leftmost: places stand in the low bits.
        least, have = ((h >> LOW) << LOW) | np.arange(n - gram + 1, dtype=np.uint64), 1
        while have * 2 <= window:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if have < window:
            rest = window - have
            least = np.minimum(least[:-rest], least[rest:])
        anchor = (least & ((np.uint64(1) << LOW) - np.uint64(1))).astype(np.int64)
        piece = np.repeat(np.arange(len(pieces)), sizes)
        valid = piece[: n - depth + 1] == piece[depth - 1 :]
        change = np.ones(n - depth + 1, bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1]) | (piece[1 : n - depth + 1] != piece[: n - depth])
        first = np.flatnonzero(change)
        last = np.append(first[1:], n - depth + 1) - 1
        use = valid[first]
        self.first, self.last = first[use], last[use]
        self.at = anchor[self.first]
        self.gram = mix(h[self.at])  # least hashes are small: spread again, as buckets are ranges
        which = piece[self.first]
        self.text = np.array([t for t, _, _ in pieces], np.int64)[which]
        self.base = (np.array([b for _, b, _ in pieces], np.int64) - edges[:-1])[which]  # from the buffer to the text

    def hashed(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes between places: for dealing out and grouping, not for deciding."""
        return mix((self.sums[end] - self.sums[begin]) * powers(INVERSE, len(self.buffer) + 1)[begin])


def pieces(texts: list[bytes], depth: int):
    """Groups of pieces of about CHUNK bytes; long texts are cut, with an overlap."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - depth + 1), CHUNK):
            p = t[lo : lo + CHUNK + depth - 1]
            group.append((i, lo, p))
            size += len(p)
            if size >= CHUNK:
                yield group
                group, size = [], 0
    if group:
        yield group


# --- pass 1: grams ----------------------------------------------------------------------------------


def settle_grams(keys, place, extra, ids, at):
    """Of each gram one entry is sent, with the number of the task's runs; runs that share one within the task go on anyway."""
    new = np.concatenate(([True], keys[1:] != keys[:-1]))
    first = np.flatnonzero(new)
    count = np.repeat(np.diff(np.append(first, len(keys))), np.diff(np.append(first, len(keys))))
    return new, count.astype(np.uint64), np.where(count > 1, 2, 0).astype(np.int8)


def decide_grams(bucket: exchange.Bucket) -> list:
    """Entries whose gram another task has too go on; hot grams are noted."""
    if not len(bucket.keys):
        return []
    order = np.argsort(bucket.keys, kind="stable")
    k = bucket.keys[order]
    first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    sizes = np.diff(np.append(first, len(k)))
    runs = np.add.reduceat(bucket.extra[order], first)
    bucket.notes = k[first][runs > max(HOT, int(runs.sum()) // 4)]
    hit = order[np.repeat(sizes > 1, sizes)]
    return [(2, bucket.docs[hit], bucket.at[hit])]


# --- passes 2 and 3: bytes --------------------------------------------------------------------------


def words_at(buffer: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first `size` (1 to 8) bytes from each start as a number, in the order of bytes. The buffer goes on for 8 bytes."""
    view = np.lib.stride_tricks.as_strided(buffer, (len(buffer) - 7, 8), (1, 1))
    out = view[start].view(">u8").ravel().astype(np.uint64)
    return out >> (np.uint64(8) * (np.uint64(8) - size.astype(np.uint64)))


def numbered(*keys: np.ndarray) -> np.ndarray:
    """The same number for entries that are equal in all keys, from 0 on without gaps."""
    out = np.zeros(len(keys[0]), np.int64)
    if len(out):
        order = np.lexsort(keys)
        new = np.zeros(len(out), np.int64)
        for k in keys:
            new[1:] |= k[order][1:] != k[order][:-1]
        out[order] = np.cumsum(new)
    return out


def radix(buffer: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Groups of equal strings, numbered anew: passes by digits of 8 bytes from the left; groups of one are left alone.

    group: of numbered(), to start with; within one all strings have one length.
    """
    group = group.copy()
    free = int(group.max()) + 1 if len(group) else 0
    active = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
    at = 0
    while len(active):
        active = active[length[active] > at]
        if not len(active):
            break
        digit = words_at(buffer, start[active] + at, np.minimum(8, length[active] - at))
        order = np.lexsort((digit, group[active]))
        active, digit = active[order], digit[order]
        own = group[active]
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (digit[1:] != digit[:-1])))
        number = np.cumsum(new) - 1
        group[active] = free + number
        free += int(number[-1]) + 1
        active = active[np.bincount(number)[number] > 1]
        at += 8
    return group


def later(group: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each group the first entry by (id, place); and the entries that stand at other places."""
    if not len(group):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((at, docs, group))
    g, d, a = group[order], docs[order], at[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    first = np.flatnonzero(new)
    lead = np.repeat(first, np.diff(np.append(first, len(g))))
    return order[first], order[~new & ((d != d[lead]) | (a != a[lead]))]  # a row given twice isn't its own repeat


class Segments:
    """Runs with their bytes: id, first start, key, the first suffix's distance from the gram, suffixes after it, place of the bytes."""

    FIELDS = ("docs", "first", "key", "back", "size", "start")

    def __init__(self, docs, first, key, back, size, start, buffer, depth):
        self.docs, self.first, self.key, self.back, self.size, self.start = docs, first, key, back, size, start
        self.buffer, self.depth = buffer, depth  # the buffer has 8 bytes more

    def at(self, index: np.ndarray) -> Segments:
        return Segments(*(getattr(self, n)[index] for n in self.FIELDS), self.buffer, self.depth)

    def equal(self) -> tuple[np.ndarray, np.ndarray]:
        """The first of all equal runs, and the others."""
        kind = numbered(self.key, self.back, self.size)
        return later(radix(self.buffer, self.start, self.size + self.depth, kind), self.docs, self.first)

    def repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids and starts of suffixes that stand earlier too: enough of them to cover what they all cover."""
        kept, same = self.equal()
        docs, starts = [self.docs[same], self.docs[same]], [self.first[same], self.first[same] + self.size[same]]  # a run is shorter than the depth
        left = self.at(kept)
        order = np.argsort(left.key, kind="stable")
        left = left.at(order)
        new = np.concatenate(([True], left.key[1:] != left.key[:-1])) if len(order) else np.zeros(0, bool)
        number = np.cumsum(new) - 1
        several = np.bincount(number, minlength=1)[number] > 1 if len(order) else new
        left, number = left.at(several), number[several]
        cut = [0]
        total = np.cumsum(left.size + 1)
        while cut[-1] < len(number):  # whole keys at once, of about SORTED suffixes
            done = int(total[cut[-1] - 1]) if cut[-1] else 0
            to = max(int(np.searchsorted(total, done + SORTED)), cut[-1])
            to = int(np.searchsorted(number, number[min(to, len(number) - 1)], side="left"))
            cut.append(to if to > cut[-1] else int(np.searchsorted(number, number[cut[-1]], side="right")))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            part, own = left.at(slice(lo, hi)), number[lo:hi]
            # the suffixes at some distances from the gram at once: a key of very many runs isn't taken apart as a whole
            steps = max(1, int(SORTED // max(1, hi - lo)))
            far, near = int(part.back.max()), int((part.back - part.size).min())
            for d in range(near, far + 1, steps):
                low, high = np.maximum(part.back - part.size, d), np.minimum(part.back, d + steps - 1)
                n = np.maximum(high - low + 1, 0)
                which = np.repeat(np.arange(len(n)), n)
                distance = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + low[which]
                step = part.back[which] - distance
                group = radix(self.buffer, part.start[which] + step, np.full(len(which), self.depth, np.int64), numbered(own[which], distance))
                hit = later(group, part.docs[which], part.first[which] + step)[1]
                docs.append(part.docs[which][hit])
                starts.append((part.first[which] + step)[hit])
        return np.concatenate(docs), np.concatenate(starts)


def stretched(runs: Runs, index: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Run, first and last start and key of the wanted runs; those of hot grams in stretches."""
    first, last, key = runs.first[index], runs.last[index], runs.gram[index].copy()
    if not len(hot) or not np.isin(key, hot).any():
        return index, first, last, key
    is_hot = np.isin(key, hot)
    at = runs.at[index]
    high, low = (at - first) // STRETCH, (at - last) // STRETCH
    n = np.where(is_hot, high - low + 1, 1)
    which = np.repeat(np.arange(len(n)), n)
    k = high[which] - (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    near, far = at[which] - k * STRETCH, at[which] - k * STRETCH - STRETCH + 1  # starts of the stretch, were it whole
    lone = is_hot[which]
    begin = np.where(lone, np.maximum(first[which], far), first[which])
    end = np.where(lone, np.minimum(last[which], near), last[which])
    common = runs.hashed(np.where(lone, near, 0), np.where(lone, far + runs.depth, 0))
    return index[which], begin, end, np.where(lone, mix(key[which] ^ common + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), key[which])


class Held:
    """The runs that a task holds: arrays by piece of text, and their bytes one after another."""

    def __init__(self, depth: int, buckets: int):
        self.depth, self.buckets = depth, buckets
        self.clear()

    def clear(self) -> None:
        self.parts, self.bytes, self.held = [], [], 0

    def add(self, doc: int, runs: Runs, index: np.ndarray, hot: np.ndarray) -> None:
        which, first, last, key = stretched(runs, index, hot)
        size = last - first
        length = size + self.depth
        take = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        self.bytes.append(runs.buffer[take])
        self.parts.append((np.full(len(first), doc, np.int64), first + runs.base[which], key, runs.at[which] - first, size, length))
        self.held += len(take)

    def flush(self):
        """A row a bucket: the different runs, sorted, and what is settled among the task's own."""
        if not self.parts:
            return
        docs, first, key, back, size, length = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        buffer = np.concatenate([*self.bytes, np.zeros(8, np.uint8)])
        self.clear()
        all_ = Segments(docs, first, key, back, size, np.cumsum(length) - length, buffer, self.depth)
        kept, same = all_.equal()
        done_docs = np.concatenate((docs[same], docs[same]))
        done_starts = np.concatenate((first[same], first[same] + size[same]))
        done_bucket = self.bucket(np.concatenate((key[same], key[same])))
        kept = kept[np.lexsort((size[kept], back[kept], key[kept]))]
        bucket = self.bucket(key[kept])
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        order = np.lexsort((done_starts, done_docs, done_bucket))
        done_docs, done_starts = done_docs[order], done_starts[order]
        done_cut = np.searchsorted(done_bucket[order], np.arange(self.buckets + 1))
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in range(self.buckets):
            own, done = kept[cut[b] : cut[b + 1]], slice(int(done_cut[b]), int(done_cut[b + 1]))
            if not len(own) and done.start == done.stop:
                continue
            ids = np.unique(np.concatenate((docs[own], done_docs[done])))
            number = lambda d, ids=ids: planes(np.searchsorted(ids, d).astype(np.uint32))
            n = size[own] + self.depth
            take = np.repeat(all_.start[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            row = (
                b, planes(np.diff(ids, prepend=np.int64(0))), number(docs[own]), planes(first[own].astype(np.uint32)), planes(np.diff(key[own], prepend=np.uint64(0))),
                back[own].astype(np.uint8).tobytes(), size[own].astype(np.uint8).tobytes(), squeeze(buffer[take].tobytes()), number(done_docs[done]), planes(done_starts[done].astype(np.uint32)),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENTS, strict=True)], schema=SEGMENTS)

    def bucket(self, key: np.ndarray) -> np.ndarray:
        """In the order of keys."""
        return ((key >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)


def sorted_out(packed: DataFrame, depth: int) -> DataFrame:
    """The answers of all buckets: starts of repeated suffixes."""
    ways = partitions(packed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        exchange.give_back()
        parts, texts, done = [], [], []
        open_up = zstandard.ZstdDecompressor().decompress
        for ids, docs, firsts, keys, backs, sizes, data, done_docs, done_starts in zip(*(table.column(n).to_pylist() for n in SEGMENTS.names[1:]), strict=True):
            known = np.cumsum(unplanes(ids, np.int64))
            key = np.cumsum(unplanes(keys, np.uint64), dtype=np.uint64)
            parts.append((known[unplanes(docs, np.uint32)], unplanes(firsts, np.uint32).astype(np.int64), key, np.frombuffer(backs, np.uint8).astype(np.int64), np.frombuffer(sizes, np.uint8).astype(np.int64)))
            texts.append(np.frombuffer(open_up(data), np.uint8))
            done.append((1, known[unplanes(done_docs, np.uint32)], unplanes(done_starts, np.uint32)))
        docs, first, key, back, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        length = size + depth
        all_ = Segments(docs, first, key, back, size, np.cumsum(length) - length, np.concatenate([*texts, np.zeros(8, np.uint8)]), depth)
        found, starts = all_.repeats()
        rows = list(exchange.dealt([*done, (1, found, starts)], ways))
        del all_, parts, texts, docs, first, key, back, size, length
        exchange.give_back()
        return pa.Table.from_batches(rows, schema=exchange.ANSWER_SCHEMA)

    return packed.groupBy("bucket").applyInArrow(run, exchange.ANSWER)


def dedup_suffixes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, gram: int = GRAM,
    with_text: bool = False,
) -> DataFrame:
    """A row a document: n_bytes, n_removed, spans (maximal removed [begin, end) of bytes), kept_sha256 and, if asked for, kept bytes.

    A byte goes if a string of `depth` bytes that covers it also starts earlier: under a smaller id, or earlier in the document.
    """
    if not gram < depth <= 250:
        raise ValueError("a gram has fewer bytes than the depth, of 250 at most")
    narrow = docs.select(exchange.id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))

    def emit_runs(held, b):
        ids, found = b.column(0).to_pylist(), raw(b.column(1))
        number: dict[int, int] = {}
        seen: dict[int, int] = {}
        for group in pieces(found, depth):
            runs = Runs(group, depth, gram)
            if not held.held:
                number.clear()
            for t, _, _ in group:
                if t not in number:
                    number[t] = held.document(ids[t], len(found[t]) + 1)
            if len(runs.text):
                change = np.concatenate(([True], runs.text[1:] != runs.text[:-1]))
                lead = np.maximum.accumulate(np.where(change, np.arange(len(change)), 0))
                texts = runs.text[change].tolist()
                place = np.arange(len(change)) - lead + np.array([seen.get(t, 0) for t in texts])[np.cumsum(change) - 1]
                for t, n in zip(texts, np.diff(np.append(np.flatnonzero(change), len(change))).tolist(), strict=True):
                    seen[t] = seen.get(t, 0) + n
                held.add(np.array([number[t] for t in texts])[np.cumsum(change) - 1], place, runs.gram)
            yield

    grams = checkpoint(exchange.answer(exchange.send(narrow, ["id", "t"], emit_runs, settle_grams), decide_grams))
    hot = exchange.noted(grams)  # a few of each bucket
    by_run = exchange.by_document(grams.where(F.col("kind") != exchange.NOTE))
    texts = exchange.packed_texts(docs, id_col=id_col, text_col=text_col)
    buckets = 2 * partitions(docs.sparkSession)

    def emit_segments(batches):
        exchange.give_back()
        held = Held(depth, buckets)
        for b in batches:
            for i, z, second in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                wanted, seen = exchange.places(second), 0
                for group in pieces([exchange.unpack(z)], depth):
                    runs = Runs(group, depth, gram)
                    index = wanted[(wanted >= seen) & (wanted < seen + len(runs.text))] - seen
                    seen += len(runs.text)
                    if len(index):
                        held.add(i, runs, index, hot)
                    if held.held >= HELD:
                        yield from held.flush()
        yield from held.flush()
        exchange.give_back()

    shared = texts.join(by_run.where(F.col("second").isNotNull()).select("id", "second"), "id")
    kinds = ", ".join(f"{f.name} {'int' if f.name == 'bucket' else 'binary'}" for f in SEGMENTS)
    packed = shared.select("id", "z", "second").mapInArrow(emit_segments, kinds)
    by_start = exchange.by_document(sorted_out(packed, depth))
    final = texts.join(by_start.select("id", "first"), "id", "left")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            out = []
            for z, starts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text = exchange.unpack(z)
                begin, end = np.frombuffer(starts or b"", np.uint32).astype(np.int64).reshape(-1, 2).T
                use = begin + depth <= len(text)
                begin, end = begin[use], np.minimum(end[use], len(text) - depth) + depth
                spans, kept, at = [], [], 0
                if len(begin):
                    gap = begin[1:] > end[:-1]
                    for x, y in zip(begin[np.concatenate(([True], gap))].tolist(), end[np.concatenate((gap, [True]))].tolist(), strict=True):
                        kept.append(text[at:x])
                        spans.append({"begin": x, "end": y})
                        at = y
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
            kinds = (pa.int64(), pa.int64(), span, pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["id", "n_bytes", "n_removed", "spans", "kept_sha256", "kept"])

    found = final.select("id", "z", "first").mapInArrow(run, "id long, n_bytes long, n_removed long, spans array<struct<begin:long,end:long>>, kept_sha256 string, kept binary")
    return found.select(exchange.public_id().alias(id_col), "n_bytes", "n_removed", "spans", "kept_sha256", *(["kept"] if with_text else []))
