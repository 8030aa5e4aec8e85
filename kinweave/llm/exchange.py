"""A packed exchange: finds, for 64-bit keys of places in documents, which places come first.

A task gathers the keys of many documents, settles what it can among them, and sends each bucket of the key
space one blob: sorted keys by byte position, places as small numbers, and the few document ids they stand
for. Of a key a task sends one place however often it holds it, so a key that a third of all documents have
costs a bucket one entry a task. Buckets meet in groups of equal size and answer with the places that are
not first, by document.

Ids are 64-bit integers; NO_ID stands for null and comes first.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, partitions, planes, raw, small_batches, unplanes

NO_ID = -(2**63)
#: The kind of answers that are notes to the driver.
NOTE = 3
#: Keys that a task holds before it sends them.
FLUSH = 1_000_000
#: Bytes of text hashed at once.
CHUNK = 1 << 18
PACKED = "bucket int, ids binary, sizes binary, keys binary, extra binary, places binary, settled binary"
ANSWER = "way int, kind int, ids binary, sizes binary, places binary"
ANSWER_SCHEMA = pa.schema([("way", pa.int32()), ("kind", pa.int32()), *((n, pa.binary()) for n in ("ids", "sizes", "places"))])


def give_back() -> None:
    """Has the C library and Arrow return freed memory to the system, so that a reused worker doesn't keep its peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD, which else grows with what is freed
        libc.malloc_trim(0)


def id_of(column: str) -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def starts(sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=out[1:])
    return out


class Gathered:
    """What a task holds: ids, the number of places of each document, and keys with their places."""

    def __init__(self, buckets: int, settle: Callable):
        self.buckets, self.settle = buckets, settle
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.docs, self.at, self.keys, self.extra = [], [], [], [], [], []
        self.held = 0

    def document(self, doc_id: int, places: int) -> int:
        self.ids.append(doc_id)
        self.sizes.append(places)
        return len(self.ids) - 1

    def add(self, docs: np.ndarray, places: np.ndarray, keys: np.ndarray, extra: np.ndarray | None = None) -> None:
        self.docs.append(docs.astype(np.int32))
        self.at.append(places.astype(np.uint32))
        self.keys.append(keys)
        if extra is not None:
            self.extra.append(extra)
        self.held += len(keys)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield from self._rows()
        self.clear()

    def _rows(self) -> Iterator[pa.RecordBatch]:
        ids, sizes = np.array(self.ids, np.int64), np.array(self.sizes, np.int64)
        rank = np.empty(len(ids), np.int64)
        by_id = np.argsort(ids, kind="stable")
        rank[by_id] = np.arange(len(ids))
        ids, sizes = ids[by_id], sizes[by_id]
        at = starts(sizes)
        place = at[rank[np.concatenate(self.docs)]] + np.concatenate(self.at)  # places in order of (id, place)
        keys = np.concatenate(self.keys)
        extra = np.concatenate(self.extra) if self.extra else None
        self.clear()
        order = np.argsort(keys)
        keys, place = keys[order], place[order]
        extra = None if extra is None else extra[order]
        # settle: which entries are sent, what is sent beside the key, and the kind of answer settled here (0: none)
        send, extra, kind = self.settle(keys, place, extra, ids, at)
        bucket = ((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(self.buckets + 1))
        schema = pa.schema([("bucket", pa.int32()), *((n, pa.binary()) for n in ("ids", "sizes", "keys", "extra", "places", "settled"))])
        for b in range(self.buckets):
            lo, hi = int(cut[b]), int(cut[b + 1])
            s, k, p = send[lo:hi], kind[lo:hi], place[lo:hi]
            used = s | (k > 0)
            if not used.any():
                continue
            doc = np.searchsorted(at, p[used], side="right") - 1
            present = np.unique(doc)
            local = np.zeros(len(p), np.int64)
            within = starts(sizes[present])
            local[used] = within[np.searchsorted(present, doc)] + (p[used] - at[doc])
            settled = [np.sort(local[k == v]).astype(np.uint32) for v in (1, 2)]
            head = np.array([len(settled[0])], np.uint32)
            row = (
                b,
                planes(np.diff(ids[present], prepend=ids[present[:1]] * 0)),
                planes(sizes[present].astype(np.uint32)),
                planes(keys[lo:hi][s]),
                b"" if extra is None else planes(extra[lo:hi][s]),
                planes(local[s].astype(np.uint32)),
                head.tobytes() + b"".join(planes(np.diff(x, prepend=x[:1] * 0)) for x in settled),
            )
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)


class Bucket:
    """All entries of a bucket: key, extra, document id and place, and the answers settled by the tasks."""

    def __init__(self, table: pa.Table):
        keys, extra, docs, at, self.settled = [], [], [], [], []
        columns = [table.column(n).to_pylist() for n in ("ids", "sizes", "keys", "extra", "places", "settled")]
        for i, s, k, x, p, done in zip(*columns, strict=True):
            ids = np.cumsum(unplanes(i, np.int64))
            first = starts(unplanes(s, np.uint32).astype(np.int64))
            place = unplanes(p, np.uint32).astype(np.int64)
            doc = np.searchsorted(first, place, side="right") - 1
            keys.append(unplanes(k, np.uint64))
            extra.append(unplanes(x, np.uint64) if x else np.zeros(0, np.uint64))
            docs.append(ids[doc])
            at.append((place - first[doc]).astype(np.uint32))
            n = int(np.frombuffer(done[:4], np.uint32)[0])
            for kind, part in ((1, done[4 : 4 + 4 * n]), (2, done[4 + 4 * n :])):
                if part:
                    place = np.cumsum(unplanes(part, np.uint32).astype(np.int64))
                    doc = np.searchsorted(first, place, side="right") - 1
                    self.settled.append((kind, ids[doc], (place - first[doc]).astype(np.uint32)))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.keys, self.extra, self.docs, self.at = join(keys, np.uint64), join(extra, np.uint64), join(docs, np.int64), join(at, np.uint32)
        self.notes = np.zeros(0, np.uint64)  # keys that decide() wants known to all tasks


def note(keys: np.ndarray) -> pa.RecordBatch:
    """A row of kind NOTE, that goes to the driver: of at most a few keys a bucket."""
    row = (-1, NOTE, keys.astype(np.uint64).tobytes(), b"", b"")
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ANSWER_SCHEMA, strict=True)], schema=ANSWER_SCHEMA)


def noted(answers: DataFrame) -> np.ndarray:
    rows = answers.where(F.col("kind") == NOTE).select("ids").collect()
    return np.sort(np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(r["ids"], np.uint64) for r in rows)]))


def dealt(found: list[tuple[int, np.ndarray, np.ndarray]], ways: int) -> Iterator[pa.RecordBatch]:
    """found: kind, ids and places. A row for each kind and each of the `ways` that ids are dealt out to."""
    for kind in (1, 2):
        parts = [(d, p) for k, d, p in found if k == kind and len(d)]
        if not parts:
            continue
        docs, at = np.concatenate([d for d, _ in parts]), np.concatenate([p for _, p in parts]).astype(np.uint32)
        way = mix(docs.view(np.uint64).copy()) % np.uint64(ways)
        order = np.lexsort((at, docs, way))
        docs, at, way = docs[order], at[order], way[order]
        cut = np.append(np.flatnonzero(np.concatenate(([True], way[1:] != way[:-1]))), len(way))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            first = np.flatnonzero(np.concatenate(([True], docs[lo + 1 : hi] != docs[lo : hi - 1])))
            row = (int(way[lo]), kind, planes(np.diff(docs[lo:hi][first], prepend=np.int64(0))), planes(np.diff(np.append(first, hi - lo)).astype(np.uint32)), planes(at[lo:hi].copy()))
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, ANSWER_SCHEMA, strict=True)], schema=ANSWER_SCHEMA)


def send(docs: DataFrame, columns: list[str], emit: Callable, settle: Callable) -> DataFrame:
    """emit(gathered, record batch) adds documents and keys, in steps that it yields after."""
    small_batches(docs.sparkSession)
    buckets = 2 * partitions(docs.sparkSession)

    def run(batches):
        give_back()
        held = Gathered(buckets, settle)
        for b in batches:
            for _ in emit(held, b):
                if held.held >= FLUSH:
                    yield from held.flush()
        yield from held.flush()
        give_back()

    return docs.select(*columns).mapInArrow(run, PACKED)


def answer(packed: DataFrame, decide: Callable[[Bucket], list]) -> DataFrame:
    """decide(bucket) gives (kind, ids, places); the result has them in blobs, dealt out by id."""
    ways = partitions(packed.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        give_back()
        bucket = Bucket(table)
        found = decide(bucket)
        rows = list(dealt([*bucket.settled, *found], ways))
        if len(bucket.notes):
            rows.append(note(bucket.notes))
        del bucket, found
        give_back()
        return pa.Table.from_batches(rows, schema=ANSWER_SCHEMA)

    return packed.groupBy("bucket").applyInArrow(run, ANSWER)


def stretches(at: np.ndarray) -> bytes | None:
    """Sorted places as (first, last) of their stretches."""
    if not len(at):
        return None
    gap = np.flatnonzero(np.diff(at) > 1)
    return np.stack((at[np.concatenate(([0], gap + 1))], at[np.append(gap, len(at) - 1)]), axis=1).astype(np.uint32).tobytes()


def by_document(answers: DataFrame) -> DataFrame:
    """id, first and second: the places of kinds 1 and 2, as places() reads them."""
    schema = pa.schema([("id", pa.int64()), ("first", pa.binary()), ("second", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        found: list[dict[int, bytes | None]] = []
        for kind in (1, 2):
            docs, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for k, i, s, p in zip(*(table.column(n).to_pylist() for n in ("kind", "ids", "sizes", "places")), strict=True):
                if k == kind:
                    docs.append(np.repeat(np.cumsum(unplanes(i, np.int64)), unplanes(s, np.uint32)))
                    at.append(unplanes(p, np.uint32))
            doc, place = np.concatenate(docs), np.concatenate(at)
            order = np.lexsort((place, doc))
            doc, place = doc[order], place[order].astype(np.int64)
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            doc, place = doc[new], place[new]
            cut = np.append(np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1]))), len(doc)) if len(doc) else np.zeros(1, np.int64)
            found.append({int(doc[x]): stretches(place[x:y]) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)})
        ids = sorted({*found[0], *found[1]})
        give_back()
        return pa.Table.from_arrays([pa.array(ids, pa.int64()), *(pa.array([f.get(i) for i in ids], pa.binary()) for f in found)], schema=schema)

    return answers.groupBy("way").applyInArrow(run, "id long, first binary, second binary")


def places(data: bytes | None) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int64)
    first, last = np.frombuffer(data, np.uint32).astype(np.int64).reshape(-1, 2).T
    size = last - first + 1
    return np.repeat(first, size) + np.arange(int(size.sum())) - np.repeat(starts(size)[:-1], size)


def packed_texts(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """id and the text's UTF-8 bytes, compressed for the way through a shuffle."""
    small_batches(docs.sparkSession)

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([squeeze(t) for t in raw(b.column(1))], pa.binary())], names=["id", "z"])

    return docs.select(id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, "id long, z binary")


def unpack(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def public_id(name: str = "id") -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name))
