"""Substring dedup by Rabin-Karp hashes of every window of `width` words.

Words are runs of bytes other than space and \\x09-\\x0D. Every window of every document is hashed; the
packed exchange tells which windows also start in a document with a smaller id; these merge into maximal
intervals of removed words. Windows are judged on the input, not on what is left.

Hashes have 64 bits: among n different windows about n**2 / 2**65 pairs share one by chance.

Cases: null and empty texts have no words and keep nothing to remove; a null id counts as the smallest; rows
repeated under one id are one document and don't remove each other (texts that differ under one id get the
places found in any of them); ties within a document are no repeats; very long texts are hashed in pieces;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange
from .common import BASE, INVERSE, mix, powers, prefix_sums, raw, symbol_values

WIDTH = 13
#: Words of a piece of a long text.
PIECE = 400_000
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True


def word_hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a buffer."""
    space = SPACE[buffer]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1), append=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(begin) == 0:
        return np.zeros(0, np.uint64), begin
    sums = prefix_sums(symbol_values()[buffer])
    h = (sums[end] - sums[begin]) * powers(INVERSE, len(buffer))[begin]
    h += (end - begin).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    return mix(h), begin


def rolled(words: np.ndarray, width: int) -> np.ndarray:
    """The Rabin-Karp hash of each `width` words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(BASE, len(words)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(INVERSE, n))


def window_hashes(texts: list[bytes], width: int):
    """(text, first word, hashes): the windows of the texts, a long text in pieces, many short ones at once."""
    short: list[int] = []
    size = 0

    def together():
        parts = [texts[i] for i in short]
        buffer = np.frombuffer(b"\n".join(parts), np.uint8)
        words, begin = word_hashes(buffer)
        at = np.searchsorted(begin, exchange.starts(np.array([len(p) + 1 for p in parts])))
        hashes = rolled(words, width)
        for i, lo, hi in zip(short, at[:-1].tolist(), at[1:].tolist(), strict=True):
            yield i, 0, hashes[lo : max(lo, hi - width + 1)]

    for i, t in enumerate(texts):
        if len(t) > exchange.CHUNK:
            found = t.split()
            for lo in range(0, max(1, len(found) - width + 1), PIECE):
                buffer = np.frombuffer(b" ".join(found[lo : lo + PIECE + width - 1]), np.uint8)
                yield i, lo, rolled(word_hashes(buffer)[0], width)
            continue
        short.append(i)
        size += len(t)
        if size >= exchange.CHUNK:
            yield from together()
            short, size = [], 0
    if short:
        yield from together()


def settle_documents(keys, place, extra, ids, at):
    """Entries of a key's smallest id are sent; those of larger ids are repeats."""
    if not len(keys):
        return np.zeros(0, bool), None, np.zeros(0, np.int8)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    doc = ids[np.searchsorted(at, place, side="right") - 1]
    least = np.repeat(np.minimum.reduceat(doc, first), np.diff(np.append(first, len(keys))))
    later = doc > least
    return ~later, None, later.astype(np.int8)


def decide_documents(bucket: exchange.Bucket) -> list:
    order = np.argsort(bucket.keys)
    keys, docs = bucket.keys[order], bucket.docs[order]
    if not len(keys):
        return []
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    least = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(keys))))
    later = order[docs > least]
    return [(1, bucket.docs[later], bucket.at[later])]


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """id and the places (first words) of windows that also start in a document with a smaller id."""

    def emit(held, b):
        ids, found = b.column(0).to_pylist(), raw(b.column(1))
        numbers: dict[int, int] = {}
        for i, lo, hashes in window_hashes(found, width):
            if i not in numbers or not held.held:  # the text may go on after a flush
                numbers[i] = held.document(ids[i], len(found[i]) + 1)
            held.add(np.full(len(hashes), numbers[i]), np.arange(lo, lo + len(hashes)), hashes)
            if held.held >= exchange.FLUSH:
                numbers.clear()
                yield
        yield

    narrow = docs.select(exchange.id_of(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    packed = exchange.send(narrow, ["id", "t"], emit, settle_documents)
    return exchange.answer(packed, decide_documents)


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """A row a document: n_words, n_removed, intervals (maximal removed [begin, end) of words), kept_sha256 and, if asked for, kept text."""
    marks = exchange.by_document(repeated_windows(docs, id_col=id_col, text_col=text_col, width=width))
    joined = exchange.packed_texts(docs, id_col=id_col, text_col=text_col).join(marks.select("id", "first"), "id", "left")
    span = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for z, parts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = exchange.unpack(z).split()
                at = exchange.places(parts)
                at = at[at < max(0, len(words) - width + 1)]
                spans, removed = [], 0
                if len(at):
                    breaks = np.flatnonzero(np.diff(at) > width) + 1
                    begin, end = at[np.concatenate(([0], breaks))], at[np.concatenate((breaks - 1, [len(at) - 1]))] + width
                    removed = int((end - begin).sum())
                    kept, last = [], 0
                    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
                        kept += words[last:x]
                        last = y
                        spans.append({"begin": x, "end": y})
                    kept += words[last:]
                else:
                    kept = words
                text = b" ".join(kept)
                out.append((len(words), removed, spans, hashlib.sha256(text).hexdigest(), text.decode() if with_text else None))
            kinds = (pa.int64(), pa.int64(), span, pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], names=["id", "n_words", "n_removed", "intervals", "kept_sha256", "kept"])

    found = joined.select("id", "z", "first").mapInArrow(run, "id long, n_words long, n_removed long, intervals array<struct<begin:long,end:long>>, kept_sha256 string, kept string")
    return found.select(exchange.public_id().alias(id_col), "n_words", "n_removed", "intervals", "kept_sha256", *(["kept"] if with_text else []))
