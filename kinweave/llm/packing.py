"""Mixture-controlled packing: deficit round-robin over source queues.

Each source is a queue of its documents' tokens. In a round every queue's deficit grows by its quantum, its
target share of a window, and as many whole tokens leave it; what is left of the deficit is carried to the next
round. The rounds make one stream, cut into windows of `width` tokens, so every window but the last is full and
holds the target proportions to within a token a queue. A queue that runs dry hands its share to the others.

With quanta known, a round and a place in the stream follow from a token's number in its queue alone. So
only the queues' totals (one number a source) reach the driver; running counts by partition and queue are a
small table, and every document finds its pieces by itself, wherever it lies: deficits carry over windows and
partitions without any task seeing more than its own documents.

Targets: weights by source; by default each source's share of all tokens, so that all queues last to the end.
Of more than MAX_QUEUES sources those with a weight keep queues of their own; the others are hashed into that many
queues, each with the sum of its sources' weights.

Cases: a null text counts as empty and packs as its end token; a null source is the queue of the empty name; a
null id is passed on; rows repeated are each packed; very long texts are cut into pieces over many windows; an
empty table gives an empty result; sources without a target weight share what is left as if their weight were 1;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, joined_batches, small_batches
from .exchange import give_back
from .tokens import SPLIT_AT_ONCE, encoder

WIDTH = 2048
MAX_QUEUES = 1024
#: Quanta are in 2**-FRACTION tokens.
FRACTION = 16
#: Rows (queue and partition) up to which running counts are broadcast: some 10 MB.
BROADCAST_ROWS = 200_000


def quanta(weights: list[int], width: int) -> np.ndarray:
    """Shares of width << FRACTION in proportion to the weights: at least 1, and exact in sum."""
    total, whole = sum(weights), width << FRACTION
    out = [max(1, w * whole // total) for w in weights]
    by_rest = sorted(range(len(weights)), key=lambda i: (-(weights[i] * whole % total), i))
    for i in range(abs(whole - sum(out))):
        out[by_rest[i % len(out)]] += 1 if whole > sum(out) else -1 if out[by_rest[i % len(out)]] > 1 else 0
    return np.array(out, np.int64)


def grown(quantum: np.ndarray, rounds: np.ndarray) -> np.ndarray:
    """Whole tokens of a quantum after some rounds, without overflow."""
    return (rounds >> FRACTION) * quantum + (((rounds & ((1 << FRACTION) - 1)) * quantum) >> FRACTION)


class Schedule:
    """Phases of rounds with constant quanta. By phase: queues at work, quanta, rounds, tokens gone before, place in the stream."""

    def __init__(self, totals: dict[str, int], weights: dict[str, float] | None, width: int):
        self.queues = sorted(totals)
        left = {q: totals[q] for q in self.queues if totals[q] > 0}
        scale = {q: max(1, round((weights.get(q, 1) if weights else totals[q]) * (1 << 20 if weights else 1))) for q in left}
        gone, base = dict.fromkeys(self.queues, 0), 0
        self.phases: list[tuple[list[str], np.ndarray, int, dict[str, int], int]] = []
        while left:
            names = sorted(left)
            own = quanta([scale[q] for q in names], width)
            last = {q: (((left[q] + 1) << FRACTION) - 1) // int(k) for q, k in zip(names, own, strict=True)}
            rounds = min(last.values())
            if rounds == 0:  # less than a quantum is left: these queues end with one short round
                names = [q for q in names if last[q] == 0]
                own = np.array([left[q] << FRACTION for q in names], np.int64)
                rounds = 1
            self.phases.append((names, own, rounds, {q: gone[q] for q in names}, base))
            for q, taken in zip(names, grown(own, np.int64(rounds)).tolist(), strict=True):
                gone[q] += taken
                base += taken
                left[q] -= taken
                if not left[q]:
                    del left[q]
        self.tokens = base

    def place(self, queue: str, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For stretches [begin, begin + size) of a queue: number of the stretch, start in the queue, length, place in the stream."""
        out = []
        for names, own, rounds, gone, base in self.phases:
            if queue not in gone:
                continue
            k = names.index(queue)
            first, q = gone[queue], int(own[k])
            end = first + int(grown(own[k], np.int64(rounds)))
            hit = np.flatnonzero((begin < end) & (begin + size > first) & (end > first))
            if not len(hit):
                continue
            lo, hi = np.maximum(begin[hit], first) - first, np.minimum((begin + size)[hit], end) - first
            from_round = np.array([(((x + 1) << FRACTION) - 1) // q for x in lo.tolist()], np.int64)
            to_round = np.array([((x << FRACTION) - 1) // q for x in hi.tolist()], np.int64)
            # from_round: the last round that starts at or before lo; to_round: the one that holds hi - 1
            many = to_round - from_round + 1
            which = np.repeat(np.arange(len(hit)), many)
            r = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + from_round[which]
            starts, ends = grown(own[k], r), grown(own[k], r + 1)
            a, b = np.maximum(starts, lo[which]), np.minimum(ends, hi[which])
            use = b > a
            a, b, r, starts, which = a[use], b[use], r[use], starts[use], which[use]
            at = base + a - starts
            for t, other in enumerate(own):
                at = at + grown(other, r + 1 if t < k else r)
            out.append((hit[which], first + a, b - a, at))
        if not out:
            return (np.zeros(0, np.int64),) * 4
        return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


TOKENS = "id {id}, queue string, ids binary, n long, part int, before long"


def queue_of(docs: DataFrame, source_col: str, weights: dict[str, float] | None, queues: int) -> tuple[Column, dict[str, float] | None]:
    """The queue of a row, and the queues' weights. With more sources than queues, those without a weight share hash buckets."""
    source = F.coalesce(F.col(source_col).cast("string"), F.lit(""))
    if docs.select(source.alias("s")).distinct().limit(queues + 1).count() <= queues:
        return source, weights
    mark = "#"
    while any(name.startswith(mark) for name in weights or ()):
        mark += "#"
    bucket = F.concat(F.lit(mark), F.pmod(F.xxhash64(source), F.lit(queues)).cast("string"))
    if not weights:
        return bucket, weights
    own = source.isin(list(weights))
    sizes = docs.where(~own).select(source.alias("s"), bucket.alias("q")).distinct().groupBy("q").count().collect()  # a row a bucket
    return F.when(own, source).otherwise(bucket), weights | {r["q"]: r["count"] for r in sizes}  # each source without a weight counts 1


def tokenised(docs: DataFrame, *, id_col: str, text_col: str, queue: Column, tokenizer: str, end_id: int) -> DataFrame:
    """id, queue, ids (compressed), n, and the partition and the queue's tokens before it in the partition."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        squeeze = zstandard.ZstdCompressor(level=1).compress
        seen: dict[str, int] = {}
        for b in joined_batches(batches, 2, SPLIT_AT_ONCE):
            ids, n, before = [], [], []
            for queue, made in zip(b.column(1).to_pylist(), enc.encode(b.column(2)), strict=True):
                before.append(seen.get(queue, 0))
                n.append(len(made) + 1)
                seen[queue] = before[-1] + n[-1]
                ids.append(squeeze(made.tobytes() + end))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([part] * len(n), pa.int32()), pa.array(before, pa.int64())], names=["id", "queue", "ids", "n", "part", "before"])
        enc.forget()
        give_back()

    return docs.select(F.col(id_col).alias("id"), queue.alias("queue"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, TOKENS.format(id=kind))


def pack(
    docs: DataFrame, *, tokenizer: str, end_id: int = 1, width: int = WIDTH,
    weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", queues: int = MAX_QUEUES, with_ids: bool = False,
) -> DataFrame:
    """A row a piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source queue and, if asked for, the ids."""
    queue, weights = queue_of(docs, source_col, weights, queues)
    tokens = checkpoint(tokenised(docs, id_col=id_col, text_col=text_col, queue=queue, tokenizer=tokenizer, end_id=end_id))
    parts = checkpoint(tokens.groupBy("queue", "part").agg(F.sum("n").alias("n")))
    totals = {r["queue"]: r["n"] for r in parts.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # a row a queue
    schedule = Schedule(totals, weights, width)
    order = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    running = parts.select("queue", "part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("base"))
    running = F.broadcast(running) if parts.count() <= BROADCAST_ROWS else running
    wide = pa.binary() if with_ids else None
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue", *(["ids"] if with_ids else [])]

    def run(batches):
        dtype = encoder(tokenizer).dtype
        open_up = zstandard.ZstdDecompressor().decompress
        for b in batches:
            queue, n, begin = b.column(1).to_pylist(), b.column(3).to_numpy(), b.column(4).to_numpy()
            data = [np.frombuffer(open_up(z), dtype).astype("<u4") for z in b.column(2).to_pylist()]
            by: dict[str, list[int]] = {}
            for i, q in enumerate(queue):
                by.setdefault(q, []).append(i)
            rows: list[tuple] = []
            for q, at in by.items():
                rowed = np.array(at)
                which, first, size, place = schedule.place(q, begin[rowed], n[rowed])
                cut = width - place % width
                over = size > cut  # a piece that runs into the next window
                which = np.concatenate((rowed[which], rowed[which[over]]))
                first = np.concatenate((first, (first + cut)[over]))
                place = np.concatenate((place, (place + cut)[over]))
                size = np.concatenate((np.minimum(size, cut), (size - cut)[over]))
                start = first - begin[which]
                rows += zip(which.tolist(), start.tolist(), size.tolist(), place.tolist(), strict=True)
            rows.sort()
            # pieces of a document that follow one another in a window are one
            joined: list[list[int]] = []
            for d, s, k, p in rows:
                if joined and (j := joined[-1])[0] == d and j[3] + j[2] == p and p % width:
                    j[2] += k
                else:
                    joined.append([d, s, k, p])
            views = [memoryview(x).cast("B") for x in data]
            ids = [views[d][4 * s : 4 * (s + k)] for d, s, k, _ in joined]
            take = pa.array([j[0] for j in joined], pa.int64())
            column = lambda values: pa.array(values, pa.int64())
            arrays = [b.column(0).take(take), column([j[1] for j in joined]), column([j[2] for j in joined]), column([zlib.crc32(x) for x in ids]), column([int(n[j[0]]) for j in joined]), column([j[3] // width for j in joined]), column([j[3] % width for j in joined]), b.column(1).take(take)]
            if wide:
                arrays.append(pa.array([bytes(x) for x in ids], wide))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    placed = tokens.join(running, ["queue", "part"]).select("id", "queue", "ids", "n", (F.col("before") + F.col("base")).alias("begin"))
    out = placed.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string" + (", ids binary" if with_ids else ""))
    return out.withColumnRenamed("id", id_col)
