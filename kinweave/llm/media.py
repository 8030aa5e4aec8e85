"""Media columns: copies of images, cropped or edited, by local descriptors.

Corners are found at several scales, the strongest of each cell of CELL by CELL pixels, so that a part of an image has
the corners that it has in the whole. Each gets an orientation (the direction of its patch's intensity centroid) and
BITS binary tests between points of the patch, turned by that orientation. Larger images are first reduced to SIDE
pixels; margins are mirrored, so that corners near them count too.

Descriptors are cut into CHUNKS chunks of 32 bits, the keys of as many Hamming tables. Two images meet if they share
MEET keys and more. A meeting is verified on all corners of both: corners whose nearest
descriptor there differs in NEAR bits at most are matches, and the pair is a link if matches of AGREE corners, and of
SHARE of those of the image with fewer, agree on one shift, turn and scale (geometric consensus). What links connect
is a class. A copy at another size is found if the scales or their ratios (1.5, 2.25) come near it.

Pairs within a bucket of equal keys aren't all made. Each image is held against the bucket's first image; then buckets
of up to SMALL images that hold several classes make the pairs across these. Larger ones, of chunks that many images have
by chance, deal their images out again by two neighbouring chunks, then by four, and make the pairs across classes where
the buckets have become small; of images that share a whole descriptor in a bucket that stays large each is held against
the first. So a pair is verified or connected if it shares MEET chunks in small buckets, or neighbouring chunks
of a descriptor where its chunks are common ones.

A link's descriptors may differ in NEAR bits without a chunk in common, so the classes are then joined by all pairs across
them, block by block: a pair is verified if enough corners of the one have a descriptor within NEAR bits in the other, as any link
needs. Of the image with fewer corners those are left out that a link can spare, down to LEFT it must have. Distances are bounded from below
by projections to AXES axes, and counted where that bound allows NEAR bits. So no link is missed; the cost grows with the square of the different images' corners.

Equal images are one image from the start. Images are PNG (8 bits, not interlaced), PGM and PPM bytes, or arrays of
grey values with a given width.

Cases: null, empty, undecodable and flat images have no corners and are classes of their own (equal ones of the same
bytes are one class, but for null and empty); a null id counts as the smallest and is passed on; rows repeated are
copies; ties go to the smaller id; a very large image takes memory in proportion to its pixels while it is reduced; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint, mix, small_batches
from .exchange import NO_ID, id_of, public_id, starts
from .omh import joined

BITS, CHUNKS = 256, 8
RADIUS, SCALES = 10, (1.0, 1.5, 2.25)
#: Pixels of a cell and corners of each cell and scale; the longer side of an image as it is described.
CELL, PER_CELL, SIDE = 27, 4, 640
#: Differing bits of a match; corners that must agree, and their share of the fewer corners.
NEAR, AGREE, SHARE = 40, 4, 0.25
#: Keys shared before a pair is verified; images of a bucket whose pairs are all made.
MEET, SMALL = 2, 24
#: Bytes of corners and descriptors of a block of images, blocks at least (if there are as many images), axes of the projection.
BLOCK, BLOCKS, AXES = 8_000_000, 12, 48
#: Descriptors of each side whose products are made at once; matches that an image must have without the corners left out.
STRETCH, LEFT = 512, 3
#: Matches tried as the one that the others agree with.
TRIED = 256


# --- images -----------------------------------------------------------------------------------


def png(data: bytes) -> np.ndarray:
    at, header, packed = 8, None, []
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            header = body
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + size
    w, h, depth, colour, interlaced = int.from_bytes(header[:4], "big"), int.from_bytes(header[4:8], "big"), header[8], header[9], header[12]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or interlaced or not channels:
        raise ValueError("a kind of PNG that isn't read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + w * channels)
    out = np.zeros((h + 1, w + 1, channels), np.uint8)
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].reshape(w, channels)
        row, up = out[y + 1], out[y]
        if kind == 0:
            row[1:] = line
        elif kind == 1:
            row[1:] = np.cumsum(line, axis=0, dtype=np.uint64).astype(np.uint8)
        elif kind == 2:
            row[1:] = line + up[1:]
        else:
            for x in range(1, w + 1):
                a, b, c = row[x - 1].astype(int), up[x].astype(int), up[x - 1].astype(int)
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                row[x] = (line[x - 1] + guess) & 255
    return out[1:, 1:].astype(np.float32)


NETPBM = re.compile(rb"P[56]" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s")


def netpbm(data: bytes) -> np.ndarray:
    head = NETPBM.match(data)
    if not head:
        raise ValueError("no header")
    w, h, top = map(int, head.groups())
    channels = 3 if data[:2] == b"P6" else 1
    return np.frombuffer(data, np.uint8, w * h * channels, head.end()).reshape(h, w, channels).astype(np.float32) * (255 / top)


def decode(data: bytes) -> np.ndarray | None:
    """Grey values; None if these aren't bytes of a known image."""
    try:
        pixels = png(data) if data[:4] == b"\x89PNG" else netpbm(data) if data[:2] in (b"P5", b"P6") else None
    except (ValueError, IndexError, TypeError, ZeroDivisionError, zlib.error):
        return None
    if pixels is None or pixels.size == 0:
        return None
    return pixels[..., :3] @ np.array([0.299, 0.587, 0.114], np.float32) if pixels.shape[2] >= 3 else pixels[..., 0]


def resized(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, with the centres of the corner pixels in place."""
    y, x = np.linspace(0, image.shape[0] - 1, h), np.linspace(0, image.shape[1] - 1, w)
    y0, x0 = np.minimum(y.astype(int), max(0, image.shape[0] - 2)), np.minimum(x.astype(int), max(0, image.shape[1] - 2))
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None].astype(np.float32), (x - x0)[None].astype(np.float32)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy) + low * fy


def smooth(image: np.ndarray) -> np.ndarray:
    """A 5 by 5 binomial blur."""
    h, w = image.shape
    p = np.empty((h + 4, w), image.dtype)
    p[2:-2], p[:2], p[-2:] = image, image[:1], image[-1:]
    image = (p[:-4] + p[4:] + 4 * (p[1:-3] + p[3:-1]) + 6 * p[2:-2]) / 16
    p = np.empty((h, w + 4), image.dtype)
    p[:, 2:-2], p[:, :2], p[:, -2:] = image, image[:, :1], image[:, -1:]
    return (p[:, :-4] + p[:, 4:] + 4 * (p[:, 1:-3] + p[:, 3:-1]) + 6 * p[:, 2:-2]) / 16


@functools.lru_cache(maxsize=1)
def pattern() -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points of the tests (pair, end, x and y), evenly over the patch, and the offsets of the round patch."""
    r = np.random.default_rng(5)
    angle, far = r.uniform(0, 2 * np.pi, (BITS, 2)), np.sqrt(r.uniform(0, 1, (BITS, 2))) * RADIUS
    points = np.stack([far * np.cos(angle), far * np.sin(angle)], axis=-1)
    grid = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1)), -1).reshape(-1, 2)
    return points, grid[(grid**2).sum(1) <= RADIUS**2]


def describe(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (x, y, scale, angle) and descriptors (words of 64 bits) of the strongest corners of each cell and scale."""
    tests, patch = pattern()
    corners, words = [], []
    border = RADIUS + 1
    longest = max(image.shape)
    if longest > SIDE:
        image = resized(image, max(2, round(image.shape[0] * SIDE / longest)), max(2, round(image.shape[1] * SIDE / longest)))
    for scale in SCALES:
        h, w = round(image.shape[0] / scale), round(image.shape[1] / scale)
        if min(h, w) <= border:
            break
        im = np.pad(smooth(resized(image, h, w)), border, mode="reflect")
        gy, gx = np.gradient(im)
        xx, yy, xy = smooth(gx * gx), smooth(gy * gy), smooth(gx * gy)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        inner = response[border:-border, border:-border]
        peak = inner > 1e-6 * max(1e-9, float(im.var()) ** 2)
        for dy, dx in ((-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)):
            peak &= inner >= response[border + dy : border + dy + h, border + dx : border + dx + w]
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        strength, cell = inner[y, x], y // CELL * (w // CELL + 1) + x // CELL
        order = np.lexsort((x, y, -strength, cell))
        new = np.concatenate(([True], cell[order][1:] != cell[order][:-1]))
        rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        top = order[rank < PER_CELL]
        y, x = y[top] + border, x[top] + border
        values = im[y[:, None] + patch[:, 1], x[:, None] + patch[:, 0]]
        values = values - values.mean(axis=1, keepdims=True)
        angle = np.arctan2((values * patch[:, 1]).sum(1), (values * patch[:, 0]).sum(1))
        c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = tests[None, ..., 0], tests[None, ..., 1]
        tx, ty = np.rint(c * px - s * py).astype(np.int32), np.rint(s * px + c * py).astype(np.int32)
        sample = im[y[:, None, None] + ty, x[:, None, None] + tx]
        words.append(np.packbits(sample[..., 0] < sample[..., 1], axis=1).view(np.uint64))
        at = np.stack([(x - border) * (image.shape[1] - 1) / max(1, w - 1), (y - border) * (image.shape[0] - 1) / max(1, h - 1)], axis=1)
        corners.append(np.concatenate([at, np.full((len(x), 1), scale), angle[:, None]], axis=1))
    if not corners:
        return np.zeros((0, 4), np.float32), np.zeros((0, BITS // 64), np.uint64)
    return np.concatenate(corners).astype(np.float32), np.concatenate(words)


def matched(a: np.ndarray, b: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Descriptors of a with their nearest of b, where at most `near` bits differ; of several with one nearest, the closest."""
    best, far = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    rows = max(1, 1_000_000 // max(1, len(b)))
    for lo in range(0, len(a), rows):
        differing = np.bitwise_count(a[lo : lo + rows, None] ^ b[None]).sum(axis=2, dtype=np.int64)
        best[lo : lo + rows] = differing.argmin(axis=1)
        far[lo : lo + rows] = differing.min(axis=1)
    order = np.lexsort((far, best))
    first = np.concatenate(([True], best[order][1:] != best[order][:-1]))
    use = np.sort(order[first & (far[order] <= near)])
    return use, best[use]


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches that agree with one of them on turn, scale and shift. Rows: x, y, scale, angle here and there."""
    scale, turn = b[:, 2] / a[:, 2], b[:, 3] - a[:, 3]
    c, s = np.cos(turn) * scale, np.sin(turn) * scale
    best = 0
    for i in np.unique(np.linspace(0, len(a) - 1, min(len(a), TRIED)).astype(int)):
        dx, dy = a[:, 0] - a[i, 0], a[:, 1] - a[i, 1]
        off = np.hypot(b[i, 0] + c[i] * dx - s[i] * dy - b[:, 0], b[i, 1] + s[i] * dx + c[i] * dy - b[:, 1])
        angle = np.abs((turn - turn[i] + np.pi) % (2 * np.pi) - np.pi)
        fit = (off <= 3 * b[:, 2] + 0.05 * np.hypot(dx, dy)) & (angle <= 0.35) & (np.abs(np.log2(scale / scale[i])) <= 0.6)
        best = max(best, int(fit.sum()))
    return best


def copies(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray], near: int = NEAR, agree: int = AGREE, share: float = SHARE) -> bool:
    """Whether two images, by corners and descriptors, are a link."""
    order = lambda z: (len(z[1]), z[1].tobytes())  # noqa: E731  the same answer whichever comes first
    (a, v), (b, w) = (x, y) if order(x) <= order(y) else (y, x)
    need = max(agree, share * len(v))
    if not len(v):
        return False
    i, j = matched(v, w, near)
    return len(i) >= need and agreeing(a[i], b[j]) >= need


# --- over a table -----------------------------------------------------------------------------


def digest(value) -> bytes | None:
    if value is None or len(value) == 0:
        return None
    return hashlib.blake2b(value if isinstance(value, bytes) else np.asarray(value, np.float32).tobytes(), digest_size=16).digest()


def pixels(value, width: int | None, enlarged: int) -> np.ndarray | None:
    """Grey values from 0 to 255 of an image's bytes, or of an array with that width, enlarged so many times."""
    if isinstance(value, bytes):
        return decode(value)
    flat = np.nan_to_num(np.asarray([0 if v is None else v for v in value], np.float32))
    if not width or len(flat) % width:
        return None
    image = flat.reshape(-1, width)
    low, high = float(image.min()), float(image.max())
    if high <= low:
        return None
    return resized((image - low) * (255 / (high - low)), image.shape[0] * enlarged, image.shape[1] * enlarged)


def images_of(narrow: DataFrame, width: int | None, enlarged: int) -> DataFrame:
    """item (a number), image, corners and words (as bytes) of each different image that has corners."""

    def corners(batches):
        for b in batches:
            out: list[tuple] = []
            for v in b.column(0).to_pylist():
                image = digest(v)
                grey = pixels(v, width, enlarged) if image else None
                if grey is not None:
                    found, words = describe(grey)
                    if len(words):
                        out.append((image, found.tobytes(), words.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.binary()) for i in range(3)], names=["image", "corners", "words"])

    made = narrow.select("media").mapInArrow(corners, "image binary, corners binary, words binary")
    made = made.groupBy("image").agg(F.min("corners").alias("corners"), F.min("words").alias("words"))
    return checkpoint(made.select(F.monotonically_increasing_id().alias("item"), "image", "corners", "words"))


def chunk_keys(words: np.ndarray, width: int) -> np.ndarray:
    """Keys of `width` neighbouring chunks from each chunk on (columns) of descriptors (rows); the last goes on with the first."""
    chunk = words.view(np.uint32).reshape(-1, CHUNKS).astype(np.uint64)
    place = np.arange(CHUNKS, dtype=np.uint64)
    if width == 1:
        return chunk * np.uint64(CHUNKS) + place
    key = np.broadcast_to(place, chunk.shape).copy()
    for k in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.roll(chunk, -k, axis=1))
    return key


def keys_of(described: DataFrame) -> DataFrame:
    """key, item: each different chunk of an image's descriptors, with its place in the descriptor."""

    def run(batches):
        for b in batches:
            keys, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for i, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                keys.append(np.unique(chunk_keys(np.frombuffer(w, np.uint64), 1)))
                items.append(np.full(len(keys[-1]), i, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(items))], names=["key", "item"])

    return described.select("item", "words").mapInArrow(run, "key long, item long")


def wider_keys(held: DataFrame, described: DataFrame, width: int) -> DataFrame:
    """held: key (of half the width), item, label. key, item, label: of twice as many chunks, from where these keys stand."""

    def run(batches):
        for b in batches:
            keys, many = [np.zeros(0, np.uint64)], []
            for own, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                words = np.frombuffer(w, np.uint64)
                here = np.isin(chunk_keys(words, width // 2), np.array(own, np.int64).view(np.uint64))
                keys.append(np.unique(chunk_keys(words, width)[here]))
                many.append(len(keys[-1]))
            take = pa.array(np.repeat(np.arange(len(many)), many), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), b.column(0).take(take), b.column(1).take(take)], names=["key", "item", "label"])

    of = held.groupBy("item", "label").agg(F.collect_set("key").alias("keys"))  # an image's own keys
    return of.join(described.select("item", "words"), "item").select("item", "label", "keys", "words").mapInArrow(run, "key long, item long, label long")


def near_pairs(v: np.ndarray, w: np.ndarray, near: int, start: np.ndarray | None = None):
    """Stretches of v with the places (i, j) of all pairs of descriptors that differ in at most `near` bits: (first, end, i, j).

    start: the place in w from which on pairs are wanted, for each place in v, ascending.
    """
    signs = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, BITS // 8), axis=1).astype(np.float32) * 2 - 1
    sample = signs(w[:: max(1, len(w) // 10_000)])
    axes = np.linalg.eigh((sample.T @ sample).astype(np.float64))[1][:, 1 - AXES :].astype(np.float32)  # any axes give a bound, these a good one

    def low(x: np.ndarray) -> np.ndarray:
        """Coordinates on the axes and the length of what is left: a product of two is at least that of the signs."""
        out = np.empty((len(x), AXES), np.float32)
        for k in range(0, len(x), 10_000):
            own = signs(x[k : k + 10_000]) @ axes
            out[k : k + 10_000, :-1] = own
            out[k : k + 10_000, -1] = np.sqrt(np.maximum(0, BITS - (own * own).sum(axis=1)))
        return out

    left, right = low(v), low(w)
    pad = -len(w) % STRETCH  # zeros: never near
    right = np.concatenate([right, np.zeros((pad, AXES), np.float32)]).reshape(-1, STRETCH, AXES)
    right = [np.ascontiguousarray(x.T) for x in right]
    product, flags = np.empty((STRETCH, STRETCH), np.float32), np.empty((STRETCH, STRETCH), bool)
    for lo in range(0, len(v), STRETCH):
        end = min(len(v), lo + STRETCH)
        own, here = left[lo:end], v[lo:end]
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0 if start is None else int(start[lo]) // STRETCH, len(right)):
            np.matmul(own, right[k], out=product[: end - lo])
            np.greater_equal(product[: end - lo], BITS - 2 * near - 0.25, out=flags[: end - lo])  # with room for rounding
            may = flags[: end - lo].reshape(-1)
            some = np.flatnonzero(may.view(np.uint64))
            if not len(some):
                continue
            place = np.flatnonzero(may.reshape(-1, 8)[some])
            place = (some[place >> 3] << 3) + (place & 7)
            i, j = place // STRETCH, place % STRETCH
            bits = np.bitwise_count(here.take(i, axis=0) ^ w[k * STRETCH : (k + 1) * STRETCH].take(j, axis=0)).view(np.uint16)
            bits = bits[:, 0] + bits[:, 1]  # two sums of up to 128
            use = np.flatnonzero((bits >> 8) + (bits & 255) <= near)
            rows.append(i[use] + lo)
            columns.append(j[use] + k * STRETCH)
        yield lo, end, np.concatenate(rows), np.concatenate(columns)


def block_links(items: list[int], labels: list[int], ours: list[tuple], mine: np.ndarray, others: np.ndarray, near: int, agree: int, share: float) -> list[tuple[int, int]]:
    """Links that connect different classes among images (mine) and others, by places in the lists, each pair once.

    None of mine has more corners than one of the others; if both are the same, they stand by number of corners.
    """
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while root.get(x, x) != x:
            x = root[x]
        return x

    many = np.array([len(w) for _, w in ours], np.int64)
    label = np.array(labels)
    found = []
    if not len(mine) or not len(others):
        return found
    same = mine is others
    # of the corners that a link needs all but LEFT may be among those left out
    need = np.maximum(agree, np.ceil(share * many[mine] - 1e-9).astype(np.int64))
    out = np.maximum(0, need - LEFT)
    need = need - out
    of, to = np.repeat(np.arange(len(mine)), np.maximum(0, many[mine] - out)), np.repeat(np.arange(len(others)), many[others])
    joined = lambda at, skip: np.concatenate([np.zeros((0, BITS // 64), np.uint64), *(ours[k][1][n:] for k, n in zip(at, skip, strict=True))])
    if not len(of) or not len(to):
        return found
    left = np.zeros((0, len(others)), np.int32)  # counts of the image that goes on in the next stretch
    for lo, end, i, j in near_pairs(joined(mine, out), joined(others, np.zeros(len(others), np.int64)), near, starts(many[others])[of] if same else None):
        first, last = int(of[lo]), int(of[end - 1])
        counts = np.zeros((last - first + 1, len(others)), np.int32)
        counts[: len(left)] += left
        seen = np.unique(i * len(others) + to[j])  # a corner counts once for an image
        np.add.at(counts, (of[seen // len(others)] - first, seen % len(others)), 1)
        whole = end == len(of) or of[end] != last
        left = counts[:0] if whole else counts[-1:]
        done = counts if whole else counts[:-1]
        m = mine[first : first + len(done)]
        enough = (done >= need[first : first + len(done), None]) & (label[m][:, None] != label[others][None])
        for p, q in np.argwhere(enough).tolist():
            x, y = int(m[p]), int(others[q])
            if (not same or q > first + p) and top(labels[x]) != top(labels[y]) and copies(ours[x], ours[y], near, agree, share):
                root[top(labels[x])] = top(labels[y])
                found.append((items[x], items[y]))
    return found


def all_links(described: DataFrame, found: DataFrame, near: int, agree: int, share: float, block: int = BLOCK) -> DataFrame:
    """Links that connect classes which the links found leave apart: all pairs, a task a pair of blocks."""
    size = described.agg(F.sum(F.length("corners") + F.length("words")).alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    n = max(1, -(-(size["bytes"] or 0) // block), min(BLOCKS, size["n"] // 50))
    label = joined(found, None, "item", "long")
    # blocks by number of corners, so that it is known which of two images has fewer
    described = described.withColumn("many", F.length("words"))
    ranks, before = [], 0
    for r in sorted(described.groupBy("many").count().collect()):  # as many rows as there are numbers of corners
        ranks.append((r["many"], before / max(1, size["n"]), r["count"] / max(1, size["n"])))
        before += r["count"]
    ranks = F.broadcast(described.sparkSession.createDataFrame(ranks, "many int, first double, part double"))
    even = F.pmod(F.xxhash64("item"), F.lit(1 << 20)) / (1 << 20)
    own = F.least(F.floor((F.col("first") + F.col("part") * even) * n), F.lit(n - 1))
    held = described.join(ranks, "many").join(label, "item", "left").select("item", F.coalesce("label", "item").alias("label"), "corners", "words", own.alias("block"))
    of = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other")
    pair = (F.least("block", "other") * n + F.greatest("block", "other")).alias("pair")
    dealt = held.select("*", of).select("item", "label", "corners", "words", "block", pair)

    def run(table: pa.Table) -> pa.Table:
        at = table.column("pair")[0].as_py()
        block = table.column("block").to_numpy()
        read = lambda name, kind, width: [np.frombuffer(x, kind).reshape(-1, width) for x in table.column(name).to_pylist()]
        ours = list(zip(read("corners", np.float32, 4), read("words", np.uint64, BITS // 64), strict=True))
        order = np.argsort([len(w) for _, w in ours], kind="stable")
        mine, others = (order[block[order] == k] for k in (at // n, at % n))
        if at // n == at % n:
            others = mine
        kept = block_links(table.column("item").to_pylist(), table.column("label").to_pylist(), ours, mine, others, near, agree, share)
        return pa.table({"a": pa.array([p[0] for p in kept], pa.int64()), "b": pa.array([p[1] for p in kept], pa.int64())})

    return checkpoint(dealt.repartitionByRange(n * (n + 1) // 2, "pair").groupBy("pair").applyInArrow(run, "a long, b long"))


def image_copies(
    images: DataFrame, *, id_col: str, media_col: str, width: int | None = None, enlarged: int = 1,
    near: int = NEAR, agree: int = AGREE, share: float = SHARE, meet: int = MEET, small: int = SMALL,
) -> DataFrame:
    """A row a row: id, class_id (the smallest id among its copies, edited ones too) and class_size (rows of the class)."""
    small_batches(images.sparkSession)
    kind = images.schema[media_col].dataType
    value = F.col(media_col) if isinstance(kind, (T.BinaryType, T.ArrayType)) else F.col(media_col).cast("binary")

    def prints(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest(v) for v in b.column(1).to_pylist()], pa.binary())], names=["id", "image"])

    narrow = images.select(id_of(id_col).alias("id"), value.alias("media"))
    rows = checkpoint(narrow.mapInArrow(prints, "id long, image binary"))
    described = images_of(narrow, width, enlarged)
    entries = checkpoint(keys_of(described))

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b) of items."""

        def run(batches):
            for batch in batches:
                kept = []
                x, y, *parts = (batch.column(i).to_pylist() for i in range(6))
                for k, (ca, wa, cb, wb) in enumerate(zip(*parts, strict=True)):
                    of = lambda c, w: (np.frombuffer(c, np.float32).reshape(-1, 4), np.frombuffer(w, np.uint64).reshape(-1, BITS // 64))
                    if copies(of(ca, wa), of(cb, wb), near, agree, share):
                        kept.append((x[k], y[k]))
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in kept], pa.int64()) for i in range(2)], names=["a", "b"])

        side = lambda s: described.select(F.col("item").alias(s), F.col("corners").alias("c" + s), F.col("words").alias("w" + s))
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ca", "wa", "cb", "wb")
        return checkpoint(both.mapInArrow(run, "a long, b long"))

    def often(pairs: DataFrame, least: int) -> DataFrame:
        """Different pairs that come `least` times."""
        return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b")

    # each image against the first one of its buckets
    hubs = entries.groupBy("key").agg(F.min("item").alias("hub"), F.max("item").alias("last"), F.count(F.lit(1)).alias("size")).where("hub < last")
    entries = checkpoint(entries.join(hubs.select("key", "hub", "size"), "key"))
    found = verified(often(entries.where("item <> hub").select(F.col("hub").alias("a"), F.col("item").alias("b")), meet))

    def mixed(held: DataFrame, links: DataFrame) -> DataFrame:
        """held (key, item and others) with the items' classes: the buckets that hold several."""
        label = joined(links, 2, "item", "long")  # whole stars; what is joined further only costs pairs
        classed = held.join(label, "item", "left").withColumn("label", F.coalesce("label", "item"))
        several = classed.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 <> l2").select("key")
        return checkpoint(classed.join(several, "key", "left_semi"))

    def across(held: DataFrame) -> DataFrame:
        other = held.select("key", F.col("item").alias("b"), F.col("label").alias("lb"))
        return held.select("key", F.col("item").alias("a"), "label").join(other, "key").where("a < b and label <> lb").select("a", "b")

    # pairs across classes in small buckets
    classed = mixed(entries.select("key", "item", "size"), found)
    found = checkpoint(found.union(verified(often(across(classed.where(F.col("size") <= small)), meet))))
    # images of large buckets by more chunks
    large, width = entries.where(F.col("size") > small).select("key", "item"), 1
    while width < CHUNKS:
        held = mixed(large, found)
        if held.isEmpty():
            break
        width *= 2
        wider = checkpoint(wider_keys(held.select("key", "item", "label"), described, width))
        sizes = wider.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.min("item").alias("hub"), F.count(F.lit(1)).alias("size")).where("l1 <> l2")
        wider = checkpoint(wider.join(sizes.select("key", "hub", "size"), "key"))
        pairs = across(wider.where(F.col("size") <= small))
        large = wider.where(F.col("size") > small)
        if width == CHUNKS:  # the same descriptor
            pairs = pairs.union(large.where("item <> hub").select(F.col("hub").alias("a"), F.col("item").alias("b")))
        large = large.select("key", "item")
        found = checkpoint(found.union(verified(often(pairs, 1))))

    found = checkpoint(found.union(all_links(described, found, near, agree, share)))

    label = joined(found, None, "item", "long")
    classes = described.select("item", "image").join(label, "item", "left").select("image", F.coalesce("label", "item").alias("label"))
    own = rows.where("image is not null").groupBy("image").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    # images without corners have no item: their bytes are their class
    classed = own.join(classes, "image", "left").withColumn("class", F.coalesce(F.col("label").cast("string").cast("binary"), F.concat(F.lit(b"="), "image")))
    least = classed.groupBy("class").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"))
    by_image = classed.join(least, "class").select("image", "class_id", "class_size")
    alone = rows.where("image is null").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    out = rows.where("image is not null").join(by_image, "image").select("id", "class_id", "class_size").union(alone)
    return out.select(public_id().alias(id_col), F.when(F.col("class_id") != NO_ID, F.col("class_id")).alias("class_id"), "class_size")
