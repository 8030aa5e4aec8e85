import struct
import zlib

import numpy as np

from kinweave.llm import media


def picture(seed, h=96, w=120):
    r = np.random.default_rng(seed)
    image = np.full((h, w), 120.0)
    for _ in range(40):
        y, x = r.integers(0, h - 8), r.integers(0, w - 8)
        image[y : y + r.integers(4, 30), x : x + r.integers(4, 30)] = r.integers(0, 255)
    return image


def pgm(image):
    return b"P5 %d %d 255\n" % image.shape[::-1] + np.clip(image, 0, 255).astype(np.uint8).tobytes()


def png(image, kind=0):
    image = np.clip(image, 0, 255).astype(np.uint8)
    before = np.zeros_like(image)
    if kind == 1:
        before[:, 1:] = image[:, :-1]
    elif kind == 2:
        before[1:] = image[:-1]
    elif kind == 3:
        a, b = np.zeros(image.shape, int), np.zeros(image.shape, int)
        a[:, 1:], b[1:] = image[:, :-1], image[:-1]
        before = ((a + b) // 2).astype(np.uint8)
    rows = b"".join(bytes([kind]) + r.tobytes() for r in image - before)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_decoders():
    image = picture(1)
    for kind in range(4):
        assert (media.decode(png(image, kind)) == np.clip(image, 0, 255).astype(np.uint8)).all()
    assert (media.decode(pgm(image)) == np.clip(image, 0, 255).astype(np.uint8)).all()
    assert media.decode(b"P5 3") is None and media.decode(b"GIF89a") is None and media.decode(b"\x89PNG") is None


def test_copies(spark):
    r = np.random.default_rng(0)
    rows = []
    for k in range(8):
        p = picture(k)
        rows += [(10 * k, pgm(p)), (10 * k + 1, png(p)), (10 * k + 2, pgm(p[10:, 14:])), (10 * k + 3, pgm(p * 0.8 + 20)), (10 * k + 4, pgm(np.rot90(p))), (10 * k + 5, pgm(p + r.normal(0, 2, p.shape)))]
    rows += [(200, None), (201, b""), (202, b"junk"), (203, b"junk"), (204, pgm(np.full((50, 50), 9.0))), (None, pgm(picture(99))), rows[0]]
    rows += [(300 + k, pgm(picture(500 + k))) for k in range(20)]
    got = media.image_copies(spark.createDataFrame(rows, "image_id long, media binary").repartition(3), id_col="image_id", media_col="media").collect()
    assert len(got) == len(rows)
    classes = {x["image_id"]: x["class_id"] for x in got}
    for k in range(8):
        assert [classes[10 * k + j] for j in range(6)] == [10 * k] * 6
    assert all(classes[i] == i for i in (200, 201, 202, 204, None, *range(300, 320))) and classes[203] == 202


def test_arrays(spark):
    r = np.random.default_rng(3)
    rows = [(i, r.normal(0, 1, 64).tolist()) for i in range(60)]
    rows += [(100 + i, (np.array(rows[i][1]) + r.normal(0, 0.01, 64)).tolist()) for i in range(20)] + [(500, [1.0] * 64), (501, []), (502, None), (503, [1.0, None])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {x["vec_id"]: x["class_id"] for x in media.image_copies(frame, id_col="vec_id", media_col="embedding", width=8, enlarged=4).collect()}
    assert all(got[i] == i for i in [*range(60), 500, 501, 502, 503])
    assert all(got[100 + i] == i for i in range(20))


def classes_by_all_pairs(described):
    root = {i: i for i in described}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(described)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if top(i) != top(j) and media.copies(described[j], described[i]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return {i: top(i) for i in ids}


def test_recall_against_all_pairs(spark):
    """Groups of very many copies, hot chunks (all tiles share a part) and small buckets, so that each way of meeting is used."""
    r = np.random.default_rng(8)
    rows, part = [], r.normal(0, 1, (8, 3))
    for i in range(120):
        tile = r.normal(0, 1, (8, 8))
        if i % 2:
            tile[:, :3] = part
        rows.append((i, tile.ravel()))
    rows += [(1000 + i, rows[i % 20][1] + r.normal(0, 0.01 + 0.05 * (i % 3), 64)) for i in range(120)]
    rows += [(2000 + i, rows[5][1] + r.normal(0, 0.02, 64)) for i in range(120)]
    described = {i: media.describe(media.pixels(v.astype(np.float32).tolist(), 8, 4)) for i, v in rows}
    want = classes_by_all_pairs(described)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>")
    got = {}
    for small in (2, media.SMALL):
        found = media.image_copies(frame.repartition(3), id_col="vec_id", media_col="embedding", width=8, enlarged=4, small=small).collect()
        got[small] = {x["vec_id"]: x["class_id"] for x in found}
    joined = [i for i in want if want[i] != i]
    assert len(joined) > 200
    for found in got.values():
        assert all(want[found[i]] == want[i] for i in want)  # nothing joined that all pairs leave apart
        assert sum(found[i] == want[i] for i in joined) >= 0.97 * len(joined)


def test_crops_of_large_pictures(spark):
    rows = []
    for k in range(4):
        p = picture(k, 400, 500)
        for y, x in r_places(k):
            rows_ = p[y : y + 12 + 5 * k, x : x + 30]
            p[y : y + rows_.shape[0], x : x + rows_.shape[1]] = (y * x) % 255
        rows += [(10 * k, pgm(p)), (10 * k + 1, png(p[100:300, 120:370])), (10 * k + 2, pgm(p[150:290, 200:380] * 0.9 + 9)), (10 * k + 3, pgm(media.resized(p, 267, 333)))]
    got = {x["id"]: x["class_id"] for x in media.image_copies(spark.createDataFrame(rows, "id long, media binary"), id_col="id", media_col="media").collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}


def r_places(seed):
    r = np.random.default_rng(seed)
    return zip(r.integers(0, 380, 400).tolist(), r.integers(0, 470, 400).tolist(), strict=True)


def test_empty(spark):
    assert media.image_copies(spark.createDataFrame([], "vec_id long, embedding array<float>"), id_col="vec_id", media_col="embedding", width=8, enlarged=4).count() == 0


def test_links_without_a_common_chunk(spark):
    """Copies whose descriptors are all changed in each chunk, by NEAR bits in all: no key is shared."""
    r = np.random.default_rng(2)
    described, rows = [], []
    for k in range(30):
        words = r.integers(0, 2**63, (24, 4), dtype=np.uint64)
        corners = np.stack([*r.uniform(0, 100, (2, 24)), np.ones(24), np.zeros(24)], axis=1).astype(np.float32)
        off = np.full((24, 4), 0b11111 | 0b11111 << 32, np.uint64) << r.integers(0, 20, (24, 4), dtype=np.uint64)
        described += [(corners, words), (corners, words ^ off)]
        if k % 3 == 0:  # one bit more is no copy
            described.append((corners, words ^ off ^ np.uint64(1 << 31)))
    rows = [(i, bytes([i]), c.tobytes(), w.tobytes()) for i, (c, w) in enumerate(described)]
    frame = spark.createDataFrame(rows, "item long, image binary, corners binary, words binary")
    none = spark.createDataFrame([], "a long, b long")
    every = [(i, j) for i in range(len(rows)) for j in range(i) if media.copies(described[i], described[j])]
    assert len(every) == 30 + 10 and not any(np.intersect1d(*(media.chunk_keys(described[x][1], 1) for x in p)).size for p in every if rows[p[0]][0] < 2)
    want = classes_by_all_pairs(dict(enumerate(described)))
    for block in (media.BLOCK, 4000):
        root = {i: i for i in range(len(rows))}
        for a, b in media.all_links(frame, none, media.NEAR, media.AGREE, media.SHARE, block).collect():
            x, y = root[a], root[b]
            root = {i: min(x, y) if t in (x, y) else t for i, t in root.items()}
        assert root == want


def test_noisy_tiles_against_all_pairs(spark):
    """Copies at the edge of the rule: what the tables of chunks miss is found."""
    r = np.random.default_rng(6)
    rows = [r.normal(0, 1, 64) for _ in range(100)]
    rows += [rows[i % 100] + r.normal(0, 0.1 + 0.05 * (i % 5), 64) for i in range(200)]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)]
    want = classes_by_all_pairs({i: media.describe(media.pixels(v, 8, 4)) for i, v in rows})
    got = media.image_copies(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), id_col="vec_id", media_col="embedding", width=8, enlarged=4).collect()
    assert {x["vec_id"]: x["class_id"] for x in got} == want


def test_near_pairs():
    """All pairs within NEAR bits, and no others, at sizes around a stretch and from any place on."""
    r = np.random.default_rng(4)
    for n, m in ((1, 1), (511, 513), (700, 1300)):
        w = r.integers(0, 2**63, (m, 4), dtype=np.uint64)
        flips = np.packbits(r.random((n, 256)) < r.uniform(0.1, 0.2, (n, 1)), axis=1).view(np.uint64)
        v = w[r.integers(0, m, n)] ^ flips
        want = {(i, j) for i, j in np.argwhere(np.bitwise_count(v[:, None] ^ w[None]).sum(axis=2, dtype=int) <= media.NEAR).tolist()}
        start = np.sort(r.integers(0, m, n))
        for s in (None, start):
            got = [x for _, _, i, j in media.near_pairs(v, w, media.NEAR, s) for x in zip(i.tolist(), j.tolist(), strict=True)]
            wanted = want if s is None else {x for x in want if x[1] >= s[x[0]]}
            assert len(set(got)) == len(got) and wanted <= set(got) <= want
    assert want


def test_blocks_compare_each_pair_once(monkeypatch):
    """Corners that a link needs may be among those left out, and a block holds each pair once."""
    compared = []
    near_pairs = media.near_pairs

    def counted(v, w, near, start=None):
        for lo, end, i, j in near_pairs(v, w, near, start):
            compared.append((end - lo) * (len(w) - (0 if start is None else int(start[lo]) // media.STRETCH * media.STRETCH)))
            yield lo, end, i, j

    monkeypatch.setattr(media, "near_pairs", counted)
    r = np.random.default_rng(7)
    ours = []
    for n in sorted(r.integers(4, 40, 160).tolist()):
        corners = np.stack([*r.uniform(0, 100, (2, n)), np.ones(n), np.zeros(n)], axis=1).astype(np.float32)
        ours.append((corners, r.integers(0, 2**63, (n, 4), dtype=np.uint64)))
    for k in range(40):  # the first corners and no more than needed are alike
        (a, v), (b, w) = ours[k * 3], ours[k * 3 + 2]
        need = int(max(media.AGREE, np.ceil(media.SHARE * len(v))))
        b[:need], w[:need] = a[:need], v[:need]
    want = {(i, j) for i in range(160) for j in range(i + 1, 160) if media.copies(ours[i], ours[j])}
    every, items = np.arange(160), list(range(160))
    assert len(want) >= 35
    got = media.block_links(items, items, ours, every, every, media.NEAR, media.AGREE, media.SHARE)
    assert {tuple(sorted(p)) for p in got} == want
    n = sum(len(w) for _, w in ours)
    assert sum(compared) < 0.85 * n * n
    got += media.block_links(items, items, ours, every[:70], every[70:], media.NEAR, media.AGREE, media.SHARE)
    assert {tuple(sorted(p)) for p in got} == want
