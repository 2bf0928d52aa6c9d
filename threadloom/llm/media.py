"""Copies among image columns, cropped or edited ones too, by local descriptors."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm._store import connected_components, written
from threadloom.llm._words import mix
from threadloom.llm.minhash import link_buckets, pivot_links

_STEP = 0.75
_PATCH, _BITS = 12, 128
_SMALLEST = 28
_rng = np.random.default_rng(20)
_angle, _far = _rng.random((2, _BITS, 2)) * np.array([2 * np.pi, 1])[:, None, None]
#: Pairs of places in a patch whose brightness is compared: even over its disc, so that the whole patch tells corners apart.
_TESTS = np.stack([np.cos(_angle), np.sin(_angle)], axis=-1) * np.sqrt(_far)[:, :, None] * (_PATCH - 2)
_RING = np.array([(y, x) for y in range(-6, 7) for x in range(-6, 7) if y * y + x * x <= 36])


# -- decoding -----------------------------------------------------------------


def decode_image(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM, or of an 8-bit PNG without interlace; None for anything else."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, KeyError, struct.error, zlib.error):  # what truncated or contradictory data leads to
        return None
    return None


def _netpbm(data: bytes) -> np.ndarray:
    head, at = [], 2
    while len(head) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        head.append(int(data[at:end]))  # an error without digits, at the end of the data too
        at = end
    w, h, most = head
    n = 3 if data[:2] == b"P6" else 1
    if most > 255 or w < 1 or h < 1 or not data[at : at + 1].isspace() or len(data) - at - 1 < w * h * n:
        raise ValueError("only whole 8-bit images")
    return _grey(np.frombuffer(data, np.uint8, w * h * n, at + 1).reshape(h, w, n))


def _png(data: bytes) -> np.ndarray:
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data[at + 8 : at + 21])
        elif kind == b"IDAT":
            body.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    n = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlace or w < 1 or h < 1:
        raise ValueError("only 8-bit images without interlace")
    packed, size = b"".join(body), h * (1 + w * n)
    if size > 1100 * len(packed):  # deflate makes no more of it than about 1,030 times
        raise ValueError("too little data")
    raw = np.frombuffer(zlib.decompressobj().decompress(packed, size), np.uint8).reshape(h, 1 + w * n)
    out = np.zeros((h + 1, (w + 1) * n), np.int64)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].astype(np.int64)
        up = out[y, n:]
        if kind == 0:
            out[y + 1, n:] = line
        elif kind == 2:
            out[y + 1, n:] = (line + up) & 255
        elif kind == 1:
            out[y + 1, n:] = (np.cumsum(line.reshape(w, n), axis=0) & 255).ravel()
        else:
            row, above = out[y + 1], out[y]
            for x in range(n, n + w * n):
                a, b, c = row[x - n], above[x], above[x - n]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    p = a + b - c
                    pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                row[x] = (line[x - n] + guess) & 255
    img = out[1:, n:].reshape(h, w, n)
    return _grey(img[:, :, :3] if n >= 3 else img[:, :, :1])


def _grey(img: np.ndarray) -> np.ndarray:
    return (img.astype(np.float32) @ np.array([0.299, 0.587, 0.114], np.float32)) if img.shape[2] == 3 else img[:, :, 0].astype(np.float32)


# -- features -----------------------------------------------------------------


def _resize(img: np.ndarray, h: int, w: int) -> np.ndarray:
    y = np.clip((np.arange(h) + 0.5) * img.shape[0] / h - 0.5, 0, img.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * img.shape[1] / w - 0.5, 0, img.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, img.shape[0] - 1), np.minimum(x0 + 1, img.shape[1] - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    return (img[y0][:, x0] * (1 - fy) + img[y1][:, x0] * fy) * (1 - fx) + (img[y0][:, x1] * (1 - fy) + img[y1][:, x1] * fy) * fx


def _smooth(img: np.ndarray) -> np.ndarray:
    p = np.pad(img, 2, mode="edge")
    k = np.array([1, 4, 6, 4, 1]) / 16
    rows = sum(k[i] * p[i : i + img.shape[0]] for i in range(5))
    return sum(k[i] * rows[:, i : i + img.shape[1]] for i in range(5))


def describe(img: np.ndarray, corners: int | None = None) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    """Keypoints (y, x, scale, angle) in the image's own pixels, their descriptors (128 bits as 16 bytes), and the image's height and width.

    Corners are all local maxima of the structure tensor's weaker response above a threshold, on the image as it is and
    on smaller ones whose shorter side has fixed lengths, each a third longer than the one before, from where the patch
    fits: a copy of another size has the same levels below its own, a crop the image as it is. ``corners`` keeps only so many of
    the strongest. The patch around each is turned to its brightness centroid before pairs of places are compared.
    """
    found, maps, side = [], [], min(img.shape)
    sides, k = [], 0
    while (fixed := _SMALLEST / _STEP**k) <= 0.95 * side:
        sides.append(fixed)
        k += 1
    level = img
    for fixed in [side, *reversed(sides)] if side >= _SMALLEST else []:
        scale = fixed / side
        h, w = int(round(img.shape[0] * scale)), int(round(img.shape[1] * scale))
        level = _resize(level, h, w) if scale != 1 else img  # from the level before, so that fine detail averages out
        s = _smooth(level)
        gy, gx = np.gradient(s)
        a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
        r = a * b - c * c - 0.05 * (a + b) ** 2
        p = np.pad(r, 1, constant_values=-np.inf)
        peak = np.ones_like(r, bool)
        for dy in range(3):
            for dx in range(3):
                if (dy, dx) != (1, 1):
                    peak &= r >= p[dy : dy + h, dx : dx + w] if (dy, dx) < (1, 1) else r > p[dy : dy + h, dx : dx + w]
        m = _PATCH
        peak[:m] = peak[-m:] = False
        peak[:, :m] = peak[:, -m:] = False
        y, x = np.nonzero(peak & (r > 1.0))
        found.append((r[y, x], y, x, np.full(len(y), scale), np.full(len(y), len(maps))))
        maps.append(_smooth(s))
    if not found:
        return np.zeros((0, 4), np.float32), np.zeros((0, _BITS // 8), np.uint8), img.shape
    power, y, x, scale, which = (np.concatenate(c) for c in zip(*found, strict=True))
    best = np.lexsort((x, y, scale, -power))[:corners]
    points, codes = np.empty((len(best), 4), np.float32), np.empty((len(best), _BITS // 8), np.uint8)
    for k, s in enumerate(maps):
        mine = np.flatnonzero(which[best] == k)
        cy, cx, own = y[best[mine]], x[best[mine]], scale[best[mine]]
        ring = s[cy[:, None] + _RING[:, 0], cx[:, None] + _RING[:, 1]]
        ring = ring - ring.mean(axis=1, keepdims=True)
        angle = np.arctan2(ring @ _RING[:, 0], ring @ _RING[:, 1])
        cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        ty = cy[:, None, None] + _TESTS[:, :, 1] * cos + _TESTS[:, :, 0] * sin
        tx = cx[:, None, None] + _TESTS[:, :, 0] * cos - _TESTS[:, :, 1] * sin
        v = s[np.clip(np.rint(ty).astype(int), 0, s.shape[0] - 1), np.clip(np.rint(tx).astype(int), 0, s.shape[1] - 1)]
        codes[mine] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)
        points[mine] = np.column_stack([(cy + 0.5) / own, (cx + 0.5) / own, own, angle])
    return points, codes, img.shape


# -- matching -----------------------------------------------------------------

_CELL = 1 << 22


def _wide(codes: np.ndarray) -> np.ndarray:
    """Codes as two 64-bit numbers each."""
    return np.ascontiguousarray(codes).view(np.uint64)


def _best(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest code of ``b`` for each wide code of ``a`` and its unlike bits; nearest of ``a`` for each of ``b``. A few rows at a time."""
    best, bits = np.empty(len(a), np.int64), np.empty(len(a), np.uint8)
    back, least = np.zeros(len(b), np.int64), np.full(len(b), 255, np.uint8)
    step = max(1, _CELL // max(1, len(b)))
    for k in range(0, len(a), step):
        u = np.bitwise_count(a[k : k + step, None, 0] ^ b[None, :, 0])
        u += np.bitwise_count(a[k : k + step, None, 1] ^ b[None, :, 1])
        best[k : k + step] = u.argmin(axis=1)
        bits[k : k + step] = u.min(axis=1)
        own, low = u.argmin(axis=0), u.min(axis=0)
        back[low < least] = own[low < least] + k
        least = np.minimum(least, low)
    return best, bits, back


def _seen(points: np.ndarray, moved: np.ndarray, size: float, other: np.ndarray, frame: tuple[int, int]) -> int:
    """How many keypoints a detector would find in the other image too, if ``moved`` are their places there and ``size`` its relative size."""
    own = points[:, 2] / size  # the level on which the other image shows the same patch
    edge = _PATCH / own
    ok = (own <= 1.15) & (own >= 0.85 * other[:, 2].min())
    return int((ok & (moved.real >= edge) & (moved.real <= frame[1] - edge) & (moved.imag >= edge) & (moved.imag <= frame[0] - edge)).sum())


def consensus(
    pa_: np.ndarray, ca: np.ndarray, fa: tuple[int, int], pb: np.ndarray, cb: np.ndarray, fb: tuple[int, int], most_bits: int, least: int, share: float = 0.35,
) -> bool:
    """Whether one similarity transform explains enough descriptor matches that are best in both directions.

    Every match gives a turn and a size by itself, and with its place a transform; each match's own transform is tried.
    A match agrees if its place, its turn and its size do. Enough are ``least`` at places of their own (a corner may be found on
    several levels), half of all matches, and ``share`` of the keypoints that both images should show under that
    transform: in unlike images of alike texture a few matches agree by chance, in copies most do.
    """
    if not len(pa_) or not len(pb):
        return False
    best, bits, back = _best(_wide(ca), _wide(cb))
    ok = np.flatnonzero((bits <= most_bits) & (back[best] == np.arange(len(ca))))
    if len(ok) < least:
        return False
    a, b = pa_[ok].astype(np.float64), pb[best[ok]].astype(np.float64)
    za, zb = a[:, 1] + 1j * a[:, 0], b[:, 1] + 1j * b[:, 0]
    angle, size = b[:, 3] - a[:, 3], a[:, 2] / b[:, 2]
    turn, step, mine, at = np.exp(1j * angle) * size, max(1, (1 << 20) // len(ok)), np.zeros(len(ok), bool), 0
    for k in range(0, len(ok), step):
        way = za[None] - za[k : k + step, None]
        moved = way * turn[k : k + step, None] + zb[k : k + step, None]
        agree = np.abs(moved - zb[None]) <= 3.0 + 0.08 * np.abs(way)
        agree &= np.abs(turn[None] / turn[k : k + step, None] - 1) <= 0.4
        best_one = int(agree.sum(axis=1).argmax())
        if agree[best_one].sum() > mine.sum():
            mine, at = agree[best_one], k + best_one
    most = int(mine.sum())
    if most < len(ok) / 2 or len(np.unique(np.rint(za[mine] / 4))) < least:
        return False
    there = (pa_[:, 1] + 1j * pa_[:, 0] - za[at]) * turn[at] + zb[at]
    here = (pb[:, 1] + 1j * pb[:, 0] - zb[at]) / turn[at] + za[at]
    return most >= share * min(_seen(pa_, there, size[at], pb, fb), _seen(pb, here, 1 / size[at], pa_, fa))


#: A keypoint in 22 bytes: its place and turn as fractions, its level by number, its code.
_POINT = np.dtype([("place", "<u2", 2), ("level", "u1"), ("turn", "u1"), ("code", "u1", _BITS // 8)])


def _pack(points: np.ndarray, codes: np.ndarray, frame: tuple[int, int]) -> bytes:
    out, side = np.empty(len(points), _POINT), min(frame)
    if len(points):
        out["place"] = np.rint(points[:, :2] / frame * 65535)
        out["level"] = np.where(points[:, 2] == 1, 0, 1 + np.rint(np.log(points[:, 2].astype(np.float64) * side / _SMALLEST) / -np.log(_STEP)))
        out["turn"] = np.rint(points[:, 3] / (2 * np.pi) * 256).astype(np.int64) % 256
        out["code"] = codes
    return struct.pack("<II", *frame) + out.tobytes()


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, tuple[int, int]]:
    frame, out = struct.unpack("<II", data[:8]), np.frombuffer(data, _POINT, -1, 8)
    points = np.empty((len(out), 4))
    points[:, :2] = out["place"] / 65535 * frame
    points[:, 2] = np.where(out["level"] == 0, 1, _SMALLEST / _STEP ** (out["level"] - 1.0) / min(frame))
    points[:, 3] = out["turn"] * (2 * np.pi / 256)
    return points, out["code"], frame


def _describer(corners: int | None):
    def run(batches):
        for batch in batches:
            digest, packed, count = [], [], []
            for data in batch.column(1).to_pylist():
                img = decode_image(data)
                digest.append(None if data is None else int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True))
                found = (np.zeros((0, 4)), np.zeros((0, 16), np.uint8), (0, 0)) if img is None else describe(img, corners)
                packed.append(_pack(*found))
                count.append(len(found[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.int64()), pa.array(packed, pa.binary()), pa.array(count, pa.int32())], ["id", "digest", "features", "n_points"])
    return run


# -- Hamming tables -----------------------------------------------------------

_NEAR, _APART, _TAKEN, _TURNS, _FARTHER = 3, 4.0, 28, 16, 1.3
#: Keys of an image that give first classes.
_FEW = 8


def table_keys(points: np.ndarray, codes: np.ndarray, tables: int) -> np.ndarray:
    """Distinct Hamming-table keys of an image, from its pairs of neighbouring corners.

    One corner's descriptor is little to tell images apart where their texture is alike, so a key joins two: each
    corner with its three nearest of its own or a coarser level, which a smaller copy has too, at least four patch pixels
    apart. For each table a key holds 28 sampled bits of either descriptor, and the second corner's direction, distance,
    turn and level as seen from the first, in cells with the table's own shift. None of that changes if an image is cropped, moved, turned or scaled by whole levels.
    """
    n = len(points)
    if n < 2:
        return np.zeros(0, np.int64)
    p = points.astype(np.float64)
    z, scale, m = p[:, 1] + 1j * p[:, 0], p[:, 2], min(_NEAR, n - 1)
    other = np.empty((n, m), np.int64)
    step = max(1, _CELL // n)
    for k in range(0, n, step):
        far = np.abs(z[k : k + step, None] - z[None])
        far[(scale[None] > scale[k : k + step, None] * 1.01) | (far * scale[None] < _APART)] = np.inf
        some = np.argpartition(far, m - 1, axis=1)[:, :m] if m < n else np.tile(np.arange(n), (len(far), 1))
        other[k : k + step] = np.where(np.isfinite(np.take_along_axis(far, some, 1)), some, -1)
    i, j = np.repeat(np.arange(n), m), other.ravel()
    i, j = i[j >= 0], j[j >= 0]
    way = z[j] - z[i]
    around = np.stack([(np.angle(way) - p[i, 3]) / (2 * np.pi), (p[j, 3] - p[i, 3]) / (2 * np.pi)]) % 1
    far = np.log(np.abs(way) * scale[i]) / np.log(_FARTHER)
    level = np.rint(np.log(scale[j] / scale[i]) / np.log(_STEP)).astype(np.int64) + 64
    bits, out = np.unpackbits(codes, axis=1), []
    for t in range(tables):
        rng = np.random.default_rng([20, t])
        taken, shift = rng.permutation(_BITS)[: 2 * _TAKEN], rng.random(3)
        half = [bits[:, taken[a : a + _TAKEN]] @ (np.uint64(1) << np.arange(_TAKEN, dtype=np.uint64)) for a in (0, _TAKEN)]
        turns = np.floor((around + shift[:2, None]) * _TURNS) % _TURNS
        cell = ((turns[0] * _TURNS + turns[1]) * 256 + np.floor(far + shift[2]) + 64) * 256 + level
        out.append(mix(mix(half[0][i] << np.uint64(32) | half[1][j]) + cell.astype(np.uint64) * np.uint64(tables) + np.uint64(t)))
    return np.unique(np.concatenate(out)).astype(np.int64)


def _keys(tables: int, lowest: int | None = None):
    """Arrow function: the keys of each image, or the ``lowest`` so many of them."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = [table_keys(*_unpack(data)[:2], tables)[:lowest] for data in part.column("features").to_pylist()]
                which = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), part.column("digest").take(pa.array(which))], ["key", "id"])
    return run


def _holders(tables: int):
    """Arrow function: who holds each key, ``alone`` images of no class so far and classes of some; a key that many of a batch hold travels once for each."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                keys = [table_keys(*_unpack(data)[:2], tables) for data in part.column("features").to_pylist()]
                of_class, size = np.asarray(part.column("class").is_valid()), np.array([len(k) for k in keys])
                single = [k for k, c in zip(keys, of_class, strict=True) if not c]
                if single:
                    each, n = np.unique(np.concatenate(single), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n.astype(np.int32)), pa.nulls(len(each), pa.int64())], ["key", "alone", "class"])
                if of_class.any():
                    key = np.concatenate([k for k, c in zip(keys, of_class, strict=True) if c])
                    label = np.repeat(part.column("class").drop_null().to_numpy(), size[of_class])
                    both = np.unique(np.stack([key, label], axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(np.zeros(len(both), np.int32)), pa.array(both[:, 1].copy())], ["key", "alone", "class"])
    return run


def _checker(most_bits: int, least: int, share: float):
    def run(batches):
        for batch in batches:
            ok = pa.array([consensus(*_unpack(x), *_unpack(y), most_bits, least, share) for x, y in zip(batch.column("fa").to_pylist(), batch.column("fb").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])
    return run


def _within(most_bits: int, least: int, share: float):
    """Consensus of one image of a bucket with others of it."""

    def prepare(key: int, data: list[bytes]):
        feats = [_unpack(d) for d in data]
        return lambda i, js: [j for j in js if consensus(*feats[min(i, j)], *feats[max(i, j)], most_bits, least, share)]
    return prepare


def image_copies(
    images: DataFrame, image_id: str = "image_id", image: str = "image", corners: int | None = None, most_bits: int = 20, least_matches: int = 8,
    least_share: float = 0.35, tables: int = 5, broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """``image_id, class_id, n_points``: class of copies of each image, named by its smallest id.

    Images are linked if their bytes have one 64-bit hash, or if geometric consensus finds at least ``least_matches``
    descriptor matches at different places (of at most ``most_bits`` unlike bits of 128) under one turn, size and shift, and
    these are at least ``least_share`` of the keypoints that both should show; classes are connected components. Candidates
    share a key of ``tables`` Hamming tables over pairs of neighbouring corners (``table_keys``); every candidate is checked
    that isn't of one class already: a few keys of each image give first classes, and keys that one class alone holds fall away.
    Buckets are first compared with one of their images, and those that then still mix classes in blocks inside tasks, so no
    bucket is cut.

    Null, broken or featureless images are only linked to equal ones, and null images stay alone. Rows with one id are one
    image; a row without id has no class. An empty table gives no row; other columns are ignored.
    """
    cols = images.select(F.col(image_id).alias("id"), F.col(image).alias("image"))
    x = written(cols.mapInArrow(_describer(corners), "id long, digest long, features binary, n_points int"), "images")
    # from here on an image is its digest
    one = x.where(F.col("digest").isNotNull() & (F.col("n_points") >= least_matches)).select("digest", "features").dropDuplicates(["digest"])
    one = written(one, "one")

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(one.select(F.col("digest").alias("a"), F.col("features").alias("fa")), "a").join(one.select(F.col("digest").alias("b"), F.col("features").alias("fb")), "b")
        return both.mapInArrow(_checker(most_bits, least_matches, least_share), "a long, b long")

    def payload(ids: DataFrame) -> DataFrame:
        return ids.join(one.select(F.col("digest").alias("id"), F.col("features").alias("data")), "id")

    # copies that are told by a few keys become classes first, so that what follows compares classes and not each two of a large group
    found = pivot_links(one.mapInArrow(_keys(1, _FEW), "key long, id long"), verify)
    label = connected_components(found, "a", "b").select(F.col("node").alias("digest"), F.col("component").alias("class"))
    told = label.where("digest != class").select(F.col("class").alias("a"), F.col("digest").alias("b"))
    classed = written(one.join(label, "digest", "left"), "classed")
    # an image has a key once and most keys occur once, so counts before the shuffle are made by batches, not by whole tasks
    n_keys = (x.agg(F.sum(F.col("n_points").cast("long"))).first()[0] or 0) * _NEAR * tables
    parts = max(int(x.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_keys // 1_000_000)
    holders = classed.mapInArrow(_holders(tables), "key long, alone int, class long").repartition(parts, "key")
    holders = holders.groupBy("key").agg(F.sum("alone").alias("alone"), F.min("class").alias("low"), F.max("class").alias("high"))
    shared = written(holders.where("alone > 1 or alone = 1 and low is not null or low < high").select("key"), "shared")
    small = shared.count() <= broadcast_keys  # numbers of eight bytes
    members = one.mapInArrow(_keys(tables), "key long, id long").join(F.broadcast(shared) if small else shared, "key", "left_semi")
    links = link_buckets(written(members, "members"), verify, payload, _within(most_bits, least_matches, least_share), few_pivots=True, known=told)
    ids = x.where("id is not null and digest is not null")
    first = ids.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where("a < z").select("id", "a")
    again = ids.select("id", "digest").join(first, "id").where("a != digest").select("a", F.col("digest").alias("b")).distinct()
    classes = written(connected_components(links.unionByName(again), "a", "b"), "classes")
    placed = x.where("digest is not null").select("id", "digest", "n_points").join(classes, F.col("digest") == F.col("node"), "left").withColumn("c", F.coalesce("component", "digest"))
    named = placed.groupBy("c").agg(F.min("id").alias("low"))
    got = placed.join(named, "c").select("id", "low", "n_points").unionByName(x.where("digest is null").select("id", F.col("id").alias("low"), "n_points"))
    return got.select(F.col("id").alias("image_id"), F.when(F.col("id").isNotNull(), F.col("low")).alias("class_id"), "n_points")


def heat_map(vector: list[float] | None, side: int = 64) -> bytes | None:
    """A vector as a grey picture: its components as an eight-wide grid from darkest to brightest, drawn ``side`` pixels wide."""
    if not vector or any(v is None for v in vector) or not np.isfinite(vector).all():
        return None
    v = np.array(vector, np.float64)
    low, high = v.min(), v.max()
    grid = np.resize((v - low) / (high - low if high > low else 1), (-(-len(v) // 8), 8))
    img = _resize(grid * 255, max(1, side * grid.shape[0] // 8), side)
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + np.rint(img).astype(np.uint8).tobytes()


def draw_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``image_id, image``: a heat map of each vector; null for vectors that are null, empty or not finite.

    Drawing, and what follows in the same stage, takes far longer than reading a vector, so rows are dealt out evenly first.
    """
    tasks = max(4 * vectors.sparkSession.sparkContext.defaultParallelism, vectors.count() // 4096)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([heat_map(v) for v in batch.column(1).to_pylist()], pa.binary())], ["image_id", "image"])

    rows = vectors.select(F.col(vec_id).cast("long").alias("image_id"), F.col(embedding).alias("e")).repartition(tasks)
    return rows.mapInArrow(run, "image_id long, image binary")
