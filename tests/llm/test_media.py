"""Copies among pictures against all-pairs consensus."""

import zlib

import numpy as np

from threadloom.llm import media


def texture(rng, n=96, cells=12):
    return media._smooth(media._resize(rng.random((cells, cells)) * 255, n, n))


def pgm(img):
    return b"P5 %d %d 255\n" % (img.shape[1], img.shape[0]) + np.clip(np.rint(img), 0, 255).astype(np.uint8).tobytes()


def frame(spark, rows):
    return spark.createDataFrame([(i, bytearray(x)) for i, x in rows], "image_id long, image binary")


def by_all_pairs(rows):
    feats = [media.describe(media.decode_image(x)) for _, x in rows]
    label = [i for i, _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and (media.consensus(*feats[j], *feats[i], 20, 8) or media.consensus(*feats[i], *feats[j], 20, 8)):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return {i: c for (i, _), c in zip(rows, label, strict=True)}


def turned(img, degrees):
    """The middle of a picture, turned by any angle."""
    n = int(img.shape[0] * 0.66)
    y, x = np.mgrid[:n, :n] - (n - 1) / 2
    c, s, m = np.cos(np.radians(degrees)), np.sin(np.radians(degrees)), (img.shape[0] - 1) / 2
    v, u = c * y - s * x + m, s * y + c * x + m
    y0, x0 = v.astype(int), u.astype(int)
    fy, fx = v - y0, u - x0
    return img[y0, x0] * (1 - fy) * (1 - fx) + img[y0 + 1, x0] * fy * (1 - fx) + img[y0, x0 + 1] * (1 - fy) * fx + img[y0 + 1, x0 + 1] * fy * fx


EDITS = {
    "noise 8": lambda t, rng: t + rng.normal(0, 8, t.shape), "noise 14": lambda t, rng: t + rng.normal(0, 14, t.shape),
    "crop to 3/4": lambda t, rng: t[20:116, 30:126], "crop to half": lambda t, rng: t[40:104, 8:72],
    "turn by 90": lambda t, rng: np.rot90(t), "turn by 30": lambda t, rng: turned(t, 30), "turn by 137": lambda t, rng: turned(t, 137),
    "size 0.9": lambda t, rng: media._resize(t, 115, 115), "size 0.75": lambda t, rng: media._resize(t, 96, 96), "size 0.6": lambda t, rng: media._resize(t, 77, 77), "size 1.25": lambda t, rng: media._resize(t, 160, 160),
    "darker": lambda t, rng: t * 0.6 + 10, "crop, size and noise": lambda t, rng: media._resize(t[10:110, 10:110], 80, 80) + rng.normal(0, 4, (80, 80)),
}


def test_recall_of_edits_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(10):
        t = texture(rng, 128, 16)
        rows += [(100 * k + v, pgm(x)) for v, x in enumerate([t, *(edit(t, rng) for edit in EDITS.values())])]
    want = by_all_pairs(rows)
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(frame(spark, rows)).collect()}
    assert all(want[i] == want[c] for i, c in got.items())  # no link that all pairs don't give
    linked = [i for i in want if want[i] == i // 100 * 100 and i % 100]
    assert all(i // 100 == c // 100 for i, c in want.items())
    found = {name: np.mean([got[100 * k + v] == 100 * k for k in range(10)]) for v, name in enumerate(EDITS, 1)}
    assert min(found.values()) >= 0.8, found
    assert np.mean([got[i] == want[i] for i in linked]) >= 0.9
    assert len(linked) >= 0.9 * 10 * len(EDITS)


def test_alike_textures_are_no_copies(spark):
    """Smooth heat maps of unlike vectors hold many alike corners; vectors that differ by little noise are copies."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(150, 64))
    v = np.concatenate([v, v[:40] + rng.normal(0, 0.08, (40, 64))])
    rows = [(i, media.heat_map(x.tolist())) for i, x in enumerate(v)]
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(frame(spark, rows)).collect()}
    assert all(got[i] == i for i in range(150)) and all(c in (i, i - 150) for i, c in got.items())
    assert sum(got[150 + i] == i for i in range(40)) >= 38


def test_a_bucket_is_never_cut(spark):
    """Forty noisy copies that share their buckets, told apart from others in them by blocks."""
    rng = np.random.default_rng(4)
    t, u = texture(rng), texture(rng)
    rows = [(i, pgm((t if i % 2 else u) + rng.normal(0, 2, t.shape))) for i in range(80)]
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(frame(spark, rows)).collect()}
    assert got == {i: i % 2 for i in range(80)}


def test_every_prefix_of_a_picture_returns():
    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    a = np.arange(30, dtype=np.uint8).reshape(5, 6)
    head = (6).to_bytes(4, "big") + (5).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in a))) + chunk(b"IEND", b"")
    for whole in (pgm(a), b"P6 # remark\n2 1\n255\n" + bytes(6), png):
        assert media.decode_image(whole) is not None
        for n in range(len(whole)):
            media.decode_image(whole[:n])
    odd = [b"P5", b"P5 10 10", b"P5 3 3 255", b"P5 -1 3 255 ", b"P5 a b c ", b"P5 0 0 255 ", b"P5 99999999 99999999 255 x", b"\x89PNG\r\n\x1a\n", b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b"x"), png[:8] + chunk(b"IHDR", b"\xff" * 8 + bytes([8, 0, 0, 0, 0])) + png[33:], png[:8] + chunk(b"IHDR", head[:4]) + png[33:]]
    assert [media.decode_image(x) for x in odd] == [None] * len(odd)


def test_small_crops_and_thumbnails(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k in range(3):
        t = texture(rng, 256, 40)
        t[:100, :100] = 128 + 0.3 * (t[:100, :100] - 128)  # a part that has none of the strongest corners
        small = t[:255, :255].reshape(85, 3, 85, 3).mean(axis=(1, 3))
        smaller = t.reshape(64, 4, 64, 4).mean(axis=(1, 3))
        rows += [(10 * k + i, pgm(x)) for i, x in enumerate((t, t[10:74, 20:84], small, smaller))]
    rows.append((99, pgm(texture(rng, 256, 40))))
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(frame(spark, rows)).collect()}
    assert got == {i: i // 10 * 10 if i < 99 else 99 for i, _ in rows}


def test_every_corner_is_kept():
    t = texture(np.random.default_rng(1), 256, 40)
    assert len(media.describe(t)[0]) > 1000 and len(media.describe(t, 32)[0]) == 32
    assert media.describe(t)[0][:, 2].min() <= 0.75**6


def test_keys_inside_one_class_are_not_compared_again(spark, monkeypatch):
    """Rows of a large group of copies fall away once a few keys have made it a class; classes stay those of all pairs."""
    rng, seen = np.random.default_rng(11), []
    t, u = texture(rng), texture(rng)
    rows = [(i, pgm(t + rng.normal(0, 2, t.shape))) for i in range(40)] + [(40 + i, pgm(u + rng.normal(0, 2, u.shape))) for i in range(3)] + [(50 + i, pgm(texture(rng))) for i in range(5)]
    of_buckets = media.link_buckets
    monkeypatch.setattr(media, "link_buckets", lambda members, *a, **b: seen.append(members.count()) or of_buckets(members, *a, **b))
    got = {r["image_id"]: r["class_id"] for r in media.image_copies(frame(spark, rows)).collect()}
    assert got == by_all_pairs(rows)
    n_keys = [len(media.table_keys(*media._unpack(media._pack(*media.describe(media.decode_image(x))))[:2], 5)) for _, x in rows]
    assert seen[0] < 0.1 * sum(n_keys)
