import math

import numpy as np
import pytest
from pyspark.sql import types as T

from mediamatch.operators import features as X

SCHEMA = "id long, width int, height int, n_channels int, data binary"


def picture(width, height, seed=0):
    """Smooth random RGB picture."""
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    out = np.zeros((height, width, 3))
    for c in range(3):
        for _ in range(4):
            fx, fy, phase, size = rng.uniform(0.5, 3), rng.uniform(0.5, 3), rng.uniform(0, 6), rng.uniform(20, 50)
            out[:, :, c] += size * np.sin(2 * np.pi * (fx * x / width + fy * y / height) + phase)
    return np.clip(out + 128, 0, 255).astype(np.uint8)


def row(i, rgb):
    return (i, rgb.shape[1], rgb.shape[0], 3, bytearray(np.ascontiguousarray(rgb[:, :, ::-1]).tobytes()))


def run(spark, rows, *args, **options):
    return {r["id"]: r for r in X.with_features(spark.createDataFrame(rows, SCHEMA), *args, **options).collect()}


def plain_resample(rgb, width, height):
    h, w, _ = rgb.shape
    out = np.zeros((height, width, 3), dtype=np.uint8)
    for j in range(height):
        for i in range(width):
            ax, ay = i * (w * 256 // width), j * (h * 256 // height)
            x, y, fx, fy = ax >> 8, ay >> 8, ax & 255, ay & 255
            x1, y1 = min(x + 1, w - 1), min(y + 1, h - 1)
            for c in range(3):
                top = int(rgb[y, x, c]) * (256 - fx) + int(rgb[y, x1, c]) * fx
                low = int(rgb[y1, x, c]) * (256 - fx) + int(rgb[y1, x1, c]) * fx
                out[j, i, c] = (top * (256 - fy) + low * fy) >> 16
    return out


def test_resample_matches_plain_loops():
    for size in [(7, 5), (64, 40), (90, 33)]:
        rgb = picture(*size)
        assert (X.resample(rgb, 32, 32) == plain_resample(rgb, 32, 32)).all()


def test_features_match_plain_loops():
    rgb = picture(50, 70, 3)
    g = X.grey(plain_resample(rgb, 32, 32))
    block = []
    for u in range(8):
        for v in range(8):
            total = sum(
                g[y, x] * math.cos((2 * x + 1) * u * math.pi / 64) * math.cos((2 * y + 1) * v * math.pi / 64)
                for x in range(32) for y in range(32)
            )
            block.append(total / 4 * (math.sqrt(0.5) if u == 0 else 1) * (math.sqrt(0.5) if v == 0 else 1))
    assert np.allclose(X.dct_block(rgb).ravel(), block)
    mean = sum(block[1:]) / 63
    bits = "".join("1" if d > mean else "0" for d in block)
    assert X.perceptual_hash(rgb) == f"{int(bits, 2):016x}"

    g = X.grey(plain_resample(rgb, 64, 64)).astype(float)
    cells = [[] for _ in range(32)]
    for x in range(64):
        for y in range(64):
            m = 0.0
            if 0 < x < 63 and 0 < y < 63:
                k = [(-1, 1), (0, 2), (1, 1)]
                gx = sum(w * (g[y + d, x + 1] - g[y + d, x - 1]) for d, w in k)
                gy = sum(w * (g[y + 1, x + d] - g[y - 1, x + d]) for d, w in k)
                m = math.hypot(gx, gy)
            cells[(x // 8) * 4 + y // 16].append(m)
    means = np.array([sum(c) / len(c) for c in cells])
    assert np.allclose(X.edge_vector(rgb), means / means.max())


def test_shapes_and_bounds(spark):
    got = run(spark, [row(i, picture(120, 80, i)) for i in range(6)])
    for r in got.values():
        assert len(r["phash"]) == 16 and set(r["phash"]) <= set("0123456789abcdef")
        assert len(r["color_vector"]) == 48 and len(r["edge_vector"]) == 32
        assert all(sum(r["color_vector"][c * 16 : c * 16 + 16]) == pytest.approx(1) for c in range(3))
        assert max(r["edge_vector"]) == pytest.approx(1) and min(r["edge_vector"]) >= 0
    hashes = [int(r["phash"], 16) for r in got.values()]
    far = [(a ^ b).bit_count() > 5 for i, a in enumerate(hashes) for b in hashes[i + 1 :]]
    assert sum(far) > len(far) / 2


def test_solid_images(spark):
    red = np.zeros((40, 60, 3), np.uint8)
    red[:, :, 0] = 255
    black = np.zeros((10, 10, 3), np.uint8)
    got = run(spark, [row(1, red), row(2, black)])
    assert got[1]["color_vector"][15] == 1 and got[1]["color_vector"][16] == 1 and got[1]["color_vector"][32] == 1
    assert max(got[1]["edge_vector"]) == 0
    assert got[1]["phash"] == "8000000000000000" and got[2]["phash"] == "0" * 16


def test_similar_pictures_stay_close(spark):
    rgb = picture(400, 300, 5)
    doubled = np.repeat(np.repeat(rgb, 2, axis=0), 2, axis=1)
    noisy = np.clip(rgb.astype(int) + np.random.default_rng(1).integers(-6, 7, rgb.shape), 0, 255).astype(np.uint8)
    got = run(spark, [row(0, rgb), row(1, doubled), row(2, rgb[::2, ::2]), row(3, noisy), row(4, picture(400, 300, 6))])
    base = int(got[0]["phash"], 16)
    apart = {i: (base ^ int(got[i]["phash"], 16)).bit_count() for i in got}
    assert max(apart[1], apart[2], apart[3]) <= 6 < apart[4]


def test_channels_and_unusable_rows(spark):
    rgb = picture(40, 30, 2)
    alpha = np.dstack([rgb[:, :, ::-1], np.full((30, 40), 9, np.uint8)])
    one = rgb[:, :, :1]
    rows = [
        row(1, rgb),
        (2, 40, 30, 4, bytearray(alpha.tobytes())),
        (3, 40, 30, 1, bytearray(np.ascontiguousarray(one).tobytes())),
        row(4, np.repeat(one, 3, axis=2)),
        (5, -1, -1, -1, bytearray()),
        (6, 40, 30, 3, bytearray(b"short")),
        (7, 900, 30, 3, bytearray(b"short")),
        (8, 40, 30, 3, None),
    ]
    got = run(spark, rows)
    values = lambda i: (got[i]["phash"], got[i]["color_vector"], got[i]["edge_vector"])
    assert values(1) == values(2) and values(3) == values(4)
    assert values(5) == values(7) == values(8) == (None, None, None)
    assert values(6) == ("0" * 16, [0.0] * 48, [0.0] * 32)


def test_working_size_and_custom_processor(spark):
    shape = X.Processor("shape", T.StringType(), lambda rgb: f"{rgb.shape[1]}x{rgb.shape[0]}", "")
    again = X.Processor("shape", T.StringType(), lambda rgb: "later " + str(rgb.shape[1]), "")
    rows = [row(1, picture(1024, 300)), row(2, picture(100, 50)), row(3, np.zeros((2000, 1, 3), np.uint8))]
    got = run(spark, rows, [shape])
    assert [got[i]["shape"] for i in (1, 2, 3)] == ["512x150", "100x50", "1x512"]
    assert run(spark, rows[:1], [shape], probe_edge=256)[1]["shape"] == "256x75"
    assert run(spark, rows[:1], [shape, again])[1]["shape"] == "later 512"


def test_text_as_image(spark):
    from mediamatch.sources import text_as_image

    df = text_as_image(spark.createDataFrame([("aé😀bcd",), ("",)], "text string"))
    full, empty = df.collect()
    assert (full["width"], full["height"], bytes(full["data"])) == (2, 1, bytes([0x61, 0xE9, 0x00, 0x62, 0x63, 0x64]))
    assert empty["width"] == -1


@pytest.mark.parametrize("size", [(1, 1), (1, 40), (33, 34), (128, 128), (7, 129)])
def test_small_pictures_are_resampled_by_exact_products(size):
    rng = np.random.default_rng(3)
    for rgb in (rng.integers(0, 256, (*size, 3)).astype(np.uint8), np.full((*size, 3), 255, np.uint8)):
        for side in (32, 64, 150):
            y0, y1, fy = X._taps(size[0], side)
            x0, x1, fx = X._taps(size[1], side)
            fy, fx, wide = fy[:, None, None], fx[None, :, None], rgb.astype(np.int64)
            rows = wide[y0] * (256 - fy) + wide[y1] * fy
            want = rows[:, x0] * (256 - fx) + rows[:, x1] * fx
            assert np.array_equal(X._weighted(rgb, side, side).transpose(1, 2, 0), want)
            assert np.array_equal(X.resample(rgb, side, side), want >> 16)


def test_texts_of_any_script_give_their_low_bytes(spark):
    from mediamatch.sources.text_images import text_as_image

    texts = ["plain", "été\x00\xff\n", "ł€\U0001f600 mixed", "x\nł\n", "", None, "a" * 3000]
    rows = text_as_image(spark.createDataFrame([(t,) for t in texts], "text string")).collect()
    for r in rows:
        low = bytes(ord(c) % 256 for c in r["text"] or "")
        assert r["data"] is None if r["text"] is None else bytes(r["data"]).startswith(low) and not any(bytes(r["data"])[len(low) :])
