import random
import struct

import pytest

from quillon.llm import webp as w


def picture(width, height, colors, seed):
    r = random.Random(seed)
    palette = [r.randrange(1 << 32) for _ in range(colors)]
    out = []
    for y in range(height):
        for x in range(width):
            out.append(palette[(x // 3 + y // 2) % colors] if r.random() < 0.8 else r.choice(palette))
    return out


ALL = [(), (w.PREDICTOR,), (w.CROSS_COLOR,), (w.SUBTRACT_GREEN,), (w.PALETTE,), (w.PREDICTOR, w.CROSS_COLOR, w.SUBTRACT_GREEN), (w.PALETTE, w.PREDICTOR), (w.SUBTRACT_GREEN, w.CROSS_COLOR, w.PREDICTOR)]


@pytest.mark.parametrize("transforms", ALL)
@pytest.mark.parametrize("width,height,colors", [(1, 1, 1), (7, 5, 2), (16, 9, 4), (13, 13, 16), (33, 20, 17), (40, 31, 200), (1, 50, 3), (50, 1, 3)])
def test_round_trip(transforms, width, height, colors):
    for cache in (0, 1, 6, 11):
        p = picture(width, height, colors, width * 31 + cache)
        assert w.decode(w.encode(width, height, p, transforms, cache)) == (width, height, p)


def bits(*fields):
    value = n = 0
    for x, k in fields:
        value |= x << n
        n += k
    return value.to_bytes((n + 7) // 8, "little")


def container(stream):
    body = b"WEBPVP8L" + struct.pack("<I", len(stream)) + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def simple(symbol):
    return [(1, 1), (0, 1), (1, 1), (symbol, 8)]


def test_stream_written_by_hand():
    """2 x 1, no transform, no cache, no meta image, five codes of one symbol: one colour."""
    head = [(1, 14), (0, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    s = b"\x2f" + bits(*head, *simple(0x22), *simple(0x11), *simple(0x33), *simple(0xFF), *simple(0))
    assert w.decode(container(s)) == (2, 1, [0xFF112233] * 2)


def test_two_symbol_code_by_hand():
    green = [(1, 1), (1, 1), (1, 1), (10, 8), (20, 8)]
    head = [(2, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    s = b"\x2f" + bits(*head, *green, *simple(0), *simple(0), *simple(255), *simple(0), (0, 1), (1, 1), (0, 1))
    assert w.decode(container(s))[2] == [0xFF000A00, 0xFF001400, 0xFF000A00]


def test_meta_prefix_image_by_hand():
    """A 5 x 1 image in blocks of 4: the first block has green 1, the second green 2, by two groups of codes."""
    meta = [(0, 1), *[(1, 1), (1, 1), (0, 1), (0, 1), (1, 8)], *simple(0), *simple(0), *simple(0), *simple(0), (0, 1), (1, 1)]
    group = lambda g: [*simple(g), *simple(0), *simple(0), *simple(255), *simple(0)]
    s = b"\x2f" + bits((4, 14), (0, 14), (0, 1), (0, 3), (0, 1), (0, 1), (1, 1), (0, 3), *meta, *group(1), *group(2))
    assert w.decode(container(s))[2] == [0xFF000100] * 4 + [0xFF000200]


def test_predictors():
    left, top, corner, right = 0x10203040, 0x20406080, 0x30507090, 0x01020304
    p = lambda m: w.predicted(m, left, top, corner, right)
    assert [p(0), p(1), p(2), p(3), p(4)] == [0xFF000000, left, top, right, corner]
    assert p(6) == 0x20385068 and p(7) == 0x18304860
    assert p(12) == 0x00102030 and p(14) == 0xFF000000


def test_distance_map():
    assert len(w.NEAR) == 120 == len(set(w.NEAR)) and w.NEAR[:4] == [(0, 1), (1, 0), (1, 1), (-1, 1)] and w.NEAR[-1] == (8, 7)


def test_bad_data():
    good = w.encode(9, 9, picture(9, 9, 30, 1), (w.PREDICTOR,))
    for bad in (b"", b"RIFF", b"RIFF0000WEBPVP8 0000", good[:40], b"x" * 50, container(b"\x2e" + good[21:])):
        with pytest.raises(Exception):
            w.decode(bad)


def test_column(spark):
    good = w.encode(2, 2, [1, 2, 3, 0xFFFFFFFF])
    rows = [(1, bytearray(good), "a"), (2, None, "b"), (3, bytearray(b""), None), (4, bytearray(good[:30]), "d"), (1, bytearray(good), "a")]
    t = spark.createDataFrame(rows, "id int, image binary, width string")
    got = {r.id: r for r in w.decode_images(t).collect()}
    assert got[1].pixels == [1, 2, 3, -1] and (got[1].width, got[1].height) == (2, 2) and got[1].error is None
    assert got[2].pixels is None and got[2].error is None and got[3].error and got[4].error
    assert w.decode_images(t.limit(0)).count() == 0 and w.decode_images(t).count() == 5


def test_embeddings(spark):
    t = spark.createDataFrame([(0, [0.0, 1.0, -1.0]), (1, []), (2, None), (3, [5.0] * 17), (4, [None, float("nan")])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in w.decode_images(w.gray_images(t)).collect()}
    level = lambda p: p & 255
    assert [level(x) for x in got[0].pixels] == [127, 255, 0, 0, 0, 0, 0, 0] and got[1].pixels is None and got[3].height == 3 and set(map(level, got[4].pixels)) == {0}


def by_channels(mode, left, top, corner, right):
    """The predictors as the format's text has them, channel by channel, over lists of four bytes."""
    import struct

    L, T, TL, TR = (struct.unpack(">4B", struct.pack(">I", x)) for x in (left, top, corner, right))
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        guess = [a + b - c for a, b, c in zip(L, T, TL)]
        out = L if sum(abs(g - a) for g, a in zip(guess, L)) < sum(abs(g - b) for g, b in zip(guess, T)) else T
    elif mode == 12:
        out = [clamp(a + b - c) for a, b, c in zip(L, T, TL)]
    elif mode == 13:
        half = lambda d: d // 2 if d >= 0 else -(-d // 2)
        out = [clamp(m + half(m - c)) for m, c in zip(mean(L, T), TL)]
    else:
        out = {5: mean(mean(L, TR), T), 6: mean(L, TL), 7: mean(L, T), 8: mean(TL, T), 9: mean(T, TR), 10: mean(mean(L, TL), mean(T, TR))}[mode]
    return struct.unpack(">I", bytes(out))[0]


@pytest.mark.parametrize("mode", range(5, 14))
def test_predictors_against_the_format(mode):
    r = random.Random(mode)
    for _ in range(500):
        # Like neighbours as well as any, so that both sides of the choices come up.
        base = r.randrange(1 << 32)
        near = [r.randrange(1 << 32) if r.random() < 0.5 else base ^ r.randrange(1 << 4) for _ in range(4)]
        assert w.predicted(mode, *near) == by_channels(mode, *near)


def claiming(width, height):
    """A file of few bytes that claims width x height pixels of one colour."""
    head = [(width - 1, 14), (height - 1, 14), (1, 1), (0, 3), (0, 1), (0, 1), (0, 1)]
    return container(b"\x2f" + bits(*head, *simple(0x22), *simple(0x11), *simple(0x33), *simple(0xFF), *simple(0)))


def test_few_bytes_that_claim_many_pixels(spark):
    import time

    began = time.time()
    with pytest.raises(ValueError, match="16384 x 16384"):
        w.decode(claiming(16384, 16384))
    assert len(claiming(16384, 16384)) < 60 and time.time() - began < 1
    t = spark.createDataFrame([(1, bytearray(claiming(16384, 16384))), (2, bytearray(claiming(2000, 1500))), (3, bytearray(claiming(1, 1)))], "id int, image binary").coalesce(1)
    got = {r.id: r for r in w.decode_images(t).selectExpr("id", "width", "error", "size(pixels) AS n", "pixels[0] AS p").collect()}
    assert got[1].error and got[1].width is None and got[2].n == 3_000_000 and got[2].p == 0xFF112233 - (1 << 32) and got[3].n == 1
