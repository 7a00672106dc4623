"""Kernels against plain loops and against the column expressions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumitide.errors import MediaError, ParamError
from lumitide.functions import pixels as P
from lumitide.kernels import masks as M
from lumitide.kernels import pictures as K
from lumitide.kernels import surfaces as U
from lumitide.operators import frames as FR
from lumitide.sources import generate, write

RNG = np.random.default_rng(3)
PX = RNG.integers(0, 256, (2, 9, 7, 3), dtype=np.uint8)
AT = K.Times(np.array([0.25, 2.0]), np.array([3.0, 3.0]))


def columns(spark, px, f):
    rows = [(k, p.reshape(-1).tolist()) for k, p in enumerate(px)]
    out = spark.createDataFrame(rows, "k long, px array<int>").select("k", f(F.col("px")).alias("px")).orderBy("k").collect()
    return np.array([r.px for r in out])


@pytest.mark.parametrize(
    ("kernel", "f"),
    [
        (K.Crop(1, 2, 4, 5), lambda px: P.crop(px, 7, 9, 1, 2, 4, 5, 3)),
        (K.HFlip(), lambda px: P.hflip(px, 7, 9, 3)),
        (K.VFlip(), lambda px: P.vflip(px, 7, 9, 3)),
        (K.Rotate(90), lambda px: P.rotate(px, 7, 9, 90, 3)),
        (K.Rotate(180), lambda px: P.rotate(px, 7, 9, 180, 3)),
        (K.Rotate(270), lambda px: P.rotate(px, 7, 9, 270, 3)),
        (K.Resize(5, 4, "nearest"), lambda px: P.resize_nearest(px, 7, 9, 5, 4, 3)),
        (K.Resize(11, 4, "bilinear"), lambda px: P.resize_bilinear(px, 7, 9, 11, 4, 3)),
        (K.Margin(2, (9, 9, 9)), lambda px: P.margin(px, 7, 9, 2, 9, 3)),
        (K.Invert(), P.invert),
        (K.multiply(1.7), lambda px: P.multiply(px, 1.7)),
        (K.gamma(0.5), lambda px: P.gamma(px, 0.5)),
        (K.lum_contrast(-20, 1.3), lambda px: P.lum_contrast(px, -20, 1.3)),
        (K.BlackAndWhite(), lambda px: P.black_and_white(px, 7, 9)),
    ],
    ids=lambda x: type(x).__name__ if isinstance(x, K.Kernel) else "",
)
def test_kernel_is_the_expression(spark, kernel, f):
    out = kernel(PX, AT)
    assert kernel.size(7, 9) == (out.shape[2], out.shape[1])
    assert np.array_equal(out.reshape(2, -1), columns(spark, PX, f))


def test_fade():
    out = K.Fade(1.0, True, (10, 20, 30))(PX, AT)
    a = 192
    want = (PX[0].astype(int) * (256 - a) + np.array([10, 20, 30]) * a) >> 8
    assert np.array_equal(out[0], want) and np.array_equal(out[1], PX[1])
    black = K.Fade(1.0, False)(PX, K.Times(np.array([3.0, 1.0]), np.array([3.0, 3.0])))
    assert not black[0].any() and np.array_equal(black[1], PX[1])
    rgba = np.concatenate([PX, np.full((2, 9, 7, 1), 77, np.uint8)], -1)
    assert (K.Fade(1.0)(rgba, AT)[..., 3] == 77).all()


def test_bicubic_of_a_plane_is_the_plane():
    flat = np.full((1, 8, 8, 3), 100, np.uint8)
    assert (K.Resize(13, 5, "bicubic")(flat, AT) == 100).all()
    assert K.Resize(14, 0)(PX, AT).shape == (2, 18, 14, 3)


def test_slide_and_scroll():
    on = K.Slide(1.0, "left", True)(PX, K.Times(np.array([1.0, 0.0]), np.array([3.0, 3.0])))
    assert np.array_equal(on[0], PX[0]) and not on[1].any()
    win = K.Scroll(3, 3, 2.0, 100.0)(PX, K.Times(np.array([0.0, 1.0]), np.array([3.0, 3.0])))
    assert np.array_equal(win[0], PX[0, :3, :3]) and np.array_equal(win[1], PX[1, 6:9, 2:5])


def test_free_rotation_keeps_canvas():
    out = K.Rotate(45)(PX, AT)
    assert out.shape == PX.shape and not out[:, 0, 0].any()


def slow_painting(px, sat, black):
    h, w, _ = px.shape
    at = lambda y, x: px[min(max(y, 0), h - 1), min(max(x, 0), w - 1)].astype(int)
    sharp = np.array([[np.clip(10 * at(y, x) - sum(at(y + j, x + i) for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j), 0, 255) for x in range(w)] for y in range(h)])
    g = (77 * sharp[..., 0] + 150 * sharp[..., 1] + 29 * sharp[..., 2]) >> 8
    e = np.zeros((h, w), np.float32)
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            n = g[y - 1 : y + 2, x - 1 : x + 2]
            gx = n[0, 2] - n[0, 0] + 2 * (n[1, 2] - n[1, 0]) + n[2, 2] - n[2, 0]
            gy = n[2, 0] - n[0, 0] + 2 * (n[2, 1] - n[0, 1]) + n[2, 2] - n[0, 2]
            e[y, x] = np.sqrt(np.float32(gx * gx + gy * gy))
    ink = np.float32(black) * np.float32(255) * (e / max(e.max(), np.float32(1e-6)))
    return np.clip(np.floor(np.float32(sat) * sharp.astype(np.float32) - ink[..., None] + np.float32(0.5)), 0, 255).astype(np.uint8)


def test_painting():
    out = K.Painting(0.9, 0.05)(PX, AT)
    assert np.array_equal(out[0], slow_painting(PX[0], 0.9, 0.05)) and np.array_equal(out[1], slow_painting(PX[1], 0.9, 0.05))


def test_blur_is_separable_with_rounding():
    k = K.gaussian(1.0)
    r = len(k) // 2
    out = K.blur(PX, 1.0)
    p = np.pad(PX[0].astype(np.float32), [(0, 0), (r, r), (0, 0)], "edge")
    one = np.clip(np.floor(sum(p[:, i : i + 7] * v for i, v in enumerate(k)) + np.float32(0.5)), 0, 255)
    p = np.pad(one, [(r, r), (0, 0), (0, 0)], "edge")
    two = np.clip(np.floor(sum(p[i : i + 9] * v for i, v in enumerate(k)) + np.float32(0.5)), 0, 255)
    assert np.array_equal(out[0], two.astype(np.uint8)) and abs(float(k.sum()) - 1) < 1e-6 and len(K.gaussian(50)) == 65


def test_redaction_styles():
    px = RNG.integers(0, 256, (40, 40, 3), dtype=np.uint8)
    region = [M.Region(20, 20, 8)]
    for style, amount in (("gaussian", 3), ("pixelate", 4), ("solid", 0)):
        out = M.redact(px, region, style, amount)
        assert np.array_equal(out[0:8], px[0:8]) and not np.array_equal(out[20, 20], px[20, 20]), style
    assert (M.redact(px, region, "solid", 0)[20, 20] == 0).all()
    block = M.redact(px, region, "pixelate", 4)[20, 20]
    assert np.array_equal(block, np.floor(px[20:24, 20:24].reshape(-1, 3).mean(0) + 0.5))
    assert np.array_equal(M.redact(px, [M.Region(20, 20, 8, 0.01)], "solid"), px)
    with pytest.raises(MediaError):
        M.redact(px, region, "wax")


def test_masks():
    assert M.rle(2, 2, [(3, 255), (1, 0)]).data.tolist() == [[255, 255], [255, 0]]
    for bad in ([(3, 1)], [(4, 256)], [(-1, 0), (5, 0)]):
        with pytest.raises(MediaError):
            M.rle(2, 2, bad)
    square = M.polygon(6, 6, [(1, 1), (4, 1), (4, 4), (1, 4)])
    assert square.data.sum() == 9 * 255 and square.sample(2, 2) == 1.0 and square.sample(9, 9) == 0.0
    with pytest.raises(MediaError):
        M.dense(2, 2, b"123")
    with pytest.raises(MediaError):
        M.dense(9000, 1, b"")
    assert M.union_roi([], 5, 5) is None and M.union_roi([M.Region(50, 50, 1)], 10, 10) is None


def test_surfaces():
    grey = U.to_rgb("yuv420p", 3, 3, [bytes([126] * 9), bytes([128] * 4), bytes([128] * 4)])
    assert grey.shape == (3, 3, 3) and (grey == 128).all()
    assert (U.to_rgb("nv12", 2, 2, [bytes([200] * 4), bytes([128, 128])], span="full") == 200).all()
    assert U.to_rgb("bgra8", 1, 1, [bytes([1, 2, 3, 4])]).tolist() == [[[3, 2, 1]]]
    assert U.compact(b"abXcdX", 2, 2, 3).tobytes() == b"abcd"
    planes = U.split_packed("yuv420p", 3, 3, bytes(17))
    assert [len(p) for p in planes] == [9, 4, 4] and U.join_packed(planes) == bytes(17)
    red = U.to_rgb("yuv420p", 2, 2, [bytes([81] * 4), bytes([90]), bytes([240])], space="bt601")
    assert red[0, 0, 0] > 250 and red[0, 0, 1] < 5
    with pytest.raises(MediaError):
        U.split_packed("rgb8", 2, 2, b"1")


def test_surfaces_as_rows(spark):
    df = spark.createDataFrame([(1, "rgb8", 1, 1, [bytearray(b"abc")], None, None)], "k long, format string, w int, h int, planes array<binary>, colour_space string, colour_range string")
    assert bytes(FR.surfaces_to_rgb(df).first().data) == b"abc"


def test_frames_of_many_sizes(spark):
    a = generate.gradient(spark, 5, 8, 6, 10.0, "a").unionByName(generate.gradient(spark, 3, 4, 4, 10.0, "b"))
    out = FR.apply(a, [K.HFlip(), K.Resize(3, 2, "nearest"), K.Invert()])
    assert {(r.w, r.h, len(r.data)) for r in out.collect()} == {(3, 2, 18)} and out.count() == 8
    assert FR.apply(a.where("false"), [K.Invert()]).count() == 0
    with pytest.raises(ParamError):
        K.Crop(0, 0, 9, 9).size(8, 8)


def test_time_filter_reaches_below_the_kernels(spark):
    plan = FR.apply(generate.gradient(spark, 50, 8, 6, 10.0), [K.Invert()])
    clip = __import__("lumitide").Clip(generate.gradient(spark, 50, 8, 6, 10.0), 5_000_000, 8, 6, 10.0).kernel(K.Invert())
    assert clip.frame_at(1_000_000).count() == 1 and plan.count() == 50


def test_png(spark):
    data = write.thumbnail(generate.solid(spark, 2, 2, (1, 2, 3), 1_000_000), 0)
    assert data.startswith(b"\x89PNG") and write.thumbnail(generate.solid(spark, 2, 2, (1, 2, 3), 1_000_000), 2_000_000) is None


def test_text():
    px = generate.raster("Hi\n?", (255, 0, 0), 16)
    assert px.shape == (32, 24, 4) and px[..., 3].any() and generate.layout("") == (0, 8, [])


def test_premultiply_round_trip(spark):
    rgba = np.concatenate([PX, np.full((2, 9, 7, 1), 255, np.uint8)], -1)
    assert np.array_equal(K.Unpremultiply()(K.Premultiply()(rgba, AT), AT), rgba)
    clear = rgba.copy()
    clear[..., 3] = 0
    assert not K.Unpremultiply()(clear, AT)[..., :3].any()
    assert K.DropAlpha()(rgba, AT).shape[-1] == 3
    assert np.array_equal(K.Premultiply()(clear, AT).reshape(2, -1), columns(spark, clear, lambda px: P.premultiply(px, 7, 9)))


def test_chroma_and_over():
    assert K.chroma_mask(PX, tuple(int(v) for v in PX[0, 0, 0]), 0)[0, 0, 0] == 0
    dst = np.zeros((4, 4, 3), np.uint8)
    K.over(dst, np.full((2, 2, 3), 255, np.uint8), 3, 3, 0.5)
    assert dst[3, 3].tolist() == [128] * 3 and dst.sum() == 3 * 128
    K.over(dst, np.full((2, 2, 3), 255, np.uint8), 9, 9, 1.0)


def test_head_blur():
    out = K.HeadBlur(((0.0, 3.0, 4.0),), 2.0, 1.0)(PX, AT)
    assert np.array_equal(out[:, 0], PX[:, 0]) and not np.array_equal(out[0, 4, 3], PX[0, 4, 3])
