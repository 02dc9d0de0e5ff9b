"""Arithmetic of images and boxes: tilings, patch orders, token layouts, resizing and clipping."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.arrays import let


def tilings(most: int) -> list[tuple[int, int]]:
    return sorted(((i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most), key=lambda t: (t[0] * t[1], t[0]))


def select_tiling(h: Column, w: Column, patch: int, most: int) -> Column:
    """The tiling (rows, columns) that an image fits with least enlarging, or if it must shrink, least shrinking."""
    options = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(i).alias("rows"), F.lit(j).alias("cols"), F.least(F.lit(float(i * patch)) / h, F.lit(float(j * patch)) / w).alias("scale")) for n, (i, j) in enumerate(tilings(most))])
    up = F.filter(options, lambda o: o["scale"] >= 1)
    key = lambda o, sign: F.struct((sign * o["scale"]).alias("s"), o["n"].alias("n"), o["rows"].alias("rows"), o["cols"].alias("cols"))
    best_up = F.array_min(F.transform(up, lambda o: key(o, 1)))
    best_down = F.array_min(F.transform(options, lambda o: key(o, -1)))
    return F.when(F.size(up) > 0, best_up).otherwise(best_down)


def inverse_permutation(order: Column) -> Column:
    """Places of 0, 1, 2 .. in a permutation."""
    return F.transform(F.array_sort(F.transform(order, lambda x, i: F.struct(x.alias("x"), i.alias("i")))), lambda p: p["i"])


def token_positions(tokens: Column, token: int, width: int) -> Column:
    """Where ``token`` stands, in rows of ``width``."""
    at = F.filter(F.transform(tokens, lambda t, i: F.when(t == token, i).otherwise(-1)), lambda i: i >= 0)

    def rows(a: Column) -> Column:
        n = F.floor(F.size(a) / width).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda r: F.slice(a, r * width + 1, width))).otherwise(F.array().cast("array<array<int>>"))

    return let(at, rows)


def patch_layout(rows: Column, cols: Column, patch: int, column_token: int, start: int | None = None, end: int | None = None) -> Column:
    """Tokens of a grid of patches: each row of patches and then a column token, all between start and end marks."""
    row = F.concat(F.array_repeat(F.lit(patch), cols), F.array(F.lit(column_token)))
    grid = F.flatten(F.array_repeat(row, rows))
    return F.concat(*([F.array(F.lit(start))] if start is not None else []), grid, *([F.array(F.lit(end))] if end is not None else []))


def denormalized(box: list[Column], h: Column, w: Column) -> list[Column]:
    """(ymin, xmin, ymax, xmax) in shares of the image as pixels."""
    return [box[0] * h, box[1] * w, box[2] * h, box[3] * w]


def resized(box: list[Column], scale_y: Column, scale_x: Column, offset: tuple[Column, Column], pad: tuple[Column, Column]) -> list[Column]:
    return [b * (scale_y if i % 2 == 0 else scale_x) - offset[i % 2] + pad[i % 2] for i, b in enumerate(box)]


def clipped(box: list[Column], h: Column, w: Column) -> list[Column]:
    return [F.greatest(F.least(b, h if i % 2 == 0 else w), F.lit(0.0)) for i, b in enumerate(box)]


def has_area(box: list[Column]) -> Column:
    return (box[2] - box[0] > 0) & (box[3] - box[1] > 0)


def fit_and_pad(h: Column, w: Column, out_h: int, out_w: int) -> dict[str, Column]:
    """Scale that fits an image into a frame, its size there, and the padding around it when centred."""
    scale = F.least(F.lit(float(out_h)) / h, F.lit(float(out_w)) / w)
    sh, sw = F.least(F.round(h * scale), F.lit(float(out_h))).cast("int"), F.least(F.round(w * scale), F.lit(float(out_w))).cast("int")
    top, left = F.floor((out_h - sh) / 2).cast("int"), F.floor((out_w - sw) / 2).cast("int")
    return {"scale": scale, "scaled_h": sh, "scaled_w": sw, "pad_top": top, "pad_left": left, "pad_bottom": F.lit(out_h) - sh - top, "pad_right": F.lit(out_w) - sw - left}


def random_resize(h: Column, w: Column, out_h: int, out_w: int, scale: Column, widest: Column, along: tuple[Column, Column], least_side: float = 64.0, most: float | None = None) -> dict[str, Column]:
    """Geometry of an image scaled by chance, cut and centred: ``scaled_h, scaled_w, offset_y, offset_x, pad_top, pad_left, inverse_scale``.

    ``scale`` times the frame is the size aimed at (``most`` bounds it); ``widest`` says whether the longer or the shorter side
    is to fit it; no side gets below ``least_side``; ``along`` are shares in [0, 1) of the room there is to cut from.
    """
    fh, fw = h.cast("double"), w.cast("double")
    factor = scale if most is None else F.least(F.greatest(F.lit(float(out_w)) / fw, F.lit(float(out_h)) / fh), scale)
    by, bx = F.floor(factor * out_h) / fh, F.floor(factor * out_w) / fw
    s = F.greatest(F.when(widest, F.greatest(bx, by)).otherwise(F.least(bx, by)), F.lit(least_side) / F.least(fh, fw))
    sh, sw = F.floor(fh * s).cast("int"), F.floor(fw * s).cast("int")
    oy, ox = (F.floor(F.greatest(F.lit(0), side - out) * u).cast("int") for side, out, u in ((sh, out_h, along[0]), (sw, out_w, along[1])))
    top, left = (F.floor((out - F.least(side - o, F.lit(out))) / 2).cast("int") for side, out, o in ((sh, out_h, oy), (sw, out_w, ox)))
    return {"scaled_h": sh, "scaled_w": sw, "offset_y": oy, "offset_x": ox, "pad_top": top, "pad_left": left, "inverse_scale": 1.0 / s}


def image_info(h: Column, w: Column, g: dict[str, Column]) -> Column:
    """Eleven numbers that map a cut image back: paddings, inverse scale, size, offsets as shares and pixels, scaled size."""
    fh, fw = h.cast("double"), w.cast("double")
    parts = [g["pad_top"], g["pad_left"], g["inverse_scale"], fh, fw, g["offset_y"] / fh, g["offset_x"] / fw, g["offset_y"], g["offset_x"], g["scaled_h"], g["scaled_w"]]
    return F.array(*[p.cast("double") for p in parts])


def image_mask(g: dict[str, Column], out_h: int, out_w: int) -> Column:
    """Rows of 1 where the frame shows the image and 0 where it is padded."""
    inside = lambda i, pad, side, off, out: (i >= pad) & (i < pad + F.least(side - off, F.lit(out)))
    row = F.transform(F.sequence(F.lit(0), F.lit(out_w - 1)), lambda x: F.when(inside(x, g["pad_left"], g["scaled_w"], g["offset_x"], out_w), 1).otherwise(0))
    return F.transform(F.sequence(F.lit(0), F.lit(out_h - 1)), lambda y: F.when(inside(y, g["pad_top"], g["scaled_h"], g["offset_y"], out_h), row).otherwise(F.array_repeat(F.lit(0), out_w)))


def flipped(box: list[Column], w: Column) -> list[Column]:
    """A box of an image seen in a mirror."""
    return [box[0], w - box[3], box[2], w - box[1]]


def is_tall(h: Column, w: Column) -> Column:
    """Whether an image is upright by four to three, and so is turned."""
    return h >= w * F.lit(4.0) / 3


def normalized(x: Column, offset: float, scale: float) -> Column:
    return F.transform(x, lambda v: (v - offset) / scale)


def unnormalized(x: Column, offset: float, scale: float) -> Column:
    return F.transform(x, lambda v: v * scale + offset)
