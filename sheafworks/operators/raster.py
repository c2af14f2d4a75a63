"""Pixel tables: crop, turn, resample, character art, blur, key, palette, icons, layouts, colour history."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheafworks.functions import colors
from sheafworks.functions.tables import half_up, ranked

#: Characters from dark to light; icon sizes, and those of them in the icon file.
RAMP = "@%#*+=-:. "
ICONS, ICO = (16, 32, 48, 64, 128, 180, 192, 512), (16, 32, 48)
RGBA = ("r", "g", "b", "a")


def framed(pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Pixels with their picture's width and height, without other columns."""
    return pixels.select("image_id", "x", "y", *RGBA).join(dims.select("image_id", "width", "height"), "image_id")


def crop_pixels(pixels: DataFrame, dims: DataFrame, x: int, y: int, w: int, h: int) -> DataFrame:
    """Pixels in the rectangle, which is clamped to the picture; coordinates start again at 0."""
    p = framed(pixels, dims)
    x0, y0 = F.greatest(F.lit(0), F.least(F.lit(x), F.col("width") - 1)), F.greatest(F.lit(0), F.least(F.lit(y), F.col("height") - 1))
    p = p.withColumn("_x", x0).withColumn("_y", y0)
    w1, h1 = F.greatest(F.lit(1), F.least(F.lit(w), F.col("width") - F.col("_x"))), F.greatest(F.lit(1), F.least(F.lit(h), F.col("height") - F.col("_y")))
    p = p.where((F.col("x") >= F.col("_x")) & (F.col("x") < F.col("_x") + w1) & (F.col("y") >= F.col("_y")) & (F.col("y") < F.col("_y") + h1))
    return p.select("image_id", (F.col("x") - F.col("_x")).alias("x"), (F.col("y") - F.col("_y")).alias("y"), *RGBA)


def rotate_flip_pixels(pixels: DataFrame, dims: DataFrame, angle: int, flip_h: bool = False, flip_v: bool = False) -> DataFrame:
    """Flipped, then turned clockwise by 0, 90, 180 or 270."""
    p = framed(pixels, dims)
    w, h = F.col("width"), F.col("height")
    x = w - 1 - F.col("x") if flip_h else F.col("x")
    y = h - 1 - F.col("y") if flip_v else F.col("y")
    nx, ny = {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[angle % 360]
    return p.select("image_id", nx.cast("int").alias("x"), ny.cast("int").alias("y"), *RGBA)


def fit_dims(dims: DataFrame, max_dim: int) -> DataFrame:
    """Adds new_width, new_height: the longer side at most max_dim, never larger than before."""
    scale = F.lit(float(max_dim)) / F.greatest("width", "height")
    side = lambda c: F.when(F.greatest("width", "height") > max_dim, F.greatest(F.lit(1), half_up(F.col(c) * scale))).otherwise(F.col(c)).cast("int")
    return dims.withColumns({"new_width": side("width"), "new_height": side("height")})


def resize_dims(dims: DataFrame, width: int | None = None, pct: int | None = None) -> DataFrame:
    """Adds new_width, new_height: a width with the ratio kept, or a percentage of both."""
    if width is not None:
        ratio = F.col("width").cast("double") / F.col("height")
        new = F.lit(width), half_up(F.lit(float(width)) / ratio)
    else:
        new = tuple(half_up(F.col(c) * F.lit(pct / 100)) for c in ("width", "height"))
    return dims.withColumns({n: F.greatest(F.lit(1), v).cast("int") for n, v in zip(("new_width", "new_height"), new, strict=True)})


def watermark_tiles(dims: DataFrame, text_width: float, size: float) -> DataFrame:
    """(image_id, x, y) of the stamps from -diagonal up to the diagonal. Rows are spread before they multiply."""
    step_x, step_y = max(text_width + 2 * size, 40.0), max(3 * size, 40.0)
    w, h = F.col("width").cast("double"), F.col("height").cast("double")
    d = dims.select("image_id", F.sqrt(w * w + h * h).alias("diag")).repartition("image_id")
    last = lambda step: (F.ceil(F.col("diag") * 2.0 / F.lit(step)) - 1).cast("int")
    d = d.select("image_id", "diag", F.explode(F.sequence(F.lit(0), last(step_y))).alias("j")).select("image_id", "diag", "j", F.explode(F.sequence(F.lit(0), last(step_x))).alias("i"))
    return d.select("image_id", (-F.col("diag") + F.col("i") * F.lit(step_x)).alias("x"), (-F.col("diag") + F.col("j") * F.lit(step_y)).alias("y"))


def resize_pixels(pixels: DataFrame, dims: DataFrame, w: int, h: int) -> DataFrame:
    """Shrinking: mean of the pixels that fall in a cell. Growing: the nearest pixel, by a generated grid and a join."""
    pixels, d = pixels.select("image_id", "x", "y", *RGBA), dims.select("image_id", "width", "height")
    d = d.withColumn("_grow", (F.col("width") < w) | (F.col("height") < h))
    p = pixels.join(d, "image_id")
    cell = lambda c, n, side: F.floor(F.col(c) * F.lit(n) / F.col(side)).cast("int")
    small = p.where(~F.col("_grow")).groupBy("image_id", cell("x", w, "width").alias("nx"), cell("y", h, "height").alias("ny")).agg(*[half_up(F.avg(c)).cast("int").alias(c) for c in RGBA])
    grid = d.where("_grow").select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("nx")).select("*", F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("ny"))
    grid = grid.select("image_id", "nx", "ny", F.floor(F.col("nx") * F.col("width") / F.lit(w)).cast("int").alias("x"), F.floor(F.col("ny") * F.col("height") / F.lit(h)).cast("int").alias("y"))
    large = grid.join(pixels, ["image_id", "x", "y"]).select("image_id", "nx", "ny", *RGBA)
    out = small.unionByName(large)
    return out.select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), *RGBA)


def ascii_cells(pixels: DataFrame, dims: DataFrame, cols: int, invert: bool = False) -> DataFrame:
    """(image_id, x, y, r, g, b, ch): one character for each cell, twice as tall as wide."""
    rows = F.greatest(F.lit(1), half_up(F.lit(cols) * (F.col("height") / F.col("width")) * 0.5)).cast("int")
    p = pixels.select("image_id", "x", "y", *"rgb").join(dims.select("image_id", "width", "height", rows.alias("_rows")), "image_id")
    nx, ny = F.floor(F.col("x") * cols / F.col("width")).cast("int"), F.floor(F.col("y") * F.col("_rows") / F.col("height")).cast("int")
    c = p.groupBy("image_id", nx.alias("nx"), ny.alias("ny")).agg(*[half_up(F.avg(k)).cast("int").alias(k) for k in "rgb"])
    light = colors.luminance(F.col("r"), F.col("g"), F.col("b"), colors.SCREEN) / 255.0
    ramp = RAMP[::-1] if invert else RAMP
    at = F.least(F.lit(len(ramp) - 1), F.floor((F.lit(1.0) - light) * len(ramp))).cast("int")
    return c.select("image_id", F.col("nx").alias("x"), F.col("ny").alias("y"), "r", "g", "b", F.substring(F.lit(ramp), at + 1, F.lit(1)).alias("ch"))


def ascii_art(pixels: DataFrame, dims: DataFrame, cols: int, invert: bool = False) -> DataFrame:
    """(image_id, art): lines joined by newlines."""
    put = lambda order, piece, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, piece))), lambda v: v[piece]), sep)
    lines = ascii_cells(pixels, dims, cols, invert).groupBy("image_id", "y").agg(put("x", "ch", "").alias("line"))
    return lines.groupBy("image_id").agg(put("y", "line", "\n").alias("art"))


def kernel(radius: float) -> list[float]:
    """Gaussian weights with sigma = radius, cut at three sigma, of sum 1."""
    reach = math.ceil(3 * radius)
    w = [math.exp(-(k * k) / (2 * radius * radius)) for k in range(-reach, reach + 1)]
    return [v / sum(w) for v in w]


#: Side of the squares that pixels are blurred in, without what they need of their neighbours.
TILE = 256


def along(x: np.ndarray, weights: np.ndarray, axis: int) -> np.ndarray:
    """Weighted sums along an axis; what is outside counts as nothing."""
    reach, n = len(weights) // 2, x.shape[axis]
    padded = np.pad(x, [(reach, reach) if k == axis else (0, 0) for k in range(2)])
    return sum(w * padded[tuple(slice(k, k + n) if axis == d else slice(None) for d in range(2))] for k, w in enumerate(weights))


def softened(block: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Channels r, g, b (times a / 255) and a of a block, blurred, as whole numbers that are no more premultiplied."""
    r, g, b, a = (along(along(c, weights, 1), weights, 0) for c in block)
    solid = np.where(a > 0, a, 1.0)
    colours = [np.where(a > 0, np.minimum(255.0, c * 255.0 / solid), 0.0) for c in (r, g, b)]
    return np.floor(np.stack([*colours, a]) + 1e-9 + 0.5).astype(np.int32)


def blur_pixels(pixels: DataFrame, dims: DataFrame, radius: float) -> DataFrame:
    """Pixel rows, blurred on premultiplied colours; edges fade. Pixels that nothing reaches give no row.

    Pictures are cut to tiles; a pixel goes to its own tile and to those whose pixels it reaches, and a tile is one block of
    numbers, so that a picture of any size is many tasks of bounded memory.
    """
    weights = np.array(kernel(radius))
    reach = len(weights) // 2
    tile = max(TILE, reach)
    p = framed(pixels, dims)
    p = p.where(F.col("x").between(-reach, F.col("width") + reach - 1) & F.col("y").between(-reach, F.col("height") + reach - 1))
    tiles = lambda c, side: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - reach, F.lit(0)) / tile), F.floor(F.least(F.col(c) + reach, F.col(side) - 1) / tile)))
    p = p.select("*", tiles("x", "width").alias("tx")).select("*", tiles("y", "height").alias("ty"))

    def blur(image, tx: int, ty: int, t: dict) -> dict:
        left, top = tx * tile, ty * tile
        w, h = min(tile, int(t["width"][0]) - left), min(tile, int(t["height"][0]) - top)
        x, y = (t[c].astype(np.int64) - at + reach for c, at in (("x", left), ("y", top)))
        block, here = np.zeros((4, h + 2 * reach, w + 2 * reach)), np.zeros((h + 2 * reach, w + 2 * reach))
        values = [t[c].astype(np.float64) for c in RGBA]
        for c, v in zip(block, [*(v * (values[3] / 255.0) for v in values[:3]), values[3]], strict=True):
            np.add.at(c, (y, x), v)
        here[y, x] = 1.0
        inner = (slice(reach, reach + h), slice(reach, reach + w))
        reached = along(along(here, np.ones(len(weights)), 1), np.ones(len(weights)), 0)[inner] > 0
        out = softened(block, weights)[:, inner[0], inner[1]]
        ys, xs = np.nonzero(reached)
        return {"image_id": pa.repeat(image, len(xs)), "x": (xs + left).astype(np.int32), "y": (ys + top).astype(np.int32), **{c: out[k][ys, xs] for k, c in enumerate(RGBA)}}

    def blur_all(batches):
        """Rows come by tile; a tile may go on in the next batch."""
        kept: list[pa.RecordBatch] = []

        def tiles_of(parts):
            t = pa.Table.from_batches(parts).combine_chunks()
            ids, cols = t.column("image_id"), {c: t.column(c).to_numpy() for c in t.column_names if c != "image_id"}
            who = ids.dictionary_encode("encode").combine_chunks().indices.to_numpy() if t.num_rows else np.empty(0, np.int32)
            new = np.nonzero((who[1:] != who[:-1]) | (cols["tx"][1:] != cols["tx"][:-1]) | (cols["ty"][1:] != cols["ty"][:-1]))[0] + 1
            edge = [0, *new.tolist(), len(who)]
            return t, cols, edge

        def done(t, cols, edge):
            out = [blur(t.column("image_id")[i], int(cols["tx"][i]), int(cols["ty"][i]), {c: v[i:j] for c, v in cols.items()}) for i, j in zip(edge[:-1], edge[1:], strict=True)]
            columns = {c: pa.concat_arrays([o[c] for o in out]) if c == "image_id" else np.concatenate([o[c] for o in out]) for c in ("image_id", "x", "y", *RGBA)}
            yield from pa.table(columns).to_batches()

        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) < 100_000:
                continue
            t, cols, edge = tiles_of(kept)
            if len(edge) > 2:
                yield from done(t, cols, edge[:-1])
            kept = t.slice(edge[-2]).to_batches()
        if kept:
            t, cols, edge = tiles_of(kept)
            if edge[-1]:
                yield from done(t, cols, edge)

    schema = T.StructType([pixels.schema["image_id"], *[T.StructField(c, T.IntegerType()) for c in ("x", "y", *RGBA)]])
    return p.repartition("image_id", "tx", "ty").sortWithinPartitions("image_id", "tx", "ty").mapInArrow(blur_all, schema)


def blur_rasters(rasters: DataFrame, radius: float) -> DataFrame:
    """Raster form: one row for each picture, no shuffle; numpy on the lists of Arrow batches, one picture at a time."""
    weights = np.array(kernel(radius))

    def blur(batches):
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = dict(zip(names, batch.columns, strict=True))
                size = (row["height"][i].as_py(), row["width"][i].as_py())
                block = np.stack([row[c].slice(i, 1).flatten().to_numpy().astype(np.float64).reshape(size) for c in RGBA])
                block[:3] *= block[3] / 255.0
                new = dict(zip(RGBA, softened(block, weights), strict=True))
                lists = lambda v: pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(v.ravel()))
                yield pa.RecordBatch.from_arrays([lists(new[c]) if c in new else row[c].slice(i, 1) for c in names], names=names)

    return rasters.mapInArrow(blur, rasters.schema)


def raster_pixels(rasters: DataFrame) -> DataFrame:
    """Rasters as pixel rows."""
    p = rasters.select("image_id", "width", F.posexplode(F.arrays_zip(*RGBA)).alias("p", "v"))
    return p.select("image_id", (F.col("p") % F.col("width")).alias("x"), F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), *[F.col(f"v.{c}").alias(c) for c in RGBA])


def pick_colors(clicks: DataFrame, pixels: DataFrame, dims: DataFrame) -> DataFrame:
    """Adds the colour under each click; the join key is the pixel, so that a popular picture is spread."""
    c = clicks.join(dims, "image_id")
    at = lambda f, side: F.greatest(F.lit(0), F.least(F.col(side) - 1, F.floor(F.col(f) * F.col(side)))).cast("int")
    c = c.withColumn("x", at("fx", "width")).withColumn("y", at("fy", "height")).drop("width", "height")
    p = c.join(pixels, ["image_id", "x", "y"])
    h, s, light = colors.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    text = lambda *parts: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in parts])
    rgb, hsl = text("rgb(", F.col("r"), ", ", F.col("g"), ", ", F.col("b"), ")"), text("hsl(", h, ", ", s, "%, ", light, "%)")
    return p.select("event_id", "user_id", "ts", "image_id", "x", "y", colors.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex"), rgb.alias("rgb"), hsl.alias("hsl"))


def pick_history(picks: DataFrame, k: int = 16) -> DataFrame:
    """(user_id, history): newest first; a colour in the list is ignored, beyond k the oldest drops out.

    A user's picks are rows of one task in order, of which only the history is kept, however many they are.
    """

    def follow(batches):
        user, history, some = None, [], False
        for batch in batches:
            users, out = [], []
            who, what = (batch.column(k).dictionary_encode("encode") for k in range(2))
            u, c = (x.indices.to_numpy() for x in (who, what))
            names, colours = who.dictionary.to_pylist(), what.dictionary.to_pylist()
            # a colour that its user's last pick had changes nothing; those without a colour are all kept
            none = np.array([x is None for x in colours], bool)[c]
            at = np.nonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (c[1:] != c[:-1]) | none[1:]]))[0] if len(u) else []
            for i in at:
                if some and names[u[i]] != user:
                    users.append(user)
                    out.append(history)
                    history = []
                user, some, color = names[u[i]], True, colours[c[i]]
                if color is None or color not in history:
                    history = [color, *history][:k]
            kind = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(users, kind), pa.array(out, pa.list_(pa.string()))], names=["user_id", "history"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([user], kind), pa.array([history], pa.list_(pa.string()))], names=["user_id", "history"])

    ordered = picks.repartition("user_id").sortWithinPartitions("user_id", "ts", "event_id", "hex").select("user_id", "hex")
    return ordered.mapInArrow(follow, T.StructType([picks.schema["user_id"], T.StructField("history", T.ArrayType(T.StringType()))]))


def chroma_key(pixels: DataFrame, tolerance: float, feather: float) -> DataFrame:
    """Transparent where the colour is near that of the picture's first pixel, softened in the feather band."""
    key = pixels.where("x = 0 and y = 0").select("image_id", *[F.col(c).alias(f"_{c}") for c in "rgb"])
    p = pixels.select("image_id", "x", "y", *RGBA).join(key, "image_id")
    sq = lambda c: (F.col(c) - F.col(f"_{c}")) * (F.col(c) - F.col(f"_{c}"))
    p = p.withColumn("_d", F.sqrt((sq("r") + sq("g") + sq("b")).cast("double")))
    t = (F.col("_d") - F.lit(float(tolerance))) / F.lit(float(max(1, feather)))
    soft = half_up(F.col("a") * t).cast("int")
    a = F.when(F.col("_d") <= tolerance, 0).when(F.col("_d") < tolerance + feather, soft).otherwise(F.col("a"))
    return p.withColumn("a", a).select("image_id", "x", "y", *RGBA)


def gray_palette(palette: DataFrame, indexed: DataFrame) -> DataFrame:
    """(image_id, x, y, gray): the palette turned grey, the indexes looked up."""
    gray = half_up(colors.luminance(F.col("r"), F.col("g"), F.col("b"))).cast("int")
    return indexed.join(palette.select("image_id", "idx", gray.alias("gray")), ["image_id", "idx"]).select("image_id", "x", "y", "gray")


def icon_set(dims: DataFrame) -> DataFrame:
    """Each picture in each icon size: cover-fit scale, centring offsets, whether it goes into the icon file."""
    size = F.explode(F.array(*[F.lit(s) for s in ICONS])).alias("size")
    d = dims.select("image_id", "width", "height", size)
    d = d.withColumn("scale", F.greatest(F.col("size").cast("double") / F.col("width"), F.col("size").cast("double") / F.col("height")))
    off = lambda side: (F.col("size") - F.col(side) * F.col("scale")) / 2.0
    return d.select("image_id", "size", "scale", off("width").alias("dx"), off("height").alias("dy"), F.col("size").isin(*ICO).alias("in_ico"))


def border_pixels(pixels: DataFrame, dims: DataFrame, width: int, color: tuple[int, int, int]) -> DataFrame:
    """Pictures moved by width, with a frame of colour all round."""
    moved = pixels.select("image_id", (F.col("x") + width).alias("x"), (F.col("y") + width).alias("y"), *RGBA)
    d = dims.select("image_id", "width", "height", F.explode(F.sequence(F.lit(0), F.col("width") + 2 * width - 1)).alias("x"))
    d = d.select("*", F.explode(F.sequence(F.lit(0), F.col("height") + 2 * width - 1)).alias("y"))
    inside = F.col("x").between(width, F.col("width") + width - 1) & F.col("y").between(width, F.col("height") + width - 1)
    frame = d.where(~inside).select("image_id", "x", "y", *[F.lit(v).alias(c) for c, v in zip(RGBA, (*color, 255), strict=True)])
    return moved.unionByName(frame)


def collage_layout(dims: DataFrame, bundle: str, cols: int, cell: int, gap: int) -> DataFrame:
    """Row and column of each picture of a bundle, cell origin, cover-fit scale and offsets, canvas size."""
    d = dims.select(F.col(bundle).alias("bundle"), "image_id", "width", "height")
    d = ranked(d, ["bundle"], ["image_id"], "nth", "total").withColumn("nth", (F.col("nth") - 1).cast("int"))
    d = d.withColumn("rows", F.ceil(F.col("total") / F.lit(cols)).cast("int")).withColumn("col", F.col("nth") % cols).withColumn("row", F.floor(F.col("nth") / cols).cast("int"))
    d = d.withColumn("cx", gap + F.col("col") * (cell + gap)).withColumn("cy", gap + F.col("row") * (cell + gap))
    d = d.withColumn("scale", F.greatest(F.lit(float(cell)) / F.col("width"), F.lit(float(cell)) / F.col("height")))
    off = lambda at, side: F.col(at) + (F.lit(cell) - F.col(side) * F.col("scale")) / 2.0
    return d.select(F.col("bundle").alias(bundle), "image_id", "row", "col", "cx", "cy", "scale", off("cx", "width").alias("dx"), off("cy", "height").alias("dy"), F.lit(cols * cell + (cols + 1) * gap).alias("canvas_w"), (F.col("rows") * cell + (F.col("rows") + 1) * gap).alias("canvas_h"))
