"""Registered queries on pixels, pictures, archives, colours and encodings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafworks.functions import colors, encoding
from sheafworks.functions.tables import read
from sheafworks.operators import archive, raster
from sheafworks.plans import fixtures as fx
from sheafworks.plans.fixtures import sql
from sheafworks.plans.page_queries import SIX, WIDTH, six

STEP_X, STEP_Y = max(WIDTH / 1000 * 48 + 96, 40.0), 144.0
FILTER = {"brightness": 1.2, "contrast": 0.9, "saturate": 1.5, "grayscale": 0.3, "sepia": 0.2, "hue_rotate": 30, "invert": 0.1}


def on_pixels(f, *args, **kw):
    return lambda s, d: f(fx.pixels(s, d), fx.pixel_dims(s, d), *args, **kw)


def on_mixed(f, *args, **kw):
    return lambda s, d: f(fx.mixed_pixels(s, d), fx.mixed_dims(s, d), *args, **kw)


def tiles(spark, d):
    t = raster.watermark_tiles(fx.image_dims(spark, d), WIDTH / 1000 * 48, 48)
    return t.select("image_id", six("x").alias("x"), six("y").alias("y"))


def picks(spark, d):
    return raster.pick_colors(fx.clicks(spark, d), fx.pixels(spark, d), fx.pixel_dims(spark, d))


def history(spark, d):
    return raster.pick_history(picks(spark, d), 16).select("user_id", F.array_join("history", ",").alias("history"))


def grayed(spark, d):
    p = fx.pixels(spark, d)
    palette = p.where("y < 2").select("image_id", (F.col("y") * 8 + F.col("x")).alias("idx"), "r", "g", "b")
    return raster.gray_palette(palette, p.select("image_id", "x", "y", (F.col("r") % 16).alias("idx")))


def laid_out(spark, d):
    dims = fx.image_dims(spark, d).join(read(spark, d, "part").select(F.col("p_partkey").alias("image_id"), F.col("p_brand").alias("brand")), "image_id")
    out = raster.collage_layout(dims, "brand", 4, 400, 8)
    return out.withColumns({c: six(c) for c in ("scale", "dx", "dy")})


def compressed(spark, d):
    return archive.compress_report(raster.fit_dims(fx.image_dims(spark, d), 1600))


def icons(spark, d):
    return raster.icon_set(fx.image_dims(spark, d)).withColumns({c: six(c) for c in ("scale", "dx", "dy")})


def ops(spark, d):
    o = colors.gray_color_ops(fx.color_ops(spark, d))
    return o.select("op_id", "op", F.array_join(F.transform("args", lambda v: F.floor(v * 1e6 + 0.5).cast("string")), ",").alias("args"))


def cmyk(spark, d):
    k = F.col("o_orderkey")
    parts = [((k * m) % 101).cast("double") / F.lit(100.0) for m in (7, 11, 15, 19)]
    r, g, b = colors.cmyk_to_rgb(*parts)
    return read(spark, d, "orders").select(k.alias("op_id"), *[(F.floor(x * 1e6 + 0.5) / F.lit(1e6)).alias(n) for n, x in zip("rgb", (r, g, b), strict=True)])


def hexes(spark, d):
    p = fx.pixels(spark, d).withColumn("hex", colors.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")))
    r, g, b = colors.hex_to_rgb(F.col("hex"))
    return p.select("image_id", "x", "y", "hex", r.alias("r2"), g.alias("g2"), b.alias("b2"))


def hsl(spark, d):
    h, s, light = colors.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"))
    return fx.pixels(spark, d).select("image_id", "x", "y", h.alias("h"), s.alias("s"), light.alias("l"))


def uris(spark, d):
    data = F.encode("text", "UTF-8")
    return read(spark, d, "documents").select("doc_id", encoding.to_data_uri(F.lit("text/plain"), data).alias("uri"), encoding.to_data_uri(F.lit(""), data, False).alias("bare"))


def parsed(spark, d):
    uri = F.concat(F.lit(" "), encoding.to_data_uri(F.when(F.col("doc_id") % 2 == 0, "image/webp").otherwise(""), F.encode("text", "UTF-8")), F.lit("\n"))
    mime, data, ext = encoding.parse_data_uri(uri)
    return read(spark, d, "documents").select("doc_id", mime.alias("mime"), F.decode(data, "UTF-8").alias("text"), ext.alias("ext"))


def hexed(spark, d):
    coded = encoding.hex_encode(F.col("text"))
    return read(spark, d, "documents").select("doc_id", coded.alias("hex"), F.decode(encoding.hex_decode(F.concat(F.lit("zz "), coded, F.lit("4"))), "ISO-8859-1").alias("back"))


def dates(spark, d):
    day, time = encoding.dos_datetime(F.col("ts"))
    return read(spark, d, "events").select("event_id", encoding.pdf_date(F.col("ts")).alias("pdf_date"), day.alias("dos_date"), time.alias("dos_time"))


def infos(spark, d):
    i = fx.doc_info(spark, d)
    join = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    edited = encoding.edit_info(F.col("info"), {"Title": F.lit(""), "Subject": F.lit("new")}, F.lit("2024-05-06 07:08:09").cast("timestamp"))
    return i.select("doc_id", join(encoding.view_info(F.col("info"))).alias("viewed"), join(edited).alias("edited"), F.size(encoding.strip_info()).alias("n_stripped"))


def summaries(spark, d):
    size, mega, turned = encoding.image_summary(F.col("width"), F.col("height"), F.col("orientation"))
    return fx.image_dims(spark, d).select("image_id", size.alias("dimensions"), mega.alias("megapixels"), "mime", turned.alias("turned"))


def names(spark, d):
    return read(spark, d, "pages").select("page_id", encoding.suggest_name(F.col("url"), "small", "webp").alias("named"), encoding.suggest_name(F.col("url"), "").alias("same"))


def manifest(spark, d):
    return archive.archive_manifest(fx.entries(spark, d)).select("archive", "entry_no", "method", "payload", "crc", "offset", "central_size")


QUERIES = {
    "watermark_tiles": tiles,
    "gray_color_ops": ops,
    "crop_pixels": on_pixels(raster.crop_pixels, 2, 3, 4, 99),
    "rotate_90_flip_h": on_pixels(raster.rotate_flip_pixels, 90, True, False),
    "rotate_180_flip_v": on_pixels(raster.rotate_flip_pixels, 180, False, True),
    "crop_mixed_sizes": on_mixed(raster.crop_pixels, 5, 1, 3, 4),
    "rotate_mixed_sizes": on_mixed(raster.rotate_flip_pixels, 270, True, False),
    "rotate_none_mixed_sizes": on_mixed(raster.rotate_flip_pixels, 0, False, True),
    "resize_mixed_sizes": on_mixed(raster.resize_pixels, 6, 5),
    "ascii_mixed_sizes": on_mixed(raster.ascii_cells, 3),
    "fit_dims": lambda s, d: raster.fit_dims(fx.image_dims(s, d), 1600).select("image_id", "new_width", "new_height"),
    "resize_width": lambda s, d: raster.resize_dims(fx.image_dims(s, d), width=333).select("image_id", "new_width", "new_height"),
    "resize_percent": lambda s, d: raster.resize_dims(fx.image_dims(s, d), pct=50).select("image_id", "new_width", "new_height"),
    "pick_colors": picks,
    "chroma_key": lambda s, d: raster.chroma_key(fx.pixels(s, d), 40, 20),
    "gray_palette": grayed,
    "icon_set": icons,
    "compress_report": compressed,
    "shrink_pixels": on_pixels(raster.resize_pixels, 4, 3),
    "grow_pixels": on_pixels(raster.resize_pixels, 12, 12),
    "ascii_art": on_pixels(raster.ascii_art, 6),
    "ascii_art_inverted": on_pixels(raster.ascii_art, 6, True),
    "ascii_cells": on_pixels(raster.ascii_cells, 6),
    "blur_pixels": on_pixels(raster.blur_pixels, 1),
    "blur_rasters": lambda s, d: raster.raster_pixels(raster.blur_rasters(fx.rasters(s, d), 1)),
    "collage_layout": laid_out,
    "archive_manifest": manifest,
    "icon_directory": lambda s, d: archive.icon_directory(fx.entries(s, d).select("archive", "entry_no", "size")),
    "delta_decode": lambda s, d: archive.delta_decode(fx.samples(s, d)),
    "pick_history": history,
    "border_pixels": on_pixels(raster.border_pixels, 2, (255, 0, 0)),
    "gray_pixels": lambda s, d: colors.gray_pixels(fx.pixels(s, d)),
    "cmyk_to_rgb": cmyk,
    "rgb_hex": hexes,
    "rgb_to_hsl": hsl,
    "css_filter": lambda s, d: colors.css_filter(fx.pixels(s, d), **FILTER),
    "flatten_alpha": lambda s, d: colors.flatten_alpha(fx.pixels(s, d)),
    "to_data_uri": uris,
    "parse_data_uri": parsed,
    "hex_coding": hexed,
    "format_bytes": lambda s, d: fx.entries(s, d).select("entry_no", encoding.format_bytes(F.col("size") * F.col("entry_no") * F.col("entry_no")).alias("shown")),
    "suggest_name": names,
    "dates": dates,
    "doc_info": infos,
    "image_summary": summaries,
}

CLAMP = "least(255e0, greatest(0e0, {0}))"


def filter_sql() -> str:
    """The chain as nested selects, with the same order of operations."""
    inner = "select image_id, x, y, a, " + ", ".join(f"{CLAMP.format(f'{c}*1.2::double')} as {c}" for c in "rgb") + " from pixels"
    inner = "select image_id, x, y, a, " + ", ".join(f"{CLAMP.format(f'({c}-127.5::double)*0.9::double+127.5::double')} as {c}" for c in "rgb") + f" from ({inner})"
    for m in colors.filter_matrices(1.5, 0.3, 0.2, 30):
        cols = ", ".join(f"{CLAMP.format(f'{m[i][0]!r}::double*r+{m[i][1]!r}::double*g+{m[i][2]!r}::double*b')} as {c}" for i, c in enumerate("rgb"))
        inner = f"select image_id, x, y, a, {cols} from ({inner})"
    inner = "select image_id, x, y, a, " + ", ".join(f"{CLAMP.format(f'{c}*{1 - 2 * 0.1!r}::double+{255.0 * 0.1!r}::double')} as {c}" for c in "rgb") + f" from ({inner})"
    return sql("select image_id, x, y, " + ", ".join(f"cast(floor({c}+0.5e0) as int) as {c}" for c in "rgb") + f", a from ({inner})", "pixels")


CELL = "substr('{0}', cast(least(9, floor((1e0-(0.299::double*r+0.587::double*g+0.114::double*b)/255e0)*10)) as int)+1, 1)"


def ascii_sql(ramp: str, art: bool = True) -> str:
    cells = "select image_id, x*6//8 as nx, y*3//8 as ny, cast(floor(avg(r)+0.5e0) as int) as r, cast(floor(avg(g)+0.5e0) as int) as g, cast(floor(avg(b)+0.5e0) as int) as b from pixels group by all"
    ch = CELL.format(ramp)
    if not art:
        return sql(f"select image_id, nx as x, ny as y, r, g, b, {ch} as ch from ({cells})", "pixels")
    return sql(f"select image_id, string_agg(line, chr(10) order by ny) as art from (select image_id, ny, string_agg({ch}, '' order by nx) as line from ({cells}) group by image_id, ny) group by image_id", "pixels")


def blur_sql() -> str:
    w = raster.kernel(1)
    taps = "(values " + ", ".join(f"({k - 3}, {v!r}::double)" for k, v in enumerate(w)) + ") t(k, w)"
    pre = "select image_id, x, y, r*(a/255e0) as r, g*(a/255e0) as g, b*(a/255e0) as b, a::double as a from pixels"
    one = f"select image_id, x+k as x, y, sum(r*w) as r, sum(g*w) as g, sum(b*w) as b, sum(a*w) as a from ({pre}) join {taps} on true group by image_id, x+k, y"
    two = f"select image_id, x, y+k as y, sum(r*w) as r, sum(g*w) as g, sum(b*w) as b, sum(a*w) as a from ({one}) join {taps} on true group by image_id, x, y+k"
    return sql("select image_id, x, y, " + ", ".join(f"cast(floor(least(255e0, {c}*255e0/a)+1e-9+0.5e0) as int) as {c}" for c in "rgb") + f", cast(floor(a+1e-9+0.5e0) as int) as a from ({two}) where x between 0 and 7 and y between 0 and 7", "pixels")


HSL = """cast(floor(case when d = 0 then 0e0 when mx = r then ((g-b)/d + case when g < b then 6e0 else 0e0 end)/6e0 when mx = g then ((b-r)/d+2e0)/6e0 else ((r-g)/d+4e0)/6e0 end*360+0.5e0) as int) as h,
cast(floor(case when d = 0 then 0e0 when l > 0.5e0 then d/(2e0-mx-mn) else d/(mx+mn) end*100+0.5e0) as int) as s, cast(floor(l*100+0.5e0) as int) as l"""
HSL_FROM = "(select *, mx-mn as d, (mx+mn)/2e0 as l from (select *, greatest(r,g,b) as mx, least(r,g,b) as mn from (select * replace (r/255e0 as r, g/255e0 as g, b/255e0 as b) from {0})))"
HEX = "'#'||lower(lpad(to_hex(r), 2, '0')||lpad(to_hex(g), 2, '0')||lpad(to_hex(b), 2, '0'))"
PICK = f"select c.*, {HEX} as hex, r, g, b from (select event_id, user_id, ts, image_id, cast(greatest(0, least(7, floor(fx*8))) as int) as x, cast(greatest(0, least(7, floor(fy*8))) as int) as y from clicks) c join pixels p using (image_id, x, y)"
FIT = "case when greatest(width,height) > 1600 then greatest(1, cast(floor({0}*(1600e0/greatest(width,height))+0.5e0) as int)) else {0} end"
PIX = "image_id, {0} as x, {1} as y, r, g, b, a"
GROUPED = "cast(floor(avg(r)+0.5e0) as int) as r, cast(floor(avg(g)+0.5e0) as int) as g, cast(floor(avg(b)+0.5e0) as int) as b, cast(floor(avg(a)+0.5e0) as int) as a"
LUM = "0.3::double*{r}+0.59::double*{g}+0.11::double*{b}"
CMYK = LUM.format(**{c: f"(1e0-least(1e0, args[{i}]+args[4]))" for c, i in zip("rgb", (1, 2, 3), strict=True)})
RGB3 = LUM.format(r="args[1]", g="args[2]", b="args[3]")
GRAY = f"case when op in ('rg','RG') then {RGB3} when op in ('k','K') then {CMYK} when op in ('sc','SCN') then case len(args) when 1 then args[1] when 3 then {RGB3} when 4 then {CMYK} end end"
SIZE = "size*entry_no*entry_no"
#: The low bytes of a character's UTF-16 units.
UNITS = "case when unicode(c) < 65536 then [unicode(c) & 255] else [((unicode(c) - 65536) >> 10) & 255, unicode(c) & 255] end"


def crc_sql(data: str) -> str:
    """CRC-32 of a string's UTF-8 bytes, by the usual table of 256 remainders."""
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    octets = f"list_transform(regexp_extract_all(hex(encode({data})), '..'), lambda h: ('0x' || h)::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, {octets}), lambda crc, b: xor(crc >> 8, ({table}::bigint[])[(xor(crc, b) & 255) + 1])), 4294967295::bigint)"


def scaled_sql(power: int, unit: str) -> str:
    x = f"({SIZE}/{float(1024**power)!r}::double)"
    return f"case when {x} < 10 then cast(floor({x}*10+0.5e0)/10e0 as varchar) else cast(cast(floor({x}+0.5e0) as bigint) as varchar) end||' {unit}'"


ORACLES = {
    "watermark_tiles": sql(f"select image_id, {SIX.format(f'(-diag+i*{STEP_X!r}::double)')} as x, {SIX.format(f'(-diag+j*{STEP_Y!r}::double)')} as y from (select *, unnest(range(0, cast(ceil(diag*2e0/{STEP_X!r}::double) as int))) as i from (select *, unnest(range(0, cast(ceil(diag*2e0/{STEP_Y!r}::double) as int))) as j from (select image_id, sqrt(width::double*width+height::double*height) as diag from image_dims)))", "image_dims"),
    "gray_color_ops": sql(f"select op_id, case when gray is null then op when op = lower(op) then 'g' else 'G' end as op, array_to_string(list_transform(case when gray is null then args else [gray] end, lambda v: cast(cast(floor(v*1e6+0.5e0) as bigint) as varchar)), ',') as args from (select *, {GRAY} as gray from color_ops)", "color_ops"),
    "crop_pixels": sql(f"select {PIX.format('x-2', 'y-3')} from pixels where x between 2 and 5 and y between 3 and 7", "pixels"),
    "rotate_90_flip_h": sql(f"select {PIX.format('7-y', '7-x')} from pixels", "pixels"),
    "rotate_180_flip_v": sql(f"select {PIX.format('7-x', 'y')} from pixels", "pixels"),
    "crop_mixed_sizes": sql("select image_id, x-x0 as x, y-1 as y, r, g, b, a from (select p.*, least(5, width-1) as x0, width, height from mixed_pixels p join mixed_dims d on p.image_id = d.image_id) where x >= x0 and x < x0 + least(3, width-x0) and y >= 1 and y < 1 + least(4, height-1)", "mixed_pixels", "mixed_dims"),
    "rotate_mixed_sizes": sql("select p.image_id, y as x, x as y, r, g, b, a from mixed_pixels p", "mixed_pixels"),
    "rotate_none_mixed_sizes": sql("select p.image_id, x, height-1-y as y, r, g, b, a from mixed_pixels p join mixed_dims d on p.image_id = d.image_id", "mixed_pixels", "mixed_dims"),
    "resize_mixed_sizes": sql(f"select m.image_id, x*6//width as x, y*5//height as y, {GROUPED} from mixed_pixels m join mixed_dims d on m.image_id = d.image_id where width >= 6 and height >= 5 group by m.image_id, x*6//width, y*5//height union all select m.image_id, i, j, r, g, b, a from mixed_pixels m join mixed_dims d on m.image_id = d.image_id join range(0,6) t(i) on m.x = i*width//6 join range(0,5) u(j) on m.y = j*height//5 where width < 6 or height < 5", "mixed_pixels", "mixed_dims"),
    "ascii_mixed_sizes": sql(f"select image_id, nx as x, ny as y, r, g, b, {CELL.format(raster.RAMP)} as ch from (select m.image_id, x*3//width as nx, y*n//height as ny, cast(floor(avg(r)+0.5e0) as int) as r, cast(floor(avg(g)+0.5e0) as int) as g, cast(floor(avg(b)+0.5e0) as int) as b from mixed_pixels m join (select *, greatest(1, cast(floor(3*(height::double/width)*0.5e0+0.5e0) as int)) as n from mixed_dims) d on m.image_id = d.image_id group by all)", "mixed_pixels", "mixed_dims"),
    "fit_dims": sql(f"select image_id, {FIT.format('width')} as new_width, {FIT.format('height')} as new_height from image_dims", "image_dims"),
    "resize_width": sql("select image_id, 333 as new_width, greatest(1, cast(floor(333e0/(width::double/height)+0.5e0) as int)) as new_height from image_dims", "image_dims"),
    "resize_percent": sql("select image_id, greatest(1, cast(floor(width*0.5e0+0.5e0) as int)) as new_width, greatest(1, cast(floor(height*0.5e0+0.5e0) as int)) as new_height from image_dims", "image_dims"),
    "pick_colors": sql(f"select event_id, user_id, ts, image_id, x, y, hex, 'rgb('||r0||', '||g0||', '||b0||')' as rgb, 'hsl('||h||', '||s||'%, '||l||'%)' as hsl from (select event_id, user_id, ts, image_id, x, y, hex, r0, g0, b0, {HSL} from {HSL_FROM.format(f'(select *, r as r0, g as g0, b as b0 from ({PICK}))')})", "clicks", "pixels"),
    "chroma_key": sql("select image_id, x, y, r, g, b, case when d <= 40 then 0 when d < 60 then cast(floor(a*((d-40e0)/20e0)+0.5e0) as int) else a end as a from (select p.*, sqrt(cast((p.r-k.r)*(p.r-k.r)+(p.g-k.g)*(p.g-k.g)+(p.b-k.b)*(p.b-k.b) as double)) as d from pixels p join (select * from pixels where x = 0 and y = 0) k using (image_id))", "pixels"),
    "gray_palette": sql(f"select p.image_id, p.x, p.y, cast(floor({LUM.format(r='q.r', g='q.g', b='q.b')}+0.5e0) as int) as gray from pixels p join (select image_id, y*8+x as idx, r, g, b from pixels where y < 2) q on p.image_id = q.image_id and p.r % 16 = q.idx", "pixels"),
    "icon_set": sql(f"select image_id, size, {SIX.format('scale')} as scale, {SIX.format('((size-width*scale)/2e0)')} as dx, {SIX.format('((size-height*scale)/2e0)')} as dy, size in (16,32,48) as in_ico from (select *, greatest(size::double/width, size::double/height) as scale from (select image_id, width, height, unnest([16,32,48,64,128,180,192,512]) as size from image_dims))", "image_dims"),
    "compress_report": sql(f"select count(*) as touched, coalesce(sum(size_before),0)::bigint as bytes_before, coalesce(sum(size_after),0)::bigint as bytes_after, cast(case when sum(size_before) > 0 then floor(100e0*(1e0-sum(size_after)::double/sum(size_before)::double)+0.5e0) else 0 end as bigint) as percent_saved from image_dims where size_after < size_before or width <> {FIT.format('width')}", "image_dims"),
    "shrink_pixels": sql(f"select image_id, x*4//8 as x, y*3//8 as y, {GROUPED} from pixels group by image_id, x*4//8, y*3//8", "pixels"),
    "grow_pixels": sql("select p.image_id, i as x, j as y, r, g, b, a from pixels p join range(0,12) t(i) on p.x = i*8//12 join range(0,12) u(j) on p.y = j*8//12", "pixels"),
    "ascii_art": ascii_sql(raster.RAMP),
    "ascii_art_inverted": ascii_sql(raster.RAMP[::-1]),
    "ascii_cells": ascii_sql(raster.RAMP, False),
    "blur_pixels": blur_sql(),
    "blur_rasters": blur_sql(),
    "collage_layout": sql(f"""select brand, image_id, r as row, c as col, 8+c*408 as cx, 8+r*408 as cy, {SIX.format('scale')} as scale, {SIX.format('(8+c*408+(400-width*scale)/2e0)')} as dx, {SIX.format('(8+r*408+(400-height*scale)/2e0)')} as dy, 1640 as canvas_w, cast(ceil(n/4e0) as int)*400+(cast(ceil(n/4e0) as int)+1)*8 as canvas_h
from (select *, i % 4 as c, i // 4 as r, greatest(400e0/width, 400e0/height) as scale from (select d.*, p_brand as brand, row_number() over (partition by p_brand order by image_id)-1 as i, count(*) over (partition by p_brand) as n from image_dims d join part on p_partkey = image_id))""", "image_dims"),
    "archive_manifest": sql(f"select archive, entry_no, method, payload, {crc_sql('data')} as crc, coalesce(sum(30+strlen(name)+payload) over (partition by archive order by entry_no rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\", 46+strlen(name) as central_size from (select *, case when compressed_size >= size then 0 else 8 end as method, case when compressed_size >= size then size else compressed_size end as payload from entries)", "entries"),
    "icon_directory": sql("select archive, entry_no, size, (6+16*count(*) over (partition by archive)+coalesce(sum(size) over (partition by archive order by entry_no rows between unbounded preceding and 1 preceding), 0))::bigint as \"offset\" from entries", "entries"),
    "delta_decode": sql("select row_id, pos, delta, cast(sum(delta) over (partition by row_id order by pos) % 256 as int) as value from samples", "samples"),
    "pick_history": sql(f"select user_id, array_to_string(list_reduce(list_prepend([], list(hex order by ts, event_id).list_transform(lambda h: [h])), lambda acc, h: case when list_contains(acc, h[1]) then acc else list_slice(list_prepend(h[1], acc), 1, 16) end), ',') as history from ({PICK}) group by user_id", "clicks", "pixels"),
    "border_pixels": sql("select image_id, x+2 as x, y+2 as y, r, g, b, a from pixels union all select vec_id, i::int, j::int, 255, 0, 0, 255 from embeddings, range(0,12) t(i), range(0,12) u(j) where not (i between 2 and 9 and j between 2 and 9)", "pixels"),
    "gray_pixels": sql(f"select image_id, x, y, v as r, v as g, v as b, a from (select *, cast(floor({LUM.format(r='r', g='g', b='b')}+0.5e0) as int) as v from pixels)", "pixels"),
    "cmyk_to_rgb": "select o_orderkey as op_id, " + ", ".join(f"{SIX.format(f'(1e0-least(1e0, ((o_orderkey*{m})%101)::double/100e0+((o_orderkey*19)%101)::double/100e0))')} as {c}" for c, m in zip("rgb", (7, 11, 15), strict=True)) + " from orders",
    "rgb_hex": sql(f"select image_id, x, y, {HEX} as hex, r as r2, g as g2, b as b2 from pixels", "pixels"),
    "rgb_to_hsl": sql(f"select image_id, x, y, {HSL} from {HSL_FROM.format('pixels')}", "pixels"),
    "css_filter": filter_sql(),
    "flatten_alpha": sql("select image_id, x, y, " + ", ".join(f"cast(floor(a/255e0*{c}+(1e0-a/255e0)*255e0+0.5e0) as int) as {c}" for c in "rgb") + ", 255 as a from pixels", "pixels"),
    "to_data_uri": "select doc_id, 'data:text/plain;base64,'||base64(encode(text)) as uri, base64(encode(text)) as bare from documents",
    "parse_data_uri": "select doc_id, case when doc_id % 2 = 0 then 'image/webp' else 'image/png' end as mime, text, case when doc_id % 2 = 0 then 'webp' else 'png' end as ext from documents",
    "hex_coding": f"select doc_id, array_to_string(list_transform(u, lambda b: upper(lpad(to_hex(b), 2, '0'))), '') as hex, array_to_string(list_transform(u, lambda b: chr(b)), '') as back from (select doc_id, flatten(list_transform(regexp_extract_all(text, '(?s).'), lambda c: {UNITS})) as u from documents)",
    "format_bytes": sql(f"select entry_no, case when {SIZE} < 1024 then ({SIZE})||' B' when {SIZE} < 1048576 then {scaled_sql(1, 'KB')} when {SIZE} < 1073741824 then {scaled_sql(2, 'MB')} when {SIZE} < 1099511627776 then {scaled_sql(3, 'GB')} else {scaled_sql(4, 'TB')} end as shown from entries", "entries"),
    "suggest_name": r"select page_id, regexp_replace(url, '\.[^.]+$', '')||'-small.webp' as named, regexp_replace(url, '\.[^.]+$', '')||'.'||split_part(url, '.', -1) as same from pages",
    "dates": "select event_id, strftime(ts, 'D:%Y%m%dT%H%M%SZ') as pdf_date, cast(((year(ts)-1980)<<9)|(month(ts)<<5)|day(ts) as int) as dos_date, cast((hour(ts)<<11)|(minute(ts)<<5)|(second(ts)>>1) as int) as dos_time from events",
    "doc_info": sql("""select doc_id, 'Author='||author||';Creator=;Keywords='||keywords||';Producer='||producer||';Subject='||subject||';Title='||title as viewed,
'Author='||author||case when keywords = '' then '' else ';Keywords='||keywords end||';ModDate=D:20240506T070809Z;Producer='||producer||';Subject=new' as edited, 0 as n_stripped from doc_info""", "doc_info"),
    "image_summary": sql("select image_id, width||' × '||height||' px' as dimensions, width::double*height/1e6 as megapixels, mime, coalesce((['Normal','Flipped horizontally','Rotated 180°','Flipped vertically','Rotated 90° CW + flipped','Rotated 90° CW','Rotated 90° CCW + flipped','Rotated 90° CCW'])[nullif(orientation, 0)], orientation::varchar) as turned from image_dims", "image_dims"),
}
