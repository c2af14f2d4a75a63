"""Page sets: paginate, boxes, rotate, crop, merge, split, number, watermark."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafworks.functions.tables import fresh, half_up, ranked, totals

#: The box of a page that has none.
DEFAULT_BOX = {"llx": 0.0, "lly": 0.0, "urx": 612.0, "ury": 792.0}
MARGIN = 28


def paginate(documents: DataFrame, chars: int) -> DataFrame:
    """(doc_id, page_no, page_text): pages of `chars` characters, one at least."""
    n = F.greatest(F.lit(1), F.floor((F.length("text") + chars - 1) / chars)).cast("int")
    pages = documents.select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page_no"))
    return pages.select("doc_id", "page_no", F.substring("text", (F.col("page_no") - 1) * chars + 1, F.lit(chars)).alias("page_text"))


def effective_box(pages: DataFrame) -> DataFrame:
    """The page's box; the default where it has none, 0 where only a number is missing."""
    none = F.lit(True)
    for c in DEFAULT_BOX:
        none = none & F.col(c).isNull()
    return pages.withColumns({c: F.when(none, F.lit(v)).otherwise(F.coalesce(F.col(c), F.lit(0.0))) for c, v in DEFAULT_BOX.items()})


def rotate_pages(pages: DataFrame, angle: int, page: int | None = None) -> DataFrame:
    """Rotations snapped to a multiple of 90 in 0..270 and turned by angle; with page, only that one."""
    turned = F.pmod(half_up(F.col("rotate") / F.lit(90.0)) * 90 + angle, F.lit(360)).cast("int")
    return pages.withColumn("rotate", turned if page is None else F.when(F.col("page_no") == page, turned).otherwise(F.col("rotate")))


def crop_pages(pages: DataFrame, top: float, bottom: float, left: float, right: float) -> DataFrame:
    """Boxes made smaller by margins; width and height stay 1 at least."""
    p = effective_box(pages).withColumns({"llx": F.col("llx") + F.lit(float(left)), "lly": F.col("lly") + F.lit(float(bottom)), "urx": F.col("urx") - F.lit(float(right)), "ury": F.col("ury") - F.lit(float(top))})
    least = lambda hi, lo: F.when(F.col(hi) <= F.col(lo), F.col(lo) + 1.0).otherwise(F.col(hi))
    return p.withColumns({"urx": least("urx", "llx"), "ury": least("ury", "lly")})


def place_watermark(pages: DataFrame, text_width: float, angle: float) -> DataFrame:
    """Adds where a text must start so that, turned by angle, it is centred on the page."""
    half, turn = F.lit(text_width / 2), F.radians(F.lit(float(angle)))
    p = effective_box(pages)
    return p.withColumns({"x": (F.col("llx") + F.col("urx")) / 2.0 - half * F.cos(turn), "y": (F.col("lly") + F.col("ury")) / 2.0 - half * F.sin(turn)})


def parse_ranges(text: str) -> list[tuple[int, int, bool]]:
    """(first, last, single) of each valid token of "1-3, 5, 8-12"; clamping waits for the page count."""
    out = []
    for token in (t.strip() for t in text.split(",")):
        if m := re.fullmatch(r"(\d+)\s*-\s*(\d+)", token, re.ASCII):
            out.append((max(1, int(m[1])), int(m[2]), False))
        elif re.fullmatch(r"\d+", token, re.ASCII):
            out.append((int(token), int(token), True))
    return out


def split_by_ranges(pages: DataFrame, ranges: str) -> DataFrame:
    """Adds part_no: every range is a part, ranges may overlap, empty ranges give none. No valid range: ValueError.

    The list of ranges is the user's parameter, so that its table is small whatever the pages.
    """
    parsed = parse_ranges(ranges)
    if not parsed:
        raise ValueError(f"{ranges!r} names no range of pages")
    table = pages.sparkSession.createDataFrame([(k + 1, lo, hi) for k, (lo, hi, _) in enumerate(parsed)], "part_no int, lo long, hi long")
    lo, hi = fresh(pages, "lo", "hi")
    table = table.withColumnsRenamed({"lo": lo, "hi": hi})
    return pages.join(F.broadcast(table), F.col("page_no").between(F.col(lo), F.col(hi))).drop(lo, hi)


def split_chunks(pages: DataFrame, size: int) -> DataFrame:
    """Adds part_no: runs of `size` pages of each document, the last may be short. A long document is many tasks."""
    nth = fresh(pages, "nth")
    return ranked(pages, ["doc_id"], ["page_no"], nth).withColumn("part_no", (F.floor((F.col(nth) - 1) / max(1, size)) + 1).cast("int")).drop(nth)


def part_names(parts: DataFrame, base: Column) -> DataFrame:
    """Adds part_name: base-pFIRST or base-pFIRST-LAST. First and last pages are aggregated, whatever a part's size."""
    doc, part, first, last = fresh(parts, "doc", "part", "first", "last")
    ends = parts.groupBy(F.col("doc_id").alias(doc), F.col("part_no").alias(part)).agg(F.min("page_no").alias(first), F.max("page_no").alias(last))
    name = F.concat(base, F.lit("-p"), F.col(first).cast("string"), F.when(F.col(first) == F.col(last), "").otherwise(F.concat(F.lit("-"), F.col(last).cast("string"))))
    out = parts.join(ends, F.col("doc_id").eqNullSafe(F.col(doc)) & F.col("part_no").eqNullSafe(F.col(part)))
    return out.withColumn("part_name", name).drop(doc, part, first, last)


def merge_documents(pages: DataFrame, order: DataFrame, width: int = 100_000) -> DataFrame:
    """Pages of the documents of each bundle, numbered 1..N by the bundle's order. order: (doc_id, bundle_id, input_order).

    Pages are counted by runs of each document, and the counts added up in two levels, so that neither a giant document nor
    a giant bundle is one task; documents that share a place in the list are added up in one, a row for each. A page moves
    once, and its number in its run comes on top.
    """
    p = pages.join(order, "doc_id")
    run, nth, b, o, d, r, n, before, cell = fresh(p, "run", "nth", "b", "o", "d", "r", "n", "before", "cell")
    p = p.withColumn(run, F.floor(F.col("page_no") / width))
    runs = p.groupBy(F.col("bundle_id").alias(b), F.col("input_order").alias(o), F.col("doc_id").alias(d), F.col(run).alias(r)).agg(F.count("*").alias(n))
    runs = totals(runs.withColumn(cell, F.floor(F.col(o) / width)), [b], cell, [o, d, r], F.col(n), before).drop(cell, n)
    p = p.withColumn(nth, F.row_number().over(Window.partitionBy("doc_id", run, "bundle_id", "input_order").orderBy("page_no")))
    p = p.join(runs, F.col("bundle_id").eqNullSafe(F.col(b)) & F.col("input_order").eqNullSafe(F.col(o)) & (F.col("doc_id") == F.col(d)) & F.col(run).eqNullSafe(F.col(r)))
    return p.withColumn("new_page_no", (F.col(before) + F.col(nth)).cast("int")).drop(run, nth, b, o, d, r, before)


def text_width(text: Column, widths: list[int], first: int = 32, fallback: int = 556) -> Column:
    """Sum of glyph widths in thousandths: Arrow batches, all characters of a batch looked up at once; null for null."""
    table = np.array([fallback] * first + widths + [fallback])

    @F.pandas_udf("long")
    def measured(texts: pd.Series) -> pd.Series:
        known = texts.notna().to_numpy()
        some = texts[known]
        codes = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum(table[np.minimum(codes, len(table) - 1)])])
        at = np.concatenate([[0], np.cumsum(some.str.len().to_numpy(np.int64))])
        out = np.zeros(len(texts), np.int64)
        out[known] = np.diff(ends[at])
        return pd.Series(out).where(pd.Series(known), None).astype("Int64")

    return measured(text)


def number_pages(pages: DataFrame, fmt: str, start: int, position: str, size: float, widths: list[int]) -> DataFrame:
    """Adds label, x, y: {n} and {total} are replaced once each; margins of 28 points."""
    nth, total, wide = fresh(pages, "nth", "total", "wide")
    p = ranked(effective_box(pages), ["doc_id"], ["page_no"], nth, total)

    def once(text: Column, mark: str, value: Column) -> Column:
        at = F.instr(text, mark)
        return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), value, F.substring(text, at + len(mark), F.length(text)))).otherwise(text)

    p = p.withColumn("label", once(once(F.lit(fmt), "{n}", (F.col(nth) + (start - 1)).cast("string")), "{total}", F.col(total).cast("string")))
    p = p.withColumn(wide, text_width(F.col("label"), widths) / F.lit(1000.0) * F.lit(float(size)))
    y = F.col("lly") + float(MARGIN) if position.startswith("bottom") else F.col("ury") - float(MARGIN)
    x = (F.col("llx") + F.col("urx")) / 2.0 - F.col(wide) / 2.0 if "center" in position else F.col("urx") - float(MARGIN) - F.col(wide) if "right" in position else F.col("llx") + float(MARGIN)
    return p.withColumns({"x": x, "y": y}).drop(nth, total, wide)


def doc_stats(pages: DataFrame) -> DataFrame:
    """Pages and bytes of each document."""
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.sum(F.octet_length("page_text")).alias("n_bytes"))
