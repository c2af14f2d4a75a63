"""Text runs: separators, page and document text, widths, code tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheafworks.functions.tables import fresh, half_up
from sheafworks.operators.pages import text_width

#: Advance widths of codes 32..126 of the two standard fonts, in thousandths; other codes have 556.
WIDTHS = {
    "Helvetica": """278 278 355 556 556 889 667 191 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 278 278 584 584 584 556
1015 667 667 722 722 667 611 778 722 278 500 667 556 833 722 778 667 778 722 667 611 722 667 944 667 667 611 278 278 278 469 556
333 556 556 500 556 556 278 556 556 222 222 500 222 833 556 556 556 556 333 500 278 556 500 722 500 500 500 334 260 334 584""",
    "Helvetica-Bold": """278 333 474 556 556 889 722 238 333 333 389 584 278 333 278 278 556 556 556 556 556 556 556 556 556 556 333 333 584 584 584 611
975 722 722 722 722 667 611 778 722 278 556 722 611 833 722 778 667 778 722 667 611 722 667 944 667 667 611 333 278 333 584 556
333 556 611 556 611 556 333 611 611 278 278 556 278 889 611 611 611 611 389 556 333 611 556 778 556 556 500 389 280 389 584""",
}
#: Codes above ASCII that a simple font shows as other characters.
WINANSI = {0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022, 0x96: 0x2013, 0x97: 0x2014, 0xA0: 0x00A0, 0xAD: 0x00AD}
UNMAPPED = "�"
EDGE = r"[\x09-\x0D\x20]+"


def widths(font: str) -> list[int]:
    return [int(w) for w in WIDTHS.get(font, WIDTHS["Helvetica"]).split()]


def run_separators(runs: DataFrame) -> DataFrame:
    """Adds sep: newline where y moved by more than 1.5, else blank where the gap exceeds a fifth of the font size."""
    w = Window.partitionBy("doc_id", "page_no").orderBy("run_seq")
    y, last_y, last_end = half_up(F.col("y")), half_up(F.lag("y").over(w)), F.lag("end_x").over(w)
    sep = F.when(last_y.isNotNull() & (F.abs(y - last_y) > 1.5), "\n").when(last_end.isNotNull() & (F.col("x") - last_end > F.col("font_size") * 0.2), " ").otherwise("")
    return runs.withColumn("sep", sep)


def in_order(order: Column, piece: Column) -> Column:
    """Aggregate: pieces of a group end to end by order."""
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), piece.alias("p")))), lambda x: x["p"]), "")


def extract_page_text(runs: DataFrame) -> DataFrame:
    """(doc_id, page_no, page_text); the window and the grouping share one exchange, by page."""
    pieces = run_separators(runs).groupBy("doc_id", "page_no").agg(in_order(F.col("run_seq"), F.concat("sep", "run_text")).alias("t"))
    t = F.regexp_replace(F.regexp_replace("t", r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return pieces.select("doc_id", "page_no", F.regexp_replace(F.regexp_replace(t, f"^{EDGE}", ""), f"{EDGE}$", "").alias("page_text"))


def assemble_document(pages: DataFrame, page_breaks: bool = False) -> DataFrame:
    """(doc_id, text, had_unmapped, n_pages) from (doc_id, page_no, page_text, unmapped)."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no"))
    mark = F.concat(F.lit("\n\n——— Page "), nth.cast("string"), F.lit(" ———\n\n")) if page_breaks else F.lit("\n\n")
    p = pages.select("doc_id", "page_no", "unmapped", F.concat(F.when(nth == 1, "").otherwise(mark), "page_text").alias("piece"))
    return p.groupBy("doc_id").agg(in_order(F.col("page_no"), F.col("piece")).alias("text"), F.bool_or("unmapped").alias("had_unmapped"), F.count("*").alias("n_pages"))


def measure_text(runs: DataFrame, font: str = "Helvetica") -> DataFrame:
    """Adds width: glyph widths of the run's text at its font size."""
    return runs.withColumn("width", text_width(F.col("run_text"), widths(font)) / F.lit(1000.0) * F.col("font_size"))


def character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def decode_codes(codes: DataFrame, ranges: DataFrame, simple: bool = True) -> DataFrame:
    """Adds ch and unmapped: lo..hi -> base..; the later range wins; then, for simple fonts, the WinAnsi fallback.

    Ranges are expanded to codes (at most 65,536 of them), so that the join is an equi-join. This table goes to the codes:
    they are a row for each character, many times the text if they were shuffled, and half of them a few letters. It holds
    the characters too; numbers that are none are decoded only where they occur.
    """
    known, to, shown = fresh(codes, "known", "to", "shown")
    table = ranges.select("range_no", "base", "lo", F.explode(F.sequence("lo", "hi")).alias("code")).groupBy("code").agg(F.max_by(F.col("base") + F.col("code") - F.col("lo"), "range_no").alias(to))
    if simple:
        code = F.col("code")
        plain = sorted({*range(32, 127), *WINANSI, *range(0xA0, 0x100)})
        others = ranges.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in plain])).alias("code"), F.lit(None).cast("int").alias(to))
        fallback = F.when(code.between(32, 126), code).when(code.isin(*WINANSI), F.element_at(F.create_map(*[F.lit(x) for p in WINANSI.items() for x in p]), code.cast("int"))).when(code.between(0xA0, 0xFF), code)
        table = table.unionByName(others).groupBy("code").agg(F.max(to).alias(to)).select("code", F.coalesce(to, fallback).alias(to))
    valid = F.col(to).between(0, 0xD7FF) | F.col(to).between(0xE000, 0x10FFFF)
    table = table.select("code", F.col(to), F.when(valid, character(F.col(to))).alias(known))
    out = codes.join(F.broadcast(table), "code", "left").withColumn(shown, F.coalesce(known, F.when(F.col(to).isNotNull(), character(F.col(to)))))
    return out.withColumn("unmapped", F.col(to).isNull()).withColumn("ch", F.coalesce(shown, F.lit(UNMAPPED))).drop(known, to, shown)


def join_run_items(items: DataFrame, font_size: float = 10.0, hscale: float = 1.0) -> DataFrame:
    """(doc_id, page_no, line_y, text): pieces end to end, a blank before each adjustment that opens a gap."""
    gap = -F.col("adjust") / 1000.0 * F.lit(font_size) * F.lit(hscale)
    piece = F.concat(F.col("piece"), F.when(gap > font_size * 0.15, " ").otherwise(""))
    return items.groupBy("doc_id", "page_no", "line_y").agg(in_order(F.col("item_no"), piece).alias("text"))
