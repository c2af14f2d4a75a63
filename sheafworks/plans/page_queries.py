"""Registered queries on pages, text runs, redaction and objects, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheafworks.operators import archive, objects, pages, redact, text
from sheafworks.plans import fixtures as fx
from sheafworks.plans.fixtures import TERMS, sql

HELV = text.widths("Helvetica")
LABEL = "CONFIDENTIAL"
WIDTH = sum(HELV[ord(c) - 32] for c in LABEL)
RANGES = "1-3, 5,8-12, 2-4, 5-3, abc, 999"
CODE_RANGES = [(1, 65, 90, 97), (2, 97, 122, 65), (3, 70, 72, 48)]
SIX = "floor({0}*1e6+0.5e0)/1e6"
MANY = "regexp_matches(lower(run_text), '" + "|".join(sorted({t.strip().lower() for t in fx.MANY_TERMS})) + "')"
BOXES = "select doc_id, page_no, run_seq, x-1e0 as x, y-font_size*0.25e0-1e0 as y, end_x-x+2e0 as w, (y+font_size*0.85e0)-(y-font_size*0.25e0)+2e0 as h from text_runs"
HIT = "(contains(lower(run_text), 'the') or contains(lower(run_text), 'tion') or contains(lower(run_text), 'eau'))"


def six(c):
    return F.floor(F.col(c) * F.lit(1e6) + F.lit(0.5)) / F.lit(1e6)


def page_text(spark, d, runs=None):
    return text.extract_page_text(fx.text_runs(spark, d) if runs is None else runs)


def remapped(spark, d):
    from sheafworks.functions.tables import read

    kept = read(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("old_id"), F.col("c_custkey").alias("new_id"))
    return objects.remap_refs(fx.object_edges(spark, d), kept).groupBy("src", "dst", "kind", "new_dst").agg(F.count("*").alias("n"))


def reached(spark, d):
    from sheafworks.functions.tables import read

    roots = read(spark, d, "orders").where("o_orderstatus = 'O'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return objects.reachable(fx.object_edges(spark, d), roots)


def ordered(spark, d):
    p = fx.doc_pages(spark, d)
    order = p.where("page_no = 1").select("doc_id", (F.col("doc_id") % 50).alias("bundle_id"), (-F.col("doc_id")).alias("input_order"))
    return pages.merge_documents(p, order).select("bundle_id", "new_page_no", "doc_id", "page_no")


def bases(spark, d):
    latest = objects.latest_revision(fx.object_revisions(spark, d)).select("doc_id", "obj_num", "byte_offset")
    base = latest.where("byte_offset % 2 = 0")
    some = latest.where("doc_id % 3 = 0")
    updates = some.select("doc_id", "obj_num", (-F.col("byte_offset")).alias("byte_offset")).union(some.select("doc_id", F.col("obj_num") + 100, "byte_offset"))
    return base, updates


def labelled(spark, d):
    p = pages.number_pages(fx.page_boxes(spark, d), "Page {n} of {total} / {n}", 3, "bottom-right", 11, HELV)
    return p.select("doc_id", "page_no", "label", six("x").alias("x"), "y")


def documents_text(breaks):
    def query(spark, d):
        p = page_text(spark, d).withColumn("unmapped", F.contains("page_text", F.lit("e")))
        return text.assemble_document(p, breaks)

    return query


def coded(spark, d):
    ranges = spark.createDataFrame(CODE_RANGES, "range_no int, lo int, hi int, base int")
    codes = fx.text_runs(spark, d).select("doc_id", "run_seq", F.posexplode(F.split("run_text", "")).alias("pos", "c")).where("c <> ''")
    return text.decode_codes(codes.select("doc_id", "run_seq", "pos", F.ascii("c").alias("code")), ranges).select("doc_id", "run_seq", "pos", "code", "ch", "unmapped")


def measured(spark, d):
    return text.measure_text(fx.text_runs(spark, d)).select("doc_id", "run_seq", six("width").alias("width"))


def verified(spark, d):
    runs = fx.text_runs(spark, d)
    return redact.verify_redaction(runs, redact.redact_runs(runs, TERMS), TERMS)


def half_verified(spark, d):
    runs = fx.text_runs(spark, d)
    return redact.verify_redaction(runs, redact.redact_runs(runs, TERMS[:1]), TERMS)


BOX = ["doc_id", "page_no", "llx", "lly", "urx", "ury"]
RUN = ["doc_id", "page_no", "run_seq", "run_text"]
QUERIES = {
    "doc_pages": fx.doc_pages,
    "effective_box": lambda s, d: pages.effective_box(fx.page_boxes(s, d)).select(*BOX),
    "rotate_all": lambda s, d: pages.rotate_pages(fx.page_boxes(s, d), 90).select("doc_id", "page_no", "rotate"),
    "rotate_one": lambda s, d: pages.rotate_pages(fx.page_boxes(s, d), 270, 2).select("doc_id", "page_no", "rotate"),
    "crop_pages": lambda s, d: pages.crop_pages(fx.page_boxes(s, d), 10, 20, 30, 40).select(*BOX),
    "crop_clamped": lambda s, d: pages.crop_pages(fx.page_boxes(s, d), 10, 20, 700, 40).select(*BOX),
    "search_catalog": lambda s, d: archive.search_catalog(fx.catalog(s, d), "RING", ["title", "description", "category"]),
    "search_blank": lambda s, d: archive.search_catalog(fx.catalog(s, d), "  ", ["title", "description", "category"]),
    "place_watermark": lambda s, d: pages.place_watermark(fx.page_boxes(s, d), WIDTH / 1000 * 48, 45).select("doc_id", "page_no", six("x").alias("x"), six("y").alias("y")),
    "redaction_boxes": lambda s, d: redact.redaction_boxes(fx.text_runs(s, d), TERMS),
    "split_by_ranges": lambda s, d: pages.split_by_ranges(fx.doc_pages(s, d), RANGES).select("doc_id", "part_no", "page_no"),
    "find_terms": lambda s, d: redact.find_terms(fx.text_runs(s, d), TERMS).select(*RUN),
    "redact_runs": lambda s, d: redact.redact_runs(fx.text_runs(s, d), TERMS).select(*RUN),
    "measure_text": measured,
    "decode_codes": coded,
    "inherit_page_attrs": lambda s, d: objects.inherit_page_attrs(fx.page_tree(s, d), ["media_w", "rotate"]),
    "reachable": reached,
    "remap_refs": remapped,
    "redaction_report": lambda s, d: redact.redaction_report(fx.text_runs(s, d), TERMS),
    "verify_redaction": verified,
    "verify_half_redaction": half_verified,
    "find_many_terms": lambda s, d: redact.find_terms(fx.text_runs(s, d), fx.MANY_TERMS).select(*RUN),
    "redact_many_terms": lambda s, d: redact.redact_runs(fx.text_runs(s, d), fx.MANY_TERMS).select(*RUN),
    "boxes_of_many_terms": lambda s, d: redact.redaction_boxes(fx.text_runs(s, d), fx.MANY_TERMS),
    "page_text": page_text,
    "redacted_page_text": lambda s, d: page_text(s, d, redact.redact_runs(fx.text_runs(s, d), TERMS)),
    "document_text": documents_text(False),
    "document_text_breaks": documents_text(True),
    "doc_stats": lambda s, d: pages.doc_stats(fx.doc_pages(s, d)),
    "category_counts": lambda s, d: archive.category_counts(fx.catalog(s, d)),
    "distinct_shared": lambda s, d: objects.distinct_shared(fx.resources(s, d)),
    "latest_revision": lambda s, d: objects.latest_revision(fx.object_revisions(s, d)),
    "first_value_per_key": lambda s, d: objects.first_value_per_key(fx.doc_info_sections(s, d)),
    "join_run_items": lambda s, d: text.join_run_items(fx.run_items(s, d)),
    "run_separators": lambda s, d: text.run_separators(fx.text_runs(s, d)).select("doc_id", "page_no", "run_seq", "sep"),
    "merge_documents": ordered,
    "split_chunks": lambda s, d: pages.split_chunks(fx.doc_pages(s, d), 4).select("doc_id", "page_no", "part_no"),
    "part_names": lambda s, d: pages.part_names(pages.split_chunks(fx.doc_pages(s, d), 4), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))).select("doc_id", "page_no", "part_no", "part_name"),
    "number_pages": labelled,
    "compact_ids": lambda s, d: objects.compact_ids(objects.latest_revision(fx.object_revisions(s, d))).select("doc_id", "obj_num", "new_id"),
    "overlay_updates": lambda s, d: objects.overlay_updates(*bases(s, d), ["doc_id", "obj_num"]),
    "object_listing": lambda s, d: objects.object_listing(*bases(s, d)),
}

SEP = """select *, case when ly is not null and abs(floor(y+0.5e0) - floor(ly+0.5e0)) > 1.5e0 then chr(10) when le is not null and x - le > font_size*0.2e0 then ' ' else '' end as sep
from (select *, lag(y) over w as ly, lag(end_x) over w as le from {0} window w as (partition by doc_id, page_no order by run_seq))"""
TEXT = r"""select doc_id, page_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(string_agg(sep||run_text, '' order by run_seq), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10)||chr(10), 'g'), '^[\x09-\x0D\x20]+', '', 'g'), '[\x09-\x0D\x20]+$', '', 'g') as page_text from (""" + SEP + ") group by doc_id, page_no"
LATEST = "select doc_id, obj_num, max(section) as section, arg_max(byte_offset, (section, byte_offset)) as byte_offset from object_revisions where in_use group by doc_id, obj_num"
BASES = f"latest as ({LATEST}), base as (select doc_id, obj_num, byte_offset from latest where byte_offset % 2 = 0), upd as (select doc_id, obj_num, -byte_offset as byte_offset from latest where doc_id % 3 = 0 union all select doc_id, obj_num + 100, byte_offset from latest where doc_id % 3 = 0)"
W_TABLE = "[" + ",".join(map(str, HELV)) + "]"


def width_sql(col: str) -> str:
    return f"list_sum(list_transform(range(1, length({col}) + 1), lambda i: coalesce(case when unicode(substr({col}, i, 1)) >= 32 then ({W_TABLE})[unicode(substr({col}, i, 1)) - 31] end, 556)))"


def with_views(body: str, extra: str, *names: str) -> str:
    """More named tables after the views."""
    return sql("", *names).rstrip() + ", " + extra + " " + body


def page_text_sql(runs: str) -> str:
    return TEXT.replace("{0}", runs)


def document_sql(mark: str) -> str:
    return with_views(
        f"select doc_id, string_agg(case when nth = 1 then '' else {mark} end || page_text, '' order by page_no) as text, bool_or(contains(page_text, 'e')) as had_unmapped, count(*) as n_pages from (select *, row_number() over (partition by doc_id order by page_no) as nth from pt) group by doc_id",
        f"pt as ({page_text_sql('text_runs')})", "text_runs",
    )


ORACLES = {
    "doc_pages": sql("select * from doc_pages", "doc_pages"),
    "effective_box": sql(f"select {', '.join(BOX)} from boxes", "boxes"),
    "rotate_all": sql("select doc_id, page_no, cast(((cast(floor(rotate/90e0+0.5e0) as int)*90 + 90) % 360 + 360) % 360 as int) as rotate from page_boxes", "page_boxes"),
    "rotate_one": sql("select doc_id, page_no, case when page_no = 2 then cast(((cast(floor(rotate/90e0+0.5e0) as int)*90 + 270) % 360 + 360) % 360 as int) else rotate end as rotate from page_boxes", "page_boxes"),
    "crop_pages": sql("select doc_id, page_no, llx+30 as llx, lly+20 as lly, case when urx-40 <= llx+30 then llx+31 else urx-40 end as urx, case when ury-10 <= lly+20 then lly+21 else ury-10 end as ury from boxes", "boxes"),
    "crop_clamped": sql("select doc_id, page_no, llx+700 as llx, lly+20 as lly, case when urx-40 <= llx+700 then llx+701 else urx-40 end as urx, case when ury-10 <= lly+20 then lly+21 else ury-10 end as ury from boxes", "boxes"),
    "search_catalog": sql("select * from catalog where contains(lower(title), 'ring') or contains(lower(description), 'ring') or contains(lower(category), 'ring')", "catalog"),
    "search_blank": sql("select * from catalog", "catalog"),
    "place_watermark": sql(f"select doc_id, page_no, {SIX.format(f'((llx+urx)/2e0 - {WIDTH / 1000 * 48 / 2!r}::double*cos(radians(45e0)))')} as x, {SIX.format(f'((lly+ury)/2e0 - {WIDTH / 1000 * 48 / 2!r}::double*sin(radians(45e0)))')} as y from boxes", "boxes"),
    "redaction_boxes": sql(f"{BOXES} where {HIT}", "text_runs"),
    "split_by_ranges": sql("select doc_id, part_no, page_no from doc_pages join (values (1,1,3),(2,5,5),(3,8,12),(4,2,4),(5,5,3),(6,999,999)) r(part_no, lo, hi) on page_no between lo and hi", "doc_pages"),
    "find_terms": sql(f"select {', '.join(RUN)} from text_runs where {HIT}", "text_runs"),
    "redact_runs": sql(f"select {', '.join(RUN)} from text_runs where not {HIT}", "text_runs"),
    "measure_text": sql(f"select doc_id, run_seq, {SIX.format('(w/1000e0*font_size)')} as width from (select *, {width_sql('run_text')} as w from text_runs)", "text_runs"),
    "decode_codes": sql("""select doc_id, run_seq, pos, code, coalesce(chr(cast(coalesce(case when code between 70 and 72 then 48+code-70 when code between 97 and 122 then 65+code-97 when code between 65 and 90 then 97+code-65 end,
case when code between 32 and 126 then code when code = 145 then 8216 when code = 146 then 8217 when code = 147 then 8220 when code = 148 then 8221 when code = 149 then 8226 when code = 150 then 8211 when code = 151 then 8212 when code between 160 and 255 then code end) as int)), '�') as ch,
not (code between 32 and 126 or code between 145 and 151 or code between 160 and 255) as unmapped from (select doc_id, run_seq, cast(i - 1 as int) as pos, unicode(substr(run_text, i, 1)) as code from (select *, unnest(range(1, length(run_text) + 1)) as i from text_runs))""", "text_runs"),
    "inherit_page_attrs": sql("select a.node_id, coalesce(a.media_w, b.media_w, c.media_w) as media_w, coalesce(a.rotate, b.rotate, c.rotate) as rotate from page_tree a left join page_tree b on a.parent_id = b.node_id left join page_tree c on b.parent_id = c.node_id", "page_tree"),
    "reachable": with_views("select node from r", "r(node) as (select 'o'||o_orderkey from orders where o_orderstatus = 'O' union select dst from r join object_edges e on r.node = e.src where kind <> 'Parent')", "object_edges"),
    "remap_refs": sql("select src, dst, kind, c_custkey as new_dst, count(*) as n from object_edges left join (select c_custkey from customer where c_custkey % 10 <> 0) on dst = 'c'||c_custkey group by all", "object_edges"),
    "redaction_report": sql(f"select doc_id, page_no, sum(case when {HIT} then 1 else 0 end)::bigint as hits, grouping(doc_id, page_no) as level from text_runs group by rollup(doc_id, page_no)", "text_runs"),
    "verify_redaction": sql(f"select doc_id, count(*) filter (not {HIT} and {HIT}) as remaining from text_runs group by doc_id", "text_runs"),
    "verify_half_redaction": sql(f"select doc_id, count(*) filter (not contains(lower(run_text), 'the') and {HIT}) as remaining from text_runs group by doc_id", "text_runs"),
    "find_many_terms": sql(f"select {', '.join(RUN)} from text_runs where {MANY}", "text_runs"),
    "redact_many_terms": sql(f"select {', '.join(RUN)} from text_runs where not {MANY}", "text_runs"),
    "boxes_of_many_terms": sql(f"{BOXES} where {MANY}", "text_runs"),
    "page_text": sql(page_text_sql("text_runs"), "text_runs"),
    "redacted_page_text": sql(page_text_sql(f"(select * from text_runs where not {HIT})"), "text_runs"),
    "document_text": document_sql("chr(10)||chr(10)"),
    "document_text_breaks": document_sql("chr(10)||chr(10)||'——— Page '||nth||' ———'||chr(10)||chr(10)"),
    "doc_stats": sql("select doc_id, count(*) as n_pages, sum(strlen(page_text))::bigint as n_bytes from doc_pages group by doc_id", "doc_pages"),
    "category_counts": sql("select category, count(*) as n, count(*) filter (status = 'ready') as n_ready, count(*) filter (status <> 'ready') as n_planned from catalog group by category", "catalog"),
    "distinct_shared": sql("select distinct doc_id, obj_num from resources", "resources"),
    "latest_revision": sql(LATEST, "object_revisions"),
    "first_value_per_key": sql("select doc_id, info_key, arg_max(info_value, (section, tie)) as info_value from doc_info_sections group by doc_id, info_key", "doc_info_sections"),
    "join_run_items": sql("select doc_id, page_no, line_y, string_agg(piece || case when -adjust/1000e0*10e0 > 1.5e0 then ' ' else '' end, '' order by item_no) as text from run_items group by doc_id, page_no, line_y", "run_items"),
    "run_separators": sql("select doc_id, page_no, run_seq, sep from (" + SEP.format("text_runs") + ")", "text_runs"),
    "merge_documents": sql("select doc_id % 50 as bundle_id, row_number() over (partition by doc_id % 50 order by -doc_id, page_no) as new_page_no, doc_id, page_no from doc_pages", "doc_pages"),
    "split_chunks": sql("select doc_id, page_no, (page_no-1)//4+1 as part_no from doc_pages", "doc_pages"),
    "part_names": sql("select *, 'doc-'||doc_id||'-p'||min(page_no) over w||case when min(page_no) over w = max(page_no) over w then '' else '-'||max(page_no) over w end as part_name from (select doc_id, page_no, (page_no-1)//4+1 as part_no from doc_pages) window w as (partition by doc_id, part_no)", "doc_pages"),
    "number_pages": sql(f"select doc_id, page_no, label, {SIX.format('(urx - 28e0 - w/1000e0*11e0)')} as x, lly+28e0 as y from (select *, {width_sql('label')} as w from (select *, 'Page '||(row_number() over (partition by doc_id order by page_no)+2)||' of '||count(*) over (partition by doc_id)||' / {{n}}' as label from boxes))", "boxes"),
    "compact_ids": with_views("select doc_id, obj_num, row_number() over (partition by doc_id order by obj_num) as new_id from latest", f"latest as ({LATEST})", "object_revisions"),
    "overlay_updates": with_views("select * from base where not exists (select 1 from upd where upd.doc_id = base.doc_id and upd.obj_num = base.obj_num) union all select * from upd", BASES, "object_revisions"),
    "object_listing": with_views("select doc_id, obj_num from base union select doc_id, obj_num from upd", BASES, "object_revisions"),
}
