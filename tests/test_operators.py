"""Edge cases and properties on small hand-made tables."""

import datetime
import os
import random
import re
import struct
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafworks.functions import colors, encoding
from sheafworks.operators import archive, objects, pages, raster, redact, text
from sheafworks.sources import files
from sheafworks.streaming import streams


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


@pytest.fixture(scope="module")
def paged(spark):
    docs = spark.createDataFrame([(1, "x" * 95), (2, ""), (3, "y" * 10)], "doc_id long, text string")
    return pages.paginate(docs, 10).cache()


def test_paginate_keeps_text_and_gives_a_page_at_least(paged):
    got = {(r.doc_id, r.page_no): r.page_text for r in paged.collect()}
    assert len([k for k in got if k[0] == 1]) == 10 and got[2, 1] == "" and got[3, 1] == "y" * 10
    assert "".join(got[1, k] for k in range(1, 11)) == "x" * 95


@pytest.mark.parametrize("ranges, want", [
    ("1-3, 5,8-12", {1: [1, 2, 3], 2: [5], 3: [8, 9, 10]}), ("5-3, 2", {2: [2]}), ("0, 99, abc, 4", {3: [4]}), ("2-999", {1: list(range(2, 11))}), ("0-2", {1: [1, 2]}), ("3-4,4-5", {1: [3, 4], 2: [4, 5]}),
])
def test_ranges(paged, ranges, want):
    got = {}
    for r in pages.split_by_ranges(paged.where("doc_id = 1"), ranges).orderBy("part_no", "page_no").collect():
        got.setdefault(r.part_no, []).append(r.page_no)
    assert list(got.values()) == list(want.values())


@pytest.mark.parametrize("ranges", ["", " , ", "abc", "1-2-3", "x-4"])
def test_no_valid_range_is_an_error(paged, ranges):
    with pytest.raises(ValueError):
        pages.split_by_ranges(paged, ranges)


def test_split_then_merge_gives_the_input(paged):
    p = pages.part_names(pages.split_chunks(paged.where("doc_id = 1"), 4), F.lit("d"))
    assert {r.part_name for r in p.select("part_name").collect()} == {"d-p1-4", "d-p5-8", "d-p9-10"}
    parts = p.select(F.col("part_no").cast("long").alias("doc_id"), "page_no", "page_text")
    order = parts.select("doc_id").distinct().select("doc_id", F.lit(0).alias("bundle_id"), F.col("doc_id").alias("input_order"))
    merged = pages.merge_documents(parts, order).orderBy("new_page_no").collect()
    assert "".join(r.page_text for r in merged) == "x" * 95 and [r.new_page_no for r in merged] == list(range(1, 11))


def test_a_giant_bundle_is_no_single_task(spark):
    order = spark.createDataFrame([(d, d % 2, -(d // 4)) for d in range(1, 20)], "doc_id long, bundle_id int, input_order int")
    parts = spark.createDataFrame([(d, k + 1) for d in range(1, 20) for k in range(d % 5)], "doc_id long, page_no int")
    got = pages.merge_documents(parts, order)
    assert not re.search(r"row_number\(\) windowspecdefinition\(bundle_id", got._jdf.queryExecution().toString())
    want = {b: sorted((-(d // 4), d, k + 1) for d in range(1, 20) if d % 2 == b for k in range(d % 5)) for b in (0, 1)}
    assert {(r.bundle_id, r.new_page_no, r.doc_id, r.page_no) for r in got.collect()} == {(b, n + 1, d, k) for b in want for n, (_, d, k) in enumerate(want[b])}
    dims = spark.createDataFrame([("x", k * 7, 100, 50) for k in range(9)], "brand string, image_id long, width int, height int")
    laid = raster.collage_layout(dims, "brand", 4, 400, 8)
    assert not re.search(r"row_number\(\) windowspecdefinition\(brand", laid._jdf.queryExecution().toString())
    assert {(r.image_id // 7, r.row, r.col, r.canvas_h) for r in laid.collect()} == {(k, k // 4, k % 4, 1232) for k in range(9)}


@pytest.fixture(scope="module")
def boxes(spark):
    odd = [-450, -45, 0, 44, 45, 359, 720]
    return spark.createDataFrame([(1, k + 1, None, None, None, None, r) if k == 0 else (1, k + 1, 0.0, None, 100.0, 0.0, r) for k, r in enumerate(odd)], "doc_id long, page_no int, llx double, lly double, urx double, ury double, rotate int")


def test_rotation_snaps_wraps_and_four_quarters_are_none(boxes):
    snapped = [r.rotate for r in pages.rotate_pages(boxes, 0).orderBy("page_no").collect()]
    assert snapped == [270, 0, 0, 0, 90, 0, 0]
    p = boxes
    for _ in range(4):
        p = pages.rotate_pages(p, 90)
    assert [r.rotate for r in p.orderBy("page_no").collect()] == snapped
    assert [r.rotate for r in pages.rotate_pages(boxes, 90, 5).orderBy("page_no").collect()] == [-450, -45, 0, 44, 180, 359, 720]


def test_boxes_default_and_crop_stays_one_wide(boxes):
    b = pages.effective_box(boxes).orderBy("page_no").collect()
    assert (b[0].urx, b[0].ury) == (612.0, 792.0) and (b[1].lly, b[1].ury) == (0.0, 0.0)
    same = pages.crop_pages(boxes, 0, 0, 0, 0).where("page_no = 1").first()
    assert (same.llx, same.lly, same.urx, same.ury) == (0, 0, 612, 792)
    for r in pages.crop_pages(boxes, 900, 900, 900, 900).collect():
        assert r.urx == r.llx + 1 and r.ury == r.lly + 1


def test_labels_replace_each_mark_once(boxes):
    p = pages.number_pages(boxes, "{n}/{total} {n}{total}", 3, "top-center", 10, text.widths("Helvetica")).orderBy("page_no").collect()
    assert p[0].label == "3/7 {n}{total}" and p[6].label == "9/7 {n}{total}"


RUNS = "doc_id long, page_no int, run_seq long, run_text string, font_size double, x double, y double, end_x double"


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame([
        (1, 1, 1, "The", 10.0, 0.0, 700.0, 15.0), (1, 1, 2, "Secret", 10.0, 20.0, 700.0, 50.0), (1, 1, 3, "s", 10.0, 51.0, 700.4, 56.0), (1, 1, 4, "end ", 10.0, 0.0, 680.0, 20.0),
        (1, 1, 5, " ", 10.0, 0.0, 660.0, 5.0), (1, 1, 6, "last", 10.0, 0.0, 640.0, 20.0), (2, 1, 1, None, 10.0, 0.0, 0.0, 0.0), (2, 2, 1, "secretly", 10.0, 0.0, 0.0, 40.0),
    ], RUNS)


def test_page_text(runs):
    got = {(r.doc_id, r.page_no): r.page_text for r in text.extract_page_text(runs.where("run_text is not null")).collect()}
    assert got[1, 1] == "The Secrets\nend\n\nlast"


def test_redaction_leaves_nothing_and_counts(spark, runs):
    terms = [" secret ", "", "  ", "SECRET"]
    left = redact.redact_runs(runs, terms)
    assert sorted(r.run_seq for r in left.where("doc_id = 1").collect()) == [1, 3, 4, 5, 6]
    assert {r.doc_id: r.remaining for r in redact.verify_redaction(runs, left, terms).collect()} == {1: 0, 2: 0}
    report = {(r.doc_id, r.page_no, r.level): r.hits for r in redact.redaction_report(runs, terms).collect()}
    assert report[None, None, 3] == 2 and report[1, None, 1] == 1 and report[2, 1, 0] == 0
    table = spark.createDataFrame([("secret",), (" ",), ("ecre",)], "term string")
    assert redact.find_terms(runs, table).count() == 2
    assert redact.find_terms(runs, ["secret"], True).count() == 1
    assert redact.redact_runs(runs, ["  "]).count() == runs.count()


def test_document_text(spark):
    p = spark.createDataFrame([(1, 2, "b", False), (1, 1, "a", True), (1, 10, "c", False)], "doc_id long, page_no int, page_text string, unmapped boolean")
    assert text.assemble_document(p).first().text == "a\n\nb\n\nc"
    r = text.assemble_document(p, True).first()
    assert r.text == "a\n\n——— Page 2 ———\n\nb\n\n——— Page 3 ———\n\nc" and r.had_unmapped and r.n_pages == 3


def test_codes_later_range_wins_and_fallbacks(spark):
    ranges = spark.createDataFrame([(1, 65, 90, 97), (3, 70, 72, 0x4E00)], "range_no int, lo int, hi int, base int")
    codes = spark.createDataFrame([(c,) for c in (65, 70, 33, 0x91, 0xE9, 5)], "code int")
    got = {r.code: (r.ch, r.unmapped) for r in text.decode_codes(codes, ranges).collect()}
    assert got == {65: ("a", False), 70: ("一", False), 33: ("!", False), 0x91: ("‘", False), 0xE9: ("é", False), 5: ("�", True)}
    assert {r.code for r in text.decode_codes(codes, ranges, False).where("unmapped").collect()} == {33, 0x91, 0xE9, 5}


def test_codes_are_decoded_where_they_lie(spark):
    ranges = spark.createDataFrame([(1, 0, 65535, 0), (2, 65, 90, 97)], "range_no int, lo int, hi int, base int")
    codes = spark.range(700, numPartitions=3).select(F.when(F.col("id") % 7 > 0, (F.col("id") % 97 + 32).cast("int")).alias("code"), F.spark_partition_id().alias("was"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(old, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        got = text.decode_codes(codes, ranges).select("code", "ch", "was", F.spark_partition_id().alias("now")).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(got) == 700 and all(r.was == r.now for r in got)
    assert all(r.ch == (chr(r.code + 32 if 65 <= r.code <= 90 else r.code) if r.code else "�") for r in got)


def test_graph_ends_in_cycles_and_ignores_parents(spark):
    e = spark.createDataFrame([("a", "b", "Font"), ("b", "c", "Next"), ("c", "a", "Next"), ("c", "p", "Parent"), ("q", "r", "Font")], "src string, dst string, kind string")
    assert {r.node for r in objects.reachable(e, spark.createDataFrame([("a",), ("zz",)], "node string")).collect()} == {"a", "b", "c", "zz"}
    m = spark.createDataFrame([("b", 7)], "old_id string, new_id int")
    assert {(r.src, r.dst): r.new_dst for r in objects.remap_refs(e, m).collect()}[("b", "c")] is None


def test_revisions_overlay_and_dense_ids(spark):
    t = lambda d: datetime.datetime(2024, 1, d)
    rev = spark.createDataFrame([(1, 5, t(1), 10, True), (1, 5, t(2), 20, False), (1, 9, t(1), 30, True), (1, 9, t(1), 31, True)], "doc_id long, obj_num long, section timestamp, byte_offset long, in_use boolean")
    got = objects.latest_revision(rev)
    assert {r.obj_num: r.byte_offset for r in got.collect()} == {5: 10, 9: 31}
    assert [r.new_id for r in objects.compact_ids(got).orderBy("obj_num").collect()] == [1, 2]
    up = spark.createDataFrame([(1, 9, t(3), 99), (1, 12, t(3), 5)], "doc_id long, obj_num long, section timestamp, byte_offset long")
    assert {r.obj_num: r.byte_offset for r in objects.overlay_updates(got, up, ["doc_id", "obj_num"]).collect()} == {5: 10, 9: 99, 12: 5}


def test_manifest_offsets_and_checksums(spark):
    data = [b"aaaaaaaaaa", b"", b"xyz"] * 3
    e = spark.createDataFrame([("z", k * 70_000, f"n{k}", len(d), 2, bytearray(d)) for k, d in enumerate(data)], "archive string, entry_no long, name string, size long, compressed_size long, data binary")
    at = 0
    for r, d in zip(archive.archive_manifest(e).orderBy("entry_no").collect(), data):
        stored = 2 >= len(d)
        assert (r.offset, r.method, r.crc, r.central_size) == (at, 0 if stored else 8, zlib.crc32(d), 48)
        at += 30 + 2 + (len(d) if stored else 2)


def test_delta_decode_undoes_differences(spark):
    values = [5, 250, 3, 3, 77, 0, 255]
    deltas = [(v - p) % 256 for p, v in zip([0, *values], values)]
    s = spark.createDataFrame([(1, k + 1, d) for k, d in enumerate(deltas)], "row_id long, pos long, delta int")
    assert [r.value for r in archive.delta_decode(s).orderBy("pos").collect()] == values


def test_uris(spark):
    uris = ["data:image/gif;base64,AAEC", "data:;base64,AAEC", " AA\n EC ", "data:image/xyz;base64,AAEC", "!!!", ""]
    df = spark.createDataFrame([(u,) for u in uris], "u string")
    mime, data, ext = encoding.parse_data_uri(F.col("u"), "image/jpeg")
    got = [(r[0], bytes(r[1]) if r[1] is not None else None, r[2]) for r in df.select(mime, data, ext).collect()]
    assert got[0] == ("image/gif", b"\0\1\2", "gif") and got[1] == ("image/png", b"\0\1\2", "png") and got[2] == ("image/jpeg", b"\0\1\2", "jpg")
    assert got[3][2] == "png" and got[4][1] is None


@pytest.mark.parametrize("digits, want", [("48 65 6c", b"Hel"), ("4", b""), ("zz41", b"A"), ("414", b"A"), ("", b"")])
def test_hex(spark, digits, want):
    assert bytes(one(spark, encoding.hex_decode(F.lit(digits)))[0]) == want


@pytest.mark.parametrize("n, want", [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (10240, "10 KB"), (5 * 1024**4, "5.0 TB")])
def test_sizes(spark, n, want):
    assert one(spark, encoding.format_bytes(F.lit(n).cast("long")))[0] == want


@pytest.mark.parametrize("name, want", [("a.b.png", "a.b-s.png"), ("plain", "plain-s.plain"), ("", "file-s.bin"), (None, "file-s.bin")])
def test_names(spark, name, want):
    assert one(spark, encoding.suggest_name(F.lit(name).cast("string"), "s"))[0] == want


def test_dates(spark):
    ts = F.lit("2024-03-05 17:09:59").cast("timestamp")
    assert one(spark, encoding.pdf_date(ts))[0] == "D:20240305T170959Z"
    assert tuple(one(spark, *encoding.dos_datetime(ts))) == ((44 << 9) | (3 << 5) | 5, (17 << 11) | (9 << 5) | 29)


def test_filter_identity_and_luminance(spark):
    p = spark.createDataFrame([(1, 0, 0, 10, 200, 255, 255), (1, 1, 0, 0, 0, 0, 0)], "image_id long, x int, y int, r int, g int, b int, a int")
    assert sorted(map(tuple, colors.css_filter(p).collect())) == sorted(map(tuple, p.collect()))
    assert colors.flatten_alpha(p).where("x = 1").first()[3:] == (255, 255, 255, 255)
    assert tuple(one(spark, *colors.rgb_to_hsl(*[F.lit(v) for v in (255, 0, 128)]))) == (330, 100, 50)


@pytest.fixture(scope="module")
def picture(spark):
    p = spark.createDataFrame([(1, x, y, x * 20, y * 20, (x + y) * 5, 255 if x else 0) for x in range(6) for y in range(4)], "image_id long, x int, y int, r int, g int, b int, a int")
    return p, spark.createDataFrame([(1, 6, 4)], "image_id long, width int, height int")


def test_four_turns_are_none(spark, picture):
    p, dims = picture
    out, d = p, dims
    for _ in range(4):
        out = raster.rotate_flip_pixels(out, d, 90)
        d = d.select("image_id", F.col("height").alias("width"), F.col("width").alias("height"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, p.collect()))
    assert sorted(map(tuple, raster.crop_pixels(p, dims, -5, -5, 99, 99).collect())) == sorted(map(tuple, p.collect()))


def test_blur_forms_agree(spark, picture):
    p, dims = picture
    arrays = {c: [v[c] for v in sorted(p.collect(), key=lambda r: (r.y, r.x))] for c in "rgba"}
    r = spark.createDataFrame([(1, 6, 4, *[arrays[c] for c in "rgba"])], "image_id long, width int, height int, r array<int>, g array<int>, b array<int>, a array<int>")
    key = lambda df: sorted(map(tuple, df.select("image_id", "x", "y", "r", "g", "b", "a").collect()))
    assert key(raster.blur_pixels(p, dims, 1)) == key(raster.raster_pixels(raster.blur_rasters(r, 1)))


def history_of(rows, k):
    out = {}
    for user, _, _, color in sorted(rows):
        h = out.setdefault(user, [])
        if color not in h:
            h.insert(0, color)
            del h[k:]
    return {u: ",".join(h) for u, h in out.items()}


def pick_rows():
    t0 = datetime.datetime(2024, 1, 1)
    return [(u, t0 + datetime.timedelta(seconds=k), k, f"#{(k * (7 + u) + k // 5) % 23:02d}") for u in (1, 2) for k in range(90)]


PICK = "user_id long, ts timestamp, event_id long, hex string"


def test_history_evicts_and_lets_colours_return(spark):
    got = raster.pick_history(spark.createDataFrame(pick_rows(), PICK), 16)
    assert {r.user_id: ",".join(r.history) for r in got.collect()} == history_of(pick_rows(), 16)


def test_history_of_a_heavy_user_is_no_array(spark):
    rows = [(u, t, k, None if u is None and k == 3 else h) for u, t, k, h in pick_rows() for u in ((u, None) if u == 1 else (u,))]
    got = raster.pick_history(spark.createDataFrame(rows, PICK).repartition(5), 16)
    assert "collect_list" not in got._jdf.queryExecution().toString()
    out = {r.user_id: r.history for r in got.collect()}
    assert {u: ",".join(out[u]) for u in (1, 2)} == history_of([r for r in rows if r[0]], 16) and len(out) == 3 and len(out[None]) == 16


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(name)


def test_histories_expire_and_late_picks_are_dropped(spark, tmp_path, rocks):
    """A stream that is stopped and started again between micro-batches, with picks in disorder, late ones and idle users."""
    at = lambda minute: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=minute)
    batches = [
        [(1, at(2), 2, "b"), (1, at(1), 1, "a"), (2, at(3), 3, "x")],
        [(1, at(60), 4, "c"), (1, at(59), 5, "a")],
        [(2, at(1), 6, "late"), (1, at(61), 7, "d")],
        [(3, at(200), 8, "z")],
        [(3, at(201), 9, "y")],
    ]
    seen: list[tuple] = []
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, PICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(PICK).parquet(str(tmp_path / "in"))
        out = streams.stream_pick_history(stream, 3, late="10 minutes", idle="90 minutes")
        q = out.writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend((r.user_id, tuple(r.history)) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
    last = {}
    for u, h in seen:
        last[u] = h
    assert (1, ("b", "a")) in seen and (1, ("c", "b", "a")) in seen and (1, ("d", "c", "b")) in seen
    assert not any("late" in h for _, h in seen)
    assert last == {1: (), 2: (), 3: ("y", "z")}
    with pytest.raises(ValueError):
        streams.stream_pick_history(stream, idle="1 minute")


def test_stream_history_equals_batch(spark, tmp_path, rocks):
    rows = pick_rows()
    for n in range(3):
        spark.createDataFrame(rows[n * 30 : n * 30 + 30] + rows[90 + n * 30 : 120 + n * 30], PICK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PICK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_pick_history(stream).writeStream.outputMode("update").format("memory").queryName("histories").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    last = {r.user_id: ",".join(r.history) for r in spark.table("histories").collect()}
    assert last == history_of(rows, 16)


def test_stream_redaction_equals_batch(spark, runs, tmp_path):
    some = runs.where("run_text is not null")
    some.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.stream_redact(stream, ["secret"]).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(redact.redact_runs(some, ["secret"]))


@pytest.mark.parametrize("n, joined", [(1, False), (8, False), (9, False), (201, False), (2000, True)])
def test_terms_are_cleaned_alike_however_many_they_are(spark, runs, monkeypatch, n, joined):
    """The same runs by finding, boxes, removal, report and verification, for lists, tables and streams, by automaton and by join.

    Runs have columns of the names that the operators use inside."""
    if joined:
        monkeypatch.setattr(redact, "TERM_BYTES", 3)
    terms = ["\t\xa0SECRET\n\ufeff", *[f"{k} \u3000" if k % 2 else f" \t{k}x" for k in range(1000, 999 + n)]]
    more = runs.unionByName(spark.createDataFrame([(3, 1, 1, "É 1001a", 10.0, 0.0, 0.0, 1.0), (3, 1, 2, "1002X", 10.0, 0.0, 0.0, 1.0), (3, 1, 2, "1002X", 10.0, 0.0, 0.0, 1.0)], RUNS))
    want = {(1, 1, 2), (2, 2, 1)} | ({(3, 1, 1), (3, 1, 2)} if n > 2 else set())
    for c in ("hit", "t", "n", "term", "_hit"):
        more = more.withColumn(c, F.lit("secret"))
    key = lambda df: sorted((r.doc_id, r.page_no, r.run_seq) for r in df.collect())
    full = sorted(k for k in key(more) if k in want)
    table = spark.createDataFrame([(t,) for t in [*terms, " ", "\n", None]], "term string")
    for given in ([*terms, "", "\u2003 "], table):
        assert key(redact.find_terms(more, given)) == full == key(redact.redaction_boxes(more, given))
        left = redact.redact_runs(more, given)
        assert key(left) == sorted(k for k in key(more) if k not in want)
        assert left.columns == more.columns
        assert {r.remaining for r in redact.verify_redaction(more, left, given).collect()} == {0}
        assert redact.redaction_report(more, given).where("level = 3").first().hits == len(full)
    if joined:
        with pytest.raises(ValueError):
            streams.stream_redact(more, terms)
    else:
        assert key(streams.stream_redact(more, terms)) == key(left)
    assert redact.find_terms(more, terms, True).count() == (0 if n < 3 else 1)
    assert "NestedLoop" not in redact.find_terms(more, table)._jdf.queryExecution().toString()


def test_a_hundred_thousand_terms_read_each_text_once(spark):
    r = random.Random(5)
    terms = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(100_000)]
    rows = [(k, 1, k, "x" * (k % 40) + (terms[k].upper() if k % 3 else "abcdefgh") + "yz", 1.0, 0.0, 0.0, 0.0) for k in range(300)]
    found = redact.find_terms(spark.createDataFrame(rows, RUNS), terms)
    assert sorted(x.doc_id for x in found.collect()) == [k for k in range(300) if k % 3]
    plan = found._jdf.queryExecution().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_a_path_given_twice_and_a_file_in_a_given_folder(spark, paged, tmp_path):
    paged.where("doc_id = 1").coalesce(1).write.parquet(str(tmp_path / "a"))
    paged.where("doc_id = 3").coalesce(1).write.parquet(str(tmp_path / "b"))
    one = str(next((tmp_path / "a").glob("*.parquet")))
    count = lambda paths: {(r.doc_id, r.input_order): r["count"] for r in files.read_corpus(spark, paths).groupBy("doc_id", "input_order").count().collect()}
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    assert count([a, a]) == {(1, 0): 10, (1, 1): 10}
    assert count([a, b, one, f"file://{a}/"]) == {(1, 0): 10, (3, 1): 1, (1, 2): 10, (1, 3): 10}
    assert count([one, a]) == {(1, 0): 10, (1, 1): 10}
    with pytest.raises(ValueError):
        files.read_corpus(spark, [f"{a}/*"])


def test_a_large_part_is_many_files_and_a_small_one_is_one(spark, tmp_path):
    rows = spark.range(60_000).select(F.when(F.col("id") < 50, "small").otherwise("large").alias("part_name"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        files.write_parts(rows.repartition(8), str(tmp_path / "parts"))
        files.write_parts(rows.where("part_name = 'small'"), str(tmp_path / "few"), rows_per_file=20)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    n = lambda folder, part: len(list((tmp_path / folder / f"part_name={part}").glob("*.parquet")))
    tasks = {f.name.split("-")[1] for f in (tmp_path / "parts" / "part_name=large").glob("*.parquet")}
    assert len(tasks) > 3 and n("parts", "small") == 1 and n("few", "small") == 3
    assert spark.read.parquet(str(tmp_path / "parts")).count() == 60_000


def test_values_come_down_deep_trees(spark):
    """A chain of 41 levels with leaves, columns of inner names, and ways that turn back."""
    rows = [(k, k - 1 if k else None, 7 if not k else k if k % 13 == 0 else None, None) for k in range(41)] + [(100 + k, k, None, "own" if k % 2 else None) for k in range(41)] + [(200, 999, None, None), (201, 200, None, None)]
    tree = spark.createDataFrame(rows, "node_id int, parent_id int, up int, node string")
    got = {r.node_id: (r.up, r.node) for r in objects.inherit_page_attrs(tree, ["up", "node"]).collect()}
    want = {k: (k // 13 * 13 or 7, None) for k in range(41)}
    assert got == want | {100 + k: (want[k][0], "own" if k % 2 else None) for k in range(41)} | {200: (None, None), 201: (None, None)}
    for odd in ([(1, 1, None)], [(1, 2, 5), (2, 3, None), (3, 1, None), (4, 1, 5)]):
        with pytest.raises(ValueError):
            objects.inherit_page_attrs(spark.createDataFrame(odd, "node_id int, parent_id int, a int"), ["a"])
    assert objects.inherit_page_attrs(tree.where("false"), ["up"]).count() == 0


@pytest.mark.parametrize("thin", [10_000, 0])
def test_closure_of_chains_cycles_and_hubs(spark, monkeypatch, thin):
    monkeypatch.setattr(objects, "THIN", thin)
    n = 500 if thin else 8
    rows = [(f"n{k}", f"n{k + 1}", "Kid") for k in range(n)] + [(f"n{n}", "n5", "Kid"), ("n3", "n1", "Parent"), ("n7", "out", "Parent"), ("n2", None, "Kid")]
    rows += [(f"n{k}", "hub", "Font") for k in range(n)] + [("hub", f"h{k}", "Kid") for k in range(50)] + [("other", "n0", "Kid")]
    written = []
    monkeypatch.setattr(objects, "cut", lambda df, cut=objects.cut: written.append(cut(df)) or written[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    got = [r.node for r in objects.reachable(spark.createDataFrame(rows, "src string, dst string, kind string"), spark.createDataFrame([("n0",), ("zz",)], "node string")).collect()]
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted(got) == sorted([f"n{k}" for k in range(n + 1)] + ["hub", "zz"] + [f"h{k}" for k in range(50)])
    left = [t for t in written if os.path.isdir(t.cut_at)]
    assert sum(t.count() for t in left) == len(got) and len(left) <= 8  # spent tables are gone


def test_one_picture_at_a_time(spark):
    size = 64
    raw = bytes(range(256)) * 64
    batch = pa.RecordBatch.from_arrays(
        [pa.array([f"p{k}" for k in range(5)]), pa.array([size] * 5, pa.int32()), pa.array([size] * 5, pa.int32()), pa.array([4, 4, 3, 1, 4], pa.int32()), pa.array([raw[: size * size * n] for n in (4, 4, 3, 1, 4)], pa.binary())],
        names=["origin", "width", "height", "nChannels", "data"],
    )
    for limit, sizes in ((1, [1] * 5), (16 * size * size * 2, [2, 2, 1]), (1 << 30, [5])):
        out = list(files.picture_batches(iter([batch]), limit))
        assert [b.num_rows for b in out] == sizes
        t = pa.Table.from_batches(out)
        assert t.column("b")[0].as_py()[:2] == [0, 4] and t.column("a")[2].as_py() == [255] * size * size and t.column("r")[3].as_py() == t.column("g")[3].as_py()


def test_a_picture_of_many_tiles_is_blurred_as_one(spark, monkeypatch):
    import math

    r = random.Random(1)
    w, h, radius = 37, 23, 1.5
    rows = [(7, x, y, *(r.randrange(256) for _ in range(4))) for x in range(w) for y in range(h) if r.random() < 0.9] + [(9, 0, 0, 255, 0, 0, 255)]
    dims = spark.createDataFrame([(7, w, h), (9, 1, 1)], "image_id long, width int, height int")
    p = spark.createDataFrame([(*x, 1, 2) for x in rows], "image_id long, x int, y int, r int, g int, b int, a int, width int, tx int")
    reach = math.ceil(3 * radius)
    k = [math.exp(-(d * d) / (2 * radius * radius)) for d in range(-reach, reach + 1)]
    k = [v / sum(k) for v in k]
    want = {}
    for image, iw, ih in ((7, w, h), (9, 1, 1)):
        near: dict = {}
        for i, x, y, cr, cg, cb, a in rows:
            if i == image:
                for dx in range(-reach, reach + 1):
                    for dy in range(-reach, reach + 1):
                        if 0 <= x + dx < iw and 0 <= y + dy < ih:
                            v = near.setdefault((x + dx, y + dy), [0.0] * 4)
                            for n, c in enumerate((cr * a / 255, cg * a / 255, cb * a / 255, a)):
                                v[n] += k[dx + reach] * k[dy + reach] * c
        for (x, y), v in near.items():
            want[image, x, y] = [*(min(255.0, c * 255 / v[3]) if v[3] > 0 else 0.0 for c in v[:3]), v[3]]
    for tile in (8, 256):
        monkeypatch.setattr(raster, "TILE", tile)
        got = {(x.image_id, x.x, x.y): (x.r, x.g, x.b, x.a) for x in raster.blur_pixels(p, dims, radius).collect()}
        assert got.keys() == want.keys() and all(abs(g - v) <= 0.5 + 1e-6 for key in want for g, v in zip(got[key], want[key], strict=True))


@pytest.mark.parametrize("order", [["page_no"], ["name"], ["name", "page_no"]])
def test_ranks_of_one_giant_document(spark, order):
    from sheafworks.functions import tables

    rows = spark.range(6_000).select(F.when(F.col("id") < 5_900, 1).when(F.col("id") < 5_990, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), (F.col("id") * 7919 % 6_000).alias("page_no"))
    rows = rows.withColumn("name", F.lpad(F.col("page_no").cast("string"), 6, "0")).withColumn("run", F.lit("mine"))
    got = tables.ranked(rows.repartition(4), ["doc_id"], order, "nth", "total", width=500)
    assert got.columns == [*rows.columns, "nth", "total"]
    place: dict = {}
    for r in sorted(got.collect(), key=lambda r: r.page_no):
        place[r.doc_id] = place.get(r.doc_id, 0) + 1
        assert (r.nth, r.total) == (place[r.doc_id], {1: 5_900, None: 90}.get(r.doc_id, 1))


INSIDE = ["run", "nth", "total", "wide", "first", "last", "doc", "part", "lo", "hi", "n", "before", "v", "inside", "earlier", "b", "o", "d", "inputs", "docs", "cell", "to", "shown", "up", "node", "further", "old", "new", "path", "hit", "t", "_n", "_first", "_run", "_v", "_s", "_x", "_y", "_to", "_piece", "_rows", "_d", "_i", "_b", "width_above", "doc_id_of", "run_of", "archive_of"]


def inside(df):
    return df.select("*", *[F.lit("mine").alias(c) for c in INSIDE if c not in df.columns])


@pytest.mark.parametrize("name", ["merge", "number", "chunks", "names", "ranges", "compact", "remap", "inherit", "codes", "icons", "delta", "manifest", "separators", "document", "collage", "crop", "shrink", "key"])
def test_columns_may_have_the_names_used_inside(spark, paged, runs, name):
    """The same rows with as without further columns, which stay where the operator keeps columns."""
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    box = paged.withColumns({c: F.lit(float(v)) for c, v in (("llx", 0), ("lly", 0), ("urx", 100), ("ury", 100))})
    pixel = make([(1, x, y, 9 * x, y, 7, 255) for x in range(4) for y in range(4)], "image_id long, x int, y int, r int, g int, b int, a int")
    dims = make([(1, 4, 4)], "image_id long, width int, height int")
    made = {
        "merge": (lambda w: pages.merge_documents(w(paged), make([(1, 5, 2), (3, 5, 1)], "doc_id long, bundle_id int, input_order int"))),
        "number": lambda w: pages.number_pages(w(box), "{n}/{total}", 1, "top-center", 9, text.widths("Helvetica")),
        "chunks": lambda w: pages.split_chunks(w(paged), 3),
        "names": lambda w: pages.part_names(w(paged.withColumn("part_no", F.lit(1))), F.lit("x")),
        "ranges": lambda w: pages.split_by_ranges(w(paged), "1-2, 2"),
        "compact": lambda w: objects.compact_ids(w(make([(1, 9), (1, 4), (2, 5)], "doc_id int, obj_num int"))),
        "remap": lambda w: objects.remap_refs(w(make([("a", "b")], "src string, dst string")), w(make([("b", 3)], "old_id string, new_id int"))),
        "inherit": lambda w: objects.inherit_page_attrs(w(make([(1, None, 5), (2, 1, None)], "node_id int, parent_id int, width int")), ["width"]),
        "codes": lambda w: text.decode_codes(w(make([(65,), (300,)], "code int")), make([(1, 65, 66, 97)], "range_no int, lo int, hi int, base int")),
        "icons": lambda w: archive.icon_directory(w(make([("z", 1, 10), ("z", 2, 20)], "archive string, entry_no int, size int"))),
        "delta": lambda w: archive.delta_decode(w(make([(1, 0, 250), (1, 1, 10)], "row_id int, pos int, delta int"))),
        "manifest": lambda w: archive.archive_manifest(w(make([("z", 1, "n", 10, 5), ("z", 2, "m", 10, 50)], "archive string, entry_no int, name string, size int, compressed_size int"))),
        "separators": lambda w: text.run_separators(w(runs)),
        "document": lambda w: text.assemble_document(w(paged.withColumn("unmapped", F.lit(False))), True),
        "collage": lambda w: raster.collage_layout(w(make([(1, 1, 4, 4), (2, 1, 3, 9)], "image_id long, brand int, width int, height int")), "brand", 1, 10, 2),
        "crop": lambda w: raster.crop_pixels(w(pixel), w(dims), 1, 1, 2, 2),
        "shrink": lambda w: raster.resize_pixels(w(pixel), w(dims), 2, 2),
        "key": lambda w: raster.chroma_key(w(pixel), 5.0, 5.0),
    }[name]
    plain = made(lambda df: df)
    more = made(inside)
    assert sorted(map(tuple, more.select(*plain.columns).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    if "run" in more.columns:
        assert {r.run for r in more.select("run").distinct().collect()} == {"mine"}


def test_corpus_paths_join_by_equality(spark, paged, tmp_path):
    odd = tmp_path / "a b+c%20d"
    for k in (1, 3):
        paged.where(F.col("doc_id") == k).repartition(3).write.parquet(str(odd / f"k={k}"))
    got = files.read_corpus(spark, [str(odd / "k=3"), str(odd / "k=1")])
    assert {(r.doc_id, r.input_order) for r in got.collect()} == {(3, 0), (1, 1)} and got.count() == 11


def test_text_width_of_odd_texts(spark):
    rows = [("A",), ("",), (None,), ("é\x01~",), ("\U0001f600",)]
    got = [r.w for r in spark.createDataFrame(rows, "t string").coalesce(1).select(pages.text_width(F.col("t"), text.widths("Helvetica")).alias("w")).collect()]
    assert got == [667, 0, None, 556 + 556 + 584, 556]


def png(width, height, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pictures_and_inventories(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(2, 1, [[(1, 2, 3, 255), (4, 5, 6, 255)]]))
    (tmp_path / "b.png").write_bytes(b"broken")
    (tmp_path / "c.txt").write_bytes(b"text")
    got = files.read_images(spark, str(tmp_path)).collect()
    assert len(got) == 1 and (got[0].r, got[0].g, got[0].b, got[0].a) == ([1, 4], [2, 5], [3, 6], [255, 255])
    assert {(r.name, r.extension, r.length) for r in files.list_files(spark, str(tmp_path), "*.txt").collect()} == {("c.txt", "txt", 4)}


def test_corpus_order_and_parts(spark, paged, tmp_path):
    for name, k in (("b", 1), ("a", 3)):
        paged.where(F.col("doc_id") == k).coalesce(1).write.parquet(str(tmp_path / name))
    got = files.read_corpus(spark, [str(tmp_path / "b"), str(tmp_path / "a")]).select("doc_id", "input_order").distinct().collect()
    assert {r.doc_id: r.input_order for r in got} == {1: 0, 3: 1}
    p = pages.part_names(pages.split_chunks(paged.where("doc_id = 1"), 5), F.lit("x"))
    files.write_parts(p, str(tmp_path / "parts"))
    assert {f.name for f in (tmp_path / "parts").iterdir() if f.is_dir()} == {"part_name=x-p1-5", "part_name=x-p6-10"}
    files.write_text(paged.where("doc_id = 3").withColumnRenamed("page_text", "text"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first().value == "y" * 10


def test_tiles_icons_and_palette(spark):
    d = spark.createDataFrame([(1, 30, 40)], "image_id long, width int, height int")
    t = raster.watermark_tiles(d, 0.0, 1.0).collect()
    assert len(t) == 9 and min(r.x for r in t) == -50.0 and max(r.y for r in t) == 30.0
    assert {r.size for r in raster.icon_set(d).where("in_ico").collect()} == {16, 32, 48}
    f = raster.fit_dims(spark.createDataFrame([(1, 3200, 1), (2, 10, 10)], "image_id long, width int, height int"), 1600).orderBy("image_id").collect()
    assert [(r.new_width, r.new_height) for r in f] == [(1600, 1), (10, 10)]


def test_empty_inputs(spark, paged, runs):
    none = paged.where("false")
    assert pages.split_chunks(none, 3).count() == 0 and pages.doc_stats(none).count() == 0
    assert text.extract_page_text(runs.where("false")).count() == 0
    assert archive.compress_report(spark.createDataFrame([], "width int, new_width int, size_before long, size_after long")).first().percent_saved == 0
