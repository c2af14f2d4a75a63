"""WARC as a PySpark data source, read and written.

Reading: files are planned into partitions by size alone; the task that reads a range finds its first record. Archives
written here have a small file of member starts beside them, which only that task opens; in others the first start is
searched: a member (or plain record) that is whole and is followed by another one or the end. Equality, membership and prefix predicates on the record's type and headers are pushed down; a
record's headers are parsed first, and the payload of a record that no predicate keeps, or that the read schema doesn't
ask for, is skipped without decoding: by seeking in plain files and in compressed files whose members carry their
length, otherwise by inflating without keeping. Members that are decoded whole are held against their checksum.

Writing: one compressed member for each record, with its length in the member's extra field; each task writes files of
its own, and each commit adds a manifest of the names that count, so files of lost or repeated tasks are never read.
Archives of other makers count without a manifest, before and after; archives made here that lie in a folder without one
(copied there, say) are listed by the first commit, if they were there when its job began. Overwriting replaces manifests
and deletes archives; MANIFESTS manifests are made one.

Defined cases: a null payload is an empty one; null headers are left out; empty tables give no file and no rows;
records of any length up to what one row may hold; equal rows are records of their own; columns other than the record's
are ignored.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, StringStartsWith, WriterCommitMessage

from sheafworks.llm.common import documents, drop, shared_dir, stash

#: Column of the table, header of the record.
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_length": "X-Payload-Length"}
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_length long, content_type string, payload binary"
MANIFEST, STARTS, MANIFESTS, LEVEL, ROLL = "_manifest-", "_starts-", 32, 4, 256 << 20
#: Bytes read at once where a record's head is looked for, and bytes between listed starts of an archive.
HEAD, STEP = 256 << 10, 8 << 20
ARCHIVE, OURS = re.compile(r"\.warc(\.gz)?$"), re.compile(r"^[0-9a-f]{32}\.warc\.gz$")
MAGIC, PLAIN = b"\x1f\x8b\x08", b"WARC/1."


def opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Ranges(InputPartition):
    """(path, first byte, end); records belong to where they begin."""

    def __init__(self, ranges: list[tuple[str, int, int]]):
        self.ranges = ranges


class WarcSource(DataSource):
    """Options: path; partition_bytes (64 MB), how much of the files one partition takes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"], schema, int(self.options.get("partition_bytes", 64 << 20)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(self.options["path"], overwrite)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema, partition_bytes: int):
        self.path, self.names, self.partition_bytes = path, [f.name for f in schema.fields], partition_bytes
        self.tests: list[tuple[str, str, tuple]] = []

    def pushFilters(self, filters):
        """Predicates on headers are taken; the others go back to Spark."""
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and name != "payload_length" and isinstance(f, (EqualTo, In, StringStartsWith)):
                self.tests.append((name, "starts" if isinstance(f, StringStartsWith) else "in", tuple(f.value) if isinstance(f, In) else (f.value,)))
            else:
                yield f

    def partitions(self):
        found, _, counts = listing(*opened(self.path))
        ranges = [(x.path, i, min(x.size, i + self.partition_bytes)) for x in found if counts(x.base_name) for i in range(0, max(1, x.size), self.partition_bytes)]
        groups: list[list] = []
        for r in sorted(ranges, key=lambda r: r[1] - r[2]):  # largest first, into the emptiest partition that has room
            size = r[2] - r[1]
            room = [g for g in groups[-64:] if g[0] + size <= self.partition_bytes]
            g = min(room, key=lambda g: g[0]) if room else groups.append([0, []]) or groups[-1]
            g[0] += size
            g[1].append(r)
        return [Ranges(g[1]) for g in groups] or [Ranges([])]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, kind, values in self.tests:
            v = headers.get(HEADERS[name].lower())
            if v is None or not (v.startswith(values[0]) if kind == "starts" else v in values):
                return False
        return True

    def read(self, partition):
        store, _ = opened(self.path)
        payload = "payload" in self.names
        for path, begin, end in partition.ranges:
            with store.open_input_file(path) as f:
                whole = begin == 0 and end >= f.size()
                begin, end, known = (begin, end, True) if whole else known_range(store, path, f.size(), begin, end)
                for headers, body in records(Window(f), path.endswith(".gz"), self.wanted, payload, begin, end, known):
                    yield tuple(self.value(name, headers, body) for name in self.names)

    def value(self, name: str, headers: dict[str, str], body: bytes | None):
        if name == "payload":
            return body
        if name == "content_type":
            return headers.get("content-type")
        v = headers.get(HEADERS[name].lower())
        return int(v) if name == "payload_length" and v is not None else v


def parse_head(raw: bytes) -> tuple[dict[str, str], int] | None:
    """Headers (names lowered) and where the block begins; None if raw ends before."""
    end = raw.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = raw[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}, end + 4


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block


def listing(store, top: str):
    """The folder's files, the names that its manifests list (None without manifests), and which archives count."""
    from pyarrow import fs

    for last in (False, False, True):
        found = store.get_file_info(fs.FileSelector(top, allow_not_found=True))
        manifests = [x for x in found if x.base_name.startswith(MANIFEST)]
        listed: set[str] = set()
        try:
            for x in manifests:
                with store.open_input_stream(x.path) as f:
                    listed.update(json.loads(f.read()))
            break
        except FileNotFoundError:  # another commit made several manifests one meanwhile
            if last:
                raise
    named = listed if manifests else None
    return found, named, lambda name: bool(ARCHIVE.search(name)) and (named is None or name in named or not OURS.match(name))


def known_range(store, path: str, size: int, begin: int, end: int) -> tuple[int, int, bool]:
    """Both ends at the next listed start, if starts are listed; whether the first is known to begin a record."""
    top, _, name = path.rpartition("/")
    try:
        with store.open_input_stream(f"{top}/{STARTS}{name}.json") as f:
            starts = [0, *json.loads(f.read()), size]
    except FileNotFoundError:
        return begin, end, begin == 0
    return *(min(x for x in starts if x >= min(at, size)) for at in (begin, end)), True


class Window:
    """Bytes of a file by place; neighbouring short reads share one long one."""

    def __init__(self, f):
        self.f, self.size, self.at, self.held = f, f.size(), 0, b""

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        if at < self.at or at + n > self.at + len(self.held):
            self.f.seek(at)
            self.at, self.held = at, self.f.read(max(n, HEAD))
        return self.held[at - self.at : at - self.at + n]


class Member:
    """A gzip member: its length if it carries it, and its text as far as it was asked for."""

    def __init__(self, w: Window, at: int):
        self.w, self.at, head = w, at, w.get(at, 20)
        self.length = struct.unpack_from("<I", head, 16)[0] if len(head) == 20 and head[3] & 4 and head[12:14] == b"sl" else None
        self.inflate, self.read, self.text, self.end = zlib.decompressobj(31), at, bytearray(), None

    def more(self, keep: bool = True) -> bool:
        """Inflates some more; false at the member's end, whose checksum zlib verifies."""
        if self.end is not None:
            return False
        raw = self.w.get(self.read, min(HEAD, (self.length or HEAD) - (self.read - self.at if self.length else 0)))
        if not raw:
            raise ValueError(f"the member at byte {self.at} has no end")
        got = self.inflate.decompress(raw)
        self.read += len(raw)
        if keep:
            self.text += got
        if self.inflate.eof:
            self.end = self.read - len(self.inflate.unused_data)
        return True

    def head(self) -> tuple[dict[str, str], int]:
        if self.length:  # a small piece will do
            text = zlib.decompressobj(31).decompress(self.w.get(self.at, min(self.length, 4096)), 16 << 10)
            if (found := parse_head(text)) is not None:
                return found
        while (found := parse_head(self.text)) is None:
            if not self.more():
                raise ValueError(f"the member at byte {self.at} holds no record")
        return found

    def whole(self) -> bytes:
        while self.more():
            pass
        return bytes(self.text)

    def skip(self) -> int:
        """Where the next member begins."""
        if self.length and self.end is None:
            return self.at + self.length
        while self.more(False):
            pass
        return self.end


def plain_head(w: Window, at: int) -> tuple[dict[str, str], int]:
    n = 4096
    while (found := parse_head(w.get(at, n))) is None:
        if at + n >= w.size:
            raise ValueError(f"the record at byte {at} has no end")
        n *= 4
    return found


def after(w: Window, at: int, compressed: bool) -> int | None:
    """Where the record that begins at this byte ends, or None if none does."""
    try:
        if compressed:
            m = Member(w, at)
            end = (m.whole(), m.end)[1] if m.text.startswith(PLAIN) or (m.more() and m.text.startswith(PLAIN)) else None
            return end if end is not None and parse_head(m.text) else None
        headers, begin = plain_head(w, at)
        end = at + begin + int(headers["content-length"]) + 4
        return end if "warc-type" in headers and end <= w.size and w.get(end - 4, 4) == b"\r\n\r\n" else None
    except (ValueError, KeyError, zlib.error):
        return None


def first_start(w: Window, begin: int, end: int, compressed: bool) -> int:
    """The first place from begin on where a whole record begins that another one or the end follows; end if none does."""
    mark, at = MAGIC if compressed else PLAIN, begin
    while at < end:
        found = w.get(at, HEAD).find(mark)
        if found < 0:
            at += HEAD - len(mark) + 1
            continue
        at += found
        if at < end and (compressed or w.get(at - 4, 4) == b"\r\n\r\n"):
            following = after(w, at, compressed)
            if following is not None and (following == w.size or w.get(following, len(mark)) == mark):
                return at
        at += 1
    return end


def records(w: Window, compressed: bool, wanted, payload: bool, begin: int, end: int, known: bool) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, payload or None) of the records that are wanted and begin in begin..end."""
    at = begin if known else first_start(w, begin, end, compressed)
    while at < end:
        if compressed:
            m = Member(w, at)
            headers, start = m.head()
            if wanted(headers):
                yield headers, payload_of(headers, m.whole()[start : start + int(headers["content-length"])]) if payload else None
            at = m.skip()
        else:
            headers, start = plain_head(w, at)
            n = int(headers["content-length"])
            if wanted(headers):
                yield headers, payload_of(headers, w.get(at + start, n)) if payload else None
            at += start + n + 4


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        found, listed, _ = listing(*opened(path))
        self.adopted = [x.base_name for x in found if OURS.match(x.base_name)] if listed is None and not overwrite else []

    def write(self, iterator):
        store, top = opened(self.path)
        store.create_dir(top, recursive=True)
        files, out, size, starts = [], None, 0, []

        def close():
            out.close()
            if starts:
                with store.open_output_stream(f"{top}/{STARTS}{files[-1]}.json") as f:
                    f.write(json.dumps(starts).encode())

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or size > ROLL:
                        if out is not None:
                            close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        size, starts = 0, []
                        out = store.open_output_stream(f"{top}/{files[-1]}", compression=None)
                    if size - (starts[-1] if starts else 0) > STEP:
                        starts.append(size)
                    data = member(row)
                    size += len(data)
                    out.write(data)
        finally:
            if out is not None:
                close()
        return Written(files)

    def commit(self, messages):
        store, top = opened(self.path)
        store.create_dir(top, recursive=True)
        new = [k for m in messages if m for k in m.files]
        found, _, _ = listing(store, top)
        manifests = [x for x in found if x.base_name.startswith(MANIFEST)]
        names, spent = [*self.adopted, *new], []
        if self.overwrite:
            kept = {*new, *(f"{STARTS}{k}.json" for k in new)}
            spent = [x for x in found if x.base_name not in kept and (x.base_name.startswith((MANIFEST, STARTS)) or ARCHIVE.search(x.base_name))]
        elif len(manifests) >= MANIFESTS:
            spent = manifests
            for x in manifests:
                with store.open_input_stream(x.path) as f:
                    names += json.loads(f.read())
        with store.open_output_stream(f"{top}/{MANIFEST}{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(list(dict.fromkeys(names))).encode())
        # manifests first: a reader never meets one whose files are gone
        for x in sorted(spent, key=lambda x: not x.base_name.startswith(MANIFEST)):
            store.delete_file(x.path)

    def abort(self, messages):
        """Nothing is listed, so nothing is read; the files of the tasks that ended go."""
        from pyarrow import fs

        store, top = opened(self.path)
        for name in (k for m in messages if m for k in m.files):
            for path in (f"{top}/{name}", f"{top}/{STARTS}{name}.json"):
                if store.get_file_info(path).type != fs.FileType.NotFound:
                    store.delete_file(path)


def member(row: dict) -> bytes:
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {row.get('content_type') or 'text/html; charset=utf-8'}\r\n".encode()
    block += b"\r\n" if kind == "revisit" else f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines = ["WARC/1.1"] + [f"{header}: {clean}" for name, header in HEADERS.items() if row.get(name) is not None and (clean := re.sub(r"[\r\n]+", " ", str(row[name])))]
    if kind == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    record = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = 12 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def mark_revisits(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, payload) as records: of equal payloads of least bytes or more the largest id is the
    response, the others revisit it. Only ids and digests are grouped; the payloads are moved once, by page."""
    digest = F.sha1(F.coalesce("payload", F.lit(b"")))
    small = pages.select("page_id", digest.alias("digest"), F.octet_length(F.coalesce("payload", F.lit(b""))).alias("n")).where(F.col("n") >= least)
    last = small.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count("*").alias("c")).where("c > 1").select("digest", "refers")
    revisits = small.join(last, "digest").where("page_id < refers or page_id is null").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers").distinct()
    out = pages.withColumn("digest", digest)
    return out.join(revisits, out["page_id"].eqNullSafe(revisits["p"]) & (out["digest"] == revisits["d"]), "left").drop("p", "d")


def to_records(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages with digest and refers as rows of SCHEMA; digests go out in base 32, as is usual in WARC."""

    @F.pandas_udf("string")
    def base32(hexes):
        return hexes.map(lambda x: "sha1:" + base64.b32encode(bytes.fromhex(x)).decode())

    urn = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    revisit = F.col("refers").isNotNull()
    return pages.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"),
        F.when(revisit, urn("refers")).alias("refers_to"), base32("digest").alias("payload_digest"), F.octet_length(F.coalesce("payload", F.lit(b""))).cast("long").alias("payload_length"),
        F.lit("text/html; charset=utf-8").alias("content_type"), F.when(~revisit, F.col("payload")).alias("payload"),
    )


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Per record of an archive of pages: ids, type, and length and digest of the full payload."""

    @F.pandas_udf("string")
    def base16(digests):
        return digests.map(lambda x: base64.b32decode(x.removeprefix("sha1:")).hex())

    number = lambda c: F.regexp_extract(c, r"^<urn:x-page:(-?\d+)>$", 1).try_cast("long")
    register(spark)
    # Two reads: payloads are decoded for responses only, and no payload at all for revisits.
    full = spark.read.format("warc").load(path).where("record_type = 'response'").select("record_id", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    heads = spark.read.format("warc").schema(SCHEMA.replace(", payload binary", "")).load(path).where("record_type = 'revisit'")
    heads = heads.select("record_id", "record_type", "refers_to", F.col("payload_length").alias("payload_bytes"), base16("payload_digest").alias("payload_digest"))
    return full.unionByName(heads).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = documents(spark, sf_dir, "pages").select("page_id", "url", F.encode(F.col("html"), "UTF-8").alias("payload"))
    register(spark)
    path = shared_dir(spark)
    to_records(mark_revisits(pages)).write.format("warc").mode("append").save(path)
    archive = spark.read.format("warc").load(path)
    out = stash(read_back(spark, path))  # a few numbers for each page, so that the archive may go
    archive.stashed_at = path
    drop(archive)
    return out


QUERIES = {"op3_warc": op3_warc}
ORACLES = {
    "op3_warc": """
with p as (select page_id, coalesce(html, '') as h, sha1(coalesce(html, '')) as s, strlen(coalesce(html, '')) as n from pages),
g as (select s, max(page_id) as last from p where n >= 1000 group by s)
select page_id, n as payload_bytes, p.s as payload_digest, case when n >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id < last then last end as refers_to
from p left join g on p.s = g.s
"""
}
