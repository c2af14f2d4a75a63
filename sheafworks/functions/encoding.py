"""Text columns: data URIs, hex, sizes, names, dates, information maps, picture summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheafworks.functions.tables import half_up

#: File endings of media types; orientation codes and what they mean; fields of an information map.
EXTENSIONS = {"image/png": "png", "image/jpeg": "jpg", "image/webp": "webp", "image/gif": "gif", "image/bmp": "bmp"}
ORIENTATIONS = {
    1: "Normal", 2: "Flipped horizontally", 3: "Rotated 180°", 4: "Flipped vertically", 5: "Rotated 90° CW + flipped",
    6: "Rotated 90° CW", 7: "Rotated 90° CCW + flipped", 8: "Rotated 90° CCW",
}
INFO_FIELDS = ("Title", "Author", "Subject", "Keywords", "Creator", "Producer")
BLANK = r"[\x09-\x0D\x20]"


def literal_map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def strip(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def to_data_uri(mime: Column, data: Column, prefix: bool = True) -> Column:
    coded = F.regexp_replace(F.base64(data), r"[\r\n]", "")
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), coded) if prefix else coded


def parse_data_uri(text: Column, default_mime: str = "image/png") -> tuple[Column, Column, Column]:
    """(media type, bytes, file ending); the bytes are null for bad input."""
    text = strip(text)
    is_uri = F.startswith(text, F.lit("data:"))
    head = F.substring(F.substring_index(text, ",", 1), 6, 1 << 30)
    named = F.substring_index(head, ";", 1)
    mime = F.when(~is_uri, F.lit(default_mime)).when(named == "", "image/png").otherwise(named)
    body = F.when(is_uri, F.expr("null").cast("string")).otherwise(text)
    body = F.coalesce(body, F.regexp_replace(text, "^[^,]*,", ""))
    data = F.try_to_binary(F.regexp_replace(body, BLANK, ""), F.lit("base64"))
    return mime, data, F.coalesce(F.element_at(literal_map(EXTENSIONS), mime), F.lit("png"))


def hex_encode(text: Column) -> Column:
    """Two digits for each character's Latin-1 byte; of characters beyond, for the low byte of each UTF-16 unit."""
    return F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(..)(..)", "$2")


def hex_decode(digits: Column) -> Column:
    """Bytes; characters that are no digits are skipped, and so is an odd last digit."""
    only = F.regexp_replace(digits, "[^0-9A-Fa-f]", "")
    return F.unhex(F.substring(only, F.lit(1), (F.floor(F.length(only) / 2) * 2).cast("int")))


def format_bytes(n: Column) -> Column:
    """B, KB, MB, GB, TB; one decimal below 10."""

    def scaled(power: int, unit: str) -> Column:
        x = n.cast("double") / F.lit(float(1024**power))
        one = (half_up(x * 10) / F.lit(10.0)).cast("string")
        return F.concat(F.when(x < 10, one).otherwise(half_up(x).cast("string")), F.lit(f" {unit}"))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB"))
        .when(n < 1024**3, scaled(2, "MB")).when(n < 1024**4, scaled(3, "GB")).otherwise(scaled(4, "TB"))
    )


def suggest_name(name: Column, suffix: str, ext: str | None = None) -> Column:
    named = F.when(name.isNull() | (name == ""), F.lit("file")).otherwise(name)
    base = F.regexp_replace(named, r"\.[^.]+$", "")
    last = F.substring_index(F.coalesce(name, F.lit("")), ".", -1)
    ending = F.lit(ext) if ext else F.when(last == "", "bin").otherwise(last)
    return F.concat(base, F.lit(f"-{suffix}" if suffix else ""), F.lit("."), ending)


def pdf_date(ts: Column) -> Column:
    return F.date_format(ts, "'D:'yyyyMMdd'T'HHmmss'Z'")


def dos_datetime(ts: Column) -> tuple[Column, Column]:
    """Packed date and time of archive entries."""
    day = F.shiftleft(F.year(ts) - 1980, 9).bitwiseOR(F.shiftleft(F.month(ts), 5)).bitwiseOR(F.dayofmonth(ts))
    time = F.shiftleft(F.hour(ts), 11).bitwiseOR(F.shiftleft(F.minute(ts), 5)).bitwiseOR(F.shiftright(F.second(ts), 1))
    return day, time


def view_info(info: Column) -> Column:
    """The six fields, '' where absent."""
    return F.create_map(*[x for f in INFO_FIELDS for x in (F.lit(f), F.coalesce(F.element_at(info, F.lit(f)), F.lit("")))])


def edit_info(info: Column, changes: dict[str, Column], ts: Column) -> Column:
    """A new map of the fields that are not empty, and the date of change."""
    fields = F.create_map(*[x for f in INFO_FIELDS for x in (F.lit(f), changes.get(f, F.coalesce(F.element_at(info, F.lit(f)), F.lit(""))))])
    return F.map_concat(F.map_filter(fields, lambda _, v: v != ""), F.create_map(F.lit("ModDate"), pdf_date(ts)))


def strip_info() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def image_summary(width: Column, height: Column, orientation: Column) -> tuple[Column, Column, Column]:
    """(dimensions, megapixels, orientation in words)."""
    size = F.concat(width.cast("string"), F.lit(" × "), height.cast("string"), F.lit(" px"))
    mega = width.cast("double") * height / F.lit(1e6)
    return size, mega, F.coalesce(F.element_at(literal_map(ORIENTATIONS), orientation), orientation.cast("string"))
