"""Quality rules: per-text counts and cross-document line frequency, with built-in functions only.

A line is normalised (white space runs to one blank, ends trimmed, lower case) and hashed; for every host the documents
that hold it are counted. A line in more than `limit` documents of a host is removed from all of them but the one with
the smallest id, so that a page of which a host has many copies is left once; without `keep_first` from all. A document is
rejected if a base rule fails, or if it is depleted: fewer than `min_words` words are left, or more than `max_removed` of
them went.

The texts are read once: each row's counts and the hashes of its lines are written to a table, on which all else works.

Defined cases: a null or blank text has no words and fails the base rule; a null host is a host of its own; rows that
share an id count as one document, those with a null id each as one, and equal rows get equal results; of lines whose
documents all have null ids none is left, a smallest id that is repeated keeps its lines in each of its rows; other columns of the input, whatever their names, stay
untouched in `keep`; an empty table gives an empty result. Very long texts are one row each and are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheafworks.llm.common import SPACE, documents, named, stash

#: Production parameters. The limit is a number of documents and no share, so that it means the same on a host of any size.
PARAMS = {"limit": 20, "min_words": 10, "max_removed": 0.5}
BLANKS = " \t\n\x0b\x0c\r"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    cut = F.btrim(text, F.lit(BLANKS))
    return F.when(cut == "", F.array().cast("array<string>")).otherwise(F.split(cut, SPACE + "+"))


def repeat_words(w: Column, span: int = 8) -> Column:
    """Words of w that lie in a window of span words which occurs twice or more."""

    def covered(seen: Column) -> Column:
        tagged = F.sort_array(F.transform(seen, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = let(
            tagged,
            lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))),
        )
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + span).alias("end"), (acc["n"] + i + span - F.greatest(i, acc["end"])).alias("n"))
        return F.aggregate(starts, zero, step, lambda acc: acc["n"])

    def windows(hashes: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(hashes) - (span - 1)), lambda i: F.xxhash64(F.slice(hashes, i, span)))

    found = let(
        let(F.transform(w, lambda x: F.xxhash64(x)), windows),
        lambda seen: F.when(F.size(F.array_distinct(seen)) < F.size(seen), covered(seen)).otherwise(F.lit(0).cast("long")),
    )
    return F.when(F.size(w) > span, found).otherwise(F.lit(0).cast("long"))


def base_counts(text: Column) -> Column:
    """Struct of the counts of one text."""

    def dup_lines(lines: Column) -> Column:
        return let(F.filter(lines, lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))

    text = F.coalesce(text, F.lit(""))
    return let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            dup_lines(F.split(text, "\n", -1)).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def line_hashes(text: Column) -> Column:
    """Hash and number of words of each line's normal form; null for lines without a word."""
    text = F.regexp_replace(F.lower(F.regexp_replace(text, r"[\t\x0B\x0C\r]", " ")), " {2,}", " ")
    n_words = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    one = lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("line"), n_words(x).alias("n")))
    return F.transform(F.split(text, "\n", -1), lambda raw: let(F.btrim(raw), one))


def examined(docs: DataFrame, doc_id: str, text: str, host: str, whole: bool) -> DataFrame:
    """A written table: row, id, host, base counts b, lines; with whole also the document as a struct."""
    doc = [F.struct(*map(named, docs.columns)).alias("doc")] if whole else []
    return stash(docs.select(F.monotonically_increasing_id().alias("row"), named(doc_id).alias("id"), named(host).alias("host"), base_counts(named(text)).alias("b"), line_hashes(named(text)).alias("lines"), *doc))


def frequent_lines(rows: DataFrame, limit: int) -> DataFrame:
    """(host, line, n_docs, first) of the lines in more than limit documents; an id counts once for each line, a null id each time.

    Counted in two steps, by line and id first, so that a line that is everywhere is no single task."""
    once = F.array_distinct(F.transform(F.filter("lines", lambda x: x.isNotNull()), lambda x: x["line"]))
    lines = rows.select("host", "id", F.explode(once).alias("line"))
    each = lines.groupBy("host", "line", "id").agg(F.count("*").alias("n")).withColumn("n", F.when(F.col("id").isNull(), F.col("n")).otherwise(F.lit(1).cast("long")))
    return each.groupBy("host", "line").agg(F.sum("n").alias("n_docs"), F.min("id").alias("first")).where(F.col("n_docs") > limit)


def judged(rows: DataFrame, limit: int, min_words: int, max_removed: float, keep_first: bool = True) -> DataFrame:
    """rows with n_removed_words, removed_lines (places of lines, null if none), base_failed, kept."""
    often = frequent_lines(rows, limit).select(F.col("host").alias("h"), F.col("line").alias("l"), "first")
    lines = rows.select("row", "id", "host", F.posexplode("lines").alias("pos", "x")).where("x is not null").select("row", "id", "host", "pos", "x.line", "x.n")
    gone = lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("l")))
    if keep_first:
        gone = gone.where(~F.col("id").eqNullSafe(F.col("first")) | F.col("id").isNull())
    gone = gone.groupBy("row").agg(F.sum("n").alias("n_gone"), F.sort_array(F.collect_list("pos")).alias("removed_lines"))
    out = rows.join(gone, "row", "left").withColumn("n_removed_words", F.coalesce("n_gone", F.lit(0)).cast("long"))
    out = out.withColumn("base_failed", (F.col("b.n_words") < 20) | (100 * F.col("b.n_repeat_words") > 30 * F.col("b.n_words")))
    left = F.col("b.n_words") - F.col("n_removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= min_words) & (F.col("n_removed_words") <= max_removed * F.col("b.n_words")))


def report(docs: DataFrame, limit: int, min_words: int, max_removed: float, keep_first: bool = True, doc_id: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row per document: doc_id, its counts, words lost with frequent lines and their places, verdicts."""
    out = judged(examined(docs, doc_id, text, host, False), limit, min_words, max_removed, keep_first)
    return out.select(F.col("id").alias("doc_id"), "b.*", "n_removed_words", "removed_lines", "base_failed", "kept")


def keep(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **params) -> DataFrame:
    """The documents that the rules keep, with all their columns, without the lines above the limit."""
    rows = examined(docs, doc_id, text, host, True)
    verdict = judged(rows.drop("doc"), **(PARAMS | params)).where("kept").select("row", "removed_lines")
    whole = F.col("doc").getField(text)
    lines = F.filter(F.split(whole, "\n", -1), lambda _, i: ~F.array_contains(F.col("removed_lines"), i))
    cleaned = F.when(F.col("removed_lines").isNull(), whole).otherwise(F.array_join(lines, "\n"))
    return rows.select("row", "doc").join(verdict, "row").select(*[(cleaned if c == text else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def op10_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir), **PARAMS).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


ORACLE = rf"""
with d as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
l as (select doc_id, source, unnest(l) as raw from d),
nl as (select doc_id, source, raw, lower(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g'))) as line from l where regexp_matches(raw, '[^\x20\x09-\x0D]')),
often as (select source, line, min(doc_id) as first from nl group by source, line having count(distinct doc_id) > {PARAMS["limit"]}),
lost as (select doc_id, sum(len(string_split(nl.line, ' '))) as n from nl join often o on nl.source is not distinct from o.source and nl.line = o.line where doc_id <> first group by doc_id),
dup as (select doc_id, count(*) - count(distinct raw) as n from nl group by doc_id),
win as (select doc_id, unnest(range(1, len(w) - 6)) as i, w from d where len(w) > 8),
g as (select doc_id, i, array_to_string(w[i : i + 7], ' ') as t from win),
twice as (select doc_id, i, count(*) over (partition by doc_id, t) as c from g),
cov as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) as n from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from twice where c > 1) group by doc_id),
b as (select d.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words, coalesce(lost.n, 0)::bigint as n_removed_words
  from d left join dup using (doc_id) left join cov using (doc_id) left join lost using (doc_id))
select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_removed_words >= {PARAMS["min_words"]} and n_removed_words <= {PARAMS["max_removed"]}::double * n_words as kept
from b
"""
QUERIES = {"op10_line_frequency": op10_line_frequency}
ORACLES = {"op10_line_frequency": ORACLE}
