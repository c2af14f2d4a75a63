"""Redaction: find runs that hold a term, remove them, report, cover, verify.

Whether a run holds a term is a column, computed where the run is: nothing is shuffled or joined. Terms, cleaned by one
expression, become an automaton (Aho-Corasick) that reads each distinct text of an Arrow batch once, so that the work grows
with the text, not with texts times terms; a handful of them are plain `contains`, which stay in compiled code. Terms that
are too large for a task's memory are a table that is joined with the pieces of the texts by equality.
"""

from __future__ import annotations

import uuid
from functools import reduce

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheafworks.functions.tables import fresh

#: Bytes of terms that an automaton takes (some 60 times as much memory in a task); beyond, terms are joined.
TERM_BYTES = 4 << 20
#: Up to this many cleaned terms are `contains` expressions; the column is the same, it is only faster.
FEW = 8
#: What is trimmed from terms: all white space, as a browser does.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_built: dict[str, object] = {}


def cased(text: Column, case_sensitive: bool) -> Column:
    return text if case_sensitive else F.lower(text)


def cleaned(term: Column, case_sensitive: bool = False) -> Column:
    """A term as it is looked for; null if it is blank."""
    t = cased(F.btrim(term, F.lit(WHITE)), case_sensitive)
    return F.when(t != "", t)


def searching(terms, key: str):
    """A column function: whether a text holds one of the broadcast terms; false for nulls. A worker builds the automaton once."""

    def automaton():
        if key not in _built:
            if len(_built) == 4:  # conditions of one stage take turns
                del _built[next(iter(_built))]
            a = _built[key] = ahocorasick.Automaton()
            for t in terms.value:
                a.add_word(t, True)
            a.make_automaton()
        return _built[key]

    def search(texts: pa.Array) -> pa.Array:
        a, coded = automaton(), texts.dictionary_encode()
        hit = pa.array([next(a.iter(t), None) is not None for t in coded.dictionary.to_pylist()], pa.bool_())
        return pc.fill_null(hit.take(coded.indices), False)

    return F.arrow_udf(search, "boolean")


def holds(runs: DataFrame, terms: list[str] | DataFrame, case_sensitive: bool = False) -> Column | None:
    """Whether run_text holds a term, also on streams; None if the terms are too large for that."""
    session = runs.sparkSession
    table = terms if isinstance(terms, DataFrame) else session.createDataFrame([(t,) for t in terms], "term string")
    table = table.select(cleaned(F.col("term"), case_sensitive).alias("t")).where("t is not null")
    if isinstance(terms, DataFrame):
        table = table.distinct()
        if (table.agg(F.sum(F.octet_length("t"))).first()[0] or 0) > TERM_BYTES:
            return None
    found = list(dict.fromkeys(r.t for r in table.collect()))
    if sum(len(t.encode()) for t in found) > TERM_BYTES:
        return None
    text = cased(F.col("run_text"), case_sensitive)
    if len(found) <= FEW:
        return reduce(lambda out, t: out | F.coalesce(F.contains(text, F.lit(t)), F.lit(False)), found, F.lit(False))
    return searching(session.sparkContext.broadcast(found), uuid.uuid4().hex)(text)


def texts_with(runs: DataFrame, terms: DataFrame, case_sensitive: bool) -> DataFrame:
    """(hit): the distinct texts, as they are compared, that hold a term of the table (term).

    A text's pieces of the lengths that terms have are joined with the terms by equality, so that the work does not grow
    with texts times terms. Only the distinct lengths reach the driver.
    """
    table = terms.select(cleaned(F.col("term"), case_sensitive).alias("t")).where("t is not null").distinct()
    lengths = sorted(r.n for r in table.select(F.length("t").alias("n")).distinct().collect())
    texts = runs.select(cased(F.col("run_text"), case_sensitive).alias("hit")).where("hit is not null").distinct()
    starts = F.sequence(F.lit(1), F.length("hit") - F.col("n") + 1)
    sized = texts.select("hit", F.explode(F.lit(lengths).cast("array<int>")).alias("n")).where(F.length("hit") >= F.col("n"))
    pieces = sized.select("hit", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("hit"), i, F.col("n"))))).alias("t"))
    return pieces.join(table, "t", "left_semi").select("hit").distinct()


def matched(runs: DataFrame, terms: list[str] | DataFrame, case_sensitive: bool, keep: bool) -> DataFrame:
    """Runs with a term in them (keep), or the others. Terms: a list, or a table (term)."""
    hit = holds(runs, terms, case_sensitive)
    if hit is not None:
        return runs.where(hit if keep else ~hit)
    table = terms if isinstance(terms, DataFrame) else runs.sparkSession.createDataFrame([(t,) for t in terms], "term string")
    name = fresh(runs, "hit")
    found = texts_with(runs, table, case_sensitive).withColumnRenamed("hit", name)
    return runs.join(found, cased(F.col("run_text"), case_sensitive) == F.col(name), "left_semi" if keep else "left_anti")


def hits(runs: DataFrame, terms: list[str] | DataFrame, name: str) -> DataFrame:
    """runs with a boolean column: whether run_text holds a term."""
    hit = holds(runs, terms)
    if hit is not None:
        return runs.withColumn(name, hit)
    some = matched(runs, terms, False, True).withColumn(name, F.lit(True))
    return some.unionByName(matched(runs, terms, False, False).withColumn(name, F.lit(False)))


def find_terms(runs: DataFrame, terms: list[str] | DataFrame, case_sensitive: bool = False) -> DataFrame:
    """Runs with a term in them, each once."""
    return matched(runs, terms, case_sensitive, True)


def redact_runs(runs: DataFrame, terms: list[str] | DataFrame, case_sensitive: bool = False) -> DataFrame:
    """What is left without the runs that hold a term; runs without text stay."""
    return matched(runs, terms, case_sensitive, False)


def redaction_boxes(runs: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """(doc_id, page_no, run_seq, x, y, w, h) of the rectangle over each matching run, a point wider on each side."""
    size = F.col("font_size")
    return find_terms(runs, terms).select(
        "doc_id", "page_no", "run_seq", (F.col("x") - 1.0).alias("x"), (F.col("y") - size * 0.25 - 1.0).alias("y"),
        (F.col("end_x") - F.col("x") + 2.0).alias("w"), ((F.col("y") + size * 0.85) - (F.col("y") - size * 0.25) + 2.0).alias("h"),
    )


def redaction_report(runs: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """Matching runs by page, by document and in all; level is 0, 1 and 3. Pages are added up first, then rolled up."""
    pages = hits(runs.select("doc_id", "page_no", "run_text"), terms, "hit").select("doc_id", "page_no", F.col("hit").cast("long").alias("hit")).groupBy("doc_id", "page_no").agg(F.sum("hit").alias("hit"))
    return pages.rollup("doc_id", "page_no").agg(F.sum("hit").alias("hits"), F.grouping_id().alias("level"))


def verify_redaction(runs: DataFrame, redacted: DataFrame, terms: list[str] | DataFrame) -> DataFrame:
    """(doc_id, remaining) for every document that had runs; all must be 0."""
    left = find_terms(redacted, terms).groupBy("doc_id").agg(F.count("*").alias("n"))
    return runs.select("doc_id").distinct().join(left, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("remaining"))
