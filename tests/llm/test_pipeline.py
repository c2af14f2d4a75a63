"""The pipeline's stages, each on its predecessor's output, against brute force."""

import hashlib
import re
from collections import Counter

import pytest

import corpus_pipeline
from sheafworks.llm import quality
from test_suffixes import brute
from test_text_operators import brute_components, corpus


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus() if i is not None]
    docs = spark.createDataFrame(list(dict.fromkeys(rows)), "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        stage(spark, out[-1], None).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_copies", "repeated_passages", "sequences"]
    for df in stages[1:4]:
        assert df.columns == stages[0].columns
        assert all(r.n_chars == len(r.text) for r in df.collect())


def test_quality_stage(stages):
    verdict = quality.report(stages[0], **quality.PARAMS)
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in verdict.where("kept").collect()}
    assert [r.doc_id for r in stages[1].collect() if re.search("newsletter", r.text.lower())] == [400]


def test_near_copies_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    assert {r.doc_id for r in stages[2].collect()} == {i for i, _, c in brute_components(rows, 5, 80, 100) if i == c}


def test_passages_stage(stages):
    rows = [(r.doc_id, r.text) for r in stages[2].collect()]
    want = {i: (n, lost, sha) for i, n, lost, _, sha in brute(rows, 100)}
    for r in stages[3].collect():
        n, lost, sha = want.pop(r.doc_id)
        if r.text.isascii():
            assert len(r.text) == n - lost and hashlib.sha256(r.text.encode()).hexdigest() == sha
    assert all(lost == n for n, lost, _ in want.values())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sequences_stage(stages):
    """Each document's words and its end mark, in pieces, whole and in order."""
    got = {}
    for r in stages[4].collect():
        for i, s, a, b in zip(r.doc_ids, r.starts, r.offsets, [*r.offsets[1:], r.n_tokens]):
            got.setdefault(i, {})[s] = r.tokens[a:b]
        assert len(r.tokens) == r.n_tokens <= r.capacity
    assert {i: [w for s in sorted(x) for w in x[s]] for i, x in got.items()} == {r.doc_id: [*words(r.text), "\n"] for r in stages[3].collect()}


ODD = "doc_id long, text string, source string, n_chars long, lang string, _row int, removed_lines string, _removed int, _id int, _text string, text_key int, doc struct<text:string>, `a.b` int"


def test_stages_take_nulls_ties_and_odd_columns(spark):
    long = " ".join(f"w{k}" for k in range(30_000))
    some = " ".join(f"v{k}" for k in range(60))
    rows = [(1, some, "a"), (1, some, "a"), (2, some, None), (3, None, None), (4, "", "a"), (5, " \t", "b"), (None, some, "a"), (None, long, None), (6, long + " end", "b"), (7, "x " * 25, "b")]
    more = (7, "r", 8, 9, "t", 10, (some,), 11)
    docs = spark.createDataFrame([(*r, None, None, *more) for r in rows], ODD).coalesce(1)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        if k == 3:
            assert sum(r.n_tokens for r in out.collect()) == sum(len(words(r[1])) + 1 for r in rows)
            continue
        assert out.columns == docs.columns
        got = out.collect()
        assert all(tuple(r)[5:] == (*more[:6], (some,), 11) for r in got)
        ids = Counter(r.doc_id for r in got)
        want = [{1: 2, 2: 1, None: 2, 6: 1}, {1: 2, None: 2, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}, {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1}][k]  # 6 holds all of the long text without an id
        assert ids == want, (k, ids)


def test_stages_of_nothing(spark):
    docs = spark.createDataFrame([], ODD)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, None)
        assert out.count() == 0 and (k == 3 or out.columns == docs.columns)


def test_run_gives_the_last_stage(spark, stages):
    import os

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("driver's tables are not here")
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns == stages[4].columns
