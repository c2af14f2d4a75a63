"""Quality rules, Jaccard join, passages, packing and sharding against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from sheafworks.llm import common, jaccard, packing, quality, sharding, windows


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(seed=11):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "日本", "The"]
    text = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = [(i, text(r.randint(0, 90)), f"src{i % 3}") for i in range(80)]
    bases = [text(120), text(70), text(30)]
    for k in range(45):
        w = bases[k % 3].split(" ")
        for _ in range(k // 9):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((200 + k, " ".join(w), "src0"))
    passage = text(60)
    rows += [(300 + k, f"{text(20)}\n{passage}\n{text(25)}", None if k == 3 else "src1") for k in range(6)]
    line = "Subscribe to our newsletter for more stories like this one"
    rows += [(400 + k, "\n".join([text(12), line.upper() if k % 2 else f"  {line}\t", text(14), text(3)]), "src2") for k in range(60)]
    rows += [(500, "", "src0"), (501, None, "src0"), (502, " \t\n", None), (503, "one two", "src0"), (504, "one two", "src1"), (505, "a b c d e f g h " * 30, "src0"), (506, text(6000), "src0"), (None, bases[0], "src0"), (507, "x\n\nx\n \nx", "src0")]
    return [*rows, rows[3], rows[3]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([(*row, k, "b", 1.5) for k, row in enumerate(rows)], "doc_id long, text string, source string, row long, block string, n double").repartition(3).cache()


def sorted_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# --- quality rules ---
def test_quality_matches_sql(docs):
    con = duckdb.connect()
    pdf = docs.select("doc_id", "text", "source").where("doc_id is not null").dropDuplicates(["doc_id"]).toPandas()
    con.register("documents", pd.DataFrame({"doc_id": pdf["doc_id"].astype("int64"), "text": pdf["text"].where(pdf["text"].notna(), None), "source": pdf["source"].where(pdf["source"].notna(), None)}))
    want = con.sql(quality.ORACLE)
    unique = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = quality.report(unique, **quality.PARAMS).select(*want.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
    assert got.where("n_removed_words > 0").count() == 59


def test_quality_keeps_columns_and_cuts_lines(docs):
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert [r.doc_id for r in rows if "newsletter" in low(r.text)] == [400]
    assert {r.row for r in rows if r.doc_id == 3} in (set(), {3, len(corpus()) - 2, len(corpus()) - 1})
    assert 505 not in {r.doc_id for r in rows} and 506 in {r.doc_id for r in rows}


def test_quality_columns_may_have_any_name(docs):
    clash = docs.withColumns({"_row": F.lit(7), "removed_lines": F.lit("r"), "id": F.lit("i"), "host": F.lit(1), "doc": F.lit(2), "b": F.lit(3), "lines": F.lit(4), "kept": F.lit("k")}).withColumnRenamed("n", "a.b")
    kept = quality.keep(clash)
    assert kept.columns == clash.columns
    assert {tuple(r)[6:] for r in kept.collect()} == {(7, "r", "i", 1, 2, 3, 4, "k")} and kept.count() == quality.keep(docs).count()


def test_first_document_keeps_its_lines(spark):
    line, text = "Read more of this in our paper of today", lambda k: " ".join(f"t{k}x{j}" for j in range(15))
    rows = [(k if k else None, f"{text(k)}\n{line}", "a") for k in range(30)] + [(90 + k, f"{text(k)}\n{line}", None) for k in range(20)]
    df = spark.createDataFrame([*rows, rows[1]], "doc_id long, text string, source string")
    got = Counter((r.doc_id, line in r.text) for r in quality.keep(df).collect())
    assert got[(1, True)] == 2 and got[(None, False)] == 1 and all(n == 1 for (i, has), n in got.items() if i != 1)
    assert {i for (i, has) in got if has} == {1, *range(90, 110)} and sum(got.values()) == 51


def test_lines_are_counted_by_documents(spark):
    """Rows that share an id are one document, those without an id one each; lines at the limit stay."""
    line, text = "shared words of some line", lambda k: " ".join(f"w{k}x{j}" for j in range(40))
    rows = [(k, f"{line}\n{text(k)}", "a") for k in range(10) for _ in range(3)] + [(None, f"null line here\n{text(j)}", "a") for j in range(6)] + [(7, f"null line here\n{text(99)}", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    lost = lambda limit: Counter((r.doc_id, r.n_removed_words) for r in quality.report(df, limit, 10, 0.5).collect())
    assert lost(10) == Counter({(None, 0): 6, **{(k, 0): 3 for k in range(10)}, (7, 0): 4})
    plain = Counter((r.doc_id, r.n_removed_words) for r in quality.report(df, 6, 10, 0.5, keep_first=False).collect())
    assert plain == Counter({(None, 3): 6, **{(k, 5): 3 for k in range(10)}, (7, 3): 1})
    assert lost(6) == Counter({(None, 3): 6, (0, 0): 3, **{(k, 5): 3 for k in range(1, 10)}, (7, 0): 1})


def test_quality_of_nothing(docs):
    assert quality.report(docs.where("false"), **quality.PARAMS).count() == 0 and quality.keep(docs.where("false")).count() == 0


# --- Jaccard join ---
def brute_components(rows, width, num, den):
    sets = []
    for _, text, *_ in rows:
        w = words(low(text))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j]:
                c = len(sets[i] & sets[j])
                if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                    up[root(i)] = root(j)
    best = defaultdict(list)
    for k in range(len(rows)):
        if rows[k][0] is not None:
            best[root(k)].append(rows[k][0])
    return [(rows[k][0], len(sets[k]), min(best[root(k)], default=rows[k][0])) for k in range(len(rows))]


@pytest.mark.parametrize("width, num, den, tile", [(4, 85, 100, 256), (5, 80, 100, 256), (3, 60, 100, 4)])
def test_jaccard_matches_brute_force(docs, monkeypatch, width, num, den, tile):
    if tile == 4:  # many blocks and partitions of the exchange
        docs = docs.repartition(13)
        monkeypatch.setattr(jaccard, "count_parts", lambda table, name: common.count_parts(table, name, 2000))
    got = sorted_rows(jaccard.join(docs, width, num, den, tile=tile), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(corpus(), width, num, den), key=repr)


def test_jaccard_keeps_one_of_each(docs):
    kept = jaccard.keep(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and ids == {i for i, _, c in brute_components(corpus(), 5, 80, 100) if i is None or i == c}
    assert jaccard.keep(docs.where("false")).count() == 0


# --- passages ---
def test_passages_are_found_and_true(docs):
    got = windows.passages(docs).collect()
    rows = corpus()
    texts = defaultdict(list)
    for i, t, _ in rows:
        texts[i].append(words(low(t)))
    for r in got:
        ok = []
        for x in texts[r.doc_id]:
            for y in texts[r.other_id]:
                s, t = ({tuple(w[k : k + 5]) for k in range(a, b - 3)} for w, a, b in ((x, r.first_word, r.last_word), (y, r.other_first, r.other_last)))
                ok.append(len(s & t) / len(s | t))
        assert max(ok) == pytest.approx(r.similarity) and r.similarity >= 0.8
    runs = defaultdict(set)
    for k, (_, t, _) in enumerate(rows):
        w = words(low(t))
        for j in range(len(w) - 50):
            runs[tuple(w[j : j + 51])].add(k)
    want = {rows[k][0] for v in runs.values() if len(v) > 1 for k in v}
    assert want <= {r.doc_id for r in got} | {r.other_id for r in got}
    assert windows.passages(docs.where("false")).count() == 0


def variants(spark):
    """Triples: an excerpt or a far variant first, then two documents that share a passage with each other only."""
    r = random.Random(5)
    text = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    early, late = [], []
    for k in range(40):
        passage = text(50)
        start = r.randrange(1, 5)
        early.append((k, " ".join(text(40) + passage[start : start + 42] + text(40))))
        late += [(100 + 2 * k + j, " ".join(text(30) + passage + text(30))) for j in range(2)]
    return spark.createDataFrame(early + late, "doc_id long, text string").coalesce(1), {(100 + 2 * k, 101 + 2 * k) for k in range(40)}


def test_passages_behind_a_first_document_are_found(spark):
    docs, want = variants(spark)
    source = [words(r.text) for r in docs.orderBy("doc_id").collect()]
    runs = defaultdict(set)
    for r, w in zip(docs.orderBy("doc_id").collect(), source, strict=True):
        for j in range(len(w) - 49):
            runs[tuple(w[j : j + 50])].add(r.doc_id)
    assert {tuple(sorted(v)) for v in runs.values() if len(v) > 1} == want
    got = windows.passages(docs).collect()
    assert {tuple(sorted((r.doc_id, r.other_id))) for r in got} == want


def test_all_passages_of_two_documents_are_found(spark):
    r = random.Random(9)
    text = lambda n: [f"p{r.randrange(10**6)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(6):
        head, foot, middle = text(60 + k), text(90), 150 + k
        for j in range(2):
            rows.append((2 * k + j, " ".join(head + text(middle) + foot)))
        n = len(head)
        want |= {(2 * k, 2 * k + 1, 0, n - 1, 0, n - 1), (2 * k, 2 * k + 1, n + middle, n + middle + 89, n + middle, n + middle + 89)}
    # brute force: the longest equal runs of 50 words and more
    texts = {i: t.split(" ") for i, t in rows}
    runs = set()
    for k in range(6):
        x, y = texts[2 * k], texts[2 * k + 1]
        for i in range(len(x) - 49):
            for p in range(len(y) - 49):
                if x[i : i + 50] == y[p : p + 50] and (min(i, p) == 0 or x[i - 1] != y[p - 1]):
                    n = next((n for n in range(min(len(x) - i, len(y) - p)) if x[i + n] != y[p + n]), min(len(x) - i, len(y) - p))
                    runs.add((2 * k, 2 * k + 1, i, i + n - 1, p, p + n - 1))
    assert runs == want
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.other_id, r.doc_id, r.other_first, r.other_last, r.first_word, r.last_word) for r in got} == want


def changed(r, x, n):
    """x with n words replaced, dropped or put in."""
    x = list(x)
    for _ in range(n):
        k, how = r.randrange(len(x)), r.random()
        x[k : k + (how < 0.8)] = [f"c{r.randrange(10**7)}"] * (how < 0.6 or how >= 0.8)
    return x


def shingled(x):
    return {tuple(x[j : j + 5]) for j in range(len(x) - 4)}


def linked_by_class(got):
    """Pairs of documents that share a class of passages."""
    of = defaultdict(set)
    for r in got:
        of[r.class_id, r.class_first] |= {r.doc_id, r.other_id}
    return lambda i, j: any(i in v and j in v for v in of.values())


@pytest.mark.parametrize("n", [50, 70, 120])
def test_recall_of_pairs(spark, n):
    """Isolated pairs of passages of n words with some words changed, against brute force."""
    r = random.Random(n)
    text = lambda n: [f"q{r.randrange(10**7)}" for _ in range(n)]
    rows, want = [], set()
    while len(want) < 150:
        x = text(n)
        y = changed(r, x, r.randint(0, n // 40))
        s, t = shingled(x), shingled(y)
        if min(len(x), len(y)) >= 50 and len(s & t) >= 0.8 * len(s | t):
            k = len(rows)
            want.add((k, k + 1))
            rows += [(k + j, " ".join(text(40) + w + text(40))) for j, w in enumerate((x, y))]
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    pairs = {(min(r.other_id, r.doc_id), max(r.other_id, r.doc_id)) for r in got}
    print("recall", n, len(pairs & want), "of", len(want))
    assert pairs <= want and len(pairs) >= 0.95 * len(want) and len(got) == len(set(got))


def edited(r, x, how, n):
    """x with one run of n words put in, dropped or replaced, or with its two parts swapped."""
    k = r.randint(len(x) // 4, 3 * len(x) // 4)
    new = [f"e{r.randrange(10**7)}" for _ in range(n)]
    return {"insert": x[:k] + new + x[k:], "drop": x[:k] + x[k + n :], "replace": x[:k] + new + x[k + n :], "swap": x[k:] + x[:k]}[how]


@pytest.mark.parametrize("how", ["insert", "drop", "replace", "swap"])
def test_recall_of_edits(spark, how):
    """Isolated pairs with one edit of several words, as long as the similarity allows, for each length; brute force."""
    r = random.Random(how)
    text = lambda n: [f"s{r.randrange(10**7)}" for _ in range(n)]
    rows, want = [], defaultdict(set)
    for n in (50, 60, 70, 80, 120):
        for _ in range(400):
            x = text(n)
            y = edited(r, x, how, r.randint(1, n // 8))
            s, t = shingled(x), shingled(y)
            if len(want[n]) < 60 and min(len(x), len(y)) >= 50 and len(s & t) >= 0.8 * len(s | t):
                k = len(rows)
                want[n].add((k, k + 1))
                rows += [(k + j, " ".join(text(40) + w + text(40))) for j, w in enumerate((x, y))]
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    pairs = {(min(r.other_id, r.doc_id), max(r.other_id, r.doc_id)) for r in got}
    found = {n: (len(pairs & v), len(v)) for n, v in want.items() if v}
    print("recall", how, found)
    assert pairs <= set().union(*want.values()) and all(a >= 0.9 * b for a, b in found.values()) and len(got) == len(set(got))


def test_bounds_of_edits_are_exact():
    """Verification alone finds every passage, whatever lies around it."""
    import numpy as np

    r, text = random.Random(4), lambda n: [f"b{r.randrange(10**7)}" for _ in range(n)]
    for _ in range(300):
        x = text(r.choice([50, 60, 80, 120]))
        y = edited(r, x, r.choice(["insert", "drop", "replace", "swap"]), r.randint(1, len(x) // 8))
        s, t = shingled(x), shingled(y)
        if min(len(x), len(y)) < 50 or len(s & t) < 0.8 * len(s | t):
            continue
        code = {}
        p, q = r.randint(0, 40), r.randint(0, 40)
        codes = lambda w: np.array([code.setdefault(tuple(w[k : k + 5]), len(code)) for k in range(len(w) - 4)], np.uint32)  # noqa: B023, E731
        got = windows.verify_all(codes(text(p) + x + text(20)), codes(text(q) + y + text(20)), 46, 80, 100)
        assert any(a <= p + len(x) - 5 and b >= p and c <= q + len(y) - 5 and d >= q for a, b, c, d, _ in got)


def test_recall_in_clusters(spark):
    """Variants of a passage: every two that are similar are in one class, though both may differ from the representative."""
    r = random.Random(8)
    text = lambda n: [f"k{r.randrange(10**7)}" for _ in range(n)]
    rows, want = [], set()
    for k in range(4):
        base = text(70)
        members = [changed(r, base, r.randint(0, 3)) for _ in range(40)]
        for i, x in enumerate(members):
            rows.append((100 * k + i, " ".join(text(30) + x + text(30))))
            for j in range(i):
                s, t = shingled(x), shingled(members[j])
                if len(s & t) >= 0.8 * len(s | t):
                    want.add((100 * k + j, 100 * k + i))
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    together = linked_by_class(got)
    found = sum(together(i, j) for i, j in want)
    print("recall in clusters", found, "of", len(want))
    assert found >= 0.97 * len(want) and len(got) == len(set(got))


def test_two_equal_passages_in_three_documents(spark):
    r = random.Random(2)
    text = lambda n: [f"z{r.randrange(10**7)}" for _ in range(n)]
    a, b = text(80), text(80)
    rows = [(k, " ".join(text(10 + k) + a + text(30 + 5 * k) + b + text(8))) for k in (1, 2, 3)]
    got = windows.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(set(got))
    for r in got:
        assert r.last_word - r.first_word == r.other_last - r.other_first == 79 and r.similarity == 1
    assert {i for r in got for i in (r.doc_id, r.other_id)} == {1, 2, 3} and len(got) == 4
    assert {(r.class_id, r.class_first) for r in got} == {(1, 11), (1, 11 + 80 + 35)}


def test_members_are_each_passage_once(spark):
    """One row for each passage of a document, however many others it matches; a common short line brings none."""
    r = random.Random(6)
    text = lambda n: [f"m{r.randrange(10**7)}" for _ in range(n)]
    base, line, rows = text(60), text(14), []
    for k in range(60):
        x = list(base)
        x[k] = f"x{k}"
        rows.append((k, " ".join(text(20) + x + text(20))))
    rows += [(100 + k, " ".join(text(40) + line + text(40))) for k in range(60)]
    rows += [(200, rows[0][1]), (201, rows[60][1]), (202, None)]
    got = [(g.doc_id, g.first_word, g.last_word, g.is_copy, g.class_id, g.class_first) for g in windows.members(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    whole = {(0, 0, 99, False, 0, 0), (200, 0, 99, True, 0, 0), (100, 0, 93, False, 100, 0), (201, 0, 93, True, 100, 0)}
    assert whole <= set(got)
    passages = [g for g in got if g not in whole]
    assert len(got) == len(set(got)) and sorted(g[0] for g in passages) == list(range(60)) and len({g[4:] for g in passages}) == 1
    assert all(last - first >= 49 for _, first, last, *_ in passages)


def test_both_places_of_a_repeated_passage_are_found(spark):
    r = random.Random(12)
    text = lambda n: [f"d{r.randrange(10**7)}" for _ in range(n)]
    x = text(70)
    rows = [(1, " ".join(text(30) + x + text(30))), (2, " ".join(text(30) + x + text(80) + x + text(30)))]
    got = windows.members(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(g.doc_id, g.first_word, g.last_word) for g in got} == {(1, 30, 99), (2, 30, 99), (2, 180, 249)}


def test_what_may_match_is_the_runs_with_hits_enough():
    """Against brute force: a run of `least` or more with the wanted share of hits, repeated misses being free."""
    import numpy as np

    r, least = np.random.default_rng(5), 6
    sizes = r.integers(1, 25, 60)
    hit, again = r.random(sizes.sum()) < 0.8, r.random(sizes.sum()) < 0.1
    start = np.cumsum(sizes) - sizes
    want = []
    for s, n in zip(start, sizes, strict=True):
        runs = [slice(s + i, s + j) for i in range(n) for j in range(i + least, n + 1)]
        counts = [(hit[x].sum(), (~hit[x] & ~again[x]).sum()) for x in runs]
        want.append(sum(any(share * h >= cost * miss for h, miss in counts) for share, cost in ((20, 80), (20, 160))))
    assert windows.may_match(hit, again, start, least, 80, 100).tolist() == want and len(set(want)) == 3


def test_rectangles_that_cannot_match_make_no_rows(spark):
    """A signature that is cut into tiles: its pairs are those of two labels and texts whose bodies may match, each once."""
    import numpy as np

    r, least, base = np.random.default_rng(6), 46, np.random.default_rng(7).permutation(1 << 16)[:80]
    bodies, labels = {}, {}
    for row in range(700):
        x = np.concatenate([base, r.permutation(np.setdiff1d(np.arange(1 << 16), base))])[:80].copy()
        some = r.permutation(80)[: 2 if row < 600 or row % 20 == 0 else 60]
        x[some] = r.permutation(np.setdiff1d(np.arange(1 << 16), base))[: len(some)]
        bodies[row], labels[row] = x.astype(np.uint16), 7 if row < 600 else -1 - row if row < 690 else 8
    for name, v in (("hot", lambda row: 5), ("cold", lambda row: row // 7 % 97)):
        rows = [(v(row), row, labels[row], 2, 10, 20, 89, bytearray(x.tobytes())) for row, x in bodies.items()]
        met = windows.meeting(spark.createDataFrame(rows, windows.OPEN), least, 80, 100).collect()
        two = [(a, b) for a in bodies for b in bodies if a > b and labels[a] != labels[b] and v(a) == v(b)]
        want = {(a, b) for a, b in two if windows.possible(np.isin(bodies[a], bodies[b]), np.isin(bodies[b], bodies[a]), least, 80, 100)}
        assert sorted((m.a, m.b) for m in met) == sorted(want), name
        assert want and len(want) < len(two) / 4 and all(m[2:] == (10, 20, 89) * 2 for m in met)


def test_what_no_other_text_shares_is_not_met():
    """Coverage against brute force: every run of `least` with the wanted sum, repeated misses being free."""
    import numpy as np

    r = np.random.default_rng(3)
    for _ in range(200):
        m = r.integers(0, 40, 4)
        hit, again = r.random(m.sum()) < 0.8, r.random(m.sum()) < 0.1
        worth, cost, least, wanted = ((20, 80, 8, 0), (100, 80, 8, 640))[r.integers(2)]
        weight, want, start = np.where(hit, worth, np.where(again, 0, -cost)), np.zeros(m.sum(), bool), 0
        for n in m.tolist():
            for i in range(start, start + n):
                for j in range(i + least, start + n + 1):
                    if weight[i:j].sum() >= wanted:
                        want[i:j] = True
            start += n
        assert np.array_equal(windows.covered(hit, again, m, least, worth, cost, wanted), want)


def test_window_bounds():
    import numpy as np

    r = np.random.default_rng(2)
    m = np.array([0, 3, 50, 7, 200, 46])
    h = r.integers(0, 1 << 62, m.sum(), np.int64).view(np.uint64)
    got = set(zip(*(x.tolist() for x in windows.compact_windows(h, m, 7))))
    want, start = set(), 0
    for n in m.tolist():
        for c in range(start, start + n):
            lo, hi = c, c
            while lo > start and h[lo - 1] > h[c]:
                lo -= 1
            while hi < start + n - 1 and h[hi + 1] > h[c]:
                hi += 1
            if hi - lo + 1 >= 7:
                want.add((lo, c, hi))
        start += n
    assert got == want


# --- packing ---
@pytest.mark.parametrize("capacities, shard", [((64, 128, 512), 10_000), ((512,), 50)])
def test_packing_is_whole_and_fits(docs, capacities, shard):
    got = packing.pack_documents(docs, capacities, 16, shard).toPandas()
    want = Counter((i, len(words(t)) + 1) for i, t, _ in corpus())
    sizes = Counter()
    for (i, n) in want:
        assert n > 0
    for i, g in got.groupby(got["doc_id"].fillna(-1)):
        sizes[int(i)] = int(g["n_tokens"].sum())
    totals = Counter()
    for (i, n), k in want.items():
        totals[-1 if i is None else i] += n * k
    assert sizes == totals
    for _, g in got.groupby("bin_id"):
        g = g.sort_values("offset")
        assert (g["offset"].to_numpy() == (g["n_tokens"].cumsum() - g["n_tokens"]).to_numpy()).all()
        fill, size = g["n_tokens"].sum(), g["capacity"].iloc[0]
        assert fill == g["bin_tokens"].iloc[0] and size == min(c for c in capacities if c >= fill)
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_sequences_of_columns_without_nulls(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "d"), (3, "e f")], "doc_id int, text string")
    for tokens in (F.split("text", " "), F.array(F.lit("x"), F.lit("y"))):
        got = packing.sequences(df.select("doc_id", tokens.alias("tokens")), "tokens", capacities=(2, 4), overhead=1, shard=10).collect()
        assert sorted(t for r in got for t in r.tokens) == sorted(t for r in df.select(tokens.alias("t")).collect() for t in r.t)


def test_equal_rows_are_spread_over_shards(spark):
    df = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    got = packing.pack_documents(df.repartition(4), shard=10_000)
    shards = got.select(F.shiftright("bin_id", 32).alias("shard")).groupBy("shard").count().collect()
    assert len(shards) == 6 and sum(r["count"] for r in shards) == 60_000 and max(r["count"] for r in shards) < 11_000


def test_packing_keeps_large_and_null_ids(spark):
    ids = [9007199254740993, None, -(1 << 62) - 1, None]
    df = spark.createDataFrame([(i, "a b c", 7, "x") for i in ids], "doc_id long, text string, n_tokens int, shard string").coalesce(1)
    got = packing.pack_documents(df).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr) and len({r.bin_id for r in got}) == 1


def least_cost(lengths, capacities, overhead):
    """Brute force: all partitions of the pieces into bins."""
    best = [math.inf]

    def place(k, fill):
        if k == len(lengths):
            best[0] = min(best[0], sum(min(c for c in capacities if c >= f) + overhead for f in fill))
            return
        for b in range(len(fill)):
            if fill[b] + lengths[k] <= max(capacities):
                place(k + 1, [*fill[:b], fill[b] + lengths[k], *fill[b + 1 :]])
        place(k + 1, [*fill, lengths[k]])

    place(0, [])
    return best[0]


def test_cost_is_near_the_least():
    import numpy as np

    r, ratios = random.Random(4), []
    for _ in range(150):
        lengths = np.array(sorted((r.choice([r.randint(1, 30), r.randint(1, 64)]) for _ in range(r.randint(1, 7))), reverse=True))
        fill = packing.cheapest(lengths, (8, 16, 32, 64), 2)[2]
        ratios.append(packing.cost(fill, (8, 16, 32, 64), 2) / least_cost(lengths.tolist(), (8, 16, 32, 64), 2))
    print("cost against the least:", sum(ratios) / len(ratios), max(ratios))
    assert min(ratios) >= 1 and sum(ratios) / len(ratios) < 1.05 and max(ratios) < 1.4


def test_shards_cost_little():
    import numpy as np

    n = np.sort(np.random.default_rng(5).lognormal(6, 1, 20_000).astype(np.int64).clip(1, 8191))[::-1]
    whole = packing.cost(packing.cheapest(n, packing.CAPACITIES, packing.OVERHEAD)[2], packing.CAPACITIES, packing.OVERHEAD)
    parts = sum(packing.cost(packing.cheapest(n[k::10], packing.CAPACITIES, packing.OVERHEAD)[2], packing.CAPACITIES, packing.OVERHEAD) for k in range(10))
    assert whole <= parts <= 1.01 * whole


@pytest.mark.parametrize("kind, mark", [("int", None), ("string", None), ("string", " ")])
def test_sequences_hold_all_tokens(spark, kind, mark):
    r = random.Random(6)
    make = int if kind == "int" else str
    rows = [(k if k % 9 else None, [make(r.randrange(10**6)) for _ in range(r.choice([0, 3, 40, 64, 130, r.randint(1, 300)]))]) for k in range(120)]
    rows += [(500, None), (501, []), rows[5], (9007199254740993, [make(1)])]
    df = spark.createDataFrame([(*x, 1, "t") for x in rows], f"doc_id long, ids array<{kind}>, shard int, tokens string").repartition(3)
    got = packing.sequences(df, capacities=(16, 32, 64), overhead=4, shard=50, mark=mark).collect()
    assert len({x.bin_id for x in got}) == len(got)
    pieces = Counter()
    for x in got:
        assert x.n_tokens == len(x.tokens) <= x.capacity == min(c for c in (16, 32, 64) if c >= x.n_tokens)
        for i, s, a, b in zip(x.doc_ids, x.starts, x.offsets, [*x.offsets[1:], x.n_tokens]):
            pieces[i, s, tuple(x.tokens[a:b])] += 1
    assert pieces == Counter((i, s, tuple(t[s : s + 64])) for i, t in rows for s in range(0, len(t or ()), 64))
    assert packing.sequences(df.where("false")).count() == 0


def test_best_fit_takes_the_tightest_bin():
    import numpy as np

    bins, offsets, fill = packing.best_fit(np.array([9, 7, 3, 1]), (10,), 1, 0.0)
    assert bins.tolist() == [0, 1, 1, 0] and offsets.tolist() == [0, 0, 7, 9] and fill.tolist() == [10, 10]


# --- sharding ---
@pytest.mark.parametrize("rows, ranges", [(100_000, 4096), (3, 4096), (3, 2)])
def test_shards_are_even_gapless_and_whole(docs, rows, ranges):
    got = sharding.assign(docs, 4, rows_per_unit=rows, most_ranges=ranges).toPandas()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in corpus())
    assert Counter((None if pd.isna(i) else int(i), n, c) for i, n, c in zip(got["doc_id"], got["size"], got["text_crc32"])) == want
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sums = got.groupby("shard")["size"].sum()
    assert sums.max() - sums.min() <= 2 * got["size"].max()
    assert sharding.assign(docs.where("false"), 4).count() == 0


@pytest.mark.parametrize("shards, rows, ranges", [(4, 100_000, 4096), (16, 100_000, 4096), (7, 200, 5), (1, 100_000, 4096)])
def test_shards_follow_the_law(spark, docs, shards, rows, ranges):
    """Records along the hashes of their texts, equal texts by id and place; each in the shard that its middle byte is in."""
    r = random.Random(5)
    more = [(10_000 - i, r.choice(["copy", f"text {i} " * r.randint(0, 9), None])) for i in range(300)] + [(7, "é" * 40_000), (None, "copy"), (None, "copy")]
    records = spark.createDataFrame(more, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bodies = [(None if i is None else int(i), (t or "").encode()) for i, t in more + [(row[0], row[1]) for row in corpus()]]
    key = lambda row: (xxhash.xxh64_intdigest(row[1], seed=42) + (1 << 63)) % (1 << 64)  # noqa: E731 - signed hashes in ascending order
    ordered = sorted(bodies, key=lambda row: (key(row), row[0] is not None, row[0] or 0))
    total, run, begun, want = sum(len(b) + 1 for _, b in bodies), 0, Counter(), Counter()
    for i, body in ordered:
        size = len(body) + 1
        shard = min(shards - 1, (2 * run + size) * shards // (2 * total))
        want[i, size, zlib.crc32(body), shard, begun[shard]] += 1
        begun[shard] += 1
        run += size
    got = sharding.assign(records, shards, rows_per_unit=rows, most_ranges=ranges).collect()
    assert Counter(tuple(g) for g in got) == want


@pytest.mark.parametrize("ids", [600, 1])
def test_hot_key_is_subdivided(spark, ids):
    same = spark.createDataFrame([(k % ids, "copy" if k % 3 else f"text {k}") for k in range(600)], "doc_id long, text string")
    got = sharding.assign(same, 4, rows_per_unit=20, most_ranges=8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == 600 and len(sums) == 4 and sums.max() - sums.min() <= 2 * got["size"].max()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
