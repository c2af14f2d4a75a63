import random

import numpy as np
import pyarrow as pa
import pytest

from sheafworks.llm import common


@pytest.mark.parametrize("shape", ["chain", "star", "random", "loops"])
def test_components(spark, shape):
    r = random.Random(3)
    edges = {
        "chain": [(k, k + 1) for k in range(60)], "star": [(40, k) for k in range(60)],
        "random": [(r.randint(0, 80), r.randint(0, 80)) for _ in range(50)], "loops": [(1, 1), (2, 3), (3, 2), (3, 2)],
    }[shape]
    low = {}
    for a, b in edges:
        if a != b:
            low.setdefault(a, a)
            low.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.component for x in got} == low and len(got) == len(low)


def test_no_edges_no_components(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("values", [[], [0], [255, 256], [-1, 3], [-(1 << 63), (1 << 63) - 1], [-129, 127]])
def test_packing_is_exact(values):
    a = np.array(values, np.int64)
    assert common.unpack(common.pack(a=a))["a"].astype(np.int64).tolist() == values


def test_packing_keeps_other_types():
    x = common.unpack(common.pack(u=np.array([0, (1 << 64) - 1], np.uint64), f=np.array([0.1, -5e300]), e=np.empty(0)))
    assert x["u"].tolist() == [0, (1 << 64) - 1] and x["f"].tolist() == [0.1, -5e300] and len(x["e"]) == 0


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_blocks_keep_all_rows_in_order(limit):
    texts = ["", None, "aaa", "b" * 20, "", "c", "dd"] * 3
    batches = [pa.RecordBatch.from_pydict({"text": texts[i : i + 4], "k": list(range(i, min(i + 4, len(texts))))}) for i in range(0, len(texts), 4)]
    got = list(common.blocks(iter(batches), limit))
    assert [k for t in got for k in t.column("k").to_pylist()] == list(range(len(texts)))
    for t in got:
        sizes = [len(x or "") for x in t.column("text").to_pylist()]
        assert sum(sizes) <= limit or sum(1 for s in sizes if s) == 1


def test_blocks_of_nothing_are_bounded():
    batch = pa.RecordBatch.from_pydict({"text": [None, ""] * 50})
    assert [t.num_rows for t in common.blocks(iter([batch, batch]), rows=64)] == [64, 64, 64, 8]


def test_row_numbers_do_not_repeat_and_end_with_an_error():
    seen = [common.block_id(k, task) for task in (0, 1, 40_000, (1 << 27) - 1) for k in (0, 1, (1 << 20) - 1)]
    rows = np.concatenate([common.row_ids(b, common.BLOCK_ROWS) for b in seen])
    assert len(np.unique(rows)) == len(rows) and rows.min() == 0 and int(rows.max()) == (1 << 63) - 1
    assert ((rows >> common.ROW_BITS) == np.repeat(seen, common.BLOCK_ROWS)).all()
    for k, task in ((1 << 20, 0), (0, 1 << 27)):
        with pytest.raises(OverflowError):
            common.block_id(k, task)
    with pytest.raises(OverflowError):
        common.row_ids(0, common.BLOCK_ROWS + 1)


@pytest.mark.parametrize("bits, parts", [(33, 1), (40, 7), (62, 100_000)])
def test_partitions_follow_the_keys(bits, parts):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << bits, 5000, np.int64)).view(np.uint64)
    part = common.part_of(keys, bits, parts)
    assert (np.diff(part) >= 0).all() and part.min() >= 0 and part.max() < parts and (parts > 1000 or len(np.unique(part)) == parts)
    assert [v for p, i, j in common.runs_of(part) for v in [p] * (j - i)] == part.tolist()


def test_small_messages_are_small():
    assert len(common.pack(h=np.array([1 << 62]), n=np.array([1]))) <= 20


def test_a_shared_folder_is_needed_on_a_cluster():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_words():
    words, n = common.words_of(pa.array(["A b\tC", None, "", "  é\x0bZ ", "\x85x"]))
    assert words.to_pylist() == ["a", "b", "c", "é", "z", "\x85x"] and n.tolist() == [3, 0, 0, 2, 1]
