"""Operator 6 against brute force, and its parts."""

import itertools
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from stratalog.llm import jaccard, shared
from stratalog.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets, up = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]):
            up[find(j)] = find(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return Counter((doc_id, len(sets[i]), least.get(find(i)) if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize("flush", [1_000_000, 200])
def test_components_match(docs, monkeypatch, flush):
    monkeypatch.setattr(jaccard, "FLUSH", flush)
    monkeypatch.setattr(jaccard, "PAIRS", flush)
    got = Counter(tuple(r) for r in jaccard.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_tables_have_few_files(spark, docs, monkeypatch):
    """However many partitions shuffles have; tasks then work several partitions, whose lists are still told apart."""
    monkeypatch.setattr(shared, "FILES", 8, raising=False)
    made = len(shared._made)
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = Counter(tuple(r) for r in jaccard.near_copies(docs).select("doc_id", "n_shingles", "component_id").collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    files = {at: len(list(Path(at.removeprefix("file:")).glob("part-*"))) for at in shared._made[made:]}
    assert files and max(files.values()) <= max(8, 2 * spark.sparkContext.defaultParallelism)
    lists = spark.read.parquet(next(at for at in files if "jaccard-lists" in at))
    assert lists.count() == lists.select("row").distinct().count() > 8
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_one_of_each(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    full = [x for x in got if shingle_set(x[1])]
    assert len(full) == len(jaccard.near_copies(docs).where("n_shingles > 0").select("label").distinct().collect())
    for a, b in itertools.combinations([shingle_set(t) for _, t in full], 2):
        assert 100 * len(a & b) < 80 * len(a | b)
    assert {x for x in rows if not shingle_set(x[1])} == {x for x in got if not shingle_set(x[1])}


def test_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(160):
        own = list(base)
        for k in range(int(rng.integers(0, 4))):
            own[int(rng.integers(150))] = f"e{i}x{k}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in jaccard.near_copies(df).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows)


def test_match_bound_is_sound():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(5, 80))
        x = set(rng.choice(200, n, replace=False).tolist())
        y = set(x)
        for t in list(x)[: int(rng.integers(0, max(1, n // 8)))]:
            y.discard(t)
            y.add(int(rng.integers(200, 400)))
        if 100 * len(x & y) < 80 * len(x | y):
            continue
        order = {t: v for t, v in zip(x | y, rng.permutation(len(x | y)).tolist(), strict=True)}
        c = lambda s: -(-80 * len(s) // 100)
        lx, ly = (int(rng.integers(1, c(s) + 1)) for s in (x, y))
        px, py = (set(sorted(s, key=order.get)[: len(s) - c(s) + k]) for s, k in ((x, lx), (y, ly)))
        need = jaccard.least_matches(np.array([len(x)]), np.array([len(y)]), np.array([lx]), np.array([ly]))[0]
        assert len(px & py) >= need


def test_across_gives_each_pair_once():
    rng = np.random.default_rng(0)
    t, g = np.sort(rng.integers(0, 6, 300)).astype(np.uint64), rng.integers(0, 5, 300)
    got = Counter((min(p), max(p)) for x, y in jaccard.across(t, g, 8) for p in zip(x.tolist(), y.tolist(), strict=True))
    assert got == Counter((i, j) for i, j in itertools.combinations(range(300), 2) if t[i] == t[j] and g[i] != g[j])


def test_components(spark):
    links = [(1, 2), (2, 3), (3, 4), (9, 8), (5, 5), (4, 1), (4, 1), *((100 + i, 101 + i) for i in range(20))]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, **{100 + i: 100 for i in range(21)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_empty(none):
    assert jaccard.near_copies(none).count() == 0 and jaccard.one_of_each(none).count() == 0
