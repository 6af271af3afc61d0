"""Operators 1 and 4 against brute force, on awkward rows, with heavy groups split and with tiny flushes."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest

from stratalog.llm import repeats, substring, suffix

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_words(docs, n=35):
    split = [WORD.findall(t or "") for _, t in docs]
    count = Counter(tuple(w[i : i + n]) for w in split for i in range(len(w) - n + 1))
    out = Counter()
    for (doc_id, _), w in zip(docs, split, strict=True):
        keep = [True] * len(w)
        for i in range(len(w) - n + 1):
            if count[tuple(w[i : i + n])] > 1:
                keep[i : i + n] = [False] * n
        kept = [x for x, k in zip(w, keep, strict=True) if k]
        out[(doc_id, len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())] += 1
    return out


def brute_bytes(docs, key, n=100):
    """Documents in the order of (doc_id, key); equal rows stand side by side and don't precede each other."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, key[i]))
    out, first = Counter(), {}
    for i in order:
        t = (docs[i][1] or "").encode()
        me = (docs[i][0], key[i])
        gone = bytearray(len(t))
        for j in range(len(t) - n + 1):
            who, at = first.setdefault(t[j : j + n], (me, j))
            if who != me or at < j:
                gone[j : j + n] = b"\1" * n
        kept = bytes(x for x, g in zip(t, gone, strict=True) if not g)
        out[(docs[i][0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("heavy", "flush"), [(20_000, 1 << 20), (1, 1 << 20), (20_000, 300)])
def test_words(docs, monkeypatch, heavy, flush):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "FLUSH_ANCHORS", flush)
    monkeypatch.setattr(repeats, "FLUSH_BYTES", flush)
    got = Counter(tuple(r) for r in substring.deduplicated(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    want = brute_words([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and sum(n for _, _, n, _ in got) > 500


@pytest.mark.parametrize(("heavy", "flush"), [(20_000, 1 << 20), (1, 1 << 20), (20_000, 300)])
def test_bytes(docs, monkeypatch, heavy, flush):
    monkeypatch.setattr(repeats, "HEAVY", heavy)
    monkeypatch.setattr(repeats, "FLUSH_ANCHORS", flush)
    monkeypatch.setattr(repeats, "FLUSH_BYTES", flush)
    monkeypatch.setattr(suffix, "SHARD", 2000)
    got = Counter(tuple(r) for r in suffix.deduplicated(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    keys = repeats.keyed(docs).select("doc_id", "text", "key").collect()
    want = brute_bytes([(r.doc_id, r.text) for r in keys], [r.key for r in keys])
    assert got == want and sum(x[2] for x in got) > 3000


def test_kept_text_has_the_hash(docs):
    for r in substring.deduplicated(docs).where("n_removed > 0").limit(5).collect():
        assert hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_empty(none):
    assert substring.deduplicated(none).count() == 0 and suffix.deduplicated(none).count() == 0


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    size = np.array([150, 130, 220, 101, 180])
    text = rng.integers(97, 99, size.sum()).astype(np.uint8)
    text[300:420] = text[10:130]
    n = size - 99
    begin, order = suffix.suffix_array(text, size, n, 100)
    raw = text.tobytes()
    rows = [raw[b : b + 100] for b in begin]
    assert order.tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i))
    got = suffix.common_prefixes(text, begin, order, n, 100)
    for a, b in zip(order[:-1], order[1:], strict=True):
        want = next((k for k in range(100) if rows[a][k] != rows[b][k]), 100)
        assert got[b] == want


def test_trees():
    rng = np.random.default_rng(2)
    units = rng.integers(0, 2, 400).astype(np.uint64)
    from stratalog.llm.kernel import gram_hashes, mix

    at = np.arange(0, 365)
    many = rng.integers(1, 3, len(at))
    tree = substring.grow(np.zeros(len(at), np.uint64), at, gram_hashes(mix(units + np.uint64(1)), 5), many, 3, 5)
    count = Counter()
    for i in at:
        for d in (5, 10, 15):
            count[tuple(units[i : i + d])] += int(many[i])
    assert tree.deep(15).tolist() == [count[tuple(units[i : i + 15])] > 1 for i in at]
    assert sorted(zip(tree.depth.tolist(), tree.places.tolist(), strict=True)) == sorted((len(k), n) for k, n in count.items() if n > 1)
    for node, up in enumerate(tree.parent.tolist()):  # each inner node hangs below the one five words up
        assert (up == -1) == (tree.depth[node] == 5) and (up == -1 or tree.depth[up] == tree.depth[node] - 5 and tree.places[up] >= tree.places[node])


@pytest.mark.parametrize("op", [substring, suffix])
def test_nothing_goes_past_the_structure(docs, monkeypatch, op):
    """Without the structure's word no window goes, of whatever copies; texts that occur twice as a whole are the rows that copies are."""
    once = docs.where("text is not null").dropDuplicates(["text"])
    found = op.deduplicated(once).where("n_removed > 0").count()
    assert found > 10
    monkeypatch.setattr(op, "solve", lambda runs: (np.zeros(int(runs.n.sum()), bool), np.zeros(int(runs.n.sum()), bool)))
    assert op.deduplicated(once).where("n_removed > 0").count() == 0


def test_spans_are_the_maximal_repeats(docs):
    for r in substring.deduplicated(docs).collect():
        spans = list(zip(r.spans[::2], r.spans[1::2], strict=True))
        assert sum(b - a for a, b in spans) == r.n_removed and all(b - a >= 35 for a, b in spans)


def test_search_in_another_shard():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(97, 99, 400).astype(np.uint8) for _ in range(2))
    b[50:200] = a[100:250]
    length = 20
    starts = np.arange(400 - length)
    array = np.array(sorted(starts, key=lambda i: (b[i : i + length].tobytes(), i)))
    keep = np.concatenate(([True], [b[x : x + length].tobytes() != b[y : y + length].tobytes() for x, y in zip(array[1:], array[:-1], strict=True)]))
    array = array[keep]
    place, found = suffix.placed(suffix.eights(a), starts, suffix.eights(b), array, length)
    have = [b[i : i + length].tobytes() for i in array]
    for i in starts:
        mine = a[i : i + length].tobytes()
        assert place[i] == sum(x < mine for x in have) and found[i] == (mine in have)
    assert found.sum() >= 130


def test_heavy_groups_are_split_by_prefixes(spark, monkeypatch):
    """One sequence of words in very many documents, under many different neighbours, some of which come twice."""
    rng = np.random.default_rng(4)
    core = " ".join(f"core{i}" for i in range(20))
    rows = []
    for i in range(300):
        own = rng.integers(0, 60) if i % 3 else 1000 + i
        rows.append((i, " ".join(f"a{own}x{k}" for k in range(30)) + " " + core + " " + " ".join(f"b{own % 7}x{k}" for k in range(30))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for heavy in (1, 20, 100):
        monkeypatch.setattr(repeats, "HEAVY", heavy)
        got = Counter(tuple(r) for r in substring.deduplicated(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
        assert got == brute_words(rows)
        got = Counter(tuple(r) for r in suffix.deduplicated(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
        assert got == brute_bytes(rows, [0] * len(rows))
