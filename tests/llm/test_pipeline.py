"""Each stage of the pipeline against its rule, in a row, and what it does with awkward tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from stratalog.llm import contamination, jaccard, mixing, quality

from .conftest import SCHEMA, prose
from .test_jaccard import shingle_set
from .test_others import plain_align, plain_kept, plain_score, plain_words


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(11)
    rows = [tuple(r) for r in docs.collect()]
    items = [(i, prose(rng, 30)) for i in range(3)]
    more = []
    for i in range(80):
        bad = i % 3 == 0
        t = prose(rng, 60)
        more.append((1000 + i, " ".join(w + "&&&" for w in t.split(" ")) if bad else t, "en", "s9", 1, *rows[0][5:]))
    more += [(2000 + i, prose(rng, 30) + " " + t, "en", "s9", 1, *rows[0][5:]) for i, t in items]
    spark.createDataFrame(rows + more, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(r[0], int("&&&" not in r[1]), 0) for r in more[:80]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    given = [tuple(r) for r in docs.collect()]
    for name, stage in pipeline.STAGES:
        before, docs = docs, stage(spark, docs, tables).cache()
        own = [tuple(r) for r in docs.collect()]
        if name == "quality":
            assert docs.columns == before.columns and not Counter(own) - Counter(given)
            assert not [r for r in own if r[1] and "&&&" in r[1]] and {1001, 1002, 2000} <= {r[0] for r in own}
        if name == "lines":
            assert docs.columns == before.columns
            old = {(r.doc_id, r.source, r.lang) for r in before.collect()}
            assert {(r.doc_id, r.source, r.lang) for r in docs.collect()} <= old
            assert all(r.n_chars == len(r.text) for r in docs.collect() if r.text and (r.doc_id, r.text) not in {(x.doc_id, x.text) for x in before.collect()})
        if name == "near_copies":
            sets = [s for s in (shingle_set(r[1]) for r in own) if s]
            assert len(sets) == len(set(sets)) == jaccard.near_copies(before).where("n_shingles > 0").select("label").distinct().count()
        if name == "benchmark":
            assert {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()} == {2000, 2001, 2002}
        if name == "mix":
            taken = {(r.doc_id, r.key): r.copies for r in mixing.mixed(before).collect()}
            assert docs.count() == sum(taken.values()) and docs.columns == [*before.columns, "copy_number"]


def test_long_lines_repeated_among_others_go(spark):
    rng = random.Random(12)
    long, short = prose(rng, 50), "short line"
    docs = spark.createDataFrame([(i, "\n".join([prose(rng, 9), f"  {long} ", prose(rng, 9), short, prose(rng, 9)])) for i in range(5)] + [(9, long), (10, "own\n" + long + "\n" + long)], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in pipeline.lines_stage(spark, docs, "").collect()}
    assert [sum(x.strip() == long for x in got.get(i, [])) for i in (0, 1, 2, 3, 4, 9, 10)] == [1, 0, 0, 0, 0, 0, 0]
    assert all(short in got[i] and len(got[i]) == 4 + (i == 0) for i in range(5)) and got[10] == ["own"] and 9 not in got


def hashes(spark, rows, schema):
    """Of each row: the hash of its text, null as empty; that of its text; that of all its columns. They only order what is equal otherwise."""
    df = spark.createDataFrame([(i, tuple(r)) for i, r in enumerate(rows)], f"i long, r struct<{schema.simpleString()[7:-1]}>")
    return [tuple(r)[1:] for r in df.select("i", F.xxhash64(F.coalesce("r.text", F.lit(""))), F.xxhash64("r.text"), F.xxhash64("r")).sort("i").collect()]


def plain_first(rows, keys):
    """Of each component the row with the least id, of documents without words each once."""
    sets = [shingle_set(r["text"]) for r in rows]
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
            old, new = group[j], group[i]
            group = [new if g == old else g for g in group]
    best = {}
    for i, r in enumerate(rows):
        place = (r["doc_id"] is not None, r["doc_id"] or 0, keys[i][0], keys[i][2])
        name = group[i] if sets[i] else (r["doc_id"], keys[i][0])
        best[name] = min(best.get(name, (place, i)), (place, i))
    return [rows[i] for _, i in best.values()]


def plain_copies(rows, keys):
    """Every row as often as one systematic draw a source takes it."""
    size = [len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in rows]
    names = sorted({r["source"] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r["source"] == s) for s in names}
    weight, target, left, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, 1.5 * sum(size), set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * total[s]}
        for s in over or open_:
            target[s] = 2 * total[s] if over else share[s]
            left -= target[s]
        open_ -= over or set(open_)
    out = Counter()
    for s in names:
        own = sorted((i for i, r in enumerate(rows) if r["source"] == s), key=lambda i: (-size[i], rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0, keys[i][1]))
        rate = target[s] / total[s] if total[s] else 0.0
        tries = []
        for k in range(32):
            u = int(hashlib.md5(f"{s or ''}#1#{k}".encode()).hexdigest()[:8], 16) / 2**32
            copies = [min(2, math.floor(rate * (p + 1) + u) - math.floor(rate * p + u)) for p in range(len(own))]
            tries.append((abs(sum(c * size[i] for c, i in zip(copies, own, strict=True)) - target[s]), k, copies))
        for i, c in zip(own, min(tries)[2], strict=True):
            for n in range(1, c + 1):
                out[(*rows[i].values(), n)] += 1
    return out


def test_run_against_plain_stages(spark, tables):
    """The rows of run() from plain versions of all stages in a row; the classifier's parameters alone are taken as they were learned."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    key = lambda: hashes(spark, [r.values() for r in rows], docs.schema)
    scores = [plain_score(model, r["text"]) for r in rows]
    assert min(abs(s - 0.5) for s in scores) > 1e-4
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= 0.5]
    kept = plain_kept([(r["doc_id"], r["text"], k[0]) for r, k in zip(rows, key(), strict=True)], 2, 32)
    rows = [r | ({"text": t, "n_chars": len(t)} if gone else {}) for r, (_, gone, t) in zip(rows, kept, strict=True) if not gone or t.strip(" \t\r\n")]
    rows = plain_first(rows, key())
    items = [plain_words(r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    rows = [r for r in rows if all(plain_align(w, plain_words(r["text"] or "")) < contamination.enough(len(w)) for w in items)]
    want = plain_copies(rows, key())
    assert Counter(map(tuple, pipeline.run(spark, tables).collect())) == want and len(want) > 50


def test_empty_tables(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert pipeline.run(spark, at).count() == 0
