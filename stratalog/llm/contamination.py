"""Operator 9: benchmark decontamination by rare n-gram seeds and Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII characters, lower-cased, so that punctuation and case don't hide a copy. The
``SEED``-grams of the test items are counted over the whole corpus, in documents; rare are those that no more than a share of ``RARE`` of
all documents has (or ``FEW`` documents), and of each item the ``LEAST`` that fewest documents have, of those that any has. Where a document has such a seed, the passage around it, as long as the item on either
side of the diagonal that the seed names, is aligned with the item: match +1, mismatch and gap -0.5, local. The score is
the best alignment over the item's length, and a document is contaminated by an item at ``THRESHOLD`` or more if the alignment also
comes to ``FLOOR`` words, or, in items that are too short for that, to ``SHORT`` of their words; or, however long the item, by an
alignment of ``MATCHED`` or more. Items below SEED words are matched exactly: where all their words stand side by side the score is 1.

Both passes are map-only over the documents, at any size of them. Test items go out in blocks of ``BLOCK`` words; a benchmark of
several blocks passes over the corpus once for each, and only one block is on the driver at a time. What comes back of a pass is one
counter for each seed and task. Hot items, or a document with very many seeds, cost only their own alignments; seeds on
neighbouring diagonals share one passage. A copy that has none of an item's rare seeds isn't seen; the README gives the measured recall.

Defined cases: null and empty items find nothing; null and empty texts are clean; repeated rows
and items are judged each for itself; a text is read whole, whatever its length; ties between passages go to the first; an
empty table on either side gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jaccard import lookup, merged
from .kernel import gram_hashes, inside, spans_by, text_chunks, word_hashes
from .shared import bounded, through_table

SEED, RARE, LEAST, THRESHOLD, FLOOR, SHORT = 3, 0.01, 12, 0.45, 6, 0.8
MISS = 0.5
#: Documents in which a seed is rare however small the corpus.
FEW = 10
#: Alignment score (matched words less MISS for each other step) that is enough in an item of any length.
MATCHED = 50
#: Words of test items that one pass over the corpus takes.
BLOCK = 2_000_000
#: Cells of alignments held at once.
CELLS = 1 << 21
FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("first_word", pa.int64()), ("last_word", pa.int64())])
_own = np.ones(256, bool)
_own[:128] = [chr(i).isalnum() for i in range(128)]


def plain_words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and where each document's begin."""
    start, end, first = spans_by(~_own[buf], offs)
    return word_hashes(buf, start, end), first


def plain_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return text_chunks(pc.utf8_lower(texts))


@dataclass
class Items:
    """Test items side by side. seeds: ascending hashes; for each seed k, the places at[first_at[k]:first_at[k+1]] (item, position)."""

    ids: list[int | None]
    words: np.ndarray
    first: np.ndarray
    seeds: np.ndarray
    first_at: np.ndarray
    item: np.ndarray
    position: np.ndarray


def items_of(rows: list[tuple[int | None, str | None]]) -> Items:
    """The items; those below SEED words have no seeds. rows are (item_id, text)."""
    texts = pa.array([t or "" for _, t in rows], pa.string())
    parts = [(np.zeros(0, np.uint64), np.zeros(1, np.int64))] + [plain_words(buf, offs) for _, _, buf, offs in plain_chunks(texts)]
    h = np.concatenate([p[0] for p in parts])
    n = np.concatenate([np.diff(p[1]) for p in parts])
    first = np.concatenate(([0], np.cumsum(n)))
    g = gram_hashes(h, SEED)
    at = np.flatnonzero(inside(first, SEED, len(h)))
    order = at[np.argsort(g[at], kind="stable")]
    seeds, begin = np.unique(g[order], return_index=True)
    item = np.searchsorted(first, order, "right") - 1
    return Items([i for i, _ in rows], h, first, seeds, np.concatenate((begin, [len(order)])), item, order - first[item])


def rare(items: Items, count: np.ndarray, documents: int) -> Items:
    """The items with only their rare seeds, by the documents that have them."""
    of = np.repeat(np.arange(len(items.seeds)), np.diff(items.first_at))
    found = np.flatnonzero(count[of] > 0)  # no document has the others
    order = found[np.lexsort((items.position[found], items.seeds[of[found]], count[of[found]], items.item[found]))]
    size = np.bincount(items.item[found], minlength=len(items.ids))
    place = np.arange(len(order)) - np.repeat(np.cumsum(size) - size, size)
    keep = np.zeros(len(of), bool)
    keep[order] = (place < LEAST) | (count[of[order]] <= max(FEW, RARE * documents))
    seeds, begin = np.unique(of[keep], return_index=True)
    return Items(items.ids, items.words, items.first, items.seeds[seeds], np.concatenate((begin, [int(keep.sum())])), items.item[keep], items.position[keep])


def document_counts(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """Documents that have each seed, and all documents."""
    width = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(items.seeds) + 1, np.uint64)
        for b in batches:
            out[-1] += np.uint64(b.num_rows)
            for a, z, buf, offs in plain_chunks(b.column("text")):
                h, first = plain_words(buf, offs)
                g = gram_hashes(h, SEED)
                k, at = lookup(items.seeds, g)
                ok = inside(first, SEED, len(h))[at]
                doc = np.searchsorted(first, at[ok], "right") - 1
                out += np.bincount(np.unique(k[ok] * (z - a) + doc) // (z - a), minlength=len(out)).astype(np.uint64)
        for p in range(0, len(out), width):
            yield pa.RecordBatch.from_arrays([pa.array([p // width], pa.int32()), pa.array([out[p : p + width].tobytes()], pa.binary())], ["part", "cells"])

    rows = merged(docs.select("text").mapInArrow(count, "part int, cells binary"), "<u8", lambda a, b: a + b, lambda x: x)
    out = np.concatenate([np.frombuffer(x, np.uint64) for x in rows] or [np.zeros(len(items.seeds) + 1, np.uint64)])
    return out[:-1], int(out[-1])


def align(item: np.ndarray, passage: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smith-Waterman of each row of item with that of passage (0: no word): best scores and where their alignments begin and end in the passage."""
    n, m = passage.shape
    across = np.arange(m) * MISS
    score, since = np.zeros((n, m + 1), np.float32), np.tile(np.arange(m + 1), (n, 1))
    best, begin, end, rows = np.zeros(n, np.float32), np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    for i in range(item.shape[1]):
        word = item[:, i : i + 1]
        diagonal = score[:, :-1] + np.where((word == passage) & (word != 0), np.float32(1), np.float32(-MISS))
        up = score[:, 1:] - np.float32(MISS)
        top = np.maximum(np.maximum(diagonal, up), 0)
        origin = np.where(top <= 0, np.arange(m), np.where(diagonal >= up, since[:, :-1], since[:, 1:]))
        # gaps along the passage: the greatest score to the left less MISS a step
        level = top + across
        reach = np.maximum.accumulate(level, 1)
        source = np.maximum.accumulate(np.where(level >= reach, np.arange(m), 0), 1)
        score[:, 1:] = np.maximum(reach - across, 0)
        since[:, 1:] = origin[rows[:, None], source]
        j = score[:, 1:].argmax(1)
        now = score[rows, j + 1]
        better = now > best
        best[better], begin[better], end[better] = now[better], since[rows, j + 1][better], j[better] + 1
    return best, begin, end


def passages(items: Items, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, items, starts and ends of the passages to align. h, first: words of a chunk of documents."""
    k, at = lookup(items.seeds, gram_hashes(h, SEED))
    ok = inside(first, SEED, len(h))[at]
    k, at = k[ok], at[ok]
    many = np.diff(items.first_at)[k]
    place = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many - items.first_at[k], many)
    at = np.repeat(at, many)
    item, doc = items.item[place], np.searchsorted(first, at, "right") - 1
    diagonal = at - items.position[place]  # where the item would begin
    order = np.lexsort((diagonal, item, doc))
    item, doc, diagonal = item[order], doc[order], diagonal[order]
    long = np.diff(items.first)[item]
    if not len(item):
        return doc, item, diagonal, diagonal
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diagonal[1:] - diagonal[:-1] > long[1:] // 2)))
    a = np.flatnonzero(new)
    z = np.concatenate((a[1:], [len(new)])) - 1
    slack = long[a] // 2 + 2
    return doc[a], item[a], np.maximum(first[doc[a]], diagonal[a] - slack), np.minimum(first[doc[a] + 1], diagonal[z] + long[a] + slack)


def short_matches(items: Items, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, 1, first word, end) of the first place of each item below SEED words that a document has word for word."""
    length = np.diff(items.first)
    for n in range(1, SEED):
        own = np.flatnonzero(length == n)
        if not len(own) or len(h) < n:
            continue
        content = gram_hashes(items.words, n)[items.first[own]]
        order = np.argsort(content, kind="stable")
        keys, begin = np.unique(content[order], return_index=True)
        stop = np.concatenate((begin[1:], [len(order)]))
        k, at = lookup(keys, gram_hashes(h, n))
        ok = inside(first, n, len(h))[at]
        k, at = k[ok], at[ok]
        doc = np.searchsorted(first, at, "right") - 1
        once = np.lexsort((at, k, doc))
        if len(once):
            once = once[np.concatenate(([True], (doc[once][1:] != doc[once][:-1]) | (k[once][1:] != k[once][:-1])))]
        for d, key, place in zip(doc[once].tolist(), k[once].tolist(), at[once].tolist(), strict=True):
            for i in own[order[begin[key] : stop[key]]].tolist():
                yield d, i, 1.0, int(place - first[d]), int(place - first[d]) + n


def enough(length: int, threshold: float = THRESHOLD) -> float:
    """The alignment score from which an item of so many words counts."""
    return min(MATCHED, max(threshold * length, min(FLOOR, SHORT * length)))


def matches(items: Items, h: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, end) of the pairs that count as contaminated."""
    length = np.diff(items.first)
    for found in best_alignments(items, h, first):
        if found[2] * length[found[1]] >= enough(int(length[found[1]]), threshold) - 1e-6:
            yield found
    yield from short_matches(items, h, first)


def best_alignments(items: Items, h: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item, score, first word, end) of the best passage of each pair that has a rare seed."""
    doc, item, start, end = passages(items, h, first)
    length = np.diff(items.first)[item]
    order = np.lexsort((end - start, length))  # alike in size, so that little is padded
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    a = 0
    while a < len(order):
        z = a + 1
        while z < len(order) and (z + 1 - a) * (end - start)[order[a : z + 1]].max() <= CELLS and z - a < 512:
            z += 1
        own = order[a:z]
        q = np.zeros((z - a, int(length[own].max())), np.uint64)
        p = np.zeros((z - a, int((end - start)[own].max())), np.uint64)
        for r, i in enumerate(own):
            q[r, : length[i]] = items.words[items.first[item[i]] : items.first[item[i] + 1]]
            p[r, : end[i] - start[i]] = h[start[i] : end[i]]
        score, begin, stop = align(q, p)
        for r, i in enumerate(own):
            key, got = (int(doc[i]), int(item[i])), (float(score[r]) / int(length[i]), int(start[i] - first[doc[i]] + begin[r]), int(start[i] - first[doc[i]] + stop[r]))
            if key not in found or (got[0], -got[1]) > (found[key][0], -found[key][1]):
                found[key] = got
        a = z
    for (d, i), got in sorted(found.items()):
        yield d, i, *got


def blocks(benchmark: DataFrame) -> Iterator[Items]:
    """Test items of BLOCK words at most, or one item."""
    have, size = [], 0
    for r in benchmark.where(F.length("text") > 0).select("item_id", "text").toLocalIterator():
        have.append((r.item_id, r.text))
        size += len(r.text) // 4
        if size > BLOCK:
            yield items_of(have)
            have, size = [], 0
    if have:
        yield items_of(have)


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word for each document (doc_id, text) and test item (item_id, text) with a passage at threshold or more."""
    out, last, schema = None, None, "doc_id long, item_id long, score double, first_word long, last_word long"
    for items in blocks(benchmark):
        chosen = rare(items, *document_counts(docs, items))

        def find(batches: Iterator[pa.RecordBatch], items: Items = chosen) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a, z, buf, offs in plain_chunks(b.column("text")):
                    ids = b.column("doc_id")[a:z].to_pylist()
                    rows = [(ids[d], items.ids[i], score, s, e - 1) for d, i, score, s, e in matches(items, *plain_words(buf, offs), threshold)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), FOUND, strict=True)], schema=FOUND)

        if last is not None:  # the block before is done with when the next one comes
            last = through_table(last, "contaminated")
            out = last if out is None else out.union(last)
        last = docs.select("doc_id", "text").mapInArrow(find, schema)
    if last is None:
        return docs.sparkSession.createDataFrame([], schema)
    return last if out is None else out.union(last)


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded(spark)
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (text) that no test item contaminates, with all their columns."""
    given = docs
    for items in blocks(benchmark):
        if docs is not given:
            docs = through_table(docs, "clean")
        chosen = rare(items, *document_counts(docs, items))

        def keep(batches: Iterator[pa.RecordBatch], items: Items = chosen) -> Iterator[pa.RecordBatch]:
            for b in batches:
                good = np.ones(b.num_rows, bool)
                for a, _, buf, offs in plain_chunks(b.column("text")):
                    for d, *_ in matches(items, *plain_words(buf, offs), threshold):
                        good[a + d] = False
                yield b.filter(pa.array(good))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
