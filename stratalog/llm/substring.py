"""Operator 1: removal of repeated word sequences, by prefix-partitioned suffix trees.

A suffix starts at each word that begins a window of ``LENGTH`` words; only suffixes below an anchor that occurs again are
built (``repeats``). They are split into groups that fit in memory: by the anchor, and below anchors with very many suffixes by
longer pieces, whose length varies with how many share them. In a task as many whole groups as ``GROUP`` suffixes allow are
grown at once, each from its own root, an edge of ``EDGE`` words at a time. ``Tree`` keeps the inner nodes; a branch that
stands for one place is a leaf and grows no further. The suffixes below inner nodes of depth ``LENGTH`` are the repeats; those that start side by
side join to maximal repeats, the spans that ``deduplicated`` returns.

Words are compared as 32-bit codes below an equal 64-bit anchor hash; two windows that differ in one word are taken as equal
once in 2**32 such pairs.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` of the whole text; a null or empty text has none, keeps none, and its hash is
that of the empty string; of texts that occur twice, equal rows included, every window is repeated, so all words go where
there are LENGTH; shorter texts are kept; null doc_ids are documents like others; an empty table gives no rows; further columns
are ignored. Long texts are handled whole, in chunks of bounded size, and one longer than a chunk by itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import U, gram_hashes, mix, runs as runs_of, text_chunks, words
from .repeats import Runs, Scheme, cover, keyed, repeated_ranges, spread, with_ranges
from .shared import batch, bounded

LENGTH, EDGE = 35, 5
WORDS = Scheme("word", LENGTH, 12, "<u4")
#: Suffixes whose trees are grown at once.
GROUP = 1_000_000
OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.int64()))])


@dataclass
class Tree:
    """The inner nodes of a group's suffix tree, level by level: depth in words, parent (a node's number, -1 for the root's children), and the places that the leaves below stand for.

    node: of each suffix the deepest inner node above it; a suffix below a node of depth LENGTH repeats.
    """

    depth: np.ndarray
    parent: np.ndarray
    places: np.ndarray
    node: np.ndarray

    def deep(self, depth: int) -> np.ndarray:
        """Which suffixes lie below an inner node of that depth."""
        return np.concatenate((self.depth, [0]))[self.node] >= depth


def grow(root: np.ndarray, at: np.ndarray, edges: np.ndarray, weight: np.ndarray, levels: int, edge: int) -> Tree:
    """The tree of suffixes, grown by an edge of units at a time; a branch that stands for one place is a leaf and grows no further.

    root: the group of each suffix; at: where its units begin; edges[i]: hash of the edge of units from i on; weight: places it stands for.
    """
    name, alive, above = mix(root), np.arange(len(at)), np.full(len(at), -1)
    depth, parent, places, size = [], [], [], 0
    deepest = np.full(len(at), -1)
    for level in range(levels):
        name = mix(name + edges[at[alive] + level * edge] * U(0x9E3779B97F4A7C15))
        order = np.argsort(name)
        if not len(order):
            break
        new = np.concatenate(([True], name[order][1:] != name[order][:-1]))
        begin, child = np.flatnonzero(new), np.cumsum(new) - 1
        leaves = np.add.reduceat(weight[alive[order]], begin)
        inner = leaves > 1
        number = np.where(inner, size + np.cumsum(inner) - 1, -1)
        depth.append(np.full(int(inner.sum()), (level + 1) * edge))
        parent.append(above[alive[order[begin]]][inner])
        places.append(leaves[inner])
        size += int(inner.sum())
        own = np.full(len(order), -1)
        own[order] = number[child]
        keep = own >= 0
        name, alive = name[keep], alive[keep]
        above[alive] = deepest[alive] = own[keep]
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Tree(cat(depth), cat(parent), cat(places), deepest)


def solve(runs: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur again, in any document: those below a deep node. A run's places share that."""
    n = runs.n.astype(np.int64)
    size = n + LENGTH - 1
    order = np.argsort(runs.h, kind="stable")
    edges = gram_hashes(mix(runs.body.astype(U) + U(1)), EDGE)
    at, first = np.cumsum(size) - size, np.cumsum(n) - n
    picked = np.zeros(int(n.sum()), bool)
    ends = np.flatnonzero(np.concatenate((runs.h[order][1:] != runs.h[order][:-1], [True]))) + 1 if len(order) else np.zeros(0, int)  # of groups
    many = np.cumsum(n[order])[ends - 1]
    a = 0
    while a < len(n):
        have = many[np.searchsorted(ends, a)] if a else 0
        z = int(ends[max(np.searchsorted(ends, a, "right"), np.searchsorted(many, have + GROUP, "right") - 1)])
        own = order[a:z]
        run = np.repeat(own, n[own])
        tree = grow(runs.h[run], spread(at[own], n[own]), edges, runs.many[run].astype(np.int64), LENGTH // EDGE, EDGE)
        picked[spread(first[own], n[own])] = tree.deep(LENGTH)
        a = z
    return picked, picked


def kept_words(buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, keep: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The kept words of each document joined by spaces, side by side, and where each document's begin."""
    s, e = start[keep], end[keep]
    count = np.concatenate(([0], np.cumsum(keep)))[first]
    long = e - s + 1
    last = count[1:][count[1:] > count[:-1]] - 1
    long[last] -= 1
    where = spread(s, long)
    gap = np.zeros(len(where), bool)
    stop = np.cumsum(long)
    inner = np.ones(len(long), bool)
    inner[last] = False
    gap[stop[inner] - 1] = True
    out = buf[np.minimum(where, max(0, len(buf) - 1))]
    out[gap] = 0x20
    return out.tobytes(), np.concatenate(([0], stop))[count]


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept and spans (first word, end, first word, end, ... of the maximal repeats) for each row of docs (doc_id, text)."""
    rows = keyed(docs)
    ranges, copies = repeated_ranges(rows, WORDS, solve)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            copies, ranges = b.column("copies").to_numpy(), b.column("ranges")
            for a, z, buf, offs in text_chunks(b.column("text")):
                start, end, first = words(buf, offs)
                n = np.diff(first)
                keep = np.ones(len(start), bool)
                for i, own in enumerate(ranges[a:z].to_pylist()):
                    if copies[a + i] > 1 and n[i] >= LENGTH:
                        keep[first[i] : first[i + 1]] = False
                    elif own:
                        keep[first[i] : first[i + 1]] = ~cover(own, LENGTH, int(n[i]))
                text, at = kept_words(buf, start, end, first, keep)
                kept = np.diff(np.concatenate(([0], np.cumsum(keep)))[first])
                parts = [text[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
                spans = [np.stack(runs_of(~keep[x:y]), 1).ravel() for x, y in zip(first[:-1], first[1:], strict=True)]
                hashes = [hashlib.sha256(x).hexdigest() for x in parts]
                yield batch(OUT, [b.column("doc_id")[a:z], n, n - kept, hashes, pa.array(parts, pa.binary()).cast(pa.string()), spans])

    return with_ranges(rows, ranges, copies).mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, spans array<long>")


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: The same by grouping every window with its words.
SQL = r"""
WITH worded AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT row, unnest(range(1, len(w) - 33)) AS i, w FROM worded WHERE len(w) >= 35),
windows AS (SELECT row, i, array_to_string(w[i:i + 34], ' ') AS content FROM starts),
often AS (SELECT content FROM windows GROUP BY content HAVING count(*) > 1),
covered AS (SELECT DISTINCT row, unnest(range(i, i + 35)) AS p FROM windows JOIN often USING (content)),
places AS (SELECT row, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM worded),
kept AS (SELECT row, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM places ANTI JOIN covered USING (row, p) GROUP BY row)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM worded LEFT JOIN kept USING (row)"""
