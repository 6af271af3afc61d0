"""Operator 6: groups of near copies by an n-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct shingles of ``WORDS`` words; two documents link when 100 * intersection >= ``PERCENT`` *
union, and the result names each document's connected component.

Order. Tokens are ordered rare first. A sketch of ``CELLS`` counters over all shingles of all documents gives an upper bound of
each token's frequency; the order is (rounded bound, token), which is the same for every document. Its size is fixed, so it is
the one thing broadcast.

Prefixes. n tokens of which c = ceil(PERCENT% of n) must be shared give a prefix of n - c + l tokens of which l must be shared.
Each document takes the l with the least estimated cost: reading the lists of its prefix tokens, and verifying the candidates
that share l of them. A pair must share the lesser of its two l.

Candidates. Postings (token, text) are dealt by token as packed arrays. Pairs are sought in two steps, so that a group of
thousands of near copies doesn't become all its pairs. First each list links its members only to its most central one; what
verifies gives provisional components. Then every list gives all pairs of members of different components, and those that
verify complete the links: two texts left unlinked in one component change nothing, any others have been compared.

Verification computes the intersection of the whole sets of 64-bit shingles. The texts that take part are found by a Bloom filter of
bounded size and an exact join; each sends its set to the groups that compare it, and a text with very many partners is split
over several groups.

Tables. Lists, candidates and links come from as many partitions as shuffles have, some hundred kB of pairs from 200; they are written
by few tasks. On a local disk Hadoop starts two processes for each file, which share the JVM's memory until they execute.

Equal texts are one node under a 64-bit content key (n texts clash n**2 / 2**65 times), and so are shingles. A posting list is
held by one task, at 26 bytes a different text. Results go from components to texts and from texts to rows by joins that split
large components and large groups of copies over tasks.

Defined cases: A-Z are lower-cased; a null, empty or blank text has no shingles, links with nothing and is its own component;
fewer than WORDS words are one shingle; the component of documents that all have null ids is null; repeated rows are
documents like others; texts are read whole; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .kernel import U, WORD_BASE, gram_hashes, inside, mix, prefix, span_hash, text_chunks, word_hashes, words
from .repeats import _new_texts, _split, by_key, deal, spread
from .shared import bounded, few_files, join_spread, partitions, through_table

WORDS, PERCENT = 5, 80
CELLS_BITS, CHUNK_CELLS = 22, 1 << 16
CELLS = 1 << CELLS_BITS
MATCHES = np.array([1, 2, 3, 4, 6, 8, 12, 16])
#: Cost of a verification in postings read.
VERIFY = 16.0
#: Pairs that one group compares.
SPLIT = 64
FLUSH, PAIRS, BLOOM_BITS = 1_000_000, 2_000_000, 26


def lookup(sorted_: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where values occur in sorted_, and which of them do."""
    if not len(sorted_):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    hit = np.flatnonzero(sorted_[at] == values)
    return at[hit], hit


def lower(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


def shingles(buf: np.ndarray, offs: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each document's distinct shingles in ascending order, side by side, and where each document's begin."""
    low = lower(buf)
    start, end, first = words(low, offs)
    h = word_hashes(low, start, end)
    ok = inside(first, n, len(h))
    g, doc = gram_hashes(h, n)[: len(ok)][ok], np.repeat(np.arange(len(offs) - 1), np.diff(first))[: len(ok)][ok]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < n))
    if len(few):
        g = np.concatenate((g, span_hash(prefix(h, WORD_BASE), first[few], first[few + 1], WORD_BASE)))
        doc = np.concatenate((doc, few))
    order = np.argsort(g)
    order = order[np.argsort(doc[order].astype(np.uint16 if len(offs) < 1 << 16 else np.int64), kind="stable")]
    g, doc = g[order], doc[order]
    if len(g):
        new = np.concatenate(([True], (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])))
        g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(offs)))


def merged(parts: DataFrame, kind: str, combine, finish) -> list[bytes]:
    """Rows (part, cells) of equal length combined by part; one row a part comes to the driver.

    Where there are very many tasks, each part is combined in groups of them first.
    """
    n = partitions(parts.sparkSession)

    def by_part(last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            have: dict[int, np.ndarray] = {}
            for b in batches:
                for p, x in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                    x = np.frombuffer(x, kind)
                    have[p] = combine(have[p], x) if p in have else x
            yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.int32()), pa.array([(finish(x) if last else x).tobytes() for x in have.values()], pa.binary())], ["part", "cells"])

        return merge

    rows = parts.select("part", "cells")
    if (groups := n // 64) > 1:
        rows = rows.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(groups))).repartition(n, "part", "task").select("part", "cells").mapInArrow(by_part(False), "part int, cells binary")
    return [r.cells for r in sorted(rows.repartition(min(n, 64), "part").mapInArrow(by_part(True), "part int, cells binary").collect())]


def measured(docs: DataFrame) -> DataFrame:
    """A table of (doc_id, key, n) for each row, and (part, cells) of each task's sketch."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, np.uint32)
        for b in batches:
            sizes = []
            for _, _, buf, offs in text_chunks(b.column("text")):
                g, first = shingles(buf, offs)
                np.add.at(cells, (g >> U(64 - CELLS_BITS)).astype(np.int64), np.uint32(1))
                sizes.append(np.diff(first))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(np.concatenate(sizes) if sizes else [], pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "key", "n", "part", "cells"])
        for p in range(CELLS // CHUNK_CELLS):
            own = cells[p * CHUNK_CELLS : (p + 1) * CHUNK_CELLS]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([p], pa.int32()), pa.array([own.tobytes()], pa.binary())], ["doc_id", "key", "n", "part", "cells"])

    return through_table(docs.mapInArrow(measure, "doc_id long, key long, n long, part int, cells binary"), "jaccard-sizes")


def frequency_classes(sizes: DataFrame) -> np.ndarray:
    """8 classes an octave of each cell's count, as bytes."""
    sketch = sizes.where("part is not null")
    classes = lambda x: np.minimum(255, np.round(8 * np.log2(1.0 + x))).astype(np.uint8)
    rows = merged(sketch, "<u4", lambda a, b: a + b, classes)
    out = np.zeros(CELLS, np.uint8)
    for p, x in zip(sorted(r.part for r in sketch.select("part").distinct().collect()), rows, strict=True):
        out[p * CHUNK_CELLS : (p + 1) * CHUNK_CELLS] = np.frombuffer(x, np.uint8)
    return out


def prefixes(g: np.ndarray, first: np.ndarray, classes: np.ndarray, expected: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Prefix tokens rare first, their documents, and each document's l and centrality. expected: other texts of a token, by class."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    of = classes[(g >> U(64 - CELLS_BITS)).astype(np.int64)]
    order = np.argsort(of, kind="stable")
    order = order[np.argsort(doc[order].astype(np.uint16 if len(first) < 1 << 16 else np.int64), kind="stable")]
    g, of = g[order], of[order]
    n = np.diff(first)
    c = -(-PERCENT * n // 100)
    cost = np.concatenate(([0.0], np.cumsum(expected[of])))
    base = n - c
    # the cost of each l; beyond c it isn't sound
    long = np.minimum(base[:, None] + MATCHES, n[:, None])
    lists = cost[first[:-1, None] + long] - cost[first[:-1], None]
    price = np.where(MATCHES <= np.maximum(c, 1)[:, None], lists * (1 + VERIFY / MATCHES), np.inf)
    l = MATCHES[np.argmin(price, 1)]  # noqa: E741
    take = np.where(n > 0, np.minimum(base + l, n), 0)
    central = np.zeros(len(n), np.uint8)
    some = n > 0
    central[some] = np.add.reduceat(of.astype(np.int64), first[:-1][some]) // n[some] if len(of) else 0
    own = spread(first[:-1][some], take[some])
    return g[own], np.repeat(np.flatnonzero(some), take[some]), l.astype(np.uint8), central


LISTS = [("token", U), ("key", np.int64), ("n", np.uint32), ("l", np.uint8), ("central", np.uint8)]


def posting_lists(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """A table of (row, token, key, n, l, central): packed postings in token order, whole lists, of tokens that two texts or more have. row: the first token."""
    n_parts = partitions(docs.sparkSession)
    buckets = 4 * n_parts
    bound = 2.0 ** (np.arange(256) / 8) - 1
    # the cells' usual load is chance
    usual = float(np.median(classes[classes > 0])) if (classes > 0).any() else 0.0
    expected = np.maximum(0, bound - 2 * (2.0 ** (usual / 8) - 1) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            g, *rest = (np.concatenate(x) for x in zip(*found, strict=True))
            items = list(_split(((g >> U(32)) % U(buckets)).astype(np.int64), g, *rest))
            for a in range(0, len(items), 64):
                few = items[a : a + 64]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in few], pa.int32()), *(pa.array([c[i].tobytes() for _, c in few], pa.binary()) for i in range(5))], ["bucket", "token", "key", "n", "l", "central"])
            found.clear()
            seen.clear()

        for b in batches:
            b = _new_texts(b, seen)
            keys = b.column("key").to_numpy()
            for a, z, buf, offs in text_chunks(b.column("text")):
                g, first = shingles(buf, offs)
                tokens, doc, l, central = prefixes(g, first, classes, expected)  # noqa: E741
                found.append((tokens, keys[a:z][doc], np.diff(first).astype(np.uint32)[doc], l[doc], central[doc]))
                size += len(tokens)
            if size >= FLUSH:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in LISTS]
        for b in batches:
            for packed in zip(*(b.column(c).to_pylist() for c in ("token", "key", "n", "l", "central")), strict=True):
                for i, x in enumerate(packed):
                    cols[i].append(np.frombuffer(x, LISTS[i][1]))
        if not cols[0]:
            return
        t, *rest = (np.concatenate(c) for c in cols)
        cols.clear()
        order = np.lexsort((rest[0], t))
        t, rest = t[order], [x[order] for x in rest]
        new = np.concatenate(([True], (t[1:] != t[:-1]) | (rest[0][1:] != rest[0][:-1])))  # a text that several tasks have sent counts once
        t, rest = t[new], [x[new] for x in rest]
        edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        count = np.diff(np.concatenate((edge, [len(t)])))
        many = np.repeat(count > 1, count)
        t, rest = t[many], [x[many] for x in rest]
        ends = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True]))) + 1 if len(t) else np.zeros(0, int)
        a = 0
        while a < len(t):
            z = int(ends[min(len(ends) - 1, np.searchsorted(ends, a + 50_000))])
            yield pa.RecordBatch.from_arrays([pa.array(t[a : a + 1].view(np.int64)), *(pa.array([x[a:z].tobytes()], pa.binary()) for x in (t, *rest))], ["row", "token", "key", "n", "l", "central"])
            a = z

    packed = docs.select("key", "text").mapInArrow(send, "bucket int, token binary, key binary, n binary, l binary, central binary").repartition(n_parts, "bucket")
    return through_table(few_files(packed.mapInArrow(collect, "row long, token binary, key binary, n binary, l binary, central binary")), "jaccard-lists")


def least_matches(na: np.ndarray, nb: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Tokens that the prefixes of linked sets have in common at least.

    A pair that links shares t = ceil(p (na + nb) / (1 + p)) tokens, p = PERCENT%. All but n - prefix of these lie in a set's
    prefix, and the rarest of them lie in both.
    """
    share = -(-PERCENT * (na + nb) // (100 + PERCENT))
    own = lambda n, l: share - -(-PERCENT * n // 100) + l  # noqa: E731, E741
    return np.maximum(1, np.minimum(own(na, la.astype(np.int64)), own(nb, lb.astype(np.int64)))).astype(np.uint32)


class Pairs:
    """Pairs of texts with the matches counted so far; held merged."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.size = buckets, [], 0

    def add(self, key: np.ndarray, n: np.ndarray, l: np.ndarray, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:  # noqa: E741
        """The pairs (x, y) of postings whose sizes allow a link, each matched once more."""
        n = n.astype(np.int64)
        na, nb = n[x], n[y]
        ok = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        x, y, na, nb = x[ok], y[ok], na[ok], nb[ok]
        a, b, need = key[x], key[y], least_matches(na, nb, l[x], l[y])
        self.parts.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.uint32), need))
        self.size += len(a)
        if self.size > PAIRS:
            self.parts = [merge_pairs(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])
            if self.size > PAIRS // 2:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            a, b, count, need = merge_pairs(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
            where = (mix(mix(a.view(U)) ^ b.view(U)) % U(self.buckets)).astype(np.int64)
            for bucket, cols in _split(where, a, b, count, need):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["bucket", "a", "b", "count", "need"])
        self.parts, self.size = [], 0


def merge_pairs(a: np.ndarray, b: np.ndarray, count: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    if not len(a):
        return a, b, count, need
    order = np.lexsort((b, a))
    a, b, count, need = a[order], b[order], count[order], need[order]
    at = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    return a[at], b[at], np.add.reduceat(count, at).astype(np.uint32), need[at]


PACKED = "bucket int, a binary, b binary, count binary, need binary"


def enough(packed: DataFrame, name: str) -> DataFrame:
    """A table of the pairs (a, b) with as many matches as they need."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for i, (c, kind) in enumerate((("a", np.int64), ("b", np.int64), ("count", np.uint32), ("need", np.uint32))):
                cols[i] += [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]
        if cols[0]:
            a, b, count, need = merge_pairs(*(np.concatenate(c) for c in cols))
            ok = count >= need
            yield pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])

    return through_table(few_files(packed.repartition(partitions(packed.sparkSession), "bucket").mapInArrow(total, "a long, b long")), name)


def star_pairs(lists: DataFrame) -> DataFrame:
    """Candidates of each list: its most central text with each other one."""
    buckets = 4 * partitions(lists.sparkSession)

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = Pairs(buckets)
        for batch in batches:
            for packed in zip(*(batch.column(c).to_pylist() for c, _ in LISTS), strict=True):
                t, key, n, l, central = (np.frombuffer(x, kind) for x, (_, kind) in zip(packed, LISTS, strict=True))  # noqa: E741
                order = np.lexsort((key, central, t))
                last = np.flatnonzero(np.concatenate((t[1:] != t[:-1], [True])))
                head = np.repeat(order[last], np.diff(np.concatenate(([-1], last))))
                other = head != order
                head, order = head[other], order[other]
                yield from pairs.add(key, n, l, head, order)
        yield from pairs.flush()

    return enough(lists.select(*(c for c, _ in LISTS)).mapInArrow(stars, PACKED), "jaccard-stars")


def cross_pairs(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Candidates of each list between different components; labels (node, label)."""
    n_parts = partitions(lists.sparkSession)
    buckets = 4 * n_parts
    names = [c for c, _ in LISTS]

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [(row, np.unique(np.frombuffer(packed, np.int64))) for row, packed in zip(batch.column("row").to_pylist(), batch.column("key").to_pylist(), strict=True)]
            if own:
                node = np.concatenate([k for _, k in own])
                for b in deal(node % buckets, {"r": np.concatenate([np.full(len(k), r) for r, k in own]), "k": node}, ()):
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.nulls(b.num_rows, pa.int64()), pa.nulls(b.num_rows, pa.int64())], ["bucket", "r", "k", "node", "label"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, nodes, node, label = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            own = batch.filter(batch.column("node").is_valid())
            node.append(own.column("node").to_numpy())
            label.append(own.column("label").to_numpy())
            for got, c in ((rows, "r"), (nodes, "k")):
                got += [np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist() if x]
        r, k, node, label = (np.concatenate(x) for x in (rows, nodes, node, label))
        order = np.argsort(node)
        at, hit = lookup(node[order], k)
        yield from deal(r[hit] % buckets, {"r": r[hit], "k": k[hit], "label": label[order][at]}, ())

    packed = lists.select("row", "key").mapInArrow(members, "bucket int, r binary, k binary, node long, label long")
    given = labels.select(F.pmod("node", F.lit(buckets)).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("r"), F.lit(None).cast("binary").alias("k"), "node", "label")
    known = packed.union(given).repartition(n_parts, "bucket").mapInArrow(look_up, "bucket int, r binary, k binary, label binary")
    null = lambda cols, kind="binary": [F.lit(None).cast(kind).alias(c) for c in cols]
    both = lists.select(F.pmod("row", F.lit(buckets)).cast("int").alias("bucket"), "row", *names, *null(("r", "k", "label"))).union(known.select("bucket", *null(["row"], "long"), *null(names), "r", "k", "label"))

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        found: list[list[np.ndarray]] = [[], [], []]
        for batch in batches:
            for got, c in zip(found, ("r", "k", "label"), strict=True):
                got += [np.frombuffer(x, np.int64) for x in batch.column(c).to_pylist() if x]
            own = batch.filter(batch.column("row").is_valid())
            rows += zip(*(own.column(c).to_pylist() for c in ("row", *names)), strict=True)
        of = dict(by_key(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in found)))
        pairs = Pairs(buckets)
        for r, *packed in rows:
            t, key, n, l, _ = (np.frombuffer(x, kind) for x, (_, kind) in zip(packed, LISTS, strict=True))  # noqa: E741
            group = key.copy()
            if r in of:
                nodes, marks = of[r]
                order = np.argsort(nodes)
                nodes, marks = nodes[order], marks[order]
                at = np.minimum(np.searchsorted(nodes, key), len(nodes) - 1)
                group = np.where(nodes[at] == key, marks[at], key)
            for x, y in across(t, group):
                yield from pairs.add(key, n, l, x, y)
        yield from pairs.flush()

    return enough(both.repartition(n_parts, "bucket").mapInArrow(cross, PACKED), "jaccard-cross")


def across(t: np.ndarray, group: np.ndarray, long: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of equal t and different group; t is sorted."""
    edge = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    count = np.diff(np.concatenate((edge, [len(t)])))
    mixed = np.minimum.reduceat(group, edge) != np.maximum.reduceat(group, edge)
    short = np.flatnonzero(np.repeat(mixed & (count <= long), count))
    left = np.repeat(edge + count, count)
    for step in range(1, long):
        short = short[short + step < left[short]]
        if not len(short):
            break
        ok = group[short] != group[short + step]
        yield short[ok], short[ok] + step
    for a, m in zip(edge[mixed & (count > long)], count[mixed & (count > long)], strict=True):
        own = np.arange(a, a + m)
        values, back, times = np.unique(group[own], return_inverse=True, return_counts=True)
        # each member outside the largest component with all of other components, once
        place = np.lexsort((own, back, -times[back]))
        own, back = own[place], back[place]
        for i in range(int(times.max()), m):
            y = own[:i][back[:i] != back[i]]
            yield np.full(len(y), own[i]), y


def bloom(keys: DataFrame, count: int) -> np.ndarray:
    """Bits of a filter of bounded size; beyond its capacity it lets more pass, never less."""
    bits = int(min(1 << BLOOM_BITS, max(1 << 16, 1 << int(16 * max(count, 1)).bit_length())))
    chunk = 1 << 15

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for b in batches:
            h = mix(b.column(0).to_numpy().view(U))
            for shift in (0, 20, 37):
                at = ((h >> U(shift)) % U(bits)).astype(np.int64)
                np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        for p in range(0, len(own), chunk):
            yield pa.RecordBatch.from_arrays([pa.array([p // chunk], pa.int32()), pa.array([own[p : p + chunk].tobytes()], pa.binary())], ["part", "cells"])

    rows = merged(keys.coalesce(8).mapInArrow(fill, "part int, cells binary"), "u1", np.bitwise_or, lambda x: x)
    return np.concatenate([np.frombuffer(x, np.uint8) for x in rows] or [np.zeros(bits // 8, np.uint8)])


def maybe(filter_: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h, out = mix(keys.view(U)), np.ones(len(keys), bool)
    for shift in (0, 20, 37):
        at = ((h >> U(shift)) % U(8 * len(filter_))).astype(np.int64)
        out &= (filter_[at >> 3] >> (at & 7)) & 1 > 0
    return out


def verified(docs: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    """A table of the pairs (a, b) that link; docs (key, text), pairs (a, b) of keys."""
    degree = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    wide = pairs.join(degree.select(F.col("key").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("key").alias("b"), F.col("d").alias("db")), "b")
    hub, leaf = F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b")), F.when(F.col("da") >= F.col("db"), F.col("b")).otherwise(F.col("a"))
    salt = F.pmod(F.xxhash64(leaf), F.ceil(F.greatest("da", "db") / SPLIT))
    placed = through_table(wide.select("a", "b", hub.alias("hub"), leaf.alias("leaf"), F.xxhash64(hub, salt).alias("group")), f"{name}-placed")
    takers = placed.select(F.col("hub").alias("key"), "group").distinct().union(placed.select(F.col("leaf").alias("key"), "group"))
    takers = takers.groupBy("key").agg(F.collect_set("group").alias("groups"))
    wanted = bloom(takers.select("key"), placed.count() * 2)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            b = _new_texts(b.filter(pa.array(maybe(wanted, b.column("key").to_numpy()))), seen)
            for a, z, buf, offs in text_chunks(b.column("text")):
                g, first = shingles(buf, offs)
                yield pa.RecordBatch.from_arrays([b.column("key")[a:z], pa.array([g[i:j].tobytes() for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["key", "tokens"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        todo: list[tuple[int, int]] = []
        for b in batches:
            for x, y, tokens in zip(*(b.column(c).to_pylist() for c in ("a", "b", "tokens")), strict=True):
                if tokens is None:
                    todo.append((x, y))
                elif x not in sets:
                    sets[x] = np.frombuffer(tokens, U)
        out = []
        for x, y in todo:
            m, k = sets[x], sets[y]
            both = len(m) + len(k) - len(np.unique(np.concatenate((m, k))))
            if 100 * both >= PERCENT * (len(m) + len(k) - both):
                out.append((x, y))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    chosen = docs.select("key", "text").mapInArrow(choose, "key long, tokens binary").join(takers.hint("merge"), "key")  # a broadcast would fit small tables alone
    sent = chosen.select(F.explode("groups").alias("group"), F.col("key").alias("a"), F.lit(None).cast("long").alias("b"), "tokens")
    sent = sent.union(placed.select("group", "a", "b", F.lit(None).cast("binary").alias("tokens")))
    return through_table(few_files(sent.repartition(partitions(docs.sparkSession), "group").mapInArrow(compare, "a long, b long")), name)


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, key, n_shingles, label, component_id for each row of docs (doc_id, text); label: the same for all texts of a component."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), text.alias("text"))
    sizes = measured(rows)
    lists = posting_lists(rows, frequency_classes(sizes))
    links = verified(rows, star_pairs(lists), "jaccard-star-links")
    more = verified(rows, cross_pairs(lists, components(links)), "jaccard-cross-links")
    labels = through_table(components(links.union(more)), "jaccard-labels")
    given = sizes.where("part is null").select("doc_id", "key", "n")
    texts = given.groupBy("key").agg(F.first("n").alias("n_shingles"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    texts = texts.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("label", F.coalesce("label", "key"))
    texts = through_table(texts, "jaccard-texts")
    groups = texts.where("n_shingles > 0").groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("texts"))
    named = join_spread(texts, through_table(groups, "jaccard-groups"), ["label"], "texts", ["key"], "left").drop("least", "texts")
    out = join_spread(given.drop("n"), through_table(named, "jaccard-named"), ["key"], "rows", ["doc_id", "key"])
    return out.select("doc_id", "key", "n_shingles", "label", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, text) that come first in their component, by doc_id (null before all) and then a hash of the text.

    Of rows that agree in both, the one whose columns have the least hash stays, so that a task that runs again chooses as before.
    """
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_ord")
    found = near_copies(docs).select(order, F.col("key").alias("_key"), "label", (F.col("n_shingles") > 0).alias("full"))
    first = found.where("full").groupBy("label").agg(F.min(F.struct("_ord", "_key")).alias("first")).select("first._ord", "first._key")
    first = first.union(found.where("not full").select("_ord", "_key")).distinct()
    rows = docs.select(order, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"), F.struct(*docs.columns).alias("_row"))  # one column, whatever the names
    one = rows.join(first, ["_ord", "_key"]).groupBy("_ord", "_key").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return one.select("_row.*")


#: The same by joining documents on every shingle and walking the links.
SQL = r"""
WITH RECURSIVE worded AS (SELECT doc_id, row_number() OVER () AS row,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT row, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM worded WHERE len(w) > 0),
shingles AS (SELECT DISTINCT row, array_to_string(w[i:i + 4], ' ') AS shingle FROM starts),
sizes AS (SELECT row, count(*) AS n FROM shingles GROUP BY row),
shared AS (SELECT a.row AS a, b.row AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.row < b.row GROUP BY a.row, b.row),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.row = a JOIN sizes y ON y.row = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT row AS a, row AS b FROM worded UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.b),
least AS (SELECT reach.a AS row, min(o.doc_id) AS component_id FROM reach JOIN worded o ON o.row = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM worded JOIN least USING (row) LEFT JOIN sizes USING (row)"""
