"""Repeated windows across a corpus: what operators 1 and 4 share.

A window is ``length`` consecutive units (words or bytes) of one document. Which windows occur twice is found in three steps
that ship neither all windows nor all texts.

1. Of the ``gram`` units long pieces of each window, the one with the least hash is its anchor. Equal windows have equal
   anchors, and a text has only about 2 / (length - gram) anchors a unit. Anchors that occur once in the corpus rule out all
   their windows (``repeated_anchors``).
2. For anchors that occur again, the runs of windows below them are sent, with their units, to the group of the anchor (``send``). An
   anchor with more than ``HEAVY`` runs is split by longer pieces around it. Windows that begin within so many units of one another share
   the longer a piece the fewer these are; a run is halved, and its halves again, until at most HEAVY runs have the piece that a part's
   windows share (``crowded``). What is left in the end are single windows, whose piece is the whole window: one string.
3. Each group is solved in memory by the operator's own structure, a suffix tree or a suffix array (``solve``), which says of each
   window of each run whether it goes. Equal runs enter the structure once, with the number of places they stand for, and what the
   structure says of a run is delivered to all its places (``deliver``): no window goes that the structure hasn't seen.

Equal texts are handled once, under a 64-bit content key; n different texts are expected to clash n**2 / 2**65 times, and so are
equal runs. Each Python task first merges what it holds: of equal texts, anchors or runs it sends one, so the hottest of them comes to
one row a task, however many documents have it; the other places of a run wait in buckets of its hash, split in proportion
to its anchor's weight. Rows of the exchange are packed arrays, one for each task and bucket. The number of buckets follows
spark.sql.shuffle.partitions. What the driver gets are the heavy anchors and prefixes; as heavy means more than a millionth of all,
these are a million at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import BYTE, BYTE_BASE, U, WORD_BASE, anchors, gram_hashes, inside, mix, prefix, sliding, span_hash, text_chunks, word_hashes, words
from .shared import join_spread, partitions, through_table

HEAVY = 20_000
#: Anchors, and bytes of runs, that a Python task gathers before it merges and sends them.
FLUSH_ANCHORS, FLUSH_BYTES = 1_000_000, 24 << 20


@dataclass(frozen=True)
class Scheme:
    """What a window is. code: dtype in which a unit is sent."""

    unit: str
    length: int
    gram: int
    code: str

    @property
    def width(self) -> int:
        return self.length - self.gram + 1

    @property
    def blocks(self) -> list[int]:
        """Numbers of window offsets that share a piece, halving down to one."""
        top = 1 << (self.width - 1).bit_length()
        return [top >> k for k in range(1, top.bit_length())]

    def units(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of the units of a chunk, and where each document's begin."""
        if self.unit == "byte":
            return BYTE[buf], offs
        start, end, first = words(buf, offs)
        return word_hashes(buf, start, end), first

    @property
    def base(self) -> int:
        return BYTE_BASE if self.unit == "byte" else WORD_BASE

    def codes(self, units: np.ndarray, buf: np.ndarray) -> np.ndarray:
        return buf if self.unit == "byte" else (units >> U(64 - 8 * np.dtype(self.code).itemsize)).astype(self.code)

    def anchors(self, units: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Anchors' hashes and positions."""
        grams = gram_hashes(units, self.gram, self.base)
        at = anchors(grams, inside(first, self.gram, len(units)), inside(first, self.length, len(units)), self.width)[1]
        return grams[at], at

    def lowest(self, units: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Anchor of each window (0: no window)."""
        ok = inside(first, self.length, len(units))
        return np.where(ok, sliding(gram_hashes(units, self.gram, self.base), self.width)[: len(ok)], U(0))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, ord (null before all), key, text of docs (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("ord"), F.xxhash64(text).alias("key"), text.alias("text"))


def _new_texts(b: pa.RecordBatch, seen: set[int]) -> pa.RecordBatch:
    """The rows with texts that the task has not had since the last flush."""
    keys = b.column("key").to_pylist()
    own = []
    for i, k in enumerate(keys):
        if k not in seen:
            seen.add(k)
            own.append(i)
    return b if len(own) == b.num_rows else b.take(pa.array(own, pa.int64()))


def _split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), [c[order[a:z]] for c in columns]


def key_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys.view(U)) % U(buckets)).astype(np.int64)


def packed_rows(bucket: list[int], columns: dict[str, list[bytes]], more: dict[str, list[bytes | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(pa.array(x, pa.binary()) for x in (*columns.values(), *more.values()))], ["bucket", *columns, *more])


def deal(bucket: np.ndarray, columns: dict[str, np.ndarray], more: tuple[str, ...] = ("heavy",)) -> Iterator[pa.RecordBatch]:
    """One row of packed columns for each bucket; null in more."""
    items = list(_split(bucket, *columns.values()))
    for a in range(0, len(items), 64):
        few = items[a : a + 64]
        yield packed_rows([b for b, _ in few], {name: [c[i].tobytes() for _, c in few] for i, name in enumerate(columns)}, {name: [None] * len(few) for name in more})


def unpack(batches: Iterator[pa.RecordBatch], kinds: dict[str, type], more: list[str] = ()) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """The packed columns of all rows side by side, and what isn't null of the others."""
    cols, rest = {c: [] for c in kinds}, {c: [] for c in more}
    for b in batches:
        for c, kind in kinds.items():
            cols[c] += [np.frombuffer(x, kind) for x in b.column(c).to_pylist() if x]
        for c in more:
            rest[c] += [x for x in b.column(c).to_pylist() if x]
    return [np.concatenate(x) if x else np.zeros(0, kinds[c]) for c, x in cols.items()], list(rest.values())


def by_key(keys: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Columns by key; keys are signed 64-bit."""
    if len(keys):
        order = np.argsort(keys, kind="stable")
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys[order])) + 1, [len(keys)]))
        for a, z in zip(edges[:-1], edges[1:], strict=True):
            yield int(keys[order[a]]), [c[order[a:z]] for c in columns]


def repeated_anchors(rows: DataFrame, scheme: Scheme) -> DataFrame:
    """(key, anchors binary, heavy binary): the anchors of each text that occur again; heavy: anchors of heavy groups, with key 0."""
    n = partitions(rows.sparkSession)
    buckets = 4 * n

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        found: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, k = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h)
            h, k = h[order], k[order]
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.concatenate((edge, [len(h)])))
            again = np.repeat(count > 1, count)
            out: dict[int, list[np.ndarray]] = {}
            none = [np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)]
            for bucket, cols in _split((h[~again] % U(buckets)).astype(np.int64), h[~again], k[~again]):
                out.setdefault(bucket, list(none))[:2] = cols
            many = edge[count > 1]
            for bucket, cols in _split((h[many] % U(buckets)).astype(np.int64), h[many], count[count > 1]):
                out.setdefault(bucket, list(none))[2:4] = cols
            for bucket, cols in _split((mix(k[again].view(U)) % U(buckets)).astype(np.int64), h[again], k[again]):
                out.setdefault(bucket, list(none))[4:] = cols
            names = ["bucket", "h", "k", "many", "count", "sure_h", "sure_k"]
            items = list(out.items())
            for a in range(0, len(items), 64):
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in items[a : a + 64]], pa.int32()), *(pa.array([c[i].tobytes() for _, c in items[a : a + 64]], pa.binary()) for i in range(6))], names)
            found.clear()
            seen.clear()

        for b in batches:
            b = _new_texts(b, seen)
            keys = b.column("key").to_numpy()
            for a, _, buf, offs in text_chunks(b.column("text")):
                units, first = scheme.units(buf, offs)
                h, at = scheme.anchors(units, first)
                doc = np.searchsorted(first, at, "right") - 1
                found.append((h, keys[a + doc]))
                size += len(h)
            if size >= FLUSH_ANCHORS:
                yield from flush()
                size = 0
        if size:
            yield from flush()

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[] for _ in range(6)]
        for b in batches:
            for i, (name, kind) in enumerate((("h", U), ("k", np.int64), ("many", U), ("count", np.int64), ("sure_h", U), ("sure_k", np.int64))):
                cols[i] += [np.frombuffer(x, kind) for x in b.column(name).to_pylist() if x]
        if not any(cols):
            return
        h, k, many, count, sure_h, sure_k = (np.concatenate(c) if c else np.zeros(0, kind) for c, kind in zip(cols, (U, np.int64, U, np.int64, U, np.int64), strict=True))
        cols.clear()
        if len(h):
            order = np.lexsort((k, h))
            h, k = h[order], k[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])))  # one text in several tasks counts once
            h, k = h[new], k[new]
        total = np.concatenate((h, many))
        values, back, times = np.unique(total, return_inverse=True, return_counts=True)
        weight = np.bincount(back, np.concatenate((np.ones(len(h)), count)), len(values)).astype(np.int64)
        again = np.zeros(len(values), bool)
        again[back[len(h) :]] = True
        again |= times > 1
        keep = again[back[: len(h)]]
        heavy = weight > HEAVY
        k, h = np.concatenate((k[keep], sure_k)), np.concatenate((h[keep], sure_h))
        yield from deal(key_buckets(k, buckets), {"k": k, "h": h})
        if heavy.any():
            yield packed_rows([0], {"k": [b""], "h": [b""]}, {"heavy": [values[heavy].tobytes() + weight[heavy].tobytes()]})

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (k, h), (heavy,) = unpack(batches, {"k": np.int64, "h": U}, ["heavy"])
        out = [(key, c.tobytes(), b"") for key, (c,) in by_key(k, h)] + [(0, b"", x) for x in heavy]
        for a in range(0, len(out), 5_000):
            x, y, z = zip(*out[a : a + 5_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.binary()), pa.array(z, pa.binary())], ["key", "anchors", "heavy"])

    packed = rows.select("key", "text").mapInArrow(gather, "bucket int, h binary, k binary, many binary, count binary, sure_h binary, sure_k binary")
    found = packed.repartition(n, "bucket").mapInArrow(match, "bucket int, k binary, h binary, heavy binary")
    return found.repartition(n, "bucket").mapInArrow(regroup, "key long, anchors binary, heavy binary")


@dataclass
class Heavy:
    """Anchors with more runs than a group may have, ascending, and how many; crowded: for each of Scheme.blocks but the last, the names of the pieces that too many runs have, ascending."""

    h: np.ndarray
    weight: np.ndarray
    crowded: list[np.ndarray]

    def parts(self, h: np.ndarray) -> np.ndarray:
        """Into how many parts the places of runs below anchors h are dealt."""
        out = np.ones(len(h), np.int64)
        if len(self.h):
            at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
            hit = self.h[at] == h
            out[hit] = -(-self.weight[at[hit]] // HEAVY)
        return out


def heavy_anchors(found: DataFrame, n_anchors: int) -> Heavy:
    """More than HEAVY, and than a millionth of all."""
    hs, ws = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for r in found.where(F.octet_length("heavy") > 0).select("heavy").toLocalIterator():
        half = len(r.heavy) // 2
        h, n = np.frombuffer(r.heavy[:half], U), np.frombuffer(r.heavy[half:], np.int64)
        keep = n > max(HEAVY, n_anchors // 1_000_000)
        hs.append(h[keep])
        ws.append(n[keep])
    h, w = np.concatenate(hs), np.concatenate(ws)
    order = np.argsort(h)
    return Heavy(h[order], w[order], [])


#: Columns of a run of windows below one anchor. h: its group; code: a hash of its units; many: places that the sender knows of.
RUN = [("h", U), ("code", U), ("key", np.int64), ("ord", np.int64), ("start", np.uint32), ("n", np.uint16), ("many", np.uint32), ("parts", np.uint32)]


@dataclass
class Runs:
    """Runs of windows below one anchor each. body: their units one after the other, n + length - 1 a run."""

    h: np.ndarray
    code: np.ndarray
    key: np.ndarray
    ord: np.ndarray
    start: np.ndarray
    n: np.ndarray
    many: np.ndarray
    parts: np.ndarray
    body: np.ndarray

    def take(self, own: np.ndarray, size: np.ndarray) -> Runs:
        """size: units of each run."""
        at = np.cumsum(size) - size
        return Runs(*(getattr(self, name)[own] for name, _ in RUN), self.body[spread(at[own], size[own])])


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then the same for start[1], ..."""
    if not len(size):
        return np.zeros(0, np.int64)
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size - start, size)


#: solve(runs) of different runs: for each window whether it goes at the run's first place (key, start), and at its other places.
Solver = Callable[[Runs], tuple[np.ndarray, np.ndarray]]


def candidate_runs(scheme: Scheme, units: np.ndarray, first: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, documents, first windows (in units) and windows of the runs whose anchor is wanted; units and first: a chunk of documents."""
    low = scheme.lowest(units, first)
    if not len(low):
        return low, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(low)]
    begin = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]))))
    long = np.diff(np.concatenate((begin, [len(low)])))
    hit = np.isin(low[begin], wanted) & (low[begin] != 0)
    begin, long = begin[hit], long[hit]
    pieces = -(-long // scheme.width)  # longer runs come from periodic text
    begin, step = np.repeat(begin, pieces), np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    long = np.minimum(np.repeat(long, pieces) - step * scheme.width, scheme.width)
    begin = begin + step * scheme.width
    return low[begin], doc[begin], begin, long


def heavy_windows(scheme: Scheme, units: np.ndarray, h: np.ndarray, begin: np.ndarray, long: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the windows of runs below known anchors h: the run, the first unit, and how far behind that the first place of the anchor is."""
    grams = gram_hashes(units, scheme.gram, scheme.base)
    at = np.flatnonzero(np.isin(grams, known))
    places = np.sort(np.searchsorted(known, grams[at]) * len(units) + at)
    run, window = np.repeat(np.arange(len(h)), long), spread(begin, long)
    own = np.searchsorted(known, h)[run] * len(units)
    return run, window, places[np.searchsorted(places, own + window)] - own - window


def piece_names(scheme: Scheme, sums: np.ndarray, anchor: np.ndarray, window: np.ndarray, behind: np.ndarray, block: int) -> np.ndarray:
    """Names of the pieces that windows share with those whose anchor is as far behind, in blocks of so many units."""
    least = behind - behind % block
    most = np.minimum(least + block, scheme.width) - 1
    at = window + behind
    return mix(span_hash(sums, at - least, at - most + scheme.length, scheme.base) ^ mix(anchor + (least * 1024 + block).astype(U)))


def crowded(rows: DataFrame, scheme: Scheme, heavy: Heavy, least: int) -> list[np.ndarray]:
    """For each of Scheme.blocks but the last, the names of pieces of runs below heavy anchors that more than `least` runs have; copies of a text in several tasks count again."""
    steps = scheme.blocks[:-1]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, U), np.zeros(0, np.int64)) for _ in steps]

        def out(i: int) -> pa.RecordBatch:
            names, n = have[i]
            have[i] = np.zeros(0, U), np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(names), i), pa.int32()), pa.array(names.view(np.int64)), pa.array(n)], ["step", "name", "n"])

        seen: set[int] = set()
        for b in batches:
            for _, _, buf, offs in text_chunks(_new_texts(b, seen).column("text")):
                units, first = scheme.units(buf, offs)
                h, _, begin, long = candidate_runs(scheme, units, first, heavy.h)
                if not len(h):
                    continue
                run, window, behind = heavy_windows(scheme, units, h, begin, long, heavy.h)
                sums = prefix(units, scheme.base)
                for i, block in enumerate(steps):
                    names = piece_names(scheme, sums, h[run], window, behind, block)
                    once = np.concatenate(([True], (names[1:] != names[:-1]) | (run[1:] != run[:-1])))
                    names, n = np.unique(names[once], return_counts=True)
                    names, back = np.unique(np.concatenate((have[i][0], names)), return_inverse=True)
                    have[i] = names, np.bincount(back, np.concatenate((have[i][1], n)), len(names)).astype(np.int64)
                    if len(names) > FLUSH_ANCHORS:
                        seen.clear()
                        yield out(i)
        for i in range(len(steps)):
            yield out(i)

    counts = rows.select("key", "text").mapInArrow(count, "step int, name long, n long").groupBy("step", "name").agg(F.sum("n").alias("n"))
    out: list[list[int]] = [[] for _ in steps]
    for r in counts.where(F.col("n") > least).select("step", "name").toLocalIterator():
        out[r.step].append(r.name)
    return [np.sort(np.array(x, np.int64).view(U)) for x in out]


def repeated_ranges(rows: DataFrame, scheme: Scheme, solve: Solver) -> tuple[DataFrame, DataFrame]:
    """(key, ranges binary) with the pairs [a, b) of window starts that solve picks, and a table of (key, least, copies).

    Texts with copies are treated as their first copy.
    """
    spark = rows.sparkSession
    n = partitions(spark)
    buckets = 4 * n
    copies = through_table(rows.groupBy("key").agg(F.min("ord").alias("least"), F.count(F.lit(1)).alias("copies")), "copies")
    found = through_table(repeated_anchors(rows, scheme), "anchors")
    n_anchors = found.select(F.coalesce(F.sum(F.octet_length("anchors")), F.lit(0))).first()[0] // 8
    again = found.where(F.octet_length("anchors") > 0).select("key", "anchors").join(copies, "key")
    given = join_spread(rows.select("ord", "key", "text"), again, ["key"], "copies", ["ord"])
    heavy = heavy_anchors(found, n_anchors)
    if len(heavy.h):
        heavy.crowded = crowded(rows, scheme, heavy, max(HEAVY, n_anchors // 1_000_000))
    kinds = {**{f"r_{x}": kind for x, kind in RUN}, "body": np.dtype(scheme.code)}
    places = {"c_code": U, "c_key": np.int64, "c_start": np.uint32}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        parts: list[Runs] = []
        held: list[np.ndarray] = []  # the chunks' units; body of a run in parts: where its own begin
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            units = np.concatenate(held)
            r = Runs(*(np.concatenate([getattr(p, name) for p in parts]) for name in [*(name for name, _ in RUN), "body"]))
            # of equal runs the first is sent, the other places wait for what is said of it
            order = np.lexsort((r.start, r.key, r.ord, r.code))
            new = np.concatenate(([True], r.code[order][1:] != r.code[order][:-1]))
            own, rest = order[new], order[~new]
            r.many[own] = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
            for b, (i,) in _split((mix(r.h[own]) % U(buckets)).astype(np.int64), own):
                cols = {f"r_{x}": [getattr(r, x)[i].tobytes()] for x, _ in RUN}
                cols["body"] = [units[spread(r.body[i], r.n[i].astype(np.int64) + scheme.length - 1)].tobytes()]
                yield packed_rows([b], cols, {c: [None] for c in places})
            part = mix(r.key[rest].view(U)) % r.parts[rest].astype(U)
            for b, cols in _split((mix(r.code[rest] + part) % U(buckets)).astype(np.int64), r.code[rest], r.key[rest], r.start[rest]):
                yield packed_rows([b], {c: [None] for c in kinds}, {c: [x.tobytes()] for c, x in zip(places, cols, strict=True)})
            for x in (parts, held, seen):
                x.clear()

        for b in batches:
            b = _new_texts(b, seen)
            keys, order, lists = b.column("key").to_numpy(), b.column("least").to_numpy(), b.column("anchors")
            for a, z, buf, offs in text_chunks(b.column("text")):
                units, first = scheme.units(buf, offs)
                h, doc, begin, long = candidate_runs(scheme, units, first, np.frombuffer(b"".join(lists[a:z].to_pylist()), U))
                if not len(h):
                    continue
                sums, share = prefix(units, scheme.base), heavy.parts(h)
                is_heavy = np.isin(h, heavy.h)
                if is_heavy.any():
                    own = np.flatnonzero(is_heavy)
                    run, window, behind = heavy_windows(scheme, units, h[own], begin[own], long[own], heavy.h)
                    anchor = h[own][run]
                    name, left = np.zeros(len(run), U), np.arange(len(run))
                    for i, block in enumerate(scheme.blocks):
                        names = piece_names(scheme, sums, anchor[left], window[left], behind[left], block)
                        fits = ~np.isin(names, heavy.crowded[i]) if block > 1 else np.ones(len(left), bool)
                        name[left[fits]] = names[fits]
                        left = left[~fits]
                    cut = np.flatnonzero(np.concatenate(([True], (name[1:] != name[:-1]) | (run[1:] != run[:-1]))))
                    piece, rest = own[run[cut]], ~is_heavy
                    doc, share = np.concatenate((doc[rest], doc[piece])), np.concatenate((share[rest], share[piece]))
                    h, begin = np.concatenate((h[rest], name[cut])), np.concatenate((begin[rest], window[cut]))
                    long = np.concatenate((long[rest], np.diff(np.concatenate((cut, [len(run)])))))
                code = mix(span_hash(sums, begin, begin + long + scheme.length - 1, scheme.base) ^ mix(h))
                base = sum(map(len, held))
                parts.append(Runs(h, code, keys[a + doc], order[a + doc], (begin - first[doc]).astype(np.uint32), long.astype(np.uint16), np.ones(len(h), np.uint32), share.astype(np.uint32), base + begin))
                held.append(scheme.codes(units, buf))
                size += held[-1].nbytes + 64 * len(h)
            if size >= FLUSH_BYTES and parts:
                yield from flush()
                size = 0
        if parts:
            yield from flush()

    names = ["k", "a", "z", "code", "wait", "wait_k", "wait_a"]

    def row(bucket: int, **columns: np.ndarray) -> pa.RecordBatch:
        return packed_rows([bucket], {c: [columns[c].tobytes() if c in columns else None] for c in names}, {})

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: list[pa.RecordBatch] = []
        for b in batches:
            waits = b.column("c_code").is_valid()
            own = b.filter(waits)
            if own.num_rows:
                nulls = [pa.nulls(own.num_rows, pa.binary())] * 4
                yield pa.RecordBatch.from_arrays([own.column("bucket"), *nulls, *(own.column(c) for c in places)], ["bucket", *names])
            mine.append(b.filter(pc.invert(waits)))
        full, _ = unpack(mine, kinds)
        mine.clear()
        every = Runs(*full)
        if not len(every.h):
            return
        # what several tasks have sent as equal is one run, which stands first where the first of them does
        order = np.lexsort((every.start, every.key, every.ord, every.code))
        code, key, start = every.code[order], every.key[order], every.start[order]
        new = np.concatenate(([True], code[1:] != code[:-1]))
        begin, of = np.flatnonzero(new), np.cumsum(new) - 1
        fresh = new.copy()  # a text that several tasks have sent counts once
        fresh[1:] |= (key[1:] != key[:-1]) | (start[1:] != start[:-1])
        waiting = np.maximum.reduceat(every.many[order], begin) > 1
        runs = every.take(order[new], every.n.astype(np.int64) + scheme.length - 1)
        runs.many = np.maximum(np.maximum.reduceat(every.many[order], begin), np.add.reduceat(fresh.astype(np.int64), begin))
        here, there = solve(runs)
        n_of = runs.n.astype(np.int64)
        rest = np.flatnonzero(fresh & ~new)  # other places that came with units
        picked = there[spread((np.cumsum(n_of) - n_of)[of[rest]], n_of[of[rest]])]
        found = [window_ranges(runs.key, runs.start, n_of, here), window_ranges(key[rest], start[rest], n_of[of[rest]], picked)]
        k, a, z = (np.concatenate(x) for x in zip(*found, strict=True))
        for b, cols in _split(key_buckets(k, buckets), k, a.astype(np.uint32), z.astype(np.uint32)):
            yield row(b, **dict(zip(("k", "a", "z"), cols, strict=True)))
        # what is said of runs with places that wait, once for each part of these
        copy, low, high = window_ranges(np.arange(len(n_of)), np.zeros(len(n_of), np.int64), n_of, there & np.repeat(waiting, n_of))
        parts = runs.parts[copy].astype(np.int64)
        part, at = spread(np.zeros(len(copy), np.int64), parts), np.repeat(np.arange(len(copy)), parts)
        told = runs.code[copy][at]
        for b, cols in _split((mix(told + part.astype(U)) % U(buckets)).astype(np.int64), told, low[at].astype(np.uint32), high[at].astype(np.uint32)):
            yield row(b, **dict(zip(("code", "a", "z"), cols, strict=True)))

    def deliver(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (code, a, z, wait, key, start), _ = unpack(batches, {"code": U, "a": np.uint32, "z": np.uint32, "wait": U, "wait_k": np.int64, "wait_a": np.uint32})
        order = np.argsort(code)
        code, a, z = code[order], a[order].astype(np.int64), z[order].astype(np.int64)
        low, high = np.searchsorted(code, wait, "left"), np.searchsorted(code, wait, "right")
        at, of = spread(low, high - low), np.repeat(np.arange(len(wait)), high - low)
        yield from deal(key_buckets(key[of], buckets), {"k": key[of], "a": (start[of] + a[at]).astype(np.uint32), "z": (start[of] + z[at]).astype(np.uint32)}, ())

    def regroup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (k, a, z), _ = unpack(batches, {"k": np.int64, "a": np.uint32, "z": np.uint32})
        out = [(key, np.stack(x, 1).tobytes()) for key, x in by_key(k, a, z)]
        for i in range(0, len(out), 5_000):
            x, y = zip(*out[i : i + 5_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.binary())], ["key", "ranges"])

    packed = lambda columns: ", ".join(["bucket int", *(f"{c} binary" for c in columns)])
    sent = given.select("key", "text", "least", "anchors").mapInArrow(send, packed([*kinds, *places]))
    answered = through_table(sent.repartition(n, "bucket").mapInArrow(answer, packed(names)), "answers")
    delivered = answered.where("k is null").select("bucket", *names[1:]).repartition(n, "bucket").mapInArrow(deliver, packed(names[:3]))
    ranges = answered.where("k is not null").select("bucket", *names[:3]).union(delivered)
    return ranges.repartition(n, "bucket").mapInArrow(regroup, "key long, ranges binary"), copies


def with_ranges(rows: DataFrame, ranges: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, ord, key, text, least, copies, ranges for every row."""
    facts = through_table(copies.join(ranges, "key", "left"), "ranges")
    return join_spread(rows, facts, ["key"], "copies", ["ord"]).select("doc_id", "ord", "key", "text", "least", "copies", "ranges")


def cover(ranges: bytes | None, length: int, n: int) -> np.ndarray:
    """Units of a document of n units that windows starting in the ranges cover."""
    edge = np.zeros(n + 1, np.int32)
    if ranges:
        pairs = np.frombuffer(ranges, np.uint32).astype(np.int64).reshape(-1, 2)
        np.add.at(edge, pairs[:, 0], 1)
        np.add.at(edge, pairs[:, 1] - 1 + length, -1)
    return np.cumsum(edge[:-1]) > 0


def window_ranges(key: np.ndarray, start: np.ndarray, n: np.ndarray, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of the picked windows; picked has n entries for each run."""
    run = np.repeat(np.arange(len(n)), n)
    at = np.cumsum(n) - n
    last = np.zeros(len(picked), bool)
    last[at + n - 1] = True
    before = np.concatenate(([False], (picked & ~last)[:-1]))  # whether the window before, of the same run, goes on
    begin = np.flatnonzero(picked & ~before)
    following = np.concatenate((picked[1:], [False])) & ~last
    end = np.flatnonzero(picked & ~following)
    base = start.astype(np.int64)[run] - at[run]
    return key[run[begin]], base[begin] + begin, base[end] + end + 1
