"""Operator 4: removal of byte strings that occur earlier, by suffix arrays.

Suffixes are the windows of ``LENGTH`` bytes below an anchor that occurs again (``repeats``); those of one anchor go to one
task. There the runs of windows are put in document order inside their group and cut into shards, of whole groups where they fit. Each
shard gets its own suffix array by Larsson-Sadakane refinement: suffixes are ranked by their first 8 bytes, and ranks double in
depth by pairing a suffix's rank with that of the suffix so many bytes on, where only groups that are still tied are sorted again, up to LENGTH
bytes, beyond which order doesn't matter here. Kasai's rule, that the common prefix with the suffix before shrinks by one byte at most from one position to
the next, then gives the common prefixes, for all runs in step. Neighbours with a common prefix of LENGTH are one string. The
shards of a group are merged in document order: each different string is sought by binary search in the suffix arrays of the
shards before, byte by byte.

Defined cases: bytes are those of the whole text in UTF-8; a null or empty text has none and its hash is that of the empty
string; documents are ordered by doc_id, null before all, then by a hash of the text, so that of different texts under one
doc_id one comes first; rows that are equal in doc_id and text are neither before the other, and lose the same bytes; a
removed run may cut a character, so what is kept is bytes; texts shorter than LENGTH are kept; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .kernel import runs, text_chunks
from .repeats import Runs, Scheme, cover, keyed, repeated_ranges, spread, with_ranges
from .shared import bounded

LENGTH = 100
BYTES = Scheme("byte", LENGTH, 32, "u1")
#: Bytes of a shard.
SHARD = 1 << 20
OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def first_eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as one big-endian number; the last 7 positions have fewer and aren't given."""
    out = np.zeros(max(0, len(text) - 7), np.uint64)
    for i in range(8):
        out |= text[i : i + len(out)].astype(np.uint64) << np.uint64(56 - 8 * i)
    return out


def refine(rank: np.ndarray, tied: np.ndarray, left: np.ndarray, have: int, shift: int) -> None:
    """Ranks by `have` bytes become ranks by have + shift bytes, in place. tied: whether a suffix shares its rank; left: bytes left to the end of its run."""
    own = np.flatnonzero(tied & (left >= have + shift))
    if not len(own):
        return
    key = rank[own].astype(np.uint64) << np.uint64(32) | rank[own + shift].astype(np.uint64)
    order = np.argsort(key)
    key, own = key[order], own[order]
    place = np.arange(len(own))
    new = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.concatenate(([True], key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32)))
    at = np.maximum.accumulate(np.where(new, place, 0))
    rank[own] = rank[own] + at - np.maximum.accumulate(np.where(group, place, 0))
    size = np.diff(np.concatenate((np.flatnonzero(new), [len(own)])))
    tied[own] = np.repeat(size > 1, size)


def suffix_array(text: np.ndarray, size: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of `size` bytes that lie side by side in text, the first n suffixes of each: where they begin, and their order by the first `length` bytes. Equal ones keep their order in text."""
    end = np.repeat(np.cumsum(size), size)
    left = (end - np.arange(len(text))).astype(np.int32)
    eight = first_eight(text)
    own = np.flatnonzero(left[: len(eight)] >= 8)
    order = own[np.argsort(eight[own])]
    new = np.concatenate(([True], eight[order][1:] != eight[order][:-1]))
    rank, tied = np.zeros(len(text), np.int64), np.zeros(len(text), bool)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    many = np.diff(np.concatenate((np.flatnonzero(new), [len(order)])))
    tied[order] = np.repeat(many > 1, many)
    have = 8
    while have < length:
        shift = min(have, length - have)
        refine(rank, tied, left, have, shift)
        have += shift
    begin = spread(np.cumsum(size) - size, n)
    return begin, np.argsort(rank[begin], kind="stable")


def common_prefixes(text: np.ndarray, begin: np.ndarray, order: np.ndarray, n: np.ndarray, length: int) -> np.ndarray:
    """Kasai: for each suffix, its common prefix with the one before it in the array, up to `length`; 0 for the first.

    The bound from one position to the next needs that the neighbour's successor is a suffix of the array and stands before
    one's own; beyond `length` bytes the array isn't sorted, so after a full match that is known only if it is the neighbour.
    """
    before = np.full(len(begin), -1)
    before[order[1:]] = order[:-1]
    first = np.cumsum(n) - n
    is_last = np.zeros(len(begin), bool)
    is_last[first + n - 1] = True
    eight = first_eight(np.concatenate((text, np.zeros(8, np.uint8))))
    out = np.zeros(len(begin), np.int32)
    have = np.zeros(len(n), np.int32)
    fresh = np.ones(len(n), bool)  # no bound from the position before
    following = np.full(len(n), -2)
    for step in range(int(n.max(initial=0))):
        run = np.flatnonzero(n > step)
        me = first[run] + step
        other = before[me]
        has = other >= 0
        h = np.where(fresh[run] | (have[run] >= length) & (other != following[run]), 0, np.maximum(have[run] - 1, 0))
        i, j = begin[me], begin[np.maximum(other, 0)]
        open_ = np.flatnonzero(has)
        for width in (8, 1):
            todo = open_
            while len(todo := todo[h[todo] + width <= length]):
                x, y = i[todo] + h[todo], j[todo] + h[todo]
                same = eight[x] == eight[y] if width == 8 else text[x] == text[y]
                todo = todo[same]
                h[todo] += width
        h[~has] = 0
        out[me], have[run], following[run] = h, h, other + 1
        fresh[run] = ~has | is_last[np.maximum(other, 0)]
    return out


def eights(text: np.ndarray) -> np.ndarray:
    """first_eight of every position, zeros behind the end."""
    return first_eight(np.concatenate((text, np.zeros(8, np.uint8))))[: len(text)]


def below(mine: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, length: int, or_equal: bool) -> np.ndarray:
    """Whether the `length` bytes at other's positions `there` come before those at mine's positions `at` (or are equal); mine and other as eights."""
    out, open_ = np.full(len(at), or_equal), np.arange(len(at))
    for k in range(0, length, 8):
        k = min(k, length - 8)  # the last word overlaps the one before
        x, y = mine[at[open_] + k], other[there[open_] + k]
        out[open_[x != y]] = (y < x)[x != y]
        open_ = open_[x == y]
        if not len(open_):
            break
    return out


def placed(mine: np.ndarray, at: np.ndarray, other: np.ndarray, array: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the suffixes at `at` belong in another shard's array, by binary search with their bytes, and whether they stand there already."""
    low, high = np.zeros(len(at), np.int64), np.full(len(at), len(array), np.int64)
    while (busy := np.flatnonzero(low < high)).size:
        mid = (low[busy] + high[busy]) // 2
        less = below(mine, at[busy], other, array[mid], length, or_equal=False)
        low[busy[less]] = mid[less] + 1
        high[busy[~less]] = mid[~less]
    there = np.flatnonzero(low < len(array))
    found = np.zeros(len(at), bool)
    at_or_after = array[low[there]]
    found[there] = below(mine, at[there], other, at_or_after, length, or_equal=True) & ~below(mine, at[there], other, at_or_after, length, or_equal=False)
    return low, found


def solve(given: Runs) -> tuple[np.ndarray, np.ndarray]:
    """Which windows occur earlier: at a run's first place those that aren't the first of their string, at its other places all, for the first place stands before them.

    A shard takes whole groups, as strings of different anchors differ; a group above SHARD is cut in document order into several
    shards, and those are merged.
    """
    size = given.n.astype(np.int64) + LENGTH - 1
    order = np.lexsort((given.start, given.key, given.ord, given.h))
    runs = given.take(order, size)
    size, n = size[order], runs.n.astype(np.int64)
    at, first = np.concatenate(([0], np.cumsum(size))), np.concatenate(([0], np.cumsum(n)))
    ends = np.flatnonzero(np.concatenate((runs.h[1:] != runs.h[:-1], [True]))) + 1 if len(n) else np.zeros(0, int)
    picked = np.ones(int(n.sum()), bool)
    known: list[tuple[np.ndarray, np.ndarray]] = []  # eights and array of the shards of this group before
    a = 0
    while a < len(n):
        whole = int(ends[np.searchsorted(ends, a, "right")])  # of the group of a
        fit = max(a + 1, int(np.searchsorted(at, at[a] + SHARD, "right")) - 1)
        z = int(ends[np.searchsorted(ends, fit, "right") - 1]) if fit >= whole else fit
        text = runs.body[at[a] : at[z]]
        begin, sa = suffix_array(text, size[a:z], n[a:z], LENGTH)
        new = common_prefixes(text, begin, sa, n[a:z], LENGTH)[sa] < LENGTH
        new[:1] = True
        heads = np.flatnonzero(new)
        # of equal strings the earliest: places ascend inside a group, and equal strings are of one group
        head = np.minimum.reduceat(sa, heads)
        earlier = np.zeros(len(head), bool)
        own = eights(text)
        for other, array in known:
            todo = np.flatnonzero(~earlier)
            earlier[todo] = placed(own, begin[head[todo]], other, array, LENGTH)[1]
        picked[first[a] + head] = earlier
        if z < whole:  # more of this group to come
            known.append((own, begin[sa[heads[~earlier]]]))
        else:
            known = []
        a = z
    here = np.ones(len(picked), bool)
    here[spread((np.cumsum(given.n.astype(np.int64)) - given.n)[order], n)] = picked
    return here, np.ones(len(picked), bool)


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept for each row of docs (doc_id, text)."""
    rows = keyed(docs)
    ranges, copies = repeated_ranges(rows, BYTES, solve)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, order, least, ranges = b.column("doc_id"), b.column("ord").to_numpy(), b.column("least").to_numpy(), b.column("ranges")
            for a, z, buf, offs in text_chunks(b.column("text")):
                out = []
                for i, own in enumerate(ranges[a:z].to_pylist(), a):
                    text = buf[offs[i - a] : offs[i - a + 1]]
                    gone = np.ones(len(text), bool) if order[i] > least[i] and len(text) >= LENGTH else cover(own, LENGTH, len(text)) if own else np.zeros(len(text), bool)
                    kept = text[~gone].tobytes()
                    out.append((ids[i].as_py(), len(text), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest(), kept))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), OUT, strict=True)], schema=OUT)

    return with_ranges(rows, ranges, copies).mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(bounded(spark).read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: The same by grouping every 100-byte string; bytes as hexadecimal digits.
SQL = r"""
WITH bytes AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS row, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT row, unnest(range(0, len(h) // 2 - 99)) AS i, h FROM bytes WHERE len(h) >= 200),
windows AS (SELECT row, i, substr(h, 2 * i + 1, 200) AS content FROM starts),
later AS (SELECT row, i FROM windows QUALIFY row_number() OVER (PARTITION BY content ORDER BY row, i) > 1),
runs AS (SELECT row, i, i - lag(i) OVER (PARTITION BY row ORDER BY i) AS step FROM later),
numbered AS (SELECT row, i, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY row ORDER BY i) AS span FROM runs),
spans AS (SELECT row, span, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY row, span),
gaps AS (SELECT row, a, z, coalesce(lag(z) OVER (PARTITION BY row ORDER BY a), 0) AS before FROM spans),
cut AS (SELECT row, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN bytes USING (row) GROUP BY row)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM bytes LEFT JOIN cut USING (row)"""
