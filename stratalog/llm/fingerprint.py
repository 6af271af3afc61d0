"""Operator 3: document fingerprints from prefix polynomial hashes.

``Text`` holds the prefix sums of a text's code points times the powers of a base, modulo two primes below 2**31, in 8 bytes a code
point; they are made and read in blocks. Any two spans
are compared through four lookups, the longest common extension of two positions is found by binary search, and the
fingerprint samples the hashes of all spans of ``SPAN`` code points: the least hash in each of ``SLOTS`` classes.

A fingerprint is text: the length, the hash of the whole text, and 16 bits for each slot (``....`` where no span fell). The
likeness of two fingerprints is 1 if they are equal; else, with J the share of equal slots among those filled in either, it is
2J / (1 + J), an estimate of the share of spans that the texts have in common.

``with_next`` pairs each document with the next one by doc_id without a global sort in one task: the ids' quantiles cut the
table into ranges, each range is sorted in one task, and the first document of each range is sent once more, as a guest, to
the end of the range before. What reaches the driver is one id for each range. Texts are shuffled once.

Defined cases: a null text is empty; a null doc_id comes before all others; rows with one doc_id are ordered by text; the last
document's next is the first, and a lone document is its own next; an empty table gives no rows; two empty texts have likeness
1, an empty and another text 0; texts below SPAN code points are one span; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernel import U, mix
from .shared import batch, bounded, partitions

PRIMES, BASES = (2147483647, 2147483629), (911382323, 972663749)
SPAN, SLOTS = 12, 64
#: Rows turned into Python strings at once.
SLICE = 256
OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix_edited", pa.int64()), ("common_prefix_next", pa.int64())])
#: Code points handled at once, beside the 8 bytes each that a text's sums take.
BLOCK = 1 << 18
_tables: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, p: int, start: int, n: int) -> np.ndarray:
    """base**i modulo p for the n <= BLOCK exponents from start on."""
    if (base, p) not in _tables or len(_tables[base, p]) < n:
        out = np.ones(1, U)
        while len(out) < max(n, BLOCK):
            out = np.concatenate((out, out * U(pow(base, len(out), p)) % U(p)))
        _tables[base, p] = out
    return _tables[base, p][:n] * U(pow(base, start, p)) % U(p)


class Text:
    """A text's prefix arrays, one for each prime. codes: its code points."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        self.sums = [np.zeros(self.n + 1, np.uint32) for _ in PRIMES]
        for sums, b, p in zip(self.sums, BASES, PRIMES, strict=True):
            for i in range(0, self.n, BLOCK):
                own = codes[i : i + BLOCK].astype(U) + U(1)
                sums[i + 1 : i + 1 + len(own)] = (np.cumsum(own * _powers(b, p, i, len(own)) % U(p)) + U(sums[i])) % U(p)
        self.print = self._print()

    def span(self, i: int, j: int) -> int:
        """Hash of the code points from i to j, as 62 bits."""
        h = [(int(s[j]) - int(s[i])) * pow(b, -i, p) % p for s, b, p in zip(self.sums, BASES, PRIMES, strict=True)]
        return h[0] << 31 | h[1]

    def common(self, i: int, other: "Text", j: int) -> int:
        """Length of the longest common extension of position i here and j there."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, i + mid) == other.span(j, j + mid):
                low = mid
            else:
                high = mid - 1
        return low

    def _print(self) -> str:
        slots = np.full(SLOTS, 0xFFFFFFFFFFFFFFFF, U)
        width, p, s = min(SPAN, self.n), PRIMES[0], self.sums[0]
        back = pow(BASES[0], -1, p)
        for i in range(0, self.n - width + 1 if self.n else 0, BLOCK):
            j = min(i + BLOCK, self.n - width + 1)
            spans = (s[i + width : j + width].astype(U) + U(p) - s[i:j]) % U(p) * _powers(back, p, i, j - i) % U(p)
            spans = mix(spans + U(width << 32))
            np.minimum.at(slots, (spans >> U(58)).astype(np.intp), spans)
        own = "".join("...." if x == 0xFFFFFFFFFFFFFFFF else f"{(x >> 8) & 0xFFFF:04x}" for x in slots.tolist())
        return f"{self.n:x}-{self.span(0, self.n):016x}-{own}"


def text_of(s: str) -> Text:
    return Text(np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32))


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = (np.frombuffer(s.rpartition("-")[2].encode(), "S4") for s in (a, b))
    filled = int(((x != b"....") | (y != b"....")).sum())
    j = int(((x == y) & (x != b"....")).sum()) / filled if filled else 0.0
    return 2 * j / (1 + j)


def with_next(docs: DataFrame, fold, schema: str, ranges: int | None = None) -> DataFrame:
    """fold(pairs) over ((doc_id, text), (next doc_id, next text)) of docs (doc_id, text); it yields record batches."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(-(2**63))).alias("key"))
    n = ranges or 2 * partitions(spark)
    cuts = np.array(sorted({int(x) for x in (rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else [])}), np.int64)

    def of(keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, keys, "right").astype(np.int64)

    def ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            at = of(keys)
            order = np.unique(at)
            yield pa.RecordBatch.from_arrays([pa.array(order), pa.array([keys[at == x].min() for x in order], pa.int64())], ["part", "key"])

    lowest = rows.select("key").mapInArrow(ranged, "part long, key long").groupBy("part").agg(F.min("key").alias("key")).collect()
    lowest = sorted((r.part, r.key) for r in lowest)
    before = {key: lowest[i - 1][0] for i, (_, key) in enumerate(lowest)}
    firsts = np.array(sorted(before), np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("key").to_numpy()
            names = ["part", "guest", *b.schema.names]
            yield pa.RecordBatch.from_arrays([pa.array(of(keys)), pa.array(np.zeros(len(keys), bool)), *b.columns], names)
            if len(guests := np.flatnonzero(np.isin(keys, firsts))):
                g = b.take(pa.array(guests))
                yield pa.RecordBatch.from_arrays([pa.array([before[k] for k in g.column("key").to_pylist()], pa.int64()), pa.array(np.ones(len(guests), bool)), *g.columns], names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
        part, last = None, None
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                s = b.slice(at, SLICE)
                for p, guest, doc_id, text in zip(*(s.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text")), strict=True):
                    if p != part:
                        part, last = p, None
                    row = (doc_id, text)
                    if last is not None:
                        yield last, row
                    last = None if guest else row

    routed = rows.mapInArrow(route, "part long, guest boolean, doc_id long, text string, key long").repartition(max(1, min(n, len(lowest))), "part").sortWithinPartitions("part", "guest", "key", "text")
    return routed.mapInArrow(lambda batches: fold(pairs(batches)), schema)


def fingerprints(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The columns of OUT for docs (doc_id, text)."""

    def fold(pairs: Iterator[tuple[tuple, tuple]]) -> Iterator[pa.RecordBatch]:
        rows, known = [], (None, None)
        for one, following in pairs:
            (doc_id, text), (_, after) = one, following
            own = known[1] if known[0] is one else text_of(text)
            n = len(text)
            m = n // 4
            edited = text[: n - m] + after[:m]
            new, then = text_of(edited), text_of(after)
            known = (following, then)
            rows.append((doc_id, n, hashlib.sha256(edited.encode()).hexdigest(), own.print, new.print, likeness(own.print, new.print), likeness(own.print, then.print), own.common(0, new, 0), own.common(0, then, 0)))
            if len(rows) == 2048:
                yield batch(OUT, list(zip(*rows, strict=True)))
                rows = []
        if rows:
            yield batch(OUT, list(zip(*rows, strict=True)))

    return with_next(docs, fold, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix_edited long, common_prefix_next long", ranges)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(bounded(spark).read.parquet(f"{sf_dir}/documents.parquet"))
