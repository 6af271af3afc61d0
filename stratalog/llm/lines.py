"""Operator 8: removal of repeated runs of lines, by winnowing over line hashes. DataFrame functions only.

A line is what stands between line feeds, without spaces, tabs and carriage returns at its ends; blank lines are skipped over and
always kept. A run of ``window`` lines or more that stands earlier too (in a document before, or further up) is deleted, as is a line of
``alone`` bytes or more that does, among whatever neighbours.

Fingerprints. Of each ``window`` lines side by side the one with the least hash, the first of several, is a fingerprint. So two places
that share a run of ``window`` lines share a fingerprint, at the same line of it; a text has about 2 / (window + 1) of them a line.
Positions. Each fingerprint keeps its position and the window - 1 line hashes on either side. The earliest position of each value,
found by an aggregate that combines before the shuffle, is joined to all later ones: one row a position, no pairs among them.
Extension. From there the match is extended over equal lines to the left and to the right, and makes a run where it comes to
``window`` lines. As the run's next fingerprint is no further off than the context reaches, longer runs are covered by their fingerprints together.
The rest. A window that chose a fingerprint but lies beyond its extension may still have stood at a place in between, under other
neighbours than those of the earliest. Those windows alone are grouped by a hash of their lines, and the later ones go. What
equals a window of the earliest position has been found by extension, so that nothing is missed, whatever the context.

Documents are ordered by doc_id, null before all, then by a hash of the text. What is shuffled are hashes of lines; the texts move once,
to meet the lines that go. Values with very many positions are split over tasks (``shared.join_spread``), and what is gathered by document is
bounded by its own lines.

Defined cases: a null text has no lines and an empty one has one blank line, both are kept as the empty text; rows equal in
doc_id and text are neither before the other and lose the same lines; documents of fewer than ``window`` lines lose none but lines
that are runs by themselves; a document all of whose lines go keeps the empty text; an empty table gives no rows; further columns
are ignored. Line hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import join_spread, through_table

WINDOW = 2
#: Bytes, without blanks at the ends, from which a line is a run by itself.
ALONE = 32
#: What is trimmed.
BLANKS = " \t\r"
PLACE = ["ord", "key", "at"]


def hashed(docs: DataFrame, alone: int | None = ALONE) -> DataFrame:
    """ord, key, line array<long> and long array<boolean>: the hashes of the lines that aren't blank, and whether they are runs by themselves."""
    own = (lambda x: F.lit(False)) if alone is None else (lambda x: F.octet_length(x) >= alone)
    full = F.filter(F.transform(F.split("text", "\n", -1), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != "")
    rows = docs.select("ord", "key", F.transform(full, lambda x: F.struct(F.xxhash64(x).alias("line"), own(x).alias("long"))).alias("full")).where(F.size("full") > 0)
    return rows.select("ord", "key", F.col("full.line").alias("line"), F.col("full.long").alias("long"))


def prints(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """ord, key, at, print, left, right, chosen_by for each fingerprint: its line's number and hash, the hashes before (nearest first) and after, and the first lines of the windows that chose it."""
    least = f"i + CAST(array_position(slice(line, i + 1, {window}), array_min(slice(line, i + 1, {window}))) AS INT) - 1"
    chosen = f"transform(filter(sequence(0, size(line) - 1), i -> i + {window} <= size(line)), i -> {least})"
    near = lambda sign: "array(" + ", ".join(f"get(line, q {sign} {d})" for d in range(1, window)) + ")" if window > 1 else "CAST(array() AS array<bigint>)"
    by = f"filter(sequence(greatest(0, q - {window - 1}), least(q, size(chosen) - 1)), i -> chosen[i] = q)"
    each = f"transform(array_distinct(chosen), q -> struct(q AS at, line[q] AS print, {near('-')} AS left, {near('+')} AS right, {by} AS chosen_by))"
    return rows.select("ord", "key", "line", F.expr(chosen).alias("chosen")).select("ord", "key", F.expr(f"inline({each})"))


def _equal(a: str, b: str, n: int) -> Column:
    """How many of n elements from the first on are equal."""
    out = F.lit(0)
    for k in reversed(range(n)):
        out = F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), out + 1).otherwise(0)
    return out


def _later(rows: DataFrame, by: str, carried: list[str], name: str) -> DataFrame:
    """rows (ord, key, at, by, ...) that aren't the earliest of their value of by, with the carried columns of that as first."""
    first = rows.groupBy(by).agg(F.min(F.struct(*PLACE, *carried)).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    found = join_spread(rows, through_table(first, name), [by], "n", PLACE)
    return found.where(F.struct(*PLACE) > F.struct(*(F.col(f"first.{c}") for c in PLACE)))


def repeated_runs(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """ord, key, start, size: runs and lines of rows (ord, key, line, long) that stand earlier too."""
    around = window - 1
    found = _later(prints(rows, window), "print", ["left", "right"], "line-prints")
    found = found.withColumns({"a": F.col("at") - _equal("left", "first.left", around), "z": F.col("at") + 1 + _equal("right", "first.right", around)})
    # read twice: extended runs, and windows beyond them
    context = F.concat(F.reverse("left"), F.array("print"), "right")
    found = through_table(found.select("ord", "key", "at", "a", "z", context.alias("context"), F.filter("chosen_by", lambda i: (i < F.col("a")) | (i + window > F.col("z"))).alias("open")), "line-matches")
    extended = found.where(F.col("z") - F.col("a") >= window).select("ord", "key", F.col("a").alias("start"), (F.col("z") - F.col("a")).alias("size"))
    rest = found.select("ord", "key", F.explode(F.transform("open", lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("context", i - F.col("at") + window, window)).alias("content")))).alias("w"))
    rest = _later(rest.select("ord", "key", "w.at", "w.content"), "content", [], "line-rest").select("ord", "key", F.col("at").alias("start"), F.lit(window).alias("size"))
    alone = rows.select("ord", "key", F.posexplode(F.arrays_zip("line", "long")).alias("at", "x")).where("x.long").select("ord", "key", "at", F.col("x.line").alias("line"))
    alone = _later(alone, "line", [], "line-alone").select("ord", "key", F.col("at").alias("start"), F.lit(1).alias("size"))
    return extended.union(rest).union(alone)


def with_kept_lines(docs: DataFrame, keep: list[str] = ("doc_id",), alone: int | None = ALONE, window: int = WINDOW) -> DataFrame:
    """keep, n_lines, n_removed and kept (text) for each row of docs (doc_id, text). alone: bytes from which a line is a run by itself (None: never)."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(*keep, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_ord"), F.xxhash64(text).alias("_key"), text.alias("_text"))
    lines = through_table(hashed(rows.select(F.col("_ord").alias("ord"), F.col("_key").alias("key"), F.col("_text").alias("text")), alone), "lines")
    runs = repeated_runs(lines, window).groupBy(F.col("ord").alias("_ord"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "size")).alias("_runs"))
    # step by step inside one generator, so that each step is evaluated once a row, whatever is asked of the result
    out = F.transform(F.array(F.split("_text", "\n", -1)), lambda ls: F.struct(ls.alias("lines"), F.filter(F.sequence(F.lit(0), F.size(ls) - 1), lambda i: F.trim(F.get(ls, i), F.lit(BLANKS)) != "").alias("full")))
    # runs number the lines that aren't blank
    out = F.transform(out, lambda x: F.struct(x.lines.alias("lines"), F.array_distinct(F.flatten(F.transform("_runs", lambda s: F.slice(x.full, s["start"] + 1, s["size"])))).alias("gone")))
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x.lines) - 1), x.gone), lambda i: F.get(x.lines, i))
    kept = lambda x: F.when(x.gone.isNull(), F.col("_text")).otherwise(F.array_join(left(x), "\n"))
    out = F.transform(out, lambda x: F.struct(F.size(x.lines).cast("long").alias("n_lines"), F.coalesce(F.size(x.gone), F.lit(0)).cast("long").alias("n_removed"), kept(x).alias("kept")))
    return rows.join(runs, ["_ord", "_key"], "left").select(*keep, F.inline_outer(out))


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_kept_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def lines_sql(docs: str) -> str:
    """CTEs that end in lined(doc_id, n_lines, n_removed, kept): the rule, in windows of two lines and lines alone, without fingerprints."""
    line = "trim(raw, ' ' || chr(9) || chr(13))"
    return f"""
split_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM {docs}),
each_ AS (SELECT doc_id, unnest(ls) AS raw, generate_subscripts(ls, 1) AS pos FROM split_),
full_ AS (SELECT doc_id, pos, {line} AS line, lead(pos) OVER w AS pos2, lead({line}) OVER w AS line2 FROM each_ WHERE {line} <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
runs_ AS (SELECT *, pos2 IS NOT NULL AND row_number() OVER (PARTITION BY line, line2 ORDER BY doc_id, pos) > 1 AS pair_again,
  strlen(line) >= {ALONE} AND row_number() OVER (PARTITION BY line ORDER BY doc_id, pos) > 1 AS line_again FROM full_),
gone_ AS (SELECT doc_id, pos FROM runs_ WHERE pair_again OR line_again UNION SELECT doc_id, pos2 FROM runs_ WHERE pair_again),
lined AS (SELECT e.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, coalesce(string_agg(e.raw, chr(10) ORDER BY e.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM each_ e LEFT JOIN gone_ g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
"""


SQL = f"WITH {lines_sql('documents')} SELECT doc_id, n_lines, n_removed, sha256(kept) AS kept_sha256 FROM lined"
