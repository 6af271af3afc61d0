"""Operator 5: secret scans, with a random forest that removes false positives. DataFrame functions and the JVM's own forest only.

Candidates are runs of at least ``LEAST`` characters of secrets' alphabets inside a word, and shorter ones in certain places (below).
Each is described by its length, its character classes and the transitions between them, how much of it is covered by the common
three-letter pieces of words (a dictionary counted over every row of the documents), the beginnings that makers of tokens
use, whether it looks like a path, a date or a UUID, and the words beside it, by what they say and hashed into ``NEAR`` classes each.
The forest is trained on ``FINDINGS`` labelled findings that rules make from numbers (``FAMILIES``): keys, tokens and passwords in their
usual places, and what is commonly taken for them: commit hashes, checksums, UUIDs, encoded data, addresses, paths, versions, dates,
identifiers, and plain words beside a naming word. Another table of findings (the columns of ``labelled``) may be given.

Everything is computed row by row from a document's own words, so that no group is gathered and nothing is shuffled but the few
thousand training rows and the dictionary's counts (a row per task and different word; long words in parts).

Every run of a word is a candidate, and so is each value of at least ``LEAST`` characters behind an equals sign inside a run. A word
of ``SHORT`` characters or more beside a naming word or an assignment is a candidate too, whatever marks it has, as is the value of a
named assignment inside a word. A word with several runs is cut behind each of them, and a run is described by its own piece and the two pieces or words before that.

Defined cases: null, empty and blank texts have no candidates; a text is read whole; candidates of one word share its place;
repeated rows give their findings each; null doc_ids are kept; an empty table gives no rows; further columns are ignored. Equal
candidates in equal places have equal scores, and one of exactly 0.5 counts as secret; repeated findings weigh as often as they come;
findings of one kind only, or none, give every candidate the share of secrets among them (0.5 without any).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST, FINDINGS, TREES, DEPTH = 16, 6000, 30, 9
#: Bins of a feature for findings up to WHOLE, all of which Spark's forest reads for its thresholds; for more findings their square root.
BINS, WHOLE = 32, 10_000
#: Characters of a candidate beside a naming word or an assignment.
SHORT = 6
CORE = r"[A-Za-z0-9_\-+/=.]{16,}"
#: A run and what stands between it and the run before.
RUN = r"(?s)\G(.*?)(" + CORE + ")"
NAMES = r"(?i)(key|token|secret|passw|pwd|auth|credential|bearer|private)"
#: The value of a named assignment in a word, and a word without quotes and brackets around it.
VALUE = NAMES + r"[A-Za-z0-9_\-]{0,40}[\"']?[=:]+[\"']?([^\s\"',;&{}<>()\[\]]{6,})"
BARE = r"^[\"'(\[{<]*([^\s\"',;&{}<>()\[\]]{6,}?)[.:?]*(?:[\"',;&{}<>()\[\]]|$)"
ASSIGNED = r"[=:][\"'(]*$"
HASHED = r"(?i)(commit|sha-?[0-9]|md5|checksum|digest|etag|uuid|guid|revision|blob|\bid\b)"
#: What the makers of tokens begin them with: fixed values.
ISSUED = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abposr]-|AIza|eyJ[A-Za-z0-9_\-]{8,}\.|npm_|hf_)"
#: Three-letter pieces of the dictionary.
PIECES = 400
#: Words of four letters or more, in parts of at most 40 letters that share two: each three-letter piece lies in one part.
PARTS = r"(?=([a-z]{3,40}))(?:(?<=[a-z])|(?=[a-z]{4}))[a-z]{1,38}"
#: Classes of hashed neighbouring words.
NEAR = 12
FEATURES = ["length", "digits", "upper", "lower", "marks", "changes", "distinct", "covered", "hex", "path", "named", "assigned", "quoted", "others", "uuid", "hashed", "issued", "dated", *(f"{w}_{k}" for w in ("before", "earlier") for k in range(NEAR))]


def dictionary(docs: DataFrame, pieces: int = PIECES) -> list[str]:
    """The commonest three-letter pieces of words of four letters or more, counted wherever they stand in any row of docs; of equally common ones the first by letters."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(PARTS), 1)).alias("w")).groupBy("w").count()
    each = words.select(F.explode(F.expr("transform(sequence(1, length(w) - 2), i -> substring(w, i, 3))")).alias("p"), "count")
    found = each.groupBy("p").agg(F.sum("count").alias("n")).orderBy(F.col("n").desc(), "p").limit(pieces)
    return [r.p for r in found.collect()]


def covering(pieces: list[str]) -> str:
    """A pattern that matches before each place of a piece; by first letters, so that most places fail at once."""
    by: dict[str, list[str]] = {}
    for p in sorted(pieces):
        by.setdefault(p[0], []).append(p[1:])
    return "(?=(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by.items()) + "))" if by else "(?!)"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, place (of the word in the text), candidate, word (the candidate's piece of it), before and earlier (the two pieces or words before that)."""
    words = docs.select("doc_id", F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+").alias("w"))
    quoted = lambda x: "r'" + x.replace("'", "\\x27") + "'"
    near = f"coalesce(get(w, i - 1), '') rlike {quoted(NAMES)} OR coalesce(get(w, i - 2), '') rlike {quoted(NAMES)} OR coalesce(get(w, i - 1), '') rlike {quoted(ASSIGNED)}"
    long = F.expr(f"filter(transform(w, (x, i) -> struct(CAST(i AS BIGINT) AS place, x AS word, length(x) >= {SHORT} AND ({near}) AS beside)), s -> length(s.word) >= {LEAST} OR s.beside OR (length(s.word) >= {SHORT} AND s.word rlike {quoted(VALUE)}))")
    each = words.select("doc_id", "w", F.explode(long).alias("s"))
    before = [F.coalesce(F.expr(f"get(w, CAST(s.place AS INT) - {k})"), F.lit("")) for k in (2, 1)]
    runs = each.select("doc_id", F.col("s.place").alias("place"), F.array(*before).alias("near"), F.col("s.word").alias("whole"), F.regexp_extract_all("s.word", F.lit(VALUE), 2).alias("value"), F.when(F.col("s.beside"), F.regexp_extract("s.word", BARE, 1)).otherwise("").alias("bare"), F.regexp_extract_all("s.word", F.lit(RUN), 1).alias("lead"), F.regexp_extract_all("s.word", F.lit(RUN), 2).alias("run"), F.regexp_replace("s.word", RUN, "").alias("tail"))
    pieces = runs.withColumn("near", F.expr("concat(near, transform(run, (r, i) -> concat(lead[i], r, if(i = size(run) - 1, tail, ''))))"))
    values = f"filter(slice(split(r, '=+(?=[^=])'), 2, length(r)), v -> length(v) >= {LEAST})"
    found = f"flatten(transform(run, (r, i) -> transform(concat(array(r), {values}), c -> struct(c AS candidate, near[i + 2] AS word, near[i + 1] AS before, near[i] AS earlier))))"
    # the others, where no run is the same
    short = "transform(filter(array_distinct(concat(value, array(bare))), v -> v <> '' AND NOT exists(found, f -> f.candidate = v)), v -> struct(v AS candidate, whole AS word, near[1] AS before, near[0] AS earlier))"
    return pieces.withColumn("found", F.expr(found)).select("doc_id", "place", F.expr(f"inline(concat(found, {short}))"))


def described(found: DataFrame, pieces: list[str]) -> DataFrame:
    """found with the columns of FEATURES; pieces: a dictionary."""
    c = F.col("candidate")
    n = F.length(c).cast("double")
    share = lambda pattern: F.regexp_count(c, F.lit(pattern)) / n
    classes = F.translate(F.translate(F.translate(c, "0123456789", "0" * 10), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "A" * 26), "abcdefghijklmnopqrstuvwxyz", "a" * 26)
    flag = lambda x: F.when(x, 1.0).otherwise(0.0)
    near = {w: F.pmod(F.xxhash64(F.regexp_replace(F.lower(w), "[^a-z]", "")), F.lit(NEAR)) for w in ("before", "earlier")}
    return found.withColumns({
        "length": F.least(n, F.lit(200.0)),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "marks": share(r"[_\-+/=.]"),
        "changes": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / n,
        "distinct": F.size(F.array_distinct(F.split(c, ""))) / n,
        "covered": F.regexp_count(F.lower(c), F.lit(covering(pieces))) / F.greatest(n - 2, F.lit(1.0)),
        "hex": flag(F.regexp_like(c, F.lit("^(?=.*[a-f])(?=.*[0-9])[0-9a-f]+$"))),
        "path": flag(F.regexp_like("word", F.lit(r"^\W*(/|\./|[A-Za-z]:|https?:)|/.*/|\.(com|net|org|html?|py|txt|jpe?g|png|json)\b"))),
        "named": flag(F.regexp_like("before", F.lit(NAMES)) | F.regexp_like("earlier", F.lit(NAMES)) | F.regexp_like("word", F.lit(NAMES))),
        "assigned": flag(F.regexp_like("before", F.lit("[=:]$")) | F.regexp_like("word", F.lit("[A-Za-z0-9][\"']?[=:]"))),
        "quoted": flag(F.regexp_like("word", F.lit("[\"']"))),
        "others": share(r"[^A-Za-z0-9_\-+/=.]"),
        "uuid": flag(F.regexp_like(c, F.lit("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"))),
        "hashed": flag(F.regexp_like("before", F.lit(HASHED)) | F.regexp_like("earlier", F.lit(HASHED)) | F.regexp_like("word", F.lit(HASHED))),
        "issued": flag(F.regexp_like(c, F.lit(ISSUED))),
        "dated": flag(F.regexp_like(c, F.lit(r"(19|20)\d\d[-_./]?[01]\d[-_./]?[0-3]\d|^v?\d+\.\d+\.\d+"))),
        **{f"{w}_{k}": flag(near[w] == k) for w in near for k in range(NEAR)},
    })


#: Families of findings: name, whether secret, SQL for the candidate, and where it stands: beside a naming word (n), alone in prose (b),
#: beside a word for hashes (h), beside another name (o). x, h and m are hashes of the finding's number in hex, a(k) 64 letters and
#: digits, d(k) ten digits, w(k) a piece of a word.
FAMILIES = [
    ("hex", 1, "x", "n"),
    ("base64", 1, "replace(base64(unhex(h)), '=', '')", "n"),
    ("aws", 1, "concat('AKIA', upper(substr(a(1), 1, 16)))", "nb"),
    ("github", 1, "concat('ghp_', substr(a(1), 1, 36))", "nb"),
    ("slack", 1, "concat('xoxb-', d(1), '-', d(2), '-', substr(a(1), 1, 24))", "nb"),
    ("stripe", 1, "concat('sk_live_', substr(a(1), 1, 24))", "nb"),
    ("jwt", 1, "concat('eyJ', substr(a(1), 1, 33), '.eyJ', substr(a(2), 1, 40), '.', substr(a(3), 1, 43))", "nb"),
    ("random", 1, "substr(a(1), 1, 20 + id % 20)", "n"),
    ("weak password", 1, "concat(w(1), substr(d(1), 1, 1), CASE id % 4 WHEN 0 THEN substr(x, 1, 4) WHEN 1 THEN concat(w(2), substr(d(2), 1, 1)) WHEN 2 THEN substr(d(2), 1, 3) ELSE '' END)", "n"),
    ("password", 1, "concat(initcap(w(1)), element_at(array('!', '@', '#', '$', ':'), CAST(id % 5 + 1 AS INT)), substr(h, 1, 6), element_at(array('!', '@', '#', ''), CAST(id % 4 + 1 AS INT)))", "n"),
    ("card", 0, "concat('4', d(1), substr(d(2), 1, 5))", "b"),
    ("path", 0, "concat('/home/', w(1), '/', w(2), '.txt')", "b"),
    ("url", 0, "concat(CASE WHEN id % 2 = 0 THEN '//' ELSE '' END, 'www.', w(1), w(3), '.example.com/', w(4))", "b"),
    ("query", 0, "concat('//', w(1), '.example.org/', w(2), '/', w(3), '.html')", "bo"),
    ("long word", 0, "concat(w(1), w(2), w(3), w(4))", "bo"),
    ("identifier", 0, "concat(initcap(w(1)), initcap(w(2)), initcap(w(3)), '_', id)", "bo"),
    ("snake", 0, "concat_ws('_', w(1), w(2), w(3), w(4))", "bo"),
    ("capitals", 0, "concat(upper(concat(w(1), w(2), w(3))), CASE WHEN id % 4 = 1 THEN '.' ELSE '' END)", "b"),
    ("slug", 0, "concat_ws('-', w(1), w(2), w(3), substr(d(1), 1, 4))", "b"),
    ("uuid", 0, "concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21, 12))", "bho"),
    ("commit", 0, "x", "bh"),
    ("sha256", 0, "h", "bh"),
    ("md5", 0, "m", "bh"),
    ("encoded data", 0, "base64(unhex(concat(h, x)))", "b"),
    ("version", 0, "concat('v', id % 9, '.', id % 13, '.', id % 7, '-', w(1), '.', substr(d(1), 1, 3))", "bo"),
    ("time", 0, "concat('20', 10 + id % 15, '-0', 1 + id % 9, '-1', id % 10, 'T0', id % 9, ':12:', 10 + id % 50, '.', substr(d(1), 1, 3), 'Z')", "bo"),
    ("picture", 0, "concat('IMG_20', 10 + id % 15, '0', 1 + id % 9, '1', id % 10, '_', substr(d(1), 1, 6), '.jpg')", "b"),
    ("setting", 0, "concat_ws('_', upper(w(1)), upper(w(2)), 'MAX')", "o"),
    ("named word", 0, "CASE id % 3 WHEN 0 THEN concat(w(1), w(2)) WHEN 1 THEN concat_ws('_', w(1), w(2)) ELSE w(1) END", "n"),
    ("named path", 0, "concat('/etc/', w(1), '/', w(2))", "n"),
]
WORDS = "thing ration ently houses keit mente tions ander ingly ested water letter number people garden winter market silver".split()
SECRET_NAMES = "token api_key secret password auth pwd access_key credentials private_key bearer".split()
OTHER_NAMES = "note name see title path version level next".split()
HASH_NAMES = "commit sha256 md5 checksum uuid revision digest etag".split()
PROSE = "the and of see with number call und le que is was der in to".split()


def labelled(spark: SparkSession, n: int = FINDINGS, start: int = 0) -> DataFrame:
    """candidate, word, before, earlier, label, family: findings made by rule from the n numbers from start on, as many of each family."""
    array = lambda xs: "array(" + ", ".join(f"'{x}'" for x in xs) + ")"
    pick = lambda xs, k: f"element_at({array(xs)}, CAST(pmod(xxhash64(id, {k}), {len(xs)}) + 1 AS INT))"

    def sql(rule: str) -> str:
        for k in range(1, 5):
            rule = rule.replace(f"a({k})", f"translate(substr(base64(unhex(sha2(concat(id, ':{k}'), 512))), 1, 64), '+/=', 'xyz')")
            rule = rule.replace(f"d({k})", f"lpad(CAST(pmod(xxhash64(id, {100 + k}), 10000000000) AS STRING), 10, '7')").replace(f"w({k})", pick(WORDS, k))
        return rule

    rows = spark.range(start, start + n).selectExpr("id", "sha1(CAST(id AS STRING)) AS x", "sha2(CAST(id AS STRING), 256) AS h", "md5(CAST(id AS STRING)) AS m")
    case = lambda of: "CASE id % " + str(len(FAMILIES)) + "".join(f" WHEN {i} THEN {of(f)}" for i, f in enumerate(FAMILIES)) + " END"
    letters = case(lambda f: f"substr('{f[3]}', CAST(pmod(xxhash64(id, 7), {len(f[3])}) + 1 AS INT), 1)")
    rows = rows.selectExpr(f"{case(lambda f: sql(f[2]))} AS c", f"{case(lambda f: str(f[1]))} AS label", f"{case(lambda f: repr(f[0]))} AS family", f"{letters} AS place", "pmod(xxhash64(id, 8), 6) AS form", f"{pick(SECRET_NAMES, 9)} AS n1", f"{pick(OTHER_NAMES, 10)} AS n2", f"{pick(HASH_NAMES, 11)} AS n3", f"{pick(PROSE, 12)} AS p1", f"{pick(PROSE, 13)} AS p2")
    rows = rows.withColumn("name", F.when(F.col("place") == "n", F.col("n1")).when(F.col("place") == "o", F.col("n2")))
    c, form, alone = F.col("c"), F.when(F.col("name").isNotNull(), F.col("form")), F.when(F.col("c").startswith("//"), F.concat(F.lit("https:"), "c")).otherwise(F.col("c"))
    q = F.lit('"')
    word = F.when(form <= 1, F.concat(q, c, q)).when(form == 2, F.concat("name", F.lit("="), c)).when(form == 3, F.concat(F.lit('{"'), "name", F.lit('":"'), c, F.lit('"}'))).otherwise(alone)
    before = F.when(form <= 1, F.lit("=")).when(form == 4, F.concat("name", F.lit(":"))).when(form == 5, F.lit("=")).when(F.col("place") == "h", F.col("n3")).otherwise(F.col("p1"))
    return rows.select(c.alias("candidate"), "label", word.alias("word"), before.alias("before"), F.when(form.isin(0, 1, 5), F.col("name")).otherwise(F.col("p2")).alias("earlier"), "family")


@dataclass
class Scanner:
    """A forest and the dictionary it was trained with; without findings of both kinds there is no forest, and every score is the share of secrets among them (0.5 without any)."""

    forest: RandomForestClassificationModel | None
    pieces: list[str]
    share: float = 0.5

    def scores(self, found: DataFrame) -> DataFrame:
        """found (candidate, word, before, earlier, ...) with score."""
        if self.forest is None:
            return found.withColumn("score", F.lit(self.share))
        given = found.withColumn("_row", F.struct(*found.columns))
        out = self.forest.transform(_vectors(given, self.pieces)).select("_row.*", F.round(vector_to_array("probability")[1], 6).alias("score"))
        return out


def _vectors(rows: DataFrame, pieces: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(described(rows, pieces))


def train(findings: DataFrame, pieces: list[str]) -> Scanner:
    """A forest from labelled findings (candidate, word, before, earlier, label); those without a label or candidate are ignored."""
    known = findings.where("label is not null and candidate is not null").fillna("", ["word", "before", "earlier"])
    n, secrets = known.agg(F.count(F.lit(1)), F.sum(F.col("label").cast("long"))).first()
    if not n or secrets in (0, n):
        return Scanner(None, pieces, secrets / n if n else 0.5)
    # above max(bins ** 2, WHOLE) rows the thresholds would come from a sample
    bins = BINS if n <= WHOLE else math.isqrt(n - 1) + 1
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, maxBins=bins, featureSubsetStrategy="0.4", seed=3)
    return Scanner(forest.fit(_vectors(known, pieces).select("features", F.col("label").cast("double").alias("label"))), pieces)


def scanned(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """doc_id, place, candidate, score (of being a secret) for every candidate of docs (doc_id, text)."""
    return scanner.scores(candidates(docs)).select("doc_id", "place", "candidate", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scanned(docs, train(labelled(spark), dictionary(docs)))
    return found.select("doc_id", "place", F.sha2("candidate", 256).alias("candidate_sha256"), "score", (F.col("score") >= 0.5).cast("int").alias("secret"))
