"""Operators 2, 3, 7, 8, 9 and 10 on awkward rows, against plain versions of their rules."""

import gzip
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalog.llm import contamination, fingerprint, lines, mixing, quality, warc
from stratalog.llm.kernel import text_chunks, word_hashes

from .conftest import prose

# 3: fingerprints


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_fingerprints(docs, ranges):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    for (doc_id, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        prefix = next((i for i, (a, b) in enumerate(zip(t, edited, strict=False)) if a != b), min(len(t), len(edited)))
        want[(doc_id, len(t), hashlib.sha256(edited.encode()).hexdigest(), prefix)] += 1
    got = fingerprint.fingerprints(docs, ranges).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.common_prefix_edited) for r in got) == want
    by_text = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert len(by_text) == len({t for _, t in rows})


def plain_print(t):
    """The fingerprint by its definition: sums of powers, one span at a time, in Python's integers."""
    codes = [ord(c) + 1 for c in t]

    def span(k, i, j):
        p, b = fingerprint.PRIMES[k], fingerprint.BASES[k]
        return sum(c * pow(b, n, p) for n, c in enumerate(codes[i:j])) % p

    def scramble(x):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> shift)) * times % 2**64
        return x

    width, slots = min(12, len(t)), {}
    for i in range(len(t) - width + 1 if t else 0):
        x = scramble(span(0, i, i + width) + (width << 32))
        slots[x >> 58] = min(x, slots.get(x >> 58, x))
    own = "".join(f"{(slots[k] >> 8) & 0xFFFF:04x}" if k in slots else "...." for k in range(64))
    return f"{len(t):x}-{span(0, 0, len(t)) << 31 | span(1, 0, len(t)):016x}-{own}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([s[-256:][i : i + 4] for i in range(0, 256, 4)] for s in (a, b))
    filled = [(p, q) for p, q in zip(x, y, strict=True) if p != "...." or q != "...."]
    j = sum(p == q for p, q in filled) / len(filled) if filled else 0.0
    return 2 * j / (1 + j)


def test_fingerprints_against_their_definition(docs, monkeypatch):
    monkeypatch.setattr(fingerprint, "BLOCK", 100)  # so that texts have several
    short = docs.where("length(coalesce(text, '')) < 2500")
    rows = sorted(((r.doc_id, r.text or "") for r in short.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    want = Counter()
    for (doc_id, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        m = len(t) // 4
        one, two, three = (plain_print(x) for x in (t, t[: len(t) - m] + after[:m], after))
        want[(doc_id, one, two, plain_likeness(one, two), plain_likeness(one, three))] += 1
    got = fingerprint.fingerprints(short).select("doc_id", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()
    assert Counter(map(tuple, got)) == want


def test_likeness_follows_the_edit():
    rng = random.Random(1)
    a, b = prose(rng, 400), prose(rng, 400)
    edited = a[: len(a) * 3 // 4] + b[: len(a) // 4]
    one, two, other = (fingerprint.text_of(x) for x in (a, edited, b))
    assert fingerprint.likeness(one.print, one.print) == 1 and fingerprint.likeness(one.print, two.print) > 0.5 > 0.35 > fingerprint.likeness(one.print, other.print)
    assert one.span(5, 90) == two.span(5, 90) and one.span(0, 10) != one.span(1, 11)
    assert fingerprint.text_of("abcabcX").common(0, fingerprint.text_of("abcabcX"), 3) == 3


def test_fingerprints_of_one_and_none(spark, none):
    assert fingerprint.fingerprints(none).count() == 0
    r = fingerprint.fingerprints(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert r.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


# 7: mixing


def test_targets_match_a_plain_resharing(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 23):
        sizes = {f"s{i:02}": rng.choice([0, 10, 1000, 50_000, 9_000_000]) for i in range(n - 1)} | {None: 500}
        order = sorted((k for k in sizes if k is not None)) + [None]
        weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
        left, open_, want = 1.5 * sum(sizes.values()), set(order), {}
        while True:
            share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
            over = {k for k in open_ if share[k] > 2 * sizes[k]}
            if not over:
                want |= share
                break
            for k in over:
                want[k] = 2.0 * sizes[k]
                left -= want[k]
            open_ -= over
            if not open_:
                break
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(want)


def test_mix(docs):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count()
    words = Counter()
    for r in docs.collect():
        words[(r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or "")))] += 1
    assert Counter((r.doc_id, r.source, r.size) for r in got) == words
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    for own in by.values():
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) + 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mixed(docs.repartition(2)).collect()))


def test_equal_rows_share_their_copies(spark):
    """As many rows come out as the mix takes, whatever rows agree: three equal ones of which 1, 2 and 1 copies are taken come four times."""
    rows = [(1, "a b c", "x", 7)] * 3 + [(1, "a b c", "x", 8)] * 2 + [(2, "d e", "x", 1), (None, None, None, 2), (None, None, None, 2), (None, None, "", 2), (3, "f g h i", "", 3), (4, "j k", None, 4)] + [(5, "l m n", "y", i) for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, own int")
    want = Counter()
    for r in mixing.mixed(docs).collect():
        want[(r.doc_id, r.key, r.source)] += r.copies
    got = mixing.copies_of(docs).withColumn("key", F.xxhash64("text")).collect()
    assert Counter((r.doc_id, r.key, r.source) for r in got) == +want and sum(want.values()) > len(rows)
    given = Counter(rows)
    assert all(n <= 2 * given[k] for k, n in Counter((r.doc_id, r.text, r.source, r.own) for r in got).items())
    assert {r["copy"] for r in got} == {1, 2}


def test_small_sources_come_near_their_targets(spark):
    rng = random.Random(14)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 12)), f"s{i % 7}") for i in range(350)]
    by = defaultdict(list)
    for r in mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        by[r.source].append(r)
    miss = [abs(sum(r.taken for r in own) - own[0].target) / own[0].target for own in by.values()]
    assert sum(miss) / len(miss) < 0.01 and max(miss) < 0.03


def test_mix_of_none(none):
    assert mixing.mixed(none).count() == 0 and mixing.copies_of(none).count() == 0


# 8: lines


def plain_kept(rows, window, alone):
    """The runs rule, said directly: lines, lines removed and the text kept for each of rows (doc_id, text, hash), in their order."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
    first, out = {}, [None] * len(rows)
    for row in order:
        doc_id, text, k = rows[row]
        ls = (text or "").split("\n")
        full = [i for i, x in enumerate(ls) if x.strip(" \t\r")]
        own = [ls[i].strip(" \t\r") for i in full]
        gone = set()
        for n in {1, window}:
            for a in range(len(own) - n + 1):
                if n == 1 < window and len(own[a].encode()) < (alone or 1 << 60):
                    continue
                who = first.setdefault(tuple(own[a : a + n]) if n > 1 or window == 1 else own[a], (doc_id, k, a))
                if who[:2] != (doc_id, k) or who[2] < a:
                    gone |= set(full[a : a + n])
        out[row] = len(ls), len(gone), "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def plain_lines(rows, window, alone):
    return Counter((r[0], *kept) for r, kept in zip(rows, plain_kept(rows, window, alone), strict=True))


@pytest.mark.parametrize(("window", "alone"), [(2, 32), (2, None), (3, None), (4, 40)])
def test_lines(spark, docs, window, alone):
    """Runs under other neighbours than at their earliest place, in many short documents of few different lines, beside the awkward ones."""
    rng = random.Random(window)
    pool = [prose(rng, rng.randint(1, 7)) for _ in range(9)]
    few = [(1000 + i, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\r"]) for _ in range(rng.randint(1, 12)))) for i in range(150)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(few, "doc_id long, text string"))
    keyed = both.withColumn("k", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    got = Counter(tuple(r) for r in lines.with_kept_lines(both, alone=alone, window=window).collect())
    assert got == plain_lines([tuple(r) for r in keyed], window, alone) and sum(x[2] for x in got) >= 4


def test_hot_lines_are_split(spark, monkeypatch):
    from stratalog.llm import shared

    monkeypatch.setattr(shared, "SHARES", 8)
    rows = [(i, f"line {i}\nthe commonest of all lines in this table\nshort\nshort\nother {i % 3}") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = df.withColumn("k", F.xxhash64("text")).collect()
    assert Counter(tuple(r) for r in lines.with_kept_lines(df).collect()) == plain_lines([tuple(r) for r in keyed], 2, 32)


@pytest.mark.parametrize("window", [2, 4, 8])
def test_winnowing(spark, window):
    """Each window has the fingerprint that is its least line, the first of several; there are about 2 / (window + 1) a line, and no more positions are joined."""
    rng = random.Random(window)
    texts = ["\n".join(f"line {rng.randrange(10**9)}" for _ in range(300)) for _ in range(4)] + ["q\nq\nq\nr", "one"]
    rows = lines.hashed(spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "ord long, key long, text string"))
    want = {}
    for r in rows.collect():
        for i in range(len(r.line) - window + 1):
            q = min(range(i, i + window), key=lambda k, own=r.line: (own[k], k))
            want.setdefault((r.ord, q), []).append(i)
    got = {(r.ord, r["at"]): r for r in lines.prints(rows, window).collect()}
    assert {k: r.chosen_by for k, r in got.items()} == want
    assert abs(len([k for k in got if k[0] < 4]) / 1200 - 2 / (window + 1)) < 0.06
    by = {r.ord: r.line for r in rows.collect()}
    for (o, q), r in got.items():
        line = by[o]
        assert r.print == line[q] and r.left == [line[q - d] if q >= d else None for d in range(1, window)]
        assert r.right == [line[q + d] if q + d < len(line) else None for d in range(1, window)]


def test_lines_of_none(none):
    assert lines.with_kept_lines(none).count() == 0


# 9: contamination


def test_planted_passages(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, 35)) for i in range(12)] + [(90, None), (91, ""), (92, "too short"), (3, prose(rng, 30)), (None, prose(rng, 40))]
    docs, want = [], set()
    for i in range(12):
        docs.append((i, prose(rng, 100)))
    for i, t in items[:12]:
        words = t.split(" ")
        for k in range(0, len(words), 7):  # one word in seven replaced, one dropped
            words[k] = "other"
        del words[10]
        docs.append((100 + i, prose(rng, 50) + " " + " ".join(words).upper() + "! " + prose(rng, 50)))
        want.add((100 + i, i))
    docs += [(200, items[0][1]), (200, items[0][1]), (201, items[-1][1] + " " + prose(rng, 5000)), (None, items[1][1]), (300, None), (301, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminated(df, benchmark).collect()
    found = Counter((r.doc_id, r.item_id) for r in got)
    assert {k for k in found if k[0] is not None and 100 <= k[0] < 200} == want
    assert found[(200, 0)] == 2 and found[(201, None)] == 1 and found[(None, 1)] == 1
    assert not [k for k in found if k[0] is not None and (k[0] < 100 or k[0] >= 300)]
    left = contamination.clean(df, benchmark)
    assert sorted(r.doc_id for r in left.collect()) == [*range(12), 300, 301]


def test_parts_of_long_items_and_short_items(spark):
    rng = random.Random(13)
    long = " ".join(f"{w}{i}" for i, w in enumerate(prose(rng, 500).split(" ")))
    items = spark.createDataFrame([(1, long), (2, "漢字仮名交じり文"), (3, "zyx wvu"), (4, "zyx wvu"), (5, "qponm"), (6, ""), (7, None)], "item_id long, text string")
    part = " ".join(long.split(" ")[100:300])
    rows = [(0, prose(rng, 300)), (1, prose(rng, 80) + " " + part + " " + prose(rng, 80)), (2, "see 漢字仮名交じり文, twice 漢字仮名交じり文"), (3, "now ZYX, wvu!"), (4, "zyx and wvu"), (5, "zyx"), (6, "wvu"), (7, "a qponm"), (8, None), (9, " ".join(long.split(" ")[100:125]))]  # below MATCHED words, marks inside included
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = sorted((r.doc_id, r.item_id, r.first_word, r.last_word) for r in contamination.contaminated(docs, items).collect())
    assert [x[:2] for x in got] == [(1, 1), (2, 2), (3, 3), (3, 4), (7, 5)] and got[1][2:] == (1, 1) and got[2][2:] == (1, 2)
    assert sorted(r.doc_id for r in contamination.clean(docs, items).collect()) == [0, 4, 5, 6, 8, 9]


def plain_words(text):
    return re.findall("[0-9A-Za-z\x80-\U0010ffff]+", text.lower())


def plain_align(a, b):
    h, best = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)], 0.0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -0.5), h[i - 1][j] - 0.5, h[i][j - 1] - 0.5)
            best = max(best, h[i][j])
    return best


def test_short_overlaps_dont_count(spark):
    items = spark.createDataFrame([(1, "What is the capital of France"), (2, "a b c")], "item_id long, text string")
    rows = [(1, "We asked what is the weather like"), (2, "so: What is the capital of France?"), (3, "what is the old capital of France"), (4, "x a b c y"), (5, "x a b y c")]
    got = contamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(2, 1), (3, 1), (4, 2)]


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_contamination_against_all_alignments(spark, monkeypatch, block):
    """Every pair of document and item aligned whole; items are short enough to keep all their seeds."""
    monkeypatch.setattr(contamination, "BLOCK", block)
    rng = random.Random(17)
    items = [(i, prose(rng, rng.randint(3, 14))) for i in range(14)]
    docs = []
    for i in range(60):
        words = prose(rng, rng.randint(0, 30)).split(" ")
        own = items[i % 14][1].split(" ")
        for k in range(len(own)):
            if rng.random() < (0, 0.15, 0.4)[i % 3]:
                own[k] = rng.choice(["other", ""])
        docs.append((i, " ".join([*words, *own, *prose(rng, 9).split(" ")])))
    want = {}
    for d, text in docs:
        for i, item in items:
            w = plain_words(item)
            score = plain_align(w, plain_words(text))
            seeds = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
            t = plain_words(text)
            if score >= contamination.enough(len(w)) - 1e-6 and seeds & {tuple(t[k : k + 3]) for k in range(len(t) - 2)}:
                want[(d, i)] = score / len(w)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string").repartition(1)
    got = {(r.doc_id, r.item_id): r.score for r in contamination.contaminated(df, benchmark).collect()}
    assert got == pytest.approx(want) and len(want) > 30
    assert {r.doc_id for r in contamination.clean(df, benchmark).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_common_seeds_are_dropped_but_not_the_last():
    items = contamination.items_of([(1, "a b c d e f g h i j k l m n o p q r"), (2, "a b c d")])
    words = lambda chosen, i: [int(p) for p in sorted(chosen.position[chosen.item == i])]
    counts = np.ones(len(items.seeds), np.uint64)
    common = {items.seeds[k] for k in range(len(items.seeds)) for p in range(items.first_at[k], items.first_at[k + 1]) if items.item[p] == 0 and items.position[p] < 6}
    counts[[s in common for s in items.seeds]] = 50
    kept = words(contamination.rare(items, counts, 100), 0)
    assert len(kept) == 12 and kept[2:] == list(range(6, 16))  # twelve, the rarest
    assert words(contamination.rare(items, counts, 100), 1) == [0, 1]
    assert words(contamination.rare(items, counts, 100_000), 0) == list(range(16))


def test_alignment_scores():
    rng = np.random.default_rng(5)
    a, b = rng.integers(1, 5, (40, 12)).astype(np.uint64), rng.integers(1, 5, (40, 25)).astype(np.uint64)
    score, begin, end = contamination.align(a, b)
    for i in range(40):
        assert score[i] == plain_align(a[i].tolist(), b[i].tolist())
        assert plain_align(a[i].tolist(), b[i, begin[i] : end[i]].tolist()) == score[i]


def test_contamination_of_none(spark, docs, none):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contaminated(docs, empty).count() == 0 and contamination.clean(docs, empty).count() == docs.count()
    assert contamination.contaminated(none, spark.createDataFrame([(1, "a b c d")], "item_id long, text string")).count() == 0


# 10: WARC


def test_warc_round_trip(spark, tmp_path):
    rng = random.Random(6)
    big = prose(rng, 40_000)
    pages = [(5, "http://a", "<p>" + "x" * 200), (3, "http://b", "<p>" + "x" * 200), (9, None, "<p>" + "x" * 200), (1, "u", None), (2, "u", ""), (4, "u", "short"), (6, "u", "short"), (7, "bad\r\nurl: x", big), (8, "u", big), (None, "u", big), (10, "u", "é" * 99), (11, "u", "é" * 99), (3, "http://b", "<p>" + "x" * 200), (12, "u", "WARC/1.1\r\n\r\n" * 40)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, payload long").repartition(3)
    archives = warc.normalise(warc.write_archives(df, str(tmp_path), roll=50_000), str(tmp_path))
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    first = {}
    for i, _, html in pages:
        t = (html or "").encode()
        if len(t) >= 100 and i is not None:
            first[t] = min(i, first.get(t, i))
    want = Counter()
    for i, _, html in pages:
        t = (html or "").encode()
        back = t in first and i != first[t]
        want[(i, len(t), hashlib.sha256(t).hexdigest(), "revisit" if back else "response", first[t] if back else None)] += 1
    assert got == want
    for r in archives.collect():
        members = gzip.open(r.path).read()
        assert members.count(b"WARC-Record-ID") == r.records
        offsets = [tuple(map(int, x.split()[:2])) for x in open(r["index"])]
        raw = open(r.path, "rb").read()
        assert sum(n for _, n in offsets) == len(raw) and all(gzip.decompress(raw[o : o + n]).startswith(b"WARC/1.1") for o, n in offsets)


def test_warc_of_none(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.normalise(warc.write_archives(none, str(tmp_path)), str(tmp_path))).count() == 0


# 2: quality


def labelled(spark, n=240):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        t = prose(rng, rng.randint(20, 400))
        docs.append((i, t if good else " ".join(w + "###" for w in t.split(" "))))
        labels += [(i, int(good), 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_held_out(spark):
    docs, labels = labelled(spark)
    model = quality.train(docs, labels)
    got = quality.score(docs, model).join(labels, "doc_id").where(quality.held_out()).collect()
    assert len(got) > 40 and sum((r.score >= 0.5) == (r.quality == 1) for r in got) / len(got) > 0.95
    again = quality.train(docs.repartition(3), labels)
    assert all(np.array_equal(model.p[k], again.p[k]) for k in model.p)
    kept = quality.good(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in quality.score(docs, model).where("score >= 0.5").collect()}


def test_quality_of_awkward_rows(spark, docs, none):
    model = quality.train(*labelled(spark))
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by_text = defaultdict(set)
    for r in quality.score(docs.withColumnRenamed("score", "given"), model, ["text"]).collect():
        by_text[r.text].add(r.score)
    assert all(len(x) == 1 for x in by_text.values())
    assert quality.score(none, model).count() == 0
    no_labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, no_labels)).collect()} == {0.5}
    odd = spark.createDataFrame([(None, 1), (3, None), (5, 1), (5, 0)], "doc_id long, quality int")
    assert quality.score(docs, quality.train(docs, odd)).count() == docs.count()


def plain_score(model, text):
    """A text's score from its words, one passage after the other."""
    data = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0d]+", data)
    hashed = [int(word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in found]
    pairs, before, had, had_pair, rows = list(zip(hashed, hashed[1:], strict=False)), set(), [], [], []
    for h in hashed:
        had.append(h in before)
        before.add(h)
    for i, p in enumerate(pairs):
        had_pair.append(p in pairs[:i])
    for a in range(0, max(1, len(found)), quality.PASSAGE):
        own = range(a, min(a + quality.PASSAGE, len(found)))
        chars, many = max(1, sum(len(found[i]) for i in own)), max(1, len(own))
        kinds = Counter(b if b < 128 else 128 + (b & 15) for i in own for b in found[i])
        lengths, cells = Counter(min(len(found[i]), 16) - 1 for i in own), Counter(hashed[i] % quality.HASHED for i in own)
        x = [math.sqrt(kinds[k] / chars) for k in range(quality.BYTES)] + [lengths[k] / many for k in range(quality.LENGTHS)] + [math.sqrt(cells[k] / many) for k in range(quality.HASHED)]
        share = lambda test, own=own, many=many: sum(bool(test(i)) for i in own) / many
        x += [
            share(lambda i: had[i]),
            share(lambda i: i < len(pairs) and had_pair[i]),
            share(lambda i: found[i][-1] < 128 and not re.fullmatch(rb"[0-9A-Za-z.,]", found[i][-1:])),
            share(lambda i: len(found[i]) == 1),
            chars / many / 10,
            share(lambda i: 65 <= found[i][0] <= 90),
            math.log1p(len(own)) / 5,
            math.log1p(len(found)) / 10,
        ]
        rows.append((np.array(x) - model.mean) / model.scale)
    p = {k: v.astype(float) for k, v in model.p.items()}
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    h = [np.tanh(x @ p["W"] + p["b"]) for x in rows]
    e = [math.exp((np.tanh(v @ p["V"] + p["v"]) * sigmoid(v @ p["G"] + p["g"])) @ p["w"]) for v in h]
    return float(sigmoid(sum(w * v for w, v in zip(e, h, strict=True)) / sum(e) @ p["c"] + p["d"][0]))


def test_scores_against_the_definition(spark, docs):
    few = docs.where("length(coalesce(text, '')) < 3000")
    labels = few.where("doc_id is not null").select("doc_id", (F.col("doc_id") % 2).alias("quality"))
    model = quality.train(few, labels)
    got = quality.score(few, model, ["doc_id", "text"]).collect()
    assert len(got) == few.count() and max(r.score for r in got) - min(r.score for r in got) > 0.1
    assert [r.score for r in got] == pytest.approx([plain_score(model, r.text) for r in got], abs=2e-3)


def test_gradients():
    rng = np.random.default_rng(8)
    model = quality.GatedAttention(6, 5, 4)
    model.p = {k: rng.standard_normal(v.shape) for k, v in model.p.items()}
    x, n, y = rng.standard_normal((9, 6)), np.array([2, 4, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        s = model.forward(x, n)["score"]
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    given = model.gradients(x, n, y)
    for k, v in model.p.items():
        at = np.unravel_index(int(rng.integers(v.size)), v.shape)
        v[at] += 1e-6
        up = loss()
        v[at] -= 2e-6
        down = loss()
        v[at] += 1e-6
        assert given[k][at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-7)


def test_encoding_covers_long_texts():
    import pyarrow as pa

    texts = pa.array([prose(random.Random(9), 5000), "", None])
    (_, _, buf, offs), = text_chunks(texts)
    x, n = quality.encode(buf, offs)
    assert n.tolist() == [40, 1, 1] and np.isfinite(x).all() and len(x) == 42
