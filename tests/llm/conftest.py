import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, score double, ord int, size string, copies int, bucket int, label string, kept string, copy string"
VOCAB = [a + b for a in "ka mo ti ru se no la pi du ve".split() for b in "bel dor fin gas hum jor kel lim".split()]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows(seed=0, n=60):
    """Clean documents, copies, near copies, a shared passage, and the awkward ones."""
    rng = random.Random(seed)
    out = [prose(rng, rng.randint(5, 260)) for _ in range(n)]
    passage = prose(rng, 70)
    for i in range(0, 12, 2):
        out[i] = prose(rng, 20) + "\n" + passage + "\n" + prose(rng, 20)
    lines = "\n".join(prose(rng, 6) for _ in range(4))
    out += [lines + "\n" + prose(rng, 9), prose(rng, 9) + "\n" + lines, out[3], out[3], out[5]]
    base = prose(rng, 200).split(" ")
    out.append(" ".join(base))
    for i in range(8):
        own = list(base)
        for _ in range(rng.randint(1, 3)):
            own[rng.randrange(200)] = f"edit{i}{rng.random():.4f}"
        out.append(" ".join(own))
    out += ["", "   \n\t ", "x", "one two three", "One TWO three", "été Öl 日本語 " * 30, "a " * 300, ("repeat me now " * 90).strip(), prose(rng, 9000)]
    docs = [(i, t) for i, t in enumerate(out)]
    docs += [(len(docs), None), (None, prose(rng, 50)), (None, None), docs[7], docs[7], (7, prose(rng, 60))]  # null ids, equal rows, one id with two texts
    rng.shuffle(docs)
    return [(i, t, "en" if j % 3 else None, f"s{j % 4}" if j % 5 else None, len(t) if t else None, 1, 0.5, 2, "size", 3, 4, "label", "kept", "copy") for j, (i, t) in enumerate(docs)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
