"""Small corpora with awkward rows, shared by the tests."""

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row_key bigint, bucket string, score double, kept string, _digest string"
BASE = ["doc_id", "text", "lang", "source", "n_chars"]


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, pairs):
    """Documents with every column of the real table and some whose names the operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "b", 0.5, "k", "d") for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(seed=3, documents=60):
    """(doc_id, text): copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    passage = words(rng, 70)
    short = words(rng, 52)
    base = words(rng, 160)
    out = []
    for i in range(documents):
        body = words(rng, rng.choice([3, 40, 120, 200]))
        if i % 3 == 0:
            at = rng.randrange(len(body))
            body = body[:at] + passage + body[at:]
        if i % 4 == 1:
            body = body + short
        if i % 5 == 2:
            body = list(base)
            for _ in range(rng.randrange(4)):
                body[rng.randrange(len(body))] = "x%d" % rng.randrange(50)
        out.append((i, rng.choice([" ", "  ", "\n"]).join(body)))
    out += [(100, out[2][1]), (101, out[2][1].replace(" ", "\t")), (102, None), (103, ""), (104, " \n\t"), (105, "Ünï ćödé Ünï ćödé")]
    out += [(106, " ".join(words(rng, 6000))), (107, "x" * 5000), (100, out[2][1]), (None, out[3][1]), (None, None), (3, out[3][1])]
    return out
