"""Quality, toxicity, decontamination, secrets and licences against plain versions and planted cases."""

import hashlib
import random
import re
from importlib.resources import files
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from heliotide.llm import decontaminate, licences, quality, secrets, toxicity
from tests.llm.corpora import corpus, empty, frame, words

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def labelled(rng, n, bad):
    """Documents of two kinds: sentences, and what ``bad`` makes of them for every fourth."""
    out = []
    for i in range(n):
        text = " ".join(words(rng, rng.randint(20, 120), 300)).capitalize() + "."
        out.append((i, bad(rng, text) if i % 4 == 0 else text, int(i % 4 == 0)))
    return out


def test_quality_separates_held_out_junk(spark):
    rng = random.Random(1)
    rows = labelled(rng, 400, lambda r, t: t.upper().replace(" ", "!! ") if r.random() < 0.5 else " ".join([t.split()[0]] * 60))
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "Plain words stay."), (900, None), (901, ""), (3, rows[3][1])])
    labels = spark.createDataFrame([(i, 1 - b) for i, _, b in rows if i % 5] + [(7777, 1), (None, 0)], "doc_id bigint, label int")
    vectors = quality.statistics_of(docs)
    model = quality.fit(vectors.join(labels, "doc_id"))
    score = [(r["doc_id"], r["score"]) for r in quality.scored(vectors, model).collect()]
    assert len(score) == 404 and all(0 <= s <= 1 for _, s in score)
    wrong = [i for i, s in score if i is not None and i < 400 and i % 5 == 0 and (s >= 0.3) == (i % 4 == 0)]
    assert len(wrong) <= 2
    kept = quality.accepted(docs, model)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, s in score if s >= 0.3)


def test_quality_without_labels_or_documents(spark):
    docs = frame(spark, [(1, "one"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, label int")
    model = quality.fit(quality.statistics_of(docs).join(none, "doc_id"))
    assert {r["score"] for r in quality.scored(quality.statistics_of(docs), model).collect()} == {0.5}
    assert quality.scored(quality.statistics_of(empty(spark)), model).count() == 0


def test_discriminant_is_the_difference_of_gaussian_log_densities():
    rng = np.random.default_rng(0)
    p, means, factors, dets, densities = 3, [], [], [], []
    x = rng.normal(size=(5, p))
    for _ in range(2):
        a = rng.normal(size=(p, p))
        cov, mean = a @ a.T + np.eye(p), rng.normal(size=p)
        root = np.linalg.cholesky(cov)
        means.append(mean), factors.append(np.linalg.inv(root)), dets.append(np.linalg.slogdet(cov)[1])
        d = x - mean
        densities.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) + np.linalg.slogdet(cov)[1]))
    model = quality.Model(0.5, tuple(means), tuple(factors), tuple(dets))
    np.testing.assert_allclose(model.difference(x), densities[1] - densities[0])


def test_toxicity_finds_planted_passages(spark):
    rng = random.Random(2)
    bad = ["grumwort", "grumworts", "vilefoo", "snarlbar"]

    def spoil(r, text):
        w = text.split()
        at = r.randrange(len(w))
        return " ".join(w[:at] + [r.choice(bad) for _ in range(3)] + w[at:])

    rows = labelled(rng, 600, spoil)
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(None, "calm words"), (900, None), (901, ""), (902, "GRUMWORTY! grumwortier vilefoo")])
    labels = spark.createDataFrame([(i, b) for i, _, b in rows if i % 5] + [(None, 1), (1, 5)], "doc_id bigint, label int")
    model = toxicity.fit(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) + 4
    wrong = [r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 600 and (r["score"] >= 0.3) != (r["doc_id"] % 4 == 0)]
    assert len(wrong) <= 6
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[902]["score"] >= 0.3 and by_id[900]["score"] < 0.3 and by_id[901]["passages"] == []
    assert any(w in by_id[0]["passages"][0]["text"] for w in bad)


def test_toxicity_without_labels_or_documents(spark):
    docs = frame(spark, [(1, "one"), (2, None)])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id bigint, label int"))
    assert {r["score"] for r in toxicity.scored(docs, model).collect()} == {0.5}
    assert toxicity.scored(empty(spark), model).count() == 0


@pytest.mark.parametrize("seed", range(60))
def test_maximal_segments_by_their_definition(seed):
    """Repeatedly take the best segment, then look left and right of it."""
    rng = random.Random(seed)
    values = [rng.choice([-1, -1, 1, 2, 3]) for _ in range(rng.randint(1, 14))]

    def plain(a, b):
        best = max(((sum(values[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        return [*plain(a, best[3]), (best[3], best[4], best[0]), *plain(best[4], b)]

    at = [i for i, v in enumerate(values) if v > 0]
    got = toxicity.maximal_segments(at, [values[i] for i in at], 1.0)
    assert sum(s for _, _, s in got) == sum(s for _, _, s in plain(0, len(values)))
    assert max((s for _, _, s in got), default=0) == max((s for _, _, s in plain(0, len(values))), default=0)


def plain_hits(pairs, items):
    found = {}
    for item, text in items:
        w = ALNUM.findall(lower(text))
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if w else 0):
            found.setdefault(tuple(w[a : a + k]), set()).update([] if item is None else [str(item)])
    out = Counter()
    for i, text in pairs:
        w = ALNUM.findall(lower(text))
        hit, ids = [False] * len(w), set()
        for k in {len(f) for f in found}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in found:
                    ids |= found[tuple(w[a : a + k])]
                    hit[a : a + k] = [True] * k
        out[i, len(w), sum(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), any(hit)] += 1
    return out


@pytest.mark.parametrize("shard", [decontaminate.SHARD_WINDOWS, 20])
def test_decontamination(spark, shard):
    pairs = corpus()
    w = [ALNUM.findall(lower(t)) for _, t in pairs]
    items = [(1, " ".join(w[0][5:40])), (2, " ".join(w[3][10:20]).upper()), (10, " ".join(w[4][:3])), (11, "w7"), (12, "Ünï ćödé"), (13, None), (14, "--"), (None, " ".join(w[8][2:14])), (1, " ".join(w[0][5:40])), (15, "never seen words here")]
    docs, table = frame(spark, pairs), spark.createDataFrame([(i, t, "x") for i, t in items], "item_id bigint, text string, n_hit string")
    got = decontaminate.hits(docs, table, shard_windows=shard).collect()
    rows = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in got)
    assert rows == plain_hits(pairs, items)
    if shard > 20:
        assert Counter(tuple(r) for r in decontaminate.report(docs, table).collect()) == rows
        clean = decontaminate.clean(docs, table)
        assert clean.columns == docs.columns
        assert Counter(r["doc_id"] for r in clean.collect()) == Counter(k[0] for k, c in rows.items() if not k[5] for _ in range(c))


def test_decontamination_with_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.report(empty(spark), none).count() == 0
    assert decontaminate.report(frame(spark, [(1, "a b")]), none).collect()[0]["n_hit"] == 0


def test_secrets(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    texts = {
        1: f"é token = 'abcdef' and {key} or {'0a' * 12}",
        2: "password: abc",  # too short
        3: "secret: token: abcdefghij",  # the value of the first match is too short, and matching goes on behind it
        4: "user=bob and later nothing",
        5: "login: bob42 then Zx9Qw8Er7Ty6Ui5Op4 end",
        6: "Zx9Qw8Er7Ty6Ui5Op4 " + "x " * 200 + "https://example.org/path",
        7: "Zx9Qw8Er7Ty6Ui5Op4 at https://example.org/path",
        8: "PassWord=ſecretvalue toKen=K9abcdef", 9: None, 10: "", 11: "10.1.2.3:8080 " + "deadbeef" * 4,
    }
    docs = frame(spark, [*texts.items(), (7, texts[7]), (None, texts[7])])
    got = {}
    for r in secrets.report(docs).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[7]) == 2 and got[7][0] == got[7][1] and got[None][0]["spans"] == got[7][0]["spans"]
    spans = {i: rows[0]["spans"] for i, rows in got.items()}
    assert spans[1] == f"assign:2:17,access:23:43,hex:47:71"
    assert (spans[2], spans[3], spans[4], spans[6], spans[9], spans[10]) == ("", "", "", "", "", "")
    assert spans[5] == "identifier:0:12,run:18:36" and spans[7] == "run:0:18,endpoint:22:46"
    assert spans[8] == "assign:21:35" and spans[11] == "endpoint:0:13,hex:14:46"
    assert got[1][0]["base_sha256"] == hashlib.sha256(spans[1].encode()).hexdigest()
    assert got[7][0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and got[7][0]["n_linked"] == 2
    assert secrets.report(empty(spark)).count() == 0


def test_secrets_are_found_whole(spark):
    name, value, key = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXAMPLEKE", "aB3+" * 21 + "aB=="
    url = "https://example.org/" + "path." * 96
    long_url = "https://example.org/" + "path." * 60 + "?"
    texts = {
        1: f"aws_access_key_id={name}\naws_secret_access_key={value}\n",
        2: f"AccountName: store; AccountKey={key}; end",
        3: f"see {url} and Zx9Qw8Er7Ty6Ui5Op4",
        4: "login: " + "n" * 100 + " Zx9Qw8Er7Ty6Ui5Op4",
        5: "KEY=Zx9Qw8Er7Ty6Ui5Op4 alone",
        6: f"{long_url}token=abcdef then Zx9Qw8Er7Ty6Ui5Op4",
    }
    spans = {r["doc_id"]: r["spans"] for r in secrets.report(frame(spark, list(texts.items()))).collect()}
    at = lambda i, kind, part: f"{kind}:{texts[i].index(part)}:{texts[i].index(part) + len(part)}"
    assert len(key) == 88 and len(value) == 40 and len(url) == 500
    assert spans[1] == f"{at(1, 'access', name)},{at(1, 'run', value)}"
    assert spans[2] == "" and spans[5] == ""  # no complementary part
    assert spans[3] == f"{at(3, 'endpoint', url)},{at(3, 'run', 'Zx9Qw8Er7Ty6Ui5Op4')}"
    assert spans[4] == f"identifier:0:107,{at(4, 'run', 'Zx9Qw8Er7Ty6Ui5Op4')}"
    assert spans[6] == f"{at(6, 'endpoint', long_url)},{at(6, 'assign', 'token=abcdef')},{at(6, 'run', 'Zx9Qw8Er7Ty6Ui5Op4')}"
    stored = [(i, f"login: bob {t}") for i, t in ((1, f"AccountKey={key}"), (2, f"AccountKey = {key}"))]
    assert [r["spans"].split(",")[1] for r in secrets.report(frame(spark, stored)).orderBy("doc_id").collect()] == ["run:22:110", "run:24:112"]


def test_licences(spark):
    mit = dict(licences.KNOWN[4:5])["MIT"]
    texts = {
        1: mit.replace("<year> <copyright holders>", "2020 Somebody Else").upper(), 2: mit + " And more.",
        3: "Some words.\n\n  Licensed under the Apache Licence, version 2.0\nmore", 4: "© 2021 A. Person\nAll rights reserved", 5: None, 6: "", 7: "no licence here",
    }
    docs = frame(spark, [*texts.items(), (3, texts[3]), (None, texts[4])])
    got = {}
    for r in licences.report(docs).collect():
        got.setdefault(r["doc_id"], []).append((r["whole_licence"], r["licences"], r["n_units"]))
    assert got[1][0][:2] == ("MIT", "MIT")
    assert got[2] == [(None, "", 0)] and got[5] == got[6] == got[7] == [(None, "", 0)]
    assert got[3] == [(None, "Apache-2.0", 1)] * 2
    assert got[4] == got[None] == [("all-rights-reserved", "all-rights-reserved", 1)]
    assert licences.report(empty(spark)).count() == 0


def test_whole_licences_and_headers(spark):
    folder = files("heliotide.llm").joinpath("licence_texts")
    text = lambda name: folder.joinpath(f"{name}.txt").read_bytes().decode()
    # The published files, by their own digests.
    assert hashlib.sha256(text("Apache-2.0").encode()).hexdigest() == "cfc7749b96f63bd31c3c42b5c471bf756814053e847c10f3eb003417bc523d30"
    names = sorted(p.name[:-4] for p in folder.iterdir() if p.name.endswith(".txt"))
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "CC0-1.0"} <= set(names)
    docs = [(i, text(n).replace("<year> <owner>", "2020 Somebody Else")) for i, n in enumerate(names)]
    header = "/*\n * Copyright 2020 A. Person\n *\n * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n */\ncode();"
    docs += [(100, text("Apache-2.0").upper()), (101, text("GPL-3.0")[: text("GPL-3.0").index("END OF TERMS")]), (102, header), (103, "# SPDX-License-Identifier: LGPL-2.1-or-later\ncode()"), (104, text("GPL-3.0").replace("copyleft", "copyright", 1))]
    got = {r["doc_id"]: (r["whole_licence"], r["licences"]) for r in licences.report(frame(spark, docs)).collect()}
    assert [got[i][0] for i in range(len(names))] == names
    assert got[100][0] == "Apache-2.0" and got[101][0] == "GPL-3.0" and got[102] == (None, "Apache-2.0") and got[103] == (None, "LGPL-2.1")
    assert got[104][0] is None


def test_licences_under_other_titles_and_wrapped_anew(spark):
    import textwrap

    folder = files("heliotide.llm").joinpath("licence_texts")
    mit = dict(licences.KNOWN[4:5])["MIT"]
    body = mit.split("\n\n", 1)[1].replace("<year> <copyright holders>", "2021 A. Person")

    def wrapped(text, width):
        # owner lines stay lines of their own
        return "\n\n".join("\n".join(x for line in ([p] if "opyright (c)" in p.lower()[:20] else [" ".join(p.split())]) for x in (line.split("\n") if line is p else textwrap.wrap(line, width))) for p in re.split(r"\n\s*\n", text))

    docs = {
        1: ("MIT", "The MIT License (MIT)\n\n" + body), 2: ("MIT", body), 3: ("MIT", "The MIT License\n\n" + wrapped(body, 50)),
        4: ("Apache-2.0", wrapped(folder.joinpath("Apache-2.0.txt").read_text(), 72)), 5: ("Apache-2.0", wrapped(folder.joinpath("Apache-2.0.txt").read_text(), 60)),
    }
    got = {r["doc_id"]: r["whole_licence"] for r in licences.report(frame(spark, [(i, t) for i, (_, t) in docs.items()])).collect()}
    assert got == {i: name for i, (name, _) in docs.items()}
    kept = {r["c"] for r in spark.createDataFrame([("Copyright notices must stay\n# Copyright 2020 X\n(c) 2019 Y\ncopyright © Z",)], "t string").select(licences.canonical(F.col("t")).alias("c")).collect()}
    assert kept == {"copyright notices must stay"}


def test_no_digest_of_a_document_is_moved(spark, tmp_path):
    frame(spark, [(i, f"line {i}\nSPDX-License-Identifier: MIT") for i in range(50)]).write.parquet(str(tmp_path / "d"))
    df = licences.matches(spark.read.parquet(str(tmp_path / "d")), licences.known_licences(spark))
    assert len(df.collect()) == 50
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "Exchange hashpartitioning(digest" not in plan


def test_maximal_segments_in_linear_time():
    """Hits far apart, so that every new total is the lowest, and hits that rise and fall."""
    import time

    n = 100_000
    for gap, scores in ((10, [1.0] * n), (2, [1.0 + (i % 7) / 2 for i in range(n)]), (1, [1.0] * n)):
        at = list(range(0, gap * n, gap))
        start = time.process_time()
        got = toxicity.maximal_segments(at, scores, 1.0)
        assert time.process_time() - start < 1.5
        if gap == 10:
            assert got == [(i, i + 1, 1.0) for i in at]
        if gap == 1:
            assert len(got) == 1 and got[0][:2] == (0, n)


def test_toxic_text_with_very_many_hits(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30)) + (" vile filth scum" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, label int")
    model = toxicity.fit(frame(spark, rows), labels)
    long = " ".join(" ".join(words(rng, 9)) + " vile" for _ in range(20_000))
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(frame(spark, [(1, long), (2, "vile filth scum"), (3, "calm words")]), model).collect()}
    assert got[2] > 0.3 > got[3] and 0 <= got[1] <= 1


@pytest.mark.parametrize("seed", range(4))
def test_base_secrets_by_plain_patterns(spark, seed):
    kinds = {
        "assign": (re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
        "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
    }
    rng = random.Random(seed)
    parts = ["password", "Token", "api_key", "APIKEY", "secret", "passwd", "=", ":", " ", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "é", "x", "Zz9/+_.-", "\n", "中", "abc", "F"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(200)]
    got = {r["doc_id"]: r for r in secrets.report(frame(spark, list(enumerate(texts)))).collect()}
    some = 0
    for i, text in enumerate(texts):
        spans = [(m.start(), k, m.end()) for k, (kind, (pattern, ok)) in enumerate(kinds.items()) for m in pattern.finditer(text) if ok(m)]
        names = list(kinds)
        base = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in names] == [sum(1 for s in spans if s[1] == n) for n in range(3)]
        every = got[i]["spans"].split(",")
        assert all(f"{names[k]}:{a}:{b}" in every for a, k, b in spans)
        some += len(spans)
    assert some > 50
