"""Held-out accuracy of the trained models, and their parts against brute force."""

import itertools
import zlib

import numpy as np
import pytest

from tarnql.llm import language, licenses, quality, token_counts, toxicity

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def test_forward_backward_is_exact():
    rng = np.random.default_rng(1)
    k, lengths = 3, [4, 1, 3]
    scores, a, start = rng.normal(size=(8, k)), rng.normal(size=(k, k)), rng.normal(size=k)
    got = language.forward_backward(scores, np.array(lengths), a, start)
    want, joint, at = [], np.zeros((k, k)), 0
    for n in lengths:
        marginal, pairs, total = np.zeros((n, k)), np.zeros((k, k)), 0.0
        for y in itertools.product(range(k), repeat=n):
            w = np.exp(start[y[0]] + sum(scores[at + i, y[i]] for i in range(n)) + sum(a[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            for i in range(n):
                marginal[i, y[i]] += w
            for i in range(n - 1):
                pairs[y[i], y[i + 1]] += w
        want.append(marginal / total)
        joint += pairs / total
        at += n
    assert np.allclose(got, np.concatenate(want))
    first = np.cumsum(lengths) - lengths
    assert np.allclose(language._joint(scores, np.array(lengths), a, start, np.setdiff1d(np.arange(8), first)), joint)


def test_language_accuracy(docs):
    model = language.train(docs)
    rows = language.identify(docs.filter(language.held_out()).select("doc_id", "text", "lang"), model).select("lang", "lang_pred").collect()
    assert len(rows) > 2000 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97
    mixed = language.Labeller(model)([b"and of the thing with erent " * 3 + "de la cióniedoas ciónra que los ".encode() * 3])
    ((words, p),) = list(mixed)
    named = [model["names"][i] for i in p.argmax(axis=1)]
    assert named[:12].count("en") > 9 and named[-12:].count("es") > 9 and len(words) == len(named)


def test_quality_accuracy(docs, labels):
    model = quality.train(docs, labels)
    rows = quality.score(docs.join(labels, "doc_id").filter(quality.held_out()).select("doc_id", "text", "quality"), model).select("quality", "score").collect()
    good = [r["score"] for r in rows if r["quality"] == 1]
    bad = [r["score"] for r in rows if r["quality"] == 0]
    assert len(rows) > 1000 and np.mean([s >= 0.5 for s in good]) > 0.99 and np.mean([s < 0.5 for s in bad]) > 0.95


def test_votes_against_brute_force():
    rng = np.random.default_rng(3)
    texts = [bytes(rng.integers(97, 123, size=60).astype(np.uint8)) for _ in range(80)]
    labels = [int(x) for x in rng.integers(2, size=80)]
    model = quality.fit(texts, labels)
    got = quality.scores(model, texts[:5] + [None, b""])
    for text, score in zip(texts[:5], got, strict=False):
        v = quality.terms([text])[0] @ model["projection"]
        near = sorted(((float(v / np.linalg.norm(v) @ w), y) for w, y in zip(model["vectors"], model["labels"], strict=True)), reverse=True)[: quality.NEIGHBOURS]
        weight = [max(c, 0) for c, _ in near]
        assert abs(sum(w * y for w, (_, y) in zip(weight, near, strict=True)) / sum(weight) - score) < 1e-4
    assert got[5] == got[6] == model["prior"]


def test_ties_go_to_the_first():
    rng = np.random.default_rng(4)
    for _ in range(200):
        cosines, k = rng.integers(0, 4, size=(6, 12)) / 4, int(rng.integers(1, 13))
        want = [sorted(range(12), key=lambda i: (-row[i], i))[:k] for row in cosines]
        assert [sorted(w) for w in want] == [np.flatnonzero(m).tolist() for m in quality.nearest(cosines, k)]


def test_long_text_in_windows():
    texts = [b"the of and for was are thing erent " * 40, "le la les des ci\u00f3nie dans la mais ".encode() * 40, b"und der die das ein nicht sich auf " * 40]
    own = language.Labeller(language.fit(texts * 3, ["en", "fr", "de"] * 3))
    text = texts[0][:300] + texts[1][:400] + texts[2][:500]
    ((words, p),) = list(own([text]))
    parts = list(own.windows(text, 50))[::-1]
    assert len(parts) > 10 and [w for ws, _ in parts for w in ws] == words and np.allclose(np.concatenate([q for _, q in parts]), p)


def test_memory_is_bounded():
    from tarnql.llm import common, packing

    words = common.Words(len, most=10_000)
    for i in range(5000):
        assert words[b"w%d" % i] == len(b"w%d" % i) and words.size <= 10_000 + common.ENTRY_BYTES + 10
    made = []
    for key in ("a", "a", "b", "a"):
        common.remembered(key, lambda key=key: made.append(key))
    assert made == ["a", "b", "a"] and len(common._memory) == 2
    own = packing.Encoder(packing.default_tokenizer())
    for i in range(0, 600_000, 20_000):
        list(own.encode([" ".join(f"x{j}" for j in range(i, i + 20_000))]))
        assert own.size <= packing.MEMORY + 20_000 * 200
    scored = toxicity.Scorer({"weights": {b"bad": 2.0}, "thresholds": [0.0, 1.0, 2.0]})
    assert np.allclose(scored([b"bad day", None])["above"], toxicity._sigmoid(np.array([[2, 1, 0], [0, -1, -2]])))


def test_small_slices():
    import pyarrow as pa

    from tarnql.llm import common

    rng = np.random.default_rng(1)
    texts = [None if rng.random() < 0.1 else "x" * int(rng.integers(0, 3_000_000) if rng.random() < 0.01 else rng.integers(0, 3000)) for _ in range(3500)]
    parts = list(common.slices(iter([pa.RecordBatch.from_arrays([pa.array(range(3500)), pa.array(texts)], names=["i", "t"])]), 1))
    assert [t for p in parts for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or p.num_rows <= common.SLICE_ROWS and sum(len(t or "") for t in p.column(1).to_pylist()) <= common.SLICE_BYTES for p in parts)


def test_toxicity_accuracy(docs, labels):
    from pyspark.sql import functions as F

    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 1
    model = toxicity.train(docs, labels, where=~fold)
    assert sorted(model["thresholds"]) == model["thresholds"]
    own = docs.join(labels.withColumnRenamed("toxic", "label"), "doc_id").filter(fold).select("doc_id", "text", "label")
    rows = toxicity.severity(own, model).collect()
    hit = [r for r in rows if r["label"] == 1]
    clean = [r for r in rows if r["label"] == 0]
    assert len(hit) > 50 and np.mean([r["toxic"] for r in hit]) > 0.95 and np.mean([r["toxic"] for r in clean]) < 0.005
    assert all(0 <= r["expected_severity"] <= 3 and (r["severity"] > 0) == r["toxic"] for r in rows)


def test_ordinal_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 2))
    latent = 2 * x[:, 0] - x[:, 1] + rng.logistic(size=3000)
    grade = np.searchsorted([-1, 1, 2.5], latent)
    w, cut = toxicity._fit_ordinal(x, grade)
    assert np.allclose(w, [2, -1], atol=0.25) and np.allclose(cut, [-1, 1, 2.5], atol=0.25)


def test_token_counts_against_brute_force():
    rng = np.random.default_rng(2)
    scores = token_counts.zipf_scores(["▁", "a", "b", "ab", "ba", "▁ab", "aba", "bb", "é", "▁a"])
    own = token_counts.Counter(scores)

    def slow(word: str) -> int:
        best = [(0.0, 0)]
        for i in range(1, len(word) + 1):
            n = len(word[i - 1].encode())
            found = [(best[i - 1][0] + n * own.byte_score, best[i - 1][1] - n)]
            found += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
            best.append(max(found))
        return -best[-1][1]

    words = ["".join(rng.choice(list("abé中"), size=rng.integers(1, 9))) for _ in range(300)]
    got, n = own.count([" ".join(words[i : i + 10]) for i in range(0, 300, 10)])
    assert got == [sum(slow("▁" + w) for w in words[i : i + 10]) for i in range(0, 300, 10)] and n == [10] * 30


def test_license_families(spark):
    texts = {
        "apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "mit": "x\nReleased under the MIT License.\ny",
        "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.",
        "all-rights-reserved": "Copyright 2021 Someone. All rights reserved.",
        "unknown": "Licensed under the Foo Bar license.",
        "": "He has rights and a license to drive.\nThe public house is open.",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id string, text string")
    for r in licenses.scan(df).collect():
        families = [f["family"] for f in r["findings"]]
        assert families == [r["doc_id"]] if r["doc_id"] else set(families) <= {"unknown"}, (r, families)
        assert all(0 <= f["probability"] <= 1 for f in r["findings"])


@pytest.mark.parametrize("words", [0, 60, 200, 1000])
def test_license_in_a_long_line(spark, words):
    rest = " ".join(f"w{i % 97}" for i in range(words))
    cases = {"apache-2.0": f"Licensed under the Apache License, Version 2.0. {rest}", "mit": f"{rest} Released under the MIT License. {rest}", "": f"{rest} nothing here {rest}"}
    for r in licenses.scan(spark.createDataFrame(list(cases.items()), "doc_id string, text string")).collect():
        assert [f["family"] for f in r["findings"]] == ([r["doc_id"]] if r["doc_id"] else [])


def test_license_scan_matches_the_model(spark):
    lines = [t for ts in licenses.TEMPLATES.values() for t in ts]
    model = licenses.train()
    p = licenses._softmax((licenses._matrix(lines) @ model["weights"] + model["bias"]) / model["temperature"])
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    for r in licenses.scan(df, model).collect():
        (f,) = r["findings"]
        assert abs(f["probability"] - p[r["doc_id"]].max()) < 1e-5 and f["family"] in (model["names"][p[r["doc_id"]].argmax()], "unknown")


def test_license_scan_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_fold_rule(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = df.select("doc_id", language.held_out().alias("a"), quality.held_out().alias("b")).collect()
    assert all(r["a"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and r["b"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
