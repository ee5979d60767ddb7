import itertools
import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gleanery.llm import hmm as H


def small(seed=0, k=2, m=3):
    r = np.random.default_rng(seed)
    return H.Hmm.of_counts(r.uniform(size=k), r.uniform(size=(k, k)) * 5, r.uniform(size=(m, k)) * 5)


def brute(model, doc):
    k = len(model.start)
    return sum(model.start[p[0]] * model.emit[doc[0], p[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[doc[i], p[i]] for i in range(1, len(doc))) for p in itertools.product(range(k), repeat=len(doc)))


def test_forward_is_exact():
    model, docs = small(), [np.array(d) for d in ([0], [1, 2, 0, 1], [2, 2], [0, 1, 2, 0, 1, 1, 2])]
    assert np.allclose(model.log10(docs), [math.log10(brute(model, d)) for d in docs])


def test_expected_counts_by_enumeration_and_blocks(monkeypatch):
    model, docs = small(3), [np.array(d) for d in ([1, 2, 0, 1, 1], [2, 0, 2], [0])]
    want = model.zeros()
    for d in docs:
        whole = brute(model, d)
        for p in itertools.product(range(2), repeat=len(d)):
            w = model.start[p[0]] * model.emit[d[0], p[0]] * math.prod(model.move[p[i - 1], p[i]] * model.emit[d[i], p[i]] for i in range(1, len(d))) / whole
            want[0][p[0]] += w
            for i in range(len(d)):
                want[2][d[i], p[i]] += w
                if i:
                    want[1][p[i - 1], p[i]] += w
    for block in (512, 2, 1):
        monkeypatch.setattr(H, "BLOCK", block)
        got = model.zeros()
        ll = model.expect(docs, got)
        assert all(np.allclose(a, b) for a, b in zip(got, want))
        assert np.isclose(ll, model.log10(docs).sum())


def test_likelihood_rises():
    r = np.random.default_rng(5)
    docs = [np.array([i % 2 * 3 + int(r.integers(3)) for _ in range(20)]) for i in range(40)]
    model, seen = H.Hmm.of_counts(np.ones(2), np.ones((2, 2)) + np.eye(2), r.uniform(0.5, 1.5, (6, 2))), []
    for _ in range(15):
        acc = model.zeros()
        seen.append(model.expect(docs, acc))
        model = H.Hmm.of_counts(*acc, prior=1e-9)
    assert seen[-1] > seen[0] + 50 * math.log10(1.5)


def test_base_by_brute_force_and_better_than_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 != 0
    got = {r["doc_id"]: r for r in H.score(docs, train, frequent=200, classes=16, states=3).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    c = Counter()
    for d in rows:
        if zlib.crc32(str(d["doc_id"]).encode()) % 10:
            c.update([*H.words_of(d["text"]), b"\n"])
    n, v = sum(c.values()), len(c)
    for d in rows:
        tokens, r = [*H.words_of(d["text"]), b"\n"], got[d["doc_id"]]
        assert r["train_tokens"] == n and r["n_tokens"] == len(tokens) and r["n_known"] == sum(t in c for t in tokens)
        assert math.isclose(r["base_score"], sum(math.log10((c[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens), rel_tol=1e-9)
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, "A b c " * 20_000), (4, "x"), (4, "x"), (None, "a B")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash"))
    got = H.score(df, F.col("doc_id") < 5, frequent=2, classes=4, states=2).collect()
    assert len(got) == 6 and all(r["score"] <= 0 and math.isfinite(r["score"]) for r in got)
    assert H.score(df.limit(0), F.lit(True), frequent=2, classes=4, states=2).count() == 0
    assert H.score(df, F.lit(False), frequent=2, classes=4, states=2).count() == 6


def test_every_round_sees_all_training_rows(spark):
    df = spark.range(0, 60, 1, 3).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'a b a b', concat('c d c d e', id)) AS text")
    got = [{r["doc_id"]: r["score"] for r in H.score(x, F.lit(True), frequent=8, classes=4, states=2).collect()} for x in (df, df.repartition(5), df.orderBy(F.desc("doc_id")))]
    for other in got[1:]:
        assert all(math.isclose(got[0][k], other[k], rel_tol=1e-6) for k in got[0])


def test_score_end_to_end_by_brute_force(spark, monkeypatch):
    """The whole score of each of 60 texts: the path sum of the model that the job fitted, times each rare word's share of its class."""
    kept, real = [], H.Hmm.of_counts.__func__

    def remember(cls, *counts, **other):
        kept.append(real(cls, *counts, **other))
        return kept[-1]

    monkeypatch.setattr(H.Hmm, "of_counts", classmethod(remember))
    texts = [("a b a", "b a", "b rare%d" % i, "a new%d b" % (i % 7))[i % 4] for i in range(60)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    frequent, classes = 3, 8
    got = {r["doc_id"]: r for r in H.score(df, F.col("doc_id") < 50, frequent=frequent, classes=classes, states=2, rounds=4).collect()}
    c = Counter(w for t in texts[:50] for w in H.words_of(t))
    top = sorted((w for w in c if c[w] >= 10), key=lambda w: (-c[w], w))
    assert {*top} == {b"a", b"b"}
    mass, kinds = Counter(), Counter()
    for w in c.keys() - set(top):
        mass[H._class(w, classes)] += c[w]
        kinds[H._class(w, classes)] += 1
    for i, t in enumerate(texts):
        words, symbols, tail = H.words_of(t), [], 0.0
        for w in words:
            k = H._class(w, classes)
            symbols.append(top.index(w) if w in top else frequent + k)
            tail += 0 if w in top else math.log10((c[w] + 0.1) / (mass[k] + 0.1 * (kinds[k] + 1)))
        want = math.log10(brute(kept[-1], [*symbols, frequent + classes])) + tail
        assert math.isclose(got[i]["score"], want, rel_tol=1e-9), (t, got[i]["score"], want)


def test_states_are_computed_once_and_documents_of_like_length_run_together(monkeypatch):
    model, r = small(4), np.random.default_rng(1)
    docs = [r.integers(0, 3, n) for n in (300, 2, 290, 300, 5, 1)]
    want = [np.zeros_like(x) for x in model.zeros()]
    likelihood = sum(model.expect([d], want) for d in docs)
    monkeypatch.setattr(H, "PORTION", 600, raising=False)
    parts = [[len(d) for d in p] for p in H.portions(docs)]
    assert parts == [[300, 300], [290, 5, 2, 1]]
    calls, real, got = [], H.Hmm._forward, model.zeros()
    monkeypatch.setattr(H.Hmm, "_forward", lambda self, *a: calls.append(a[2:4]) or real(self, *a))
    assert np.isclose(sum(model.expect(p, got) for p in H.portions(docs)), likelihood)
    assert calls == [(0, 300), (0, 290)]  # once for each list
    assert all(np.allclose(a, b) for a, b in zip(got, want, strict=True))
