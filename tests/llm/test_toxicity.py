import math

import numpy as np
import pytest

from gleanery.llm.langid import is_held_out
from gleanery.llm.toxicity import Bags, Weights, features, fit, judged, learn, loss_and_gradient, score, sentences


def test_sentences_and_features():
    assert sentences("One. Two!\n \nThree") == [(0, 3), (4, 8), (12, 17)] and sentences("") == []
    assert features("abc") == ["abc"] and features("abcdef") == ["abcdef", "abcd*", "abcde*"]


def test_gradient_by_differences():
    rng = np.random.default_rng(0)
    docs = [[[int(w) for w in rng.integers(0, 6, rng.integers(0, 4))] for _ in range(rng.integers(0, 5))] for _ in range(12)]
    bags, y, weight, w = Bags(docs), rng.random(12) < 0.5, rng.random(12) + 0.5, rng.normal(size=6)
    _, gw, gb, gl = loss_and_gradient(bags, y, weight, w, -0.5, -1.0)
    at = lambda d, b=0.0, k=0.0: loss_and_gradient(bags, y, weight, w + d, -0.5 + b, -1.0 + k)[0]
    h = 1e-6
    assert np.allclose(gw, [(at(h * e) - at(-h * e)) / (2 * h) for e in np.eye(6)], atol=1e-4)
    assert math.isclose(gb, (at(0, h) - at(0, -h)) / (2 * h), abs_tol=1e-4) and math.isclose(gl, (at(0, 0, h) - at(0, 0, -h)) / (2 * h), abs_tol=1e-4)


def test_document_labels_find_the_sentence():
    rng = np.random.default_rng(1)
    docs, y = [], []
    for i in range(300):
        doc = [[int(w) for w in rng.integers(1, 40, 6)] for _ in range(8)]
        if i % 3 == 0:
            doc[rng.integers(8)][0] = 0
        docs.append(doc)
        y.append(i % 3 == 0)
    w, bias, leak = learn(Bags(docs), np.array(y), np.ones(300), 40, 300, 0.5, 0.1, 1e-3)
    assert w[0] > 4 and np.abs(w[1:]).max() < w[0] / 2
    model = {"words": {"bad": float(w[0])}, "bias": bias, "leak": leak}
    p, n, found = judged("All is fine. This is bad! Good day.", model, Weights(model))
    assert p > 0.8 and n == 3 and [f[:2] for f in found] == [(12, 12)]
    whole = 1 - (1 / (1 + math.exp(leak))) * math.prod(1 - 1 / (1 + math.exp(-(bias + (float(w[0]) if i == 1 else 0)))) for i in range(3))
    assert math.isclose(p, whole, rel_tol=1e-9)


@pytest.mark.parametrize("sf, recall, precision", [("sf0.1", 0.85, 0.85)])
def test_held_out_accuracy(spark, sf, recall, precision):
    held_out = is_held_out("doc_id", 4, 2)
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs.where(~held_out), labels.where(~held_out))
    got = score(docs.where(held_out).join(labels, "doc_id"), model).select("toxic", "score").collect()
    hit = sum(r["toxic"] == 1 and r["score"] >= 0.3 for r in got)
    assert hit >= recall * sum(r["toxic"] for r in got) and hit >= precision * sum(r["score"] >= 0.3 for r in got)


def test_edge_rows(spark):
    rows = [(i, "You fool. Go away." if i % 2 else "Good day. Come in.", 1.0) for i in range(40)]
    rows += [(40, None, 1.0), (41, "", 1.0), (42, "?!.\n", 1.0), (43, "Good day. " * 30_000 + "You fool", 1.0), (None, "fool", 1.0), (1, "You fool. Go away.", 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, None), (None, 1), (40, 1), (1, 0)], "doc_id long, toxic int")
    model = fit(df, labels)
    got = {(r["doc_id"], (r["text"] or "")[:9]): r for r in score(df, model).collect()}
    leak = 1 - 1 / (1 + math.exp(model["leak"]))
    assert all(math.isclose(got[k]["score"], leak, rel_tol=1e-9) for k in [(40, ""), (41, ""), (42, "?!.\n")])
    assert got[1, "You fool."]["score"] > 0.5 > got[2, "Good day."]["score"] and got[43, "Good day."]["offending"][0]["start"] == 299_999
    assert score(df.limit(0), model).count() == 0 and score(df, fit(df, labels.limit(0))).where("score > 0.01").count() == 0
    assert fit(df, labels.where("toxic = 1"))["words"] == {}
