import random

import numpy as np

from gleanery.llm.near_dup import damped, near_classes, one_of_each, prob_min_hash, shingles


def test_registers_estimate_probability_jaccard():
    r = np.random.default_rng(1)
    x, y = {int(e): int(r.integers(1, 5)) for e in range(1, 60)}, {int(e): int(r.integers(1, 5)) for e in range(30, 80)}
    sketch = lambda s: prob_min_hash(np.array([*s], np.uint64) * np.uint64(0x9E3779B97F4A7C15), np.array([*s.values()]), 4096)
    got = (sketch(x) == sketch(y)).mean()
    want = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x | y) for d in x.keys() & y.keys())
    assert abs(got - want) < 0.035, (got, want)


def brute(texts, similarity=0.8):
    sets = [set(shingles(t.split(), 5)[0].tolist()) if t and t.split() else None for t in texts]
    up = list(range(len(texts)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))]


def test_classes_by_brute_force(spark):
    r, texts = random.Random(2), []
    for g in range(40):
        base = [f"w{r.randrange(400)}" for _ in range(r.randrange(30, 120))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 40 if g == 7 else 2])):
            t = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 8])):
                t[r.randrange(len(t))] = "new%d" % r.randrange(9999)
            texts.append(" ".join(t))
    df = spark.createDataFrame([(i, t.encode().decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x["class_id"] for x in near_classes(df).collect()}
    want = brute([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want


def test_small_table_by_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    want = brute([t.encode() for _, t in rows])
    got = {x["doc_id"]: (x["class_id"], x["kept"]) for x in near_classes(docs).collect()}
    assert [got[d] for d, _ in rows] == [(rows[w][0], w == i) for i, w in enumerate(want)]
    assert one_of_each(docs).count() == len(set(want))


def test_edge_rows(spark):
    long = "one two three four five six seven eight " * 15_000
    rows = [(1, None, 0), (2, "", 0), (3, "a b", 0), (3, "a  b", 0), (None, "a b", 0), (5, long, 0), (6, long + "nine", 0), (7, "b a", 0), (8, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int").coalesce(2)
    got = [(r["doc_id"], r["class_id"], r["kept"]) for r in near_classes(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 1, True), (2, 2, True), (3, 3, True), (3, 3, False), (None, 3, False), (5, 5, True), (6, 5, False), (7, 7, True), (8, 8, True)], key=str)
    assert near_classes(df.limit(0)).count() == 0


def test_repeated_passages_do_not_hide_links(spark):
    r, texts = random.Random(5), []
    for _ in range(20):
        base = [f"w{r.randrange(10**6)}" for _ in range(204)]
        texts += [" ".join(base), " ".join(base[:160] + base[120:160] * 20 + base[160:])]
    got = {x["doc_id"]: x["class_id"] for x in near_classes(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()}
    want = brute([t.encode() for t in texts])
    assert [got[i] for i in range(len(texts))] == want == [i // 2 * 2 for i in range(len(texts))]


def probability_jaccard(x, y):
    return sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in x | y) for d in x.keys() & y.keys())


def test_weights_follow_counts_within_a_bound():
    r = random.Random(11)
    assert damped(np.array([1, 2, 10**6])).tolist() == [1, 1.25, 1.5 - 0.5 / 10**6]
    for _ in range(200):  # the same shingles, however their counts differ, stay close
        n = r.randrange(1, 60)
        x, y = ({e: float(damped(np.array(r.choice([1, 2, 50, 10**5])))) for e in range(n)} for _ in "xy")
        assert probability_jaccard(x, y) > 0.79
    one = {e: 1.0 for e in range(60)}
    assert min(probability_jaccard(one, {e: 1.5 if e < k else 1.0 for e in range(60)}) for k in range(61)) > 0.89


def test_recall_of_a_stated_query_set(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    sets = {d: set(shingles(t.encode().split(), 5)[0].tolist()) for d, t in rows if t and t.split()}
    got = {x["doc_id"]: x["class_id"] for x in near_classes(docs).collect()}
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    assert sum(got[a] == got[b] for a, b in links) == len(links)
