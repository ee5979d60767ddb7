import numpy as np

from gleanery.llm.langid import Ftrl, fit, grams, identify, is_held_out, softmax, temperature


def test_grams_and_letters():
    assert grams(None, 64) is None and grams("12 %% 3", 64) is None
    at, n = grams("ab ab", 1 << 15)
    assert n.sum() == 2 * len(" ab ab ") - 3 and (at[:-1] < at[1:]).all()


def test_ftrl_separates_and_is_sparse():
    rng, m = np.random.default_rng(1), Ftrl(50, 2, 0.5, 1.0, 0.5, 0.01)
    for _ in range(400):
        y = int(rng.integers(2))
        m.learn(np.array([y, 5 + int(rng.integers(40))]), np.array([0.9, 0.4]), y)
    w = m.weights(slice(None))
    assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0] and (w == 0).sum() > 20


def test_temperature_is_the_best_on_a_grid():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(300, 3)) * 4
    y = np.array([rng.choice(3, p=softmax(r / 2)) for r in z])
    loss = lambda t: -np.log(softmax(z / t)[np.arange(300), y]).mean()
    assert loss(temperature(z, y)) <= min(loss(t) for t in np.linspace(0.3, 6, 60)) + 1e-4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", is_held_out())
    model = fit(docs.where("NOT held_out"))
    got = identify(docs, model).where("held_out AND lang IS NOT NULL").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in got)
    assert right >= 0.97 * len(got), (right, len(got))
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_rows(spark):
    rows = [(1, None, "en", 1.0), (2, "", "de", 1.0), (3, "123", None, 1.0), (4, "the " * 60_000, "en", 1.0), (4, "the cat", "en", 1.0), (None, "und der", "de", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r["text"]: r for r in identify(df, fit(df)).collect()}
    assert got[None]["lang_pred"] == got[""]["lang_pred"] == got["123"]["lang_pred"] == "und"
    assert got["the cat"]["lang_pred"] == "en"
    empty = df.limit(0)
    assert identify(empty, fit(empty)).count() == 0 and identify(df, fit(empty)).where("lang_pred <> 'und'").count() == 0
