"""Reading levels: features, trees, calibration and held-out accuracy."""

import numpy as np

from lexiloom.llm import boosting as b
from lexiloom.llm import readability as r
from lexiloom.llm import reading
from lexiloom.llm import reading_queries as q

LEVELS = {"dog": 1, "policy": 3}


def test_features_and_sentences():
    assert r.sentences("# Unit 3: Anna\n- I see a dog. Is it?\nAnna: No!\nSee https://x.invalid/u1 <b>now</b>") == ["I see a dog.", "Is it?", "No!", "See    now "]
    assert [r.word_level(w, LEVELS) for w in ("dog", "dogs", "policies", "of", "heterogeneity")] == [1, 1, 3, 0, r.BEYOND]
    x = dict(zip(r.NAMES, r.features("The dog is in the house. Ｔhe d​og is not.", LEVELS, {})))
    assert x["n_sentences"] == 2 and x["n_words"] == 10 and x["words_mean"] == (36 + 16) / 10 and x["overlap"] == 1
    for text in ("", "  \n ", "12 34", "____", "日本語", "word " * 100_000, "A" * 300_000):
        x = r.features(text, LEVELS, {})
        assert len(x) == len(r.NAMES) and np.isfinite(x).all()


def test_boosting_learns_and_isotonic_ascends():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 6))
    y = (x[:, 0] > 0.5).astype(float) + (x[:, 1] > 0.3) * (x[:, 0] > 0.5) + rng.normal(0, 0.1, 2000)
    forest = b.fit(x[:1500], y[:1500], np.ones(1500))
    assert np.mean((forest.predict(x[1500:]) - y[1500:]) ** 2) < 0.08
    s, v = b.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]), np.ones(4))
    assert v.tolist() == [0, 1.5, 3] and (np.diff(s) > 0).all()
    assert b.fit(x[:0], y[:0], np.ones(0), trees=3).predict(x[:2]).tolist() == [0, 0]
    assert np.allclose(b.fit(x[:50] * 0, y[:50], np.ones(50), trees=3).predict(x[:1] * 0), y[:50].mean(), atol=0.5)


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    s, y, w = np.sort(rng.random(12)), rng.random(12), rng.random(12) + 0.5
    fitted = b.calibrated(b.isotonic(s, y, w), s)
    assert (np.diff(fitted) >= -1e-12).all()
    # the fit at i is the max over starts of the min over ends of the weighted means
    mean = lambda i, j: np.average(y[i : j + 1], weights=w[i : j + 1])
    ends = set(b.isotonic(s, y, w)[0])
    for k in range(12):
        if s[k] in ends:
            assert np.isclose(fitted[k], max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)))


def test_tables(spark, folder):
    rows = q.p8_found(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    want = sorted(d.doc_id for d in docs if d.lang and d.lang.strip().lower().startswith("en") and (d.n_chars or 0) >= 200)
    assert sorted(x.doc_id for x in rows) == want and {x.band for x in rows} <= set(reading.BANDS)
    assert sum(x.n_documents for x in q.p8_profile(spark, folder).collect()) == len(want)


def test_held_out_agreement_with_raters(spark):
    """Raters name another band about once in fifteen; held-out bands agree with them about as often as they agree with the truth."""
    rows = q.p8_validation(spark, "/root/testdata/sf0.1").collect()
    assert sum(x.n_documents * x.agreement for x in rows) / sum(x.n_documents for x in rows) > 0.88


def test_nulls_no_labels_and_empty(spark):
    text = "The dog is in the house. " * 20
    schema = "doc_id long, text string, lang string, source string, n_chars long, grade int, x int"
    docs = spark.createDataFrame([(1, text, " EN-us", None, 500, 1, 1), (1, text, "en", "s", 500, 1, 1), (2, None, "en", "s", None, 1, 1), (3, text, None, "s", 500, 1, 1), (4, text, "ja", "s", 500, 1, 1), (5, "x", "en", "s", 1, 1, 1)], schema)
    labels = spark.createDataFrame([(1, "r1", "easy"), (1, "r2", "odd"), (1, None, None), (9, "r", "hard")], "doc_id long, rater string, band string")
    table = reading.feature_table(reading.eligible(docs), LEVELS)
    model, _ = reading.train(reading.labelled(table, labels))
    assert [(r.doc_id, r.band) for r in reading.score(table, model).collect()] == [(1, "easy")] * 2
    none, _ = reading.train(reading.labelled(table, labels.limit(0)))
    assert [(r.doc_id, r.band) for r in reading.score(table, none).collect()] == [(1, None)] * 2
    empty = reading.feature_table(reading.eligible(docs.limit(0)), LEVELS)
    assert reading.score(empty, reading.train(reading.labelled(empty, labels))[0]).count() == 0
