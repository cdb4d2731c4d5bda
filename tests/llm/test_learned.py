"""Rejection and severity on made-up texts whose answers are known."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from spanloom.llm import langid, toxicity  # noqa: E402


def made_up(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_texts_of_two_languages_are_rejected(spark, monkeypatch):
    monkeypatch.setattr(langid, "KEEP", 1)
    rng = random.Random(2)
    tongues = {"aa": ["ba", "lo", "mi", "ne"], "bb": ["schr", "ung", "kei", "ter"], "cc": ["ço", "éx", "où", "vie"]}
    rows = [(k, made_up(rng, tongues[lang], rng.randrange(3, 40)), lang) for k in range(600) for lang in [rng.choice(list(tongues))]]
    # labels are wrong for texts that hold two languages in equal parts: what is like them must be rejected
    mixed = [(1000 + k, made_up(rng, tongues["aa"], 9) + " " + made_up(rng, tongues["bb"], 3), rng.choice(["aa", "bb"])) for k in range(60)]
    model = langid.fit(spark.createDataFrame(rows + mixed, "doc_id long, text string, lang string"))
    fresh = [(k, made_up(rng, tongues[lang], 30), lang) for k in range(60) for lang in [rng.choice(list(tongues))]]
    fresh += [(100 + k, made_up(rng, tongues["aa"], 9) + " " + made_up(rng, tongues["bb"], 3), None) for k in range(60)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(fresh, "doc_id long, text string, lang string"), model).collect()}
    assert all(got[k].lang_pred == lang and not got[k].rejected for k, _, lang in fresh if lang)
    assert sum(got[k].rejected for k, _, lang in fresh if not lang) > 15


def test_calibration_cuts_off_errors():
    model = langid.Model(["a", "b"], np.array([[3.0, 0.0], [0.0, 3.0], [0.2, 0.0]], np.float32), np.zeros(2))
    one = lambda k, lang: (np.array([k], np.int32), np.ones(1, np.float32), lang)
    langid.calibrate(model, [one(0, 0)] * 50 + [one(1, 1)] * 50 + [one(2, 0)] * 1 + [one(2, 1)] * 80)
    z = np.array([0.2, 0.0]) / model.temperature
    assert np.exp(z[0]) / np.exp(z).sum() < model.threshold < 1 / (1 + np.exp(-3 / model.temperature))


def test_near_copies_are_in_one_fold():
    fps = [5, 5 ^ 1, 5 ^ 3, (1 << 62) - 77, ((1 << 62) - 77) ^ 1 << 9, -9]
    fold = langid._folds(fps)
    assert fold[0] == fold[1] == fold[2] and fold[3] == fold[4] and langid._folds([]) == []


def test_planted_toxic_documents(spark):
    rng = random.Random(5)
    plain, bad = [f"word{k}" for k in range(300)], ["idiotic", "moronic", "vilest", "scummy"]
    rows, labels = [], []
    for k in range(700):
        words = [rng.choice(plain) for _ in range(rng.randrange(10, 80))]
        toxic = k % 7 == 0
        for _ in range(rng.choice([1, 2, 6]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((k, " ".join(words)))
        if k < 400:
            labels.append((k, int(toxic)))
    got = {r.doc_id: r for r in toxicity.severity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    fresh = range(400, 700)
    found = [k for k in fresh if k % 7 == 0 and got[k].toxic]
    assert len(found) >= 0.9 * sum(k % 7 == 0 for k in fresh) and not any(got[k].toxic for k in fresh if k % 7)
    many = [got[k].severity for k in fresh if sum(w in bad for w in rows[k][1].split()) >= 6]
    one = [got[k].severity for k in fresh if sum(w in bad for w in rows[k][1].split()) == 1]
    assert np.mean(many) > np.mean(one) + 0.5


def test_labels_without_telling_words(spark):
    docs = spark.createDataFrame([(k, f"text number {k}") for k in range(8)], "doc_id long, text string")
    both = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    got = toxicity.severity(docs, both).collect()
    assert len({r.severity for r in got}) == 1 and 0 < got[0].severity < 3 and not any(r.toxic for r in got)
    got = toxicity.severity(docs, both.filter("toxic = 0")).collect()
    assert {(r.severity, r.grade, r.toxic) for r in got} == {(0.0, 0, False)}
