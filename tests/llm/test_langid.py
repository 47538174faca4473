import math
import random

import numpy as np

from tessera.llm import langid as L

SYLLABLES = {"aa": ["the", "ing", "and", "th", "er"], "bb": ["sch", "ung", "der", "ich", "ö"], "cc": ["ción", "os", "ñ", "que", "ar"]}


def text(lang, rng, n=30):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(n))


def corpus(n=400):
    rng = random.Random(1)
    return [(k, text(lang, rng), lang) for k in range(n) for lang in [rng.choice([*SYLLABLES])]]


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus() + [(9001, None, "aa"), (9002, "", "aa"), (9003, "123 !?", "bb"), (9004, text("cc", random.Random(8), 20_000), None), (9005, "a", None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.identify(docs, L.train(docs)).collect()}
    want = {d: lang for d, _, lang in corpus()}
    held = [r.doc_id for r in docs.filter(L.held_out()).collect() if r.doc_id in want]
    assert sum(got[d].lang_pred == want[d] for d in held) >= 0.95 * len(held)
    assert all((got[d].lang_pred, got[d].score) == ("und", 0.0) for d in (9001, 9002, 9003))
    assert got[9004].lang_pred == "cc" and got[9005].lang_pred in SYLLABLES
    assert all(0 <= r.score <= 1 for r in got.values())


def test_grams_stay_inside_their_text():
    many = ["ab", "", "c", "defg 1 h"]
    together = L.grams(many)
    for (rows, n), order in zip(together, L.NGRAMS):
        at = 0
        for t, k in zip(many, n):
            alone = L.grams([t], (order,))[0]
            assert alone[0].tolist() == rows[at : at + k].tolist() and alone[1].tolist() == [k]
            at += k
        assert at == len(rows)


def test_weights_are_sparse_and_no_labels_mean_und(spark):
    m = L.fit([t for _, t, _ in corpus()], [x for *_, x in corpus()])
    assert (m.weights == 0).mean() > 0.5
    docs = spark.createDataFrame([(1, "words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in L.identify(docs, L.train(docs)).collect()] == [(1, "und", 0.0)]
    assert L.identify(docs.limit(0), m).collect() == []


def test_training_reads_texts_past_a_long_opening(spark):
    rng = random.Random(3)
    opening = text("aa", rng, 1500)  # the same in every text, whatever its label
    assert len(opening) > 4000
    docs = spark.createDataFrame([(k, f"{opening} {text(lang, rng, 1500)}", lang) for k in range(150) for lang in [("bb", "cc")[k % 2]]], "doc_id long, text string, lang string")
    m = L.train(docs)
    assert sum(m.predict([f"{opening} {text(lang, rng, 1500)}"])[0] == [lang] for lang in ("bb", "cc") for _ in range(20)) >= 38


def test_marks_belong_to_their_words():
    assert L._letters("สวัสดี नमस्ते e\u0301!") == " สวัสดี नमस्ते e\u0301 "
    assert L._letters("\u0301\u0301 12") == ""
    assert L.Model(["aa"], np.zeros((8, 1)), np.zeros(1), 1.0).predict(["\u0301", "ā"])[0] == ["und", "aa"]


def test_ftrl_matches_a_plain_one():
    """Coordinate by coordinate, as the update is written down."""
    rng = np.random.default_rng(5)
    rows, classes, alpha, beta, l1, l2 = 6, 3, 0.4, 1.0, 0.4, 0.1
    model = L.Ftrl(rows, classes, alpha, beta, l1, l2)
    z, n = np.zeros((rows, classes)), np.zeros((rows, classes))

    def weight(i, c):
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - (l1 if z[i, c] > 0 else -l1)) / ((beta + math.sqrt(n[i, c])) / alpha + l2)

    for _ in range(60):
        touched = np.sort(rng.choice(rows, 3, replace=False))
        gradient = rng.normal(size=(3, classes)) * 0.2
        model.step(touched, gradient)
        for g, i in zip(gradient, touched):
            for c in range(classes):
                w = weight(i, c)
                sigma = (math.sqrt(n[i, c] + g[c] ** 2) - math.sqrt(n[i, c])) / alpha
                z[i, c] += g[c] - sigma * w
                n[i, c] += g[c] ** 2
    want = np.array([[weight(i, c) for c in range(classes)] for i in range(rows)])
    assert np.allclose(model.weights(), want) and (want == 0).any() and (want != 0).any()


def test_temperature_makes_the_held_out_loss_least():
    many, labels = [t for _, t, _ in corpus()], [x for *_, x in corpus()]
    m = L.fit(many, labels)
    keep = [i for i in range(len(many)) if i % 5 == 4]
    y = [m.classes.index(labels[i]) for i in keep]
    z, _ = m.logits([many[i] for i in keep])
    loss = lambda t: -np.log(L.softmax(z / t)[np.arange(len(y)), y]).mean()
    assert all(loss(m.temperature) <= loss(t) + 1e-3 for t in (m.temperature * 0.8, m.temperature * 1.25))
