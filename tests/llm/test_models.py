"""Language identification and toxicity: held-out accuracy, mixtures and edge cases."""

import math
import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from flowlens.llm import langid, queries, toxicity, words as W

DATA = "/root/testdata/sf0.01"


def test_languages_held_out(spark):
    found = queries.op3_langid(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    right = found.join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert right[0] > 0.97 and 0 <= right[1] and right[2] <= 1


def test_language_mixture_and_edges(spark):
    train = [(i, f"{a} {b}", lang) for lang, words in (("aa", ["kato", "mika", "toka"]), ("bb", ["wersh", "blint", "quorsh"])) for i, a in enumerate(words) for b in words]
    model = langid.train(spark.createDataFrame([*train, (9, None, "aa"), (9, "kato", None)], "doc_id long, text string, lang string"))
    assert model.names == ["aa", "bb"]
    mixed = "kato mika toka " * 30 + "wersh blint " * 15
    rows = [(1, "kato toka mika"), (2, mixed), (3, "12 34 !?"), (4, None), (5, ""), (5, "wersh " * 20_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, score string")
    got = {r.text: r for r in langid.identify(docs, model).collect()}
    assert got["kato toka mika"].lang_pred == "aa" and got["kato toka mika"].score == 1.0
    assert abs(got[mixed].score - 0.75) < 0.05 and set(got[mixed].lang_shares) == {"aa", "bb"}
    assert [got[t].lang_pred for t in ("12 34 !?", None, "")] == ["und"] * 3
    assert got["wersh " * 20_000].lang_pred == "bb"
    assert langid.identify(docs.limit(0), model).count() == 0
    nothing = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify(docs, nothing).collect()} == {"und"}


def test_text_of_five_languages(spark):
    words = {"aa": "kato mika toka", "bb": "wersh blint quorsh", "cc": "zuzy vyzu yvuz", "dd": "dodeg gedod dagge", "ee": "finnin innif nifin"}
    model = langid.train(spark.createDataFrame([(t, lang) for lang, t in words.items()], "text string, lang string"))
    counts = dict(zip(words, (90, 60, 50, 40, 30)))
    mixed = " ".join(f"{words[lang]} " * (n // 3) for lang, n in counts.items())
    share = langid.proportions(model, [mixed, "kato mika", mixed])
    assert np.allclose(share[0], [n / 270 for n in counts.values()], atol=0.02)
    # A text's result does not hang on its neighbours.
    assert np.array_equal(share[0], share[2]) and np.allclose(share[0], langid.proportions(model, [mixed])[0], atol=1e-12)
    assert (share[1] > 0).sum() == 1


def _slow_mixture(model, text):
    """Proportions of a text word by word: the best nested set by penalised likelihood, estimated in plain loops."""
    runs = re.findall(r"[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text.lower())
    like = []
    for word in runs:
        buf, starts, ends, _ = W.split([word.encode()], "letters", lower=True)
        cells, _ = langid._trigrams(buf, starts, ends)
        logs = model.cells[cells].sum(axis=0)
        like.append([math.exp(max(x - max(logs), -60.0)) for x in logs])

    def settle(allowed):
        share = [a / sum(allowed) for a in allowed]
        while True:
            sums = [0.0] * len(share)
            for p in like:
                total = sum(a * b for a, b in zip(p, share))
                sums = [s + a * b / total for s, a, b in zip(sums, p, share)]
            new = [s / len(like) for s in sums]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved <= langid.SETTLED:
                return share, sum(math.log(sum(a * b for a, b in zip(p, share))) for p in like)

    n = len(model.names)
    full, _ = settle([1] * n)
    order = sorted(range(n), key=lambda i: -full[i])
    tried = []
    for size in range(1, n + 1):
        share, fit = settle([int(i in order[:size]) for i in range(n)])
        tried.append((fit - (size - 1) * (0.5 * math.log(len(like)) + math.log(n)), -size, share))
    return max(tried)[2]


def test_mixture_equals_slow_reference(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.train(docs)
    texts = [r.text for r in docs.where("length(text) BETWEEN 20 AND 3000").orderBy("doc_id").limit(40).collect()]
    texts += [f"{a[:400]} {b[:250]} {c[:150]}" for a, b, c in zip(texts, texts[7:], texts[19:])][:25]
    for text, share in zip(texts, langid.proportions(model, texts)):
        assert np.allclose(share, _slow_mixture(model, text), atol=1e-6), text[:80]


def test_letters_are_a_category(spark):
    """Signs that Python counts as word characters, but that are no letters, make no language."""
    model = langid.train(spark.createDataFrame([("kato mika", "aa"), ("wersh blint", "bb")], "text string, lang string"))
    docs = spark.createDataFrame([("² ½ ①",), ("ª kato",), ("٣٤",)], "text string")
    got = {r.text: r.lang_pred for r in langid.identify(docs, model).collect()}
    assert got["² ½ ①"] == got["٣٤"] == "und" and got["ª kato"] != "und"


def test_language_stage_without_labels(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Ein Text", None), (2, None, None), (3, "12 !", None), (4, "слово", None)], "doc_id long, text string, lang string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.language_stage(spark, docs, str(tmp_path)).collect()) == [1, 4]


def test_toxicity_held_out(spark):
    found = queries.op9_toxicity(spark, DATA)
    labels = spark.read.parquet(f"{DATA}/labels.parquet").select("doc_id", "toxic")
    rows = found.join(labels, "doc_id").collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == r.toxic for r in rows if r.held_out]) > 0.85


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = toxicity.Network(np.zeros(toxicity.WORD_CELLS, np.float32), np.zeros(toxicity.CHAR_CELLS, np.float32))
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    x = rng.standard_normal((9, 2 * toxicity.WIDTH + 2))
    at, mask = rng.integers(0, 9, (4, toxicity.WINDOW)), np.ones((4, toxicity.WINDOW))
    mask[1, 5:] = 0
    y = np.array([0.0, 1.0, 1.0, 0.0])
    loss = lambda: float(np.mean(np.log1p(np.exp(-(2 * y - 1) * net.forward(x, at, mask)))))
    g = net.gradients(x, at, mask, y)
    for name in ("Wf", "Ub", "bf", "A", "v", "w", "c"):
        place = tuple(rng.integers(0, s) for s in net.p[name].shape)
        net.p[name][place] += 1e-3
        up = loss()
        net.p[name][place] -= 2e-3
        down = loss()
        net.p[name][place] += 1e-3
        assert abs((up - down) / 2e-3 - g[name][place]) < 2e-3, name


def test_toxicity_edges(spark):
    rng = np.random.default_rng(3)
    filler = lambda: " ".join(rng.choice(["word", "fine", "day", "clear", "a"], 40))
    texts = [f"{filler()} idiot {filler()}" for _ in range(60)] + [f"{filler()} {filler()}" for _ in range(140)]
    net = toxicity.learn(texts, np.array([1] * 60 + [0] * 140))
    rows = [(1, None), (2, ""), (3, "a fine day"), (4, "word " * 9000 + "idiot fool " + "word " * 9000), (4, "a fine day")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, score int")
    got = toxicity.score(docs, net).collect()
    assert len(got) == 5 and [r.predicted for r in sorted(got, key=lambda r: r.doc_id) if r.doc_id < 4] == [0, 0, 0]
    assert max(r.predicted for r in got if r.doc_id == 4) == 1
    assert toxicity.score(docs.limit(0), net).count() == 0
    same = toxicity.learn(["a", "b"], np.array([0, 0]))
    assert all(0 <= s <= 1 for s in same.scores(["a", None]))


def test_windows_cover_every_word():
    for n in range(0, 200):
        held = {p for s in toxicity.window_starts(n) for p in range(s, min(n, s + toxicity.WINDOW))}
        assert held == set(range(n))
