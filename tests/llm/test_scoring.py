import math
import random
from collections import Counter

import numpy as np
import pytest

from factgraph.llm import langid, lm, quality, toxicity
from factgraph.llm.common import fraction_filter


def test_measures():
    names = quality.FEATURES
    got = dict(zip(names, quality.measure("a b c a b c d\nx\nx\n\n é! #".encode()), strict=True))
    assert got["n_words"] == 11 and got["word_chars"] == 12 and got["n_dup_lines"] == 1 and got["n_repeat_words"] == 6 and got["n_symbols"] == 1
    assert quality.measure(b"") == (0,) * len(names)
    assert dict(zip(names, quality.measure(b"a a a a"), strict=True))["n_repeat_words"] == 4


def test_upper_bound_is_clopper_pearson():
    for bad, n in ((0, 50), (3, 200), (10, 40)):
        p = quality.upper_bound(bad, n, 0.05)
        below = sum(math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(bad + 1))
        assert below == pytest.approx(0.05, rel=1e-6)
    assert quality.upper_bound(5, 5, 0.05) == 1.0 and quality.upper_bound(0, 0, 0.05) == 1.0


def test_quality_cutoffs_hold_their_risk(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(3000):
        good = i % 3 != 0
        words = [f"w{rng.randrange(5000)}" + ("" if good and rng.random() > 0.002 else "##") for _ in range(80)]
        docs.append((i, " ".join(words), "en" if i % 10 else None, "s"))
        labels.append((i, int(good)))
    docs += [(9001, None, "xx", "s"), (9002, "", "xx", "s"), (9001, None, "xx", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, kept string")
    marks = spark.createDataFrame([*labels, (0, 0), (None, None)], "doc_id long, quality int")
    rows = quality.quality_rules(df, marks).collect()
    assert len(rows) == len(docs)
    verdict = {r["doc_id"]: r for r in rows}
    assert sum(not verdict[i]["kept"] for i, g in labels if g) <= 0.05 * 2000
    assert sum(not verdict[i]["kept"] for i, g in labels if not g and i % 10) > 800
    assert verdict[9001]["base_failed"] and not verdict[9001]["kept"] and verdict[9001]["n_words"] == 0
    kept = quality.keep_good(df, marks).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(r["doc_id"] for r in rows if r["kept"]) and kept[0].asDict().keys() == set(df.columns)
    assert quality.quality_rules(df.limit(0), marks.limit(0)).count() == 0


def test_quality_without_labels_keeps_what_passes_the_base(spark):
    df = spark.createDataFrame([(1, "##a " * 60, "en"), (2, " ".join(f"#w{i}" for i in range(60)), "en")], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df, spark.createDataFrame([], "doc_id long, quality int")).collect()}
    assert rows[1]["base_failed"] and rows[2]["kept"]


LANGUAGES = {"aa": ["ba", "bo", "ri", "ta"], "bb": ["kel", "mon", "dur", "fis"], "cc": ["ñu", "ço", "éa", "ûl"]}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(LANGUAGES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_languages(spark):
    rng = random.Random(2)
    train = [(i, tongue(rng, lang, 60), lang) for i, lang in enumerate(list(LANGUAGES) * 30)] + [(900, None, "aa"), (901, "x", None)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    held = [(i, tongue(rng, lang, 20), lang) for i, lang in enumerate(list(LANGUAGES) * 20)]
    extra = [(1000, None, None), (1001, "123 --", "aa"), (1002, "", None), (1003, "wxyz qqq jjj vvw " * 40, None), (1004, tongue(rng, "bb", 30_000), "bb")]
    rows = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(held + extra, "doc_id long, text string, score string"), model).collect()}
    assert all(rows[i]["lang_pred"] == lang and not rows[i]["rejected"] for i, _, lang in held)
    assert rows[1000]["lang_pred"] == rows[1001]["lang_pred"] == rows[1002]["lang_pred"] == "und" and rows[1000]["score"] == 0
    assert rows[1003]["rejected"] and rows[1004]["lang_pred"] == "bb"
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0
    assert langid.train(spark.createDataFrame([], "doc_id long, text string, lang string")) is None


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOGETHER", 2)
    rng = random.Random(4)
    names = {f"l{i:02}": [f"{chr(97 + i)}{a}{b}" for a in "aeiou" for b in "lmnr"] for i in range(7)}
    text = lambda words: " ".join(rng.choice(words) for _ in range(40))
    rows = [(i * 100 + k, text(w), name) for i, (name, w) in enumerate(names.items()) for k in range(20)]
    df = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.model.languages == sorted(names) and len(model.model.parts) == 4
    got = langid.identify(spark.createDataFrame([(i, text(w), name) for i, (name, w) in enumerate(names.items())], "doc_id long, text string, want string"), model, keep=("want",)).collect()
    assert all(r["lang_pred"] == r["want"] for r in got)
    assert [model.predict([rows[0][1]])[1].tolist()] * 2 == [model.predict([rows[0][1]] * 2)[1].tolist()[:1]] * 2


def test_kneser_ney_sums_to_one():
    rng = random.Random(3)
    model = langid.KneserNey(["aa", "bb"], [[tongue(rng, "aa", 50)], [tongue(rng, "bb", 50)]])
    letters = sorted({c for s in LANGUAGES["aa"] + LANGUAGES["bb"] for c in s} | {" "})
    for context in ("ba", "rit", "kelmo"):
        e0, n0, _ = model.cross_entropy([context])
        total = np.zeros(2)
        for c in letters:
            e, n, _ = model.cross_entropy([context + c])
            total += np.exp(-(e[0] * n[0] - e0[0] * n0[0]))
        assert (total < 1.0 + 1e-3).all() and (total > 0.85).all()  # the rest is left for letters never seen


def test_toxicity_learns_and_locates(spark):
    rng = random.Random(6)
    plain = [f"word{i}" for i in range(400)]
    docs, labels = [], []
    for i in range(900):
        sentences = [" ".join(rng.choice(plain) for _ in range(6)) + "." for _ in range(5)]
        toxic = i % 5 == 0
        if toxic:
            sentences[i % 4] = f"you {rng.choice(['fool', 'moron', 'scum'])} here."
        docs.append((i, " ".join(sentences)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame([*docs, (9000, None), (9001, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(df.where("doc_id % 3 <> 0"), marks.where("doc_id % 3 <> 0"))
    rows = {r["doc_id"]: r for r in toxicity.score_toxicity(df, model).collect()}
    held = [(i, y) for i, y in labels if i % 3 == 0]
    assert sum((rows[i]["score"] >= 0.3) == bool(y) for i, y in held) >= 0.97 * len(held)
    for i, y in held:
        if y and rows[i]["score"] >= 0.3:
            worst = rows[i]["offending"][0]
            assert docs[i][1][worst["start"] : worst["end"]] == worst["sentence"] and worst["sentence"].startswith("you ")
    assert 0 <= rows[9000]["score"] == rows[9001]["score"] < 0.3
    p, parts = model.score(docs[0][1])
    assert p == pytest.approx(1 - math.prod(1 - x for _, _, x in parts), abs=1e-9)
    assert toxicity.train(df.limit(0), marks.limit(0)).score("a")[0] < 0.3


def test_toxicity_knows_endings_never_seen(spark):
    rng = random.Random(3)
    docs = []
    for i in range(600):
        lines = [" ".join(f"word{rng.randrange(300)}" for _ in range(5)).replace("0", "o") + "." for _ in range(4)]
        if i % 4 == 0:
            lines[2] = f"so grumbel{''.join(rng.choice('abcdefgh') for _ in range(5))} it is."
        docs.append((i, "\n".join(lines), int(i % 4 == 0)))
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(df, df)
    assert model.starts and model.score("It is\nquite GRUMBELxyzzy here.")[0] > 0.3 > model.score("It is quite fine here.")[0]
    p, parts = model.score("Fine.\nquite grumbelzz here.\nFine.")
    assert len(parts) == 3 and max(parts, key=lambda x: x[2])[:2] == (6, 27) and parts[0][2] == parts[2][2]
    assert model.score("")[1] == [(0, 0, pytest.approx(1 / (1 + math.exp(-model.bias))))]


def test_pseudo_likelihood(spark):
    rng = random.Random(8)
    texts = [" ".join(w for _ in range(20) for w in rng.choice([("the", "cat", "sat"), ("a", "dog", "ran")])) for _ in range(400)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = lm.vocabulary(df)
    net = lm.train(df, words, train_share=1.0, rounds=3, batch=128)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in texts[:40]]
    probe = spark.createDataFrame([*((i, t) for i, t in enumerate(texts[:40])), *((100 + i, t) for i, t in enumerate(shuffled)), (500, None), (501, ""), (502, "dog " * 9000)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm.score_documents(probe, net, words).collect()}
    assert np.mean([rows[i]["mean_log_prob"] - rows[100 + i]["mean_log_prob"] for i in range(40)]) > 1
    assert rows[500]["sum_log_prob"] == 0 == rows[501]["n_words"] and rows[502]["n_words"] == 9000
    hashes, bounds = next(lm.word_hashes([texts[0].encode()]))
    ids = words.ids(hashes)
    total = 0.0
    for i, target in enumerate(ids):  # word by word
        around = [ids[j] if 0 <= j < len(ids) else 0 for j in (i - 2, i - 1, i + 1, i + 2)]
        _, _, z = lm.forward(net, np.array([around]))
        total += float(z[0, target] - np.log(np.exp(z[0]).sum()))
    assert (words.shares(hashes, ids) == 0).all()  # the few words here have classes of their own
    assert rows[0]["sum_log_prob"] == pytest.approx(total, rel=1e-4)
    assert lm.score_documents(df.limit(0), net, words).count() == 0


def test_every_word_has_its_share_of_its_class(spark):
    rng = random.Random(5)
    tokens = [f"w{rng.randrange(400) * rng.randrange(400)}" for _ in range(9000)]
    texts = [" ".join(tokens[i : i + 90]) for i in range(0, 9000, 90)]
    df = spark.createDataFrame([*enumerate(texts), (0, texts[0]), (900, None), (901, "")], "doc_id long, text string")
    counts = Counter(t for text in [*texts, texts[0]] for t in text.split())
    names = list(counts)
    hashes = np.concatenate([h for h, _ in lm.word_hashes([" ".join(names).encode()])])
    for most in (1 << 20, 300):
        words = lm.vocabulary(df, most=most)
        assert len(words.known) <= most
        ids = words.ids(hashes)
        share = np.exp(words.shares(hashes, ids))
        for c in np.unique(ids):  # the words of a class share all of it
            assert share[ids == c].sum() == pytest.approx(1, rel=1e-4)
        known = np.isin(hashes, words.known)
        for i in np.flatnonzero(known).tolist():
            inside = sum(counts[names[j]] for j in np.flatnonzero(ids == ids[i]).tolist())
            assert share[i] == pytest.approx(counts[names[i]] / inside, rel=1e-4)
        assert known.any() and (most > 300 or not known[ids > lm.WORDS].all())
    rows = lm.score_documents(df, lm.initial(), words).collect()
    assert len(rows) == 103 and len({round(r["sum_log_prob"], 6) for r in rows if r["doc_id"] == 0}) == 1
    empty = lm.vocabulary(df.limit(0))
    assert lm.score_documents(df, lm.train(df.limit(0), empty), empty).where("doc_id = 0").first()["sum_log_prob"] < 0


def test_every_document_shapes_the_weights(spark):
    df = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(60)], "doc_id long, text string")
    outside = df.where(~fraction_filter("doc_id", 1 / 12, 41))
    assert outside.count() > 0
    net = lm.train(outside, lm.vocabulary(df))
    assert any((net[k] != w).any() for k, w in lm.initial().items())
