"""Registered queries against brute force, and against their SQL, on small tables."""

import os
import random
import zlib
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from factgraph.llm import entries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(entries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want, got = con.sql(entry.oracle_sql()[name]), entry.queries()[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def measured_by_hand(text):
    space, symbols = set("\x20\x09\x0a\x0b\x0c\x0d"), set("#*$%&|<>")
    words = "".join("\n" if c in space else c for c in text or "").split("\n")
    words = [w for w in words if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    lines = [x for x in (text or "").split("\n") if any(c not in space for c in x)]
    return len(words), sum(map(len, words)), sum(c in symbols for c in text or ""), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    plain = {"en": [f"th{a}{b}" for a in "aeiou" for b in "lmnrst"], "xx": [f"kr{a}{b}z" for a in "äöü" for b in "bdgpvw"]}
    docs, labels = [], []
    for i in range(900):
        lang, toxic = "en" if i % 3 else "xx", i % 7 == 0
        lines = [" ".join(rng.choice(plain[lang]) for _ in range(rng.randint(4, 20))) + "." for _ in range(rng.randint(2, 12))]
        if toxic:
            lines[0] = f"you {rng.choice(['moron', 'scum'])} there."
        if i % 11 == 0:
            lines += [lines[0], "# $ | <&>", lines[0]]
        docs.append((i, "\n".join(lines), None if i % 13 == 0 else lang, "s", 1))
        labels.append((i, int(i % 5 > 0), int(toxic)))
    docs += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "\x0b\x0c 1 2 3", "xx", "s", 0), (1003, "a b c " * 30_000, "en", "s", 0), (5, docs[5][1], "en", "s", 1)]
    base = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base, docs, dict((i, t) for i, _, t in labels)


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_quality_query(spark, corpus):
    base, docs, _ = corpus
    rows = entries.op1_quality_rules(spark, base).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    want = sorted((i, *measured_by_hand(t)) for i, t, *_ in docs)
    assert sorted((r["doc_id"], *(r[c] for c in names)) for r in rows) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["failed"] == "") for r in rows)


def test_language_query(spark, corpus):
    base, docs, _ = corpus
    rows = entries.op9_language_id(spark, base).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs) and all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    truth = {i: "en" if i % 3 else "xx" for i in range(900)}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1000, 1001, 1002)} == {"und"} and {r["lang_pred"] for r in rows} <= {"en", "xx", "und"}


def test_toxicity_query(spark, corpus):
    base, docs, toxic = corpus
    rows = entries.op8_toxicity(spark, base).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(d[0] for d in docs)
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert sum(r["predicted"] == toxic[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert len({r["score"] for r in rows if r["doc_id"] in (1000, 1001)}) == 1


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for name, query in entries.QUERIES.items():
        assert query(spark, str(tmp_path)).count() == 0, name
    assert entry.queries()["pipeline"](spark, str(tmp_path)).count() == 0


def test_pipeline_of_odd_rows(spark, tmp_path):
    rng = random.Random(2)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(80))
    one = text()
    docs = [(i, text(), None, "s", 1, "x") for i in range(20)] + [(30, one, None, "s", 1, "x"), (30, one, None, "s", 1, "y"), (31, one, None, "s", 1, "x"), (None, text(), None, None, None, "x"), (40, None, None, None, None, "x"), (41, "", "en", "s", 0, "x"), (50, " ".join(f"v{i}" for i in range(60_000)), None, "s", 1, "x")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, component string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = entry.queries()["pipeline"](spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter([*range(20), 30, 30, None, 50])
