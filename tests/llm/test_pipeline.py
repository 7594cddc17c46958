import random

import corpus_pipeline
from factgraph.llm import common, langid, ngram_join, packing, quality, suffix_dedup
from tests.llm.test_dedup import groups_by_hand, removed_by_hand


def sentence(rng, words):
    return " ".join(rng.choice(words) for _ in range(12)) + "."


def test_stages_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    tongues = {"en": [f"th{a}{b}" for a in "aeiou" for b in "lmnrst"], "xx": [f"kr{a}{b}z" for a in "äöü" for b in "bdgpvw"]}
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = []
    for i in range(120):
        lang = "en" if i % 3 else "xx"
        text = " ".join(sentence(rng, tongues[lang]) for _ in range(8))
        if i % 10 == 1:
            text += " " + passage
        docs.append([i, text, lang, "s", len(text)])
    for i in range(120, 140):  # near copies
        text = docs[i - 100][1] + " tail"
        docs.append([i, text, docs[i - 100][2], "s", len(text)])
    docs.append([140, "too short", "en", None, 9])
    docs.append([141, None, None, None, None])
    base = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    table, now = spark.read.parquet(f"{base}/documents.parquet"), None
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, table, base)
        now.write.parquet(f"{base}/{len(seen)}.parquet")
        table = spark.read.parquet(f"{base}/{len(seen)}.parquet")
        seen.append({r["doc_id"]: r for r in table.collect()})
    assert set(seen[0]) == set(range(140)) and set(seen[1]) == set(range(140))
    before = [(i, r["text"]) for i, r in seen[1].items()]
    keep = {i for i, (_, c) in groups_by_hand(before).items() if i == c}
    assert set(seen[2]) == keep and len(keep) == 120
    cut = removed_by_hand([(i, r["text"]) for i, r in seen[2].items()])
    assert {i: r["text"].encode() for i, r in seen[3].items()} == {i: v[3] for i, v in cut.items() if v[3]}
    assert sum(v[1] for v in cut.values()) > 4000 and all(r["n_chars"] == len(r["text"]) for r in seen[3].values())
    assert set(seen[4]) == set(seen[3])
    assert corpus_pipeline.run(spark, base).select("doc_id", "piece").distinct().count() == len(seen[4])


def test_no_stage_gets_all_texts_of_a_task_as_one_batch(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(5)) for _ in range(3000)]
    long, base, log = 2_400_000, str(tmp_path), str(tmp_path / "batches")
    texts = [" ".join(rng.choices(words, k=n // 6)) for n in [40_000] * 200 + [long]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")

    def watched(run):
        def look(batches):
            for b in batches:
                with open(log, "a") as f:
                    f.write(f"{b.nbytes}\n")
                yield b

        return lambda batches: run(look(batches))

    for module in (quality, langid, ngram_join, suffix_dedup, packing):
        monkeypatch.setattr(module, "released", watched)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    table = spark.read.parquet(f"{base}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, table, base).coalesce(1).write.parquet(f"{base}/{k}")
        table = spark.read.parquet(f"{base}/{k}")
        sizes = [int(x) for x in open(log)]
        open(log, "w").close()
        # a batch ends with the row that fills it, which the first stage sends with its text twice
        assert sizes and max(sizes) < common.BATCH_BYTES + 2 * long + 200_000
        if k < 4:
            assert {r["doc_id"]: r["text"] for r in table.collect()} == dict(enumerate(texts))
    assert {r["doc_id"] for r in table.select("doc_id").collect()} == set(range(201))
    spark.conf.set(limit, "1m")  # a smaller limit of the session stays
    common.bounded_batches(spark)
    assert spark.conf.get(limit) in ("1m", str(1 << 20))
    spark.conf.unset(limit)
