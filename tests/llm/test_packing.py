import zlib

import numpy as np
import public_tokenizers
import pytest

from factgraph.llm.packing import WordEncoder, crossover, default_tokenizer, evolve, pack, packed

TEXTS = ["Hello, world! It's 3 o'clock.", "", None, "x" * 500, "naïve Été — “quoted” don't  we'll\t42", "日本語 text Σίσυφος", "a b c", "<|endoftext|> end", "word " * 5000, "word " * 5000]


def test_cached_encoding_equals_the_tokenizer():
    e = WordEncoder(default_tokenizer())
    texts = [t for t in TEXTS if t is not None] * 2
    assert [e.encode(t) for t in texts] == e.ids(texts)


def test_pieces_and_bins(spark):
    from tokenizers import Tokenizer

    docs = [(i, TEXTS[i % len(TEXTS)], "x") for i in range(60)]
    rows = pack(spark.createDataFrame(docs, "doc_id long, text string, sequence_id string"), with_ids=True).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, text, _ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            want[i, at // 4096] = (at, len(part), zlib.crc32(part.tobytes()), part.tolist())
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"], r["ids"]) for r in rows} == want
    places: dict[int, list] = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(places) <= -(-sum(v[1] for v in want.values()) // 4096) + 1


def test_repeated_rows_are_packed_as_often(spark):
    rows = [(7, "a b c"), (7, "a b c"), (7, "other words"), (None, "x"), (None, None)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["length"]) for r in got) == [(-1, 1), (-1, 2), (7, 3), (7, 4), (7, 4)]
    assert len({(r["sequence_id"], r["offset"]) for r in got}) == 5


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_crossover_keeps_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(30, 70, 120).tolist()
    a, b = packed(list(range(120)), lengths, 100), packed(rng.permutation(120).tolist(), lengths, 100)
    child = crossover(a, b, lengths, 100, rng)
    assert sorted(i for x in child for i in x) == list(range(120))
    assert all(sum(lengths[i] for i in x) <= 100 for x in child)
    founded = [packed(np.random.default_rng(seed + k).permutation(120).tolist(), lengths, 100) for k in range(4)]
    grown = evolve(lengths, founded, 100, 60, rng)
    assert len(grown[0]) <= min(map(len, founded)) and sum(map(len, grown)) < sum(map(len, founded))  # crossover finds better bins
    assert all(sorted(i for x in p for i in x) == list(range(120)) for p in evolve(lengths, [], 100, 5, rng, greedy=False))
    best = evolve(lengths, [], 100, 20, rng)[0]
    assert len(best) <= len(packed(sorted(range(120), key=lambda i: -lengths[i]), lengths, 100))


def test_queries_match_added_tokens(spark, tmp_path):
    from tokenizers import Tokenizer

    import corpus_pipeline
    from factgraph.llm import entries

    texts = [*(t for t in TEXTS if t is not None), "a <|endoftext|> b", "x<|startoftext|>é 日本 <|endoftext|>", "<|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    t = Tokenizer.from_file(default_tokenizer())
    want = {}
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 4096):
            want[i, at // 4096] = (len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes()))
    for out in (entries.op3_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.pack_sequences(spark, docs, "")):
        assert {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in out.collect()} == want
