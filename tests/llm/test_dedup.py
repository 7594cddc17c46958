import numpy as np
import pytest

from factgraph.llm import ngram_join, postings, suffix_dedup
from factgraph.llm.suffix_array import weak_ranks
from tests.llm.texts import near_copies, passages

SCHEMA = "doc_id long, text string"


def removed_by_hand(docs, width=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for x in range(len(b) - width + 1):
            first[b[x : x + width]] = min(first.get(b[x : x + width], 1 << 60), i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for x in range(len(b) - width + 1):
            if first[b[x : x + width]] < i:
                gone[x : x + width] = b"\1" * width
        spans = sum(1 for j in range(len(gone)) if gone[j] and (j == 0 or not gone[j - 1]))
        out[i] = (len(b), sum(gone), spans, bytes(c for c, g in zip(b, gone, strict=True) if not g))
    return out


def test_weak_ranks_order_prefixes():
    rng = np.random.default_rng(1)
    for trial in range(20):
        s = rng.integers(1, rng.integers(2, 5) + 1, int(rng.integers(1, 300)))
        s = np.tile(s[: max(1, len(s) // 5)], 6) if trial % 3 == 0 else s
        for need in (1, 2, 3, 5, 17, 50):
            starts = np.arange(0, max(0, len(s) - need + 1))
            for ranks in (weak_ranks(s, need)[starts], weak_ranks(s, need, starts)):
                order = np.argsort(ranks, kind="stable")
                prefixes = [tuple(s[i : i + need]) for i in starts[order]]
                assert prefixes == sorted(prefixes)
                assert all(prefixes[k] == prefixes[k + 1] for k in range(len(order) - 1) if ranks[order[k]] == ranks[order[k + 1]])


@pytest.mark.parametrize("part", [16, 2])
def test_removal_equals_brute_force(spark, monkeypatch, part):
    monkeypatch.setattr(postings, "PART", part)
    docs = passages(3 + part, 250)
    df = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA + ", kept string")  # a clashing extra column
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == removed_by_hand(docs)
    assert sum(v[1] for v in got.values()) > 0


def test_removal_edge_cases(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "abcdefghij" * 12
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(5, long), (5, long), (None, long), (9, "é" + long[:60])], SCHEMA), as_text=True).collect()
    found = sorted((r["doc_id"] or -1, r["n_removed"], r["kept"]) for r in rows)
    assert found == [(-1, 0, long), (5, 0, long), (5, 0, long), (9, 60, "é")]


def groups_by_hand(docs):
    sets = {}
    for i, t in docs:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")).encode().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                r, q = root(ids[x]), root(ids[y])
                parent[max(r, q)] = min(r, q)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("seed", "block", "frequent"), [(16, 256, 1 << 17), (3, 4, 0), (5, 16, 40)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, block, frequent):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_join, "FLUSH", 2000)
    docs = near_copies(seed, 400)
    got = {r["id"]: (r["n_shingles"], r["component"]) for r in ngram_join.ngram_groups(spark.createDataFrame([(*d, 1) for d in docs], SCHEMA + ", component int")).collect()}
    assert got == groups_by_hand(docs)


def test_groups_of_empty_table(spark):
    assert ngram_join.ngram_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    assert ngram_join.ngram_groups(spark.createDataFrame([(1, None), (2, "")], SCHEMA)).count() == 2


def test_groups_of_repeated_and_null_keys(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, one), (7, one), (9, one + " z"), (9, two), (4, two + " z"), (None, two), (None, "c c c"), (3, None), (3, None), (2, "a0 " * 9000)]
    found = sorted((r["id"] or -1, r["n_shingles"], r["component"] or -1) for r in ngram_join.ngram_groups(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted([(7, 36, 4), (7, 36, 4), (9, 37, 4), (9, 36, 4), (4, 37, 4), (-1, 36, 4), (-1, 1, -1), (3, 0, 3), (3, 0, 3), (2, 1, 2)])


def test_divide_skip_and_bounds():
    rng = np.random.default_rng(5)
    for _ in range(60):
        query = np.unique(rng.integers(0, 400, int(rng.integers(1, 200))).astype(np.uint64))
        others = [np.unique(np.concatenate([rng.choice(query, int(len(query) * f)), rng.integers(0, 400, 5).astype(np.uint64)])) for f in rng.uniform(0.3, 3, 6)]
        want = [100 * len(np.intersect1d(query, o)) >= 75 * len(np.union1d(query, o)) for o in others]
        assert ngram_join.divide_skip(query, [len(o) for o in others], others, len(query), 75) == want
        for o, linked in zip(others, want, strict=True):
            if linked:
                assert not ngram_join.far_apart(ngram_join.signature(query), len(query), ngram_join.signature(o), len(o), 75)


def test_shingles_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"a b c d e f", b"", b"A B C D E F", b"x", b"a b c d e f g" * 3]
    alone = [next(iter(ngram_join.shingle_sets([t]))) for t in texts]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(alone, ngram_join.shingle_sets(texts), strict=True))
    assert (alone[0] == alone[2]).all()
