"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence gets a probability from the weights of its words and of their
first letters (so that endings never seen still count), and the
document the noisy-or of its sentences: 1 - prod(1 - p). Weights are trained in numpy from document labels
alone, on a bounded sample of labelled rows (``most`` in the mean); every text is scored whole, and the
sentences that carry the score are located by character span. Null and empty texts are one empty sentence,
whose probability is the bias alone. Rows are scored one by one, so repeated rows come back as often, and
sentences of equal probability in page order. Columns outside ``keep`` are not read; one named like a result
(score, n_sentences, offending) can't be kept. Empty tables, or labels of one kind, give a model without words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import released

WORD = re.compile(r"[^\W\d_]+")
#: Letters of a word's beginnings that are features of their own.
BEGINNINGS = (4, 5, 6, 7)
BREAK = re.compile(r"(?<=[.!?])\s+|\n+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Character spans of non-blank sentences; one empty span if there is none."""
    out, at = [], 0
    for m in BREAK.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    if at < len(text):
        out.append((at, len(text)))
    return out or [(0, 0)]


def beginnings(words: set[str] | frozenset[str], k: int) -> set[str]:
    """The first k letters of longer words; a star tells them from words."""
    return {w[:k] + "*" for w in words if len(w) > k}


def features(lowered: str) -> frozenset[str]:
    """Words and their beginnings in a lower-cased text."""
    words = frozenset(WORD.findall(lowered))
    return words.union(*(beginnings(words, k) for k in BEGINNINGS))


def enrichment(a: int, b: int, n1: int, n0: int) -> float:
    """Log of an upper bound (Chernoff) of the chance that ``a`` or more of a word's a + b documents have label 1."""
    n, q, p = a + b, a / (a + b), n1 / (n1 + n0)
    if q <= p:
        return 0.0
    return -n * (q * np.log(q / p) + (0.0 if q == 1 else (1 - q) * np.log((1 - q) / (1 - p))))


class NoisyOr:
    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias
        self.words = frozenset(w for w in weights if w[-1] != "*")
        self.starts = {k: found for k in BEGINNINGS if (found := frozenset(w for w in weights if w[-1] == "*" and len(w) == k + 1))}

    @classmethod
    def fit(cls, chosen: list[str], docs: list[tuple[int, int, list[int], list[int]]], steps: int = 300, rate: float = 0.2, decay: float = 2e-4) -> NoisyOr:
        """AdaGrad on the log loss of the noisy-or. A document is its label, its number of sentences, and sentence and word (numbers) of each occurrence."""
        base = sum(y for y, *_ in docs) / max(1, len(docs))
        if not 0 < base < 1:
            return cls({}, float(np.log(max(base, 1e-4) / max(1 - base, 1e-4))))
        sizes = np.array([n for _, n, _, _ in docs], np.int64)
        first = np.cumsum(sizes) - sizes
        doc_a = np.repeat(np.arange(len(docs)), sizes)
        flat_a = np.concatenate([np.array(w, np.int64) for *_, w in docs])
        sent_a = np.concatenate([np.array(s, np.int64) + f for (_, _, s, _), f in zip(docs, first.tolist(), strict=True)])
        y = np.array([v for v, *_ in docs], float)
        w, bias = np.zeros(len(chosen)), float(np.log(base / len(doc_a) * len(docs)))
        sums, bias_sum = np.full(len(chosen), 1e-6), 1e-6
        for _ in range(steps):
            z = bias + np.bincount(sent_a, w[flat_a], len(doc_a))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            none = np.exp(np.bincount(doc_a, np.log1p(-np.minimum(p, 1 - 1e-9)), len(docs)))
            any_ = np.maximum(1 - none, 1e-6)
            slope = np.where(y == 1, -none / any_, 1.0)[doc_a] * p / len(docs)
            g = np.bincount(flat_a, slope[sent_a], len(chosen)) + decay * w
            g0 = slope.sum()
            sums += g * g
            bias_sum += g0 * g0
            w -= rate * g / np.sqrt(sums)
            bias -= rate * g0 / np.sqrt(bias_sum)
        return cls({c: float(v) for c, v in zip(chosen, w, strict=True) if abs(v) > 1e-3}, bias)

    def hits(self, words: frozenset[str]) -> list[str]:
        """The features with weights, sorted."""
        out = set(self.words.intersection(words))
        for k, known in self.starts.items():
            out |= known.intersection(beginnings(words, k))
        return sorted(out)

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and (start, end, probability) of each sentence. Sentences are looked at only if the text has a feature at all."""
        spans = sentences(text)
        odds = np.full(len(spans), self.bias)
        if self.hits(frozenset(WORD.findall(text.lower()))):
            for i, (a, b) in enumerate(spans):
                odds[i] += sum(self.weights[w] for w in self.hits(frozenset(WORD.findall(text[a:b].lower()))))
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum())), [(a, b, x) for (a, b), x in zip(spans, p.tolist(), strict=True)]


def _bag(text: str) -> list[frozenset[str]]:
    return [features(text[a:b].lower()) for a, b in sentences(text)]


def choose_words(rows: DataFrame) -> list[str]:
    """Words and beginnings of the sampled ``rows`` (__t, __y) found in more documents of label 1 than chance explains, one false word expected; strongest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in counts], pa.string()), pa.array([y for _, y in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["word", "y", "c"])

        for b in batches:
            for i in range(b.num_rows):
                words, y = features(b.column(0)[i].as_py().lower()), b.column(1)[i].as_py()
                counts.update((w, y) for w in words)
                counts["", y] += 1  # no word: counts documents
                if len(counts) > 100_000:
                    yield out()
                    counts.clear()
        yield out()

    counted = rows.select("__t", "__y").mapInArrow(released(run), "word string, y int, c long")
    counted = counted.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, F.col("c")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("c")).otherwise(0)).alias("b"))
    counted = counted.where("a >= 3 or word = ''").collect()
    n1, n0 = next(((r["a"], r["b"]) for r in counted if not r["word"]), (0, 0))
    if not n1 or not n0:
        return []
    rare = {r["word"]: enrichment(r["a"], r["b"], n1, n0) for r in counted if r["word"]}
    return sorted((w for w, p in rare.items() if p <= -np.log(len(rare) + 1)), key=lambda w: (rare[w], w))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = 8000) -> NoisyOr:
    """Fit on labelled rows; of several labels of a document the highest counts. Texts stay on the executors: only occurrences of the chosen words come to the driver."""
    marks = labels.where(F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).cast("int").alias("__y"))
    n = marks.count()
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(31)), F.lit(1 << 20)) < F.lit(int(min(1.0, most / max(1, n)) * (1 << 20)) + 1)
    rows = docs.where(draw).select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__t")).join(marks.where(draw), key)
    chosen = choose_words(rows)
    index = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(chosen)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                found = [sorted(index.value[w] for w in s if w in index.value) for s in _bag(b.column(0)[i].as_py())]
                out.append((b.column(1)[i].as_py(), len(found), [k for k, s in enumerate(found) for _ in s], [w for s in found for w in s]))
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), pa.array(c[1], pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in c[2:])], names=["y", "n", "s", "w"])

    found = rows.select("__t", "__y").mapInArrow(released(run), "y int, n int, s array<int>, w array<int>").collect()
    return NoisyOr.fit(chosen, sorted((r["y"], r["n"], r["s"], r["w"]) for r in found))


def score_toxicity(docs: DataFrame, model: NoisyOr, text: str = "text", keep: tuple[str, ...] = ("doc_id",), located: float = 0.1) -> DataFrame:
    """``keep`` columns, score, n_sentences and the located sentences (start, end, score, text), worst first."""
    plain = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), "score double, n_sentences int, offending array<struct<start: int, end: int, score: double, sentence: string>>"])
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("sentence", pa.string())]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores, sizes, found = [], [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                t = t or ""
                p, parts = shared.value.score(t)
                scores.append(p)
                sizes.append(len(parts))
                found.append([{"start": s, "end": e, "score": x, "sentence": t[s:e]} for s, e, x in sorted(parts, key=lambda v: (-v[2], v[0])) if x >= located])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(sizes, pa.int32()), pa.array(found, kind)], names=[*keep, "score", "n_sentences", "offending"])

    return plain.mapInArrow(released(run), schema)
