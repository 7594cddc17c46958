"""Language identification by character language models.

One interpolated Kneser-Ney model of order 4 per language, over lower-cased letters with everything else
as a single gap. All n-grams of all languages stand in sorted arrays of 64-bit hashes with one column of
log-probabilities per language, back-off weights likewise; a lookup is a binary search. The language with
the lowest cross-entropy per character wins. Held-back training texts calibrate a temperature, which turns
differences of cross-entropy into a score, and the cross-entropy from which a text is rejected as none of
the languages. Training texts are a bounded sample (``per_language`` texts of each language at most, in
the mean); every text is scored whole. Null text, or text without a letter, is ``und`` with score 0. Of languages
of equal cross-entropy the first by name wins. Rows are identified one by one, so repeated rows come back as often;
an empty table gives an empty one. Columns outside ``keep`` are not read; one named like a result can't be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import mix, released

ORDER = 4
UNKNOWN = "und"
#: Languages whose probabilities share one table, and training texts of all languages together, in the mean.
TOGETHER, TEXTS = 64, 50_000
_LETTERS: np.ndarray | None = None


def letters() -> np.ndarray:
    global _LETTERS
    if _LETTERS is None:
        _LETTERS = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _LETTERS


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of all texts in one array (0: gap, each text led by ORDER - 1 gaps), start of each text, its letters."""
    parts = [code_points(t) for t in texts]
    sizes = np.array([len(p) for p in parts], np.int64)
    cp = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    owner = np.repeat(np.arange(len(parts)), sizes)
    is_letter = letters()[cp]
    gap_before = np.ones(len(cp), bool)
    gap_before[1:] = is_letter[:-1] | (owner[1:] != owner[:-1])
    keep = is_letter | gap_before
    kept = np.bincount(owner[keep], minlength=len(parts))
    counts = np.bincount(owner[is_letter], minlength=len(parts))
    starts = np.concatenate([[0], np.cumsum(kept + ORDER - 1)])
    out = np.zeros(starts[-1], np.uint64)
    where = np.arange(int(kept.sum())) + np.repeat((ORDER - 1) * (np.arange(len(parts)) + 1), kept)
    out[where] = np.where(is_letter, cp, 0)[keep]
    return out, starts, counts


def gram_keys(s: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n symbols that end at each position; the first n - 1 positions mean nothing."""
    key = np.full(len(s), n, np.uint64)
    for back in range(n - 1, -1, -1):
        shifted = s if not back else np.concatenate([np.zeros(min(back, len(s)), np.uint64), s[:-back]])
        key = key * np.uint64(0x9E3779B97F4A7C15) + shifted + np.uint64(1)
    return mix(key)


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Index of each key in the sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class KneserNey:
    """``grams[n]``: sorted keys and (keys, languages) log-probabilities; ``contexts[n]``: the same with log back-off weights."""

    def __init__(self, languages: list[str], texts: list[list[str]], alphabet: int | None = None):
        self.languages = languages
        per = [[self._distinct(s, starts, n) for n in range(1, ORDER + 1)] for s, starts in ((x[0], x[1]) for x in map(symbols, texts))]
        self.grams: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.contexts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        lower: np.ndarray | None = None
        size = (alphabet or len(np.unique(np.concatenate([p[0]["key"] for p in per])))) + 1
        self.floor = -np.log(size)
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([p[n - 1]["key"] for p in per]))
            ctx_keys = np.unique(np.concatenate([p[n - 1]["context"] for p in per]))
            probs, weights = np.zeros((len(keys), len(languages))), np.zeros((len(ctx_keys), len(languages)))
            suffix_of = np.zeros(len(keys), np.int64)
            for p in per:
                suffix_of[find(keys, p[n - 1]["key"])] = 0 if n == 1 else find(self.grams[n - 1][0], p[n - 1]["suffix"])
            ctx_of = np.zeros(len(keys), np.int64)
            for p in per:
                ctx_of[find(keys, p[n - 1]["key"])] = find(ctx_keys, p[n - 1]["context"])
            for j, p in enumerate(per):
                counts = np.zeros(len(keys))
                if n == ORDER:
                    counts[find(keys, p[n - 1]["key"])] = p[n - 1]["count"]
                else:  # continuation counts: distinct longer grams that end in this one
                    np.add.at(counts, find(keys, p[n]["suffix"]), 1)
                n1, n2 = (counts == 1).sum(), (counts == 2).sum()
                d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
                total = np.bincount(ctx_of, counts, len(ctx_keys))
                kinds = np.bincount(ctx_of, counts > 0, len(ctx_keys))
                weight = np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)
                below = np.full(len(keys), 1 / size) if n == 1 else lower[suffix_of, j]
                probs[:, j] = np.maximum(counts - d, 0) / np.maximum(total[ctx_of], 1) + weight[ctx_of] * below
                weights[:, j] = weight
            lower = probs
            self.grams[n] = (keys, np.log(probs).astype(np.float32))
            self.contexts[n] = (ctx_keys, np.log(weights).astype(np.float32))

    @staticmethod
    def _distinct(s: np.ndarray, starts: np.ndarray, n: int) -> dict[str, np.ndarray]:
        real = np.ones(len(s), bool)
        for k in range(ORDER - 1):
            real[starts[:-1] + k] = False
        keys, first, counts = np.unique(gram_keys(s, n)[real], return_index=True, return_counts=True)
        at = np.flatnonzero(real)[first]
        context = gram_keys(s, n - 1)[at - 1] if n > 1 else np.zeros(len(at), np.uint64)
        return {"key": keys, "count": counts, "suffix": gram_keys(s, n - 1)[at] if n > 1 else keys, "context": context}

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts, languages) mean negative log-probability per symbol, symbols and letters of each text."""
        s, starts, n_letters = symbols(texts)
        lengths = np.diff(starts) - (ORDER - 1)
        total = np.zeros((len(s), len(self.languages)), np.float32)
        real = np.ones(len(s), bool)
        for k in range(ORDER - 1):
            real[starts[:-1] + k] = False
        at = np.flatnonzero(real)
        out = total[: len(at)]
        left = np.arange(len(at))
        for n in range(ORDER, 0, -1):
            keys, probs = self.grams[n]
            hit = find(keys, gram_keys(s, n)[at[left]] if n < ORDER else gram_keys(s, n)[at])
            good = hit >= 0
            out[left[good]] += probs[hit[good]]
            left = left[~good]
            if not len(left):
                break
            if n > 1:
                ctx_keys, weights = self.contexts[n]
                ctx = find(ctx_keys, gram_keys(s, n - 1)[at[left] - 1])
                seen = ctx >= 0
                out[left[seen]] += weights[ctx[seen]]
            else:
                out[left] += self.contexts[1][1][0] + self.floor
        sums = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(lengths > 0)
        if len(full):
            offsets = np.concatenate([[0], np.cumsum(lengths)])[full]
            sums[full] = np.add.reduceat(out, offsets, axis=0, dtype=np.float64)
        return -sums / np.maximum(lengths, 1)[:, None], lengths, n_letters


class Models:
    """Models of any number of languages, TOGETHER in a table: a table has a column for each of its languages, of which most n-grams have few."""

    def __init__(self, languages: list[str], texts: list[list[str]]):
        self.languages = languages
        alphabet = len(np.unique(np.concatenate([symbols(t)[0] for t in texts])))
        self.parts = [KneserNey(languages[i : i + TOGETHER], texts[i : i + TOGETHER], alphabet) for i in range(0, len(languages), TOGETHER)]

    def cross_entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [p.cross_entropy(texts) for p in self.parts]
        return np.concatenate([e for e, _, _ in found], axis=1), found[0][1], found[0][2]


class Identifier:
    """A model with its calibration: ``temperature`` per symbol, and by language mean and spread of the cross-entropy."""

    def __init__(self, model: Models, held: list[tuple[str, int]], tolerance: float = 1.5):
        self.model = model
        entropies, sizes, _ = model.cross_entropy([t for t, _ in held])
        truth = np.array([y for _, y in held], np.int64)
        self.mean, self.spread = np.full(len(model.languages), 3.0), np.full(len(model.languages), 1.0)
        worst = 4.0
        for j in range(len(model.languages)):
            own = truth == j
            if own.sum() >= 5:
                e = entropies[own, j]
                self.mean[j], self.spread[j] = np.median(e), max(0.05, 1.4826 * np.median(np.abs(e - np.median(e))))
                worst = max(worst, float(np.quantile((e - self.mean[j]) / self.spread[j] / np.sqrt(1 + 200 / np.maximum(sizes[own], 1)), 0.999)))
        self.limit = worst * tolerance
        self.temperature = 1.0
        if len(held):
            losses = {t: -np.log(np.maximum(self.posterior(entropies, sizes, t)[np.arange(len(truth)), truth], 1e-6)).mean() for t in (0.125, 0.25, 0.5, 1.0, 2.0, 4.0)}
            self.temperature = min(losses, key=losses.get)

    def posterior(self, entropies: np.ndarray, sizes: np.ndarray, temperature: float) -> np.ndarray:
        gap = -(entropies - entropies.min(axis=1, keepdims=True)) * (temperature * np.sqrt(np.maximum(sizes, 1)))[:, None]
        p = np.exp(gap)
        return p / p.sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Languages, scores, cross-entropies and rejections."""
        entropies, sizes, n_letters = self.model.cross_entropy([t or "" for t in texts])
        best = entropies.argmin(axis=1)
        rows = np.arange(len(texts))
        lettered = n_letters > 0
        score = np.where(lettered, self.posterior(entropies, sizes, self.temperature)[rows, best], 0.0)
        bound = self.mean[best] + self.limit * self.spread[best] * np.sqrt(1 + 200 / np.maximum(sizes, 1))
        rejected = ~lettered | (entropies[rows, best] > bound)
        names = [self.model.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)]
        return names, score, entropies[rows, best], rejected


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = 400) -> Identifier | None:
    """Fit on rows with text and language; None if there are none. A quarter of the sample is held back for calibration.

    Every language is learned, from ``per_language`` texts in the mean, or fewer where TEXTS are not enough for all.
    """
    rows = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    each = min(per_language, max(4, TEXTS // len(counts)))
    shares = docs.sparkSession.createDataFrame([(name, int(min(1.0, each / n) * (1 << 20))) for name, n in counts.items()], "__lang string, __share int")
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(23)), F.lit(1 << 20))
    sample = rows.join(F.broadcast(shares), F.col(lang) == F.col("__lang")).where(draw < F.col("__share")).select(F.col(lang), F.col(text), F.xxhash64(F.col(key), F.lit(29)).alias("h")).collect()
    sample.sort(key=lambda r: (r[lang], r["h"], r[text]))
    languages = sorted({r[lang] for r in sample})
    fit: list[list[str]] = [[] for _ in languages]
    held: list[tuple[str, int]] = []
    for i, r in enumerate(sample):
        j = languages.index(r[lang])
        if i % 4 == 3 and fit[j]:
            held.append((r[text], j))
        else:
            fit[j].append(r[text])
    return Identifier(Models(languages, fit), held) if languages else None


def identify(docs: DataFrame, model: Identifier | None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred, score, cross_entropy and rejected of every row."""
    plain = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    extra = "lang_pred string, score double, cross_entropy double, rejected boolean"
    if model is None:
        return plain.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), extra])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            columns: list[list] = [[], [], [], []]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end] or "") <= 400_000):
                    size += len(texts[end] or "")
                    end += 1
                for c, v in zip(columns, shared.value.predict(texts[at:end]), strict=True):
                    c.extend(v if isinstance(v, list) else v.tolist())
                at = end
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.float64(), pa.bool_()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *arrays], names=[*keep, "lang_pred", "score", "cross_entropy", "rejected"])

    return plain.mapInArrow(released(run), schema)
