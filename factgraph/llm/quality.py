"""Quality rules with risk-controlled cutoffs.

A statistic rejects a document when it exceeds a cutoff. Cutoffs are chosen per stratum from labelled
documents: a cutoff is admitted only if the exact (Clopper-Pearson) upper bound of its false rejection
rate among good documents is below the risk that the rule may spend, at a confidence that is divided by
the number of strata, rules and cutoffs tried (Bonferroni). So with probability 1 - delta no stratum loses
more than ``risk`` of its good documents. Of the admitted cutoffs the one that rejects most bad documents,
less ``price`` times the good ones, is taken; without any, the rule does not apply in that stratum.

Null text counts as empty; null strata are the stratum ``und``. Every stratum with labels gets its cutoffs. Texts of any length are read whole. Rows are judged one by one, so repeated
rows and columns of other names change nothing. Only labelled rows with quality 0 or 1 count as labels,
and of several labels of one document the lowest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import drop_table, encoded, released, stage_table

SYMBOLS = b"#*$%&|<>"
#: Statistic: (numerator, denominator) columns; larger is worse.
RULES = {"symbols": ("n_symbols", "n_words"), "capitals": ("n_capitals", "n_letters"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "exclaims": ("n_exclaims", "n_words")}
#: Cutoffs tried: a fixed grid, so that the number of tests does not depend on the data.
GRID = [round(0.02 * i, 2) for i in range(1, 50)]
#: Strata whose cutoffs are broadcast; more are joined.
SMALL = 100_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals", "n_exclaims"]


def measure(text: bytes) -> tuple[int, ...]:
    """FEATURES of one UTF-8 text."""
    words = text.split()
    n = len(words)
    repeats = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            covered = bytearray(n)
            for i, w in enumerate(windows):
                j = first.setdefault(w, i)
                if j != i:
                    covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
            repeats = covered.count(1)
    lines = [x for x in text.split(b"\n") if x.strip()]
    data = np.frombuffer(text, np.uint8)
    counts = np.bincount(data, minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum() - counts[9:14].sum() - counts[32])
    capitals, small = int(counts[65:91].sum()), int(counts[97:123].sum())
    return (n, chars, int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeats, len(lines), capitals + small, capitals, int(counts[33]))


def features(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and FEATURES (long) of every row."""
    plain = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), *(f"{c} long" for c in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.array([measure(t) for t in encoded(b.column(b.num_columns - 1))], np.int64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(rows[:, i]) for i in range(len(FEATURES)))], names=[*keep, *FEATURES])

    return plain.mapInArrow(released(run), schema)


def upper_bound(bad: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate p at which ``bad`` or fewer of ``n`` still has probability ``level``."""
    if n == 0 or bad >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(bad + 1)]

    def below(p: float) -> float:
        terms = [c + k * math.log(p) + (n - k) * math.log1p(-p) for k, c in enumerate(logs)]
        top = max(terms)
        return top + math.log(sum(math.exp(t - top) for t in terms))

    low, high = bad / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        if mid >= 1 or (mid > 0 and below(mid) <= math.log(level)):
            high = mid
        else:
            low = mid
    return high


def choose(good: np.ndarray, bad: np.ndarray, risk: float, level: float, price: float) -> float | None:
    """A cutoff of GRID, from counts of labelled documents by the number of cutoffs that they exceed."""
    n, best, value = int(good.sum()), None, 0.0
    for i, cut in reversed(list(enumerate(GRID))):
        lost, caught = int(good[i + 1 :].sum()), int(bad[i + 1 :].sum())
        if lost > risk * n:
            break
        if caught - price * lost > value and upper_bound(lost, n, level) <= risk:
            best, value = cut, caught - price * lost
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, key: str = "doc_id", risk: float = 0.05, delta: float = 0.05, price: float = 5.0) -> DataFrame:
    """(stratum, cuts map<rule, cutoff>) of every labelled stratum; ``measured`` has key, stratum and FEATURES. A task gets the counts of a stratum, of fixed number."""
    marks = labels.where(F.col("quality").isin(0, 1)).groupBy(key).agg(F.min("quality").alias("quality"))
    exceeded = [F.least(F.lit(len(GRID)), F.floor((F.col(a) / F.col(b) - F.lit(1e-9)) / F.lit(0.02))) for a, b in RULES.values()]
    steps = F.array(*[F.when(F.col(b) > 0, F.greatest(F.lit(0), e)).otherwise(F.lit(0)).cast("int") for e, (_, b) in zip(exceeded, RULES.values(), strict=True)])
    counted = measured.join(marks, key).select("stratum", "quality", F.posexplode(steps).alias("rule", "step")).groupBy("stratum", "quality", "rule", "step").agg(F.count("*").alias("n"))
    counted = stage_table(counted.select("stratum", F.col("quality").cast("int").alias("quality"), "rule", "step", "n"), "counts")
    strata = counted.select("stratum").distinct().count()
    level = delta / max(1, strata * len(RULES) * len(GRID))

    def pick(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        t = np.zeros((len(RULES), 2, len(GRID) + 1), np.int64)
        np.add.at(t, (frame["rule"], frame["quality"], frame["step"]), frame["n"])
        picked = {name: choose(t[i, 1], t[i, 0], risk / len(RULES), level, price) for i, name in enumerate(RULES)}
        return pd.DataFrame([(keys[0], v) for v in [[{"rule": k, "cut": c} for k, c in picked.items() if c is not None]]], columns=["stratum", "cuts"])

    chosen = counted.groupBy("stratum").applyInPandas(pick, "stratum string, cuts array<struct<rule: string, cut: double>>")
    out = stage_table(chosen.select("stratum", F.map_from_entries("cuts").alias("cuts")), "cutoffs")
    drop_table(counted)
    return F.broadcast(out) if strata <= SMALL else out


def judge(measured: DataFrame, cuts: DataFrame, min_words: int = 50, repeat_percent: int = 50) -> DataFrame:
    """Adds base_failed, failed (names of the rules that reject) and kept."""
    cut = lambda name: F.try_element_at(F.col("cuts"), F.lit(name))
    checks = [F.when((F.col(b) > 0) & (F.col(a) / F.col(b) > cut(name) + F.lit(1e-9)), F.lit(name)) for name, (a, b) in RULES.items()]
    base = (F.col("n_words") < min_words) | (F.lit(100) * F.col("n_repeat_words") > F.lit(repeat_percent) * F.col("n_words"))
    judged = measured.join(cuts, "stratum", "left").withColumn("base_failed", base).withColumn("failed", F.array_join(F.array(*checks), ","))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("failed") == "")).drop("cuts")


def quality_rules(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", **how) -> DataFrame:
    """One row per document: key, stratum, FEATURES, base_failed, failed, kept. An empty table gives an empty result."""
    named = docs.select(F.col(key).alias(key), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text).alias("__body"))
    measured = stage_table(features(named, "__body", (key, "stratum")), "quality")
    return judge(measured, cutoffs(measured, labels, key, **how))


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", stratum: str = "lang", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; texts are measured where they are read, so none is shuffled."""
    named = docs.select(F.col(key), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text).alias("__body"))
    measured = stage_table(features(named, "__body", (key, "stratum")), "quality")
    cuts = cutoffs(measured, labels, key, **how)
    drop_table(measured)
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(stratum).cast("string"), F.lit("und")).alias("stratum"), F.col(text).alias("__body"))
    return judge(features(row, "__body", ("row", "stratum")), cuts).where("kept").select("row.*")
