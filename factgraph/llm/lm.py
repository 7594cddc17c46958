"""Document scores by masked pseudo-likelihood.

A window network sees SIDE words on both sides of a position, never the word itself, and predicts it:
embeddings, one tanh layer, soft-max over classes. The WORDS most frequent words are classes of their own, the
others are dealt to BUCKETS classes by their last two bytes, which context tells more of than of a word, and a word of such a class has its share of the class's
occurrences in the whole corpus as its probability there. So every word has a probability of its own, and those
of all words add up to one. A document's score is the sum of the conditional log-probabilities of all its words.

Word counts cover all documents, and the vocabulary grows with them: every word is counted apart as long as
their number is at most KNOWN (a table of fixed bound, broadcast); beyond it the rarest counts share what is left
of their class evenly. The network is trained in numpy by the tasks that read the corpus, each from the same
weights in one pass over all its documents, and the weights are averaged by words seen (a sum per weight, so
what reaches the driver has the size of the network). Weights so depend, slightly, on how rows fall into tasks.

Null and empty texts have no words: sum 0, mean 0. Texts are read whole, in slices. Rows are scored one by one, so
repeated rows come back as often, with scores equal up to rounding. An empty table trains nothing: the first weights stay, and all
words are unknown. Columns outside ``keep`` are not read; one named like a result can't be kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import drop_table, encoded, fraction_filter, mix, released, slices, span_hashes, stage_table, word_spans

WORDS, BUCKETS, SIDE, DIM, HIDDEN, KNOWN = 127, 64, 2, 12, 32, 1 << 20
SIZE = 1 + WORDS + BUCKETS
#: A word's hash begins with the bits of its class.
BITS = BUCKETS.bit_length() - 1
SHAPES = [("e", (SIZE, DIM)), ("w1", (2 * SIDE * DIM, HIDDEN)), ("b1", (HIDDEN,)), ("w2", (HIDDEN, SIZE)), ("b2", (SIZE,))]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {k: (rng.normal(0, 0.3 if len(s) > 1 else 0, s)).astype(np.float32) for k, s in SHAPES}


def flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k, _ in SHAPES]).astype(np.float64)


def unflat(v: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in SHAPES:
        n = int(np.prod(s))
        out[k] = v[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def word_hashes(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of texts: hashes of all words, and the bounds of each text among them."""
    for _, part in slices(texts):
        data = _LOWER[np.frombuffer(b"\n".join(part), np.uint8)]
        starts, ends = word_spans(data)
        ending = mix(data[ends - 1].astype(np.uint64) | data[np.maximum(ends - 2, starts)].astype(np.uint64) << np.uint64(8)) % np.uint64(BUCKETS)
        yield span_hashes(data, starts, ends) >> np.uint64(BITS) | ending << np.uint64(64 - BITS), np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))


class Vocabulary:
    """Class ids of words, and the log of each word's share of its class.

    ``top``: hashes of the words with classes of their own. ``known`` and ``counts``: hashes of words counted apart.
    ``total``, ``rest`` and ``kinds``: for each bucket its occurrences, those of words not counted apart, and how many such words there are.
    """

    def __init__(self, top: np.ndarray, known: np.ndarray | None = None, counts: np.ndarray | None = None, total: np.ndarray | None = None, rest: np.ndarray | None = None, kinds: np.ndarray | None = None):
        zero = np.zeros(BUCKETS)
        total, rest, kinds = (zero if x is None else x for x in (total, rest, kinds))
        known, counts = (np.zeros(0, t) if x is None else x for x, t in ((known, np.uint64), (counts, np.int64)))
        self.top = np.sort(top)
        order = np.argsort(known)
        self.known = known[order]
        self.share = np.log(np.maximum(counts[order], 1) / np.maximum(total[self.bucket(self.known)], 1)).astype(np.float32)
        self.tail = np.log(np.maximum(rest, 1) / np.maximum(kinds, 1) / np.maximum(total, 1))

    @staticmethod
    def bucket(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - BITS)).astype(np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        out = 1 + WORDS + self.bucket(hashes)
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            hit = self.top[at] == hashes
            out[hit] = 1 + at[hit]
        return out

    def shares(self, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log-probability of each word given its class."""
        out = np.zeros(len(hashes))
        rare = np.flatnonzero(ids > WORDS)
        some, which = np.unique(hashes[rare], return_inverse=True)
        share = self.tail[self.bucket(some)]
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, some), len(self.known) - 1)
            share = np.where(self.known[at] == some, self.share[at], share)
        out[rare] = share[which]
        return out


def windows(ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(words, 2 * SIDE) context ids, 0 beyond a text's ends."""
    n = len(bounds) - 1
    owner = np.repeat(np.arange(n), np.diff(bounds))
    where = np.arange(len(ids)) + SIDE * (owner + 1)
    padded = np.zeros(len(ids) + SIDE * (n + 1), np.int64)
    padded[where] = ids
    return np.stack([padded[where + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))], axis=1)


def forward(p: dict[str, np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = p["e"][context].reshape(len(context), -1)
    h = np.tanh(x @ p["w1"] + p["b1"])
    z = h @ p["w2"] + p["b2"]
    z -= z.max(axis=1, keepdims=True)
    return x, h, z


def log_probs(p: dict[str, np.ndarray], context: np.ndarray, target: np.ndarray, step: int = 2048) -> np.ndarray:
    out = np.empty(len(target), np.float64)
    for at in range(0, len(target), step):
        _, _, z = forward(p, context[at : at + step])
        t = target[at : at + step]
        picked = z[np.arange(len(t)), t]
        out[at : at + step] = picked - np.log(np.exp(z, out=z).sum(axis=1))
    return out


class Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.t = p, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        p, n = self.p, len(target)
        x, h, z = forward(p, context)
        q = np.exp(z, out=z)
        q /= q.sum(axis=1, keepdims=True)
        q[np.arange(n), target] -= 1
        q /= n
        back = (q @ p["w2"].T) * (1 - h * h)
        dx = (back @ p["w1"].T).reshape(-1, DIM)
        hot = np.zeros((SIZE, DIM), np.float32)
        flat_ids = context.ravel()
        for d in range(DIM):
            hot[:, d] = np.bincount(flat_ids, dx[:, d], SIZE)
        self.t += 1
        for k, g in (("e", hot), ("w1", x.T @ back), ("b1", back.sum(0)), ("w2", h.T @ q), ("b2", q.sum(0))):
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            p[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-7)


def vocabulary(docs: DataFrame, text: str = "text", most: int | None = None) -> Vocabulary:
    """The words of all documents, of which ``most`` (KNOWN) at most are counted apart: those of greatest count, whole counts at a time."""
    most = KNOWN if most is None else most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in kept])).astype(np.int64)

        for b in batches:
            for hashes, _ in word_hashes(encoded(b.column(0))):
                if len(hashes):
                    kept.append(np.unique(hashes, return_counts=True))
            if sum(len(k) for k, _ in kept) > 2_000_000:
                k, c = merged()
                yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], names=["h", "c"])
                kept.clear()
        if kept:
            k, c = merged()
            yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int64)), pa.array(c)], names=["h", "c"])

    counted = docs.select(F.col(text).cast("string")).mapInArrow(released(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    counts = stage_table(counted.withColumn("b", F.shiftrightunsigned("h", 64 - BITS).cast("int")), "words")
    top = np.array([r["h"] for r in counts.orderBy(F.desc("c"), "h").limit(WORDS).select("h").collect()], np.int64)
    of = counts.where(~F.col("h").isin(top.tolist())) if len(top) else counts
    least, room = 1 << 20, most
    for r in sorted(of.groupBy(F.least("c", F.lit(least)).alias("c")).count().collect(), reverse=True):  # one row for each count
        if r["count"] > room:
            break
        least, room = r["c"], room - r["count"]
    apart = of.where(F.col("c") >= least).select("h", "c").toArrow()
    known, n = (apart.column(i).to_numpy().astype(t) for i, t in ((0, np.uint64), (1, np.int64)))
    total, rest, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    unknown = F.col("c") < least
    for r in of.groupBy("b").agg(F.sum("c").alias("total"), F.sum(F.when(unknown, F.col("c")).otherwise(0)).alias("rest"), F.count_if(unknown).alias("kinds")).collect():
        total[r["b"]], rest[r["b"]], kinds[r["b"]] = r["total"], r["rest"], r["kinds"]
    drop_table(counts)
    return Vocabulary(top.astype(np.uint64), known, n, total, rest, kinds)


def train(docs: DataFrame, words: Vocabulary, text: str = "text", key: str = "doc_id", train_share: float = 1.0, rounds: int = 1, batch: int = 1024, rate: float = 0.01) -> dict[str, np.ndarray]:
    """Averaged weights after ``rounds`` passes over the share."""
    now = initial()
    spark = docs.sparkSession
    share = (docs if train_share >= 1 else docs.where(fraction_filter(key, train_share, 41))).select(F.col(text).cast("string"))
    for r in range(rounds):
        sent = spark.sparkContext.broadcast((flat(now), Vocabulary(words.top)))

        def run(batches: Iterator[pa.RecordBatch], r: int = r, sent=sent) -> Iterator[pa.RecordBatch]:
            start, vocab = sent.value
            net = Adam(unflat(start), rate / (1 + r))
            rng, seen = np.random.default_rng(r), 0
            for b in batches:
                for hashes, bounds in word_hashes(encoded(b.column(0))):
                    target = vocab.ids(hashes)
                    context = windows(target, bounds)
                    order = rng.permutation(len(target))
                    seen += len(target)
                    for at in range(0, len(order), batch):
                        pick = order[at : at + batch]
                        net.step(context[pick], target[pick])
            if seen:
                v = flat(net.p) * seen
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v), pa.array(np.full(len(v), float(seen)))], names=["i", "v", "n"])

        mean = share.mapInArrow(released(run), "i int, v double, n double").groupBy("i").agg((F.sum("v") / F.sum("n")).alias("v")).collect()
        if mean:
            v = np.zeros(len(flat(now)))
            v[[x["i"] for x in mean]] = [x["v"] for x in mean]
            now = unflat(v)
        sent.unpersist()
    return now


def score_documents(docs: DataFrame, weights: dict[str, np.ndarray], words: Vocabulary, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_words, sum_log_prob and mean_log_prob."""
    plain = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), "n_words long, sum_log_prob double, mean_log_prob double"])
    sent = docs.sparkSession.sparkContext.broadcast((weights, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, vocab = sent.value
        for b in batches:
            sizes, sums = [], []
            for hashes, bounds in word_hashes(encoded(b.column(b.num_columns - 1))):
                target = vocab.ids(hashes)
                each = log_probs(p, windows(target, bounds), target) + vocab.shares(hashes, target)
                total = np.concatenate([[0.0], np.cumsum(each)])
                sizes.append(np.diff(bounds))
                sums.append(total[bounds[1:]] - total[bounds[:-1]])
            n, s = (np.concatenate([*x, np.zeros(0)]) for x in (sizes, sums))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n.astype(np.int64)), pa.array(s), pa.array(np.where(n > 0, s / np.maximum(n, 1), 0.0))], names=[*keep, "n_words", "sum_log_prob", "mean_log_prob"])

    return plain.mapInArrow(released(run), schema)
