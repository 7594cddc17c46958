"""Best-fit packing of tokenized documents into sequences by a grouping genetic algorithm.

Documents are tokenized (an end id follows each), cut into pieces of at most ``size`` tokens, and the
pieces dealt by hash into problems of about ``GROUP`` pieces. Each problem is evolved on several islands, of
which the first is founded greedily (best fit, longest first) and the others at random; a crossover copies whole well-filled bins of one parent into the other, removes the bins that hold the same
pieces a second time, and best-fits what that displaced, longest first. Between epochs each island's elite
migrates to the next. An island stops once it meets the lower bound. Bins with room left are dissolved and
packed once more across problems, so that each problem does not leave a bin of its own half empty.

Null text counts as empty; an empty text is one piece with the end id; texts of any length are cut, not shortened.
Rows are packed one by one: repeated rows are packed as often as they occur, and pieces of equal length are told
apart by key, piece and checksum. Tokens are those of the plain tokenizer, added tokens in the text included. An
empty table gives an empty one; columns other than key and text are not read.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import released, stage_table

SIZE, END_ID, GROUP, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4096, 1, 4096, 3, 2, 8, 4
#: Texts of these characters alone can be cut into words here; others go through the tokenizer whole.
PLAIN = re.compile("[\t\n\r -~¡-±´-¸º»¿-ɏ–—‘-”…€]*")
#: The tokenizer's own cut, for PLAIN lower-cased texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
CACHE = 500_000
#: Byte-level alphabet: printable Latin-1 stands for itself, other bytes follow from U+0100 on in order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Encoders of this Python worker, kept from task to task.
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of whole texts; a word's ids are looked up once and kept, of CACHE words at most."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.known: dict[str, bytes] = {}

    def ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def words(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """Words that the tokenizer cuts as we do go straight to its merge model, in its alphabet of bytes."""
        merge = self.tokenizer.model.tokenize
        for w in new:
            known_bytes = w if w.isascii() else "".join([BYTE_ALPHABET[b] for b in w.encode()])
            yield w, b"".join([t.id.to_bytes(4, "little") for t in merge(known_bytes)])

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or self.added and self.added.search(text):
            return self.ids([text])[0]
        words = WORDS.findall(text.lower())
        known = self.known
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > CACHE:
            known.clear()
        known.update(self.words([w for w in set(words) if w not in known]))
        return b"".join(map(known.__getitem__, words))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encoder_for(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    """Rows (key, piece, start, length, ids_crc32) of every document, with the ids themselves on request."""
    plain = docs.select(F.col(key), F.col(text).cast("string").alias("__text"))
    schema = f"`{key}` {plain.schema[0].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(tokenizer or default_tokenizer())
        end, width = np.array([END_ID], "<u4").tobytes(), 4 * size
        for b in batches:
            keys, owner, rows, ids = b.column(0), [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                data = encoder.encode(t or "") + end
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    owner.append(i)
                    rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            r = np.array(rows, np.int64).reshape(-1, 4)
            arrays = [keys.take(pa.array(owner, pa.int64())), pa.array(r[:, 0].astype(np.int32)), *(pa.array(r[:, k]) for k in (1, 2, 3))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return plain.mapInArrow(released(run), schema)


def best_fit(items: list[int], lengths: list[int], bins: list[list[int]], room: list[int], size: int) -> None:
    """Put items, in the order given, each into the open bin that it fills best; a new bin only where none has room."""
    open_bins = sorted((r, b) for b, r in enumerate(room) if r)
    for i in items:
        n = lengths[i]
        at = bisect_left(open_bins, (n, -1))
        if at < len(open_bins):
            r, b = open_bins.pop(at)
            bins[b].append(i)
        else:
            r, b = size, len(bins)
            bins.append([i])
            room.append(size)
        room[b] = r - n
        if r > n:
            insort(open_bins, (r - n, b))


def packed(order: list[int], lengths: list[int], size: int) -> list[list[int]]:
    bins: list[list[int]] = []
    best_fit(order, lengths, bins, [], size)
    return bins


def fitness(bins: list[list[int]], lengths: list[int], size: int) -> tuple[int, float]:
    """Fewer bins first, then the fuller ones (sum of squared fill)."""
    return len(bins), -sum((sum(lengths[i] for i in b) / size) ** 2 for b in bins)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], size: int, rng: np.random.Generator) -> list[list[int]]:
    """Whole well-filled bins of ``b`` enter ``a``; bins of ``a`` that share a piece with them go, and their other pieces are best-fitted."""
    fill = np.array([sum(lengths[i] for i in x) for x in b])
    chance = rng.random(len(b)) * (fill / size) ** 8
    injected = [b[k] for k in np.argsort(-chance, kind="stable")[: max(1, len(b) // 3)]]
    inside = {i for x in injected for i in x}
    kept, loose = [], []
    for x in a:
        if inside.isdisjoint(x):
            kept.append(list(x))
        else:
            loose.extend(i for i in x if i not in inside)
    # mutation: the emptiest kept bins are opened too
    kept.sort(key=lambda x: sum(lengths[i] for i in x))
    opened = min(len(kept), 1 + int(rng.integers(0, 3)))
    loose.extend(i for x in kept[:opened] for i in x)
    bins = [list(x) for x in injected] + kept[opened:]
    best_fit(sorted(loose, key=lambda i: (-lengths[i], i)), lengths, bins, [size - sum(lengths[i] for i in x) for x in bins], size)
    return bins


def evolve(lengths: list[int], population: list[list[list[int]]], size: int, generations: int, rng: np.random.Generator, greedy: bool = True) -> list[list[list[int]]]:
    """The population after some generations, best first; ends early at the lower bound.

    An empty population is founded: with ``greedy`` by best fit in decreasing order and orders near it, else by
    best fit in random orders, so that crossover has to find the good bins.
    """
    bound = -(-sum(lengths) // size)
    by_length = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    if not population:
        population = [packed(by_length if greedy else rng.permutation(len(lengths)).tolist(), lengths, size)]
    scored = sorted(((fitness(p, lengths, size), p) for p in population), key=lambda x: x[0])
    while scored[0][0][0] > bound and len(scored) < POPULATION:
        order = np.argsort(-np.array(lengths) * rng.uniform(0.85, 1.15, len(lengths)), kind="stable") if greedy else rng.permutation(len(lengths))
        p = packed(order.tolist(), lengths, size)
        scored.append((fitness(p, lengths, size), p))
    scored.sort(key=lambda x: x[0])
    for _ in range(generations):
        if scored[0][0][0] <= bound:
            break
        a, b = sorted(rng.integers(0, len(scored), 2).tolist())
        child = crossover(scored[a][1], scored[b][1], lengths, size, rng)
        scored.append((fitness(child, lengths, size), child))
        scored.sort(key=lambda x: x[0])
        del scored[POPULATION:]
    return [p for _, p in scored]


def _labels(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, x in enumerate(bins):
        out[x] = b
    return out


def _bins(labels: np.ndarray) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(int(labels.max()) + 1)] if len(labels) else []
    for i, b in enumerate(labels.tolist()):
        out[b].append(i)
    return [x for x in out if x]


def pack_pieces(pieces: DataFrame, key: str, size: int, islands: int, epochs: int, generations: int, tag: int, group: int = GROUP) -> DataFrame:
    """``pieces`` with problem, bin, and the tokens left in that bin."""
    n = pieces.count()
    problems = max(1, round(n / group))
    dealt = pieces.withColumn("problem", F.pmod(F.xxhash64(F.col(key), F.col("piece"), F.lit(tag)), F.lit(problems)).cast("int"))
    state_schema = "problem int, island int, lengths binary, plan binary, bins int"

    def state(problem: int, island: int, lengths: np.ndarray, plans: list[list[list[int]]]) -> pd.DataFrame:
        rows = [(problem, island, lengths.tobytes(), _labels(p, len(lengths)).tobytes(), len(p)) for p in plans]
        return pd.DataFrame(rows, columns=["problem", "island", "lengths", "plan", "bins"])

    def start(keys, frame: pd.DataFrame) -> pd.DataFrame:
        lengths = np.sort(frame["length"].to_numpy(np.int32))[::-1].copy()
        rng = np.random.default_rng([tag, int(keys[0]), int(keys[1]), 0])
        return state(int(keys[0]), int(keys[1]), lengths, evolve(lengths.tolist(), [], size, generations, rng, greedy=int(keys[1]) == 0))

    def advance(epoch: int):
        def run(keys, frame: pd.DataFrame) -> pd.DataFrame:
            lengths = np.frombuffer(frame["lengths"].iloc[0], np.int32)
            plans = [_bins(np.frombuffer(p, np.int32)) for p in sorted(frame["plan"])]
            rng = np.random.default_rng([tag, int(keys[0]), int(keys[1]), epoch])
            return state(int(keys[0]), int(keys[1]), lengths, evolve(lengths.tolist(), plans, size, generations, rng)[:POPULATION])

        return run

    spread = dealt.select("problem", "length", F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"))
    plans = spread.groupBy("problem", "island").applyInPandas(start, state_schema)
    for epoch in range(1, epochs):
        plans = stage_table(plans, "islands")
        elite = plans.groupBy("problem", "island").agg(F.min_by(F.struct("lengths", "plan", "bins"), F.struct("bins", "plan")).alias("e"))
        migrants = elite.select("problem", ((F.col("island") + 1) % islands).alias("island"), "e.lengths", "e.plan", "e.bins")
        plans = plans.unionByName(migrants).groupBy("problem", "island").applyInPandas(advance(epoch), state_schema)
    best = plans.groupBy("problem").agg(F.min_by("plan", F.struct("bins", "plan")).alias("plan"))
    best = stage_table(best, "plans")
    names = [f.name for f in dealt.schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + ", bin int, free int"

    def assign(keys, rows: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame(columns=[*names, "bin", "free"])
        rows = rows.sort_values(["length", key, "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        labels = np.frombuffer(plan["plan"].iloc[0], np.int32)
        rows["bin"] = labels
        rows["free"] = (size - np.bincount(labels, rows["length"].to_numpy())[labels]).astype(np.int32)
        return rows

    return dealt.groupBy("problem").cogroup(best.groupBy("problem")).applyInPandas(assign, schema)


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, size: int = SIZE, islands: int = ISLANDS, epochs: int = EPOCHS, generations: int = GENERATIONS, with_ids: bool = False, slack: int = 24) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset (and ids on request)."""
    pieces = stage_table(token_pieces(docs, text, key, tokenizer, size, with_ids), "pieces")
    columns = pieces.columns
    whole = pieces.where(F.col("length") == size).withColumns({"problem": F.xxhash64(F.col(key), F.col("piece")), "bin": F.lit(-1), "free": F.lit(0)})
    first = stage_table(pack_pieces(pieces.where(F.col("length") < size), key, size, islands, epochs, generations, 1), "packed")
    again = pack_pieces(first.where(F.col("free") > slack).select(*columns), key, size, islands, epochs, generations, 2)
    tagged = [d.select(*columns, F.lit(t).alias("tag"), F.col("problem").cast("long").alias("problem"), "bin") for t, d in ((1, first.where(F.col("free") <= slack)), (2, again))]
    bins = tagged[0].unionByName(tagged[1]).withColumn("sequence_id", F.shiftleft(F.col("problem"), 24) * 4 + F.shiftleft(F.col("bin").cast("long"), 2) + F.col("tag"))
    single = whole.select(*columns, (F.monotonically_increasing_id() * 4).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    from pyspark.sql import Window

    before = Window.partitionBy("sequence_id").orderBy(F.desc("length"), key, "piece", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = bins.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select(*columns, "sequence_id", "offset").unionByName(single)
