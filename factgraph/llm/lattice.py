"""SentencePiece encoding as a relational lattice, and decoding.

A text is led by the space mark, spaces become marks, and each run of marks or line starts a new word; no
piece of the model reaches over such a bound. The lattice
of a word has an edge for each of its substrings that is a piece, and one for each character as its UTF-8
byte pieces, at a score below all others. ``encode_words`` builds it relationally: substrings of bounded
length are exploded, equi-joined to the piece table, grouped by word, and the best path is folded with
``aggregate`` over the edges in order of their end. Among equal paths the longer last piece wins.

``encode`` counts the words of all documents, of LONGEST characters at most, and encodes the DICTIONARY most
frequent ones so; that table has a fixed bound and is broadcast. Rarer and longer words take the same fold where
the documents are read, side by side, for a relational lattice of every distinct word of a corpus, and the ids that
it sends back to the documents, would be several times the corpus on disk. The ids do not depend on which way a
word went. Null texts are empty and have no pieces; texts and words of any length are encoded whole. Rows are
encoded one by one, so repeated rows come back as often; an empty table gives an empty one. Of the columns those in
``keep`` stay, and one named like the result can't be kept.
"""

from __future__ import annotations

import functools
import re
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.llm.common import _tables, drop_table, mix, released, stage_table

MARK, LONGEST, DICTIONARY, RARE = "▁", 48, 1 << 17, 300_000
#: Characters of words that are folded side by side, slots that lead to the piece table, documents handled at once, and words counted before they are sent.
AT_ONCE, SLOTS, ROWS, COUNTED = 48, 1 << 20, 256, 300_000
WORD = re.compile(r"\n|▁+[^▁\n]*|[^▁\n]+")


@functools.lru_cache(maxsize=4)
def piece_table(path: str) -> tuple[dict[str, tuple[int, float]], int, float, list[str]]:
    """Pieces with id and score, id of byte 0, the score of a byte, and the text of every id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    plain = {model.id_to_piece(i): (i, model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))}
    least = min(s for _, s in plain.values())
    return plain, model.piece_to_id("<0x00>"), least - 10.0, [model.id_to_piece(i) for i in range(n)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words_of(text: str) -> list[str]:
    """Words whose concatenation is the marked text; none for an empty text."""
    return WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Folder:
    """The best paths of words, by the same fold as ``encode_words``.

    ``table`` holds the ids of known words; those added to it, RARE at most, are listed in ``rare``.

    ``many`` folds words of AT_ONCE characters at most side by side: the hashes of all their substrings are looked
    up in the piece table, and each step of the fold goes over all words. Longer words are folded one by one.
    """

    def __init__(self, path: str):
        self.table: dict[str, bytes] = {}
        self.rare: list[str] = []
        self.pieces, self.byte0, self.fallback, _ = piece_table(path)
        self.longest = max(map(len, self.pieces))
        text = list(self.pieces)
        codes, first = _codes(text)
        sizes = np.array([len(t) for t in text])
        hashes = _prefix(codes)
        found = np.concatenate([_spans(hashes, first[sizes == n], n) for n in range(1, self.longest + 1)])
        order = np.argsort(found)
        rank = np.concatenate([np.flatnonzero(sizes == n) for n in range(1, self.longest + 1)])[order]
        self.hashes = found[order]
        self.ids = np.array([self.pieces[t][0] for t in text], np.int32)[rank]
        self.scores = np.array([self.pieces[t][1] for t in text])[rank]
        spot = (self.hashes & np.uint64(SLOTS - 1)).astype(np.int64)
        self.slots = np.full(SLOTS, -1, np.int32)
        self.slots[spot] = np.arange(len(spot))
        many = np.bincount(spot, minlength=SLOTS) > 1
        self.slots[many] = -2  # several pieces

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are pieces, and their places in the table."""
        place = self.slots[(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
        shared = np.flatnonzero(place == -2)
        place[shared] = np.minimum(np.searchsorted(self.hashes, hashes[shared]), len(self.hashes) - 1)
        maybe = np.flatnonzero(place >= 0)
        hit = maybe[self.hashes[place[maybe]] == hashes[maybe]]
        return hit, place[hit]

    def __call__(self, word: str) -> list[int]:
        n, get = len(word), self.pieces.get
        best, steps, ids = array("d", [0.0]), array("i", [0]), array("i", [0])
        for end in range(1, n + 1):
            top, step, which = best[end - 1] + self.fallback * len(word[end - 1].encode()), 1, -1
            for start in range(max(0, end - self.longest), end):
                hit = get(word[start:end])
                if hit:
                    score = best[start] + hit[1]
                    if score > top or score == top and which < 0:
                        top, step, which = score, end - start, hit[0]
            best.append(top)
            steps.append(step)
            ids.append(which)
        out: list[int] = []
        while n:
            step, which = steps[n], ids[n]
            out.extend([which] if which >= 0 else [self.byte0 + b for b in reversed(word[n - 1].encode())])
            n -= step
        return out[::-1]

    def learn(self, table: dict[str, bytes], texts: list[list[str]]) -> dict[str, bytes]:
        """``table`` with all words of the texts; words over LONGEST characters only for now, in a table of their own."""
        if table is not self.table:
            self.table, self.rare = table, []
        if len(self.rare) > RARE:
            for w in self.rare:
                del table[w]
            self.rare.clear()
        new = list(set().union(*({*words}.difference(table) for words in texts)))
        found = dict(zip(new, self.many(new), strict=True))
        short = [w for w in new if len(w) <= LONGEST]
        self.rare += short
        table.update((w, found[w]) for w in short)
        return {w: found[w] for w in new if len(w) > LONGEST}

    def many(self, words: list[str]) -> list[bytes]:
        """Little-endian int32 ids of each word."""
        out = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= AT_ONCE), key=lambda i: -len(words[i]))
        odd = [i for i, w in enumerate(words) if len(w) > AT_ONCE]
        if short:
            paths, plain = self._side_by_side([words[i] for i in short])
            for i, path, ok in zip(short, paths, plain, strict=True):
                out[i] = path
                if not ok:
                    odd.append(i)
        for i in odd:
            out[i] = np.array(self(words[i]), np.int32).tobytes()
        return out

    def _side_by_side(self, words: list[str]) -> tuple[list[bytes], list[bool]]:
        """Paths of words, longest first, and which have no byte pieces."""
        codes, first = _codes(words)
        sizes = np.array([len(w) for w in words])
        hashes, n = _prefix(codes), len(codes)
        score, which = np.full((self.longest + 1, n), -np.inf), np.full((self.longest + 1, n), -1, np.int32)
        start, stop = np.arange(n), np.repeat(first + sizes, sizes)
        for size in range(1, min(self.longest, int(sizes[0])) + 1):
            start = start[start + size <= stop[start]]  # inside the word
            hit, place = self.find(_spans(hashes, start, size))
            at = start[hit]
            score[size, at], which[size, at] = self.scores[place], self.ids[place]
        octets = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        node = first + np.arange(len(words))  # of each word's start: a word has one node more than characters
        best, step, piece = np.zeros(n + len(words)), np.zeros(n + len(words), np.int32), np.full(n + len(words), -1, np.int32)
        for end in range(1, int(sizes[0]) + 1):
            active = int(np.searchsorted(-sizes, -end, "right"))
            base, begin = node[:active], first[:active]
            top, long, id_ = best[base + end - 1] + self.fallback * octets[begin + end - 1], np.ones(active, np.int32), np.full(active, -1, np.int32)
            for size in range(min(self.longest, end), 0, -1):
                found = best[base + end - size] + score[size, begin + end - size]
                better = (found > top) | ((found == top) & (id_ < 0))
                if better.any():
                    top[better], long[better], id_[better] = found[better], size, which[size, (begin + end - size)[better]]
            best[base + end], step[base + end], piece[base + end] = top, long, id_
        owner, path, turn = [], [], []
        live, at = np.arange(len(words)), sizes.copy()
        for k in range(int(sizes[0])):
            here = node[live] + at[live]
            owner.append(live)
            path.append(piece[here])
            turn.append(np.full(len(live), -k))
            at[live] -= step[here]
            live = live[at[live] > 0]
            if not len(live):
                break
        owner_, path_ = np.concatenate(owner), np.concatenate(path)
        order = np.lexsort((np.concatenate(turn), owner_))
        owner_, path_ = owner_[order], path_[order]
        bounds = np.searchsorted(owner_, np.arange(len(words) + 1)).tolist()
        plain = np.ones(len(words), bool)
        plain[owner_[path_ < 0]] = False
        data = path_.astype("<i4").tobytes()
        return [data[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], plain.tolist()


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of words one after the other, and where each begins."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, words[:-1])])


def _prefix(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _tables(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=sums[1:])
    return sums, down


def _spans(prefix: tuple[np.ndarray, np.ndarray], start: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of the spans of ``size`` code points, equal for equal spans wherever they stand."""
    sums, down = prefix
    return mix((sums[start + size] - sums[start]) * down[start] ^ np.uint64(size))


@functools.lru_cache(maxsize=4)
def folder(path: str) -> Folder:
    """The folder of this Python worker, kept from task to task."""
    return Folder(path)


def encode_words(words: DataFrame, path: str | None = None, word: str = "word") -> DataFrame:
    """(word, ids) of a table of distinct words, relationally."""
    spark = words.sparkSession
    path = path or default_path()
    pieces, byte0, fallback, _ = piece_table(path)
    longest = max(map(len, pieces))
    rows = pa.table({"piece": list(pieces), "id": pa.array([i for i, _ in pieces.values()], pa.int32()), "score": pa.array([s for _, s in pieces.values()], pa.float64())})
    table = spark.createDataFrame(rows)  # as many rows as the vocabulary, whatever the corpus
    base = words.select(F.col(word).alias("word")).where(F.length("word") > 0)
    starts = base.select("word", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("start"))
    spans = starts.select("word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - F.col("start") + 1))).alias("n"))
    cut = spans.withColumn("piece", F.substring("word", F.col("start"), F.col("n")))
    edges = cut.join(F.broadcast(table), "piece").select("word", (F.col("start") + F.col("n") - 1).alias("end"), "n", "score", F.array("id").alias("ids"))
    one = F.substring("word", F.col("start"), F.lit(1))
    coded = F.hex(F.encode(one, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(0), F.octet_length(one) - 1), lambda i: (F.conv(F.substring(coded, i * 2 + 1, F.lit(2)), 16, 10).cast("int") + byte0))
    bytes_ = starts.select("word", F.col("start").alias("end"), F.lit(0).alias("n"), (F.lit(fallback) * F.octet_length(one)).alias("score"), octets.alias("ids"))
    grouped = edges.unionByName(bytes_).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("end", (-F.col("n")).alias("order"), "score", "ids"))).alias("edges"))
    first = F.struct(F.array(F.lit(0.0)).alias("best"), F.array(F.array().cast("array<int>")).alias("path"))

    def fold(acc, e):
        n = F.greatest(-e["order"], F.lit(1))
        score = F.get(acc["best"], e["end"] - n) + e["score"]
        path_ = F.concat(F.get(acc["path"], e["end"] - n), e["ids"])
        grown = F.struct(F.concat(acc["best"], F.array(score)).alias("best"), F.concat(acc["path"], F.array(path_)).alias("path"))
        replaced = F.struct(F.concat(F.slice(acc["best"], 1, e["end"]), F.array(score)).alias("best"), F.concat(F.slice(acc["path"], 1, e["end"]), F.array(path_)).alias("path"))
        return F.when(F.size(acc["best"]) == e["end"], grown).when(score > F.get(acc["best"], e["end"]), replaced).otherwise(acc)

    return grouped.select("word", F.element_at(F.aggregate("edges", first, fold)["path"], -1).alias("ids"))


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, count) over all documents of the words of LONGEST characters at most, summed up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            short = [(w, n) for w, n in counts.items() if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["word", "count"])

        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                for t in b.column(0).slice(at, ROWS).to_pylist():
                    counts.update(words_of(t or ""))
                    if len(counts) > COUNTED:
                        yield out()
                        counts.clear()
        yield out()

    return docs.select(F.col(text).cast("string")).mapInArrow(released(run), "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


def encode(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), path: str | None = None, dictionary: int = DICTIONARY, checked: bool = False) -> DataFrame:
    """``keep`` columns and ids of every row; with ``checked`` also round_trip, whether decoding gives the text back (null counts as empty)."""
    spark = docs.sparkSession
    path = path or default_path()
    frequent = stage_table(count_words(docs, text).orderBy(F.desc("count"), "word").limit(dictionary).select("word"), "words")
    table = {r["word"]: np.array(r["ids"], np.int32).tobytes() for r in encode_words(frequent, path).toLocalIterator()}
    drop_table(frequent)
    sent = spark.sparkContext.broadcast(table)
    plain = docs.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), "ids array<int>", *(["round_trip boolean"] if checked else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, fold = sent.value, folder(path)
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                whole = [t or "" for t in b.column(b.num_columns - 1).to_pylist()]
                texts = list(map(words_of, whole))
                long = fold.learn(table, texts)
                offsets, parts = [0], []
                for words in texts:
                    part = b"".join([long[w] if w in long else table[w] for w in words] if long else map(table.__getitem__, words))
                    parts.append(part)
                    offsets.append(offsets[-1] + len(part) // 4)
                values = pa.array(np.frombuffer(b"".join(parts), np.int32))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                back = [pa.array([x == t for x, t in zip(spell(ids, path), whole, strict=True)], pa.bool_())] if checked else []
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, *back], names=[*keep, "ids", *(["round_trip"] if checked else [])])

    return plain.mapInArrow(released(run), schema)


@functools.lru_cache(maxsize=4)
def spellings(path: str) -> np.ndarray:
    """The bytes of every id."""
    _, byte0, _, texts = piece_table(path)
    return np.array([bytes([i - byte0]) if byte0 <= i < byte0 + 256 else t.replace(MARK, " ").encode() for i, t in enumerate(texts)], dtype=object)


def spell(ids: pa.ListArray, path: str) -> list[str]:
    """The text of each list of ids; a null list is empty."""
    lengths = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    words = spellings(path)[ids.flatten().to_numpy()]
    return [b"".join(words[e - n : e].tolist()).decode("utf-8", "replace")[1:] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]


def decode(encoded: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Replaces ``ids`` by the text that they spell; null ids are an empty text."""
    path = path or default_path()
    others = [c for c in encoded.columns if c != ids]
    plain = encoded.select(*[F.col(f"`{c}`") for c in others], F.col(ids).alias("__ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, ROWS):
                b = big.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(spell(b.column(b.num_columns - 1), path), pa.string())], names=[*others, out])

    return plain.mapInArrow(released(run), schema)


def session_words(spark: SparkSession, words: list[str]) -> DataFrame:
    return spark.createDataFrame([(w,) for w in words], "word string")
