"""Jaccard self-join on word n-grams by T-occurrence search, and the groups that its links make.

Two documents link when percent * |A or B| <= 100 * |A and B| for their sets of word shingles. A set of n
shingles shares at least T = ceil(percent * n / 100) with any partner. The join runs in four steps:

1. Counting. Postings (shingle, document) of all documents meet by shingle, packed, in slices sized by text
   volume; a shingle of one document alone goes no further. The others, with their numbers of documents,
   return to their documents. A document with fewer than T shared shingles has no partner.
2. Short lists. The shingles of a document in order of frequency, rarest first: of those that all documents
   order alike, two partners share one of the first n - T + 1. Only these lists, the short ones, propose
   candidates; the T - 1 more frequent shingles, the long lists, never do.
3. Rounds. Round one takes each short list as a star around its smallest document. Round two takes the lists
   whose documents are still in different groups: each document outside a list's largest group meets the
   others, in blocks, and only pairs that two bounds admit leave the block (the sizes, and the distance of
   parity bitmaps, which is never more than the number of shingles in one set only). So a group of m near
   copies costs about m pairs and not m squared; links inside a group cannot change it.
4. DivideSkip. Each document is a query against the inverted lists of a block of its candidates: a heap
   merges the short lists, candidates that can still reach their overlap are looked up in the long ones by
   binary search, and those that reach it are links.

Shingles that a sample finds frequent (FREQUENT at most) are not posted, or a third of all rows could meet in one
slice; they come last in the order and travel with their documents. A shingle outside that list is in less
than about 1/400 of the documents, since the frequent ones would fill the documents otherwise.

Shingles are 64-bit hashes of words, told apart by 40 bits and their slice; equal sets are found by 128 bits
and link without a search. Null texts and texts without words have the empty set and stay alone. Rows of one
key are one document for the groups: each row comes back, with its own n_shingles, and all have one component.
A row of null key is a document of its own; its component is the smallest key of its group, null if there is none.
Other columns are not read.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import drop_table, encoded, fraction_filter, mix, released, slices, span_hashes, stage_table, word_spans, trim
from factgraph.llm.graph import connected_components
from factgraph.llm.postings import pack_docs, slice_of, unpack_docs

N, PERCENT = 5, 75
#: The sample that finds frequent shingles, how many are remembered, and from how many sampled documents.
SAMPLE, FREQUENT, AT_LEAST = 1 / 16, 1 << 17, 3
#: Bytes of text whose postings make a slice, the least number of slices, and postings that a task holds before it sends them.
SLICE_TEXT, LEAST, FLUSH, FLUSH_DOCS = 8 << 20, 8, 400_000, 30_000
#: Documents of a list that are compared at once in round two; candidates of one search.
LIST_BLOCK, BLOCK = 256, 128
#: Bitmap bits for each shingle (rounded up to a power of two), and at most.
SPREAD, SIGNATURE = 8, 1 << 13
_COEFFICIENTS = np.random.default_rng(77).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOW = np.uint64((1 << 40) - 1)


def shingle_sets(texts: list[bytes], n: int = N) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; its whole word sequence as one where it has fewer than n words."""
    for _, part in slices(texts):
        data = _LOWER[np.frombuffer(b"\n".join(part), np.uint8)]
        starts, ends = word_spans(data)
        words = span_hashes(data, starts, ends)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in part)]))
        full = np.zeros(max(0, len(words) - n + 1), np.uint64)
        for k in range(n):
            full += words[k : len(words) - n + 1 + k] * _COEFFICIENTS[k]
        mix(full)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(full[a : b - n + 1])
            elif b > a:
                short = np.array([b - a], np.uint64)
                for k in range(b - a):
                    short = mix(short * _COEFFICIENTS[k + n] + words[a + k])
                yield short
            else:
                yield np.zeros(0, np.uint64)


def fingerprint(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set of hashes, as two signed longs."""
    size = np.array([len(s)], np.uint64)
    one = mix(s.sum(dtype=np.uint64, keepdims=True) + size) if len(s) else size
    two = mix(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True) ^ size) if len(s) else size
    return int(one.astype(np.int64)[0]), int(two.astype(np.int64)[0])


def signature(s: np.ndarray) -> bytes:
    """For each of 2**k buckets, SPREAD times the shingles or more (up to SIGNATURE), whether the count of shingles is odd."""
    if not len(s):
        return b""
    bits = min(SIGNATURE, 1 << max(63, SPREAD * len(s) - 1).bit_length())
    spot = mix(s.astype(np.uint64)) & np.uint64(bits - 1)
    return np.packbits(np.bincount(spot.astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def far_apart(x: bytes, nx: int, y: bytes, ny: int, percent: int) -> bool:
    """True only if the two sets can't link."""
    frame = pd.DataFrame({"id": [1, 2], "component": [1, 2], "n": [nx, ny], "m": [nx, ny], "bits": [x, y], "minor": [True, False]})
    return not admitted_pairs(frame, percent)


def needed(n: int, percent: int) -> int:
    """The smallest overlap that a set of n can have with any partner."""
    return -(-percent * n // 100)


def divide_skip(query: np.ndarray, sizes: list[int], candidates: list[np.ndarray], size: int, percent: int) -> list[bool]:
    """Which candidates link with the query.

    ``query`` and ``candidates`` hold the sorted shingles that can be shared, ``size`` and ``sizes`` count all shingles.
    The query's shingles have inverted lists over the candidates. The L longest are set apart; a heap merges
    the others in order of candidate. A candidate that they give a count within L of the overlap that it
    needs is probed in the long lists by binary search, until it reaches that overlap or no longer can.
    """
    out = [False] * len(candidates)
    if not len(query) or not candidates:
        return out
    need = [-(-percent * (size + n) // (100 + percent)) for n in sizes]
    flat = np.concatenate(candidates)
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    at = np.minimum(np.searchsorted(query, flat), len(query) - 1)
    hit = query[at] == flat
    token, doc = at[hit], owner[hit]
    order = np.lexsort((doc, token))
    length = np.bincount(token, minlength=len(query))
    lists = sorted((x.tolist() for x in np.split(doc[order], np.cumsum(length)[:-1]) if len(x)), key=len)
    least = min(need)
    if not lists or least > len(lists):
        return out
    n_long = min(least - 1, int(least / (0.01 * np.log(max(2, len(lists[-1]))) + 1)))
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    while heap:
        now, count = heap[0][0], 0
        while heap and heap[0][0] == now:
            _, k, i = heap[0]
            count += 1
            if i + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][i + 1], k, i + 1))
            else:
                heapq.heappop(heap)
        left = n_long
        if count + left < need[now]:
            continue
        for block in reversed(long):
            if count >= need[now] or count + left < need[now]:
                break
            i = bisect_left(block, now)
            count += i < len(block) and block[i] == now
            left -= 1
        out[now] = count >= need[now]
    return out


def _sets(docs: DataFrame, key: str, text: str, n: int, body, schema: str) -> DataFrame:
    """``body``(keys, sets) for each batch gives record batches of ``schema``."""
    plain = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512))
        yield from body((b.column(0).to_pylist(), shingle_sets(encoded(b.column(1)), n)) for b in parts)

    return plain.mapInArrow(released(run), schema)


def frequent_shingles(docs: DataFrame, key: str, text: str, n: int) -> np.ndarray:
    """Shingles of AT_LEAST sampled documents or more, the FREQUENT most frequent at most, rarest first."""

    def body(batches):
        for _, sets in batches:
            for s in sets:
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int64))], names=["token"])

    tokens = _sets(docs.where(fraction_filter(key, SAMPLE)), key, text, n, body, "token long")
    top = tokens.groupBy("token").count().where(F.col("count") >= AT_LEAST).orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toPandas()
    return top["token"].to_numpy(np.int64).astype(np.uint64)[::-1].copy()


class _Frequent:
    """Splits a set into its frequent shingles, as ranks, and the others."""

    def __init__(self, tokens: np.ndarray):
        self.rank = np.argsort(tokens).astype(np.int32)
        self.tokens = tokens[self.rank]

    def split(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.tokens) or not len(s):
            return np.zeros(0, np.int32), s
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        known = self.tokens[at] == s
        return np.sort(self.rank[at[known]]), s[~known]


def _block_of(ids: np.ndarray, blocks: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64)


def _cuts(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    at = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1], [True]])) if len(sorted_keys) else []
    yield from zip(at[:-1], at[1:], strict=True)


def shared_sets(docs: DataFrame, measured: DataFrame, frequent, slices_n: int, text: str, key: str, n: int, percent: int) -> DataFrame:
    """(id, n, m, prefix, s, bits) of the documents of ``measured`` that can have a partner: their short lists, all m shared shingles, and the bitmap of these."""

    def post(batches):
        sets_: list[np.ndarray] = []
        ids: list[int] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.concatenate(sets_) if sets_ else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(ids), dtype=np.uint16), [len(s) for s in sets_])
            where = slice_of(keys, slices_n)
            order = np.argsort(where.astype(np.uint16) if slices_n < 1 << 16 else where, kind="stable")
            keys, owner, where = keys[order], owner[order], where[order]
            rows = []
            for a, b in _cuts(where):
                used, local = np.unique(owner[a:b], return_inverse=True)
                low = keys[a:b] & _LOW
                packed = low.astype(np.uint32).tobytes() + (low >> np.uint64(32)).astype(np.uint8).tobytes()
                rows.append((int(where[a]), packed, local.astype(np.uint16).tobytes(), pack_docs(np.array(ids, np.int64)[used][:, None])))
            sets_.clear()
            ids.clear()
            if rows:
                c = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int32()), *(pa.array(x, pa.binary()) for x in c[1:])], names=["slice", "keys", "owners", "docs"])

        size = 0
        for keys, sets in batches:
            for k, s in zip(keys, sets, strict=True):
                _, rest = frequent.value.split(s)
                if not len(rest):
                    continue
                sets_.append(rest)
                ids.append(k)
                size += len(rest)
                if size >= FLUSH or len(ids) >= FLUSH_DOCS:
                    yield from flush()
                    size = 0
        yield from flush()

    back = "block int, slice int, ids binary, tokens binary, counts binary"

    def count(table: pa.Table) -> pa.Table:
        """The shingles of a slice that several documents have, back to the documents."""
        trim()
        keys, owner, ids, base = [], [], [], 0
        for k, o, d in zip(*(table.column(c).to_pylist() for c in ("keys", "owners", "docs")), strict=True):
            d, m = unpack_docs(d, 1)[:, 0], len(o) // 2
            keys.append(np.frombuffer(k, np.uint32, m).astype(np.uint64) | np.frombuffer(k, np.uint8, m, 4 * m).astype(np.uint64) << np.uint64(32))
            owner.append(np.frombuffer(o, np.uint16).astype(np.int32) + base)
            ids.append(d)
            base += len(d)
        key, ids = np.concatenate(keys), np.concatenate(ids)
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([first, [len(key)]]))
        many = np.repeat(many, many)
        pick = np.flatnonzero(many > 1)
        key, many, ids = key[pick], np.minimum(many[pick], 65535), ids[np.concatenate(owner)[order[pick]]]
        block = _block_of(ids, slices_n)
        order = np.lexsort((ids, block))
        key, many, ids, block = key[order], many[order], ids[order], block[order]
        rows = [(int(block[a]), zstandard.compress(np.diff(ids[a:b], prepend=0).tobytes(), 1), key[a:b].astype(np.uint32).tobytes() + (key[a:b] >> np.uint64(32)).astype(np.uint8).tobytes(), many[a:b].astype(np.uint16).tobytes()) for a, b in _cuts(block)]
        c = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({"block": pa.array(c[0], pa.int32()), "slice": pa.array([table.column("slice")[0].as_py()] * len(rows), pa.int32()), **{k: pa.array(x, pa.binary()) for k, x in zip(("ids", "tokens", "counts"), c[1:], strict=True)}})

    types = [("id", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("prefix", pa.list_(pa.int64())), ("s", pa.binary()), ("bits", pa.binary())]

    def gather(own: pa.Table, replies: pa.Table) -> pa.Table:
        """Of the documents of a block those that share enough."""
        trim()
        out: list[tuple] = []
        names, order = np.unique(own.column("id").to_numpy(), return_index=True) if own.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = own.column("n").to_numpy()[order] if own.num_rows else order
        ids, tokens, counts = [], [], []
        for i, t, c, s in zip(*(replies.column(x).to_pylist() for x in ("ids", "tokens", "counts", "slice")), strict=True):
            m = len(c) // 2
            ids.append(np.cumsum(np.frombuffer(zstandard.decompress(i), np.int64)))
            tokens.append(np.frombuffer(t, np.uint32, m).astype(np.int64) | np.frombuffer(t, np.uint8, m, 4 * m).astype(np.int64) << 32 | (s + 1) << 40)
            counts.append(np.frombuffer(c, np.uint16).astype(np.int32))
        common = [np.frombuffer(x, np.int32) for x in own.column("frequent").take(pa.array(order)).to_pylist()] if own.num_rows else []
        ids.extend(np.full(len(x), i) for x, i in zip(common, names.tolist(), strict=True))
        tokens.extend(x.astype(np.int64) for x in common)
        counts.append(np.full(sum(map(len, common)), 1 << 20, np.int32))
        if len(names):
            ids_, token, count_ = np.concatenate(ids), np.concatenate(tokens), np.concatenate(counts)
            doc = np.minimum(np.searchsorted(names, ids_), len(names) - 1)
            shared = np.bincount(doc[names[doc] == ids_], minlength=len(names))
            enough = shared >= np.maximum(1, -(-percent * n // 100))
            use = np.flatnonzero((names[doc] == ids_) & enough[doc])
            use = use[np.lexsort((token[use], count_[use], doc[use]))]
            doc, token = doc[use], token[use]
            for a, b in _cuts(doc):
                d, mine = int(doc[a]), token[a:b]
                s = np.sort(mine).astype(np.uint64)
                out.append((int(names[d]), int(n[d]), len(mine), mine[: len(mine) - needed(int(n[d]), percent) + 1], s.tobytes(), signature(s)))
        c = list(zip(*out, strict=True)) or [[]] * 6
        return pa.table({k: pa.array(x, t) for (k, t), x in zip(types, c, strict=True)})

    counted = _sets(docs, key, text, n, post, "slice int, keys binary, owners binary, docs binary").groupBy("slice").applyInArrow(count, back)
    return measured.select("block", "id", "n", "frequent").groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(gather, "id long, n long, m long, prefix array<long>, s binary, bits binary")


def ngram_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component) of every row: the component is the smallest key reachable by links."""
    if docs.groupBy(F.col(key)).count().where(F.col(key).isNull() | (F.col("count") > 1)).isEmpty():
        return _groups(docs, text, key, n, percent, None)
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text")).groupBy("id", "text").agg(F.count("*").alias("times"))
    rows = stage_table(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
    first = rows.groupBy("id").agg(F.min("row").alias("a"))
    same = rows.join(first, "id").where("a <> row").select("a", F.col("row").alias("b"))
    found = _groups(rows, "text", "row", n, percent, same).withColumnRenamed("id", "row").join(rows.select("row", "id", "times"), "row")
    names = found.groupBy("component").agg(F.min("id").alias("name"))
    return found.join(names, "component").select("id", "n_shingles", F.col("name").alias("component"), F.explode(F.sequence(F.lit(1), F.col("times")))).drop("col")


def _groups(docs: DataFrame, text: str, key: str, n: int, percent: int, same: DataFrame | None) -> DataFrame:
    """``ngram_groups`` of unique keys; ``same`` holds further links (a, b)."""
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    slices_n = int(max(LEAST, volume // SLICE_TEXT))
    frequent = spark.sparkContext.broadcast(_Frequent(frequent_shingles(docs, key, text, n)))

    def sizes(batches):
        for keys, sets in batches:
            rows = [(k, len(s), *fingerprint(s), frequent.value.split(s)[0].tobytes()) for k, s in zip(keys, sets, strict=True)]
            c = list(zip(*rows, strict=True)) or [[]] * 5
            block = _block_of(np.array(c[0], np.int64), slices_n)
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], pa.binary()), pa.array(block, pa.int32())], names=["id", "n", "f1", "f2", "frequent", "block"])

    measured = stage_table(_sets(docs, key, text, n, sizes, "id long, n long, f1 long, f2 long, frequent binary, block int"), "sets")
    equal = measured.where("n > 0").groupBy("f1", "f2", "n").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1")
    copies = stage_table(measured.join(equal, ["f1", "f2", "n"]).where("id <> rep").select("id", "rep"), "copies")
    firsts = measured.where("n > 0").join(copies.select("id"), "id", "left_anti")
    able = stage_table(shared_sets(docs, firsts, frequent, slices_n, text, key, n, percent), "able")

    # Round one: each short list is a star around its smallest document. Equal lists of several shingles count once.
    members = able.select("id", "n", F.explode("prefix").alias("list"))
    lists = members.groupBy("list").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("id")).alias("x")).where("c > 1")
    lists = lists.groupBy("hub", "c", "x").agg(F.min("list").alias("list"))
    shared = stage_table(members.join(lists, "list").select("list", "hub", "id", "n"), "lists")
    fits = F.lit(percent) * F.greatest("n", "hub.n") <= F.lit(100) * F.least("n", "hub.n")
    near = stage_table(shared.where(fits & (F.col("id") != F.col("hub.id"))).select(F.col("hub.id").alias("a"), F.col("id").alias("b")).distinct(), "stars")
    links = verify(near, able, percent)
    links = stage_table(links if same is None else links.unionByName(same), "links")
    groups = stage_table(connected_components(links), "groups")

    # Round two: of each list, the pairs of documents that are still in different groups.
    placed = shared.select("list", "id", "n").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id"))
    per = placed.groupBy("list", "component").agg(F.count("*").alias("k"))
    main = per.groupBy("list").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("c"), F.count("*").alias("kinds")).where("kinds > 1")
    main = main.select("list", "main", F.ceil(F.col("c") / LIST_BLOCK).cast("int").alias("nj"), F.ceil((F.col("c") - F.col("k")) / LIST_BLOCK).cast("int").alias("ni"))
    open_ = stage_table(placed.join(main, "list"), "open")
    member = open_.join(able.select("id", "m", "bits"), "id")
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["list", "id", "component", "n", "m", "bits"]
    all_ = member.select(*columns, place("nj").alias("j"), every("ni").alias("i"), F.lit(False).alias("minor"))
    minor = member.where("component <> main").select(*columns, place("ni").alias("i"), every("nj").alias("j"), F.lit(True).alias("minor"))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(admitted_pairs(frame, percent), columns=["a", "b"], dtype=np.int64)

    rest = all_.unionByName(minor).groupBy("list", "i", "j").applyInPandas(compare, "a long, b long").distinct()
    rest = stage_table(rest.join(near, ["a", "b"], "left_anti"), "rest")
    more = None if rest.isEmpty() else stage_table(verify(rest, able, percent), "links")
    if more is not None and not more.isEmpty():
        between = more.join(groups.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(groups.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        merged = connected_components(between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        names = groups.unionByName(more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(groups, "id", "left_anti").withColumn("component", F.col("id")))
        groups = stage_table(names.join(merged.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component")), "groups")
    for done in (able, shared, near, links, open_, rest):
        drop_table(done)
    own = measured.select("id", "n").join(copies, "id", "left").withColumn("node", F.coalesce("rep", "id"))
    return own.join(groups.withColumnRenamed("id", "node"), "node", "left").select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component"))


def admitted_pairs(frame: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Pairs of a minor document with any other of another component that sizes and bitmaps do not rule out."""
    minor = frame["minor"].to_numpy()
    rest = frame[~minor]
    ids, component, n, m = (rest[c].to_numpy() for c in ("id", "component", "n", "m"))
    width = np.array([len(x) for x in rest["bits"]])
    tables = {w: (np.flatnonzero(width == w), np.stack([np.frombuffer(x, np.uint64) for x in rest["bits"][width == w]])) for w in np.unique(width).tolist()}
    out: set[tuple[int, int]] = set()
    for id_, c, size, shared, bits in zip(*(frame[k][minor].to_numpy() for k in ("id", "component", "n", "m", "bits")), strict=True):
        own = np.frombuffer(bits, np.uint64)
        for rows, table in tables.values():
            fit = np.flatnonzero((component[rows] != c) & (percent * np.maximum(n[rows], size) <= 100 * np.minimum(n[rows], size)))
            if not len(fit):
                continue
            x, y = own, table[fit]
            while len(x) > y.shape[1]:  # bucket i of the smaller is buckets i and i + half of the larger
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            while y.shape[1] > len(x):
                y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
            need = -(-percent * (n[rows][fit] + size) // (100 + percent))
            near = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= m[rows][fit] + shared - 2 * need
            out.update((min(id_, b), max(id_, b)) for b in ids[rows][fit][near].tolist())
    return sorted(out)


def verify(pairs: DataFrame, able: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Each a is a query against the inverted lists of blocks of its candidates b."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = able.select("id", "n", "s").join(ids, "id", "left_semi")
    counted = pairs.join(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "a")
    blocked = counted.withColumn("block", F.pmod(F.xxhash64("b"), F.col("blocks")).cast("int"))
    candidates = blocked.select("a", "block", F.col("b").alias("id")).join(sets, "id")
    queries = counted.select("a", "blocks").distinct().select("a", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).join(sets.withColumnRenamed("id", "a"), "a")

    def search(keys, frame: pd.DataFrame) -> pd.DataFrame:
        asks = frame["query"].to_numpy()
        if asks.all() or not asks.any():
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        sets_ = [np.frombuffer(x, np.uint64) for x in frame["s"][~asks]]
        found = divide_skip(np.frombuffer(frame["s"][asks].iloc[0], np.uint64), frame["n"][~asks].tolist(), sets_, int(frame["n"][asks].iloc[0]), percent)
        b = frame["id"][~asks].to_numpy()[np.array(found)]
        return pd.DataFrame({"a": np.full(len(b), keys[0], np.int64), "b": b})

    both = candidates.withColumn("query", F.lit(False)).unionByName(queries.select("a", "block", F.col("a").alias("id"), "n", "s", F.lit(True).alias("query")))
    return both.groupBy("a", "block").applyInPandas(search, "a long, b long")
