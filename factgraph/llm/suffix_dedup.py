"""Removal of byte strings that an earlier document has too, by suffix arrays.

A byte goes when a string of ``width`` bytes covers it that also starts in a document with a smaller key.

1. Anchors. Of the grams of GRAM bytes inside each string the one of smallest hash is its anchor, so equal
   strings have equal anchors. Anchors travel as postings; those of one text only cannot matter and end here.
2. Contexts. Around each shared anchor the text is cut out that holds all strings with this anchor. Each
   block of documents sends a context once, with the smallest and largest key that has it, to the slice of
   its anchor, so all equal strings meet in one slice, and a passage of any number of documents costs a
   slice no more than one context a block.
3. Suffix array. A slice sorts the strings of its contexts by the difference-cover method (suffix_array.py)
   and compares adjacent prefixes; runs of equal strings give the smallest key for each string.
4. Each block applies the answers to its texts.

Texts travel to their blocks in compressed batches. The number of slices and blocks follows the bytes of
all texts (SLICE_TEXT and BLOCK_TEXT each), so that a task needs the same memory at every size.

Equal texts share one identity in steps 1 to 3: only the copy of smallest key takes part, and the others,
where long enough for one string, are covered whole. Null texts are empty. Rows with a null key keep their
text and remove nothing. Repeated keys are documents of equal rank: neither removes the other's bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm import postings
from factgraph.llm.common import BYTE_VALUES, _tables, mix, released, slices, span_hashes, stage_table, trim
from factgraph.llm.suffix_array import weak_ranks

WIDTH, GRAM = 50, 24
SLICE_TEXT, BLOCK_TEXT, BATCH_TEXT, LEAST = 1 << 20, 4 << 20, 12 << 20, 24
_TOP = np.uint64(0xFFFFFFFF00000000)


def anchor_runs(data: np.ndarray, ends: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of string starts with one anchor: first start, last start and the anchor's hash.

    ``data`` holds texts one after the other, ``ends`` where each ends; strings never cross an end.
    """
    n = len(data) - width + 1
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, empty.astype(np.uint64)
    up, down = _tables(len(data) + 1)
    prefix = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:-1], dtype=np.uint64, out=prefix[1:])
    hashes = mix((prefix[gram:] - prefix[:-gram]) * down[: len(data) - gram + 1])
    best = hashes & _TOP | np.arange(len(hashes), dtype=np.uint64)
    span, window = 1, width - gram + 1
    while span * 2 <= window:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    best = np.minimum(best[: n], best[window - span : window - span + n])
    inside = np.ones(n, bool)
    for e in ends[:-1].tolist():  # strings that would cross the end of a text
        inside[max(0, e - width + 1) : min(n, e)] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return empty, empty, empty.astype(np.uint64)
    anchor = best[starts] & np.uint64(0xFFFFFFFF)
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:] - 1, [len(starts) - 1]])
    return starts[at], starts[last], mix(hashes[anchor[at].astype(np.int64)] ^ np.uint64(0x5851F42D4C957F2D))  # anchors are small hashes; their keys must not be


def _identity(text: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _doc_runs(texts: list[bytes], width: int):
    """For slices of texts: data, start of each text, and the runs with the text that owns each."""
    for first, part in slices(texts):
        ends = np.cumsum([len(t) for t in part])
        data = np.frombuffer(b"".join(part), np.uint8)
        low, high, key = anchor_runs(data, ends, width)
        owner = np.searchsorted(ends, low, "right")
        yield first, part, data, ends, low, high, key, owner


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of all spans, one after the other."""
    offsets = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - offsets, sizes)]


def _to_blocks(frame: DataFrame) -> DataFrame:
    """(block, batch): the rows of each block, as compressed Arrow streams of about BATCH_TEXT bytes a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(table: pa.Table) -> pa.RecordBatch:
            table = table.take(pc.sort_indices(table.column("block")))
            numbers = table.column("block").to_numpy()
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]])), [len(numbers)]])
            blobs = []
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table.slice(a, b - a).combine_chunks())
                blobs.append(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_arrays([pa.array(numbers[edges[:-1]], pa.int32()), pa.array(blobs, pa.binary())], names=["block", "batch"])

        kept, size = [], 0
        for b in batches:
            kept.append(b)
            size += b.nbytes
            if size >= BATCH_TEXT:
                yield out(pa.Table.from_batches(kept))
                kept, size = [], 0
        if size:
            yield out(pa.Table.from_batches(kept))

    return frame.mapInArrow(released(run), "block int, batch binary")


def _from_batches(column) -> pa.Table | None:
    found = [pa.ipc.open_stream(x).read_all() for x in column.to_pylist()]
    return pa.concat_tables(found).combine_chunks() if found else None


def pieces_of(numbers: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(number, first, last + 1) of each run of a sorted array."""
    starts, count = postings.groups(numbers)
    for a, c in zip(starts.tolist(), count.tolist(), strict=True):
        yield int(numbers[a]), a, a + c


def _answers(hashes: np.ndarray, sizes: np.ndarray, text: np.ndarray, smallest: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """For distinct contexts: segments (context, first offset, last offset + 1, smallest key) of their strings."""
    begin = np.cumsum(sizes) - sizes
    runs = sizes - width + 1
    owner = np.repeat(np.arange(len(sizes)), runs)
    offset = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
    starts = begin[owner] + offset
    ranks = weak_ranks(text.astype(np.int64) + 1, width, starts)
    order = np.argsort(ranks, kind="stable")
    padded = np.concatenate([text, np.zeros(width, np.uint8)])
    equal = np.zeros(len(order), bool)  # equal to the string before it
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    for at in range(1, len(order), 1 << 17):
        b = order[at : at + (1 << 17)]
        a = order[at - 1 : at - 1 + len(b)]
        equal[at : at + len(b)] = (windows[starts[a]] == windows[starts[b]]).all(axis=1)
    group = np.cumsum(~equal) - 1
    low = np.full(int(group[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(low, group, smallest[owner[order]])
    answer = np.empty(len(order), np.int64)
    answer[order] = low[group]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (answer[1:] != answer[:-1])])
    at = np.flatnonzero(new)
    stop = np.concatenate([at[1:], [len(owner)]])
    return owner[at], offset[at], offset[stop - 1] + 1, answer[at]


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH, keep: tuple[str, ...] = (), as_text: bool = False) -> DataFrame:
    """One row per document: key, ``keep`` columns, n_bytes, n_removed, n_spans (maximal removed runs) and kept.

    ``kept`` is binary, or with ``as_text`` a string without the odd bytes of characters that were cut in two.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    volume = docs.agg(F.sum(F.octet_length(body))).first()[0] or 0
    blocks, slices_n = max(LEAST, volume // BLOCK_TEXT), max(LEAST, volume // SLICE_TEXT)
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)).cast("int")
    plain = docs.select(block.alias("block"), F.col(key).cast("long").alias("id"), body.alias("body"))
    known = plain.where("id is not null")

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = postings.Writer(slices_n, 3, marks=True)
        seen: dict[int, int] = {}
        for b in (big.slice(at, 512) for big in batches for at in range(0, big.num_rows, 512)):
            where, ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for first, part, _, _, _, _, keys, owner in _doc_runs(texts, width):
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                for i, t in enumerate(part):
                    j = first + i
                    if bounds[i] == bounds[i + 1]:
                        continue
                    name = _identity(t)
                    if name in seen:
                        at = seen[name]
                        writer.docs[at] = min(writer.docs[at], (ids[j], name, where[j]))
                        continue
                    seen[name] = len(writer.docs)
                    writer.add(np.unique(keys[bounds[i] : bounds[i + 1]]), ids[j], name, where[j])
                    if writer.full():
                        yield from writer.flush()
                        seen.clear()
        yield from writer.flush()

    def share(table: pa.Table) -> pa.Table:
        """Anchors of two identities or more, back to the smallest document of each identity."""
        trim()
        frame = table.to_pandas()
        parts = frame["part"].notna().to_numpy()
        found_keys, found_docs = [], []
        for key64, d in zip(frame["part"][parts], frame["docs"][parts], strict=True):
            d = postings.unpack_docs(d, 3)
            found_keys.append(np.full(len(d), int(key64), np.uint64))
            found_docs.append(d[:, [0, 2]])
        if not parts.all():
            keys, owner, attributes = postings.read_slice(frame[~parts], 4)
            starts, count = postings.groups(keys)
            names = attributes[owner, 1]
            many = np.minimum.reduceat(names, starts) != np.maximum.reduceat(names, starts)
            many |= np.bitwise_or.reduceat(attributes[owner, 3], starts) > 0
            pick = np.repeat(many, count)
            keys, rows = keys[pick], attributes[owner[pick]]
            order = np.lexsort((rows[:, 0], rows[:, 1], keys))
            keys, rows = keys[order], rows[order]
            lead = np.concatenate([[True], (keys[1:] != keys[:-1]) | (rows[1:, 1] != rows[:-1, 1])]) if len(keys) else np.zeros(0, bool)
            found_keys.append(np.uint64(int(frame["slice"].iloc[0]) << 32) | keys[lead].astype(np.uint64))
            found_docs.append(rows[lead][:, [0, 2]])
        out: list[tuple] = []
        keys, rows = np.concatenate(found_keys), np.concatenate(found_docs)
        order = np.argsort(rows[:, 1], kind="stable")
        keys, rows = keys[order], rows[order]
        for b, x, y in pieces_of(rows[:, 1]):
            out.append((b, None, keys[x:y].tobytes(), np.ascontiguousarray(rows[x:y, 0]).tobytes()))
        return replies_table(out)

    def replies_table(rows: list[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table({n: pa.array(c, t) for (n, t), c in zip((("block", pa.int32()), ("batch", pa.binary()), ("one", pa.binary()), ("two", pa.binary())), cols, strict=True)})

    back = "block int, batch binary, one binary, two binary"
    shared = known.mapInArrow(released(post), postings.SCHEMA).groupBy("slice").applyInArrow(share, back)

    def contexts(table: pa.Table) -> pa.Table:
        """Distinct contexts of a block, packed by slice."""
        trim()
        is_doc = table.column("batch").is_valid().to_numpy()
        replies = table.filter(pa.array(~is_doc))
        empty = pa.table({n: pa.array([], t) for n, t in CONTEXT_TYPES})
        if not replies.num_rows:
            return empty
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in replies.column("one").to_pylist()])
        ids = np.concatenate([np.frombuffer(x, np.int64) for x in replies.column("two").to_pylist()])
        order = np.argsort(ids, kind="stable")
        keys, ids = keys[order], ids[order]
        own = _from_batches(table.column("batch").filter(pa.array(is_doc)))
        named = own.column("id").to_numpy()
        at, to = np.searchsorted(ids, named, "left"), np.searchsorted(ids, named, "right")
        chosen = np.flatnonzero(at < to)
        texts = own.column("body").take(pa.array(chosen)).to_pylist()
        parts = []
        for first, part, data, ends, low, high, key64, owner in _doc_runs(texts, width):
            slice_no = postings.slice_of(key64, slices_n)
            full = slice_no.astype(np.uint64) << np.uint64(32) | key64 & np.uint64(0xFFFFFFFF)
            bounds = np.searchsorted(owner, np.arange(len(part) + 1))
            hit = np.zeros(len(low), bool)
            for i in range(len(part)):
                d = chosen[first + i]
                mine = np.sort(keys[at[d] : to[d]])
                f = full[bounds[i] : bounds[i + 1]]
                hit[bounds[i] : bounds[i + 1]] = mine[np.minimum(np.searchsorted(mine, f), len(mine) - 1)] == f
            low, high, slice_no = low[hit], high[hit], slice_no[hit]
            if not len(low):
                continue
            sizes = high - low + width
            names = span_hashes(data, low, low + sizes)
            _, lead = np.unique(names, return_index=True)
            docs_of = named[chosen[first + owner[hit]]]
            order = np.argsort(names, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
            small, large = np.minimum.reduceat(docs_of[order], cuts), np.maximum.reduceat(docs_of[order], cuts)
            parts.append((names[lead], slice_no[lead], sizes[lead], small, large, _gather(data, low[lead], sizes[lead])))
        if not parts:
            return empty
        names, slice_no, sizes, small, large = (np.concatenate([p[i] for p in parts]) for i in range(5))
        text_all = np.concatenate([p[5] for p in parts])
        begin = np.cumsum(sizes) - sizes
        order = np.argsort(names, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], names[order][1:] != names[order][:-1]]))
        small, large, lead = np.minimum.reduceat(small[order], cuts), np.maximum.reduceat(large[order], cuts), order[cuts]
        rows = []
        order = np.argsort(slice_no[lead], kind="stable")
        lead, small, large = lead[order], small[order], large[order]
        here = table.column("block")[0].as_py()
        for s, a, b in pieces_of(slice_no[lead]):
            pick = lead[a:b]
            rows.append((s, here, names[pick].tobytes(), sizes[pick].astype(np.uint8 if width <= 128 else np.uint32).tobytes(), zstandard.compress(np.stack([small[a:b], large[a:b] - small[a:b]]).tobytes(), 3), zstandard.compress(_gather(text_all, begin[pick], sizes[pick]).tobytes(), 3)))
        cols = list(zip(*rows, strict=True))
        return pa.table({n: pa.array(c, t) for (n, t), c in zip(CONTEXT_TYPES, cols, strict=True)})

    CONTEXT_TYPES = [("slice", pa.int32()), ("block", pa.int32()), ("names", pa.binary()), ("sizes", pa.binary()), ("keys", pa.binary()), ("packed", pa.binary())]
    size_type = np.uint8 if width <= 128 else np.uint32
    placed = _to_blocks(known).unionByName(shared, allowMissingColumns=True)
    cut = placed.groupBy("block").applyInArrow(contexts, "slice int, block int, names binary, sizes binary, keys binary, packed binary")

    def resolve(table: pa.Table) -> pa.Table:
        """Sort the strings of a slice's contexts; answer each block that has a larger key than the smallest."""
        trim()
        rows = table.to_pylist()
        names = np.concatenate([np.frombuffer(r["names"], np.uint64) for r in rows])
        sizes = np.concatenate([np.frombuffer(r["sizes"], size_type) for r in rows]).astype(np.int64)
        bounds = [np.frombuffer(zstandard.decompress(r["keys"]), np.int64).reshape(2, -1) for r in rows]
        small = np.concatenate([k[0] for k in bounds])
        large = small + np.concatenate([k[1] for k in bounds])
        block_of = np.repeat([r["block"] for r in rows], [k.shape[1] for k in bounds])
        text_all = np.frombuffer(b"".join(zstandard.decompress(r["packed"]) for r in rows), np.uint8)
        begin = np.cumsum(sizes) - sizes
        distinct, lead, which = np.unique(names, return_index=True, return_inverse=True)
        least = np.full(len(distinct), np.iinfo(np.int64).max)
        np.minimum.at(least, which, small)
        owner, low, high, answer = _answers(distinct, sizes[lead], _gather(text_all, begin[lead], sizes[lead]), least, width)
        first = np.searchsorted(owner, np.arange(len(distinct) + 1))
        count = (first[1:] - first[:-1])[which]
        segment = np.arange(int(count.sum())) + np.repeat(first[:-1][which] - (np.cumsum(count) - count), count)
        entry = np.repeat(np.arange(len(which)), count)
        useful = answer[segment] < large[entry]
        segment, entry = segment[useful], entry[useful]
        order = np.argsort(block_of[entry], kind="stable")
        segment, entry = segment[order], entry[order]
        out = []
        for b, x, y in pieces_of(block_of[entry]):
            s = segment[x:y]
            out.append((b, None, names[entry[x:y]].tobytes(), np.stack([low[s], high[s], answer[s]]).tobytes()))
        return replies_table(out)

    answers = stage_table(cut.groupBy("slice").applyInArrow(resolve, back), "answers")

    # Copies of a text whose smallest key is another document's.
    digests = known.select("block", "id", F.sha2("body", 256).alias("d"))
    firsts = digests.groupBy("d").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    copies = digests.join(firsts, "d").where("id > first").select("block", "id").distinct()
    extra = [docs.schema[c] for c in keep]
    whole = docs.select(block.alias("block"), F.col(key).cast("long").alias("id"), body.alias("body"), *[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)])
    meet = _to_blocks(whole)
    for other in (answers, copies):
        meet = meet.unionByName(other, allowMissingColumns=True)
    out_schema = ", ".join([f"`{key}` long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in extra), "n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")])

    def apply(table: pa.Table) -> pa.Table:
        trim()
        own = _from_batches(table.column("batch").filter(table.column("batch").is_valid()))
        if own is None:
            own = pa.table({n: pa.array([], t) for n, t in (("id", pa.int64()), ("body", pa.binary()), *((f"__k{i}", pa.null()) for i in range(len(extra))))})
        replies = table.filter(table.column("one").is_valid())
        copied = set(table.column("id").drop_null().to_pylist())
        names = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, np.uint64) for x in replies.column("one").to_pylist())])
        segments = np.concatenate([np.zeros((3, 0), np.int64), *(np.frombuffer(x, np.int64).reshape(3, -1) for x in replies.column("two").to_pylist())], axis=1)
        order = np.argsort(names, kind="stable")
        names, segments = names[order], segments[:, order]
        ids, texts = own.column("id").to_pylist(), own.column("body").to_pylist()
        removed: list[np.ndarray | None] = [None] * len(texts)
        for first, part, data, ends, low, high, _, owner in _doc_runs(texts, width) if len(names) else ():
            spans = span_hashes(data, low, high + width)
            at, to = np.searchsorted(names, spans, "left"), np.searchsorted(names, spans, "right")
            hit = np.flatnonzero(at < to)
            count = to[hit] - at[hit]
            run = np.repeat(hit, count)
            segment = np.arange(int(count.sum())) + np.repeat(at[hit] - (np.cumsum(count) - count), count)
            key_of = np.array([np.iinfo(np.int64).min if ids[first + i] is None else ids[first + i] for i in range(len(part))], np.int64)
            less = segments[2, segment] < key_of[owner[run]]
            run, segment = run[less], segment[less]
            mark = np.zeros(len(data) + 1, np.int32)
            np.add.at(mark, low[run] + segments[0, segment], 1)
            np.add.at(mark, low[run] + segments[1, segment] - 1 + width, -1)
            gone = np.cumsum(mark[:-1]) > 0
            starts = ends - [len(t) for t in part]
            for i in np.unique(owner[run]).tolist():
                removed[first + i] = gone[starts[i] : ends[i]]
        n_removed, n_spans, kept = [], [], []
        for i, (k, t) in enumerate(zip(ids, texts, strict=True)):
            if k in copied and len(t) >= width:
                n_removed.append(len(t))
                n_spans.append(1)
                kept.append(b"")
            elif removed[i] is not None:
                g = removed[i]
                n_removed.append(int(g.sum()))
                n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()))
                kept.append(np.frombuffer(t, np.uint8)[~g].tobytes())
            else:
                n_removed.append(0)
                n_spans.append(0)
                kept.append(t)
        arrays = {key: pa.array(ids, pa.int64()), **{f.name: own.column(f"__k{i}") for i, f in enumerate(extra)}}
        arrays |= {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "n_spans": pa.array(n_spans, pa.int64()), "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())}
        return pa.table(arrays)

    return meet.groupBy("block").applyInArrow(apply, out_schema)
