"""Postings of 64-bit keys, shuffled as packed arrays.

A key's slice is chosen by its leading bits, so keys must be spread evenly (not chosen by their size), and within its slice it is known by 32 further bits, so a
posting costs six bytes. Two different keys may so be taken for one; callers verify what they find.
A key that many documents of one flush have is hot: its documents there travel as a part of their own, to
any slice, and the key's slice gets only the first of them, marked. So no slice gets more of a key than
flushes times PART postings.
``Writer`` collects postings of a task in bounded flushes; ``read_slice`` joins the blobs of one slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard

from factgraph.llm.common import mix

#: A flush holds at most about so many postings or documents.
FLUSH, FLUSH_DOCS = 800_000, 30_000
PART = 8
SCHEMA = "slice int, part long, keys binary, owners binary, docs binary"


def slice_of(keys: np.ndarray, slices: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def pack_docs(rows: np.ndarray) -> bytes:
    """Attributes by column, ids as differences, compressed."""
    columns = np.ascontiguousarray(rows.T)
    columns[0, 1:] = np.diff(columns[0])
    return zstandard.compress(columns.tobytes(), 3)


def unpack_docs(data: bytes, width: int) -> np.ndarray:
    columns = np.frombuffer(zstandard.decompress(data), np.int64).reshape(width, -1).copy()
    columns[0] = np.cumsum(columns[0])
    return columns.T


class Writer:
    """``add`` keys of documents; ``flush`` gives record batches of SCHEMA. ``docs`` rows are int64 attributes of a document, the id first; with ``marks`` a last one tells that the posting stands for a part."""

    def __init__(self, slices: int, width: int, marks: bool = False):
        self.slices, self.width, self.marks = slices, width, marks
        self.keys: list[np.ndarray] = []
        self.owners: list[np.ndarray] = []
        self.docs: list[tuple[int, ...]] = []
        self.size = 0

    def add(self, keys: np.ndarray, *doc: int) -> None:
        self.keys.append(keys)
        self.owners.append(np.full(len(keys), len(self.docs), np.uint16))
        self.docs.append(doc)
        self.size += len(keys)

    def full(self) -> bool:
        return self.size >= FLUSH or len(self.docs) >= FLUSH_DOCS

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.size:
            self.keys, self.owners, self.docs = [], [], []
            return
        keys, owners = np.concatenate(self.keys), np.concatenate(self.owners)
        docs = np.array(self.docs, np.int64).reshape(-1, self.width)
        self.keys, self.owners, self.docs, self.size = [], [], [], 0
        part = slice_of(keys, self.slices)
        full = part.astype(np.uint64) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)
        order = np.argsort(full, kind="stable")
        full, owners = full[order], owners[order]
        rows: list[tuple] = []
        if self.marks:
            starts, count = groups(full)
            keep = np.ones(len(full), bool)
            hot = np.zeros(len(full), bool)
            for a, c in zip(starts[count > PART].tolist(), count[count > PART].tolist(), strict=True):
                mine = docs[owners[a : a + c]]
                first = a + int(mine[:, 0].argmin())
                keep[a : a + c] = False
                keep[first] = hot[first] = True
                rows.append((int(mix(full[a : a + 1] + np.uint64(mine[0, 0] & 0xFFFF))[0] % np.uint64(self.slices)), int(full[a]), None, None, pack_docs(mine)))
            full, owners, hot = full[keep], owners[keep], hot[keep]
        part, low = (full >> np.uint64(32)).astype(np.int64), full.astype(np.uint32)
        for a, c in zip(*(x.tolist() for x in groups(part)), strict=True):
            b, s = a + c, int(part[a])
            refs = owners[a:b].astype(np.int64)
            if self.marks:
                refs = refs * 2 + hot[a:b]
            used, local = np.unique(refs, return_inverse=True)
            attributes = np.column_stack([docs[used >> 1], used & 1]) if self.marks else docs[used]
            rows.append((s, None, low[a:b].tobytes(), local.astype(np.uint16).tobytes(), pack_docs(attributes)))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["slice", "part", "keys", "owners", "docs"])


def read_slice(frame: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (uint32) sorted, the row in docs of each, and docs of all blobs of a slice."""
    keys, owners, docs, base = [], [], [], 0
    for k, o, d in zip(frame["keys"], frame["owners"], frame["docs"], strict=True):
        d = unpack_docs(d, width)
        keys.append(np.frombuffer(k, np.uint32))
        owners.append(np.frombuffer(o, np.uint16).astype(np.int32) + base)
        docs.append(d)
        base += len(d)
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.argsort(key, kind="stable")
    return key[order], owner[order], np.concatenate(docs)


def groups(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of each run of equal keys."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return starts, np.diff(np.concatenate([starts, [len(sorted_keys)]]))
