"""Parsing of a files table into raw facts, one row per file."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.schemas import RAW, raw_schema
from factgraph.sources.facts_go import go_facts
from factgraph.sources.facts_js import js_facts
from factgraph.sources.facts_python import python_facts

#: Registry of extractors by language; add an entry to support another.
EXTRACTORS: dict[str, Callable[[str, bytes], dict]] = {"go": go_facts, "python": python_facts, "javascript": js_facts, "typescript": js_facts}


def extract(files: DataFrame, extractors: dict[str, Callable[[str, bytes], dict]] | None = None) -> DataFrame:
    """``files``: repository_id, path, language, content (binary). Files without an extractor give no row.

    Parsing reads each file once; everything that joins files is left to DataFrame plans.
    """
    chosen = extractors or EXTRACTORS
    plain = files.where(F.col("language").isin(*chosen)).select("repository_id", "path", "language", F.coalesce("content", F.lit(b"")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {k: pa.list_(pa.struct([_field(x) for x in v.split(", ")])) for k, v in RAW.items()}
        for big in batches:
            for at in range(0, big.num_rows, 64):
                b = big.slice(at, 64)
                rows = [chosen[lang](path, content) for path, lang, content in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([r["package"] for r in rows], pa.string()), *(pa.array([r[k] for r in rows], types[k]) for k in RAW)], names=["repository_id", "path", "language", "package", *RAW])

    return plain.mapInArrow(run, raw_schema())


def _field(text: str) -> tuple[str, pa.DataType]:
    name, _, kind = text.partition(": ")
    return name, {"string": pa.string(), "boolean": pa.bool_(), "bigint": pa.int64(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}[kind]
