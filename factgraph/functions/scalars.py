"""Scalar functions of the fact model, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ``trim_all`` strips: Unicode spaces, not only U+0020.
SPACES = r"[\s\u0085\p{Z}]"


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def collapse_spaces(c: Column) -> Column:
    return trim_all(F.regexp_replace(c, r"\s+", " "))


def digest(*parts: Column) -> Column:
    """The first 12 hex digits of SHA-1 over the trimmed parts, each ended by a NUL."""
    ended = [x for p in parts for x in (trim_all(F.coalesce(p.cast("string"), F.lit(""))), F.lit("\0"))]
    return F.substring(F.sha1(F.concat(*ended)), 1, 12)


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix + "_"), digest(*parts))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one underscore, none at the ends; ``workspace`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("workspace"))


def canonical_name(package: Column, receiver: Column, name: Column) -> Column:
    return F.concat_ws(".", package, F.nullif(receiver, F.lit("")), name)


def module_path(path: Column) -> Column:
    """Path without extension and without a final /__init__ or /index, with dots for slashes."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]+$", ""), "/(__init__|index)$", ""), F.lit("/"), F.lit("."))


def receiver_name(c: Column) -> Column:
    return F.element_at(F.split(trim_all(F.regexp_replace(c, r"[()*]", " ")), r"\s+"), -1)


def type_name(c: Column) -> Column:
    return F.substring_index(F.regexp_replace(F.regexp_replace(trim_all(c), r"^\*+", ""), r"\[.*$", ""), ".", -1)


def package_token(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("/")), c).otherwise(F.substring_index(c, ".", -1))


def method_hint(token: Column, method: Column) -> Column:
    return F.when((trim_all(token) != "") & (trim_all(method) != ""), F.concat_ws(".", package_token(trim_all(token)), trim_all(method))).otherwise(F.lit(""))


def method_ref(c: Column) -> Column:
    """(package, method) of text with one dot and no slash, else nulls."""
    ok = F.regexp_like(c, F.lit(r"^[^./]+\.[^./]+$"))
    return F.struct(F.when(ok, F.substring_index(c, ".", 1)).alias("package"), F.when(ok, F.substring_index(c, ".", -1)).alias("method"))


def route_path(c: Column) -> Column:
    """One pass of // to /, a leading slash, / if empty."""
    p = F.replace(c, F.lit("//"), F.lit("/"))
    return F.when(p == "", F.lit("/")).when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))


def unquote(c: Column) -> Column:
    return F.regexp_replace(c, "^[\"'`]+|[\"'`]+$", "")


def quoted_source(c: Column) -> Column:
    """Text between the first and last double quote, else between single quotes."""
    double = F.regexp_extract(c, '(?s)"(.*)"', 1)
    return F.when(double != "", double).otherwise(F.regexp_extract(c, "(?s)'(.*)'", 1))


def comma_list(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim_all), lambda s: s != "")


def identifier(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "^_+|_+$", "")


def synthetic_test_name(label: Column, line: Column) -> Column:
    return F.concat(F.lit("__test_"), identifier(label), F.lit("_"), line.cast("string"))


def participant(c: Column) -> Column:
    return F.translate(F.substring_index(c, ".", -1), "-/: ", "____")


def diagram_quote(c: Column) -> Column:
    return F.when(F.regexp_like(c, F.lit(r"[ \t:>]")), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit("'")), F.lit('"'))).otherwise(c)


def short_label(c: Column) -> Column:
    return F.when(F.endswith(c, F.lit("/")), c).otherwise(F.substring_index(c, "/", -1))


def rolling_hash(c: Column) -> Column:
    """32-bit hash of the UTF-8 bytes: h = (h << 5) ^ h ^ byte from 5381, modulo 2**32 - 1, in lower hex."""
    coded = F.hex(F.encode(c, "UTF-8"))
    octets = F.when(F.octet_length(c) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.octet_length(c) - 1), lambda i: F.conv(F.substring(coded, i * 2 + 1, F.lit(2)), 16, 10).cast("bigint")))
    h = F.aggregate(octets, F.lit(5381).cast("bigint"), lambda a, b: F.shiftleft(a, 5).bitwiseXOR(a).bitwiseXOR(b).bitwiseAND(F.lit(4294967295)))
    return F.lower(F.hex(h % F.lit(4294967295)))


def node_key(id_: Column, canonical: Column) -> Column:
    return F.when((id_ != "") & (F.octet_length(id_) <= 64), id_).otherwise(F.concat(canonical, F.lit("_"), rolling_hash(canonical)))


def rationale(c: Column, default: str = "no rationale provided") -> Column:
    return F.when(trim_all(F.coalesce(c, F.lit(""))) == "", F.lit(default)).otherwise(c)


def confidence_rank(c: Column) -> Column:
    return F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)


def source_context(text: Column, start: Column, end: Column, window: int = 8) -> Column:
    """(source, context): lines start to end, and with ``window`` lines around them (8 if not positive).

    A start outside the text counts as line 1, an end outside it or before the start as the start.
    """
    lines = F.split(text, "\n")
    n, window = F.size(lines), window if window > 0 else 8
    first = F.when((start <= 0) | (start > n), F.lit(1)).otherwise(start).cast("int")
    last = F.when((end <= 0) | (end > n) | (end < first), first).otherwise(end).cast("int")
    cut = lambda a, b: F.array_join(F.slice(lines, a, b - a + 1), "\n")
    return F.struct(cut(first, last).alias("source"), cut(F.greatest(F.lit(1), first - window), F.least(n, last + window)).alias("context"))


def language_of(path: Column) -> Column:
    """Case-sensitive language by extension, null for others."""
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    names = {".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".yaml": "yaml", ".yml": "yaml", ".json": "json"}
    out = F.lit(None).cast("string")
    for e, n in names.items():
        out = F.when(ext == e, F.lit(n)).otherwise(out)
    return out


def test_framework(path: Column) -> Column:
    base = F.substring_index(path, "/", -1)
    return F.when(F.endswith(base, F.lit("_test.go")), "go_test").when(F.regexp_like(base, F.lit(r"^test_.*\.py$|_test\.py$")), "pytest").when(F.regexp_like(base, F.lit(r"\.(test|spec)\.(js|ts)$")), "jest")


def framework_hint(path: Column) -> Column:
    low = F.lower(path)
    return F.when(F.contains(low, F.lit("openapi")) | F.contains(low, F.lit("swagger")), "openapi").when(F.endswith(low, F.lit(".proto")), "protobuf").when(F.contains(low, F.lit("kafka")), "kafka")


def file_bucket(path: Column) -> Column:
    """Case-insensitive bucket by extension: go, python, javascript, typescript, config."""
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "go", "go").when(ext == "py", "python").when(ext.isin("js", "jsx", "mjs", "cjs"), "javascript").when(ext.isin("ts", "tsx"), "typescript").when(ext.isin("yaml", "yml", "json", "toml", "proto"), "config")


def boundary_hint(path: Column) -> Column:
    """The boundary type that a path hints at: grpc, http or kafka, the first that fits."""
    low = F.lower(path)
    return F.when(F.endswith(low, F.lit(".proto")), "grpc").when(F.contains(low, F.lit("openapi")) | F.contains(low, F.lit("swagger")), "http").when(F.contains(low, F.lit("kafka")), "kafka")


def repo_role(services: Column, languages: Column, build_files: Column) -> Column:
    """service, shared_lib, infra or unknown, the first that fits; infra is a build file of terraform or docker without sources."""
    source = F.size(F.array_intersect(languages, F.array(*[F.lit(x) for x in ("go", "python", "javascript", "typescript", "java")])))
    return F.when(services > 0, "service").when((source == 1) & F.array_contains(languages, "go"), "shared_lib").when((source > 0) & (F.size(build_files) > 0), "service").when(F.exists(build_files, lambda f: F.regexp_like(F.lower(f), F.lit("terraform|docker"))), "infra").otherwise("unknown")
