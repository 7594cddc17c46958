"""File inventory: ignore policy, repositories, services and technology of a workspace listing."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars as S

#: Folders never scanned, and manifests whose folder is a repository root.
DEFAULT_IGNORED = [".git", "artifacts", ".pytest_cache", "__pycache__", ".venv", "node_modules", "testdata", "vendor"]
ROOT_FILES = ["go.mod", "package.json", "pyproject.toml", "requirements.txt", "setup.py", "setup.cfg", "Pipfile", "poetry.lock", "Cargo.toml", "pom.xml", "build.gradle", "settings.gradle"]


def glob_regex(pattern: str) -> str:
    """A shell glob as a regular expression; * and ? do not cross a slash."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            out += pattern[i : end + 1].replace("[!", "[^")
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


class IgnorePolicy:
    """Paths with a default folder as a segment, or that hold a pattern as text or match it as a glob."""

    def __init__(self, patterns: list[str] = ()):
        cleaned = (p.strip().removeprefix("./").strip("/") for p in patterns)
        self.patterns = sorted({p for p in cleaned if p})
        self.signature = "ignore_" + hashlib.sha1("|".join(self.patterns).strip().encode() + bytes(1)).hexdigest()[:12]

    def ignores(self, path: Column) -> Column:
        out = F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(x) for x in DEFAULT_IGNORED]))
        for p in self.patterns:
            out = out | F.contains(path, F.lit(p)) | F.regexp_like(path, F.lit(glob_regex(p)))
        return out


def list_workspace(spark: SparkSession, root: str) -> DataFrame:
    """(full_path, relative_path) of every file below ``root``; no content is read."""
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(F.col("path").alias("full_path"))
    return files.withColumn("relative_path", F.regexp_replace("full_path", f"^[a-z]+:/+{base}/", ""))


def read_workspace(spark: SparkSession, root: str, policy: IgnorePolicy | None = None) -> DataFrame:
    """(relative_path, content) of every file below ``root`` that the policy admits; ignored files are listed but not read."""
    listing = list_workspace(spark, root)
    admitted = [r["full_path"] for r in listing.where(~(policy or IgnorePolicy()).ignores(F.col("relative_path"))).select("full_path").collect()]  # the driver holds the listing anyway
    if not admitted:
        return spark.createDataFrame([], "relative_path string, content binary")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(admitted)
    base = re.escape(root.rstrip("/").removeprefix("file:").lstrip("/"))
    return files.select(F.regexp_replace("path", f"^[a-z]+:/+{base}/", "").alias("relative_path"), "content")


def above(path: Column) -> Column:
    """The folders above a path, the workspace first as '', then each below it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def skipped(listing: DataFrame, policy: IgnorePolicy) -> DataFrame:
    """(entry) of every entry that a walk skips: the topmost ignored folder or file of each ignored file. A folder counts once, whatever it holds."""
    entries = listing.select("relative_path", F.posexplode(F.array_append(above(F.col("relative_path")), F.col("relative_path"))).alias("n", "entry")).where("entry <> ''")
    return entries.where(policy.ignores(F.col("entry"))).groupBy("relative_path").agg(F.min_by("entry", "n").alias("entry")).select("entry").distinct()


def folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def repository_roots(files: DataFrame) -> DataFrame:
    """Folders that hold a manifest; the workspace root, '', where there is none."""
    base = F.substring_index("relative_path", "/", -1)
    found = files.where(base.isin(*ROOT_FILES)).select(folder(F.col("relative_path")).alias("root")).distinct()
    none = files.groupBy().agg(F.count_if(base.isin(*ROOT_FILES)).alias("n")).where("n = 0").select(F.lit("").alias("root"))
    return found.unionByName(none)


def assign_repository(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root: the deepest repository folder above each file. A file meets only the folders on its own path."""
    hit = files.select("relative_path", F.explode(above(F.col("relative_path"))).alias("root")).join(roots, "root").groupBy("relative_path").agg(F.max_by("root", F.length("root")).alias("root"))
    return files.join(hit, "relative_path")


def technology(files: DataFrame) -> DataFrame:
    """Per repository: sorted languages, build files, frameworks and test frameworks."""
    path = F.col("relative_path")
    base = F.substring_index("relative_path", "/", -1)
    sets = {"languages": S.language_of(path), "build_files": F.when(base.isin(*ROOT_FILES), path), "frameworks": S.framework_hint(path), "test_frameworks": S.test_framework(path)}
    return files.groupBy("root").agg(*[F.array_sort(F.collect_set(e)).alias(n) for n, e in sets.items()], F.count("*").alias("files"))


def services(files: DataFrame) -> DataFrame:
    """(root, service_root, name, entrypoints): folders with an entry file, or a package.json with a start script."""
    path = F.col("relative_path")
    base = F.lower(F.substring_index("relative_path", "/", -1))
    scripts = F.from_json(F.get_json_object(F.decode("content", "UTF-8"), "$.scripts"), "map<string,string>")
    starts = F.exists(F.array(*[F.lit(x) for x in ("start", "dev", "serve")]), lambda k: F.coalesce(S.trim_all(F.try_element_at(scripts, k)), F.lit("")) != "")
    entry = base.isin("main.go", "main.py", "app.py", "server.js", "server.ts") | F.regexp_like(path, F.lit("(^|/)src/(index|main)\\.ts$")) | F.when(base == "package.json", F.coalesce(starts, F.lit(False))).otherwise(F.lit(False))
    grouped = files.where(entry).groupBy("root", folder(path).alias("service_root")).agg(F.array_sort(F.collect_set("relative_path")).alias("entrypoints"))
    return grouped.withColumn("name", F.coalesce(F.nullif(F.substring_index("service_root", "/", -1), F.lit("")), F.nullif(F.substring_index("root", "/", -1), F.lit("")), F.lit("workspace")))


def extraction_plans(files: DataFrame) -> DataFrame:
    """(root, language, files): the sorted files of each language that has an extractor."""
    path = F.col("relative_path")
    language = F.when(S.file_bucket(path).isin("go", "python", "javascript", "typescript"), S.file_bucket(path))
    return files.select("root", language.alias("language"), path).where("language is not null").groupBy("root", "language").agg(F.array_sort(F.collect_list("relative_path")).alias("files"))
