"""The fact tables of a workspace, as DataFrame plans over raw facts.

``build`` takes a files table and gives one DataFrame per fact table: symbols with stable ids, imports
resolved against the file listing, calls resolved first by what they name and then by keys with a single
owner, hints, tests, exports, diagnostics and routes. All joins are equi-joins on (repository, path or name).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.operators import resolve
from factgraph.operators.staging import staged
from factgraph.sources.extract import extract
from factgraph.sources.routes_go import detect_routes
from factgraph.sources import scan
from factgraph.sources.scan import folder

KEY = ["repository_id", "path"]
RESOLUTION = "call target has no single owner"


@dataclass
class Index:
    tables: dict[str, DataFrame]

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def exploded(raw: DataFrame, what: str) -> DataFrame:
    return raw.select(*KEY, "language", "package", F.posexplode(what).alias("ordinal", "x")).select(*KEY, "language", "package", "ordinal", "x.*")


def symbol_id() -> Column:
    by_name = S.stable_id("sym", F.col("repository_id"), F.col("path"), F.col("receiver"), F.col("name"))
    by_kind = S.stable_id("sym", F.col("repository_id"), F.col("path"), F.col("name"), F.col("kind"))
    made = S.stable_id("synthetic", F.col("repository_id"), F.col("path"), F.col("canonical_name"))
    return F.when(F.col("synthetic"), made).when((F.col("language") == "go") & F.col("kind").isin("struct", "interface"), by_kind).otherwise(by_name)


def module_paths(files: DataFrame) -> DataFrame:
    """(repository_id, module) of each repository's go.mod."""
    mods = files.where(F.col("path") == "go.mod").select("repository_id", F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^\s*module\s+(\S+)", 1).alias("module"))
    return mods.where("module <> ''").groupBy("repository_id").agg(F.min("module").alias("module"))


def resolved_imports(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Import bindings with resolved_path and is_local."""
    imports = exploded(raw, "imports")
    listing = files.select("repository_id", F.col("path").alias("resolved_path"))
    tried = imports.select(*KEY, "ordinal", F.posexplode("candidates").alias("n", "resolved_path"))
    by_candidate = tried.join(listing, ["repository_id", "resolved_path"]).groupBy(*KEY, "ordinal").agg(F.min_by("resolved_path", "n").alias("by_candidate"))
    go_files = files.where(F.endswith("path", F.lit(".go")) & ~F.endswith("path", F.lit("_test.go"))).select("repository_id", "path", folder(F.col("path")).alias("dir"))
    single = go_files.groupBy("repository_id", "dir").agg(F.count("*").alias("c"), F.min("path").alias("by_folder")).where("c = 1 and dir <> ''").drop("c")
    local = imports.where("language = 'go'").join(module_paths(files), "repository_id").where(F.startswith("source", "module"))
    local = local.select(*KEY, "ordinal", "repository_id", F.regexp_replace(F.expr("substring(source, length(module) + 1)"), "^/", "").alias("dir")).select(*KEY, "ordinal", "dir")
    by_folder = local.join(single, ["repository_id", "dir"]).select(*KEY, "ordinal", "by_folder")
    out = imports.join(by_candidate, [*KEY, "ordinal"], "left").join(by_folder, [*KEY, "ordinal"], "left")
    path = F.coalesce("by_candidate", "by_folder", F.lit(""))
    return out.withColumn("resolved_path", path).withColumn("is_local", path != "").drop("by_candidate", "by_folder", "candidates")


def named_calls(raw: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls with the target they name: canonical name, file and export, or a diagnostic category where nothing is named."""
    calls = exploded(raw, "calls")
    package = F.col("package")
    dotted = lambda *c: F.concat_ws(".", *[F.nullif(x, F.lit("")) for x in c])
    root = F.when(F.col("form") == "identifier", F.col("name")).otherwise(F.substring_index("operand", ".", 1))
    last = imports.groupBy(*KEY, "alias").agg(F.max_by(F.struct("source", "resolved_path", "is_local", "imported_name", "export_name"), "ordinal").alias("i"))
    calls = calls.withColumn("alias", F.when((F.col("language") == "go") & (F.col("form") == "import_selector"), F.col("operand")).when(F.col("language") == "go", F.lit(None)).otherwise(root))
    calls = calls.join(last, [*KEY, "alias"], "left")
    # Go: the package of a receiver's field, from the structs of its folder and package.
    fields = exploded(raw, "fields").where("language = 'go'").select("repository_id", folder(F.col("path")).alias("dir"), "package", F.endswith("path", F.lit("_test.go")).alias("test"), "path", "ordinal", F.col("struct").alias("owner"), F.col("field").alias("operand"), "token")
    tokens = fields.where("not test").groupBy("repository_id", "dir", "package", "owner", "operand").agg(F.max_by("token", F.struct("path", "ordinal")).alias("token"))
    calls = calls.withColumn("dir", folder(F.col("path"))).join(tokens, ["repository_id", "dir", "package", "owner", "operand"], "left")
    go, form, name, owner = F.col("language") == "go", F.col("form"), F.col("name"), F.col("owner")
    found, local = F.col("i").isNotNull(), F.col("i.is_local")
    exported = F.coalesce(F.nullif(F.col("i.export_name"), F.lit("")), F.col("i.imported_name"))
    default = ~go & (F.col("language") != "python") & (exported == "default")
    canonical = (
        F.when(go & (form == "identifier"), dotted(package, name)).when(go & (form == "import_selector"), F.concat_ws(".", owner, name)).when(go & (form == "receiver_selector"), dotted(package, owner, name))
        .when(go & (form == "receiver_field_selector") & F.col("token").isNotNull(), S.method_hint(F.col("token"), name))
        .when(~go & (form == "identifier") & found & local & (exported != "") & ~default, F.concat_ws(".", S.module_path(F.col("i.resolved_path")), exported))
        .when(~go & (form == "identifier") & ~found, dotted(package, name)).when(~go & (form == "self") & (owner != ""), dotted(package, owner, name))
        .when(~go & (form == "member") & found & local, F.concat_ws(".", S.module_path(F.col("i.resolved_path")), name)).otherwise(F.lit(""))
    )
    file = F.when(found & local & (go | form.isin("identifier", "member")), F.col("i.resolved_path")).otherwise(F.lit(""))
    export = F.when(file == "", F.lit("")).when(~go & (form == "identifier"), exported).otherwise(name)
    score = F.when(go, F.when(form == "identifier", 0.95).when(form == "import_selector", 0.75).when(form == "receiver_selector", 0.9).otherwise(0.7)).when(form == "identifier", 0.9).otherwise(0.85)
    category = F.when(go, F.lit(None)).when((form == "identifier") & found & ~local, "unresolved_import").when((form == "member") & found & ~local, "unresolved_import").when((form == "member") & ~found, "ambiguous_relation").when((form == "self") & (owner == ""), "ambiguous_relation").when(form == "dynamic", "unsupported_construct")
    method = F.when(go, "go-syntax").when(F.col("language") == "python", "python-syntax").otherwise("js-syntax")
    evidence_type = F.when(go, form).otherwise("call_expression")
    out = calls.withColumns({"target_canonical_name": canonical, "target_file_path": file, "target_export_name": export, "confidence_score": score, "category": category, "extraction_method": method, "evidence_type": evidence_type})
    return out.where((F.col("target_canonical_name") != "") | (F.col("target_file_path") != "") | F.col("category").isNotNull())


def dotted_ends(canonical: Column, name: Column) -> Column:
    """The name, and what follows each dot of the canonical name."""
    parts = F.split(canonical, r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(F.size(parts) > 1, F.array_append(ends, name)).otherwise(F.array(name))


def resolve_targets(calls: DataFrame, symbols: DataFrame, exports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls with target_symbol_id where it has a single owner, and a diagnostic for each that names a file but stays open."""
    owners = resolve.unique_owners(symbols, "canonical_name", "id").select(F.col("canonical_name").alias("target_canonical_name"), F.col("id").alias("by_name"))
    calls = calls.join(owners, "target_canonical_name", "left")
    open_ = calls.where("by_name is null and target_file_path <> '' and target_export_name <> ''")
    in_file = symbols.select("repository_id", F.col("file_path").alias("target_file_path"), F.col("id").alias("sid"), "canonical_name", dotted_ends(F.col("canonical_name"), F.col("name")).alias("names"))
    through = exports.groupBy("repository_id", "file_path", "name").agg(F.max_by("canonical_name", "ordinal").alias("exported")).select("repository_id", F.col("file_path").alias("target_file_path"), F.col("name").alias("target_export_name"), "exported")
    asked = open_.join(through, ["repository_id", "target_file_path", "target_export_name"], "left")
    counts = resolve.two_stage(asked, in_file, "id", ["repository_id", "target_file_path"], "exported", "target_export_name", "canonical_name", "names", "sid")
    by_export = counts.select("id", F.col("resolved").alias("by_export"), F.col("n_all").alias("n2"))
    out = calls.join(by_export, "id", "left").withColumn("target_symbol_id", F.coalesce("by_name", "by_export", F.lit("")))
    out = resolve.back_fill(out, "target_file_path", symbols, "target_symbol_id", "id", "file_path")
    ambiguous = out.where("n2 is not null and by_export is null")
    notes = ambiguous.select(S.stable_id("diag", F.lit("resolution"), F.col("id")).alias("id"), F.col("path").alias("file_path"), F.col("source_symbol_id").alias("symbol_id"), F.lit("ambiguous_relation").alias("category"), F.lit(RESOLUTION).alias("message"), F.col("evidence_source").alias("evidence"))
    return out, notes


def build(files: DataFrame, extractors: dict | None = None, detectors: dict | None = None) -> Index:
    """``files``: repository_id, repository_root, path, language, content. ``extractors`` by language and ``detectors`` of routes replace the registered ones."""
    raw = staged(extract(files, extractors), "raw")  # every table below reads it; files are parsed once
    file_ids = files.select("repository_id", "path", S.stable_id("file", F.col("repository_root"), F.col("path")).alias("file_id"))
    symbols = staged(exploded(raw, "symbols").withColumn("id", symbol_id()).join(file_ids, KEY).withColumnRenamed("path", "file_path"), "symbols")
    by_ordinal = symbols.select("repository_id", F.col("file_path").alias("path"), F.col("ordinal").alias("symbol"), F.col("id").alias("source_symbol_id"))
    packages = raw.select(*KEY, F.col("package").alias("package_name"))
    all_files = files.select("repository_id", "repository_root", "path", "language").join(file_ids, KEY).join(packages, KEY, "left").select(F.col("file_id").alias("id"), "repository_id", "repository_root", F.col("path").alias("relative_path"), F.concat_ws("/", F.nullif(F.col("repository_root"), F.lit("")), F.col("path")).alias("absolute_path"), "language", F.coalesce("package_name", F.lit("")).alias("package_name"))
    bindings = staged(resolved_imports(files, raw), "imports")
    imports = bindings.join(file_ids, KEY)
    binding_rows = imports.select(S.stable_id("imp", F.col("file_id"), F.lit("binding"), F.col("ordinal")).alias("id"), "file_id", F.col("path").alias("file_path"), "source", "alias", "imported_name", "export_name", "resolved_path", "is_default", "is_namespace", "is_local")
    raw_rows = imports.groupBy("file_id", "path", "source").agg(F.lit("").alias("alias")).select(S.stable_id("imp", F.col("file_id"), F.lit("raw"), F.col("source")).alias("id"), "file_id", F.col("path").alias("file_path"), "source", "alias", *[F.lit("").alias(c) for c in ("imported_name", "export_name", "resolved_path")], *[F.lit(False).alias(c) for c in ("is_default", "is_namespace", "is_local")])
    exports = exploded(raw, "exports").join(file_ids, KEY).withColumnRenamed("path", "file_path").withColumn("id", S.stable_id("exp", F.col("file_id"), F.col("ordinal")))
    calls = staged(named_calls(raw, bindings).join(by_ordinal, [*KEY, "symbol"]).join(file_ids, KEY).withColumn("id", S.stable_id("call", F.col("file_id"), F.col("ordinal"))).withColumnRenamed("evidence", "evidence_source"), "calls")
    noted = calls.where("category is not null").select(S.stable_id("diag", F.col("file_id"), F.col("ordinal")).alias("id"), F.col("path").alias("file_path"), F.col("source_symbol_id").alias("symbol_id"), "category", F.lit("call target is not statically known").alias("message"), F.col("evidence_source").alias("evidence"))
    resolved, ambiguous = resolve_targets(calls.where("category is null"), symbols, exports)
    target = by_ordinal.select("repository_id", "path", F.col("symbol").alias("target"), F.col("source_symbol_id").alias("target_symbol_id"))
    hints = exploded(raw, "hints").join(by_ordinal, [*KEY, "symbol"]).join(target, [*KEY, "target"], "left").join(file_ids, KEY)
    boundaries, route_notes = detect_routes(files, packages, bindings.where("language = 'go'").select(*KEY, "alias"), detectors)
    tables = {
        "files": all_files,
        "symbols": symbols.select("id", "repository_id", "file_id", "file_path", "canonical_name", "name", "receiver", "kind", "signature", "start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte"),
        "imports": binding_rows.unionByName(raw_rows),
        "exports": exports.select("id", "file_id", "file_path", "name", "canonical_name", "is_default"),
        "call_candidates": resolved.select("id", "source_symbol_id", "target_symbol_id", "target_canonical_name", "target_file_path", "target_export_name", F.lit("calls").alias("relationship"), "evidence_type", "evidence_source", "extraction_method", "confidence_score", "order_index"),
        "execution_hints": hints.select(S.stable_id("hint", F.col("file_id"), F.col("ordinal")).alias("id"), F.col("path").alias("file_path"), "source_symbol_id", F.coalesce("target_symbol_id", F.lit("")).alias("target_symbol_id"), "target_symbol", "kind", "evidence", "order_index"),
        "diagnostics": noted.unionByName(ambiguous).unionByName(route_notes),
        "boundaries": boundaries,
        "tests": symbols.where("kind = 'test_function'").select("id", F.col("id").alias("symbol_id"), "file_id", "file_path", "canonical_name", "name", "start_line", "end_line"),
    }
    return Index(tables)


def repository_id() -> Column:
    return F.concat(F.lit("repo_"), F.coalesce(F.nullif(F.col("root"), F.lit("")), F.lit(".")))


def repositories(placed: DataFrame) -> DataFrame:
    """One row per repository of files with their root: name, role, languages, build files and frameworks."""
    counted = scan.services(placed).groupBy("root").agg(F.count("*").alias("n"))
    name = F.coalesce(F.nullif(F.substring_index("root", "/", -1), F.lit("")), F.lit("workspace"))
    return scan.technology(placed).join(counted, "root", "left").select(repository_id().alias("id"), name.alias("name"), F.col("root").alias("root_path"), S.repo_role(F.coalesce("n", F.lit(0)), F.col("languages"), F.col("build_files")).alias("role"), "languages", "build_files", "frameworks")


def boundary_hints(placed: DataFrame) -> DataFrame:
    """(root, boundary_hints): the boundary types that a repository's paths hint at, sorted."""
    return placed.select("root", S.boundary_hint(F.col("relative_path")).alias("h")).groupBy("root").agg(F.array_sort(F.collect_set("h")).alias("boundary_hints"))


def index_workspace(files: DataFrame, generated_at: str, workspace_root: str = "", skipped: int = 0, extractors: dict | None = None, detectors: dict | None = None) -> Index:
    """All fact tables of a scanned workspace (relative_path, content): repositories and services too, and the counts of the run.

    Paths are absolute below ``workspace_root``; ``skipped`` counts the entries that the scan left out.
    """
    roots = scan.repository_roots(files)
    placed = scan.assign_repository(files, roots)
    repository = repository_id()
    inside = F.when(F.col("root") == "", F.col("relative_path")).otherwise(F.expr("substring(relative_path, length(root) + 2)"))
    language = F.coalesce(S.language_of(F.col("relative_path")), F.when(S.file_bucket(F.col("relative_path")).isin("javascript", "typescript"), S.file_bucket(F.col("relative_path"))), F.lit(""))
    table = placed.select(repository.alias("repository_id"), F.col("root").alias("repository_root"), inside.alias("path"), language.alias("language"), "content")
    out = build(table, extractors, detectors)
    if workspace_root:
        out.tables["files"] = out["files"].withColumn("absolute_path", F.concat(F.lit(workspace_root.rstrip("/") + "/"), "absolute_path"))
    out.tables["repositories"] = repositories(placed)
    out.tables["services"] = scan.services(placed).join(boundary_hints(placed), "root", "left").select(S.stable_id("svc", F.col("root"), F.col("service_root"), F.col("name")).alias("id"), repository.alias("repository_id"), "name", F.col("service_root").alias("root_path"), "entrypoints", "boundary_hints")
    count = lambda name, column: out[name].agg(F.count("*").alias(column))
    category, boundary = F.col("category"), F.startswith("id", F.lit("bd_"))
    deferred = boundary & category.isin("boundary_detection", "ambiguous_relation")
    resolution = F.col("message") == RESOLUTION
    issues = out["diagnostics"].agg(
        F.lit(skipped).cast("long").alias("skipped_ignored_files"), F.lit(0).cast("long").alias("service_attribution_ambiguities"), F.lit(0).cast("long").alias("unresolved_imports"),
        F.count_if((boundary & ~deferred) | resolution).alias("ambiguous_relations"), F.lit(0).cast("long").alias("unsupported_constructs"), F.count_if(deferred).alias("deferred_boundary_stitching"),
    )
    run = count("repositories", "repository_count").crossJoin(count("files", "file_count")).crossJoin(count("symbols", "symbol_count")).crossJoin(count("call_candidates", "call_candidate_count")).crossJoin(issues)  # one row each
    out.tables["index_runs"] = run.withColumn("generated_at", F.lit(generated_at).cast("timestamp"))
    return out
