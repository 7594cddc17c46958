"""Registered queries over the driver tables, each with its SQL counterpart.

The tables hold no source code, so the relational operators run on stand-ins: documents are files, parts
are symbols (ambiguous names by design), line items are call candidates, pages are routes, conversations
are ordered hints, events are diagnostics, and region -> nation -> customer -> order -> part is a call graph.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.operators import dedup, graph, ordering, resolve
from factgraph.plans import fixture, index, review, scenarios

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("SELECT doc_id, 'file_' || substr(sha1(lang || chr(0) || source || chr(0) || cast(doc_id AS varchar) || chr(0)), 1, 12) AS file_id FROM documents")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", S.stable_id("file", F.col("lang"), F.col("source"), F.col("doc_id")).alias("file_id"))


@query("SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'workspace') AS slug FROM part")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", S.slug(F.col("p_name")).alias("slug"))


@query("""
SELECT page_id, host, CASE WHEN p = '' THEN '/' WHEN p LIKE '/%' THEN p ELSE '/' || p END AS path FROM (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
         replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '//', '/') AS p FROM pages)
""")
def route_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1)
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), S.route_path(path).alias("path"))


@query("""
SELECT name, lower(to_hex(list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(name, ''), lambda c: ascii(c)::BIGINT)),
       lambda h, b: xor(xor((h << 5) & 4294967295, h), b) & 4294967295) % 4294967295)) AS hash
FROM (SELECT r_name AS name FROM region UNION ALL SELECT n_name FROM nation)
""")
def rolling_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "region").select(F.col("r_name").alias("name")).unionAll(read(spark, sf_dir, "nation").select("n_name"))
    return names.select("name", S.rolling_hash(F.col("name")).alias("hash"))


@query("""
SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS languages, count(*) AS files FROM documents GROUP BY source
""")
def language_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("languages"), F.count("*").alias("files"))


_ENDINGS = {"en": ".go", "de": ".PY", "fr": ".tsx"}
_PATH = "source || '/d' || doc_id || CASE lang WHEN 'en' THEN '.go' WHEN 'de' THEN '.PY' WHEN 'fr' THEN '.tsx' ELSE '.toml' END"


def document_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (source, doc_id, lang, n_chars, path)."""
    ending = F.lit(".toml")
    for lang, end in _ENDINGS.items():
        ending = F.when(F.col("lang") == lang, end).otherwise(ending)
    d = read(spark, sf_dir, "documents").select("source", "doc_id", "lang", "n_chars")
    return d.withColumn("path", F.concat(F.col("source"), F.lit("/d"), F.col("doc_id").cast("string"), ending))


@query(f"""
SELECT source, bucket, count(*) AS files FROM (SELECT source, CASE WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.PY' THEN 'python' WHEN path LIKE '%.tsx' THEN 'typescript' ELSE 'config' END AS bucket
  FROM (SELECT source, {_PATH} AS path FROM documents)) GROUP BY ALL
""")
def file_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paths(spark, sf_dir).groupBy("source", S.file_bucket(F.col("path")).alias("bucket")).agg(F.count("*").alias("files"))


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'go' ELSE NULL END AS language FROM documents")
def file_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_paths(spark, sf_dir).select("doc_id", S.language_of(F.col("path")).alias("language"))


@query("""
SELECT (contains(source, 'c1') OR regexp_matches(source, '^src[0-4]$')) AS ignored, count(*) AS files FROM documents GROUP BY ALL
""")
def ignore_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.sources.scan import IgnorePolicy

    policy = IgnorePolicy(["c1", "src[0-4]"])
    return read(spark, sf_dir, "documents").groupBy(policy.ignores(F.col("source")).alias("ignored")).agg(F.count("*").alias("files"))


@query("""
WITH r AS (SELECT source, count(*) FILTER (WHERE n_chars > 20000) AS services, bool_or(lang = 'en') AS go, bool_or(lang = 'de') AS py, bool_or(n_chars < 100) AS docker, bool_or(n_chars > 9000) AS module FROM documents GROUP BY source)
SELECT source, CASE WHEN services > 0 THEN 'service' WHEN go AND NOT py THEN 'shared_lib' WHEN (go OR py) AND (docker OR module) THEN 'service' WHEN docker THEN 'infra' ELSE 'unknown' END AS role FROM r
""")
def repo_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    language = F.when(F.col("lang") == "en", "go").when(F.col("lang") == "de", "python")
    build = F.when(F.col("n_chars") < 100, "deploy/Docker-compose.yml").when(F.col("n_chars") > 9000, "go.mod")
    d = read(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("n_chars") > 20000).alias("services"), F.collect_set(language).alias("languages"), F.collect_set(build).alias("build_files"))
    return d.select("source", S.repo_role(F.col("services"), F.col("languages"), F.col("build_files")).alias("role"))


@query("""
WITH hints AS (SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS hints FROM documents GROUP BY source),
     s AS (SELECT source, lang, count(*) AS entries, min(doc_id) AS first_doc FROM documents WHERE n_chars > 3000 GROUP BY ALL)
SELECT s.source, s.lang, s.entries, s.first_doc, coalesce(h.hints, '') AS hints FROM s LEFT JOIN hints h USING (source)
""")
def service_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    hints = d.groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("hints"))
    services = d.where("n_chars > 3000").groupBy("source", "lang").agg(F.count("*").alias("entries"), F.min("doc_id").alias("first_doc"))
    return services.join(hints, "source", "left").select("source", "lang", "entries", "first_doc", F.coalesce("hints", F.lit("")).alias("hints"))


@query("""
WITH owners AS (SELECT p_name, min(p_partkey) AS target FROM part GROUP BY p_name HAVING count(DISTINCT p_partkey) = 1)
SELECT l_orderkey, l_linenumber::BIGINT AS line, p.p_name AS target_name, o.target FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey LEFT JOIN owners o ON o.p_name = p.p_name
""")
def unique_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    calls = read(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", F.col("l_linenumber").cast("long").alias("line"), F.col("p_name").alias("target_name"))
    return resolve.resolve_unique(calls, part, "target_name", "p_name", "p_partkey", "target")


_STAGES = """
WITH refs AS (SELECT p_partkey AS ref, p_brand AS brand, p_name AS name, split_part(p_name, ' ', 2) AS tail FROM part),
     hits AS (SELECT r.ref, c.p_partkey AS target, c.p_name = r.name AS a, ends_with(c.p_name, r.tail) AS b FROM refs r LEFT JOIN part c ON c.p_brand = r.brand),
     counts AS (SELECT ref, count(DISTINCT target) FILTER (WHERE a) AS n_first, min(target) FILTER (WHERE a) AS t_first,
                count(DISTINCT target) FILTER (WHERE a OR b) AS n_all, min(target) FILTER (WHERE a OR b) AS t_all FROM hits GROUP BY ref)
"""


def _two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    refs = part.select(F.col("p_partkey").alias("ref"), F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("tail"))
    owned = part.select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("candidate"), F.col("p_name").alias("owned"), resolve.suffixes(F.col("p_name")).alias("ends"))
    return resolve.two_stage(refs, owned, "ref", ["brand"], "name", "tail", "owned", "ends", "candidate")


@query(_STAGES + "SELECT ref, n_first, n_all, CASE WHEN n_first = 1 THEN t_first WHEN n_first = 0 AND n_all = 1 THEN t_all END AS resolved FROM counts")
def two_stage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_stage(spark, sf_dir).select("ref", "n_first", "n_all", "resolved")


@query(_STAGES + "SELECT ref, 'ambiguous_relation' AS category, n_all || ' candidates' AS message FROM counts WHERE NOT (n_first = 1 OR (n_first = 0 AND n_all = 1))")
def resolution_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_refs = _two_stage(spark, sf_dir).where("resolved is null")
    return open_refs.select("ref", F.lit("ambiguous_relation").alias("category"), F.concat(F.col("n_all").cast("string"), F.lit(" candidates")).alias("message"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def export_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return dedup.last_wins(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
WITH new AS (SELECT o_orderkey, 'U' AS o_orderstatus, 'new' AS snapshot FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, o_orderstatus, 'old' AS snapshot FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT * FROM new
""")
def pk_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    old = o.select("o_orderkey", "o_orderstatus", F.lit("old").alias("snapshot"))
    new = o.where("o_orderstatus = 'O'").select("o_orderkey", F.lit("U").alias("o_orderstatus"), F.lit("new").alias("snapshot"))
    return dedup.upsert(old, new, ["o_orderkey"])


@query("""
WITH r AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+/([a-z]*)', 1) AS path,
  CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CASE WHEN page_id % 4 = 0 THEN '' ELSE 'h' || (page_id % 7) END AS target FROM pages)
SELECT host, path, page_id, confidence, target, candidates FROM (SELECT *, count(*) OVER (PARTITION BY host, path) AS candidates,
  row_number() OVER (PARTITION BY host, path ORDER BY CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END DESC, (target <> '') DESC, target, page_id) AS rn FROM r) WHERE rn = 1
""")
def route_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_ = F.col("page_id")
    confidence = F.when(id_ % 3 == 0, "high").when(id_ % 3 == 1, "medium").otherwise("low")
    target = F.when(id_ % 4 == 0, "").otherwise(F.concat(F.lit("h"), (id_ % 7).cast("string")))
    roots = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]+/([a-z]*)", 1).alias("path"), confidence.alias("confidence"), target.alias("target"))
    ranking = [-S.confidence_rank(F.col("confidence")), F.col("target") == "", F.col("target"), id_]
    return dedup.winner(roots, ["host", "path"], ranking)


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS order_index FROM conversations")
def ordered_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return ordering.ordinal(c, ["conv_id"], ["turn", "role", "text"]).select("conv_id", "turn", "role", "order_index")


@query("""
SELECT l_orderkey, l_partkey, order_index FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS order_index FROM lineitem) WHERE l_quantity > 25
""")
def call_order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    return ordering.ordinal(l, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).where("l_quantity > 25").select("l_orderkey", "l_partkey", "order_index")


@query("""
WITH s AS (SELECT user_id, event_id AS scope, event_id AS lo, event_id + 50 * (1 + event_id % 20) AS hi FROM events)
SELECT event_id, scope FROM (SELECT e.event_id, s.scope, row_number() OVER (PARTITION BY e.event_id ORDER BY s.hi - s.lo, s.scope) AS rn FROM events e JOIN s ON s.user_id = e.user_id AND s.lo <= e.event_id AND e.event_id <= s.hi) WHERE rn = 1
""")
def tightest_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id")
    id_ = F.col("event_id")
    scopes = e.select("user_id", id_.alias("scope"), id_.alias("lo"), (id_ + 50 * (1 + id_ % 20)).alias("hi"))
    return ordering.tightest(e, scopes, ["user_id"], "event_id", "lo", "hi", "event_id", "scope")


@query("SELECT l_orderkey AS source, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS position, l_partkey AS outgoing FROM lineitem")
def outgoing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), "l_linenumber", "l_partkey")
    return ordering.neighbours(l, "source", ["l_linenumber"], F.col("l_partkey"), "outgoing")


@query("SELECT l_partkey AS target, row_number() OVER (PARTITION BY l_partkey ORDER BY l_linenumber, l_orderkey) - 1 AS position, l_orderkey AS incoming FROM lineitem")
def incoming_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("target"), "l_linenumber", "l_orderkey")
    return ordering.neighbours(l, "target", ["l_linenumber"], F.col("l_orderkey"), "incoming")


@query("""
SELECT c_custkey, c_name, n_name, coalesce(o.n, 0) AS n_orders, coalesce(o.l, '') AS orders FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS l FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey
""")
def neighbourhood_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: x.cast("string")), ",").alias("l"))
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.join(orders, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "n_name", F.coalesce("n", F.lit(0)).alias("n_orders"), F.coalesce("l", F.lit("")).alias("orders"))


_EDGES = """edges AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey
  UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)"""


def star_edges(spark: SparkSession, sf_dir: str, back: bool = False) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nation, customer = read(spark, sf_dir, "nation"), read(spark, sf_dir, "customer")
    parts = [nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")), customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst")), read(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))]
    if back:
        parts.append(nation.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"""
WITH RECURSIVE {_EDGES}, walk AS (SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 3)
SELECT depth::BIGINT AS depth, count(*) AS nodes FROM (SELECT node, min(depth) AS depth FROM walk GROUP BY node) GROUP BY ALL
""")
def bounded_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = graph.bfs_levels(star_edges(spark, sf_dir), spark.range(1).select(F.lit("r0").alias("node")), 3)
    return levels.groupBy(F.col("depth").cast("long").alias("depth")).agg(F.count("*").alias("nodes"))


@query(f"""
WITH RECURSIVE {_EDGES}, cyc AS (SELECT * FROM edges UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
 walk AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN cyc e ON e.src = w.node WHERE w.depth < 4)
SELECT node, min(depth)::BIGINT AS depth FROM walk GROUP BY node
""")
def bfs_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = graph.bfs_levels(star_edges(spark, sf_dir, back=True), spark.range(1).select(F.lit("r0").alias("node")), 4)
    return levels.select("node", F.col("depth").cast("long").alias("depth"))


_STEPS = """steps AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'R' THEN 'test' ELSE 'calls' END AS relationship, CASE WHEN l_linestatus = 'F' THEN l_partkey::VARCHAR ELSE '' END AS target
   FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
 judged AS (SELECT *, CASE WHEN lower(relationship) = 'test' THEN 'rejected' WHEN target <> '' THEN 'accepted' ELSE 'ambiguous' END AS status FROM steps)"""


def judged_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_returnflag") == "R", "test").otherwise("calls").alias("relationship"), F.when(F.col("l_linestatus") == "F", F.col("l_partkey").cast("string")).otherwise("").alias("target"))
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("status", graph.classify(F.col("relationship"), F.col("target")))


_LEVEL = "SELECT {d} AS depth, e.src, e.dst, e.status, row_number() OVER (ORDER BY s.pos, e.k, e.id) AS pos FROM {e} e JOIN {s} s ON s.dst = e.src AND s.status = 'accepted'"


@query(f"""
WITH n AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'accepted' AS status, n_nationkey AS k, 'n' || n_nationkey AS id FROM nation),
 c AS (SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, CASE WHEN c_acctbal < 0 THEN 'rejected' ELSE 'accepted' END AS status, c_custkey AS k, 'c' || c_custkey AS id FROM customer),
 o AS (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, CASE WHEN o_orderstatus = 'P' THEN 'ambiguous' ELSE 'accepted' END AS status, o_orderkey AS k, 'o' || o_orderkey AS id FROM orders),
 l AS (SELECT 'o' || l_orderkey AS src, 'p' || l_partkey AS dst, 'accepted' AS status, l_linenumber AS k, 'l' || l_orderkey || '.' || l_linenumber || '.' || l_partkey AS id FROM lineitem),
 s0 AS (SELECT 0 AS depth, src, dst, status, row_number() OVER (ORDER BY k, id) AS pos FROM n WHERE src = 'r0'),
 s1 AS ({_LEVEL.format(d=1, e="c", s="s0")}), s2 AS ({_LEVEL.format(d=2, e="o", s="s1")}), s3 AS ({_LEVEL.format(d=3, e="l", s="s2")}),
 steps AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
SELECT step, depth, src AS from_symbol_id, CASE WHEN status = 'ambiguous' THEN '' ELSE dst END AS to_symbol_id, status FROM (SELECT *, row_number() OVER (ORDER BY depth, pos) AS step FROM steps) WHERE step <= 80
""")
def reviewed_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounded review of the graph below region 0: depth 3, 80 steps at most, as the traversal has them."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nothing = F.lit(None).cast("string")

    def edges(table: str, src: Column, dst: Column, order: str, id_: Column, relationship: Column | None = None, target: Column | None = None) -> DataFrame:
        return read(spark, sf_dir, table).select(
            id_.alias("id"), src.alias("source_symbol_id"), (dst if target is None else target).alias("target_symbol_id"), dst.alias("target_canonical_name"),
            (F.lit("calls") if relationship is None else relationship).alias("relationship"), nothing.alias("evidence_source"), F.col(order).cast("long").alias("order_index"),
        )

    order = name("o", "o_orderkey")
    calls = edges("nation", name("r", "n_regionkey"), name("n", "n_nationkey"), "n_nationkey", name("n", "n_nationkey"))
    calls = calls.unionByName(edges("customer", name("n", "c_nationkey"), name("c", "c_custkey"), "c_custkey", name("c", "c_custkey"), F.when(F.col("c_acctbal") < 0, "Test").otherwise("calls")))
    calls = calls.unionByName(edges("orders", name("c", "o_custkey"), order, "o_orderkey", order, target=F.when(F.col("o_orderstatus") == "P", "").otherwise(order)))
    line = F.concat(F.lit("l"), F.concat_ws(".", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey")]))
    calls = calls.unionByName(edges("lineitem", name("o", "l_orderkey"), name("p", "l_partkey"), "l_linenumber", line))
    nodes = [("region", "r", "r_regionkey"), ("nation", "n", "n_nationkey"), ("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "p", "p_partkey")]
    symbols = [read(spark, sf_dir, t).select(name(p, k).alias("id"), name(p, k).alias("canonical_name")) for t, p, k in nodes]
    known = symbols[0]
    for more in symbols[1:]:
        known = known.unionByName(more)
    steps = review.traverse(calls, known, symbols[0].where("id = 'r0'"))
    return steps.select(F.col("step").cast("long").alias("step"), F.col("depth").cast("int").alias("depth"), "from_symbol_id", "to_symbol_id", "status")


@query(f"WITH {_STEPS} SELECT status, count(*) AS steps FROM judged GROUP BY status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_steps(spark, sf_dir).groupBy("status").agg(F.count("*").alias("steps"))


@query(f"WITH {_STEPS} SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM judged WHERE status = 'accepted'")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_steps(spark, sf_dir).where("status = 'accepted'").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()


@query(f"""WITH {_STEPS} SELECT id, label FROM (SELECT 'o' || l_orderkey AS id, 'order ' || l_orderkey AS label FROM judged WHERE status = 'accepted' UNION
  SELECT 'p' || l_partkey, 'part ' || l_partkey FROM judged WHERE status = 'accepted')""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = judged_steps(spark, sf_dir).where("status = 'accepted'")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = accepted.select(name("o", "l_orderkey").alias("src"), name("order ", "l_orderkey").alias("src_label"), name("p", "l_partkey").alias("dst"), name("part ", "l_partkey").alias("dst_label"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return graph.node_set(edges)


@query("""
SELECT user_id, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS deferred, count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) AS ambiguous, count(*) AS total FROM events GROUP BY user_id
""")
def issue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    deferred = F.col("event_type").isin("click", "view")
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(deferred).alias("deferred"), F.count_if(~deferred).alias("ambiguous"), F.count("*").alias("total"))


@query("""
SELECT DISTINCT * FROM (SELECT 'event' AS origin, event_type AS category, user_id AS subject FROM events UNION ALL SELECT 'order', o_orderstatus, o_custkey FROM orders UNION ALL SELECT 'line', l_returnflag, l_suppkey FROM lineitem)
""")
def diagnostic_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [read(spark, sf_dir, t).select(F.lit(o).alias("origin"), F.col(c).alias("category"), F.col(s).alias("subject")) for t, o, c, s in (("events", "event", "event_type", "user_id"), ("orders", "order", "o_orderstatus", "o_custkey"), ("lineitem", "line", "l_returnflag", "l_suppkey"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).distinct()


@query("""
WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS source FROM pages)
SELECT page_id, 'binding' AS kind, source, count(*) AS n FROM h GROUP BY ALL UNION ALL SELECT page_id, 'raw', source, 1 FROM (SELECT DISTINCT page_id, source FROM h)
""")
def import_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = read(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("source"))
    bindings = h.groupBy("page_id", "source").agg(F.count("*").alias("n"))
    raw = h.distinct().withColumn("n", F.lit(1).cast("long"))
    return bindings.select("page_id", F.lit("binding").alias("kind"), "source", "n").unionByName(raw.select("page_id", F.lit("raw").alias("kind"), "source", "n"))


@query("SELECT doc_id, regexp_matches(text, 'gin|http|mux|HandleFunc|Group|grpc|Register') AS candidate FROM documents")
def candidate_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.regexp_like("text", F.lit("gin|http|mux|HandleFunc|Group|grpc|Register")).alias("candidate"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def unvisited(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return read(spark, sf_dir, "customer").select("c_custkey").join(orders, "c_custkey", "left_anti")


@query("""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines, doc_id % 9 - 1 AS s0, doc_id % 7 AS e0 FROM documents),
     f AS (SELECT *, CASE WHEN s0 <= 0 OR s0 > len(lines) THEN 1 ELSE s0 END AS s FROM l),
     g AS (SELECT *, CASE WHEN e0 <= 0 OR e0 > len(lines) OR e0 < s THEN s ELSE e0 END AS e FROM f)
SELECT doc_id, array_to_string(list_slice(lines, s, e), chr(10)) AS source, array_to_string(list_slice(lines, greatest(1, s - 2), least(len(lines), e + 2)), chr(10)) AS context FROM g
""")
def source_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    id_, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    both = S.source_context(text, id_ % 9 - 1, id_ % 7, 2)
    return d.select("doc_id", both["source"].alias("source"), both["context"].alias("context"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_valid(props) AS valid FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("""
WITH t AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.x' WHEN 2 THEN 'bad id!' ELSE 't-' || o_orderkey END AS id,
  CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE 'tester' END AS role, CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE 'out' END AS dir,
  CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE 'doc' END AS type, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a/b' END AS path FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN id = '' THEN 'task_id_required@task.id' WHEN NOT regexp_full_match(id, '[A-Za-z0-9][A-Za-z0-9._-]*') THEN 'task_id_invalid@task.id' END,
  CASE WHEN role = '' THEN 'task_role_required@task.role' END, CASE WHEN dir = '' THEN 'task_output_dir_required@task.output_dir' END,
  CASE WHEN type = '' THEN 'artifact_type_required@task.input_artifacts[0].type' WHEN path = '' THEN 'artifact_path_required@task.input_artifacts[0].path' END) AS issues FROM t
""")
def validate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.operators.validate import task_issues

    k, t = F.col("o_orderkey"), F.lit
    pick = lambda n, *values: F.element_at(F.array(*values), (k % n + 1).cast("int"))
    tasks = read(spark, sf_dir, "orders").select(
        "o_orderkey", pick(5, t(""), t(".x"), t("bad id!"), *[F.concat(t("t-"), k.cast("string"))] * 2).alias("id"), pick(4, t(""), t(" "), t("tester"), t("tester")).alias("role"), F.when(k % 6 == 0, "").otherwise("out").alias("output_dir"),
        F.array(F.struct(F.when(k % 7 == 0, "").otherwise("doc").alias("type"), F.when(k % 3 == 0, "").otherwise("a/b").alias("path"))).alias("artifacts"),
    )
    found = task_issues(F.col("id"), F.col("role"), F.col("output_dir"), F.col("artifacts"))
    return tasks.select("o_orderkey", F.array_join(F.transform(found, lambda x: F.concat(x["code"], F.lit("@"), x["source"])), ",").alias("issues"))


@query("""
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN ' ' ELSE 't' END AS task_id, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'r' END AS role, CASE WHEN p_size % 5 = 0 THEN chr(9) ELSE p_name END AS goal, CASE WHEN p_size % 7 = 0 THEN '' ELSE 'json' END AS out,
  CASE WHEN p_size % 4 = 0 THEN ' ' ELSE 'fact' END AS type, CASE WHEN p_size % 6 = 0 THEN '' ELSE 'x' END AS ref_type, CASE WHEN p_size % 8 = 0 THEN '' ELSE 'a' END AS ref_path, CASE WHEN p_size % 9 = 0 THEN '' ELSE 'f.go' END AS file, p_size % 11 AS s, p_size % 13 AS e FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN trim(task_id) = '' THEN 'context_task_id_required@context.task_id' END, CASE WHEN trim(role) = '' THEN 'context_role_required@context.role' END,
  CASE WHEN goal = chr(9) THEN 'context_goal_required@context.goal' END, CASE WHEN trim(out) = '' THEN 'context_output_schema_required@context.output_schema' END,
  CASE WHEN trim(type) = '' THEN 'context_input_type_required@context.inputs[0].type' END, CASE WHEN trim(ref_type) = '' THEN 'context_input_ref_type_required@context.inputs[0].ref.type' END, CASE WHEN trim(ref_path) = '' THEN 'context_input_ref_path_required@context.inputs[0].ref.path' END,
  CASE WHEN file = '' THEN 'source_slice_file_path_required@context.source_slices[0].file_path' END, CASE WHEN s <= 0 THEN 'source_slice_start_line_invalid@context.source_slices[0].start_line' END,
  CASE WHEN e < s THEN 'source_slice_end_line_invalid@context.source_slices[0].end_line' END) AS issues FROM p
""")
def validate_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factgraph.operators.validate import packet_issues

    n = F.col("p_size")
    when = lambda m, then, other: F.when(n % m == 0, F.lit(then)).otherwise(other if isinstance(other, Column) else F.lit(other))
    inputs = F.array(F.struct(when(4, " ", "fact").alias("type"), F.struct(when(6, "", "x").alias("type"), when(8, "", "a").alias("path")).alias("ref")))
    slices = F.array(F.struct(when(9, "", "f.go").alias("file_path"), (n % 11).alias("start_line"), (n % 13).alias("end_line")))
    found = packet_issues(when(2, " ", "t"), when(3, "", "r"), when(5, "\t", F.col("p_name")), when(7, "", "json"), inputs, slices)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(found, lambda x: F.concat(x["code"], F.lit("@"), x["source"])), ",").alias("issues"))


@query("""
SELECT page_id, CASE WHEN u LIKE '%.proto' THEN 'grpc' WHEN contains(u, 'openapi') OR contains(u, 'swagger') THEN 'http' WHEN contains(u, 'kafka') THEN 'kafka' END AS hint
FROM (SELECT page_id, lower(url || CASE page_id % 5 WHEN 0 THEN '/Echo.PROTO' WHEN 1 THEN '/OpenAPI.yaml' WHEN 2 THEN '/swagger/x' WHEN 3 THEN '/kafka/openapi' ELSE '/Kafka.go' END) AS u FROM pages)
""")
def boundary_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = F.array(*[F.lit(x) for x in ("/Echo.PROTO", "/OpenAPI.yaml", "/swagger/x", "/kafka/openapi", "/Kafka.go")])
    return read(spark, sf_dir, "pages").select("page_id", S.boundary_hint(F.concat("url", F.element_at(tails, (F.col("page_id") % 5 + 1).cast("int")))).alias("hint"))


@query("""
WITH l AS (SELECT p_partkey, translate(p_name, '-/: ', '____') AS label FROM part), c AS (SELECT label FROM l GROUP BY label HAVING count(*) > 1)
SELECT p_partkey, CASE WHEN label IN (SELECT label FROM c) THEN label || '_' || right(p_partkey::VARCHAR, 6) ELSE label END AS participant FROM l
""")
def mermaid_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "part").select("p_partkey", S.participant(F.col("p_name")).alias("label"))
    shared = l.groupBy("label").agg(F.count("*").alias("c"))
    return l.join(shared, "label").select("p_partkey", F.when(F.col("c") > 1, F.concat("label", F.lit("_"), F.right(F.col("p_partkey").cast("string"), F.lit(6)))).otherwise(F.col("label")).alias("participant"))


@query(f"""WITH {_STEPS} SELECT o_custkey, '# Review of customer ' || o_custkey || chr(10) || 'accepted: ' || count(*) FILTER (WHERE status = 'accepted') || ', ambiguous: ' || count(*) FILTER (WHERE status = 'ambiguous') || ', rejected: ' || count(*) FILTER (WHERE status = 'rejected') AS summary FROM judged GROUP BY o_custkey""")
def markdown_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).cast("string")
    text = F.concat(F.lit("# Review of customer "), F.col("o_custkey").cast("string"), F.lit("\naccepted: "), n("accepted"), F.lit(", ambiguous: "), n("ambiguous"), F.lit(", rejected: "), n("rejected"))
    return judged_steps(spark, sf_dir).groupBy("o_custkey").agg(text.alias("summary"))


def _facts(spark: SparkSession) -> index.Index:
    return index.index_workspace(fixture.files(spark), "2024-01-01T00:00:00")


def _named(tables: index.Index, rows: DataFrame, key: str, out: str) -> DataFrame:
    """Adds ``out``: the canonical name of the symbol in ``key``, null if there is none."""
    return rows.join(tables["symbols"].select(F.col("id").alias(key), F.col("canonical_name").alias(out)), key, "left")


@query(fixture.rows_sql("file_path, canonical_name, receiver, kind, start_line, start_col, end_line", fixture.SYMBOLS))
def fact_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [F.col(c).cast("long").alias(c) for c in ("start_line", "start_col", "end_line")]
    return _facts(spark)["symbols"].select("file_path", "canonical_name", "receiver", "kind", *lines)


@query(fixture.rows_sql("file_path, source, alias, imported_name, resolved_path, is_default, is_namespace, is_local", fixture.IMPORTS))
def fact_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["imports"].select("file_path", "source", "alias", "imported_name", "resolved_path", "is_default", "is_namespace", "is_local")


@query(fixture.rows_sql("file_path, name, canonical_name, is_default", fixture.EXPORTS))
def fact_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["exports"].select("file_path", "name", "canonical_name", "is_default")


@query(fixture.rows_sql("caller, target, target_canonical_name, target_file_path, target_export_name, evidence_source, score, order_index", fixture.CALLS))
def fact_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _facts(spark)
    rows = _named(tables, _named(tables, tables["call_candidates"], "source_symbol_id", "caller"), "target_symbol_id", "target")
    return rows.select("caller", "target", "target_canonical_name", "target_file_path", "target_export_name", "evidence_source", F.round(F.col("confidence_score") * 100).cast("long").alias("score"), F.col("order_index").cast("long").alias("order_index"))


@query(fixture.rows_sql("caller, target_symbol, kind, evidence, order_index", fixture.HINTS))
def fact_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _facts(spark)
    return _named(tables, tables["execution_hints"], "source_symbol_id", "caller").select("caller", "target_symbol", "kind", "evidence", F.col("order_index").cast("long").alias("order_index"))


@query(fixture.rows_sql("file_path, category, evidence", fixture.DIAGNOSTICS))
def fact_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["diagnostics"].select("file_path", "category", "evidence")


@query(fixture.rows_sql("framework, method, path, handler_target, source_expr", fixture.BOUNDARIES))
def fact_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["boundaries"].select("framework", "method", "path", "handler_target", "source_expr")


@query(fixture.rows_sql("name, root_path, entrypoints, boundary_hints, role", fixture.SERVICES))
def fact_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = _facts(spark)
    roles = tables["repositories"].select(F.col("id").alias("repository_id"), "role")
    return tables["services"].join(roles, "repository_id").select("name", "root_path", F.array_join("entrypoints", ",").alias("entrypoints"), F.array_join("boundary_hints", ",").alias("boundary_hints"), "role")


@query(fixture.rows_sql("path, language, package_name, bucket", fixture.FILES))
def fact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["files"].select(F.col("relative_path").alias("path"), "language", "package_name", F.coalesce(S.file_bucket(F.col("relative_path")), F.lit("")).alias("bucket"))


QUERIES |= scenarios.QUERIES
ORACLE_SQL |= scenarios.ORACLE_SQL
