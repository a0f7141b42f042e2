"""The projection of the driver's tables onto a property graph, as SQL that Spark and DuckDB share."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .core import shared_folder

NODES = """
SELECT 1000000000 + CAST(r_regionkey AS BIGINT) AS id, 'module' AS kind, r_name AS name, r_name AS qualified_name, r_name AS path, CAST(NULL AS VARCHAR(64)) AS lang, 'public' AS visibility, CAST(NULL AS VARCHAR(64)) AS signature, CAST(NULL AS VARCHAR(64)) AS body_hash, FALSE AS is_async, CAST(1 AS BIGINT) AS start_line, CAST(2 AS BIGINT) AS end_line FROM {region}
UNION ALL SELECT 2000000000 + CAST(n_nationkey AS BIGINT), 'class', n_name, r_name || '::' || n_name, r_name || '/' || n_name, NULL, 'public', NULL, NULL, FALSE, CAST(n_nationkey AS BIGINT), CAST(n_nationkey + 10 AS BIGINT) FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 3000000000 + c_custkey, 'method', c_name, r_name || '::' || n_name || '::' || c_name, r_name || '/' || n_name || '/' || c_mktsegment, NULL, CASE WHEN c_acctbal >= 0 THEN 'public' ELSE 'private' END, c_mktsegment, NULL, FALSE, c_custkey, c_custkey + 5 FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 4000000000 + s_suppkey, 'function', s_name, r_name || '::' || n_name || '::' || s_name, r_name || '/' || n_name, NULL, CASE WHEN s_acctbal >= 0 THEN 'public' ELSE 'private' END, NULL, NULL, FALSE, s_suppkey, s_suppkey + 7 FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 5000000000 + p_partkey, 'struct', p_name, p_brand || '::' || p_name, p_brand || '/' || p_type, NULL, 'public', p_type, NULL, FALSE, p_partkey, p_partkey + p_size FROM {part}
UNION ALL SELECT 6000000000 + o_orderkey, 'function', 'order_' || CAST(o_orderkey AS VARCHAR(20)), o_orderpriority || '::order_' || CAST(o_orderkey AS VARCHAR(20)), o_orderpriority, NULL, NULL, NULL, NULL, o_orderstatus = 'P', o_orderkey, o_orderkey + 3 FROM {orders}
UNION ALL SELECT 7000000000 + code * 1000000 + user_id, 'function', 'user_' || CAST(user_id AS VARCHAR(20)), event_type || '::user_' || CAST(user_id AS VARCHAR(20)), event_type, NULL, 'public', NULL, NULL, FALSE, user_id, user_id + 1 FROM (SELECT DISTINCT user_id, event_type, code FROM {events} JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM {events}) k) c USING (event_type)) u
UNION ALL SELECT 8000000000 + doc_id, 'function', 'doc_' || CAST(doc_id AS VARCHAR(20)), source || '::doc_' || CAST(doc_id AS VARCHAR(20)), source, lang, 'public', NULL, md5(text), FALSE, doc_id, doc_id + n_chars FROM {documents}
UNION ALL SELECT 9000000000 + conv_id * 10000 + turn, 'other', 'turn_' || CAST(turn AS VARCHAR(20)), 'conv_' || CAST(conv_id AS VARCHAR(20)) || '::turn_' || CAST(turn AS VARCHAR(20)), role, NULL, 'public', NULL, NULL, FALSE, turn, turn + 1 FROM {conversations}
"""

EDGES = """
SELECT 1000000000 + CAST(n_regionkey AS BIGINT) AS src, 2000000000 + CAST(n_nationkey AS BIGINT) AS dst, 'contains' AS kind, CAST(0 AS BIGINT) AS seq, CAST(NULL AS INT) AS argument_count, FALSE AS is_async, CAST(NULL AS VARCHAR(20)) AS resolved_via FROM {nation}
UNION ALL SELECT 2000000000 + CAST(c_nationkey AS BIGINT), 3000000000 + c_custkey, 'contains', 0, NULL, FALSE, NULL FROM {customer}
UNION ALL SELECT 2000000000 + CAST(s_nationkey AS BIGINT), 4000000000 + s_suppkey, 'contains', 0, NULL, FALSE, NULL FROM {supplier}
UNION ALL SELECT 3000000000 + o_custkey, 6000000000 + o_orderkey, 'calls', o_orderkey, 0, FALSE, 'direct' FROM {orders}
UNION ALL SELECT 6000000000 + l_orderkey, 4000000000 + l_suppkey, 'calls', @days, l_linenumber, l_linestatus = 'O', CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'R' THEN 'type_match' ELSE 'binding_plane' END FROM {lineitem}
UNION ALL SELECT 6000000000 + l_orderkey, 5000000000 + l_partkey, 'references', @days, NULL, FALSE, NULL FROM {lineitem}
UNION ALL SELECT DISTINCT 5000000000 + l_partkey, 4000000000 + l_suppkey, 'imports', 0, CAST(NULL AS INT), FALSE, CAST(NULL AS VARCHAR(20)) FROM {lineitem}
UNION ALL SELECT src, dst, 'calls', seq, 1, FALSE, 'direct' FROM (SELECT 7000000000 + code * 1000000 + user_id AS src, 7000000000 + code * 1000000 + lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst, event_id AS seq FROM {events} JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) AS code FROM (SELECT DISTINCT event_type FROM {events}) k) c USING (event_type) WHERE value > 120) u WHERE dst IS NOT NULL AND src <> dst
UNION ALL SELECT 5000000000 + p_partkey, 5000000000 + least_key, 'inherits', 0, NULL, FALSE, NULL FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type) AS least_key FROM {part}) p WHERE p_partkey <> least_key
UNION ALL SELECT 5000000000 + p_partkey, 5000000000 + least_key, 'implements', 0, NULL, FALSE, NULL FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS least_key FROM {part}) p WHERE p_partkey <> least_key
UNION ALL SELECT 9000000000 + a.conv_id * 10000 + a.turn, 9000000000 + b.conv_id * 10000 + b.turn, 'contains', 0, NULL, FALSE, NULL FROM {conversations} a JOIN {conversations} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
"""

#: Columns that follow from the others: flags, frameworks, conditions and the repository of a node.
NODES = f"""
SELECT id, kind, name, qualified_name, path, coalesce(lang, CASE kind WHEN 'method' THEN 'java' WHEN 'class' THEN 'java' WHEN 'struct' THEN 'rust' WHEN 'function' THEN 'c' END) AS lang, visibility, signature, body_hash, is_async, start_line, end_line,
kind = 'function' AND start_line % 5 = 0 AS address_taken, kind = 'function' AND start_line % 11 = 0 AS callsite_promiscuous, CASE WHEN start_line % 13 = 0 THEN TRUE END AS is_unsafe, kind <> 'other' AS is_definition, kind = 'method' AND start_line % 2 = 0 AS is_static,
CASE WHEN kind = 'function' AND start_line % 4 = 1 THEN 'flask' WHEN kind = 'function' AND start_line % 4 = 2 THEN 'spring' END AS framework,
CASE start_line % 6 WHEN 0 THEN 'unix' WHEN 1 THEN 'all(unix, feature_a)' WHEN 2 THEN 'all(feature_a,unix)' END AS cfg FROM ({NODES}) base_nodes
"""

EDGES = f"""
SELECT src, dst, kind, seq, argument_count, is_async, resolved_via, CAST(NULL AS VARCHAR(20)) AS context FROM ({EDGES}) base_edges
UNION ALL SELECT 3000000000 + c_custkey, 2000000000 + CAST(c_nationkey AS BIGINT), 'type_of', 0, NULL, FALSE, NULL, CASE WHEN c_custkey % 2 = 0 THEN 'return' ELSE 'parameter' END FROM {{customer}}
UNION ALL SELECT 4000000000 + s_suppkey, 2000000000 + CAST(s_nationkey AS BIGINT), 'wraps', 0, NULL, FALSE, NULL, CASE WHEN s_acctbal > 0 THEN 'errors' ELSE 'tracing' END FROM {{supplier}}
UNION ALL SELECT 1000000000 + CAST(n_regionkey AS BIGINT), 2000000000 + CAST(n_nationkey AS BIGINT), 'exports', 0, NULL, FALSE, NULL, NULL FROM {{nation}}
"""

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")


@dataclass(frozen=True)
class Graph:
    """An immutable snapshot: ``nodes`` and ``edges`` (a directed multigraph)."""

    nodes: DataFrame
    edges: DataFrame

    def of(self, *kinds: str) -> DataFrame:
        """The edges of some kinds; the kind is a literal of each branch, so others are pruned."""
        return self.edges.filter(self.edges.kind.isin(*kinds))


def open_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """Drops unified losers once, where the columns say which they are."""
    if "is_loser" in nodes.columns:
        nodes = nodes.filter("coalesce(is_loser, false) = false")
    return Graph(nodes, edges)


def save(g: Graph, folder: str, rows: int = 0, per_file: int = 4_000_000, names: tuple = ("nodes", "edges")) -> None:
    """A snapshot as Parquet: nodes and edges partitioned by kind, so that scans of a kind read only its files.

    ``rows`` says how large the graph is; files hold about ``per_file`` rows, sorted by id or src.
    """
    parts = max(8, -(-rows // per_file))
    for name, key in (("nodes", "id"), ("edges", "src")):
        if name not in names:
            continue
        df = getattr(g, name)
        dealt = df.repartition(parts, "kind", F.pmod(F.xxhash64(key), F.lit(parts))).sortWithinPartitions("kind", key)
        dealt.write.mode("overwrite").partitionBy("kind").parquet(f"{folder}/{name}")


def reopen(spark: SparkSession, folder: str) -> Graph:
    return open_graph(spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges"))


_SAVED: dict[tuple, Graph] = {}


def versions(spark: SparkSession, sf_dir: str) -> tuple:
    """Name, size and time of every file of the tables: what a saved snapshot must agree with."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    out = []
    for name in TABLES:
        top = hadoop(f"{sf_dir}/{name}.parquet")
        fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
        out += sorted((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in fs.listStatus(top))
    return tuple(out)


def load(spark: SparkSession, sf_dir: str, edges: bool = True) -> Graph:
    """The snapshot of a folder of tables: projected and saved once for a version of its files, then read.

    Without ``edges`` the graph has its nodes alone, and no edges are saved for it.
    """
    now = versions(spark, sf_dir)
    key = (spark.sparkContext.applicationId, sf_dir, now)
    if (*key, edges) not in _SAVED:
        folder = f"{shared_folder(spark)}/graph-{hashlib.sha256(repr((sf_dir, now)).encode()).hexdigest()[:16]}"
        rows = sum(spark.read.parquet(f"{sf_dir}/{name}.parquet").count() for name in ("lineitem", "orders", "events", "documents"))
        names = ("nodes",) * ((*key, not edges) not in _SAVED) + ("edges",) * edges
        save(projected(spark, sf_dir), folder, 3 * rows, names=names)
        _SAVED[*key, edges] = reopen(spark, folder) if edges else open_graph(spark.read.parquet(f"{folder}/nodes"), None)
        spark.sparkContext._jvm.System.gc()  # the shuffles of the snapshot leave the executors' disks with their last reference
    return _SAVED[*key, edges]


def projected(spark: SparkSession, sf_dir: str) -> Graph:
    t = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES}
    days = "CAST(unix_date(CAST(l_shipdate AS DATE)) AS BIGINT)"
    return open_graph(spark.sql(NODES, **{k: v for k, v in t.items() if f"{{{k}}}" in NODES}), spark.sql(EDGES.replace("@days", days), **{k: v for k, v in t.items() if f"{{{k}}}" in EDGES}))


def oracle_prefix() -> str:
    names = {t: t for t in TABLES}
    days = "CAST(CAST(l_shipdate AS DATE) - DATE '1970-01-01' AS BIGINT)"
    return f"WITH RECURSIVE nodes AS MATERIALIZED ({NODES.format(**names)}), edges AS MATERIALIZED ({EDGES.replace('@days', days).format(**names)})"
