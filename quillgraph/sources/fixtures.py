"""Views that map the driver's tables onto the engine's model, in Spark SQL and DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.adjacency import Adjacency
from ..operators.lexical_index import LexicalIndex
from ..operators.metadata_index import MetadataIndex
from ..operators.metric import MetricIndex
from ..session import dealt
from .store import derived, length

#: name -> (SQL, tables and views it reads). ``{hash}``, ``{seconds}`` and ``{lines}`` differ by engine.
VIEWS = {
    "f_datasets": "SELECT DISTINCT lang AS dataset_id, lang AS slug, CASE WHEN lang = 'es' THEN 'deleting' ELSE 'active' END AS status, 1 AS active_generation FROM documents",
    "f_sources": """SELECT doc_id AS source_id, lang AS dataset_id, source AS name, {hash}(text{hash_arg}) AS content_sha256, source AS meta_origin,
      CASE WHEN doc_id % 13 = 0 THEN 'deleted' WHEN doc_id % 11 = 0 THEN 'pending' ELSE 'active' END AS status,
      CAST(row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) AS INT) AS version, {seconds} AS created_at FROM documents""",
    "f_documents": "SELECT doc_id AS document_id, doc_id AS source_id, lang AS dataset_id, CASE WHEN doc_id % 5 = 0 THEN 0 ELSE 1 END AS generation, (doc_id % 7 <> 0) AS is_active, text AS normalized_text FROM documents",
    "f_chunks": """SELECT document_id * 100000 + ordinal AS chunk_id, dataset_id, source_id, document_id, generation, CAST(ordinal AS INT) AS ordinal, line AS text,
      CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(line) AS BIGINT) AS end_char, (ordinal % 9 <> 8) AS is_active
      FROM (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_char FROM ({lines}) l) c WHERE length(line) > 0""",
    "f_summaries": "SELECT e.vec_id AS summary_id, d.dataset_id, d.document_id, d.generation, substr(d.normalized_text, 1, 200) AS text, e.embedding, (e.vec_id % 17 <> 0) AS is_active FROM embeddings e JOIN f_documents d ON d.document_id = e.vec_id",
    "f_entities": "SELECT vec_id AS entity_id, CAST(label AS STRING) AS entity_type, embedding, (vec_id * 7919) % 1000 AS created_rank FROM embeddings",
    "f_relations": """SELECT concat('c', o_custkey, '-', l_returnflag, '-p', l_partkey) AS relation_id, concat('c', o_custkey) AS source_entity_id, concat('p', l_partkey) AS target_entity_id,
      l_returnflag AS predicate, max(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) = 1 AS is_active FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3, 4""",
    "f_evidence": "SELECT concat('c', o_custkey, '-', l_returnflag, '-p', l_partkey) AS relation_id, l_orderkey AS chunk_id, max(1 - l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
    "f_mentions": "SELECT DISTINCT concat('c', o_custkey) AS entity_id, o_orderkey AS chunk_id FROM orders UNION ALL SELECT DISTINCT concat('p', l_partkey) AS entity_id, l_orderkey AS chunk_id FROM lineitem",
    "f_feedback": "SELECT doc_id AS feedback_id, doc_id % 50 AS entity_id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS score FROM labels",
    "f_outbox": """SELECT event_id AS id, user_id % 20 AS dataset_id, CASE event_id % 5 WHEN 0 THEN 'entity' WHEN 1 THEN 'chunk' WHEN 2 THEN 'entity_mention' WHEN 3 THEN 'relation' ELSE 'chunk_next' END AS aggregate_type,
      user_id AS aggregate_id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS operation,
      CASE event_type WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, CAST(event_id % 7 AS INT) AS attempt, ts AS processing_started_at FROM events""",
    "f_runs": """SELECT event_id AS run_id, CASE WHEN user_id = 0 THEN NULL ELSE user_id % 50 END AS dataset_id,
      CASE WHEN event_type = 'click' AND event_id % 97 = 0 AND user_id <> 0 THEN 'running' WHEN event_type IN ('signup', 'purchase') THEN 'queued' WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status,
      ts AS created_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS next_attempt_at, CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS heartbeat_at FROM events""",
    # Orders as passages of their customer, customers and parts as nodes, in four realms of which one is being deleted.
    "f_realms": "SELECT DISTINCT concat('d', n_nationkey % 4) AS dataset_id, concat('d', n_nationkey % 4) AS slug, CASE WHEN n_nationkey % 4 = 3 THEN 'deleting' ELSE 'active' END AS status, 1 AS active_generation FROM nation",
    "f_nodes": """SELECT concat('c', c_custkey) AS entity_id, concat('d', c_custkey % 4) AS dataset_id, c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 END AS generation, c_custkey % 7 <> 0 AS is_active FROM customer
      UNION ALL SELECT concat('p', p_partkey), concat('d', p_partkey % 4), p_name, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE 1 END, p_partkey % 7 <> 0 FROM part""",
    "f_links": "SELECT relation_id, concat('d', CAST(substr(source_entity_id, 2) AS BIGINT) % 4) AS dataset_id, source_entity_id, target_entity_id, predicate, 1 AS generation, is_active FROM f_relations",
    "f_passages": """SELECT o_orderkey AS chunk_id, concat('d', o_custkey % 4) AS dataset_id, o_custkey AS source_id, o_custkey AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS INT) AS ordinal,
      1 AS generation, o_orderkey % 9 <> 8 AS is_active FROM orders""",
}
NEEDS = {"f_chunks": ("f_documents",), "f_summaries": ("f_documents",), "f_links": ("f_relations",)}
#: The same rows for Spark, grouped by the keys as they are stored: names are made after the shuffle, so they do not travel. A name is null where one of its keys is, so such rows are one group. Mentions are dealt by chunk, by which they are joined.
SPARK_VIEWS = {
    "f_relations": """SELECT concat('c', c, '-', f, '-p', p) AS relation_id, concat('c', c) AS source_entity_id, concat('p', p) AS target_entity_id, f AS predicate, is_active
      FROM (SELECT o_custkey AS c, l_returnflag AS f, l_partkey AS p, max(CASE WHEN o_orderstatus <> 'P' THEN 1 ELSE 0 END) = 1 AS is_active FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) g""",
    "f_evidence": """SELECT concat('c', k.c, '-', k.f, '-p', k.p) AS relation_id, chunk_id, confidence
      FROM (SELECT CASE WHEN o_custkey IS NOT NULL AND l_returnflag IS NOT NULL AND l_partkey IS NOT NULL THEN named_struct('c', o_custkey, 'f', l_returnflag, 'p', l_partkey) END AS k, l_orderkey AS chunk_id, max(1 - l_discount) AS confidence FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) g""",
    "f_mentions": """SELECT concat(kind, k) AS entity_id, chunk_id
      FROM (SELECT DISTINCT kind, k, chunk_id FROM (SELECT 'c' AS kind, o_custkey AS k, o_orderkey AS chunk_id FROM orders UNION ALL SELECT 'p', l_partkey, l_orderkey FROM lineitem DISTRIBUTE BY chunk_id) l) b""",
}
SPARK = {
    "hash": "sha2", "hash_arg": ", 256", "seconds": "timestamp_seconds(CAST((1704067200 + doc_id * 60) AS BIGINT))",
    "lines": "SELECT d.*, u.ordinal, u.line FROM f_documents d LATERAL VIEW posexplode(split(normalized_text, '\\n', -1)) u AS ordinal, line",
}
DUCK = {
    "hash": "sha256", "hash_arg": "", "seconds": "make_timestamp(CAST((1704067200 + doc_id * 60) * 1000000 AS BIGINT))",
    "lines": "SELECT d.*, u.line, u.ordinal FROM f_documents d, LATERAL (SELECT unnest(string_split(normalized_text, chr(10))) AS line, generate_subscripts(string_split(normalized_text, chr(10)), 1) - 1 AS ordinal) u",
}
TABLES = ("customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "benchmark", "supplier", "region", "conversations")


class Fixture:
    """The views over one folder of driver tables; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}
        self._bytes = 0

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            path = f"{self.dir}/{name}.parquet"
            self._made[name] = self.spark.read.parquet(path)
            self._bytes += length(self.spark, path)
            dealt(self.spark, self._bytes)
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = SPARK_VIEWS.get(name, VIEWS[name]).format(**SPARK)
            reads = {t: (self.view(t) if t in VIEWS else self.table(t)) for t in (*TABLES, *VIEWS) if t != name and f" {t}" in sql.replace("\n", " ")}
            for t in reads:
                sql = _named(sql, t)
            self._made[name] = self.spark.sql(sql, **reads)
        return self._made[name]

    def lexical_index(self) -> LexicalIndex:
        """The index over all active chunks, stored once for the present files."""
        build = lambda path: LexicalIndex.build(self.chunks.where("is_active").select("chunk_id", "text"), path)
        return LexicalIndex(self.spark, derived(self.spark, "lexical", [f"{self.dir}/documents.parquet"], build))

    def vector_index(self) -> MetricIndex:
        """The pivot index over all embeddings, stored once for the present files."""
        build = lambda path: MetricIndex.build(self.table("embeddings"), path, id_col="vec_id")
        return MetricIndex(self.spark, derived(self.spark, "vectors", [f"{self.dir}/embeddings.parquet"], build))

    def metadata_index(self, sources: DataFrame) -> MetadataIndex:
        """The index of the metadata of all sources, stored once for the present files."""
        build = lambda path: MetadataIndex.build(sources, path)
        return MetadataIndex(self.spark, derived(self.spark, "metadata", [f"{self.dir}/documents.parquet"], build))

    def adjacency(self) -> Adjacency:
        """Neighbours in the order graph, stored once for the present files."""
        build = lambda path: Adjacency.build(self.relations.where("is_active"), path)
        return Adjacency.open(self.spark, derived(self.spark, "adjacency", [f"{self.dir}/lineitem.parquet", f"{self.dir}/orders.parquet"], build))

    def __getattr__(self, name: str) -> DataFrame:
        if f"f_{name}" in VIEWS:
            return self.view(f"f_{name}")
        raise AttributeError(name)


def _named(sql: str, table: str) -> str:
    """FROM and JOIN of ``table`` as a parameter, so that no temporary view is left in the session."""
    for word in ("FROM", "JOIN"):
        for after in (" ", "\n", ")"):
            sql = sql.replace(f"{word} {table}{after}", f"{word} {{{table}}}{after}")
        if sql.endswith(f"{word} {table}"):
            sql = sql[: -len(table)] + f"{{{table}}}"
    return sql


def ctes(*names: str) -> str:
    """DuckDB's WITH clause (without WITH) for the views and what they need."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        out.setdefault(name, f"{name} AS ({VIEWS[name].format(**DUCK)})")

    for n in names:
        add(n)
    return ",\n".join(out.values())

