"""Every query of the engine over the driver's tables, with DuckDB SQL where SQL can say it.

A query is registered under its name; ``oracle`` inlines the fixture views as CTEs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical, scalars, vectors
from ..functions.chunker import chunk_documents
from ..functions.rounding import clamp_weight, effective_importance
from ..operators import dedup, feedback, graph, listing, projection, scope, search
from ..sources import loaders, urls
from ..sources.fixtures import Fixture, ctes
from ..sources.store import derived
from ..sources.versioned import Versions
from ..streaming import events as ev
from ..streaming import outbox, runs
from . import forget, improve, provenance, recall, remember, support

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Candidate and merge thresholds at which the unit-vector fixture has pairs; the defaults are for real embeddings.
THETA, THETA_MERGE = 0.30, 0.35
AS_OF = "TIMESTAMP '2024-01-15 00:00:00'"
WORDS = ("the", "of", "and")


def query(sql: str | None = None, views: tuple[str, ...] = ()):
    """Register a function of a Fixture, with its oracle."""

    def add(f: Callable[[Fixture], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Fixture(spark, sf_dir))

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            body = sql.strip()
            if not views:
                ORACLES[f.__name__] = body
            elif body[:5].upper() == "WITH ":
                recursive = body[5:15].upper() == "RECURSIVE "
                ORACLES[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{ctes(*views)},\n{body[15 if recursive else 5:]}"
            else:
                ORACLES[f.__name__] = f"WITH {ctes(*views)}\n{body}"
        return f

    return add


def visible(t: Fixture) -> DataFrame:
    return scope.authoritative_chunks(t.chunks, t.documents, t.sources, t.datasets)


SCOPE = ("f_datasets", "f_sources", "f_documents", "f_chunks")
VISIBLE = """SELECT c.chunk_id, c.dataset_id, c.source_id, s.name AS source_name, c.document_id, c.generation, c.ordinal, c.text, c.start_char, c.end_char
  FROM f_chunks c JOIN f_datasets t USING (dataset_id) JOIN f_documents d ON d.document_id = c.document_id JOIN f_sources s ON s.source_id = c.source_id
  WHERE t.status = 'active' AND c.is_active AND c.generation = t.active_generation AND d.is_active AND d.dataset_id = c.dataset_id AND d.generation = t.active_generation AND s.status = 'active' AND s.dataset_id = c.dataset_id"""


# --- scope, filters, listings ------------------------------------------------------------------


@query(VISIBLE, SCOPE)
def scope_chunks(t):
    """B01, C01."""
    return visible(t)


@query(f"SELECT chunk_id, source_id FROM ({VISIBLE} AND s.source_id IN (1, 2, 3, 4, 6, 8, 9, 12, 16, 17) AND s.created_at >= TIMESTAMP '2024-01-01 00:02:00' AND s.created_at <= TIMESTAMP '2024-01-01 00:16:00') v", SCOPE)
def scope_filtered(t):
    """B03, B04."""
    from datetime import datetime

    rows = scope.authoritative_chunks(t.chunks, t.documents, t.sources, t.datasets, source_ids=[1, 2, 3, 4, 6, 8, 9, 12, 16, 17], created_after=datetime(2024, 1, 1, 0, 2), created_before=datetime(2024, 1, 1, 0, 16))
    return rows.select("chunk_id", "source_id")


@query(f"SELECT chunk_id FROM ({VISIBLE} AND s.meta_origin = 'src3') v", SCOPE)
def scope_metadata(t):
    """Containment in JSON metadata."""
    src = t.sources.withColumn("metadata", F.to_json(F.struct(F.struct(F.col("meta_origin").alias("origin")).alias("a"), F.array(F.lit(1), F.lit(2)).alias("list"))))
    rows = scope.authoritative_chunks(t.chunks, t.documents, src, t.datasets, metadata=scope.contains_metadata(F.col("metadata"), {"a": {"origin": "src3"}, "list": [2]}))
    return rows.select("chunk_id")


@query(f"SELECT chunk_id FROM ({VISIBLE} AND s.meta_origin = 'src3') v", SCOPE)
def scope_metadata_index(t):
    """Containment through the stored index of paths and values, in an array of objects too."""
    src = t.sources.withColumn("metadata", F.to_json(F.struct(F.array(F.struct(F.col("meta_origin").alias("origin"), F.lit(1).alias("n"))).alias("a"), F.array(F.lit(1), F.lit(2)).alias("list"))))
    found = t.metadata_index(src).containing(src, {"a": [{"origin": "src3"}], "list": [2]})
    return scope.authoritative_chunks(t.chunks, t.documents, found, t.datasets).select("chunk_id")


@query("SELECT position::INT AS position, slug, dataset_id FROM (VALUES (0, 'fr'), (1, 'en'), (2, 'de')) v(position, slug) JOIN f_datasets USING (slug) WHERE status = 'active'", ("f_datasets",))
def resolved_datasets(t):
    """B06."""
    return scope.resolve_datasets(t.spark, t.datasets, ["fr", "en", "fr", "de"]).select("position", "slug", "dataset_id")


@query("SELECT status, count(*) AS n FROM f_sources WHERE status IN ('pending', 'failed') GROUP BY 1", ("f_sources",))
def cognify_candidates(t):
    """B15."""
    return scope.cognify_candidates(t.sources).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT document_id, ordinal, chunk_id FROM f_chunks WHERE source_id = 4 AND generation = 1 AND is_active", ("f_documents", "f_chunks"))
def chunks_of_source(t):
    """B18."""
    return scope.of_generation(t.chunks, 4, 1, active_only=True).select("document_id", "ordinal", "chunk_id")


@query("SELECT run_id FROM f_runs WHERE dataset_id IS DISTINCT FROM 3 AND (created_at, run_id) < (TIMESTAMP '2024-01-03 00:00:00', 500)", ("f_runs",))
def runs_before(t):
    """B11, B12."""
    from datetime import datetime

    return t.runs.where(scope.differs(F.col("dataset_id"), F.lit(3)) & scope.precedes(F.col("created_at"), F.col("run_id"), datetime(2024, 1, 3), 500)).select("run_id")


@query("SELECT run_id, dataset_id, created_at FROM f_runs WHERE status = 'failed' AND dataset_id IN (1, 2, 3)", ("f_runs",))
def failed_work_items(t):
    """B21."""
    return scope.work_items(t.runs, status="failed", dataset_id=[1, 2, 3], pipeline_type=None).select("run_id", "dataset_id", "created_at")


@query("""
SELECT t.dataset_id, (SELECT count(*) FROM f_sources s WHERE s.dataset_id = t.dataset_id) AS sources_total, (SELECT count(*) FROM f_sources s WHERE s.dataset_id = t.dataset_id AND s.status = 'active') AS sources_active,
  (SELECT count(*) FROM f_documents d WHERE d.dataset_id = t.dataset_id) AS documents_total, (SELECT count(*) FROM f_documents d WHERE d.dataset_id = t.dataset_id AND d.is_active AND d.generation = t.active_generation) AS documents_active,
  (SELECT count(*) FROM f_chunks c WHERE c.dataset_id = t.dataset_id) AS chunks_total,
  (SELECT count(*) FROM f_chunks c JOIN f_documents d ON d.document_id = c.document_id JOIN f_sources s ON s.source_id = c.source_id WHERE c.dataset_id = t.dataset_id AND c.generation = t.active_generation AND c.is_active
     AND d.dataset_id = t.dataset_id AND d.generation = t.active_generation AND d.is_active AND s.dataset_id = t.dataset_id AND s.status = 'active') AS chunks_active,
  (SELECT count(*) FROM f_summaries m WHERE m.dataset_id = t.dataset_id) AS summaries_total
FROM f_datasets t""", (*SCOPE, "f_summaries"))
def dataset_stats(t):
    """D01."""
    return listing.dataset_stats(t.datasets, t.sources, t.documents, t.chunks, summaries=t.summaries)


@query("SELECT source_id, CAST(epoch(created_at) AS BIGINT) AS created FROM f_sources WHERE dataset_id = 'en' ORDER BY created_at DESC, source_id LIMIT 20 OFFSET 40", ("f_sources",))
def source_page(t):
    """F05, Q25."""
    return remember.source_page(t.sources, "en", 40, 20).select("source_id", F.unix_timestamp("created_at").alias("created"))


@query("SELECT dataset_id, content_sha256, source_id, version FROM f_sources QUALIFY row_number() OVER (PARTITION BY dataset_id, content_sha256 ORDER BY version DESC, created_at DESC, source_id) = 1", ("f_sources",))
def source_latest_version(t):
    """E01."""
    return listing.latest_sources(t.sources).select("dataset_id", "content_sha256", "source_id", "version")


@query("SELECT source_id, generation, document_id FROM f_documents WHERE is_active", ("f_documents",))
def latest_documents(t):
    """E02."""
    return listing.latest_documents(t.documents).select("source_id", "generation", "document_id")


@query("SELECT document_id, count(*) AS n_chunks FROM f_chunks GROUP BY 1", ("f_chunks",))
def chunks_per_document(t):
    """D07."""
    return listing.chunks_per_document(t.chunks)


@query("SELECT DISTINCT entity_type FROM f_entities", ("f_entities",))
def entity_types(t):
    """D03."""
    return listing.sorted_values(t.entities, "entity_type")


@query("SELECT DISTINCT predicate FROM f_relations WHERE is_active", ("f_relations",))
def relation_predicates(t):
    """D03."""
    return listing.sorted_values(t.relations.where("is_active"), "predicate")


@query("SELECT source_entity_id AS entity_id FROM f_relations WHERE is_active UNION SELECT target_entity_id FROM f_relations WHERE is_active", ("f_relations",))
def incident_entities(t):
    """D05."""
    return listing.incident_entities(t.relations.where("is_active"))


# --- search -----------------------------------------------------------------------------------


def query_vector(t: Fixture) -> list[float]:
    return t.table("embeddings").where("vec_id = 7").first()["embedding"]


COS = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])))"


@query(f"SELECT vec_id AS chunk_id, round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50")
def vector_topk(t):
    """F01, X18."""
    rows = t.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return search.vector_top_k(rows, query_vector(t)).select("chunk_id", F.round("score", 6).alias("score"))


@query(f"SELECT vec_id AS id, round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) AS score FROM embeddings ORDER BY 2 DESC, 1 LIMIT 50")
def vector_topk_stored(t):
    """behind the stored pivot index."""
    return t.vector_index().top_k(query_vector(t), 50)[0].select("id", F.round("score", 6).alias("score"))


@query(f"""SELECT m.summary_id, m.document_id, round({COS.format(a='m.embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) AS score
  FROM f_summaries m JOIN f_datasets t USING (dataset_id) JOIN f_documents d ON d.document_id = m.document_id JOIN f_sources s ON s.source_id = d.source_id
  WHERE t.status = 'active' AND m.is_active AND m.generation = t.active_generation AND d.is_active AND d.generation = t.active_generation AND s.status = 'active' ORDER BY 3 DESC, 1 LIMIT 12""", ("f_datasets", "f_sources", "f_documents", "f_summaries"))
def summary_topk(t):
    """B02, F03, Q02."""
    rows = scope.authoritative_summaries(t.summaries, t.documents, t.sources, t.datasets)
    return recall.summary_hits(rows, query_vector(t)).select("summary_id", "document_id", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS self_dot, len(embedding) = 64 AS valid FROM embeddings")
def vector_checks(t):
    """X18, X34."""
    e = t.table("embeddings")
    return e.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 6).alias("self_dot"), vectors.valid_embedding(F.col("embedding"), 64).alias("valid"))


TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}]+')"
MATCHED = f"SELECT chunk_id, {TOKENS} AS w FROM f_chunks WHERE is_active"


@query(f"SELECT chunk_id FROM ({MATCHED}) x WHERE (list_contains(w, 'the') AND list_contains(w, 'of') AND NOT list_contains(w, 'and')) OR list_contains(w, 'apache')", ("f_chunks",))
def lexical_match(t):
    """AND, NOT and OR."""
    q = lexical.parse_query("the of -and or apache")
    rows = t.chunks.where("is_active").select("chunk_id", lexical.to_vector(F.col("text")).alias("v"))
    return rows.where(lexical.matches(F.col("v"), q)).select("chunk_id")


@query(f"SELECT chunk_id, len(list_filter(w, lambda x: x IN ('the', 'of', 'and')))::INT AS rank_score FROM ({MATCHED}) x WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'and') ORDER BY 2 DESC, 1 LIMIT 50", ("f_chunks",))
def lexical_topk(t):
    """F02, ranked by occurrences so that SQL can check it; cover density is tested apart."""
    q = lexical.parse_query(" ".join(WORDS))
    return search.lexical_top_k(t.chunks.where("is_active"), q, rank=lexical.token_rank)


def covers_sql(words: tuple[str, ...], source: str = MATCHED) -> str:
    """(chunk_id, rank_score) by cover density for an AND of words: the last place of each word at every occurrence, by window functions."""
    last = ", ".join(f"max(CASE WHEN word = '{w}' THEN pos END) OVER run AS p{i}, max(CASE WHEN word = '{w}' THEN place END) OVER run AS n{i}" for i, w in enumerate(words))
    p, n = (", ".join(f"{c}{i}" for i in range(len(words))) for c in "pn")
    whole = " AND ".join(f"p{i} IS NOT NULL" for i in range(len(words)))
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""SELECT chunk_id, round(sum(0.1::DOUBLE / greatest(1 + (pos - start) - (place - first), 1)), 9) AS rank_score FROM (
  SELECT *, lag(start) OVER (PARTITION BY chunk_id ORDER BY place) AS before FROM (
  SELECT chunk_id, pos, place, least({p}) AS start, least({n}) AS first FROM (SELECT *, {last} FROM (
  SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS place FROM (SELECT chunk_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM ({source}) m) t WHERE word IN ({listed})) o
  WINDOW run AS (PARTITION BY chunk_id ORDER BY place ROWS UNBOUNDED PRECEDING)) l WHERE {whole}) c) d WHERE before IS NULL OR start > before GROUP BY chunk_id"""


@query(covers_sql(WORDS), ("f_chunks",))
def cover_ranks(t):
    """Cover density of every chunk that has all words, by window functions on both sides."""
    return search.cover_ranks(t.chunks.where("is_active"), list(WORDS))


@query(covers_sql(WORDS), ("f_chunks",))
def cover_ranks_stored(t):
    """The same from the stored index, by the linear sweep."""
    return t.lexical_index().ranked(lexical.parse_query(" ".join(WORDS)))


@query(f"SELECT chunk_id, rank_score FROM ({covers_sql(WORDS)}) r ORDER BY rank_score DESC, chunk_id LIMIT 50", ("f_chunks",))
def lexical_cover_topk(t):
    """The stored index, left by rank bounds."""
    return t.lexical_index().top_k(lexical.parse_query(" ".join(WORDS)), 50)


@query(f"SELECT chunk_id FROM ({MATCHED}) x WHERE (list_contains(w, 'the') AND list_contains(w, 'of') AND NOT list_contains(w, 'and')) OR list_contains(w, 'apache')", ("f_chunks",))
def lexical_match_stored(t):
    """AND, NOT and OR, from the stored index."""
    return t.lexical_index().ranked(lexical.parse_query("the of -and or apache")).select("chunk_id")


@query(f"SELECT word AS lexeme, count(DISTINCT chunk_id) AS n_chunks, count(*) AS n_positions FROM (SELECT chunk_id, unnest(w) AS word FROM ({MATCHED}) m) x GROUP BY 1", ("f_chunks",))
def stored_lexemes(t):
    """What the stored index holds of every lexeme."""
    posts = t.spark.read.parquet(f"{t.lexical_index().path}/postings")
    sums = F.aggregate("posts", F.lit(0).cast("long"), lambda n, p: n + F.size(p["positions"]))
    return posts.groupBy("lexeme").agg(F.sum(F.size("posts")).cast("long").alias("n_chunks"), F.sum(sums).cast("long").alias("n_positions"))


@query(f"""WITH v AS (SELECT vec_id AS chunk_id, row_number() OVER (ORDER BY round({COS.format(a='embedding', b='(SELECT embedding FROM embeddings WHERE vec_id = 7)')}, 6) DESC, vec_id) AS rank FROM embeddings),
l AS (SELECT doc_id AS chunk_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents),
f AS (SELECT chunk_id, v.rank AS vector_rank, l.rank AS lexical_rank, coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS score FROM (SELECT * FROM v WHERE rank <= 50) v FULL JOIN (SELECT * FROM l WHERE rank <= 50) l USING (chunk_id))
SELECT chunk_id, vector_rank::INT AS vector_rank, lexical_rank::INT AS lexical_rank, round(score, 9) AS score FROM f ORDER BY f.score DESC, least(vector_rank, lexical_rank), CAST(chunk_id AS VARCHAR) LIMIT 12""")
def rrf_fusion(t):
    """C07, E05, F04, X19."""
    rows = t.table("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    near = search.ranked(search.vector_top_k(rows, query_vector(t)).withColumn("score", F.round("score", 6)), F.desc("score"), "chunk_id")
    long_ = t.table("documents").select(F.col("doc_id").alias("chunk_id"), "n_chars").orderBy(F.desc("n_chars"), "chunk_id").limit(50)
    fused = search.fuse(near, search.ranked(long_, F.desc("n_chars"), "chunk_id"), top_k=12)
    return fused.select("chunk_id", "vector_rank", "lexical_rank", F.round("score", 9).alias("score"))


@query(f"""WITH v AS ({VISIBLE}), h AS (SELECT *, 1.0 / (1 + ordinal) AS sc FROM v WHERE document_id <= 40), q AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM h)
SELECT chunk_id, document_id, ordinal, CASE WHEN length(one) <= 500 THEN one ELSE rtrim(substr(one, 1, 499)) || '…' END AS quote FROM q""", SCOPE)
def recall_references(t):
    """S03, X04."""
    hits = visible(t).where("document_id <= 40").withColumn("score", 1 / (1 + F.col("ordinal")))
    return search.references(hits).select("chunk_id", "document_id", "ordinal", "quote")


@query(f"""WITH v AS ({VISIBLE}), h AS (SELECT *, 1.0 / (1 + ordinal) AS sc FROM v), q AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS one FROM h)
SELECT chunk_id, document_id, ordinal, CASE WHEN length(one) <= 500 THEN one ELSE rtrim(substr(one, 1, 499)) || '…' END AS quote FROM q""", SCOPE)
def recall_references_all(t):
    """Over all visible chunks."""
    hits = visible(t).withColumn("score", 1 / (1 + F.col("ordinal")))
    return search.references(hits).select("chunk_id", "document_id", "ordinal", "quote")


@query(f"""WITH vis AS ({VISIBLE}), q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7),
near AS (SELECT chunk_id, row_number() OVER (ORDER BY {COS.format(a='x.embedding', b='q.e')} DESC, chunk_id) AS vector_rank FROM vis JOIN embeddings x ON x.vec_id = vis.document_id AND vis.ordinal = 0, q ORDER BY 2 LIMIT 50),
said AS (SELECT chunk_id, row_number() OVER (ORDER BY rank_score DESC, chunk_id) AS lexical_rank FROM ({covers_sql(('the', 'of'), f"SELECT chunk_id, {TOKENS} AS w FROM vis")}) r ORDER BY 2 LIMIT 50),
f AS (SELECT chunk_id, vector_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS score FROM near FULL JOIN said USING (chunk_id))
SELECT f.chunk_id, document_id, vector_rank::INT AS vector_rank, lexical_rank::INT AS lexical_rank, round(score, 9) AS score FROM (SELECT * FROM f ORDER BY score DESC, least(vector_rank, lexical_rank), CAST(chunk_id AS VARCHAR) LIMIT 12) f JOIN vis USING (chunk_id)""", SCOPE)
def recall_rag(t):
    """Q01: whole chunks recall with both channels, over summaries' vectors placed on first chunks; words from the stored index."""
    return recall.chunk_hits(with_vectors(t), query_vector(t), "the of", index=t.lexical_index()).select("chunk_id", "document_id", "vector_rank", "lexical_rank", F.round("score", 9).alias("score"))


def with_vectors(t: Fixture) -> DataFrame:
    vec = t.table("embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    chunks = t.chunks.join(vec, "document_id", "left").withColumn("embedding", F.when(F.col("ordinal") == 0, F.col("embedding")))
    return scope.authoritative_chunks(chunks, t.documents, t.sources, t.datasets)


@query()
def recall_graph(t):
    """Q03: recall with graph expansion over the order graph."""
    src = t.table("orders").select(F.col("o_orderkey").alias("chunk_id"))
    hits = src.withColumn("score", F.lit(1.0) / (F.col("chunk_id") + 1))
    relations = t.relations.where("is_active").withColumn("description", F.lit(""))
    entities = t.mentions.select("entity_id").distinct()
    return recall.graph_hits(hits, src.withColumn("text", F.lit("")), t.mentions, relations, entities, t.evidence, top_k=12)["relations"].select("relation_id", "score", "evidence_chunk_id")


# --- graph ------------------------------------------------------------------------------------

SEEDS = "SELECT o_orderkey AS chunk_id, 1.0::DOUBLE / (o_orderkey + 1) AS score FROM orders WHERE o_orderkey <= 40"
BOTH = "SELECT source_entity_id AS a, target_entity_id AS b, relation_id FROM f_relations WHERE is_active UNION ALL SELECT target_entity_id, source_entity_id, relation_id FROM f_relations WHERE is_active AND source_entity_id <> target_entity_id"
HOP = f"seeds AS ({SEEDS}), e AS ({BOTH}), hop AS (SELECT s.chunk_id, m.entity_id AS seed_entity_id, e.b AS neighbor_entity_id, e.relation_id, s.score FROM seeds s JOIN f_mentions m USING (chunk_id) LEFT JOIN e ON e.a = m.entity_id)"


ALL_SEEDS = "SELECT o_orderkey AS chunk_id, 1.0::DOUBLE / (o_orderkey + 1) AS score FROM orders"
ALL_HOP = f"seeds AS ({ALL_SEEDS}), e AS ({BOTH}), hop AS (SELECT s.chunk_id, m.entity_id AS seed_entity_id, e.b AS neighbor_entity_id, e.relation_id, s.score FROM seeds s JOIN f_mentions m USING (chunk_id) LEFT JOIN e ON e.a = m.entity_id)"


def all_seeds(t: Fixture) -> DataFrame:
    return t.table("orders").select(F.col("o_orderkey").alias("chunk_id"), (F.lit(1.0) / (F.col("o_orderkey") + 1)).alias("score"))


def seeds(t: Fixture) -> DataFrame:
    return t.table("orders").where("o_orderkey <= 40").select(F.col("o_orderkey").alias("chunk_id"), (F.lit(1.0) / (F.col("o_orderkey") + 1)).alias("score"))


@query(f"WITH {HOP} SELECT DISTINCT chunk_id, seed_entity_id, neighbor_entity_id, relation_id FROM hop", ("f_relations", "f_mentions"))
def graph_one_hop(t):
    """G01, C08."""
    return graph.one_hop(seeds(t), t.mentions, t.relations.where("is_active"))


@query(f"WITH {ALL_HOP} SELECT DISTINCT chunk_id, seed_entity_id, neighbor_entity_id, relation_id FROM hop", ("f_relations", "f_mentions"))
def graph_one_hop_all(t):
    """From all orders."""
    return graph.one_hop(all_seeds(t), t.mentions, t.relations.where("is_active"))


@query(f"WITH {HOP}, p AS (SELECT seed_entity_id AS entity_id, score FROM hop UNION ALL SELECT neighbor_entity_id, score FROM hop WHERE neighbor_entity_id IS NOT NULL) SELECT entity_id, max(score) AS score FROM p GROUP BY 1", ("f_relations", "f_mentions"))
def graph_scores(t):
    """D06."""
    return graph.graph_scores(graph.one_hop(seeds(t), t.mentions, t.relations.where("is_active")), seeds(t))[0]


@query(f"WITH {ALL_HOP}, p AS (SELECT seed_entity_id AS entity_id, score FROM hop UNION ALL SELECT neighbor_entity_id, score FROM hop WHERE neighbor_entity_id IS NOT NULL) SELECT entity_id, max(score) AS score FROM p GROUP BY 1", ("f_relations", "f_mentions"))
def graph_scores_all(t):
    """From all orders."""
    return graph.scores_around(all_seeds(t), t.mentions, t.relations.where("is_active"))[0]


@query(f"WITH {HOP} SELECT relation_id, max(score) AS score FROM hop WHERE relation_id IS NOT NULL GROUP BY 1", ("f_relations", "f_mentions"))
def graph_relation_scores(t):
    """D06."""
    return graph.graph_scores(graph.one_hop(seeds(t), t.mentions, t.relations.where("is_active")), seeds(t))[1]


@query(f"WITH {ALL_HOP} SELECT relation_id, max(score) AS score FROM hop WHERE relation_id IS NOT NULL GROUP BY 1", ("f_relations", "f_mentions"))
def graph_relation_scores_all(t):
    """From all orders."""
    return graph.scores_around(all_seeds(t), t.mentions, t.relations.where("is_active"))[1]


@query(f"WITH e AS ({BOTH}), h1 AS (SELECT DISTINCT b FROM e WHERE a = 'c1'), h2 AS (SELECT DISTINCT e.b FROM e JOIN h1 ON e.a = h1.b), n AS (SELECT 'c1' AS entity_id, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) SELECT entity_id, min(hop)::INT AS hop FROM n GROUP BY 1", ("f_relations",))
def subgraph_2hop(t):
    """G02."""
    root = t.spark.createDataFrame([("c1",)], "entity_id string")
    return t.adjacency().subgraph_nodes(root, 2)


@query("WITH n AS (SELECT DISTINCT target_entity_id AS x FROM f_relations WHERE is_active AND source_entity_id IN ('c1', 'c2') UNION SELECT 'c1' UNION SELECT 'c2' UNION SELECT 'c4') SELECT relation_id, source_entity_id, target_entity_id FROM f_relations WHERE is_active AND source_entity_id IN (SELECT x FROM n) AND target_entity_id IN (SELECT x FROM n)", ("f_relations",))
def relations_among(t):
    """G03, C17."""
    live = t.relations.where("is_active")
    nodes = live.where("source_entity_id in ('c1', 'c2')").select(F.col("target_entity_id").alias("entity_id")).union(t.spark.createDataFrame([("c1",), ("c2",), ("c4",)], "entity_id string"))
    return graph.relations_among(live, nodes)


@query(f"""WITH e AS (SELECT a, b, min(relation_id) AS r FROM ({BOTH}) x GROUP BY 1, 2), ends AS (SELECT min(source_entity_id) AS s FROM f_relations WHERE is_active), p2 AS (SELECT x.a AS a, x.b AS m, y.b AS z FROM e x JOIN e y ON x.b = y.a WHERE x.a = (SELECT s FROM ends)),
target AS (SELECT min(z) AS z FROM p2 WHERE z <> a) SELECT 2 AS length, a || ',' || min(m) || ',' || p2.z AS path FROM p2 JOIN target USING (z) GROUP BY a, p2.z""", ("f_relations",))
def shortest_path(t):
    """Between the first customer and the first one that shares a part with it."""
    near = t.adjacency()
    start = near.rows.where("forward").agg(F.min("node")).first()[0]
    parts = near.rows.where((F.col("node") == start) & F.col("forward")).select(F.col("other").alias("node"))
    end = near.at(parts, parts.count()).where(F.col("other") != start).agg(F.min("other")).first()[0]
    return near.shortest_path(start, end).select("length", F.concat_ws(",", "nodes").alias("path"))


@query("SELECT 'entity_type' AS kind, entity_type AS value FROM f_entities UNION SELECT 'predicate', predicate FROM f_relations UNION SELECT * FROM (VALUES ('node_label', 'Entity'), ('node_label', 'Chunk'), ('relationship_type', 'RELATES_TO'), ('relationship_type', 'MENTIONED_IN'), ('relationship_type', 'NEXT')) v", ("f_entities", "f_relations"))
def graph_schema(t):
    """G07."""
    return graph.graph_schema(t.entities, t.relations)


DEGREE = "ends AS (SELECT source_entity_id AS entity_id FROM f_relations WHERE is_active AND source_entity_id <> target_entity_id UNION ALL SELECT target_entity_id FROM f_relations WHERE is_active AND source_entity_id <> target_entity_id), deg AS (SELECT entity_id, count(*) AS degree FROM ends GROUP BY 1), cen AS (SELECT entity_id, degree, CAST(printf('%.4f', degree::DOUBLE / (SELECT max(degree) FROM deg)) AS DOUBLE) AS centrality FROM deg)"


@query(f"WITH {DEGREE} SELECT * FROM cen", ("f_relations",))
def centrality(t):
    """D08."""
    return graph.degree_centrality(t.relations.where("is_active"))


@query(f"WITH {DEGREE} SELECT relation_id, CAST(printf('%.4f', (a.centrality + b.centrality) / 2) AS DOUBLE) AS centrality FROM f_relations r JOIN cen a ON a.entity_id = r.source_entity_id JOIN cen b ON b.entity_id = r.target_entity_id WHERE r.is_active", ("f_relations",))
def relation_centrality(t):
    """D09."""
    live = t.relations.where("is_active")
    return graph.relation_centrality(live, graph.degree_centrality(live))


@query("SELECT relation_id FROM f_relations r WHERE is_active AND NOT EXISTS (SELECT 1 FROM f_evidence e JOIN orders o ON o.o_orderkey = e.chunk_id WHERE e.relation_id = r.relation_id AND o.o_orderstatus = 'F')", ("f_relations", "f_evidence"))
def hygiene_orphans(t):
    """Relations all of whose evidence stands in orders that are not finished."""
    seen = t.evidence.join(t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id")), "chunk_id", "left_semi")
    return graph.without_evidence(t.relations.where("is_active"), seen).select("relation_id")


@query(f"""WITH {DEGREE}, c AS (SELECT entity_id, 0.5::DOUBLE AS w, centrality FROM cen) SELECT entity_id, w AS feedback_weight, centrality AS centrality_weight, CAST(printf('%.4f', (w + centrality) / 2) AS DOUBLE) AS importance_weight FROM c""", ("f_relations",))
def importance_update(t):
    """Weights of entities with no marker yet."""
    live = t.relations.where("is_active")
    none = F.lit(None).cast("double")
    rows = listing.incident_entities(live).select("entity_id", F.lit(0.5).alias("importance_weight"), none.alias("feedback_weight"), none.alias("centrality_weight"))
    return improve.importance(rows, graph.degree_centrality(live), "entity_id")


@query("SELECT dataset_id, chunk_id, n AS next_chunk_id FROM (SELECT *, lead(chunk_id) OVER w AS n, lead(ordinal) OVER w AS o FROM f_chunks WHERE is_active WINDOW w AS (PARTITION BY dataset_id, document_id, generation ORDER BY ordinal, chunk_id)) x WHERE o = ordinal + 1", ("f_chunks",))
def next_edges(t):
    """C11, E07."""
    return graph.next_edges(t.chunks.where("is_active"))


# --- deduplication ------------------------------------------------------------------------------

PAIRS = f"SELECT a.entity_id, b.entity_id AS candidate_id, {COS.format(a='a.embedding', b='b.embedding')} AS similarity FROM f_entities a JOIN f_entities b ON a.entity_type = b.entity_type AND a.entity_id < b.entity_id"


@query(f"SELECT entity_id, candidate_id, round(similarity, 6) AS similarity FROM ({PAIRS}) p WHERE similarity >= {THETA}", ("f_entities",))
def duplicate_candidates(t):
    """C06, F08, G18."""
    return dedup.duplicate_candidates(t.entities, THETA).withColumn("similarity", F.round("similarity", 6))


@query()
def merge_plan(t):
    """Greedy and sequential, so checked against a Python model in the tests."""
    return dedup.merge_plan(t.entities, dedup.duplicate_candidates(t.entities, THETA_MERGE))


def part_plan(t: Fixture) -> DataFrame:
    """A merge plan over the order graph: parts of one name and size go to the least of them."""
    p = t.table("part").select(F.concat(F.lit("p"), "p_partkey").alias("entity_id"), "p_brand", "p_size", "p_partkey")
    least = p.groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("k"))
    return p.join(least, ["p_brand", "p_size"]).where("p_partkey <> k").select("entity_id", F.concat(F.lit("p"), "k").alias("survivor_id"))


PLAN = "plan AS (SELECT 'p' || p_partkey AS entity_id, 'p' || min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS survivor_id FROM part QUALIFY entity_id <> survivor_id), mapped AS (SELECT r.relation_id, r.predicate, coalesce(a.survivor_id, r.source_entity_id) AS s, coalesce(b.survivor_id, r.target_entity_id) AS t, a.survivor_id IS NOT NULL OR b.survivor_id IS NOT NULL AS changed FROM f_relations r LEFT JOIN plan a ON a.entity_id = r.source_entity_id LEFT JOIN plan b ON b.entity_id = r.target_entity_id WHERE r.is_active), g AS (SELECT *, row_number() OVER (PARTITION BY s, t, predicate ORDER BY changed, relation_id) AS n, count(*) OVER (PARTITION BY s, t, predicate) AS c, bool_or(changed) OVER (PARTITION BY s, t, predicate) AS any_changed, first(relation_id) OVER (PARTITION BY s, t, predicate ORDER BY changed, relation_id) AS f FROM mapped)"


@query(f"WITH {PLAN} SELECT relation_id, s AS source_entity_id, t AS target_entity_id, CASE WHEN any_changed AND c > 1 AND n > 1 THEN 'merged' WHEN any_changed AND c > 1 THEN 'survivor' WHEN changed THEN 'rewired' ELSE 'kept' END AS outcome, CASE WHEN any_changed AND c > 1 AND n > 1 THEN f END AS survivor_id FROM g", ("f_relations",))
def relation_rewire(t):
    """G17, E10."""
    return dedup.rewired(t.relations.where("is_active"), part_plan(t)).select("relation_id", "source_entity_id", "target_entity_id", "outcome", "survivor_id")


@query(f"WITH {PLAN}, lost AS (SELECT relation_id, f AS survivor_id FROM g WHERE any_changed AND c > 1 AND n > 1), x AS (SELECT l.survivor_id, e.chunk_id, e.confidence, row_number() OVER (PARTITION BY l.survivor_id, e.chunk_id ORDER BY l.relation_id) AS k FROM f_evidence e JOIN lost l USING (relation_id) WHERE NOT EXISTS (SELECT 1 FROM f_evidence o WHERE o.relation_id = l.survivor_id AND o.chunk_id = e.chunk_id)) SELECT survivor_id AS relation_id, chunk_id, confidence FROM x WHERE k = 1", ("f_relations", "f_evidence"))
def evidence_copies(t):
    """S05."""
    return dedup.copied_evidence(t.evidence, dedup.rewired(t.relations.where("is_active"), part_plan(t)))


@query("WITH plan AS (SELECT 'p' || p_partkey AS entity_id, 'p' || min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS survivor_id FROM part) SELECT coalesce(p.survivor_id, m.entity_id) AS entity_id, count(*) AS n FROM f_mentions m LEFT JOIN plan p USING (entity_id) GROUP BY 1", ("f_mentions",))
def mention_reassignment(t):
    """G16."""
    ents = t.mentions.select("entity_id").distinct().withColumn("is_active", F.lit(True))
    return dedup.apply_merges(ents, t.mentions, part_plan(t))[1].groupBy("entity_id").agg(F.count("*").alias("n"))


# --- feedback -----------------------------------------------------------------------------------


@query("""WITH RECURSIVE o AS (SELECT entity_id, score, row_number() OVER (PARTITION BY entity_id ORDER BY feedback_id) AS k FROM f_feedback),
f(entity_id, k, v) AS (SELECT DISTINCT entity_id, 0::BIGINT, 0.5::DOUBLE FROM o UNION ALL SELECT f.entity_id, o.k, CAST(printf('%.4f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, v + 0.1::DOUBLE * ((score + 1) / 2.0::DOUBLE - v)))) AS DOUBLE) FROM f JOIN o ON o.entity_id = f.entity_id AND o.k = f.k + 1)
SELECT entity_id, arg_max(v, k) AS weight, max(k)::INT AS n_feedback FROM f GROUP BY 1""", ("f_feedback",))
def feedback_fold(t):
    """D10, X20, X21."""
    return feedback.fold_by(t.feedback, "entity_id", ["feedback_id"])


# --- ingest ------------------------------------------------------------------------------------


@query("SELECT lang AS dataset_id, doc_id AS source_id, sha256(text) AS content_sha256, CASE WHEN row_number() OVER (PARTITION BY lang, text ORDER BY doc_id) = 1 THEN 'created' ELSE 'duplicate' END AS outcome FROM documents")
def remember_dedup(t):
    """Q06: exact duplicates inside a batch."""
    rows = t.table("documents").select(F.col("lang").alias("dataset_id"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("name"), "text", F.timestamp_seconds(F.lit(0)).alias("created_at"), F.col("doc_id"))
    empty = t.sources.where("false").select("source_id", "dataset_id", "content_sha256", "version", "status")
    return remember.remembered(rows, empty).select("dataset_id", F.col("doc_id").alias("source_id"), "content_sha256", "outcome")


@query("WITH o AS (SELECT lang AS dataset_id, sha256(text) AS h, doc_id FROM documents WHERE doc_id % 2 = 0), n AS (SELECT lang AS dataset_id, sha256(text) AS h, doc_id FROM documents WHERE doc_id % 2 = 1), held AS (SELECT dataset_id, h, count(*) AS c FROM o GROUP BY 1, 2) SELECT n.doc_id AS source_id, (coalesce(c, 0) + row_number() OVER (PARTITION BY n.dataset_id, n.h ORDER BY n.doc_id))::INT AS version FROM n LEFT JOIN held USING (dataset_id, h)")
def remember_versions(t):
    """Forced re-ingest of the odd documents after the even ones."""
    d = t.table("documents").select(F.col("lang").alias("dataset_id"), F.sha2("text", 256).alias("content_sha256"), F.col("doc_id").alias("source_id"), F.timestamp_seconds(F.lit(0)).alias("created_at"))
    old = d.where("source_id % 2 = 0")
    held = old.groupBy("dataset_id", "content_sha256").agg(F.count("*").cast("int").alias("version"))
    return listing.next_version(d.where("source_id % 2 = 1"), held).select("source_id", "version")


@query("SELECT doc_id, sha256(text) AS content_sha256, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS normalized_sha256, strlen(text)::BIGINT AS byte_size, regexp_matches(text, '[\\x00-\\x08\\x0B\\x0E-\\x1F]') AS control FROM documents")
def eol_normalise(t):
    """A02, A11, A13."""
    rows = loaders.prepared_text(t.table("documents"))
    return rows.select("doc_id", "content_sha256", "normalized_sha256", "byte_size", loaders.has_control(F.col("text")).alias("control"))


@query("SELECT chunk_id, sha256('1' || chr(31) || text) AS content_sha256 FROM f_chunks", ("f_chunks",))
def content_hash(t):
    """X13."""
    return t.chunks.select("chunk_id", scalars.chunk_hash(F.col("text")).alias("content_sha256"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || CAST(doc_id AS VARCHAR)::BLOB) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h""")
def uuid5_ids(t):
    """X14."""
    return t.table("documents").select("doc_id", scalars.uuid5(str(scalars.NAMESPACE_URL), F.col("doc_id").cast("string")).alias("id"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN regexp_replace(regexp_replace(url, '#.*$', ''), '^(https://[^/?]*)(\\?|$)', '\\1/\\2') END AS url FROM pages")
def url_normalise(t):
    """A15."""
    return t.table("pages").select("page_id", urls.normalize_url("url").alias("url"))


@query()
def html_visible_text(t):
    """A08."""
    return t.table("pages").select("page_id", loaders.visible_text("html").alias("text"))


@query()
def url_filenames(t):
    """A17, A19."""
    return t.table("pages").select("page_id", urls.url_filename(F.col("url"), F.lit(".html")).alias("filename"))


@query()
def chunk_table(t):
    """K01-K07, X14."""
    docs = t.documents.where("is_active").select("document_id", "generation", "normalized_text")
    return chunk_documents(docs, most=120, overlap=20, least=15).select("document_id", "ordinal", "chunk_id", "start_char", "end_char", "token_count")


@query("SELECT n_name AS name, trim(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def dataset_slugs(t):
    """X03, Q24."""
    return remember.created_datasets(t.table("nation").select(F.col("n_name").alias("name")), t.datasets.withColumn("name", F.col("slug"))).select("name", "slug")


@query("SELECT c_custkey, lower(c_mktsegment) || ':' || lower(c_name) AS canonical_key, trim(regexp_replace(regexp_replace(lower(c_name), '[\\s-]+', '_', 'g'), '[^\\w]+', '_', 'g'), '_') AS predicate FROM customer")
def canonical_keys(t):
    """X01, X02."""
    c = t.table("customer")
    return c.select("c_custkey", scalars.ascii_entity_key(F.col("c_mktsegment"), F.col("c_name")).alias("canonical_key"), scalars.ascii_predicate(F.col("c_name")).alias("predicate"))


@query()
def cognify_graph(t):
    """Q09, Q10: chunks, extraction and merged entities of all active documents."""
    from .cognify import extracted_entities, merged_entities, prepared

    rows = prepared(t.documents.where("is_active"), most=300, overlap=30, least=20)
    return merged_entities(extracted_entities(rows)).select("dataset_id", "canonical_key", "name", "confidence", F.size("aliases").alias("n_aliases"))


@query("SELECT c_custkey, CAST(printf('%.4f', greatest(0.0::DOUBLE, least(1.0::DOUBLE, c_acctbal / 10000))) AS DOUBLE) AS clamped FROM customer")
def clamped_weights(t):
    """X22."""
    return t.table("customer").select("c_custkey", clamp_weight(F.col("c_acctbal") / 10000).alias("clamped"))


# --- projection and forgetting -----------------------------------------------------------------------


@query("WITH g AS (SELECT dataset_id, active_generation FROM f_datasets WHERE status = 'active'), c AS (SELECT c.* FROM f_chunks c JOIN g USING (dataset_id) WHERE c.is_active AND c.generation = g.active_generation), n AS (SELECT dataset_id, lead(ordinal) OVER w AS o, ordinal FROM c WINDOW w AS (PARTITION BY dataset_id, document_id, generation ORDER BY ordinal, chunk_id)) SELECT dataset_id, 'chunk' AS kind, count(*) AS n FROM c GROUP BY 1 UNION ALL SELECT dataset_id, 'chunk_next', count(*) FROM n WHERE o = ordinal + 1 GROUP BY 1", ("f_datasets", "f_chunks"))
def rebuild_snapshot(t):
    """G11, C12."""
    return snapshot(t).groupBy("dataset_id", "kind").agg(F.count("*").alias("n"))


def snapshot(t: Fixture) -> DataFrame:
    none = t.chunks.where("false")
    ents = none.select("dataset_id", F.lit("").alias("entity_id"), "generation", "is_active")
    rels = none.select("dataset_id", F.lit("").alias("relation_id"), F.lit("").alias("source_entity_id"), F.lit("").alias("target_entity_id"), "generation", "is_active")
    return projection.identities(projection.rebuilt(t.datasets, ents, t.chunks, t.mentions.where("false"), rels))


@query("WITH g AS (SELECT dataset_id, active_generation FROM f_datasets WHERE status = 'active'), x AS (SELECT c.dataset_id, c.chunk_id FROM f_chunks c JOIN g USING (dataset_id) WHERE c.is_active AND c.generation = g.active_generation), y AS (SELECT dataset_id, chunk_id FROM f_chunks WHERE ordinal % 4 <> 1) SELECT coalesce(x.dataset_id, y.dataset_id) AS dataset_id, 'chunk' AS kind, count(x.chunk_id) AS expected, count(y.chunk_id) AS actual, count(*) FILTER (y.chunk_id IS NULL) AS missing, count(*) FILTER (x.chunk_id IS NULL) AS extra FROM x FULL JOIN y ON x.chunk_id = y.chunk_id AND x.dataset_id = y.dataset_id GROUP BY 1", ("f_datasets", "f_chunks"))
def reconcile_diff(t):
    """S01, G12."""
    actual = t.chunks.where("ordinal % 4 <> 1").select("dataset_id", F.lit("chunk").alias("kind"), F.col("chunk_id").cast("string").alias("id"))
    return projection.reconciled(snapshot(t).where("kind = 'chunk'"), actual)


ORDER_VIEW = """hit AS (SELECT o_orderkey AS chunk_id FROM orders WHERE o_custkey % 10 = 3), rest AS (SELECT o_orderkey AS chunk_id FROM orders WHERE o_custkey % 10 <> 3),
live AS (SELECT * FROM f_relations WHERE is_active), touched AS (SELECT DISTINCT relation_id FROM f_evidence WHERE chunk_id IN (SELECT chunk_id FROM hit)), proved AS (SELECT DISTINCT relation_id FROM f_evidence WHERE chunk_id IN (SELECT chunk_id FROM rest)),
gone AS (SELECT relation_id FROM live WHERE relation_id IN (SELECT relation_id FROM touched) AND relation_id NOT IN (SELECT relation_id FROM proved)), left_ AS (SELECT * FROM live WHERE relation_id NOT IN (SELECT relation_id FROM gone)),
met AS (SELECT DISTINCT entity_id FROM f_mentions WHERE chunk_id IN (SELECT chunk_id FROM hit)), kept AS (SELECT entity_id FROM f_mentions WHERE chunk_id IN (SELECT chunk_id FROM rest) UNION SELECT source_entity_id FROM left_ UNION SELECT target_entity_id FROM left_)"""


def order_tables(t: Fixture) -> dict[str, DataFrame]:
    """Orders as chunks of their customer as source, four datasets of customers."""
    dataset = lambda key: F.concat(F.lit("d"), F.col(key) % 4)
    o = t.table("orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("document_id"), dataset("o_custkey").alias("dataset_id"))
    one = {"generation": F.lit(1), "is_active": F.lit(True)}
    docs = o.select("document_id", "source_id", "dataset_id").withColumns(one)
    chunks = o.withColumns({**one, "ordinal": F.lit(0), "text": F.lit(""), "start_char": F.lit(0), "end_char": F.lit(0)})
    src = t.table("customer").select(F.col("c_custkey").alias("source_id"), dataset("c_custkey").alias("dataset_id"), F.lit("active").alias("status"), F.col("c_name").alias("name"))
    sets = t.spark.createDataFrame([(f"d{k}", f"d{k}", "active", 1) for k in range(4)], "dataset_id string, slug string, status string, active_generation int")
    return {"datasets": sets, "sources": src, "documents": docs, "chunks": chunks, "relations": t.relations, "evidence": t.evidence, "mentions": t.mentions}


@query(f"WITH {ORDER_VIEW} SELECT 'chunks' AS kind, count(*) AS n FROM hit UNION ALL SELECT 'documents', count(*) FROM hit UNION ALL SELECT 'relations', count(*) FROM gone UNION ALL SELECT 'entities', count(*) FROM met WHERE entity_id NOT IN (SELECT entity_id FROM kept)", ("f_relations", "f_evidence", "f_mentions"))
def forget_source(t):
    """Q15: forgetting every tenth customer with all orders."""
    s = order_tables(t)
    gone = forget.forget_sources(s, s["sources"].where("source_id % 10 = 3").select("source_id"))
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in gone.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def relations_by_id(t: Fixture) -> DataFrame:
    """The active rows of ``f_relations``, as support counts no others, dealt by relation id: the keys travel, the names that they make are neither sent nor dealt again."""
    name = F.concat(F.lit("c"), "c", F.lit("-"), "f", F.lit("-p"), "p")
    rows = t.table("lineitem").join(t.table("orders").where("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("o_custkey").alias("c"), F.col("l_returnflag").alias("f"), F.col("l_partkey").alias("p"))
    rows = rows.repartition(name).select(name.alias("relation_id"), "c", "f", "p").distinct()
    return rows.select("relation_id", F.concat(F.lit("c"), "c").alias("source_entity_id"), F.concat(F.lit("p"), "p").alias("target_entity_id"), F.col("f").alias("predicate"), F.lit(True).alias("is_active"))


def order_support(t: Fixture) -> Versions:
    """Links and counts of the order graph, stored once for the present files."""
    build = lambda path: support.build(order_tables(t) | {"relations": relations_by_id(t)}, Versions(t.spark, path))
    return Versions(t.spark, derived(t.spark, "support_by_id", [f"{t.dir}/{n}.parquet" for n in ("customer", "lineitem", "orders")], build))


@query(f"WITH {ORDER_VIEW} SELECT 'chunks' AS kind, count(*) AS n FROM hit UNION ALL SELECT 'relations', count(*) FROM gone UNION ALL SELECT 'entities', count(*) FROM met WHERE entity_id NOT IN (SELECT entity_id FROM kept)", ("f_relations", "f_evidence", "f_mentions"))
def forget_source_counted(t):
    """Every tenth customer, from stored counts: only the links of these sources and the counts that they touch are read."""
    v = order_support(t)
    gone = support.removed(v, v.current()[1], t.table("customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("source_id")))
    parts = [gone[k].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k in ("chunks", "relations", "entities")]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 'documents' AS kind, count(*) AS n FROM f_documents WHERE is_active AND dataset_id IN ('fr', 'de') UNION ALL SELECT 'chunks', count(*) FROM f_chunks WHERE is_active AND dataset_id IN ('fr', 'de') UNION ALL SELECT 'summaries', count(*) FROM f_summaries WHERE is_active AND dataset_id IN ('fr', 'de')", ("f_documents", "f_chunks", "f_summaries"))
def forget_dataset(t):
    """Q16."""
    gone = forget.forget_datasets({"documents": t.documents, "chunks": t.chunks, "summaries": t.summaries}, t.datasets.where("dataset_id in ('fr', 'de')"))
    out = None
    for k, df in gone.items():
        p = df.agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
        out = p if out is None else out.union(p)
    return out


# --- streams and queue --------------------------------------------------------------------------------


@query("SELECT dataset_id, aggregate_type, aggregate_id, arg_max(operation, id) AS operation, max(id) AS id FROM f_outbox GROUP BY 1, 2, 3", ("f_outbox",))
def outbox_latest(t):
    """G09."""
    return projection.latest_state(t.outbox).select("dataset_id", "aggregate_type", "aggregate_id", "operation", "id")


@query(f"SELECT id FROM f_outbox WHERE status = 'pending' OR (status = 'processing' AND (processing_started_at IS NULL OR processing_started_at < {AS_OF} - INTERVAL 300 SECOND)) OR (status = 'failed' AND attempt < 5)", ("f_outbox",))
def outbox_claimable(t):
    """T02, B14."""
    return t.outbox.where(outbox.claimable(F.expr(AS_OF))).select("id")


@query("SELECT id, CASE aggregate_type WHEN 'entity' THEN 0 WHEN 'chunk' THEN 1 WHEN 'entity_mention' THEN 2 WHEN 'relation' THEN 3 WHEN 'chunk_next' THEN 4 ELSE 5 END::INT AS position FROM f_outbox WHERE dataset_id = 7 AND (status IN ('pending', 'processing') OR (status = 'failed' AND attempt < 5))", ("f_outbox",))
def outbox_order(t):
    """T06, F07."""
    return outbox.drain_order(t.outbox.where("dataset_id = 7")).select("id", "position")


REPS = """busy AS (SELECT * FROM f_runs WHERE status IN ('running', 'cancelling')), q AS (SELECT r.* FROM f_runs r WHERE status = 'queued' AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15 00:00:00')
  AND NOT EXISTS (SELECT 1 FROM busy b WHERE (r.dataset_id IS NOT NULL AND (b.dataset_id = r.dataset_id OR b.dataset_id IS NULL)) OR (r.dataset_id IS NULL AND (b.dataset_id IS NOT NULL OR b.run_id <> r.run_id)))),
reps AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY dataset_id ORDER BY created_at, run_id) = 1)"""


@query(f"WITH {REPS} SELECT run_id, dataset_id, created_at FROM reps", ("f_runs",))
def run_representatives(t):
    """T09, C09, E04, B13."""
    return runs.representatives(t.runs, F.expr(AS_OF)).select("run_id", "dataset_id", "created_at")


@query(f"WITH {REPS} SELECT dataset_id, count(*) AS n FROM busy WHERE dataset_id IS NOT NULL GROUP BY 1", ("f_runs",))
def run_conflicts(t):
    """C10."""
    return t.runs.where("status in ('running', 'cancelling') and dataset_id is not null").groupBy("dataset_id").agg(F.count("*").alias("n"))


@query(f"WITH {REPS}, g AS (SELECT min((created_at, run_id)) AS g FROM f_runs WHERE status = 'queued' AND dataset_id IS NULL AND (next_attempt_at IS NULL OR next_attempt_at <= TIMESTAMP '2024-01-15 00:00:00')), s AS (SELECT r.* FROM reps r, g WHERE dataset_id IS NOT NULL AND (g.g IS NULL OR (created_at, run_id) < g.g)) SELECT run_id FROM s UNION ALL SELECT run_id FROM reps WHERE dataset_id IS NULL AND (SELECT count(*) FROM s) = 0", ("f_runs",))
def runs_to_start(t):
    """T10."""
    return runs.arbitrated(t.runs, F.expr(AS_OF)).select("run_id")


@query(f"SELECT run_id FROM f_runs WHERE status IN ('running', 'cancelling') AND (heartbeat_at IS NULL OR heartbeat_at < {AS_OF} - INTERVAL 300 SECOND)", ("f_runs",))
def stale_runs(t):
    """B14, T19."""
    return t.runs.where(F.col("status").isin(*runs.BUSY) & scope.stale(F.col("heartbeat_at"), F.expr(AS_OF), 300, null_is_stale=True)).select("run_id")


MOVES = ", ".join(f"('{a}', '{b}')" for a, b in runs.RUN_MOVES)


@query(f"WITH l AS (SELECT run_id, lag(status) OVER (PARTITION BY dataset_id ORDER BY created_at, run_id) AS before, status AS after FROM f_runs WHERE dataset_id IS NOT NULL) SELECT run_id, before, after FROM l WHERE before IS NOT NULL AND (before, after) NOT IN ({MOVES})", ("f_runs",))
def illegal_transitions(t):
    """T11."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("dataset_id").orderBy("created_at", "run_id")
    log = t.runs.where("dataset_id is not null").select("run_id", F.lag("status").over(w).alias("before"), F.col("status").alias("after")).where("before is not null")
    return runs.illegal_moves(log)


@query("SELECT event_id, least(60.0::DOUBLE, pow(2, greatest(event_id % 9 - 1, 0))) + 0.25 AS backoff, greatest(0.25::DOUBLE, least(30.0::DOUBLE, (event_id % 200) * (1.0::DOUBLE / 3.0))) AS beat FROM events")
def retry_arithmetic(t):
    """X23, X24."""
    return t.table("events").select("event_id", scalars.backoff_seconds((F.col("event_id") % 9).cast("int"), F.lit(0.25)).alias("backoff"), scalars.heartbeat_seconds(F.col("event_id") % 200).alias("beat"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS \"end\", event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def ext_tumbling(t):
    """Extension: tumbling windows."""
    return ev.tumbling(t.table("events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("total", F.round("total", 6))


# --- provenance ---------------------------------------------------------------------------------------


@query("SELECT d.document_id, d.source_id, d.generation, d.is_active, coalesce(c.n, 0) AS n_chunks FROM f_documents d JOIN f_sources s ON s.source_id = d.source_id LEFT JOIN (SELECT document_id, count(*) AS n FROM f_chunks GROUP BY 1) c ON c.document_id = d.document_id", ("f_sources", "f_documents", "f_chunks"))
def provenance_source(t):
    """Q23, D07."""
    return provenance.source_lineage(t.sources, t.documents, t.chunks).select("document_id", "source_id", "generation", "is_active", "n_chunks")


@query("SELECT e.relation_id, e.chunk_id, e.confidence FROM f_evidence e JOIN f_relations r USING (relation_id) JOIN orders o ON o.o_orderkey = e.chunk_id WHERE r.is_active AND o.o_orderstatus = 'F' AND r.source_entity_id IN ('c1', 'c2', 'c4', 'c5', 'c7') QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY e.confidence DESC, e.chunk_id) <= 50", ("f_relations", "f_evidence"))
def provenance_relation(t):
    """Q23, C04, F10."""
    o = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("").alias("text"))
    rel = t.relations.where("is_active and source_entity_id in ('c1', 'c2', 'c4', 'c5', 'c7')")
    return provenance.relation_lineage(rel, t.evidence, o).select("relation_id", "chunk_id", "confidence")


@query("SELECT e.relation_id, e.chunk_id, e.confidence FROM f_evidence e JOIN f_relations r USING (relation_id) JOIN orders o ON o.o_orderkey = e.chunk_id WHERE r.is_active AND o.o_orderstatus = 'F' QUALIFY row_number() OVER (PARTITION BY relation_id ORDER BY e.confidence DESC, e.chunk_id) <= 50", ("f_relations", "f_evidence"))
def provenance_relation_all(t):
    """Of all active relations."""
    o = t.table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("document_id"), F.lit(0).alias("ordinal"), F.lit("").alias("text"))
    rel = t.relations.where("is_active")
    return provenance.relation_lineage(rel, t.evidence, o).select("relation_id", "chunk_id", "confidence")


@query(f"WITH v AS ({VISIBLE}), q AS (SELECT document_id AS query_id, (row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1)::INT AS position, chunk_id FROM f_chunks WHERE document_id % 10 = 4 AND ordinal < 12) SELECT query_id, position, CAST(q.chunk_id AS VARCHAR) AS chunk_id, v.chunk_id IS NOT NULL AS available FROM q LEFT JOIN v ON v.chunk_id = q.chunk_id", SCOPE)
def provenance_query(t):
    """Q23, C18, X29."""
    rows = t.chunks.where("document_id % 10 = 4 and ordinal < 12")
    item = F.struct(F.col("source_id").cast("string").alias("source_id"), F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").alias("chunk_ordinal"), F.lit(1.0).alias("score"))
    queries = rows.groupBy(F.col("document_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("i")))), lambda x: x["i"]).alias("i")).select("query_id", scalars.write_references(F.col("i")).alias("references"))
    return provenance.query_lineage(queries, visible(t)).select("query_id", "position", "chunk_id", "available")


@query(f"WITH v AS ({VISIBLE}), q AS (SELECT document_id AS query_id, (row_number() OVER (PARTITION BY document_id ORDER BY ordinal) - 1)::INT AS position, chunk_id FROM f_chunks) SELECT query_id, position, CAST(q.chunk_id AS VARCHAR) AS chunk_id, v.chunk_id IS NOT NULL AS available FROM q LEFT JOIN v ON v.chunk_id = q.chunk_id", SCOPE)
def provenance_query_all(t):
    """Of all documents' chunks."""
    rows = t.chunks
    item = F.struct(F.col("source_id").cast("string").alias("source_id"), F.col("document_id").cast("string").alias("document_id"), F.col("chunk_id").cast("string").alias("chunk_id"), F.col("ordinal").alias("chunk_ordinal"), F.lit(1.0).alias("score"))
    queries = rows.groupBy(F.col("document_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", item.alias("i")))), lambda x: x["i"]).alias("i")).select("query_id", scalars.write_references(F.col("i")).alias("references"))
    return provenance.query_lineage(queries, visible(t)).select("query_id", "position", "chunk_id", "available")


__all__ = ["ORACLES", "QUERIES", "effective_importance"]


from . import registry_state  # noqa: E402, F401 - registers its queries
