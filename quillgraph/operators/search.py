"""Ranked retrieval: vector and lexical channels, fusion, references, contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lexical import POSITION_LIMIT, WEIGHT, Query, cover_rank, matches, matches_tokens, tokens
from ..functions.scalars import reference_quote, rrf_score
from ..functions.vectors import cosine_to

DEFAULT_TOP_K, MOST_TOP_K, CANDIDATES, RRF_K = 12, 100, 50, 60
NO_EVIDENCE = "I could not find enough evidence to answer."


def checked_top_k(k: int | None, most: int = MOST_TOP_K) -> int:
    """F11."""
    k = DEFAULT_TOP_K if k is None else k
    if not 1 <= k <= most:
        raise ValueError(f"top_k must be between 1 and {most}")
    return k


def vector_top_k(rows: DataFrame, query: list[float], k: int = CANDIDATES, id_col: str = "chunk_id") -> DataFrame:
    """the k nearest by cosine distance, ties by id; rows without a usable vector take no part.

    Only id and score are sorted; wide columns come back by a join with the k ids.
    """
    scored = rows.where("embedding is not null").select(id_col, cosine_to(query)(F.col("embedding")).alias("score"))
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def lexical_top_k(rows: DataFrame, query: Query, k: int = CANDIDATES, rank=None) -> DataFrame:
    """matching rows by falling rank, ties by id. ``rows`` has text, or a ready ``lexical`` vector; ``rank`` is a function of it (or of the tokens) and the query."""
    stored = "lexical" in rows.columns
    # Without a stored vector tokens do: a row that does not match costs one pass over its text.
    if stored:
        found = rows.select("chunk_id", F.col("lexical").alias("_v")).where(matches(F.col("_v"), query))
        score = cover_rank(query)(F.map_entries(F.col("_v"))) if rank is None else rank(F.col("_v"), query)
    else:
        found = rows.select("chunk_id", tokens(F.col("text")).alias("_v")).where(matches_tokens(F.col("_v"), query))
        score = cover_rank(query, ordered=True)(F.col("_v")) if rank is None else rank(F.col("_v"), query)
    return found.select("chunk_id", score.alias("rank_score")).orderBy(F.desc("rank_score"), "chunk_id").limit(k)


def cover_ranks(rows: DataFrame, words: list[str]) -> DataFrame:
    """X10 natively, for an AND of words: (chunk_id, rank_score) of ``rows(chunk_id, text)`` by window functions over the positions.

    At each occurrence the last ones of all words are known; the earliest of
    them is where a cover that ends here begins, and it is a new cover if that
    start has moved.
    """
    words = list(dict.fromkeys(words))
    at = rows.select("chunk_id", F.posexplode(tokens(F.col("text"))).alias("pos", "word")).where(F.col("word").isin(words))
    over = Window.partitionBy("chunk_id").orderBy("pos")
    so_far = over.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(over)
    last = [F.max(F.when(F.col("word") == w, F.struct("pos", "place"))).over(so_far) for w in words]
    seen = at.withColumn("pos", F.least(F.col("pos") + 1, F.lit(POSITION_LIMIT))).withColumn("place", place)
    seen = seen.select("chunk_id", "pos", "place", *(x.alias(f"l{i}") for i, x in enumerate(last)))
    start = F.least(*(f"l{i}" for i in range(len(words)))) if len(words) > 1 else F.col("l0")
    whole = seen.where(" and ".join(f"l{i} is not null" for i in range(len(words)))).withColumn("start", start)
    covers = whole.withColumn("before", F.lag("start.pos").over(Window.partitionBy("chunk_id").orderBy("place"))).where("before is null or start.pos > before")
    noise = F.col("pos") - F.col("start.pos") - (F.col("place") - F.col("start.place"))
    return covers.groupBy("chunk_id").agg(F.round(F.sum(F.lit(WEIGHT) / F.greatest(1 + noise, F.lit(1))), 9).alias("rank_score"))


def ranked(df: DataFrame, *order: Column | str, as_: str = "rank") -> DataFrame:
    """1-based ranks of a channel. Channels are top-k results, so one partition holds them."""
    return df.withColumn(as_, F.row_number().over(Window.orderBy(*order)))


def fuse(vector: DataFrame, lexical: DataFrame, *, k: int = RRF_K, top_k: int | None = None) -> DataFrame:
    """Both channels (chunk_id, rank) joined whole by reciprocal rank fusion; score, then best rank, then id as text."""
    a = vector.select("chunk_id", F.col("rank").alias("vector_rank"))
    b = lexical.select("chunk_id", F.col("rank").alias("lexical_rank"))
    both = a.join(b, "chunk_id", "full_outer").withColumn("score", rrf_score(F.col("vector_rank"), F.col("lexical_rank"), k=k))
    order = (F.desc("score"), F.least("vector_rank", "lexical_rank"), F.col("chunk_id").cast("string"))
    return both.orderBy(*order) if top_k is None else both.orderBy(*order).limit(top_k)


def references(hits: DataFrame, evidence: DataFrame | None = None, relation_scores: DataFrame | None = None) -> DataFrame:
    """One reference a chunk: a hit comes before evidence, the first evidence before later ones.

    ``hits``: chunk columns and score; ``evidence``: relation_id, chunk columns, quote, confidence.
    """
    cols = ["source_id", "source_name", "document_id", "chunk_id", "ordinal", "start_char", "end_char"]
    rows = hits.select(*cols, reference_quote(F.col("text")).alias("quote"), "score", F.lit(0).alias("priority"), F.lit(None).cast("string").alias("relation_id"))
    if evidence is not None:
        found = evidence.join(relation_scores, "relation_id", "left") if relation_scores is not None else evidence.withColumn("relation_score", F.lit(0.0))
        rows = rows.unionByName(found.select(*cols, reference_quote(F.col("quote")).alias("quote"), F.coalesce("relation_score", F.lit(0.0)).alias("score"), F.lit(1).alias("priority"), F.col("relation_id").cast("string").alias("relation_id")))
    w = Window.partitionBy("chunk_id").orderBy("priority", F.desc("score"), "relation_id")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "relation_id")


def ordered_text(df: DataFrame, piece: Column, order: list[Column], sep: str = "\n\n", keys: list[str] | None = None, as_: str = "context") -> DataFrame:
    """Pieces joined in order. Meant for bounded results (top-k hits, the parts of one document)."""
    names = [c.alias(f"o{i}") for i, c in enumerate(order)]
    group = df.groupBy(*(keys or []))
    return group.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*names, piece.alias("piece")))), lambda x: x["piece"]), sep).alias(as_))


def rag_context(hits: DataFrame) -> DataFrame:
    """Hits as one text, best first."""
    piece = F.concat(F.lit("[chunk:"), F.col("chunk_id").cast("string"), F.lit("]\nsource: "), F.col("source_name"), F.lit("\ntext:\n"), F.col("text"))
    return ordered_text(hits, piece, [-F.col("score"), F.least("vector_rank", "lexical_rank"), F.col("chunk_id").cast("string")])


def graph_context(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Scored entities and relations as one text."""
    e = F.concat(F.lit("Entity: "), F.col("name"), F.lit(" ("), F.col("entity_type"), F.lit(")\nDescription: "), F.coalesce("description", F.lit("")))
    r = F.concat(
        F.lit("Relation: "), F.col("source_entity_id").cast("string"), F.lit(" --"), F.col("predicate"), F.lit("--> "), F.col("target_entity_id").cast("string"),
        F.lit("\nDescription: "), F.coalesce("description", F.lit("")), F.lit("\nEvidence: "), F.coalesce("evidence", F.lit("No filtered evidence available.")),
    )
    parts = ordered_text(entities, e, [-F.col("score"), F.col("entity_id").cast("string")], "\n", as_="t").select(F.lit(0).alias("part"), F.concat(F.lit("[ENTITIES]\n"), "t").alias("t"), (F.length("t") > 0).alias("has"))
    parts = parts.union(ordered_text(relations, r, [-F.col("score"), F.col("relation_id").cast("string")], "\n", as_="t").select(F.lit(1), F.concat(F.lit("[RELATIONS/TRIPLETS]\n"), "t"), F.length("t") > 0))
    return ordered_text(parts.where("has"), F.col("t"), [F.col("part")])


def hybrid_context(hits: DataFrame, summaries: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Chunks, document summaries and graph under headings; empty parts are left out."""
    piece = F.concat(F.lit("[document:"), F.col("document_id").cast("string"), F.lit("]\n"), F.col("text"))
    parts = rag_context(hits).select(F.lit(0).alias("part"), F.concat(F.lit("[CHUNKS]\n"), "context").alias("t"), F.lit(True).alias("has"))
    parts = parts.union(ordered_text(summaries, piece, [F.col("document_id").cast("string")]).select(F.lit(1), F.concat(F.lit("[DOCUMENT SUMMARIES]\n"), "context"), F.length("context") > 0))
    parts = parts.union(graph_context(entities, relations).select(F.lit(2), F.concat(F.lit("[GRAPH]\n"), "context"), F.length("context") > 0))
    return ordered_text(parts.where("has"), F.col("t"), [F.col("part")])


def gated_answer(n_hits: Column, answer: Column, *, mode: str, only_context: bool) -> Column:
    """Q04: generated text only in answering modes; the no-evidence text where nothing was found."""
    if only_context or mode not in ("rag", "graph", "hybrid"):
        return F.lit(None).cast("string")
    return F.when(n_hits == 0, F.lit(NO_EVIDENCE)).otherwise(answer)


def ordered_union(*parts: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids of the parts in order of first appearance (id, position). Each part is (id, position)."""
    rows = None
    for i, p in enumerate(parts):
        q = p.select(F.col(id_col), F.struct(F.lit(i).alias("part"), F.col("position").alias("position")).alias("position"))
        rows = q if rows is None else rows.unionByName(q)
    return rows.groupBy(id_col).agg(F.min("position").alias("position")).orderBy("position")
