"""Forgetting by stored counts, and ingest that commits against a base version.

``links`` has a row for each evidence or mention of a current chunk, in buckets
by source. ``counts`` has a row for each relation and entity, in buckets by id:
how many links of visible chunks it has, and for an entity at how many ends of
active relations it stands. Forgetting reads the links of its sources and the
counts that they touch; what comes to 0 goes. The buckets touched are written
anew and published together, so a failed run changes nothing. Both are made in
steps, each of which drops its shuffles before the next begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import scope
from ..operators.graph import kept
from ..session import sifted, tidy
from ..sources.versioned import BUCKETS, Conflict, Manifest, Versions, bucket_of
from .remember import remembered

KINDS = {"relation": ("evidence", "relation_id"), "entity": ("mentions", "entity_id")}
SMALL = 1 << 20  # ids of sources that are broadcast, so that the links are not dealt to meet them
HOT = 1 << 20  # links of ids of one hash that make them hot


def link_key() -> Column:
    return F.col("source_id").cast("string")


def link_bucket() -> Column:
    return bucket_of(link_key())


def id_bucket() -> Column:
    """By the hash by which Spark deals rows by ``id``, so that tasks to which they were dealt write few buckets each."""
    return F.pmod(F.hash("id"), F.lit(BUCKETS)).cast("int")


def content_key() -> tuple[Column, Column]:
    return F.col("dataset_id").cast("string"), F.col("content_sha256")


def current_chunks(t: dict[str, DataFrame]) -> DataFrame:
    """(chunk_id, source_id, visible) of all current chunks; visible are those of ``scope.authoritative_chunks``, told in one pass over the chunks."""
    gen, yes = scope.current_datasets(t["datasets"]), F.lit(True)
    now = t["chunks"].where("is_active").join(gen, "dataset_id").where("generation = active_generation").select("chunk_id", "source_id", "document_id", "dataset_id", "generation")
    src = t["sources"].where("status = 'active'").select("source_id", "dataset_id").distinct().withColumn("of_source", yes)
    docs = t["documents"].where("is_active").select("document_id", "dataset_id", "generation").distinct().withColumn("of_document", yes)
    now = now.join(src, ["source_id", "dataset_id"], "left").join(docs, ["document_id", "dataset_id", "generation"], "left")
    return now.select("chunk_id", "source_id", (F.col("of_source").isNotNull() & F.col("of_document").isNotNull()).alias("visible"))


def links_of(kind: str, t: dict[str, DataFrame], now: DataFrame) -> DataFrame:
    """(source_id, chunk_id, kind, id, visible) of the chunks ``now``, for relations or entities."""
    name, key = KINDS[kind]
    rows = t[name].select("chunk_id", F.col(key).cast("string").alias("id")).join(now, "chunk_id")
    return rows.select("source_id", "chunk_id", F.lit(kind).alias("kind"), "id", "visible")


def links(t: dict[str, DataFrame]) -> DataFrame:
    """(source_id, chunk_id, kind, id, visible) of all current chunks."""
    now = current_chunks(t)
    return links_of("relation", t, now).unionByName(links_of("entity", t, now))


def _slot() -> Column:
    return F.pmod(F.hash("id"), F.lit(1 << 16))


def hot_slots(every: DataFrame) -> list[int]:
    """Hashes of relation ids with over ``HOT`` links: at most one for each ``HOT`` links."""
    return [r[0] for r in every.where("kind = 'relation'").groupBy(_slot().alias("slot")).count().where(F.col("count") > HOT).select("slot").collect()]


def relation_counts(t: dict[str, DataFrame], every: DataFrame, hot: list[int] | None = None) -> DataFrame:
    """A row for each relation that is linked or active; ``n`` counts its links of visible chunks."""
    # Hardly any relation recurs in a task's links, so they are dealt before they are counted; hot ones are counted first.
    rows, n = every.where("kind = 'relation'").select("id", "visible"), F.count_if("visible").alias("n")
    seen = (rows.where(~_slot().isin(hot)) if hot else rows).repartition("id").groupBy("id").agg(n)
    if hot:
        seen = seen.unionByName(rows.where(_slot().isin(hot)).groupBy("id").agg(n))
    live = t["relations"].where("is_active").select(F.col("relation_id").cast("string").alias("id"), F.col("source_entity_id").cast("string").alias("source_entity_id"), F.col("target_entity_id").cast("string").alias("target_entity_id"))
    return seen.join(live.withColumn("is_active", F.lit(True)), "id", "full_outer").select(F.lit("relation").alias("kind"), "id", F.coalesce("n", F.lit(0)).alias("n"), F.lit(0).cast("long").alias("ends"), "source_entity_id", "target_entity_id", F.coalesce("is_active", F.lit(False)).alias("is_active"))


def entity_counts(relations: DataFrame, every: DataFrame) -> DataFrame:
    """A row for each entity that is linked or an end of an active one of ``relations``, which are rows of ``relation_counts``."""
    seen = every.where("kind = 'entity'").groupBy("id").agg(F.count_if("visible").alias("n"))
    ends = relations.where("is_active").select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("ends"))
    none = F.lit(None).cast("string")
    return seen.join(ends, "id", "full_outer").select(F.lit("entity").alias("kind"), "id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("ends"), none.alias("source_entity_id"), none.alias("target_entity_id"), F.lit(True).alias("is_active"))


def counts(t: dict[str, DataFrame], every: DataFrame) -> DataFrame:
    """(kind, id, n, ends, source_entity_id, target_entity_id, is_active): ``n`` links of visible chunks, ``ends`` of active relations."""
    rel = relation_counts(t, every)
    return rel.unionByName(entity_counts(rel, every))


def build(t: dict[str, DataFrame], versions: Versions) -> int:
    """Each part is written once and what comes after it reads it from there: links and counts of relations, links and counts of entities."""
    now = _kept(current_chunks(t))
    with tidy(versions.spark, BUCKETS):
        return versions.create_in_turn([
            ("links", link_bucket(), lambda _: links_of("relation", t, now), False),
            ("counts", id_bucket(), lambda done: relation_counts(t, done["links"], hot_slots(done["links"])), True),
            ("links", link_bucket(), lambda _: links_of("entity", t, now), False),
            ("counts", id_bucket(), lambda done: entity_counts(done["counts"], done["links"]), True),
        ])


def _kept(rows: DataFrame) -> DataFrame:
    """``kept``, and the shuffles that made it are dropped."""
    with tidy(rows.sparkSession):
        return kept(rows.select("*"))


def _buckets(rows: DataFrame, bucket: Column) -> list[int]:
    with tidy(rows.sparkSession):
        return sorted(r[0] for r in rows.select(bucket).distinct().collect())  # at most BUCKETS numbers


def removed(versions: Versions, manifest: Manifest, source_ids: DataFrame) -> dict[str, DataFrame]:
    """What goes with the sources: ``chunks`` with links, ``relations``, ``entities`` (ids), and ``counts``: the rows that change, as they will be."""
    hit = _kept(source_ids.select(link_key().alias("source")).distinct())
    own = versions.read("links", manifest=manifest, buckets=_buckets(hit, bucket_of("source")))
    # Compared as the links hold them, which is cheaper than as strings; a string that is no such value's is no source's.
    ids = hit.select(F.col("source").try_cast(own.schema["source_id"].dataType).alias("source_id"), "source").where(link_key() == F.col("source")).select("source_id")
    own = own.join(F.broadcast(ids) if hit.count() <= SMALL else ids, "source_id", "left_semi")  # read once for counts, once for chunks: cheaper than to keep it
    less = _kept(own.groupBy("kind", "id").agg(F.count_if("visible").alias("less")))
    held = versions.read("counts", manifest=manifest, buckets=_buckets(less, id_bucket())).join(less.where("less >= 0"), ["id", "kind"])
    with sifted(versions.spark, less.count()):  # of all counts only those touched are dealt
        held = _kept(held.withColumn("left", F.col("n") - F.col("less")))
    relations = _kept(held.where("kind = 'relation' and is_active and left = 0").select("id", "source_entity_id", "target_entity_id"))
    lost = _kept(relations.select(F.explode(F.array_distinct(F.array("source_entity_id", "target_entity_id"))).alias("id")).groupBy("id").agg(F.count("*").alias("lost")))
    # Ends of removed relations that are mentioned elsewhere change their counts too.
    ends = versions.read("counts", manifest=manifest, buckets=_buckets(lost, id_bucket())).where("kind = 'entity'").join(lost.select("id"), "id", "left_semi") if not lost.isEmpty() else held.select("kind", "id", "n", "ends", "source_entity_id", "target_entity_id", "is_active").where("false")
    ent = ends.unionByName(held.where("kind = 'entity'").select(*ends.columns)).dropDuplicates(["id"]).join(lost, "id", "left").join(less.where("kind = 'entity'").select("id", "less"), "id", "left")
    ent = _kept(ent.select("kind", "id", (F.col("n") - F.coalesce("less", F.lit(0))).alias("n"), (F.col("ends") - F.coalesce("lost", F.lit(0))).alias("ends"), "source_entity_id", "target_entity_id", "is_active", F.col("less").isNotNull().alias("met")))
    rel = held.where("kind = 'relation'").select("kind", "id", F.col("left").alias("n"), "ends", "source_entity_id", "target_entity_id", (F.col("is_active") & (F.col("left") > 0)).alias("is_active"))
    return {
        "chunks": own.select("chunk_id").distinct(), "relations": relations.select(F.col("id").alias("relation_id")),
        "entities": ent.where("met and n = 0 and ends = 0").select(F.col("id").alias("entity_id")), "counts": rel.unionByName(ent.drop("met")), "sources": hit,
    }


def forget(versions: Versions, source_ids: DataFrame, *, tries: int = 5) -> tuple[int, dict[str, DataFrame]]:
    """Commit the forgetting of the sources; returns the new version and what went."""
    gone: dict[str, DataFrame] = {}

    def change(v: Versions, manifest: Manifest) -> Manifest:
        gone.clear()
        gone.update(removed(v, manifest, source_ids))
        at = _buckets(gone["sources"], bucket_of("source"))
        rest = v.read("links", manifest=manifest, buckets=at).join(gone["sources"], link_key() == F.col("source"), "left_anti")
        new = _kept(gone["counts"])
        ids = _buckets(new, id_bucket())
        old = v.read("counts", manifest=manifest, buckets=ids).join(new.select("kind", "id"), ["kind", "id"], "left_anti")
        with tidy(v.spark):
            return {"links": v.write("links", rest, link_bucket(), at), "counts": v.write("counts", old.unionByName(new), id_bucket(), ids)}

    return versions.update(change, tries=tries), gone


def ingest(versions: Versions, items: DataFrame, *, force: bool = False, tries: int = 5) -> tuple[int, DataFrame]:
    """``items`` remembered against the base version and committed with it.

    Sources lie in buckets by dataset and content, so a second writer of the
    same content finds its bucket changed and is judged anew: a duplicate, or
    with ``force`` the next version.
    """
    done: list[DataFrame] = []

    def change(v: Versions, manifest: Manifest) -> Manifest:
        hashed = items.withColumn("content_sha256", F.sha2("text", 256))
        at = sorted(r[0] for r in hashed.select(bucket_of(*content_key())).distinct().collect())
        held = v.read("sources", manifest=manifest, buckets=at)
        out = kept(remembered(items, held, force=force))
        done[:] = [out]
        new = out.where("outcome = 'created'").select("source_id", "dataset_id", "name", "content_sha256", "version", F.lit("pending").alias("status"))
        both = held.unionByName(new.select(*(F.col(f.name).cast(f.dataType) for f in held.schema.fields)))
        if not both.groupBy("dataset_id", "content_sha256", "version").count().where("count > 1").isEmpty():
            raise Conflict("two sources of one dataset, content and version")
        return {"sources": v.write("sources", both, bucket_of(*content_key()), at)}

    return versions.update(change, tries=tries), done[0]
