"""A stored inverted index of chunks, read by lexeme and left by rank bounds.

Chunks are numbered in order of their id; ``BLOCK`` neighbours are a block, the
same for all lexemes. The index has a row for each lexeme and block: the chunk
ids with the positions of the lexeme, and its most occurrences in one chunk; a
block that lies in two Arrow batches has a row of either, with other chunks.
Rows lie in ``BUCKETS`` folders by lexeme, sorted by lexeme inside, so a query
reads the folders and row groups of its own words.

A cover of a query's words ends at an occurrence of one of them and counts at
most ``WEIGHT``, so the rank of a chunk is at most ``WEIGHT`` times the sum of
the most occurrences of its block. Ranks of the blocks with the best bounds
give a k-th rank that the answer reaches at least; positions are then read
only in blocks whose bound reaches it. The result is exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lexical import POSITION_LIMIT, WEIGHT, Query, cover_rank, matches, tokens

BUCKETS, BLOCK = 64, 128
SLICES = 4  # parts that the rows of a bucket are dealt in
FIRST = 48  # blocks ranked for the first k-th rank
PLACES = 9  # decimals of a rank; ties beyond are broken by id


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lexeme, block, posts, most) of each batch of (chunk_id, block, words): one stable sort of the word places, cut where lexeme, block or chunk changes."""
    for batch in batches:
        flat = pc.list_flatten(batch["words"]).dictionary_encode()
        n = len(flat)
        if not n:
            continue
        row = pc.list_parent_indices(batch["words"]).to_numpy()
        begins = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(n) - np.repeat(begins, np.diff(begins, append=n)) + 1
        blocks, at = np.unique(batch["block"].to_numpy(), return_inverse=True)
        code = flat.indices.to_numpy().astype(np.int64)
        key = at[row] * np.int64(len(flat.dictionary)) + code
        order = np.argsort(key, kind="stable")
        key, row, place = key[order], row[order], place[order]
        new = np.diff(key, prepend=-1) != 0
        entry = np.flatnonzero(new | (np.diff(row, prepend=-1) != 0))
        post = np.flatnonzero(new[entry])
        positions = pa.ListArray.from_arrays(pa.array(np.append(entry, n), pa.int32()), pa.array(np.minimum(place, POSITION_LIMIT), pa.int32()))
        held = pa.StructArray.from_arrays([batch["chunk_id"].take(pa.array(row[entry])), positions], ["chunk_id", "positions"])
        most = np.maximum.reduceat(np.diff(entry, append=n), post)
        of, word = np.divmod(key[entry[post]], len(flat.dictionary))
        lists = pa.ListArray.from_arrays(pa.array(np.append(post, len(entry)), pa.int32()), held)
        yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(word)), pa.array(blocks[of], pa.int64()), lists, pa.array(most, pa.int32())], ["lexeme", "block", "posts", "most"])


@dataclass
class LexicalIndex:
    spark: SparkSession
    path: str

    @classmethod
    def build(cls, chunks: DataFrame, path: str, *, buckets: int = BUCKETS, block: int = BLOCK) -> LexicalIndex:
        """Write the index of ``chunks(chunk_id, text)``; one shuffle by range, one of the finished rows by bucket."""
        spark = chunks.sparkSession
        number = F.shiftright(F.monotonically_increasing_id(), block.bit_length() - 1)
        rows = chunks.select("chunk_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
        rows.select("chunk_id", number.alias("block"), "text").write.parquet(f"{path}/chunks")
        rows = spark.read.parquet(f"{path}/chunks")
        kind = rows.schema["chunk_id"].dataType.simpleString()
        posts = rows.select("chunk_id", "block", tokens(F.col("text")).alias("words")).mapInArrow(_postings, f"lexeme string, block long, posts array<struct<chunk_id:{kind},positions:array<int>>>, most int")
        posts = posts.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(buckets)).cast("int"))
        run = F.pmod(F.xxhash64(F.shiftright("block", 12)), F.lit(SLICES))
        posts.repartition("bucket", run).sortWithinPartitions("bucket", "lexeme", "block").write.partitionBy("bucket").parquet(f"{path}/postings")
        spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/meta")
        return cls(spark, path)

    @property
    def chunks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/chunks").select("chunk_id", "block")

    @functools.cached_property
    def every_posting(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @functools.cached_property
    def buckets(self) -> int:
        return self.spark.read.parquet(f"{self.path}/meta").first()[0]

    def postings(self, words: list[str]) -> DataFrame:
        """Rows of the words: folders by their buckets, row groups by the lexeme."""
        at = {xxhash.xxh64_intdigest(w.encode(), seed=42) for w in words}  # as Spark's xxhash64, which is signed
        at = sorted({(h - (1 << 64) if h >> 63 else h) % self.buckets for h in at})
        return self.every_posting.where(F.col("bucket").isin(at) & F.col("lexeme").isin(words))

    def bounds(self, query: Query) -> DataFrame:
        """(block, bound) of blocks that may hold a match; positions are not read."""
        words = query.words
        branches = [list(dict.fromkeys(w for t in b if not t.negated for w in t.words)) for b in query.branches]
        held = self.postings(words).groupBy("block").agg(*(F.max(F.when(F.col("lexeme") == w, F.col("most"))).alias(f"w{i}") for i, w in enumerate(words)))
        sums = [sum((F.col(f"w{words.index(w)}") for w in b), F.lit(0)) for b in branches]  # null where a word of the branch is absent
        best = F.greatest(*sums, F.lit(None).cast("int")) if len(sums) > 1 else sums[0]
        return held.select("block", (best * F.lit(WEIGHT)).alias("bound")).where("bound is not null")

    def ranked(self, query: Query, blocks: DataFrame | Column | None = None, *, rank=None) -> DataFrame:
        """(chunk_id, rank_score) of all matches, or of those in ``blocks``."""
        every = list(dict.fromkeys(w for b in query.branches for t in b for w in t.words))
        posts = self.postings(every)
        if isinstance(blocks, DataFrame):
            posts = posts.join(blocks.select("block"), "block", "left_semi")
        elif blocks is not None:
            posts = posts.where(blocks)
        posts = posts.select("lexeme", F.explode("posts").alias("p")).select("lexeme", "p.chunk_id", "p.positions")
        vectors = posts.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("lexeme", "positions"))).alias("v"))
        if any(all(t.negated for t in b) for b in query.branches):  # such a branch matches chunks that have none of the words
            own = self.chunks if not isinstance(blocks, DataFrame) else self.chunks.join(blocks.select("block"), "block", "left_semi")
            none = F.create_map().cast("map<string,array<int>>")
            vectors = own.select("chunk_id").join(vectors, "chunk_id", "left").select("chunk_id", F.coalesce("v", none).alias("v"))
        found = vectors.where(matches(F.col("v"), query))
        score = cover_rank(query)(F.map_entries(F.col("v"))) if rank is None else rank(F.col("v"), query)
        return found.select("chunk_id", F.round(score, PLACES).alias("rank_score"))

    def top_k(self, query: Query, k: int, *, within: DataFrame | None = None, first: int = FIRST) -> DataFrame:
        """(chunk_id, rank_score): the k best matches by cover density, ties by id; ``within``: chunk ids that may be found."""
        only = (lambda rows: rows) if within is None else (lambda rows: rows.join(within.select("chunk_id").distinct(), "chunk_id", "left_semi"))
        if not query.branches:
            return self.ranked(query).limit(0) if query.words else self.chunks.select("chunk_id", F.lit(0.0).alias("rank_score")).limit(0)
        if any(all(t.negated for t in b) for b in query.branches):
            return only(self.ranked(query)).orderBy(F.desc("rank_score"), "chunk_id").limit(k)
        bounds = self.bounds(query)
        best = [r.block for r in bounds.orderBy(F.desc("bound"), "block").limit(first).collect()]
        # Most words of a query are few, and its first blocks are few, so this is a small job.
        head = only(self.ranked(query, F.col("block").isin(best))).orderBy(F.desc("rank_score"), "chunk_id").limit(k).select("rank_score").collect()
        least = head[-1].rank_score if len(head) == k else 0.0
        rest = bounds.where(F.col("bound") >= least - 10.0**-PLACES)
        return only(self.ranked(query, rest)).orderBy(F.desc("rank_score"), "chunk_id").limit(k)
