"""Hybrid search: vectors and words, fused, one hit per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import is_blank
from strataform.operators import fusion, lexical, presentation, vectors
from strataform.operators.chunking import ChunkOptions, chunk_documents
from strataform.operators.embedding import Embedder
from strataform.workspace import staged


@dataclass
class HybridIndex:
    """Chunks with vectors, postings and statistics; written tables or frames."""

    chunks: DataFrame  # chunk_id, doc_id, doc_name, breadcrumbs, text, modified_time, embedding
    words: lexical.LexicalIndex


def build_index(docs: DataFrame, embedder: Embedder = Embedder(), options: ChunkOptions = ChunkOptions()) -> HybridIndex:
    """An index of ``doc_id, doc_name, text, modified_time``, written once: nothing is chunked or embedded again per search."""
    return index_of(staged(embedder.embed(chunk_documents(docs, options).drop("overlap")), "chunks"))


def index_of(chunks: DataFrame) -> HybridIndex:
    """Postings made again from chunks that have their vectors."""
    return HybridIndex(chunks, lexical.build(lexical.lexical_documents(chunks)))


class HybridSearcher:
    def __init__(self, index: HybridIndex, embedder: Embedder = Embedder(), scoring: lexical.Scoring = lexical.Scoring()):
        self.index, self.embedder, self.scoring = index, embedder, scoring

    def semantic(self, queries: DataFrame, depth: int) -> DataFrame:
        stated = self.embedder.embed(queries.where(~is_blank(F.col("text"))).select(F.col("query_id").cast("string").alias("query_id"), "text"))
        rows = self.index.chunks.select(F.col("chunk_id").alias("id"), "embedding")
        return vectors.search(rows, stated, depth)

    def words(self, queries: DataFrame, depth: int) -> DataFrame:
        stated = queries.where(~is_blank(F.col("text"))).select(F.col("query_id").cast("string").alias("query_id"), "text")
        return lexical.search(stated, self.index.words, depth, self.scoring)

    def fused(self, queries: DataFrame, depth: int, recency: bool = True) -> DataFrame:
        newest = fusion.recency_of(self.index.chunks) if recency else None
        return fusion.reciprocal_rank_fusion([self.semantic(queries, depth), self.words(queries, depth)], recency=newest)

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """The k best documents of each query (``query_id, text``); blank queries have none."""
        fused = self.fused(queries, fusion.candidate_depth(k))
        chunks = self.index.chunks.select("chunk_id", "doc_id", "doc_name", "breadcrumbs", "text")
        return fusion.document_hits(fusion.best_chunk_per_document(fused, chunks, k))

    def suggestions(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """``query_id, place, url, line``: what an address bar shows for the k best documents of each query."""
        hits = self.search(queries, k)
        line = presentation.suggestion(F.col("doc_name"), F.col("breadcrumbs"), F.col("snippet"))
        return hits.select("query_id", "place", presentation.document_url(F.col("doc_id")).alias("url"), line.alias("line"))

    def rankings(self, queries: DataFrame, depth: int = 20) -> DataFrame:
        """``mode, query_id, doc_id, rank`` of the three modes, for evaluation; no recency.

        Queries that say the same share one ranking: each distinct question is
        searched once, by vectors and by words, and its hits return to all who
        asked it.
        """
        stated = queries.where(~is_blank(F.col("text"))).select(F.col("query_id").cast("string").alias("query_id"), "text")
        # an id may come with several texts; together they are its question
        asked = stated.groupBy("query_id").agg(F.sort_array(F.collect_list("text")).alias("texts")).withColumn("question", F.to_json("texts"))
        asked = staged(asked, "asked")
        distinct = asked.groupBy("question").agg(F.first("texts").alias("texts")).select(F.col("question").alias("query_id"), F.explode("texts").alias("text"))
        semantic, words = staged(self.semantic(distinct, depth), "semantic-hits"), staged(self.words(distinct, depth), "word-hits")
        modes = {
            "semantic": semantic.withColumnRenamed("rank", "fused_rank"),
            "lexical": words.withColumnRenamed("rank", "fused_rank"),
            "hybrid": fusion.reciprocal_rank_fusion([semantic, words]),
        }
        hits = None
        for mode, found in modes.items():
            one = found.select(F.struct(F.lit(mode).alias("mode"), "query_id").alias("query_id"), "id", "fused_rank")
            hits = one if hits is None else hits.unionByName(one)
        best = fusion.best_chunk_per_document(hits, self.index.chunks.select("chunk_id", "doc_id"), None)
        ranked = best.select("query_id.mode", F.col("query_id.query_id").alias("question"), "doc_id", F.col("place").alias("rank"))
        return asked.select("query_id", "question").join(ranked, "question").select("mode", "query_id", "doc_id", "rank")
