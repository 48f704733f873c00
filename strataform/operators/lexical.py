"""Field-weighted full-text search over tables of postings.

Score of a chunk: over the query's terms and their expansions, the sum over
fields of ``boost · idf · (delta + tf·(k1+1) / (tf + k1·(1 - b + b·len/avglen)))``.
A vocabulary term is reached exactly, by prefix, or within an edit distance of
a fifth of the query term's length; it takes the best of its routes.

Prefixes and near words are found by equi-joins on keys, not by comparing
every query term with the whole vocabulary: prefixes on the first n letters,
where n is a length some query term has, near words on pieces, since a word
within distance d of a term holds one of its d+1 pieces, shifted by at most d.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions.text import tokens
from strataform.operators.vectors import top
from strataform.workspace import spread, staged

SEPARATOR = " › "
#: Weights of the fields.
BOOSTS = {"title": 3.0, "breadcrumbs": 2.0, "text": 1.0}


#: Up to so many terms are named in a filter, of the files' postings or of words that begin with them; beyond, a join picks the postings.
NAMED_TERMS = 2000
#: Weights (query, term, field; about 60 bytes) that are broadcast to the postings; more are joined by a shuffle.
BROADCAST_WEIGHTS = 100_000


@dataclass(frozen=True)
class Scoring:
    boosts: dict[str, float] = field(default_factory=lambda: dict(BOOSTS))
    k1: float = 1.2
    b: float = 0.7
    delta: float = 0.5
    fuzzy: float = 0.2
    prefix_weight: float = 0.375
    fuzzy_weight: float = 0.45


def lexical_documents(chunks: DataFrame) -> DataFrame:
    """``chunk_id, text, title, breadcrumbs`` as they are indexed."""
    return chunks.select("chunk_id", "text", F.col("doc_name").alias("title"), F.array_join("breadcrumbs", SEPARATOR).alias("breadcrumbs"))


def postings(docs: DataFrame, fields: tuple[str, ...] = ("text", "title", "breadcrumbs")) -> DataFrame:
    """``term, field, chunk_id, tf, len``, one row for each term of a field.

    Null fields have no terms.  The field's length travels with the posting, so
    that scoring needs no further join.
    """
    # stack, not a union: the documents are read once
    stacked = spread(docs).select("chunk_id", F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") as (field, body)"))
    words = stacked.where("body is not null").withColumn("words", tokens(F.col("body")))
    return words.select("chunk_id", "field", F.size("words").alias("len"), F.explode("words").alias("term")).groupBy("term", "field", "chunk_id").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def first_words(queries: DataFrame) -> list[str] | None:
    """The distinct words of some queries (``text``), in order, without those that begin with another; None if they are too many to be named."""
    words = queries.select(F.explode(tokens(F.col("text"))).alias("q")).distinct().limit(NAMED_TERMS + 1).collect()
    if len(words) > NAMED_TERMS:
        return None
    out: list[str] = []
    for word in sorted(r["q"] for r in words):
        if not out or not word.startswith(out[-1]):
            out.append(word)
    return out


def _begins(term: Column, words: list[str], head: int = 3) -> Column:
    """Whether a term begins with one of some words.  Most terms are told by their first letters."""
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    one = lambda n: F.substring(term, 1, n).isin(by_length[n])
    any_of = lambda conditions: reduce(Column.__or__, conditions, F.lit(False))
    short, long = (any_of(one(n) for n in sorted(by_length) if (n > head) == side) for side in (False, True))
    return short | (F.substring(term, 1, head).isin(sorted({w[:head] for w in words if len(w) > head})) & long)


def postings_for(docs: DataFrame, begins: list[str], fields: tuple[str, ...] = ("text", "title", "breadcrumbs")) -> DataFrame:
    """The postings of all terms that begin with one of some words, and one of the term ``''`` for each field of a document.

    The latter's ``tf`` is the field's length.  Words are picked and counted in
    their row, so that only postings are shuffled, not every word.
    """
    stacked = spread(docs).select("chunk_id", F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") as (field, body)"))
    words = stacked.where("body is not null").select("chunk_id", "field", tokens(F.col("body")).alias("words"))
    kept = words.select("chunk_id", "field", F.size("words").alias("len"), F.filter("words", lambda w: _begins(w, begins)).alias("kept"))
    each = kept.select("*", F.explode(F.array_append(F.array_distinct("kept"), F.lit(""))).alias("term"))
    count = F.when(F.col("term") == "", F.col("len")).otherwise(F.size("kept") - F.size(F.array_remove("kept", F.col("term"))))
    # by chunk alone: what a search adds up for a chunk lies in one file
    return each.select("term", "field", "chunk_id", count.alias("tf"), "len").repartition("chunk_id").groupBy("term", "field", "chunk_id").agg(F.sum("tf").alias("tf"), F.first("len").alias("len"))


def statistics(docs: DataFrame, fields: tuple[str, ...] = ("text", "title", "breadcrumbs")) -> DataFrame:
    """``field, n, avglen``: documents and mean length, one row per field."""
    stacked = docs.select(F.expr(f"stack({len(fields)}, " + ", ".join(f"'{f}', `{f}`" for f in fields) + ") as (field, body)"))
    n = F.count("*")
    return stacked.groupBy("field").agg(n.alias("n"), (F.sum(F.coalesce(F.size(tokens(F.col("body"))), F.lit(0))) / n).alias("avglen"))


@dataclass
class LexicalIndex:
    """Written tables: postings in order of their terms, the vocabulary with document counts, and statistics."""

    postings: DataFrame  # term, field, chunk_id, tf, len
    vocabulary: DataFrame  # term, field, df
    statistics: DataFrame


def build(docs: DataFrame, fields: tuple[str, ...] = ("text", "title", "breadcrumbs")) -> LexicalIndex:
    """An index written once: searches read only what their terms need.

    Postings stay where their aggregation put them, spread by term and chunk,
    so that a term most chunks hold lies in all files.  Each file is in order
    of terms: a filter on terms skips the row groups and pages without them.
    """
    posted = staged(postings(docs, fields).sortWithinPartitions("term", "chunk_id"), "postings")
    words = staged(posted.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), "vocabulary")
    # the statistics follow from the postings: no text is read again
    n = docs.count()
    stats = words.groupBy("field").agg(F.lit(n).cast("long").alias("n"), (F.sum("total") / n).alias("avglen"))
    return LexicalIndex(posted, words.drop("total"), staged(stats, "statistics"))


def build_for(docs: DataFrame, begins: list[str], fields: tuple[str, ...] = ("text", "title", "breadcrumbs")) -> LexicalIndex:
    """An index for queries known beforehand, of the terms that begin with their :func:`first_words`.

    All documents are read and count in the statistics.  It answers these
    queries as the whole index does, with prefixes but not with near words.
    """
    posted = staged(postings_for(docs, begins, fields), "postings")  # all are read, so they need no order
    words = staged(posted.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("total")), "vocabulary")
    n = docs.count()
    stats = words.where("term = ''").select("field", F.lit(n).cast("long").alias("n"), (F.col("total") / n).alias("avglen"))
    return LexicalIndex(posted.where("term <> ''"), words.where("term <> ''").drop("total"), staged(stats, "statistics"))


def remove_documents(posted: DataFrame, ids: DataFrame) -> DataFrame:
    """Postings without some chunks; absent ids change nothing."""
    return posted.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def without(index: LexicalIndex, ids: DataFrame, stats: DataFrame) -> LexicalIndex:
    """The index without some chunks; ``stats`` are those of the chunks that stay."""
    posted = remove_documents(index.postings, ids)
    return LexicalIndex(posted, posted.groupBy("term", "field").agg(F.count("*").alias("df")), stats)


def query_terms(queries: DataFrame) -> DataFrame:
    """``query_id, q`` of the distinct words of each query; a blank one has none."""
    return queries.select("query_id", F.explode(tokens(F.col("text"))).alias("q")).distinct()


def expansions(terms: DataFrame, vocabulary: DataFrame, scoring: Scoring = Scoring(), prefix: bool = True) -> DataFrame:
    """``q, term, weight`` for the vocabulary terms each query term reaches."""
    wanted = terms.select("q").distinct().withColumn("budget", F.floor(F.length("q") * scoring.fuzzy + 0.5).cast("int"))
    exact = wanted.join(vocabulary, wanted["q"] == vocabulary["term"]).select("q", "term", F.lit(1.0).alias("weight"))
    found = exact
    if prefix:
        lengths = wanted.select(F.length("q").alias("n")).distinct()
        # lengths of words are few, whatever the number of terms
        heads = vocabulary.join(F.broadcast(lengths), F.length("term") > F.col("n")).select("term", F.substring("term", F.lit(1), F.col("n")).alias("head"))
        extra = F.length("term") - F.length("q")
        found = found.unionByName(wanted.join(heads, wanted["q"] == heads["head"]).select("q", "term", (scoring.prefix_weight * F.length("term") / (F.length("term") + 0.3 * extra)).alias("weight")))
    if scoring.fuzzy > 0:
        found = found.unionByName(_near(wanted, vocabulary, scoring))
    return found.groupBy("q", "term").agg(F.max("weight").alias("weight"))


def _near(wanted: DataFrame, vocabulary: DataFrame, scoring: Scoring) -> DataFrame:
    count = F.col("budget") + 1
    start = lambda i: F.floor(F.length("q") * i / count).cast("int")
    pieces = wanted.where("budget > 0").select("q", "budget", F.explode(F.sequence(F.lit(0), F.col("budget"))).alias("i"))
    pieces = pieces.select("q", "budget", start(F.col("i")).alias("at"), (start(F.col("i") + 1) - start(F.col("i"))).alias("n"))
    pieces = pieces.select("q", "budget", "at", F.substring("q", F.col("at") + 1, F.col("n")).alias("piece"))
    sizes = pieces.select(F.length("piece").alias("n")).distinct()
    # every place of a vocabulary term at which a piece of such a length can stand
    words = vocabulary.join(F.broadcast(sizes), F.length("term") >= F.col("n")).select("term", "n", F.explode(F.sequence(F.lit(0), F.length("term") - F.col("n"))).alias("place"))
    words = words.select("term", "place", F.substring("term", F.col("place") + 1, F.col("n")).alias("piece"))
    near = pieces.join(words, "piece").where((F.abs(F.col("place") - F.col("at")) <= F.col("budget")) & (F.abs(F.length("term") - F.length("q")) <= F.col("budget")) & (F.col("term") != F.col("q")))
    near = near.select("q", "term", "budget").distinct().withColumn("d", F.levenshtein("term", "q"))
    return near.where(F.col("d") <= F.col("budget")).select("q", "term", (scoring.fuzzy_weight * F.length("term") / (F.length("term") + F.col("d"))).alias("weight"))


def scores(terms: DataFrame, index: LexicalIndex, scoring: Scoring = Scoring(), expand: bool = True) -> DataFrame:
    """``query_id, chunk_id, score`` of all chunks that hold a reached term."""
    if expand:
        reached = expansions(terms, index.vocabulary.select("term").distinct(), scoring)
    else:
        reached = terms.select("q").distinct().select("q", F.col("q").alias("term"), F.lit(1.0).alias("weight"))
    best = terms.join(reached, "q").groupBy("query_id", "term").agg(F.max("weight").alias("weight"))
    boost = F.lit(0.0)
    for name, value in scoring.boosts.items():
        boost = F.when(F.col("field") == name, value).otherwise(boost)
    # stats has one row per field
    weighted = best.join(index.vocabulary, "term").join(F.broadcast(index.statistics), "field")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = staged(weighted.select("query_id", "term", "field", "avglen", (F.col("weight") * boost * idf).alias("factor")), "weights")
    names = [r["term"] for r in weighted.select("term").distinct().limit(NAMED_TERMS + 1).collect()]
    if len(names) <= NAMED_TERMS:  # told by a count: then the filter names them, and files without them aren't read
        posted = index.postings.where(F.col("term").isin(names)) if names else index.postings.limit(0)
        weighted = F.broadcast(weighted) if weighted.limit(BROADCAST_WEIGHTS + 1).count() <= BROADCAST_WEIGHTS else weighted
    else:
        posted = index.postings
    tf, k1, b = F.col("tf"), scoring.k1, scoring.b
    gain = scoring.delta + tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("avglen")))
    return posted.join(weighted, ["term", "field"]).groupBy("query_id", "chunk_id").agg(F.sum(F.col("factor") * gain).alias("score"))


def search(queries: DataFrame, index: LexicalIndex, k: int, scoring: Scoring = Scoring(), expand: bool = True) -> DataFrame:
    """``query_id, id, score, rank``: the k best chunks of each query (``query_id, text``)."""
    hits = scores(query_terms(queries), index, scoring, expand).select("query_id", F.col("chunk_id").alias("id"), "score")
    return top(hits, k, "query_id", F.round("score", 9), F.col("id"))


def vocabulary_size(posted: DataFrame) -> DataFrame:
    return posted.agg(F.countDistinct("term").alias("terms"), F.countDistinct("chunk_id").alias("chunks"))


__all__ = ["BOOSTS", "LexicalIndex", "Scoring", "build", "build_for", "expansions", "first_words", "lexical_documents", "postings", "postings_for", "query_terms", "remove_documents", "scores", "search", "statistics", "vocabulary_size"]
