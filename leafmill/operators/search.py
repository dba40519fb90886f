"""Lexical, vector and hybrid search over chunks, and how hits become documents.

Scores are this engine's own: BM25 per field with k1 = 1.2 and b = 0.75, summed with the fields'
boosts; the counts are over chunks. An index of postings is built once and kept; a query reads the
postings of its terms, so its work follows the matches, not the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import cosine
from ..functions.text import query_terms, tokens

#: Hits of a search, least cosine, boosts. K1 and B are this engine's own.
K1, B, LIMIT, SIMILARITY = 1.2, 0.75, 100, 0.18
BOOSTS = {"title": 3.0, "url": 2.0, "content": 1.0}


def terms_of(query: str) -> Column:
    """The query's terms, lower-cased and distinct."""
    return F.array_distinct(F.transform(query_terms(F.lit(query)), F.lower))


def _near(term: Column, wanted: Column, tolerance: int) -> Column:
    """Whether a token is a term, or within so many edits of one."""
    if not tolerance:
        return F.array_contains(wanted, term)
    close = lambda q: (F.abs(F.length(q) - F.length(term)) <= tolerance) & (F.levenshtein(q, term, tolerance) >= 0)
    return F.exists(wanted, close)


def _scored(met: DataFrame) -> DataFrame:
    """Key columns and score of rows with a struct key, boost, tf, df, len and the field's n and mean."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("boost") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    return met.groupBy("key").agg(F.sum(part).alias("score")).select("key.*", "score")


def bm25(chunks: DataFrame, query: str, key: list[str], tolerance: int = 0, boosts: dict[str, float] | None = None) -> DataFrame:
    """key columns and score of every chunk that matches, without an index: each call tokenises all chunks, three times."""
    boosts = {c: w for c, w in (boosts or BOOSTS).items() if c in chunks.columns}
    wanted = terms_of(query)
    fields = F.array(*(F.struct(F.lit(c).alias("field"), F.lit(w).alias("boost"), tokens(c).alias("tokens")) for c, w in boosts.items()))
    split = chunks.select(F.struct(*key).alias("key"), F.explode(fields).alias("f")).select("key", "f.field", "f.boost", "f.tokens")
    lengths = split.groupBy("field").agg(F.count("*").alias("n"), F.avg(F.size("tokens")).alias("mean"))
    hits = split.select("key", "field", "boost", F.size("tokens").alias("len"), F.explode(F.filter("tokens", lambda t: _near(t, wanted, tolerance))).alias("term"))
    tf = hits.groupBy("key", "field", "boost", "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("field", "term").agg(F.count("*").alias("df"))
    met = tf.join(df, ["field", "term"]).join(F.broadcast(lengths), "field")  # lengths: a row per field
    return _scored(met)


class Index(NamedTuple):
    """A kept index. postings: size, term, key, field, len, tf; vocabulary: size, term, field, df; fields: field, n, mean.
    ``size`` is the term's length; the first two are sorted by size and term, so that a query's literals prune row groups."""

    postings: DataFrame
    vocabulary: DataFrame
    fields: DataFrame


def build_index(chunks: DataFrame, key: list[str], path: str, fields: tuple[str, ...] = tuple(BOOSTS)) -> Index:
    """Write the index of the chunks below ``path``; ``fields`` comes last and marks it whole.

    The texts are tokenised once. A term of very many chunks spreads over several range partitions, since the key is part
    of their order. Chunks without words count for the mean length; an empty table gives an index that nothing matches.
    """
    each = F.array(*(F.struct(F.lit(c).alias("field"), tokens(c).alias("tokens")) for c in fields if c in chunks.columns))
    split = chunks.select(F.struct(*key).alias("key"), F.explode(each).alias("f"))
    words = split.select("key", "f.field", F.size("f.tokens").alias("len"), F.explode("f.tokens").alias("term"))
    found = words.groupBy("key", "field", "len", "term").agg(F.count("*").alias("tf")).withColumn("size", F.length("term"))
    order = ("size", "term", "key")
    found.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/postings")
    kept = chunks.sparkSession.read.parquet(f"{path}/postings")
    vocabulary = kept.groupBy("size", "term", "field").agg(F.count("*").alias("df"))
    vocabulary.repartitionByRange("size", "term").sortWithinPartitions("size", "term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    n = F.lit(chunks.count())
    totals = kept.groupBy("field").agg(F.sum("tf").alias("total"))
    totals.select("field", n.alias("n"), (F.col("total") / n).alias("mean")).write.mode("overwrite").parquet(f"{path}/fields")
    return open_index(chunks.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in Index._fields))


def search_index(index: Index, query: str, tolerance: int = 0, boosts: dict[str, float] | None = None) -> DataFrame:
    """``bm25`` over a kept index: key columns and score. Only postings of the query's terms, or of terms of nearly their
    lengths, are read; no text is."""
    boosts = boosts or BOOSTS
    wanted = index.fields.sparkSession.range(1).select(terms_of(query)).first()[0]
    if not wanted:
        at = near = F.lit(False)
    elif not tolerance:
        at = near = F.col("term").isin(wanted)
    else:
        sizes = [len(t) for t in wanted]
        at = F.col("size").between(min(sizes) - tolerance, max(sizes) + tolerance)
        near = at & _near(F.col("term"), F.array(*map(F.lit, wanted)), tolerance)
    boost = F.coalesce(*(F.when(F.col("field") == c, w) for c, w in boosts.items()))
    stats = index.fields.select("field", "n", "mean", boost.alias("boost")).filter("boost is not null")
    met = index.postings.filter(at).join(index.vocabulary.filter(near), ["size", "term", "field"])
    return _scored(met.join(F.broadcast(stats), "field"))  # stats: a row per field


def top_hits(scored: DataFrame, key: list[str], limit: int = LIMIT) -> DataFrame:
    """The best chunks, before they are grouped by document; ties by key."""
    return scored.orderBy(F.round("score", 9).desc(), *key).limit(limit)


def best_per_document(hits: DataFrame, doc: str = "doc_id", idx: str = "idx") -> DataFrame:
    """The best hit of each document, the first of equals; combined in each task before the exchange."""
    rest = [c for c in hits.columns if c != doc]
    best = F.min_by(F.struct(*rest), F.struct((-F.round("score", 9)).alias("s"), F.col(idx).alias("i")))
    return hits.groupBy(doc).agg(best.alias("_best")).select(doc, "_best.*")


def vector_scores(chunks: DataFrame, query: list[float], key: list[str], vector: str = "vector", least: float = SIMILARITY) -> DataFrame:
    """Cosine to the query of every chunk that reaches the threshold; vectors of unit length."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return chunks.select(*key, cosine(F.col(vector).cast("array<double>"), q).alias("score")).filter(F.col("score") >= least)


def hybrid_scores(lexical: DataFrame, semantic: DataFrame, key: list[str]) -> DataFrame:
    """Half the lexical score over its maximum, half the cosine; a chunk needs one of them."""
    most = lexical.agg(F.max("score").alias("_most"))
    a = lexical.select(*key, F.col("score").alias("_l")).crossJoin(F.broadcast(most))  # one row
    b = semantic.select(*key, F.col("score").alias("_v"))
    share = F.coalesce(F.col("_l") / F.col("_most"), F.lit(0.0))
    return a.join(b, key, "full").select(*key, (0.5 * share + 0.5 * F.coalesce("_v", F.lit(0.0))).alias("score")).filter("score > 0")


def display_hits(hybrid_best: DataFrame, lexical_best: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Documents in hybrid rank; where the lexical search also hit, its hit is shown; semantic_only marks the others."""
    lex = lexical_best.select(F.col(doc).alias("_d"), F.struct(*(c for c in lexical_best.columns if c != doc)).alias("_lex"))
    met = hybrid_best.join(lex, F.col(doc) == F.col("_d"), "left")
    shown = [F.when(F.col("_lex").isNotNull(), F.col(f"_lex.{c}")).otherwise(F.col(c)).alias(f"shown_{c}") for c in hybrid_best.columns if c != doc and c in lexical_best.columns]
    return met.select(doc, F.col("score").alias("rank_score"), *shown, F.col("_lex").isNull().alias("semantic_only"))


def match_reason(semantic_only: Column, title: Column, url: Column, content: Column, terms: Column) -> Column:
    from ..functions.text import includes_any

    return F.when(semantic_only, "Semantic passage").when(includes_any(title, terms), "Title match").when(includes_any(url, terms), "Address match").when(includes_any(content, terms), "Passage match").otherwise("Related passage")
