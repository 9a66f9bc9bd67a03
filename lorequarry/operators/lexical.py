"""Term tables and BM25 ranking.

The index is four tables: postings (term, id, tf), lengths (id, dl), document frequencies (term, df) and one row of
corpus figures (documents, average length).  Scores are kept in double; ties go to the smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.functions.text import terms
from lorequarry.session import cut

K1, B = 1.2, 0.75  # fixed values of the ranking formula


@dataclass
class LexicalIndex:
    """Snapshot tables of an index."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame
    figures: DataFrame


def term_frequencies(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf)."""
    words = texts.select(F.col(id_col).alias("id"), F.explode(terms(F.col(text_col))).alias("term"))
    return words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def build_index(chunks: DataFrame, id_col: str, text_col: str, document_col: str | None = None) -> LexicalIndex:
    """An index over chunks; document frequencies and the number of documents count distinct ``document_col``.

    Chunks without terms, or without text, count for the average length.  Without a document column each chunk is a document.
    """
    document = F.col(document_col or id_col)
    of = chunks.select(F.col(id_col).alias("id"), document.alias("document"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    postings = of.select("id", "document", F.explode("words").alias("term")).groupBy("term", "id", "document").agg(F.count(F.lit(1)).alias("tf"))
    lengths = of.select("id", F.size("words").cast("long").alias("dl"))
    frequencies = postings.groupBy("term").agg(F.countDistinct("document").alias("df"))
    figures = of.agg(F.countDistinct("document").alias("documents"), F.avg(F.size("words")).alias("average"))
    return LexicalIndex(postings.drop("document"), lengths, frequencies, figures)


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)


def bm25(index: LexicalIndex, queries: DataFrame, query_col: str = "query", key: str | None = None, small_rows: int = 1_000_000) -> DataFrame:
    """(id, score) of a one-row query table, or (key, id, score) of many; terms that the index lacks are skipped.

    The terms of many queries are counted, and broadcast only where they are at most ``small_rows``.
    """
    keys = [key] if key else []
    asked = queries.select(*keys, F.explode(terms(F.col(query_col))).alias("term")).groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("qtf"))
    small = key is None or asked.count() <= small_rows
    hits = index.postings.join(F.broadcast(asked) if small else asked, "term").join(index.frequencies, "term").join(index.lengths, "id").crossJoin(F.broadcast(index.figures))  # figures: one row
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
    part = idf(F.col("documents"), F.col("df")) * norm * F.col("qtf")
    return hits.where("average > 0").groupBy(*keys, "id").agg(F.sum(part).alias("score"))


def search(chunks: DataFrame, query: DataFrame, id_col: str = "doc_id", text_col: str = "text", document_col: str | None = None, query_col: str = "query") -> DataFrame:
    """(id, score): BM25 of a one-row query table over chunks that have no index, the same scores as ``bm25`` gives.

    Texts are read and tokenised once, where they stand: ids, lengths and the query's own terms are kept in a checkpoint, and
    figures, document frequencies and scores come from there.  Nothing of the size of the corpus is shuffled.
    """
    asked = query.select(terms(F.col(query_col)).alias("__asked"))  # one row
    document = F.col(document_col or id_col)
    of = chunks.select(F.col(id_col).alias("id"), document.alias("document"), terms(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    own = F.filter("words", lambda w: F.array_contains(F.col("__asked"), w))
    read = cut(of.crossJoin(F.broadcast(asked)).select("id", "document", F.size("words").alias("dl"), F.when(F.size(own) > 0, own).alias("met")))
    figures = read.agg((F.count_distinct("document") if document_col else F.count("document")).alias("documents"), F.avg("dl").alias("average"))
    met = read.where("met is not null").crossJoin(F.broadcast(asked))
    tf = lambda t: F.size(F.filter("met", lambda w: w == t))
    each = met.select("id", "document", "dl", F.explode(F.transform(F.array_distinct("met"), lambda t: F.struct(t.alias("term"), tf(t).alias("tf"), F.size(F.filter("__asked", lambda w: w == t)).alias("qtf")))).alias("m")).select("id", "document", "dl", "m.*")
    frequencies = each.groupBy("term").agg(F.count_distinct("document").alias("df"))  # a row for each term of the query
    hits = each.join(F.broadcast(frequencies), "term").crossJoin(F.broadcast(figures))
    norm = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("average")))
    return hits.where("average > 0").groupBy("id").agg(F.sum(idf(F.col("documents"), F.col("df")) * norm * F.col("qtf")).alias("score"))


def save_index(index: LexicalIndex, folder: str) -> None:
    """Writes the tables of an index; postings are cut and sorted by term, so a search reads the row groups of its terms only."""
    index.postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/postings")
    for name in ("lengths", "frequencies", "figures"):
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("postings", "lengths", "frequencies", "figures")])


def search_index(index: LexicalIndex, query: str) -> DataFrame:
    """(id, score) of one query by a stored index: the terms of the query are pushed down to the scan of the postings."""
    spark = index.postings.sparkSession
    asked = spark.createDataFrame([(query,)], "query string")
    words = [r.term for r in asked.select(F.explode(F.array_distinct(terms(F.col("query")))).alias("term")).collect()]  # those of one query
    own = LexicalIndex(index.postings.where(F.col("term").isin(words)), index.lengths, index.frequencies.where(F.col("term").isin(words)), index.figures)
    return bm25(own, asked)


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n best (id, score) with rank; ties by id."""
    from pyspark.sql import Window

    best = scores.orderBy(F.desc("score"), "id").limit(n)  # at most n rows are ranked
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def apply_delta(counts: DataFrame, texts: DataFrame, id_col: str, text_col: str, sign_col: str) -> DataFrame:
    """(term, df) after texts were added (sign 1) or removed (sign -1); terms that no text holds any more go."""
    words = texts.select(F.col(sign_col).cast("long").alias("n"), F.explode(F.array_distinct(terms(F.col(text_col)))).alias("term"))
    delta = words.groupBy("term").agg(F.sum("n").alias("df"))
    return counts.select("term", "df").unionByName(delta).groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
