"""Full-text and LIKE search over the entity tables, for one question or many at once."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import contains_like, has_phrase, search_terms, search_tokens

# The columns of each entity that are searched, one at a time, as a phrase never goes over two.
SEARCHED = {"functions": ["name", "purpose", "behavior_summary"], "routes": ["path", "handler_body", "purpose"], "constants": ["name", "value_text"]}


def postings(entity: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """The inverted index (token, field, id, pos)."""
    parts = [entity.select(F.lit(c).alias("field"), F.col(id_col).alias("id"), F.posexplode(search_tokens(F.col(c))).alias("pos", "token")) for c in columns]
    return reduce(DataFrame.unionByName, parts).select("token", "field", "id", "pos")


def document_frequencies(index: DataFrame) -> DataFrame:
    """(token, field, documents, occurrences)."""
    per_id = index.groupBy("token", "field", "id").agg(F.count("*").alias("n"))
    return per_id.groupBy("token", "field").agg(F.count("*").alias("documents"), F.sum("n").alias("occurrences"))


def matches(columns: list[str], terms: list[str]) -> Column:
    """Whether one of the terms' phrases occurs in one of the columns. No phrase matches nothing."""
    phrases = F.transform(search_terms(F.array(*[F.lit(t) for t in terms])), search_tokens)
    tokens = [search_tokens(F.col(c)) for c in columns]
    return reduce(lambda a, b: a | b, [F.exists(phrases, partial(has_phrase, t)) for t in tokens])


def searched(entity: DataFrame, columns: list[str], terms: list[str], limit: int = 10) -> DataFrame:
    """The first `limit` matching rows by id, not by relevance."""
    return entity.where(matches(columns, terms)).orderBy("id").limit(limit)


def _least_ids(hits: DataFrame, key: str, limit: int) -> DataFrame:
    """The rows of the `limit` least ids of each key; partitions drop the rest before anything is shuffled."""
    place = F.dense_rank().over(Window.partitionBy(key).orderBy("id"))
    return hits.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place").distinct()


def phrases_found(index: DataFrame, questions: DataFrame, limit: int = 10) -> DataFrame:
    """(question_id, id, rank) for (question_id, phrase), phrases being token arrays: the least `limit` ids of each question.

    The least ids of all its phrases are among the least ids of each of them, so a frequent word sends few rows on.
    """
    asked = questions.where("size(phrase) > 0").select("question_id", "phrase", F.array_join("phrase", " ").alias("key"))
    parts = asked.select("key", "phrase").distinct().select("key", F.size("phrase").alias("size"), F.posexplode("phrase").alias("off", "token"))
    single = index.join(parts.where("size = 1").select("key", "token"), "token").select("key", "id")
    several = index.join(parts.where("size > 1"), "token").groupBy("key", "size", "field", "id", (F.col("pos") - F.col("off")).alias("start")).agg(F.count("*").alias("n"))
    hits = _least_ids(single, "key", limit).unionByName(_least_ids(several.where("n = size").select("key", "id"), "key", limit))
    found = hits.join(asked.select("question_id", "key").distinct(), "key").select("question_id", "id").distinct()
    w = Window.partitionBy("question_id").orderBy("id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def searched_many(index: DataFrame, questions: DataFrame, limit: int = 10) -> DataFrame:
    """(question_id, id, rank) for many questions of single-token terms, (question_id, token)."""
    return phrases_found(index, questions.select("question_id", F.array("token").alias("phrase")), limit)


def names_like(entity: DataFrame, column: str, questions: DataFrame, limit: int = 5) -> DataFrame:
    """(question_id, id, rank) for (question_id, terms): up to `limit` ids per term, each at its first term, `limit` in all.

    The terms of the questions, a stated set, are held against every row.
    """
    asked = questions.select("question_id", F.posexplode("terms").alias("term_at", "term")).withColumn("term", F.trim(F.replace("term", F.lit('"')))).where("term <> ''")
    terms = asked.select("term").distinct()
    hits = _least_ids(entity.select("id", F.col(column).alias("_text")).join(terms, contains_like(F.col("_text"), F.col("term"))).select("term", "id"), "term", limit)
    first = hits.join(asked, "term").groupBy("question_id", "id").agg(F.min("term_at").alias("term_at"))
    w = Window.partitionBy("question_id").orderBy("term_at", "id")
    return first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("question_id", "id", "rank")


def like_search(entity: DataFrame, columns: list[str], terms: list[str], limit: int = 5) -> DataFrame:
    """Rows that hold a term in one of the columns: up to `limit` per term by id, each row at its first term, `limit` in all."""
    order = F.posexplode(F.array(*[F.lit(t.replace('"', "")) for t in terms])).alias("term_at", "term")
    rows = entity.select("*", order)
    hit = rows.where(reduce(lambda a, b: a | b, [contains_like(F.col(c), F.col("term")) for c in columns]))
    per_term = hit.withColumn("_n", F.row_number().over(Window.partitionBy("term_at").orderBy("id"))).where(F.col("_n") <= limit)
    first = per_term.groupBy("id").agg(F.min("term_at").alias("term_at"))
    return first.orderBy("term_at", "id").limit(limit)


def routes_like(routes: DataFrame, path: str | None, method: str | None) -> DataFrame:
    """Routes whose path holds the text; the method only counts together with a path."""
    if path is None:
        return routes
    found = routes.where(contains_like(F.col("path"), F.lit(path)))
    return found if method is None else found.where(F.upper("method") == method.upper())
