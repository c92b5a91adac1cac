"""Providers by rule, for runs without a model: repeatable, and columns throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import approx_tokens, normal_phrase

#: A question of more words is taken for one of several parts.
LONG_QUESTION = 30
#: The longest phrase that is recognised in a question, in words.
PHRASE_WORDS = 8


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def classify(queries: DataFrame) -> DataFrame:
    """Long questions are complex."""
    route = F.when(F.size(words(F.col("query"))) > LONG_QUESTION, "complex").otherwise("simple")
    return queries.select("query_id", route.alias("route"), F.lit(1.0).alias("confidence"), approx_tokens(F.coalesce("query", F.lit(""))).alias("tokens"))


def decompose(queries: DataFrame) -> DataFrame:
    """The two halves of a question's words."""
    every = words(F.col("query"))
    cut = F.ceil(F.size(every) / 2).cast("int")
    halves = F.array(F.array_join(F.slice(every, F.lit(1), cut), " "), F.array_join(F.slice(every, cut + 1, F.size(every)), " "))
    return queries.select("query_id", F.filter(halves, lambda h: h != "").alias("subqueries"), approx_tokens(F.coalesce("query", F.lit(""))).alias("tokens"))


def judge(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """A hop that found anything suffices."""
    found = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    verdict = F.when(F.coalesce("n", F.lit(0)) > 0, "sufficient").otherwise("insufficient")
    return queries.join(found, "query_id", "left").select("query_id", verdict.alias("verdict"), F.col("query").alias("refined"), F.lit(0).alias("tokens"))


def recognise(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """The phrases (text) whose words stand together in a query: query_id, text.

    Every run of at most PHRASE_WORDS words of a query is looked up; the join is by equality.
    """
    told = queries.select("query_id", words(normal_phrase(F.coalesce("query", F.lit("")))).alias("words")).where(F.size("words") > 0)
    at = told.select("query_id", "words", F.explode(F.sequence(F.lit(1), F.size("words"))).alias("at"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(PHRASE_WORDS), F.size("words") - F.col("at") + 1))
    runs = at.select("query_id", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice("words", F.col("at"), n), " "))).alias("phrase")).distinct()
    known = phrases.select("text", normal_phrase(F.col("text")).alias("phrase"))
    return runs.join(known, "phrase").select("query_id", "text").distinct()


def assess(answers: DataFrame) -> DataFrame:
    """``faithfulness``: the share of an answer's words that its chunks have; ``relevancy``: of the question's words that the answer has."""
    bag = lambda text: F.array_distinct(words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " ")))
    share = lambda part, whole: F.when(F.size(part) > 0, F.size(F.array_intersect(part, whole)) / F.size(part)).otherwise(F.lit(0.0))
    said, asked, found = bag(F.col("answer")), bag(F.col("query")), bag(F.array_join(F.coalesce("texts", F.array().cast("array<string>")), " "))
    return answers.select("query_id", share(said, found).alias("faithfulness"), share(asked, said).alias("relevancy"))


def first_sentence(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)^(.*?[.!?])(\s|$)", 1))


def write(contexts: DataFrame) -> DataFrame:
    """The first sentence of the best chunk, cited; an empty answer abstains."""
    answer = F.coalesce(first_sentence(F.get("texts", F.lit(0))), F.lit(""))
    return contexts.select(
        "query_id", answer.alias("answer"), F.when(answer != "", F.array(F.lit(1))).otherwise(F.array().cast("array<int>")).alias("citations"),
        F.lit(False).alias("contradiction"), F.array().cast("array<string>").alias("open_parts"), approx_tokens(F.coalesce("context", F.lit(""))).alias("tokens"), F.when(answer == "", 0).otherwise(approx_tokens(answer)).alias("output_tokens"),
    )
