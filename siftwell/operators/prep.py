"""Normalisers of question-answering corpora."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import content_id

#: The longest gold span that is kept, in tokens.
LONGEST_GOLD = 1024


def gold_rows(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw query records as (queries with all their answers, golds), one gold for each passage id or one span."""
    kind = F.col("gold.type")
    known = F.when(kind.isin("passage", "span"), True).otherwise(F.raise_error(F.concat(F.lit("unknown gold type "), F.coalesce(kind, F.lit("null")))).cast("boolean"))
    rows = queries.where(known)
    answers = F.when(kind == "span", F.coalesce("answer_texts", F.array())).otherwise(F.concat(F.array("answer"), F.coalesce("answer_aliases", F.array())))
    passages = rows.where(kind == "passage").select("query_id", F.posexplode("gold.passage_ids").alias("gold_idx", "passage_id"))
    nothing = lambda t: F.lit(None).cast(t)
    passages = passages.select("query_id", "gold_idx", F.lit("passage").alias("gold_type"), "passage_id", nothing("string").alias("doc_id"), nothing("int").alias("gold_start"), nothing("int").alias("gold_end"))
    spans = rows.where(kind == "span").select(
        "query_id", F.lit(0).alias("gold_idx"), F.lit("span").alias("gold_type"), nothing("string").alias("passage_id"),
        F.col("gold.doc_id").alias("doc_id"), F.col("gold.start_token").cast("int").alias("gold_start"), F.col("gold.end_token").cast("int").alias("gold_end"),
    )
    return rows.select("query_id", "question", answers.alias("gold_answers")), passages.unionByName(spans)


def visible_spans(tokens: DataFrame) -> DataFrame:
    """Where each raw token of a page stands in the text without markup.

    ``tokens``: doc_id, pos, token, is_html.  Markup has no place (nulls); a
    token with white space within counts as its parts.  A running sum of the
    visible parts of each document gives start and end.
    """
    parts = F.when(F.col("is_html"), 0).otherwise(F.size(F.filter(F.split("token", r"\s+"), lambda t: t != "")))
    before = F.coalesce(F.sum("parts").over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = tokens.withColumn("parts", parts).withColumn("before", before)
    there = F.col("parts") > 0
    return rows.select("doc_id", "pos", F.when(there, F.col("before")).alias("start"), F.when(there, F.col("before") + F.col("parts")).alias("end"))


def remap_spans(spans: DataFrame, visible: DataFrame) -> DataFrame:
    """Raw spans [first, last) as spans of visible tokens; null where nothing of them is visible."""
    inside = spans.join(visible, "doc_id", "left").where((F.col("pos") >= F.col("first")) & (F.col("pos") < F.col("last")))
    return inside.groupBy("doc_id", "first", "last").agg(F.min("start").alias("start_token"), F.max("end").alias("end_token"))


def majority_spans(annotations: DataFrame, least: int = 2) -> DataFrame:
    """The most frequent span of each example with at least ``least`` annotators that gave one; ties: the smallest."""
    given = annotations.where("start_token is not null and start_token >= 0")
    votes = given.groupBy("example_id", "start_token", "end_token").agg(F.count("*").alias("votes"))
    total = votes.groupBy("example_id").agg(F.sum("votes").alias("n"), F.min(F.struct(-F.col("votes"), "start_token", "end_token")).alias("best"))
    return total.where(F.col("n") >= least).select("example_id", "best.start_token", "best.end_token", "n")


def support_mismatch(a: Column, b: Column) -> Column:
    """Whether two arrays differ as sets."""
    return F.array_sort(F.array_distinct(a)) != F.array_sort(F.array_distinct(b))


def multi_hop_records(examples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Examples with paragraphs as (queries, passages); supports must be those of the decomposition."""
    marked = F.transform(F.filter("paragraphs", lambda p: p.is_supporting), lambda p: p.idx)
    needed = F.transform("question_decomposition", lambda d: d.paragraph_support_idx)
    checked = F.when(support_mismatch(marked, needed), F.raise_error(F.concat(F.lit("supports differ in "), F.col("id"))).cast("boolean")).otherwise(True)
    rows = examples.where(checked)
    named = rows.select("id", F.explode("paragraphs").alias("p"))
    passages = named.select(content_id("mu-", F.col("p.title"), F.col("p.paragraph_text")).alias("passage_id"), F.col("p.title").alias("title"), F.col("p.paragraph_text").alias("text")).distinct()
    passages = passages.withColumn("doc_id", F.col("passage_id"))
    golds = F.transform(F.filter("paragraphs", lambda p: p.is_supporting), lambda p: content_id("mu-", p.title, p.paragraph_text))
    queries = rows.select(F.col("id").alias("query_id"), "question", F.concat(F.array("answer"), "answer_aliases").alias("gold_answers"), golds.alias("passage_ids"))
    return queries, passages


def holders(rows: DataFrame, items: DataFrame, id_col: str = "chunk_id", text_col: str = "text", block_bytes: int = 32_000_000) -> DataFrame:
    """Which row's text contains which item's: ``query_id``, and the row's id.

    The items (query_id, query) are the stated set: they go out in blocks of
    bounded bytes, and each text is scanned once a block for all its items by one
    automaton.  Empty items are held by none.
    """
    spark, kind = rows.sparkSession, {"id": rows.schema[id_col].dataType.simpleString(), "query": items.schema["query_id"].dataType.simpleString()}
    schema = f"query_id {kind['query']}, {id_col} {kind['id']}"
    texts, out, held, size = rows.select(id_col, F.coalesce(text_col, F.lit("")).alias("text")), spark.createDataFrame([], schema), [], 0

    def scanned(part):
        shared = spark.sparkContext.broadcast(part)

        def work(batches):
            import ahocorasick

            by_text: dict[str, list] = {}
            for query, text in shared.value:
                by_text.setdefault(text, []).append(query)
            known = ahocorasick.Automaton()
            for text, asking in by_text.items():
                known.add_word(text, asking)
            known.make_automaton()
            for batch in batches:
                found = []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found += [(q, row) for q in dict.fromkeys(q for _, asking in known.iter(text) for q in asking)]
                yield pa.RecordBatch.from_pydict({"query_id": [f[0] for f in found], id_col: [f[1] for f in found]})

        return texts.mapInArrow(work, schema)

    for item in items.where("query <> ''").select("query_id", "query").toLocalIterator():
        held.append((item.query_id, item.query))
        size += len(item.query)
        if size > block_bytes:
            out, held, size = out.unionByName(scanned(held)), [], 0
    return out.unionByName(scanned(held)) if held else out


def first_documents(rows: DataFrame, id_col: str = "doc_id", ord_col: str = "ord") -> DataFrame:
    """One row for each id, that which came first."""
    others = [c for c in rows.columns if c != id_col]
    return rows.groupBy(id_col).agg(F.min_by(F.struct(*others), ord_col).alias("r")).select(id_col, "r.*")


def annotated_pages(examples: DataFrame, longest: int = LONGEST_GOLD) -> tuple[DataFrame, DataFrame]:
    """Long-answer examples as (records, reasons of those left out with their numbers).

    ``examples``: example_id, title, question, tokens array<struct<token, is_html>>,
    annotations array<struct<start_token, end_token, candidate_index, short_answers array<string>>>.
    Kept are examples on whose long answer at least two annotators agree, whose
    span has visible tokens, at most ``longest`` of them.
    """
    votes = examples.select("example_id", F.explode("annotations").alias("a")).where("a.candidate_index <> -1").select("example_id", "a.start_token", "a.end_token")
    best = majority_spans(votes).select(F.col("example_id").alias("doc_id"), F.col("start_token").alias("first"), F.col("end_token").alias("last"))
    tokens = examples.select(F.col("example_id").alias("doc_id"), F.posexplode("tokens").alias("pos", "t")).select("doc_id", "pos", "t.token", "t.is_html")
    seen = remap_spans(best, visible_spans(tokens))
    words = F.flatten(F.transform(F.filter("tokens", lambda t: ~t.is_html), lambda t: F.filter(F.split(t.token, r"\s+"), lambda w: w != "")))
    answers = F.array_sort(F.array_distinct(F.flatten(F.transform("annotations", lambda a: a.short_answers))))
    joined = examples.join(best.withColumnRenamed("doc_id", "example_id"), "example_id", "left").join(seen.select(F.col("doc_id").alias("example_id"), F.col("start_token").alias("gold_start"), F.col("end_token").alias("gold_end")), "example_id", "left")
    reason = F.when(F.col("first").isNull(), "no majority").when(F.col("gold_start").isNull(), "nothing visible").when(F.col("gold_end") - F.col("gold_start") > longest, "too long")
    marked = joined.withColumn("reason", reason).withColumn("text", F.array_join(words, " "))
    kept = marked.where("reason is null").select(
        F.col("example_id").alias("query_id"), "question", answers.alias("gold_answers"), content_id("nq-", F.col("text")).alias("doc_id"), "title", "text",
        F.col("gold_start").cast("int").alias("gold_start"), F.col("gold_end").cast("int").alias("gold_end"),
    )
    return kept, marked.where("reason is not null").groupBy("reason").count()


def span_statistics(golds: DataFrame) -> DataFrame:
    """Smallest, median (of the lower middle) and largest length of span golds."""
    length = F.col("gold_end") - F.col("gold_start")
    rows = golds.where("gold_type = 'span'").select(length.alias("n"))
    return rows.agg(F.count("*").alias("spans"), F.min("n").alias("least"), F.expr("cast(percentile_disc(0.5) within group (order by n) as int)").alias("median"), F.max("n").alias("most"))


def seeded_order(id_col: str, seed: int) -> Column:
    """A repeatable shuffle: order by this, then by the id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")).cast("binary"))


def seeded_selection(rows: DataFrame, id_col: str, n: int, seed: int = 13) -> DataFrame:
    """The first ``n`` rows of the seeded order with their place ``ord``; a smoke slice is the head of it."""
    chosen = rows.withColumn("__key", seeded_order(id_col, seed)).orderBy("__key", id_col).limit(n)
    return chosen.withColumn("ord", F.row_number().over(Window.orderBy("__key", id_col)) - 1).drop("__key")  # n rows


def distractors(documents: DataFrame, golds: DataFrame, n: int, seed: int = 13) -> DataFrame:
    """``n`` documents of each query's corpus that are not gold, in the seeded order."""
    return seeded_selection(documents.join(golds.select("doc_id").distinct(), "doc_id", "left_anti"), "doc_id", n, seed)
