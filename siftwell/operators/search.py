"""Retrievers: BM25, dense vectors, fusion and reranking, for whole tables of queries.

Every retriever returns ``query_id, chunk_id, score, source, rank``; ranks count
from 1, ties go to the smaller chunk.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import search_terms
from siftwell.operators.near import by_size

#: BM25 parameters (fixed values).
K1, B = 1.5, 0.75
RRF_K = 60
#: Decimals that count in a comparison of scores: sums in another order differ beyond them.
DIGITS = 6
#: Query vectors that are broadcast at a time, and scores that a worker computes at a time.
QUERY_BLOCK, SCORES = 4096, 4_000_000
#: Different terms of all queries that are broadcast at most; more are joined by a shuffle.
ASKED_TERMS = 200_000
#: Text bytes of a task that counts terms, about, and bytes that are worth a task while cores are idle.
TASK_BYTES, LEAST_BYTES = 8_000_000, 1_000_000
#: Chunks of a range of blocks, about, and ranges of a query that are read before there is a bar.
PER_RANGE, FIRST_RANGES = 16, 8


def ranked(scored: DataFrame, k: int | None, score: str = "score", by: str = "chunk_id") -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(score), by)
    out = scored.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= max(0, k))


def text_tasks(texts: DataFrame, text_col: str = "text") -> int:
    """Tasks for which the texts are enough: a task's share, and so its memory, stays the same however many there are."""
    size = texts.agg(F.sum(F.octet_length(F.col(text_col)))).head()[0] or 0
    cores = texts.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-size // TASK_BYTES), min(cores, size // LEAST_BYTES))


class Bm25Index:
    """Postings with ready weights, by term, and the statistics behind them."""

    def __init__(self, postings: DataFrame, terms: DataFrame, corpus: DataFrame, weighted=None):
        self.postings, self.terms, self.corpus, self._weighted = postings, terms, corpus, weighted

    @staticmethod
    def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", k1: float = K1, b: float = B) -> Bm25Index:
        """Term counts, document counts and lengths, in two aggregations over the exploded terms.

        Texts are exchanged by chunk first: they are smaller than their counted
        terms, which then need no exchange.  Tasks follow from the bytes of the
        texts, for the counts of a task's terms are held at once.
        idf = ln(1 + (N - df + 0.5) / (df + 0.5)); a posting's weight is
        idf * tf / (tf + k1 * (1 - b + b * length / mean length)).
        """
        texts = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        texts = texts.repartition(text_tasks(texts), "chunk_id")
        rows = texts.select("chunk_id", search_terms(F.col("text")).alias("terms"))
        sized = rows.withColumn("length", F.size("terms"))
        corpus = sized.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))

        def weighted(only: DataFrame | None, few: bool = False) -> tuple[DataFrame, DataFrame]:
            # outer, or the optimizer also finds the terms of every text before the exchange, to drop texts without any
            found = sized.select("chunk_id", "length", F.explode_outer("terms").alias("term")).where("term is not null")
            if only is not None:
                found = found.join(only, "term", "left_semi")
            counts = found.groupBy("chunk_id", "length", "term").agg(F.count("*").alias("tf"))
            terms = counts.groupBy("term").agg(F.count("*").alias("df"))
            terms = terms.crossJoin(F.broadcast(corpus)).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))  # one row of corpus
            weight = F.col("idf") * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
            return counts.join(F.broadcast(terms) if few else terms, "term").select("term", "chunk_id", "tf", weight.alias("weight")), terms.select("term", "df", "idf")

        return Bm25Index(*weighted(None), corpus, weighted)

    def write(self, path: str) -> None:
        # by both, for a frequent term has a posting in nearly every chunk
        self.postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def read(spark, path: str) -> Bm25Index:
        return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "corpus")))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """Top ``k`` by the sum of weights over the query's terms, each occurrence counted; no term, no row."""
        asked = queries.select("query_id", F.explode(search_terms(F.coalesce("query", F.lit("")))).alias("term"))
        only = asked.select("term").distinct()
        few = only.limit(ASKED_TERMS + 1).count() <= ASKED_TERMS
        if few:  # other terms fall away where the texts are read
            only = F.broadcast(only)
        postings = self._weighted(only, few)[0] if self._weighted else self.postings.join(only, "term", "left_semi")
        # asked goes to the postings, which stand by chunk: neither they nor the pairs of queries and chunks are exchanged
        found = _small(asked).join(postings, "term").groupBy("query_id", "chunk_id").agg(F.round(F.sum("weight"), DIGITS).alias("score"))
        return ranked(found.where("score > 0").withColumn("source", F.lit("bm25")), k)


    def ahead(self, queries: DataFrame, k: int) -> SearchedIndex:
        """This index with the ``k`` best of these queries' different texts searched and written, for plans that ask the same again."""
        from siftwell.operators.graph import settle

        texts = queries.select(F.coalesce("query", F.lit("")).alias("query")).distinct()
        texts = settle(texts.withColumn("query_id", F.monotonically_increasing_id()))
        found = settle(self.search(texts, k))
        return SearchedIndex(self, texts.select("query_id", F.col("query").alias("text")), found, k)


class SearchedIndex(Bm25Index):
    """An index some of whose searches are done; for other texts, or more rows of each, it searches as ever."""

    def __init__(self, index: Bm25Index, texts: DataFrame, found: DataFrame, k: int):
        super().__init__(index.postings, index.terms, index.corpus, index._weighted)
        self.texts, self.found, self.k = texts, found, k

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        if k > self.k:
            return super().search(queries, k)
        asked = queries.select("query_id", F.coalesce("query", F.lit("")).alias("text"))
        known = asked.join(self.texts.withColumnRenamed("query_id", "number"), "text", "left").select("query_id", "text", "number")
        found = self.found.where(F.col("rank") <= max(0, k)).withColumnRenamed("query_id", "number")
        out = _small(known.where("number is not null").drop("text")).join(found, "number").drop("number")
        others = known.where("number is null").select("query_id", F.col("text").alias("query"))
        return out.unionByName(super().search(others, k)) if others.head(1) else out


@dataclass
class BlockResult:
    """Ranked rows, and of each query how many blocks its terms have and how many were read."""

    rows: DataFrame
    read: DataFrame


class BlockIndex:
    """Postings in blocks of a term and a small range of chunks, each with its largest weight.

    All terms share the ranges, so the sum of the largest weights of a query's
    terms in a range bounds every score there.  A search reads the blocks of the
    ranges with the highest bounds first; the k-th best score there is a bar,
    and of all other ranges only those are read whose bound reaches it: what is
    skipped cannot be among the best.
    """

    def __init__(self, blocks: DataFrame, corpus: DataFrame, k1: float = K1, b: float = B):
        self.blocks, self.corpus, self.k1, self.b = blocks, corpus, k1, b

    @staticmethod
    def build(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "text", per_range: int = PER_RANGE, k1: float = K1, b: float = B) -> BlockIndex:
        """Ranges are by hash, about ``per_range`` chunks each.

        Texts are exchanged by range: the blocks of a range then come from one
        task, and no posting is exchanged.  A posting is a count and a length, a
        block's ``most`` its largest share before idf, which a search multiplies in.
        """
        texts = chunks.select(F.col(id_col).alias("chunk_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        n, mean = texts.agg(F.count("*"), F.avg(F.size(search_terms(F.col("text"))))).head()
        ranges = max(1, -(-n // per_range))
        own = F.pmod(F.xxhash64(F.col("chunk_id")), F.lit(ranges)).alias("range")
        rows = texts.select(own, "chunk_id", "text").repartition(text_tasks(texts), "range").select("range", "chunk_id", search_terms(F.col("text")).alias("terms"))
        # outer, or the optimizer also finds the terms of every text before the exchange, to drop texts without any
        found = rows.withColumn("length", F.size("terms")).select("range", "chunk_id", "length", F.explode_outer("terms").alias("term")).where("term is not null")
        counts = found.groupBy("range", "chunk_id", "length", "term").agg(F.count("*").cast("int").alias("tf"))
        share = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
        blocks = counts.groupBy("range", "term").agg(F.max(share).alias("most"), F.count("*").cast("int").alias("n"), F.collect_list(F.struct("chunk_id", "tf", "length")).alias("postings"))
        return BlockIndex(blocks, chunks.sparkSession.createDataFrame([(n, mean, k1, b)], "n long, mean double, k1 double, b double"), k1, b)

    def write(self, path: str) -> None:
        # tasks have ranges of their own, in which terms are sorted: a search's terms stand together in every file
        self.blocks.sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{path}/blocks")
        self.corpus.write.mode("overwrite").parquet(f"{path}/corpus")

    @staticmethod
    def read(spark, path: str) -> BlockIndex:
        corpus = spark.read.parquet(f"{path}/corpus")
        row = corpus.head()
        return BlockIndex(spark.read.parquet(f"{path}/blocks"), corpus, row.k1, row.b)

    def search(self, queries: DataFrame, k: int, first: int = FIRST_RANGES) -> BlockResult:
        """Top ``k`` by the sum of weights over the query's terms, each occurrence counted; no term, no row."""
        from siftwell.operators.graph import settle

        asked = queries.select("query_id", F.explode(search_terms(F.coalesce("query", F.lit("")))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = settle(asked)
        own = self.blocks.join(_small(asked.select("term").distinct()), "term", "left_semi")  # other terms fall away where the blocks are read
        heads = own.select("term", "range", "most", "n")  # postings are not read for this
        df = F.col("df")
        terms = heads.groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(self.corpus))  # one row of corpus
        terms = terms.select("term", "mean", F.log(1 + (F.col("n") - df + 0.5) / (df + 0.5)).alias("idf"))
        asked = settle(asked.join(terms, "term"))
        bounds = heads.join(_small(asked), "term").groupBy("query_id", "range").agg(F.sum(F.col("times") * F.col("idf") * F.col("most")).alias("bound"), F.count("*").alias("blocks"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "range"))
        bounds = settle(bounds)
        head = bounds.withColumn("place", place).where(F.col("place") <= first).drop("place")
        found = settle(self._scores(own, asked, head))
        bar = ranked(found, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("bar"))
        rest = bounds.join(_small(head.select("query_id", "range")), ["query_id", "range"], "left_anti").join(_small(bar), "query_id", "left")
        rest = settle(rest.where("bar is null or bound + 1e-6 >= bar").drop("bar"))
        rows = ranked(found.unionByName(self._scores(own, asked, rest)).withColumn("source", F.lit("bm25")), k)
        used = head.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("n_read"))
        return BlockResult(rows, bounds.groupBy("query_id").agg(F.sum("blocks").alias("n_blocks")).join(used, "query_id"))

    def _scores(self, own: DataFrame, asked: DataFrame, ranges: DataFrame) -> DataFrame:
        wanted = _small(asked.join(ranges.select("query_id", "range"), "query_id"))
        postings = own.select("term", "range", "postings").join(wanted, ["term", "range"]).select("query_id", "times", "idf", "mean", F.explode("postings").alias("p"))
        tf = F.col("p.tf")
        weight = F.col("idf") * tf / (tf + self.k1 * (1 - self.b + self.b * F.col("p.length") / F.col("mean")))
        scores = postings.groupBy("query_id", F.col("p.chunk_id").alias("chunk_id")).agg(F.round(F.sum(F.col("times") * weight), DIGITS).alias("score"))
        return scores.where("score > 0")


def _small(rows: DataFrame, most: int = ASKED_TERMS) -> DataFrame:
    """``rows``, to be broadcast if a count says that they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def dense_search(queries: DataFrame, chunks: DataFrame, k: int, vector: str = "vector", block: int = QUERY_BLOCK) -> DataFrame:
    """Top ``k`` chunks of each query by cosine.

    The query vectors are the stated set: they go out in bounded blocks, and
    every partition of chunks multiplies block by block and keeps its own best
    ``k``, so only queries x k rows a partition are exchanged.  Vectors with null
    or non-finite components take no part, and only vectors of one size are
    compared; a zero vector has cosine 0 with all.
    """
    if k <= 0:
        return queries.sparkSession.createDataFrame([], "query_id string, chunk_id string, score double, source string, rank int")
    spark = queries.sparkSession
    kind = chunks.schema["chunk_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    rows = chunks.select("chunk_id", F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    schema = f"query_id {kind[1]}, chunk_id {kind[0]}, score double"
    out = spark.createDataFrame([], schema)
    held: dict[int, list] = {}

    def scored(part):
        names = [r.query_id for r in part]
        shared = spark.sparkContext.broadcast((names, unit_rows(np.array([r.v for r in part], float))))

        def work(batches):
            own, q = shared.value
            best: list[list[tuple[float, object]]] = [[] for _ in own]  # (-score, id), ascending
            edge = np.full(len(own), -np.inf)
            for batch in batches:
                ids, x = whole_rows(batch.column(0), batch.column(1), q.shape[1])
                step = max(1, SCORES // len(own))
                for a in range(0, len(ids), step):
                    scores = np.round(q @ unit_rows(x[a : a + step]).T, DIGITS) + 0.0
                    for i in np.flatnonzero((scores >= edge[:, None]).any(axis=1)).tolist():
                        near = np.flatnonzero(scores[i] >= edge[i])
                        if len(near) > k:  # no fewer than k are at least as near as the k-th of them
                            near = near[scores[i][near] >= np.partition(scores[i][near], len(near) - k)[len(near) - k]]
                        best[i] = sorted([*best[i], *((-scores[i][j], ids[a + j]) for j in near.tolist())])[:k]
                        if len(best[i]) == k:
                            edge[i] = -best[i][-1][0]
            found = [(name, chunk, -score) for name, rows in zip(own, best) for score, chunk in rows]
            if found:
                yield pa.RecordBatch.from_pydict({"query_id": [f[0] for f in found], "chunk_id": [f[1] for f in found], "score": [f[2] + 0.0 for f in found]})

        return rows.mapInArrow(work, schema)

    for row in queries.select("query_id", F.col(vector).cast("array<double>").alias("v")).where("v is not null").toLocalIterator():
        if not row.v or not all(x is not None and math.isfinite(x) for x in row.v):
            continue
        part = held.setdefault(len(row.v), [])
        part.append(row)
        if len(part) == block:
            out = out.unionByName(scored(held.pop(len(row.v))))
    for part in held.values():
        out = out.unionByName(scored(part))
    return ranked(out.withColumn("source", F.lit("dense")), k)


def unit_rows(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(size == 0, 1, size)


def whole_rows(ids: pa.Array, vectors: pa.Array, size: int) -> tuple[list, np.ndarray]:
    """Ids and vectors of the rows with a vector of ``size`` finite components."""
    for rows, x in by_size(vectors):
        if x.shape[1] == size:
            return ids.take(pa.array(rows)).to_pylist(), x
    return [], np.zeros((0, size))


def rrf(lists: list[DataFrame], k: int | None = None, rrf_k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, adding in the order of the lists."""
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    every = None
    for i, one in enumerate(lists):
        part = one.select("query_id", "chunk_id", F.lit(i).alias("list"), (1.0 / (F.col("rank") + rrf_k)).alias("share"))
        every = part if every is None else every.unionByName(part)
    shares = [F.sum(F.when(F.col("list") == i, F.col("share"))).alias(f"s{i}") for i in range(len(lists))]
    fused = every.groupBy("query_id", "chunk_id").agg(*shares)
    total: Column = F.lit(0.0)
    for i in range(len(lists)):
        total = total + F.coalesce(f"s{i}", F.lit(0.0))
    return ranked(fused.select("query_id", "chunk_id", total.alias("score"), F.lit("rrf").alias("source")), k)


def overlap_score(query: Column, text: Column) -> Column:
    """The share of a query's different words that a text has: the offline relevance scorer."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    return F.size(F.array_intersect(words(query), words(text))) / F.greatest(F.size(words(query)), F.lit(1))


def rerank(candidates: DataFrame, queries: DataFrame, chunks: DataFrame, k: int, score=overlap_score) -> DataFrame:
    """Candidates in the order of ``score(query, text)``; equal scores keep the candidates' order."""
    from siftwell.operators.graph import settle

    joined = _small(settle(candidates.select("query_id", "chunk_id", F.col("rank").alias("before"))))  # then texts are not exchanged
    joined = joined.join(chunks.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    scored = joined.select("query_id", "chunk_id", "before", F.round(score(F.col("query"), F.col("text")), DIGITS).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before", "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit("rerank").alias("source"), "rank")
