"""Writers of corpora, indexes and logs."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(chunks: DataFrame, path: str) -> None:
    if not chunks.head(1):
        raise ValueError("there are no chunks to write")
    chunks.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, chunks: DataFrame, path: str) -> None:
    """Replaces the vector table; every chunk needs its vectors."""
    missing = chunks.join(vectors, "chunk_id", "left_anti").limit(1).count()
    if missing or not vectors.head(1):
        raise ValueError("chunks and vectors do not match")
    vectors.write.mode("overwrite").parquet(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.repartitionByRange("node_id").sortWithinPartitions("node_id").write.mode("overwrite").parquet(f"{path}/nodes")
    edges.repartitionByRange("src", "dst", "kind").sortWithinPartitions("src", "dst", "kind").write.mode("overwrite").parquet(f"{path}/edges")


def table_hash(rows: DataFrame, key: str, *columns: str) -> str:
    """One hash of a table whatever its partitioning: SHA-256 over a count and two order-free sums of row hashes."""
    one = F.xxhash64(key, *columns)
    two = F.crc32(F.concat_ws("\x1f", key, *(F.to_json(F.struct(c)) for c in columns)).cast("binary"))
    r = rows.agg(F.count("*"), F.sum(one.cast("decimal(38,0)")), F.sum(two.cast("decimal(38,0)"))).head()
    return hashlib.sha256(json.dumps([str(x) for x in r]).encode()).hexdigest()


def digest_levels(rows: DataFrame, by: list[str], columns: list[str], fan: int = 1024) -> list[DataFrame]:
    """A tree of digests over rows in the order of ``by``, from the rows' own groups up to one: ``node``, ``digest``.

    A row's digest is the SHA-256 of its columns as JSON; a node's that of the
    digests of ``fan`` neighbours, one after the other.  Rows are numbered over
    ranges of the order, and a group has ``fan`` rows at most, so neither the
    number of partitions nor one task has a part in it.  ``by`` has to be a total
    order; rows that tie have to be alike.
    """
    from siftwell.operators.graph import dense_numbers, settle

    own = F.sha2(F.to_json(F.struct(*(F.col(c) for c in columns)), {"ignoreNullFields": "false"}), 256)
    level = dense_numbers(rows.select(*by, own.alias("digest")), by, "node").select("node", "digest")
    levels = []
    while True:
        groups = level.groupBy(F.expr(f"node div {fan}").alias("node"))
        ordered = F.array_sort(F.collect_list(F.struct(F.col("node"), F.col("digest"))))
        level = settle(groups.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x.digest), ""), 256).alias("digest")))
        levels.append(level)
        if level.limit(2).count() < 2:
            return levels


def ordered_hash(rows: DataFrame, by: list[str], columns: list[str], fan: int = 1024) -> str:
    """One hash of a table in its order: it differs when two rows swap, and for no partitioning."""
    top = digest_levels(rows, by, columns, fan)[-1].head()
    return "sha256:" + (top.digest if top else hashlib.sha256(b"").hexdigest())


def hash_files(spark: SparkSession, folder: str, pattern: str = "*") -> str:
    """One hash of all files of a folder, by name and bytes, in the order of their paths."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    rows = found.select("path", F.sha2(F.concat(name.cast("binary"), F.col("content")), 256).alias("own"))
    return ordered_hash(rows, ["path"], ["own"])


def manifest(corpus_id: str, dataset: dict, chunking: dict, embed_model: str, hashes: dict, n_docs: int, n_chunks: int, n_queries: int) -> dict:
    return {
        "corpus_id": corpus_id, "dataset": dataset, "chunking": chunking, "embed_model": embed_model, "index_hashes": hashes,
        "n_docs": n_docs, "n_chunks": n_chunks, "n_queries": n_queries, "created_at": datetime.now(UTC).isoformat(),
    }


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def create_if_empty(rows: DataFrame, path: str) -> bool:
    """Writes a table only where there is none; returns whether it wrote."""
    from siftwell.sources.files import exists

    if exists(rows.sparkSession, f"{path}/_SUCCESS"):
        return False
    rows.write.mode("overwrite").parquet(path)
    return True


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """One small file, wherever the path leads."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_manifest(spark: SparkSession, doc: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def copy_corpus(spark: SparkSession, source: str, target: str) -> bool:
    """Copies an index's tables and, last, its manifest; returns whether it did.

    Nothing is done without a source manifest or where the target has one, so a
    copy that broke off is begun anew and one that ended is left alone.
    """
    from siftwell.sources.files import exists, manifest

    if not exists(spark, f"{source}/manifest/_SUCCESS") or exists(spark, f"{target}/manifest/_SUCCESS"):
        return False
    for part in ("chunks", "bm25/postings", "bm25/terms", "bm25/corpus", "vectors", "graph/nodes", "graph/edges"):
        if exists(spark, f"{source}/{part}"):
            spark.read.parquet(f"{source}/{part}").write.mode("overwrite").parquet(f"{target}/{part}")
    write_manifest(spark, manifest(spark, f"{source}/manifest"), f"{target}/manifest")
    return True


def hand_check_report(found: DataFrame, n: int, seed: int = 0) -> str:
    """Markdown for checking alignment by hand: ``n`` queries drawn by seed, each chunk with its hit or miss.

    ``found``: query_id, question, chunk_id, rank, text, hit.
    """
    drawn = found.select("query_id").distinct().orderBy(F.xxhash64(F.lit(seed), "query_id"), "query_id").limit(n)
    lines = ["# Alignment by hand", ""]
    last = None
    for r in found.join(drawn, "query_id").orderBy("query_id", "rank").collect():  # the sample asked for
        if r.query_id != last:
            lines += [f"## {r.query_id}", "", r.question or "", ""]
            last = r.query_id
        lines += [f"- {'hit' if r.hit else 'miss'} {r.rank} `{r.chunk_id}`: {' '.join((r.text or '').split())}"]
    return "\n".join(lines) + "\n"


def hand_check(found: DataFrame) -> DataFrame:
    """Alignment summary by corpus: golds, hits and the share."""
    return found.groupBy("corpus_id").agg(F.count("*").alias("golds"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("share"))
