"""Readers.  What cannot be read is returned as rows, never lost and never fatal where the docstring says so."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.text import html_body

PASSAGES = T.StructType([T.StructField(n, T.StringType()) for n in ("doc_id", "id", "passage_id", "title", "text")])
GOLD = "struct<type:string,passage_ids:array<string>,doc_id:string,start_token:int,end_token:int>"
QUERIES = f"query_id string, question string, answer string, answer_aliases array<string>, answer_texts array<string>, gold_text string, gold {GOLD}"
READABLE = (".pdf", ".md", ".html", ".txt")
#: What every manifest of a corpus has (fixed values).
MANIFEST = ("corpus_id", "dataset", "chunking", "embed_model", "index_hashes", "n_docs", "n_chunks", "n_queries", "created_at")


def passages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of passages: blank lines are skipped, a missing title is empty, other keys are needed (doc_id or id)."""
    rows = spark.read.schema(PASSAGES).json(path, mode="FAILFAST")
    doc = F.coalesce("doc_id", "id")
    needed = lambda c, name: F.coalesce(c, F.raise_error(F.lit(f"{name} is missing")).cast("string"))
    return rows.select(
        needed(doc, "doc_id").alias("doc_id"), F.coalesce(F.col("passage_id"), needed(doc, "passage_id")).alias("passage_id"),
        F.coalesce("title", F.lit("")).alias("title"), needed(F.col("text"), "text").alias("text"), F.monotonically_increasing_id().alias("ord"),
    )


def queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUERIES).json(path, mode="FAILFAST")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def dataset_name(corpus_id: str) -> str:
    """A corpus's dataset: its id without a closing ``-dev-`` and number."""
    return re.sub(r"-dev-[0-9]+$", "", corpus_id)


def document(spark: SparkSession, path: str) -> dict:
    """One JSON object, in whatever lines or part files it stands."""
    doc = json.loads("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect()))
    if not isinstance(doc, dict):
        raise ValueError(f"{path} is not a JSON object")
    return doc


def dataset_info(spark: SparkSession, raw: str, corpus_id: str) -> dict:
    """The dataset of a corpus from raw/download_meta.json; of a corpus without one, its name alone."""
    path = f"{raw}/download_meta.json"
    if not exists(spark, path):
        return {"name": dataset_name(corpus_id)}
    meta = document(spark, path)
    return {"name": dataset_name(str(meta["corpus_id"])), **{k: meta["dataset"][k] for k in ("hf_id", "split", "revision")}}


def manifest(spark: SparkSession, path: str) -> dict:
    """A corpus's manifest; one that lacks a key is refused."""
    doc = document(spark, path)
    if missing := [k for k in MANIFEST if k not in doc]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return doc


def source_files(rows: DataFrame) -> DataFrame:
    """The files that rows of uploads come from, each once and in order."""
    return rows.select("file").distinct().orderBy("file")


def count_queries(spark: SparkSession, path: str) -> int:
    return queries(spark, path).count() if exists(spark, path) else 0


def query_slice(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """``ord``, ``query_id`` of a named slice, a JSON array in its order."""
    if name not in ("smoke", "full"):
        raise ValueError(f"unknown slice {name!r}")
    text = spark.read.text(f"{folder}/slice-{name}.json", wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "query_id"))


def slice_queries(all_queries: DataFrame, chosen: DataFrame) -> DataFrame:
    """The slice's queries with their place; ids without a query are an error that lists them."""
    missing = [r.query_id for r in chosen.join(all_queries, "query_id", "left_anti").orderBy("ord").limit(20).collect()]
    if missing:
        raise ValueError(f"slice ids without a query: {', '.join(missing)}")
    return chosen.join(all_queries, "query_id")


def json_documents(spark: SparkSession, pattern: str) -> tuple[DataFrame, DataFrame]:
    """Whole JSON files as (file, VARIANT doc) and, for those that do not parse, (file, error)."""
    rows = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    parsed = rows.select("file", F.try_parse_json("value").alias("doc"))
    return parsed.where("doc is not null"), parsed.where("doc is null").select("file", F.lit("JSONDecodeError: not a JSON document").alias("error"))


def lines_or_errors(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines by a schema: good rows, and malformed lines as they are."""
    kind = T._parse_datatype_string(schema)
    full = T.StructType([*kind.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")
    return rows.where("_corrupt_record is null").drop("_corrupt_record"), rows.where("_corrupt_record is not null").select(F.col("_corrupt_record").alias("line"))


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files without a byte, which file scans pass over."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed = where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(f.getPath().getName() for f in listed if f.isFile() and f.getLen() == 0 and not f.getPath().getName().startswith(("_", ".")))


def _plugged(rows: DataFrame, reader: Callable[[bytes], str]) -> DataFrame:
    """file, text, error of binary files, by a reader of one file's bytes; what it raises is the file's error."""

    def work(parts):
        for part in parts:
            out = []
            for name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                try:
                    text = reader(content or b"")
                    out.append((name, text, None if (text or "").strip() else "ValueError: no text"))
                except Exception as error:  # noqa: BLE001  a file that cannot be read is a row with its error
                    out.append((name, None, f"{type(error).__name__}: {error}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["file", "text", "error"])

    return rows.mapInArrow(work, "file string, text string, error string")


def read_uploads(spark: SparkSession, folder: str, pdf: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Uploaded files as (file, text), and failures as (file, error).  A file that cannot be read stops no other.

    Markdown and plain text are taken as they are, of HTML the body's text;
    PDF needs a reader, from a file's bytes to its text, that is not part of this
    engine; without one such files are failures.
    """
    raw = spark.read.format("binaryFile").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    others = None
    if pdf is not None:
        is_pdf = F.lower("path").endswith(".pdf")
        others, raw = _plugged(raw.where(is_pdf).select(name, "content"), pdf), raw.where(~is_pdf)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    text: Column = F.try_validate_utf8(F.col("content").cast("string"))
    body = F.when(extension == ".html", html_body(text)).when(extension.isin(".md", ".txt"), text)
    error = (
        F.when(~extension.isin(*READABLE), F.concat(F.lit("ValueError: unsupported file type "), extension))
        .when(extension == ".pdf", "RuntimeError: no PDF reader is configured")
        .when(text.isNull(), "UnicodeDecodeError: not UTF-8")
        .when(F.trim(F.coalesce(body, F.lit(""))) == "", "ValueError: no text")
    )
    rows = raw.select(name.alias("file"), body.alias("text"), error.alias("error"))
    if others is not None:
        rows = rows.unionByName(others)
    bad = rows.where("error is not null").select("file", "error")
    if empty := empty_files(spark, folder):
        bad = bad.unionByName(spark.createDataFrame([(n, "ValueError: no text") for n in empty], "file string, error string"))
    return rows.where("error is null").select("file", "text"), bad
