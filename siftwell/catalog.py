"""Registered queries: each operator over the whole test tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import vectors as V
from siftwell.operators import agent, chunking, evaluate, graph, ledger, prep, search
from siftwell.plans import costs, records
from siftwell.plans.answer import answer, retrieve_each
from siftwell.plans.config import PRESETS, preset
from siftwell.plans.retrieve import Indexes, embed_chunks, retrieve
from siftwell.registry import register

WS = r"[\s\x1c-\x1f\x{85}\p{Z}]+"
STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
PUNCT_SQL = X.PUNCTUATION.replace("'", "''")
TOKENS_SQL = f"list_filter(regexp_split_to_array(text, '{WS}'), lambda t: t <> '')"
TERMS_SQL = f"list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: NOT list_contains({STOP_SQL}, t))"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def norm_sql(c: str) -> str:
    words = f"regexp_split_to_array(translate(lower({c}), '{PUNCT_SQL}', ''), '{WS}')"
    return f"array_to_string(list_filter({words}, lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"


# ---- scalar functions


@register("tokenise_counts", f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INTEGER) AS n_tokens FROM documents")
def tokenise_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(F.col("text"))).alias("n_tokens"))


@register("normal_phrase", f"SELECT conv_id, turn, trim(regexp_replace(lower(text), '{WS}', ' ', 'g')) AS phrase FROM conversations")
def normal_phrase(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normal_phrase(F.col("text")).alias("phrase"))


@register("normal_answer", f"SELECT conv_id, turn, {norm_sql('text')} AS answer FROM conversations")
def normal_answer(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", X.normal_answer(F.col("text")).alias("answer"))


@register("content_ids", "SELECT doc_id, 'mu-' || left(sha1(concat_ws(chr(10), source, text)), 16) AS passage_id, 'nq-' || left(sha1(text), 16) AS document_id FROM documents")
def content_ids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_id("mu-", F.col("source"), F.col("text")).alias("passage_id"), X.content_id("nq-", F.col("text")).alias("document_id"))


@register("point_uuid5", """
WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('chunk:' || CAST(doc_id AS VARCHAR))) AS s FROM documents)
SELECT doc_id, concat(s[1:8], '-', s[9:12], '-5', s[14:16], '-', substr('89ab', CAST((instr('0123456789abcdef', s[17:17]) - 1) % 4 AS INTEGER) + 1, 1), s[18:20], '-', s[21:32]) AS point FROM h
""")
def point_uuid5(spark, d):
    return table(spark, d, "documents").select("doc_id", X.uuid5(F.concat(F.lit("chunk:"), F.col("doc_id").cast("string"))).alias("point"))


@register("approx_tokens", "SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS n FROM documents")
def approx_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", X.approx_tokens(F.col("text")).alias("n"))


@register("html_body_text", f"""
WITH a AS (SELECT page_id, coalesce(nullif(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), ''), html) AS b FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(b, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM a)
SELECT page_id, trim(regexp_replace(t, '{WS}', ' ', 'g')) AS body FROM c
""")
def html_body_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_body(F.col("html")).alias("body"))


@register("chunk_parts", r"""
SELECT doc_id, regexp_extract(c, '^(.*):(\d+)$', 1) AS document, CAST(regexp_extract(c, '^(.*):(\d+)$', 2) AS INTEGER) AS position,
       regexp_matches(source, '^[a-z0-9][a-z0-9_-]{0,63}$') AS slug, regexp_replace(source || '-dev-300', '-dev-\d+$', '') AS dataset
FROM (SELECT doc_id, source, source || ':' || lang || ':' || CAST(n_chars AS VARCHAR) AS c FROM documents)
""")
def chunk_parts(spark, d):
    name = F.concat_ws(":", "source", "lang", F.col("n_chars").cast("string"))
    doc, position = X.chunk_parts(name)
    return table(spark, d, "documents").select("doc_id", doc.alias("document"), position.alias("position"), X.is_slug(F.col("source")).alias("slug"), X.dataset_name(F.concat("source", F.lit("-dev-300"))).alias("dataset"))


@register("client_address", "SELECT event_id, coalesce(nullif(trim(split_part(nullif(concat(' 10.0.0.', user_id % 7, ' , x'), ' 10.0.0.0 , x'), ',', 1)), ''), 'peer') AS ip FROM events")
def client_address(spark, d):
    forwarded = F.concat(F.lit(" 10.0.0."), (F.col("user_id") % 7).cast("string"), F.lit(" , x"))
    return table(spark, d, "events").select("event_id", X.client_address(F.nullif(forwarded, F.lit(" 10.0.0.0 , x")), F.lit("peer")).alias("ip"))


@register("hash_embed", """
WITH h AS (SELECT doc_id, sha256(text) AS s FROM documents),
v AS (SELECT doc_id, i, ((instr('0123456789abcdef', s[2*i+1:2*i+1]) - 1) * 16 + instr('0123456789abcdef', s[2*i+2:2*i+2]) - 1) / 255.0::DOUBLE - 0.5 AS x FROM h, range(32) t(i)),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM v GROUP BY doc_id)
SELECT doc_id, round(sum(x / size), 6) + 0.0::DOUBLE AS total, round(max(x / size), 6) AS most FROM v JOIN n USING (doc_id) GROUP BY doc_id
""")
def hash_embed(spark, d):
    v = table(spark, d, "documents").select("doc_id", V.hash_embedding(F.col("text")).alias("v"))
    return v.select("doc_id", (F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 6) + 0.0).alias("total"), F.round(F.array_max("v"), 6).alias("most"))


# ---- chunks


@register("chunk_fixed_stride", f"""
WITH t AS (SELECT doc_id, {TOKENS_SQL} AS w FROM documents),
c AS (SELECT doc_id, w, CASE WHEN len(w) = 0 THEN 0 WHEN len(w) <= 128 THEN 1 ELSE 1 + CAST(ceil((len(w) - 128) / 112.0) AS BIGINT) END AS n FROM t)
SELECT doc_id, CAST(i AS INTEGER) AS position, CAST(i * 112 AS INTEGER) AS start_token, CAST(least(i * 112 + 128, len(w)) AS INTEGER) AS end_token,
       array_to_string(w[i * 112 + 1 : least(i * 112 + 128, len(w))], ' ') AS text
FROM c, LATERAL (SELECT unnest(range(n)) AS i)
""")
def chunk_fixed_stride(spark, d):
    return chunking.fixed_chunks(table(spark, d, "documents"), 128, 16)


def pack_cte(rows: str, size: int, overlap: int) -> str:
    """Common table expressions (recursive) up to ``o``: key, w (words), s, e of the packed windows of rows key, text."""
    step = size - overlap
    return f"""
t AS (SELECT key, {TOKENS_SQL} AS w FROM ({rows})),
e AS (SELECT key, w, list_filter(range(1, len(w) + 1), lambda i: right(w[i], 1) IN ('.', '!', '?') OR i = len(w)) AS ends FROM t WHERE len(w) > 0),
s AS (SELECT key, unnest(range(1, len(ends) + 1)) AS k, ends FROM e),
r AS (SELECT key, CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END AS a, ends[k] AS b FROM s),
u AS (SELECT key, a + i * {step} AS a, least(a + i * {step} + {size}, b) AS b FROM (SELECT key, a, b, unnest(range(CASE WHEN b - a <= {size} THEN 1 ELSE 1 + CAST(ceil((b - a - {size}) / {step}.0) AS BIGINT) END)) AS i FROM r)),
l AS (SELECT key, list(a ORDER BY a, b) AS a, list(b ORDER BY a, b) AS b FROM u GROUP BY key),
p(key, a, b, i, first, used, win) AS (
  SELECT key, a, b, 1, 1, CAST(0 AS BIGINT), CAST(NULL AS STRUCT(s BIGINT, e BIGINT)) FROM l
  UNION ALL
  SELECT key, a, b, i + 1,
    CASE WHEN fits THEN first ELSE nf END, CASE WHEN fits THEN used + len ELSE coalesce(list_sum(list_transform(range(nf, i), lambda j: b[j] - a[j])), 0) + len END,
    CASE WHEN fits THEN NULL ELSE {{'s': a[first], 'e': b[i - 1]}} END
  FROM (
    SELECT *, CASE WHEN k0 < i AND (list_sum(list_transform(range(k0, i), lambda j: b[j] - a[j])) + len > {size} OR b[i - 1] <> a[i]) THEN i ELSE k0 END AS nf
    FROM (
      SELECT *, b[i] - a[i] AS len, (i = first OR used + b[i] - a[i] <= {size}) AS fits,
        coalesce(list_min(list_filter(range(first, i), lambda k: list_sum(list_transform(range(k, i), lambda j: b[j] - a[j])) <= {overlap})), i) AS k0
      FROM p WHERE i <= len(a)
    )
  )
),
o AS (SELECT key, w, s, e FROM t JOIN (SELECT key, win.s AS s, win.e AS e FROM p WHERE win IS NOT NULL UNION ALL SELECT key, a[first], b[len(b)] FROM p WHERE i = len(a) + 1) USING (key))
"""


PACK_SQL = f"""
WITH RECURSIVE {pack_cte("SELECT doc_id AS key, text FROM documents", 64, 8)}
SELECT CAST(key AS VARCHAR) AS doc_id, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token, CAST(row_number() OVER (PARTITION BY key ORDER BY s, e) - 1 AS INTEGER) AS position FROM o
"""


@register("chunk_sentence_pack", PACK_SQL)
def chunk_sentence_pack(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("passage_id"), F.lit(0).alias("ord"), "text")
    return chunking.chunk(docs, 64, 8).select("doc_id", "start_token", "end_token", "position")


@register("chunk_renumber", f"""
WITH RECURSIVE {pack_cte("SELECT conv_id || '-' || turn AS key, text FROM conversations", 32, 4)},
n AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, key AS passage_id, array_to_string(w[s + 1 : e], ' ') AS text, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, s, e) - 1 AS INTEGER) AS position, s, e
      FROM o JOIN conversations c ON c.conv_id || '-' || c.turn = key)
SELECT doc_id || ':' || position AS chunk_id, doc_id, passage_id, text, position, CAST(s AS INTEGER) AS start_token, CAST(e AS INTEGER) AS end_token FROM n
""")
def chunk_renumber(spark, d):
    """Passages are conversation turns: positions count through each conversation."""
    turns = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws("-", "conv_id", "turn").alias("passage_id"), F.col("turn").alias("ord"), "text")
    return chunking.chunk(turns, 32, 4)


@register("token_offsets", f"""
WITH t AS (SELECT conv_id, turn, CAST(len({TOKENS_SQL}) AS BIGINT) AS n FROM conversations),
o AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_token FROM t)
SELECT conv_id, turn, start_token, start_token + n AS end_token FROM o
""")
def token_offsets(spark, d):
    """Where each turn's tokens stand in its conversation."""
    return chunking.token_offsets(table(spark, d, "conversations"), "conv_id", "turn").select("conv_id", "turn", "start_token", "end_token")


@register("oversized_hard_cut", """
SELECT doc_id || '#part' || i AS doc_id, CAST(i AS INTEGER) AS part, CAST(n AS INTEGER) AS n_splits, substr(text, i * 2000 + 1, 2000) AS text
FROM (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, CAST(ceil(length(text) / 2000.0) AS BIGINT) AS n FROM documents WHERE length(text) > 2000), LATERAL (SELECT unnest(range(n)) AS i)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 1, text FROM documents WHERE length(text) <= 2000
""")
def oversized_hard_cut(spark, d):
    return chunking.split_oversized(table(spark, d, "documents"), 2000)


@register("oversized_split", r"""
WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, string_split(text, chr(10)) AS x FROM documents WHERE length(text) > 3000),
l AS (SELECT doc_id, list_transform(range(1, len(x) + 1), lambda i: x[i] || CASE WHEN i < len(x) THEN chr(10) ELSE '' END) AS p FROM d),
r(doc_id, p, i, held, parts) AS (
  SELECT doc_id, p, 1, '', CAST([] AS VARCHAR[]) FROM l
  UNION ALL
  SELECT doc_id, p, i + 1, CASE WHEN over THEN '' ELSE held END || substr(p[i], cuts * 3000 + 1),
    list_concat(list_concat(parts, CASE WHEN over THEN [held] ELSE CAST([] AS VARCHAR[]) END), list_transform(range(cuts), lambda j: substr(p[i], j * 3000 + 1, 3000)))
  FROM (SELECT *, held <> '' AND length(held) + length(p[i]) > 3000 AS over, greatest(length(p[i]) - 1, 0) // 3000 AS cuts FROM r WHERE i <= len(p))
),
o AS (SELECT doc_id, CASE WHEN held <> '' THEN list_append(parts, held) ELSE parts END AS parts FROM r WHERE i = len(p) + 1)
SELECT doc_id || '#part' || (k - 1) AS doc_id, CAST(k - 1 AS INTEGER) AS part, CAST(len(parts) AS INTEGER) AS n_splits, parts[k] AS text FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM o)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 0, 1, text FROM documents WHERE length(text) <= 3000
""")
def oversized_split(spark, d):
    return chunking.split_oversized(table(spark, d, "documents"), 3000, separator="\n")


# ---- search


def _chunks(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("doc_id").alias("passage_id"), F.col("doc_id"))


def _asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


BM25_CTE = f"""
t AS (SELECT doc_id AS chunk_id, {TERMS_SQL} AS terms FROM documents),
c AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM t),
f AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM t) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean)) AS weight FROM f JOIN df USING (term), c),
q AS (SELECT item_id AS query_id, unnest({TERMS_SQL}) AS term FROM benchmark),
s AS (SELECT query_id, chunk_id, round(sum(weight), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL),
b AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s WHERE score > 0)
"""


@register("bm25_stats", f"WITH {BM25_CTE} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, c")
def bm25_stats(spark, d):
    return search.Bm25Index.build(_chunks(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@register("bm25_topk", f"WITH {BM25_CTE} SELECT query_id, chunk_id, score, 'bm25' AS source, rank FROM b WHERE rank <= 5")
def bm25_topk(spark, d):
    return search.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d), 5).select("query_id", "chunk_id", "score", "source", "rank")


@register("bm25_blocks_topk", f"WITH {BM25_CTE} SELECT query_id, chunk_id, score, 'bm25' AS source, rank FROM b WHERE rank <= 5")
def bm25_blocks_topk(spark, d):
    """The same from a written index of blocks, most of which are not read."""
    path = graph.shared_path(spark, "blocks")
    search.BlockIndex.build(_chunks(spark, d)).write(path)
    return search.BlockIndex.read(spark, path).search(_asked(spark, d), 5).rows.select("query_id", "chunk_id", "score", "source", "rank")


@register("bm25_stopword_only", "SELECT CAST(0 AS BIGINT) AS n")
def bm25_stopword_only(spark, d):
    asked = spark.createDataFrame([(1, "the of and"), (2, None), (3, "")], "query_id long, query string")
    return search.Bm25Index.build(_chunks(spark, d)).search(asked, 5).agg(F.count("*").alias("n"))


DENSE_SQL = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, round(list_cosine_similarity(q.e, v.e), 6) AS score FROM v q, v WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM s)
SELECT query_id, chunk_id, score, rank FROM r WHERE rank <= 10
"""


@register("dense_topk", DENSE_SQL)
def dense_topk(spark, d):
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.dense_search(asked, v.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), 10).select("query_id", "chunk_id", "score", "rank")


def vector_sql(text: str) -> str:
    """The hash embedding of a text, not brought to length 1: a cosine does that."""
    digit = "(instr('0123456789abcdef', sha256({t})[2 * i + {k} : 2 * i + {k}]) - 1)"
    return f"list_transform(range(32), lambda i: ({digit.format(t=text, k=1)} * 16 + {digit.format(t=text, k=2)}) / 255.0::DOUBLE - 0.5)"


@register("dense_two_variants", f"""
WITH RECURSIVE {pack_cte("SELECT doc_id AS key, text FROM documents", 128, 16)},
c AS (SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY s, e) - 1 AS INTEGER) AS position, array_to_string(w[s + 1 : e], ' ') AS text FROM o),
h AS (SELECT key, string_agg(text, ' ' ORDER BY position) AS whole FROM c GROUP BY key),
v AS (SELECT key, position, {vector_sql("text")} AS a, {vector_sql("whole")} AS b FROM c JOIN h USING (key)),
z AS (SELECT *, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb FROM v)
SELECT CAST(key AS VARCHAR) || ':' || position AS chunk_id, round(list_cosine_similarity(a, list_transform(range(1, 33), lambda i: 0.8::DOUBLE * a[i] / na + 0.2::DOUBLE * b[i] / nb)), 6) AS cosine FROM z
""")
def dense_two_variants(spark, d):
    """Isolated and contextual vectors of sentence chunks; equal texts tie in the first and part in the second."""
    docs = table(spark, d, "documents").select("doc_id", F.col("doc_id").alias("passage_id"), F.lit(0).alias("ord"), "text")
    v = embed_chunks(chunking.chunk(docs, 128, 16))
    return v.select("chunk_id", F.round(V.cosine(F.col("isolated"), F.col("contextual")), 6).alias("cosine"))


OVERLAP_SQL = r"""
words AS (SELECT item_id AS query_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')) AS qw FROM benchmark)
"""


@register("rrf_fuse", f"""
WITH {BM25_CTE},
l AS (SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY chunk_id) AS INTEGER) AS rank FROM b WHERE rank <= 30),
x AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS share FROM b WHERE rank <= 20 UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) FROM l WHERE rank <= 20),
y AS (SELECT query_id, chunk_id, round(sum(share), 9) AS score FROM x GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM y
""")
def rrf_fuse(spark, d):
    """BM25's order fused with the order of ids among its 30 best."""
    best = graph.settle(search.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d), 30))  # both lists read it
    by_id = best.select("query_id", "chunk_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id"))).where("rank <= 20")
    fused = search.rrf([best.where("rank <= 20"), by_id]).select("query_id", "chunk_id", F.round("score", 9).alias("score"))
    return search.ranked(fused, None)


@register("rerank_overlap", rf"""
WITH {BM25_CTE}, {OVERLAP_SQL},
o AS (SELECT b.query_id, b.chunk_id, b.rank AS before, round(len(list_intersect(qw, list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')))) / greatest(len(qw), 1), 6) AS score
      FROM b JOIN words USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 20)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS INTEGER) AS rank FROM o) WHERE rank <= 5
""")
def rerank_overlap(spark, d):
    best = search.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d), 20)
    return search.rerank(best, _asked(spark, d), _chunks(spark, d), 5).select("query_id", "chunk_id", "score", "rank")


def _indexes(spark, d, with_graph=False):
    chunks = _chunks(spark, d).select(F.col("chunk_id").cast("string"), F.col("doc_id").cast("string"), "text", F.lit(0).alias("position"), F.col("doc_id").alias("ord"))
    found = Indexes(chunks, search.Bm25Index.build(chunks), graph.settle(embed_chunks(chunks)))
    if with_graph:
        triples = _triples(spark, d)
        nodes = graph.nodes(chunks, triples.withColumn("chunk_id", F.col("chunk_id").cast("string")))
        found.node_vectors = nodes.withColumn("vector", V.hash_embedding(F.col("text")))
        found.edges = graph.edges(nodes, triples.withColumn("chunk_id", F.col("chunk_id").cast("string")))
    return found


TRIPLES_SQL = """
tr AS (SELECT CAST(n_nationkey AS BIGINT) AS chunk_id, n_name AS s, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT CAST(c_custkey AS BIGINT), n_name, ' Market  ' || c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey),
tn AS (SELECT chunk_id, trim(regexp_replace(lower(s), '\\s+', ' ', 'g')) AS s, trim(regexp_replace(lower(o), '\\s+', ' ', 'g')) AS o FROM tr),
ph AS (SELECT s AS text FROM tn UNION SELECT o FROM tn)
"""


def plan_cte(asked: str, bm25=True, dense=False, with_graph=False, rerank=False, k: int = 50, final: int = 5, recognise=False) -> str:
    """A retrieval plan over rows query_id, text as common table expressions up to ``final``: query_id, chunk_id, score, source, rank.

    Every document is one chunk, so its contextual vector is its own.
    """
    rank = "CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank"
    parts = [f"a AS ({asked})", f"dc AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, {TERMS_SQL} AS terms, {vector_sql('text')} AS e FROM documents)", f"av AS (SELECT query_id, text, {vector_sql('text')} AS e FROM a)"]
    lists = []
    if bm25:
        parts.append(f"""c AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM dc),
f AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(terms) AS dl, unnest(terms) AS term FROM dc) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM f GROUP BY term),
w AS (SELECT term, chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / mean)) AS weight FROM f JOIN df USING (term), c),
q AS (SELECT query_id, unnest({TERMS_SQL}) AS term FROM a),
b AS (SELECT *, {rank} FROM (SELECT query_id, chunk_id, round(sum(weight), 6) AS score FROM q JOIN w USING (term) GROUP BY ALL) WHERE score > 0)""")
        lists.append("b")
    if dense:
        parts.append(f"v AS (SELECT *, {rank} FROM (SELECT query_id, chunk_id, round(list_cosine_similarity(av.e, dc.e), 6) AS score FROM av, dc))")
        lists.append("v")
    if with_graph:
        parts += _graph_sql(recognise)
        lists.append("gr")
    if len(lists) == 1:
        parts.append(f"fused AS (SELECT query_id, chunk_id, score, '{dict(b='bm25', v='dense', gr='graph')[lists[0]]}' AS source, rank FROM {lists[0]} WHERE rank <= {k})")
    else:
        share = " UNION ALL ".join(f"SELECT query_id, chunk_id, {i} AS l, 1.0::DOUBLE / (rank + 60) AS share FROM {x} WHERE rank <= {k}" for i, x in enumerate(lists))
        total = " + ".join(f"coalesce(sum(share) FILTER (l = {i}), 0.0::DOUBLE)" for i in range(len(lists)))
        parts.append(f"fused AS (SELECT query_id, chunk_id, score, 'rrf' AS source, {rank} FROM (SELECT query_id, chunk_id, {total} AS score FROM ({share}) GROUP BY ALL))")
    if rerank:
        words = r"list_distinct(list_filter(regexp_split_to_array(lower({t}.text), '\s+'), lambda t: t <> ''))"
        own, other = words.format(t="a"), words.format(t="dc")
        parts.append(f"""ro AS (SELECT query_id, chunk_id, rank AS before, round(len(list_intersect({own}, {other})) / greatest(len({own}), 1), 6) AS score FROM fused JOIN a USING (query_id) JOIN dc USING (chunk_id)),
final AS (SELECT * FROM (SELECT query_id, chunk_id, score, 'rerank' AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS INTEGER) AS rank FROM ro) WHERE rank <= {final})""")
    else:
        parts.append(f"final AS (SELECT * FROM fused WHERE rank <= {final})")
    return ",\n".join(parts)


def _graph_sql(recognise: bool = False) -> list[str]:
    """The graph of documents and phrases, the seeds of every query, the rounds of PageRank, and ``gr``.

    With recognition phrases stay seeds only if the query holds them, unless none would be left.
    """
    norm = "trim(regexp_replace(lower({}), '\\s+', ' ', 'g'))"
    if recognise:
        named = f"contains(' ' || {norm.format('a.text')} || ' ', ' ' || nd.key || ' ')"
        seeds = f"""sb AS (SELECT query_id, node, m, nd.kind = 0 AS passage, nd.kind = 1 AND {named} AS hit FROM s0 JOIN nd USING (node) JOIN a USING (query_id)),
se AS (SELECT query_id, node, m FROM (SELECT *, max(hit) OVER (PARTITION BY query_id) AS named FROM sb) WHERE NOT named OR hit OR passage)"""
    else:
        seeds = "se AS (SELECT * FROM s0)"
    parts = [TRIPLES_SQL, f"""
nd AS (SELECT CAST(row_number() OVER (ORDER BY kind, ord, key) - 1 AS BIGINT) AS node, kind, chunk_id, key, e FROM (
  SELECT 0 AS kind, doc_id AS ord, '' AS key, CAST(doc_id AS VARCHAR) AS chunk_id, {vector_sql("text")} AS e FROM documents UNION ALL SELECT 1, 0, text, NULL, {vector_sql("text")} FROM ph)),
ti AS (SELECT CAST(tn.chunk_id AS VARCHAR) AS chunk_id, x.node AS s, y.node AS o FROM tn JOIN nd x ON x.kind = 1 AND x.key = tn.s JOIN nd y ON y.kind = 1 AND y.key = tn.o),
ge AS (SELECT DISTINCT least(s, o) AS src, greatest(s, o) AS dst, 'r' AS kind FROM ti WHERE s <> o
  UNION ALL SELECT DISTINCT least(node, p), greatest(node, p), 'a' FROM (SELECT chunk_id, s AS p FROM ti UNION ALL SELECT chunk_id, o FROM ti) JOIN nd USING (chunk_id)),
ad AS (SELECT src, dst, CAST(count(*) AS DOUBLE) AS weight FROM (SELECT src, dst FROM ge UNION ALL SELECT dst, src FROM ge) GROUP BY ALL),
ou AS (SELECT src, sum(weight) AS w FROM ad GROUP BY src),
sc AS (SELECT query_id, node, round(list_cosine_similarity(av.e, nd.e), 6) AS score FROM av, nd),
sr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS rank, max(score) OVER (PARTITION BY query_id) > 0 AS above FROM sc),
s0 AS (SELECT query_id, node, CASE WHEN above THEN score ELSE 1.0::DOUBLE END AS m FROM sr WHERE rank <= {graph.SEEDS} AND ((above AND score > 0) OR (NOT above AND rank = 1))),
{seeds},
pp AS (SELECT query_id, node, m / sum(m) OVER (PARTITION BY query_id) AS p FROM se),
lo AS (SELECT query_id, coalesce(sum(p) FILTER (node NOT IN (SELECT src FROM ou)), 0.0::DOUBLE) AS lone FROM pp GROUP BY query_id),
x0 AS (SELECT query_id, node, p AS m FROM pp)"""]  # fmt: skip
    lost = "lone"
    for k in range(graph.ROUNDS):
        back = f"(0.5 + 0.5 * {lost})"
        parts.append(
            f"x{k + 1} AS MATERIALIZED (SELECT query_id, node, sum(m) AS m FROM (SELECT query_id, ad.dst AS node, 0.5 * m * (weight / w) AS m FROM x{k} JOIN ad ON ad.src = node JOIN ou ON ou.src = ad.src "
            f"UNION ALL SELECT query_id, node, p * {back} FROM pp JOIN lo USING (query_id)) GROUP BY ALL)"
        )
        lost = f"({back} * lone)"
    parts.append(
        "gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM ("
        f"SELECT query_id, chunk_id, round(0.5 * coalesce(m, 0) + 0.5 * score, 6) AS score FROM sc JOIN nd USING (node) LEFT JOIN x{graph.ROUNDS} USING (query_id, node) WHERE kind = 0))"
    )
    return parts


ITEMS_SQL = "SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark"


def _hybrid(name, with_graph=False):
    def run(spark, d):
        asked = _asked(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
        rows, degraded = retrieve(asked, _indexes(spark, d, with_graph), preset(name))
        return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", "rank", F.lit(",".join(degraded)).alias("degraded"))

    return run


def _hybrid_sql(name) -> str:
    q = preset(name).query
    return f"WITH {plan_cte(ITEMS_SQL, q.bm25, q.dense, q.graph, q.rerank)} SELECT query_id, chunk_id, round(score, 6) AS score, source, rank, '' AS degraded FROM final"


for _name in PRESETS:
    if _name != "router-on":
        register(f"retrieve_{_name.replace('-', '_')}", _hybrid_sql(_name))(_hybrid(_name, PRESETS[_name].query.graph))


#: Sub-queries of the long items: the halves of their words.
_HALVES = r"""
al AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS w FROM benchmark),
ah AS (SELECT query_id, h, array_to_string(CASE h WHEN 0 THEN w[1 : CAST(ceil(len(w) / 2.0) AS BIGINT)] ELSE w[CAST(ceil(len(w) / 2.0) AS BIGINT) + 1 :] END, ' ') AS text FROM al, (VALUES (0), (1)) t(h) WHERE len(w) > 30)
"""
_ROUTED = "SELECT query_id || '#0' AS query_id, text FROM al WHERE len(w) <= 30 UNION ALL SELECT query_id || '#' || h, text FROM ah"
_ROUTED_SQL = f"""
WITH {_HALVES}, {plan_cte(_ROUTED, dense=True, rerank=True)},
fh AS (SELECT split_part(query_id, '#', 1) AS query_id, CAST(split_part(query_id, '#', 2) AS INTEGER) AS hop, rank, chunk_id FROM final),
fu AS (SELECT query_id, chunk_id, min({{'h': hop, 'r': rank}}) AS m FROM fh GROUP BY ALL),
fr AS (SELECT query_id, chunk_id, m.h AS hop, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m.h, m.r, chunk_id) AS INTEGER) AS rank FROM fu)
"""


def _answered(spark, d):
    asked = _asked(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
    return answer(asked, _indexes(spark, d), preset("router-on"))


@register("retrieve_router_on", f"{_ROUTED_SQL} SELECT query_id, CASE WHEN len(w) <= 30 THEN 's1' ELSE 's2' END AS route, hop, rank, chunk_id FROM fr JOIN al USING (query_id)")
def retrieve_router_on(spark, d):
    """Short items in one step, long ones in two hops; the ranked rows behind the answers."""
    return _answered(spark, d)[1].select("query_id", "route", "hop", "rank", "chunk_id")


@register("answer_router_on", rf"""
{_ROUTED_SQL},
fa AS (SELECT query_id, arg_min(chunk_id, rank) AS top, string_agg(chunk_id, ',' ORDER BY rank) AS chunks FROM fr GROUP BY query_id),
fx AS (SELECT query_id, top, chunks, trim(regexp_extract(text, '(?s)^(.*?[.!?])(\s|$)', 1), ' ') AS answer FROM fa JOIN dc ON chunk_id = top)
SELECT query_id, CASE WHEN len(w) <= 30 THEN 's1' ELSE 's2' END AS route, answer, CASE WHEN answer = '' THEN '' ELSE top END AS cited, chunks, CASE WHEN len(w) <= 30 THEN 1 ELSE 2 END AS hops_used, '' AS flags FROM fx JOIN al USING (query_id)
""")
def answer_router_on(spark, d):
    found = _answered(spark, d)[0]
    return found.select("query_id", "route", "answer", F.array_join("cited", ",").alias("cited"), F.array_join("chunk_ids", ",").alias("chunks"), "hops_used", F.array_join("flags", ",").alias("flags"))


@register("retrieve_degraded", f"""
WITH {plan_cte(ITEMS_SQL, dense=True)},
pa AS (SELECT query_id, CAST(query_id AS BIGINT) % 4 AS k FROM a)
SELECT query_id, chunk_id, round(score, 6) AS score, source, rank, '' AS degraded FROM final JOIN pa USING (query_id) WHERE k = 0
UNION ALL SELECT query_id, chunk_id, score, 'bm25', rank, 'dense-skipped' FROM b JOIN pa USING (query_id) WHERE k = 1 AND rank <= 5
UNION ALL SELECT query_id, chunk_id, score, 'dense', rank, 'bm25-skipped' FROM v JOIN pa USING (query_id) WHERE k = 2 AND rank <= 5
UNION ALL SELECT query_id, '', 0, '', 0, 'failed' FROM pa WHERE k = 3
""")
def retrieve_degraded(spark, d):
    """Components fail for single queries: the dense one, BM25, or both."""
    asked = _asked(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
    k = F.col("query_id").cast("long") % 4
    broken = F.when(k == 1, F.array(F.lit("dense"))).when(k == 2, F.array(F.lit("bm25"))).when(k == 3, F.array(F.lit("bm25"), F.lit("dense")))
    rows, told = retrieve_each(asked, _indexes(spark, d), preset("dense-rrf"), asked.select("query_id", F.explode(broken).alias("component")))
    joined = told.join(rows, "query_id", "left").na.fill({"chunk_id": "", "score": 0.0, "source": "", "rank": 0})
    return joined.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", "rank", F.array_join("degraded", ",").alias("degraded"))


# ---- alignment and metrics


GOLD_CTE = f"""
{BM25_CTE},
g AS (SELECT query_id, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY chunk_id) - 1 AS INTEGER) AS gold_idx, chunk_id AS gold
      FROM (SELECT i.item_id AS query_id, d.doc_id AS chunk_id FROM benchmark i JOIN documents d ON contains(d.text, i.text) WHERE i.text <> '')),
h AS (SELECT g.query_id, gold_idx, rank FROM g JOIN b ON b.query_id = g.query_id AND b.chunk_id = g.gold WHERE rank <= 10)
"""


def _golds(spark, d):
    """Golds (see :func:`_holding`), and retrieved are BM25's ten best."""
    best = search.Bm25Index.build(_chunks(spark, d)).search(_asked(spark, d), 10)
    best = graph.settle(best.select("query_id", "chunk_id", "rank"))
    retrieved = best.where("rank <= 10").select("query_id", "rank", F.col("chunk_id").alias("passage_id"), F.col("chunk_id").alias("doc_id"), F.lit(0).alias("start_token"), F.lit(1).alias("end_token"))
    return retrieved, _holding(spark, d)


def _holding(spark, d):
    """Golds are all documents that hold an item's text."""
    holds = graph.settle(prep.holders(_chunks(spark, d), _asked(spark, d)))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_id")) - 1
    nothing = F.lit(None).cast("int")
    return holds.select("query_id", number.alias("gold_idx"), F.lit("passage").alias("gold_type"), F.col("chunk_id").alias("passage_id"), F.lit(None).cast("long").alias("doc_id"), nothing.alias("gold_start"), nothing.alias("gold_end"))


@register("align_passage_hits", f"WITH {GOLD_CTE} SELECT query_id, gold_idx, rank FROM h")
def align_passage_hits(spark, d):
    return evaluate.hits(*_golds(spark, d))


SPAN_CTE = f"""
t AS (SELECT doc_id, len({TOKENS_SQL}) AS n FROM documents),
g AS (SELECT doc_id AS query_id, doc_id, n // 3 AS s, n // 3 + 1 + n // 4 AS e FROM t WHERE n > 0),
k AS (SELECT doc_id, unnest(range(CASE WHEN n <= 128 THEN 1 ELSE 1 + CAST(ceil((n - 128) / 112.0) AS BIGINT) END)) AS i, n FROM t WHERE n > 0)
"""


@register("align_span_hits", f"""
WITH {SPAN_CTE}
SELECT query_id, 0 AS gold_idx, CAST(i + 1 AS INTEGER) AS rank FROM g JOIN k USING (doc_id) WHERE 2 * (least(least(i * 112 + 128, n), e) - greatest(i * 112, s)) >= e - s
""")
def align_span_hits(spark, d):
    """Each document's own chunks in their order against a span in its middle."""
    chunks = chunking.fixed_chunks(table(spark, d, "documents"), 128, 16)
    retrieved = chunks.select(F.col("doc_id").alias("query_id"), (F.col("position") + 1).alias("rank"), F.lit(None).cast("long").alias("passage_id"), "doc_id", "start_token", "end_token")
    n = F.size(X.tokens(F.col("text")))
    golds = table(spark, d, "documents").withColumn("n", n).where("n > 0")
    golds = golds.select(F.col("doc_id").alias("query_id"), F.lit(0).alias("gold_idx"), F.lit("span").alias("gold_type"), F.lit(None).cast("long").alias("passage_id"), "doc_id", F.expr("cast(n div 3 as int)").alias("gold_start"), F.expr("cast(n div 3 + 1 + n div 4 as int)").alias("gold_end"))
    return evaluate.hits(retrieved, golds)


@register("retrieval_metrics", f"""
WITH {GOLD_CTE},
m AS (SELECT g.query_id, g.gold_idx, h.rank FROM g LEFT JOIN h ON h.query_id = g.query_id AND h.gold_idx = g.gold_idx)
SELECT query_id, count(*) FILTER (WHERE rank <= 5) / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE rank <= 3), 0) AS mrr, min(rank) FILTER (WHERE rank <= 3) AS first_rank FROM m GROUP BY query_id
""")
def retrieval_metrics(spark, d):
    retrieved, golds = _golds(spark, d)
    return evaluate.retrieval_metrics(evaluate.hits(retrieved, golds), golds)


@register("alignment_coverage", f"""
WITH {GOLD_CTE}, m AS (SELECT g.query_id, g.gold_idx, h.rank FROM g LEFT JOIN h ON h.query_id = g.query_id AND h.gold_idx = g.gold_idx),
p AS (SELECT query_id, count(*) AS golds, count(rank) AS hits FROM m GROUP BY query_id)
SELECT CAST(sum(golds) AS BIGINT) AS golds, CAST(sum(hits) AS BIGINT) AS golds_hit, count(*) FILTER (WHERE golds = hits) AS queries_all_hit FROM p
""")
def alignment_coverage(spark, d):
    retrieved, golds = _golds(spark, d)
    return evaluate.alignment_coverage(evaluate.hits(retrieved, golds), golds)


def _pairs(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("gold"))
    return turns.join(after, ["conv_id", "turn"])


PAIRS_SQL = f"p AS (SELECT a.conv_id, a.turn, {norm_sql('a.text')} AS x, {norm_sql('b.text')} AS y FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1)"


@register("exact_match", f"WITH {PAIRS_SQL} SELECT conv_id, turn, CAST(x = y AS DOUBLE) AS em FROM p")
def exact_match(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", X.exact_match(F.col("text"), F.array("gold")).alias("em"))


@register("token_f1", f"""
WITH {PAIRS_SQL},
w AS (SELECT conv_id, turn, list_filter(string_split(x, ' '), lambda t: t <> '') AS x, list_filter(string_split(y, ' '), lambda t: t <> '') AS y FROM p),
s AS (SELECT conv_id, turn, x, y, coalesce(list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda u: u = t)), len(list_filter(y, lambda u: u = t))))), 0) AS same FROM w)
SELECT conv_id, turn, round(CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0::DOUBLE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0::DOUBLE * same / (len(x) + len(y)) END, 9) AS f1 FROM s
""")
def token_f1(spark, d):
    return _pairs(spark, d).select("conv_id", "turn", F.round(X.token_f1(F.col("text"), F.array("gold")), 9).alias("f1"))


@register("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    rows = table(spark, d, "events").groupBy("event_type")
    return rows.agg(evaluate.percentile("value", 0.5).alias("p50"), evaluate.percentile("value", 0.95).alias("p95"), F.count("*").alias("n"))


RESULTS_SQL = """
r AS (SELECT event_id AS query_id, 'run' || CAST(user_id % 3 AS VARCHAR) AS run_id, ['bm25-only', 'dense-rrf', 'contextual', 'rerank', 'graph', 'graph-rrf', 'router-on'][CAST(event_id % 7 AS INTEGER) + 1] AS preset,
      CASE event_id % 11 WHEN 0 THEN 'failed' WHEN 1 THEN 'abstained' ELSE 'ok' END AS status,
      CASE WHEN event_id % 7 = 6 AND event_id % 2 = 0 THEN 's2' WHEN event_id % 7 IN (4, 5) THEN 'graph' ELSE 's1' END AS route,
      CAST(event_id % 5 AS DOUBLE) / 4 AS recall, CAST(event_id % 3 AS DOUBLE) / 2 AS mrr, CAST(event_id % 2 AS DOUBLE) AS em, CAST(event_id % 9 AS DOUBLE) / 8 AS f1, CAST(event_id % 4 AS DOUBLE) / 64 AS usd, value AS latency_ms FROM events)
"""
METRICS_SQL = """
m AS (SELECT run_id, preset, count(*) AS n_total, count(*) FILTER (WHERE status = 'failed') AS n_failed, count(*) FILTER (WHERE status = 'abstained') AS n_abstained,
 count(*) FILTER (WHERE status <> 'failed' AND route = 's1') AS n_s1, count(*) FILTER (WHERE status <> 'failed' AND route = 's2') AS n_s2, count(*) FILTER (WHERE status <> 'failed' AND route = 'graph') AS n_graph,
 avg(recall) FILTER (WHERE status <> 'failed') AS rc, avg(mrr) FILTER (WHERE status <> 'failed') AS mr, avg(em) FILTER (WHERE status <> 'failed') AS em, avg(f1) FILTER (WHERE status <> 'failed') AS f1, avg(usd) FILTER (WHERE status <> 'failed') AS usd_per_query,
 quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95, avg(CAST(recall > 0 AS DOUBLE)) FILTER (WHERE status <> 'failed' AND route = 'graph') AS graph_route_precision FROM r GROUP BY run_id, preset)
"""


def _results(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    presets = F.array(*(F.lit(p) for p in PRESETS))
    share = lambda n, by: (k % n).cast("double") / by
    return e.select(
        k.alias("query_id"), F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"), presets[(k % 7).cast("int")].alias("preset"),
        F.when(k % 11 == 0, "failed").when(k % 11 == 1, "abstained").otherwise("ok").alias("status"),
        F.when((k % 7 == 6) & (k % 2 == 0), "s2").when((k % 7).isin(4, 5), "graph").otherwise("s1").alias("route"),
        share(5, 4).alias("recall"), share(3, 2).alias("mrr"), share(2, 1).alias("em"), share(9, 8).alias("f1"), share(4, 64).alias("usd"), F.col("value").alias("latency_ms"),
    )


@register("run_metrics", f"""
WITH {RESULTS_SQL}, {METRICS_SQL}
SELECT run_id, preset, n_total, n_failed, n_abstained, n_s1, n_s2, n_graph, CASE WHEN n_s2 + n_graph = 0 THEN round(rc, 9) END AS recall_at_5, CASE WHEN n_s2 + n_graph = 0 THEN round(mr, 9) END AS mrr_at_3,
 CASE WHEN n_s2 + n_graph > 0 THEN round(rc, 9) END AS recall_union_of_hops, round(em, 9) AS em, round(f1, 9) AS f1, round(usd_per_query, 9) AS usd_per_query, latency_p50, latency_p95, round(graph_route_precision, 9) AS graph_route_precision FROM m
""")
def run_metrics(spark, d):
    found = evaluate.run_metrics(_results(spark, d))
    return found.withColumns({c: F.round(c, 9) for c in ("recall_at_5", "mrr_at_3", "recall_union_of_hops", "em", "f1", "usd_per_query", "graph_route_precision")})


@register("anchors_delta", f"""
WITH {RESULTS_SQL}, {METRICS_SQL},
l AS (SELECT run_id, preset, 'recall_at_5' AS metric, CASE WHEN n_s2 + n_graph = 0 THEN rc END AS v FROM m UNION ALL SELECT run_id, preset, 'mrr_at_3', CASE WHEN n_s2 + n_graph = 0 THEN mr END FROM m UNION ALL SELECT run_id, preset, 'f1', f1 FROM m),
a(preset, baseline, metric, published) AS (VALUES {", ".join(f"('{p}', '{b}', '{m}', {x}::DOUBLE)" for p, b, m, x, _ in records.ANCHORS)})
SELECT o.run_id, a.preset, a.baseline, a.metric, a.published, round(o.v - b.v, 4) AS measured, (o.v - b.v > 0) = (a.published > 0) AS direction_matches
FROM a JOIN l o ON o.preset = a.preset AND o.metric = a.metric JOIN l b ON b.preset = a.baseline AND b.metric = a.metric AND b.run_id = o.run_id WHERE o.v IS NOT NULL AND b.v IS NOT NULL
""")
def anchors_delta(spark, d):
    return records.anchors(evaluate.run_metrics(_results(spark, d))).drop("source")


@register("receipt_pivot", f"""
WITH {RESULTS_SQL}, {METRICS_SQL}
SELECT preset, max(f1) FILTER (WHERE run_id = 'run0') AS run0, max(f1) FILTER (WHERE run_id = 'run1') AS run1, max(f1) FILTER (WHERE run_id = 'run2') AS run2
FROM (SELECT run_id, preset, round(f1, 6) AS f1 FROM m) GROUP BY preset
""")
def receipt_pivot(spark, d):
    found = evaluate.run_metrics(_results(spark, d)).select("preset", F.col("run_id").alias("source"), F.round("f1", 6).alias("measured"))
    return records.pivot_anchors(found)


@register("cross_index_flag", """
WITH x AS (SELECT 'run' || CAST(user_id % 3 AS VARCHAR) AS run_id, event_id AS ladder, CASE WHEN event_id % 3 > 0 THEN 'h' || CAST(user_id % 2 AS VARCHAR) END AS dense_hash FROM events)
SELECT run_id, ladder, dense_hash, coalesce(dense_hash <> last_value(dense_hash IGNORE NULLS) OVER (PARTITION BY run_id ORDER BY ladder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS cross_index FROM x
""")
def cross_index_flag(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.concat(F.lit("run"), (F.col("user_id") % 3).cast("string")).alias("run_id"), k.alias("ladder"), F.when(k % 3 > 0, F.concat(F.lit("h"), (F.col("user_id") % 2).cast("string"))).alias("dense_hash"))
    return records.cross_index(rows)


@register("strip_per_query", "SELECT event_id AS query_id, [CAST(user_id AS VARCHAR)] AS retrieved_chunk_ids, value AS latency_ms, 0.5::DOUBLE AS usd, CASE WHEN event_id % 2 = 0 THEN ['dense-skipped'] ELSE CAST([] AS VARCHAR[]) END AS flags FROM events")
def strip_per_query(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_id").alias("query_id"), F.array(F.col("user_id").cast("string")).alias("retrieved_chunk_ids"), F.col("value").alias("latency_ms"), F.lit(0.5).alias("usd"),
        F.when(F.col("event_id") % 2 == 0, F.array(F.lit("dense-skipped"))).otherwise(F.array().cast("array<string>")).alias("flags"), F.lit("an answer").alias("answer"), F.lit("s1").alias("route"),
    )
    return records.strip(rows)


@register("union_of_hops", """
WITH f AS (SELECT user_id AS query_id, event_type AS chunk_id, min({'h': event_id % 3, 'r': event_id}) AS m FROM events GROUP BY ALL)
SELECT query_id, chunk_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY m.h, m.r, chunk_id) AS INTEGER) AS rank FROM f
""")
def union_of_hops(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("query_id"), (F.col("event_id") % 3).alias("hop"), F.col("event_id").alias("rank"), F.col("event_type").alias("chunk_id"))
    return evaluate.union_of_hops(rows)


@register("citations_resolve", r"""
WITH a AS (SELECT conv_id AS query_id, '[' || CAST(turn + 1 AS VARCHAR) || '] and [99] ' AS t FROM conversations),
c AS (SELECT query_id, unnest(regexp_extract_all(t, '\[(\d+)\]', 1)) AS n FROM a),
r AS (SELECT conv_id AS query_id, turn + 1 AS rank, role AS chunk_id FROM conversations)
SELECT c.query_id, r.rank, r.chunk_id FROM c JOIN r ON r.query_id = c.query_id AND r.rank = CAST(c.n AS BIGINT)
""")
def citations_resolve(spark, d):
    turns = table(spark, d, "conversations")
    answers = turns.select(F.col("conv_id").alias("query_id"), X.citation_numbers(F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] and [99] "))).alias("citations"))
    retrieved = turns.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.col("role").alias("chunk_id"))
    return evaluate.resolve_citations(answers, retrieved).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id")


@register("numbered_context", "SELECT conv_id, string_agg('[' || CAST(n AS VARCHAR) || '] ' || text, chr(10) || chr(10) ORDER BY n) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def numbered_context(spark, d):
    texts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text)
    return table(spark, d, "conversations").groupBy("conv_id").agg(texts.alias("t")).select("conv_id", X.numbered_context(F.col("t")).alias("context"))


# ---- the graph


def _triples(spark, d):
    """Nations lie in regions; customers' segments belong to nations."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    located = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("chunk_id"), F.col("n_name").alias("subject"), F.lit("in").alias("relation"), F.col("r_name").alias("object"))
    bought = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("chunk_id"), F.col("n_name").alias("subject"), F.lit("buys").alias("relation"), F.concat(F.lit(" Market  "), "c_mktsegment").alias("object"))
    return located.unionByName(bought).withColumn("chunk_id", F.col("chunk_id").cast("long"))


@register("phrase_nodes", f"""
WITH {TRIPLES_SQL}
SELECT CAST(row_number() OVER (ORDER BY kind, ord, key) - 1 AS BIGINT) AS node_id, CASE kind WHEN 0 THEN 'passage' ELSE 'phrase' END AS kind, text FROM (
  SELECT 0 AS kind, CAST(n_nationkey AS BIGINT) AS ord, '' AS key, n_name AS text FROM nation UNION ALL SELECT 1, 0, text, text FROM ph)
""")
def phrase_nodes(spark, d):
    chunks = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("chunk_id"), F.col("n_nationkey").alias("ord"), F.col("n_name").alias("text"))
    return graph.nodes(chunks, _triples(spark, d)).select("node_id", "kind", "text")


def _edge_rows(spark, d):
    named = _triples(spark, d).select(X.normal_phrase(F.col("subject")).alias("a"), X.normal_phrase(F.col("object")).alias("b"), F.col("relation").alias("kind"), (F.col("chunk_id") % 5 + 1).cast("double").alias("weight"))
    return named


EDGES_SQL = f"""
{TRIPLES_SQL},
er AS (SELECT CAST(n_nationkey AS BIGINT) AS c, lower(n_name) AS a, lower(r_name) AS b, 'in' AS kind FROM nation JOIN region ON n_regionkey = r_regionkey
       UNION ALL SELECT c_custkey, lower(n_name), trim(regexp_replace(lower(' Market  ' || c_mktsegment), '\\s+', ' ', 'g')), 'buys' FROM customer JOIN nation ON c_nationkey = n_nationkey),
ed AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, kind, max(CAST(c % 5 + 1 AS DOUBLE)) AS weight FROM er WHERE a <> b GROUP BY ALL),
ad AS (SELECT src, dst, sum(weight) AS weight FROM (SELECT src, dst, weight FROM ed UNION ALL SELECT dst, src, weight FROM ed) GROUP BY ALL)
"""


@register("graph_counts", f"""
WITH {TRIPLES_SQL},
r AS (SELECT DISTINCT least(s, o) AS a, greatest(s, o) AS b FROM tn WHERE s <> o),
p AS (SELECT DISTINCT chunk_id, phrase FROM (SELECT chunk_id, s AS phrase FROM tn UNION ALL SELECT chunk_id, o FROM tn) WHERE chunk_id IN (SELECT doc_id FROM documents))
SELECT (SELECT count(*) FROM documents) AS n_passage, (SELECT count(*) FROM ph) AS n_phrase, (SELECT count(*) FROM r) + (SELECT count(*) FROM p) AS n_edges, (SELECT count(*) FROM tn) AS n_triples
""")
def graph_counts(spark, d):
    chunks = _chunks(spark, d).select(F.col("chunk_id").cast("string").alias("chunk_id"), F.col("chunk_id").alias("ord"), "text")
    triples = _triples(spark, d).withColumn("chunk_id", F.col("chunk_id").cast("string"))
    nodes = graph.settle(graph.nodes(chunks, triples))
    return graph.build_counts(nodes, graph.edges(nodes, triples), triples)


@register("edge_dedupe", f"WITH {EDGES_SQL} SELECT src, dst, kind, weight FROM ed")
def edge_dedupe(spark, d):
    return graph.dedupe_edges(_edge_rows(spark, d))


@register("adjacency_sum", f"WITH {EDGES_SQL} SELECT src, dst, weight FROM ad")
def adjacency_sum(spark, d):
    return graph.adjacency(graph.dedupe_edges(_edge_rows(spark, d)))


LONG_WORD, DIMENSIONS = 8, 64


@register("synonym_join", f"""
WITH w AS (SELECT doc_id, unnest(list_distinct(list_filter({TOKENS_SQL}, lambda t: length(t) >= {LONG_WORD}))) AS word FROM documents),
h AS (SELECT doc_id, md5(word) AS m FROM w),
x AS (SELECT doc_id, ((instr('0123456789abcdef', m[1:1]) - 1) * 16 + instr('0123456789abcdef', m[2:2]) - 1) % {DIMENSIONS} AS d, CAST(sum(CASE WHEN m[3:3] < '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM h GROUP BY ALL),
n AS (SELECT doc_id, sqrt(sum(x * x)) AS size FROM x GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(a.x * b.x) AS dot FROM x a JOIN x b ON a.d = b.d AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT a, b, round(dot / (m.size * n.size), 6) AS weight FROM p JOIN n m ON m.doc_id = a JOIN n ON n.doc_id = b WHERE m.size > 0 AND n.size > 0 AND dot / (m.size * n.size) >= 0.85
""")
def synonym_join(spark, d):
    """Near vectors of signed counts of each document's different long words: its near copies."""
    words = F.array_distinct(F.filter(X.tokens(F.col("text")), lambda t: F.length(t) >= LONG_WORD))
    digest = table(spark, d, "documents").select("doc_id", F.explode(words).alias("word")).select("doc_id", F.md5(F.col("word").cast("binary")).alias("m"))
    place = (F.conv(F.substring("m", 1, 2), 16, 10).cast("int") % DIMENSIONS).alias("d")
    counts = digest.groupBy("doc_id", place).agg(F.sum(F.when(F.substring("m", 3, 1) < "8", 1.0).otherwise(-1.0)).alias("x"))
    cells = counts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("d", "x"))).alias("cells"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda i: F.coalesce(F.try_element_at("cells", i), F.lit(0.0)))
    return graph.synonym_pairs(cells.select("doc_id", vector.alias("vector")), 0.85, "doc_id").select("a", "b", F.round("weight", 6).alias("weight"))


def _ppr_sql() -> str:
    """The rounds of PageRank, one common table expression each."""
    parts = [EDGES_SQL, "o AS (SELECT src, sum(weight) AS w FROM ad GROUP BY src)",
             "p AS (SELECT q AS query_id, lower(n_name) AS node, m / sum(m) OVER (PARTITION BY q) AS p FROM (SELECT n_regionkey AS q, n_name, CAST(n_nationkey + 1 AS DOUBLE) AS m FROM nation))",
             "x0 AS (SELECT query_id, node, p AS m FROM p)"]
    for k in range(graph.ROUNDS):
        parts.append(
            f"x{k + 1} AS MATERIALIZED (SELECT query_id, node, sum(m) AS m FROM (SELECT query_id, ad.dst AS node, 0.5 * m * weight / w AS m FROM x{k} JOIN ad ON ad.src = node JOIN o ON o.src = ad.src "
            "UNION ALL SELECT query_id, node, 0.5 * p FROM p) GROUP BY ALL)"
        )
    return f"WITH {', '.join(parts)} SELECT query_id, node AS node_id, round(m, 6) AS mass FROM x{graph.ROUNDS}"


@register("ppr_fixed_rounds", _ppr_sql())
def ppr_fixed_rounds(spark, d):
    """One query for each region, its nations the seeds."""
    undirected = graph.dedupe_edges(_edge_rows(spark, d))
    adj = graph.settle(graph.adjacency(undirected))
    seeds = table(spark, d, "nation").select(F.col("n_regionkey").alias("query_id"), F.lower("n_name").alias("node_id"), (F.col("n_nationkey") + 1).cast("double").alias("mass"))
    nodes = adj.select(F.col("src").alias("node_id")).distinct()
    return graph.pagerank(adj, nodes, seeds).select("query_id", "node_id", F.round("mass", 6).alias("mass"))


# ---- preparation


@register("majority_vote", """
WITH v AS (SELECT user_id AS example_id, event_id % 4 AS s, event_id % 4 + 10 AS e, count(*) AS n FROM events WHERE event_id % 5 > 0 GROUP BY ALL),
t AS (SELECT example_id, CAST(sum(n) AS BIGINT) AS n, min({'a': -n, 'b': s, 'c': e}) AS best FROM v GROUP BY example_id)
SELECT example_id, best.b AS start_token, best.c AS end_token, n FROM t WHERE n >= 2
""")
def majority_vote(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").alias("example_id"), F.when(k % 5 > 0, k % 4).alias("start_token"), (k % 4 + 10).alias("end_token"))
    return prep.majority_spans(rows)


@register("html_span_remap", r"""
WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM documents),
h AS (SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN 0 ELSE len(list_filter(regexp_split_to_array(token, '\s+'), lambda x: x <> '')) END AS parts FROM t),
b AS (SELECT doc_id, pos, parts, coalesce(sum(parts) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h),
v AS (SELECT doc_id, pos, CASE WHEN parts > 0 THEN before END AS s, CASE WHEN parts > 0 THEN before + parts END AS e FROM b)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_token, CAST(max(e) AS BIGINT) AS end_token FROM v WHERE pos >= 3 AND pos < 20 GROUP BY doc_id
""")
def html_span_remap(spark, d):
    """Every seventh blank-separated token counts as markup; the span is tokens 3 to 20."""
    docs = table(spark, d, "documents")
    tokens = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "token")).withColumn("is_html", F.col("pos") % 7 == 0)
    spans = docs.select("doc_id", F.lit(3).alias("first"), F.lit(20).alias("last"))
    return prep.remap_spans(spans, prep.visible_spans(tokens)).select("doc_id", F.col("start_token").cast("long").alias("start_token"), F.col("end_token").cast("long").alias("end_token"))


@register("support_mismatch", """
SELECT user_id, list_sort(list_distinct(list(event_id % 3))) <> list_sort(list_distinct(list(event_id % 2))) AS differs FROM events GROUP BY user_id
""")
def support_mismatch(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 3).alias("a"), F.collect_set(F.col("event_id") % 2).alias("b"))
    return g.select("user_id", prep.support_mismatch(F.col("a"), F.col("b")).alias("differs"))


@register("first_documents", "SELECT source, min(doc_id) AS ord, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def first_documents(spark, d):
    return prep.first_documents(table(spark, d, "documents").select("source", F.col("doc_id").alias("ord"), "lang"), "source").select("source", "ord", "lang")


# ---- costs, ledgers, logs


TRACE_SQL = "e AS (SELECT user_id AS trace_id, ['answer', 'small', 'embed', NULL][CAST(event_id % 4 AS INTEGER) + 1] AS model, event_id % 1000 AS i, event_id % 100 AS o FROM events)"


def _trace(spark, d):
    k = F.col("event_id")
    model = F.element_at(F.array(F.lit("answer"), F.lit("small"), F.lit("embed"), F.lit(None).cast("string")), (k % 4 + 1).cast("int"))
    return table(spark, d, "events").select(F.col("user_id").alias("trace_id"), model.alias("model"), (k % 1000).alias("input_tokens"), (k % 100).alias("output_tokens"))


@register("token_cost", f"""
WITH {TRACE_SQL}, c(model, a, b) AS (VALUES {", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, (a, b) in costs.PRICES.items())})
SELECT trace_id, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(sum(o) AS BIGINT) AS output_tokens, round(sum(CASE WHEN model IS NULL THEN 0 ELSE (i * a + o * b) / 1e6 END), 9) AS usd FROM e LEFT JOIN c USING (model) GROUP BY trace_id
""")
def token_cost(spark, d):
    return costs.trace_totals(_trace(spark, d)).select("trace_id", "input_tokens", "output_tokens", F.round("usd", 9).alias("usd"))


@register("cost_estimate", "SELECT preset, count(*) AS n, round(count(*) * usd, 6) AS usd FROM benchmark, (VALUES " + ", ".join(f"('{n}', {costs.query_usd(p)!r}::DOUBLE)" for n, p in PRESETS.items()) + ") t(preset, usd) WHERE text IS NOT NULL GROUP BY preset, usd")
def cost_estimate(spark, d):
    """What a run of each preset over all items is expected to cost at most."""
    return costs.estimates(_asked(spark, d).where("query is not null"), list(PRESETS.values())).select("preset", "n", F.round("usd", 6).alias("usd"))


@register("spend_cap_prefix", """
WITH x AS (SELECT user_id AS run_id, event_id, 0.0045::DOUBLE AS usd, 0.0144::DOUBLE AS est, 0.06::DOUBLE AS cap FROM events),
y AS (SELECT *, coalesce(sum(usd) OVER (PARTITION BY run_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM x)
SELECT run_id, event_id, max(CAST(round(spent + est, 9) > cap AS INTEGER)) OVER (PARTITION BY run_id ORDER BY event_id) = 0 AS admitted FROM y
""")
def spend_cap_prefix(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("run_id"), "event_id", F.lit(0.0045).alias("usd"), F.lit(0.0144).alias("est"), F.lit(0.06).alias("cap"))
    return ledger.within_cap(rows, "run_id", ["event_id"], "usd", "est", "cap").select("run_id", "event_id", "admitted")


def _epoch(spark, d):
    """Whole seconds, whatever the session's time zone."""
    seconds = F.unix_date(F.to_date("ts")).cast("long") * 86_400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    return table(spark, d, "events").select("event_id", "user_id", seconds.alias("s"))


EPOCH_SQL = "e AS (SELECT event_id, user_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS s FROM events)"


@register("rate_limit_minute", f"""
WITH {EPOCH_SQL}
SELECT event_id, CAST(count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, s) - count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 3600 PRECEDING AND 3600 PRECEDING) AS BIGINT) AS recent FROM e
""")
def rate_limit_minute(spark, d):
    """An hour for a minute: the test events lie far apart."""
    return ledger.minute_counts(_epoch(spark, d), "user_id", "s", 3600).select("event_id", "recent")


@register("rate_limit_day", f"""
WITH {EPOCH_SQL}, f AS (SELECT *, strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS day FROM e)
SELECT event_id, day, CAST(count(*) OVER (PARTITION BY user_id, day ORDER BY s RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY user_id, s) AS BIGINT) AS today FROM f
""")
def rate_limit_day(spark, d):
    return ledger.day_counts(_epoch(spark, d), "user_id", "s").select("event_id", "day", "today")


@register("budget_day", f"WITH {EPOCH_SQL} SELECT strftime(make_timestamp(s * 1000000), '%Y-%m-%d') AS day, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 0.02::DOUBLE, 6) AS usd, round(CAST(count(*) AS DOUBLE) * 0.02::DOUBLE, 6) >= 2.0 AS spent FROM e GROUP BY day")
def budget_day(spark, d):
    day = ledger.utc_day(F.col("s"))
    usd = F.round(F.count("*") * 0.02, 6)
    return _epoch(spark, d).groupBy(day.alias("day")).agg(F.count("*").alias("n"), usd.alias("usd"), (usd >= ledger.BUDGET).alias("spent"))


@register("job_last_status", """
WITH l AS (SELECT user_id AS job_id, max({'t': ts, 'i': event_id, 's': event_type}) AS m, count(*) AS n FROM events GROUP BY user_id)
SELECT job_id, m.s AS status, n AS n_events FROM l
""")
def job_last_status(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.struct("ts", "event_id").alias("at"), F.col("event_type").alias("status"))
    return ledger.last_status(rows, at="at").select("job_id", "status", "n_events")


@register("trace_seq", "SELECT user_id AS trace_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS seq FROM events")
def trace_seq(spark, d):
    return ledger.numbered(table(spark, d, "events").select(F.col("user_id").alias("trace_id"), "event_id", "ts"), "trace_id", ["ts", "event_id"]).select("trace_id", "event_id", "seq")


@register("resume_antijoin", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_antijoin(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.when(F.col("toxic") == 1, "failed").otherwise("ok").alias("status"))
    return ledger.resume(table(spark, d, "documents").select("doc_id"), done, ["doc_id"])


@register("result_upsert", "SELECT d.doc_id, coalesce(l.quality, -1) AS quality FROM (SELECT DISTINCT doc_id FROM documents UNION SELECT doc_id FROM labels) d LEFT JOIN labels l USING (doc_id)")
def result_upsert(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality")).distinct()
    return ledger.upsert(old, table(spark, d, "labels").select("doc_id", "quality"), ["doc_id"])


# ---- the agent


def _states(spark, d):
    k = F.col("event_id")
    words = F.array(F.lit("a"), F.lit("b"), F.lit("c"))
    none = F.array().cast("array<string>")
    return table(spark, d, "events").select(
        k.alias("query_id"), F.slice(words, 1, (k % 3 + 1).cast("int")).alias("subqueries"), F.least((k % 2).cast("int"), (k % 3).cast("int")).alias("hop_index"), (k % 4).cast("int").alias("hops_used"),
        (k % 7 * 10_000).alias("tokens_used"), F.lit(None).cast("string").alias("refined_query"), (k % 5 == 0).alias("contradiction_retried"), F.lit(False).alias("contradiction_flag"),
        F.lit(False).alias("exhausted"), none.alias("unresolved"), F.lit("grade").alias("next"), F.element_at(F.array(F.lit("sufficient"), F.lit("insufficient"), F.lit("contradictory")), (k % 3 + 1).cast("int")).alias("verdict"),
    )


@register("grade_transitions", """
WITH s AS (SELECT event_id AS query_id, ['a', 'b', 'c'][1:CAST(event_id % 3 + 1 AS INTEGER)] AS sq, least(event_id % 2, event_id % 3) AS h, event_id % 4 AS used, event_id % 7 * 10000 AS tok, event_id % 5 = 0 AS retried,
 ['sufficient', 'insufficient', 'contradictory'][CAST(event_id % 3 + 1 AS INTEGER)] AS v FROM events),
t AS (SELECT *, used < 3 AND tok < 50000 AS budget, len(sq) > h + 1 AS more FROM s),
u AS (SELECT *, v = 'contradictory' AND NOT retried AND budget AS again FROM t),
w AS (SELECT *, (v = 'sufficient' OR (v = 'contradictory' AND NOT again)) AS good FROM u)
SELECT query_id, CASE WHEN again OR (good AND more AND budget) THEN 'retrieve_hop' WHEN v = 'insufficient' AND budget THEN 'refine' ELSE 'synthesise' END AS next,
 CAST(h + CASE WHEN good AND more AND budget THEN 1 ELSE 0 END AS INTEGER) AS hop_index, (good AND more AND NOT budget) OR (v = 'insufficient' AND NOT budget) AS exhausted,
 array_to_string(CASE WHEN good AND more AND NOT budget THEN sq[CAST(h + 2 AS INTEGER):] WHEN v = 'insufficient' AND NOT budget THEN sq[CAST(h + 1 AS INTEGER):] ELSE [] END, ',') AS unresolved,
 v = 'contradictory' AND NOT again AS contradiction_flag FROM w
""")
def grade_transitions(spark, d):
    return agent.grade(_states(spark, d), F.col("verdict")).select("query_id", "next", "hop_index", "exhausted", F.array_join("unresolved", ",").alias("unresolved"), "contradiction_flag")


@register("route_decide", """
WITH r AS (SELECT event_id, ['simple', 'complex', 'graph'][CAST(event_id % 3 + 1 AS INTEGER)] AS route, event_id % 10 / 10 AS c FROM events)
SELECT event_id, CASE WHEN route = 'graph' THEN 'graph_retrieve' WHEN route = 'complex' OR c < 0.7 THEN 'decompose' ELSE 's1_retrieve' END AS with_graph,
 CASE WHEN route = 'complex' OR c < 0.7 THEN 'decompose' ELSE 's1_retrieve' END AS without_graph FROM r
""")
def route_decide(spark, d):
    k = F.col("event_id")
    route = F.element_at(F.array(F.lit("simple"), F.lit("complex"), F.lit("graph")), (k % 3 + 1).cast("int"))
    confidence = (k % 10) / 10
    return table(spark, d, "events").select("event_id", agent.after_route(route, confidence, True).alias("with_graph"), agent.after_route(route, confidence, False).alias("without_graph"))


@register("agent_loop", f"""
WITH h AS (SELECT item_id, k, CASE k WHEN 0 THEN substr(text, 1, length(text) // 2) ELSE substr(text, length(text) // 2 + 1) END AS text FROM benchmark, (VALUES (0), (1)) t(k)),
{plan_cte("SELECT item_id || '#' || k AS query_id, text FROM h", k=5)},
n AS (SELECT query_id, count(*) >= 5 AS good FROM final GROUP BY query_id),
g AS (SELECT CAST(item_id AS VARCHAR) AS query_id, coalesce(bool_or(good) FILTER (k = 0), false) AS g0, coalesce(bool_or(good) FILTER (k = 1), false) AS g1, min(h.text) FILTER (k = 0) AS h0, min(h.text) FILTER (k = 1) AS h1
      FROM h LEFT JOIN n ON n.query_id = item_id || '#' || k GROUP BY item_id)
SELECT query_id, 'synthesise' AS next, CAST(CASE WHEN g0 AND g1 THEN 2 ELSE 3 END AS INTEGER) AS hops_used, CAST(CASE WHEN g0 AND g1 THEN 200 ELSE 250 END AS BIGINT) AS tokens_used, NOT (g0 AND g1) AS exhausted,
       CASE WHEN g0 AND g1 THEN '' WHEN g0 THEN h1 WHEN h0 = h1 THEN h0 ELSE h0 || '|' || h1 END AS unresolved FROM g
""")
def agent_loop(spark, d):
    """Items as questions, their halves as sub-queries; a hop suffices when it finds five chunks."""
    index = search.Bm25Index.build(_chunks(spark, d))
    asked = _asked(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
    half = F.floor(F.length("query") / 2).cast("int")

    def decompose(q):
        return q.select("query_id", F.array(F.substring("query", F.lit(1), half), F.substring("query", half + 1, F.length("query"))).alias("subqueries"), F.lit(100).alias("tokens"))

    def retrieve_hop(q):
        return index.search(q, 5)

    def judge(q, rows):
        best = rows.groupBy("query_id").agg(F.count("*").alias("n"))
        verdict = F.when(F.coalesce("n", F.lit(0)) >= 5, "sufficient").otherwise("insufficient")
        return q.join(best, "query_id", "left").select("query_id", verdict.alias("verdict"), F.col("query").alias("refined"), F.lit(50).alias("tokens"))

    states, _ = agent.Loop(decompose, retrieve_hop, judge).run(asked)
    return states.select("query_id", "next", "hops_used", "tokens_used", "exhausted", F.array_join("unresolved", "|").alias("unresolved"))


@register("seeded_selection", """
SELECT doc_id, CAST(row_number() OVER (ORDER BY k, doc_id) - 1 AS INTEGER) AS ord FROM (SELECT doc_id, md5('13:' || CAST(doc_id AS VARCHAR)) AS k FROM documents ORDER BY k, doc_id LIMIT 50)
""")
def seeded_selection(spark, d):
    """A sampling operator: fifty documents."""
    return prep.seeded_selection(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


@register("gold_span_stats", f"""
WITH {SPAN_CTE} SELECT count(*) AS spans, CAST(min(e - s) AS INTEGER) AS least, CAST(quantile_disc(e - s, 0.5) AS INTEGER) AS median, CAST(max(e - s) AS INTEGER) AS most FROM g
""")
def gold_span_stats(spark, d):
    docs = table(spark, d, "documents").withColumn("n", F.size(X.tokens(F.col("text")))).where("n > 0")
    golds = docs.select(F.lit("span").alias("gold_type"), F.expr("cast(n div 3 as int)").alias("gold_start"), F.expr("cast(n div 3 + 1 + n div 4 as int)").alias("gold_end"))
    return prep.span_statistics(golds)


@register("annotated_pages", r"""
WITH t AS (SELECT page_id, page_id % 5 + 1 AS a, unnest(string_split(html, ' ')) AS token, generate_subscripts(string_split(html, ' '), 1) - 1 AS pos FROM pages),
w AS (SELECT page_id, a, pos, CASE WHEN starts_with(token, '<') THEN [] ELSE list_filter(regexp_split_to_array(token, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') END AS words FROM t),
b AS (SELECT *, len(words) AS parts, coalesce(sum(len(words)) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w),
g AS (SELECT page_id, min(before) AS s, max(before + parts) AS e FROM b WHERE parts > 0 AND pos >= a AND pos < a + 8 GROUP BY page_id),
x AS (SELECT page_id, string_agg(array_to_string(words, ' '), ' ' ORDER BY pos) FILTER (parts > 0) AS text FROM b GROUP BY page_id)
SELECT CAST(page_id AS VARCHAR) AS query_id, 'nq-' || left(sha1(text), 16) AS doc_id, CAST(s AS INTEGER) AS gold_start, CAST(e AS INTEGER) AS gold_end FROM g JOIN x USING (page_id) WHERE e - s <= 1024
""")
def annotated_pages(spark, d):
    """Pages of blank-separated tokens, tags as markup, three made-up annotators: two agree on most."""
    token = F.transform(F.split("html", " "), lambda t: F.struct(t.alias("token"), t.startswith("<").alias("is_html")))
    k = F.col("page_id").cast("int")
    one = lambda s, i: F.struct((k % 5 + s).alias("start_token"), (k % 5 + s + 8).alias("end_token"), F.lit(i).alias("candidate_index"), F.array(F.lit("a")).alias("short_answers"))
    examples = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("example_id"), F.col("url").alias("title"), F.lit("q").alias("question"), token.alias("tokens"), F.array(one(1, 0), one(1, 0), one(3, F.lit(0))).alias("annotations"))
    return prep.annotated_pages(examples)[0].select("query_id", "doc_id", "gold_start", "gold_end")


@register("hop_context", """
WITH f AS (SELECT conv_id AS query_id, role AS chunk_id, min({'h': turn % 2, 'r': turn, 'q': 'part ' || CAST(turn % 2 AS VARCHAR)}) AS m FROM conversations GROUP BY ALL),
n AS (SELECT query_id, chunk_id, m.q AS q, row_number() OVER (PARTITION BY query_id ORDER BY m.h, m.r, chunk_id) AS n FROM f)
SELECT query_id, string_agg('[' || CAST(n AS VARCHAR) || '] (' || q || ') text of ' || chunk_id, chr(10) || chr(10) ORDER BY n) AS context FROM n GROUP BY query_id
""")
def hop_context(spark, d):
    turns = table(spark, d, "conversations")
    rows = turns.select(F.col("conv_id").alias("query_id"), (F.col("turn") % 2).alias("hop"), F.col("turn").alias("rank"), F.col("role").alias("chunk_id"), F.concat(F.lit("part "), (F.col("turn") % 2).cast("string")).alias("subquery"))
    texts = turns.select(F.col("role").alias("chunk_id")).distinct().withColumn("text", F.concat(F.lit("text of "), F.col("chunk_id")))
    return evaluate.hop_context(rows, texts)


@register("judged_means", f"""
WITH {RESULTS_SQL} SELECT run_id, preset, round(avg(em) FILTER (WHERE status = 'ok'), 9) AS faithfulness, round(avg(f1) FILTER (WHERE status = 'ok'), 9) AS relevancy, true AS judge_spend_untracked FROM r GROUP BY run_id, preset
""")
def judged_means(spark, d):
    judged = _results(spark, d).select("run_id", "preset", "status", F.col("em").alias("faithfulness"), F.col("f1").alias("relevancy"))
    found = evaluate.judged_means(judged)
    return found.withColumns({"faithfulness": F.round("faithfulness", 9), "relevancy": F.round("relevancy", 9)})


def _streamed(spark, frame, mode: str) -> DataFrame:
    """What a stream over all present files says at its end, kept in the checkpoint folder."""
    import uuid

    graph.settle(spark.range(1))  # an own folder only where none is set
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    place = f"{place}/siftwell/stream-{uuid.uuid4().hex}"

    def keep(batch, number):
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{place}/rows")

    frame.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{place}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/rows")


def _event_stream(spark, d):
    rows = table(spark, d, "events")
    return spark.readStream.schema(rows.schema).parquet(f"{d}/events*.parquet")


@register("stream_last_status", """
WITH l AS (SELECT user_id, max({'t': ts, 'i': event_id, 's': event_type}) AS m FROM events GROUP BY user_id) SELECT user_id, m.s AS status FROM l
""")
def stream_last_status(spark, d):
    from siftwell.streaming import logs

    return _streamed(spark, logs.last_status(_event_stream(spark, d)), "complete").select("user_id", "status")


@register("stream_append_log", "SELECT event_id, event_type FROM events")
def stream_append_log(spark, d):
    return _streamed(spark, _event_stream(spark, d), "append").select("event_id", "event_type")
