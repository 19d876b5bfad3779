"""Vector families over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S, text as X
from citeloom.operators import search as Q, vectors as V
from citeloom.session import cut_lineage, dealt

from .registry import query
from .scalar_plans import _in

# One query vector per label: its first vector.
_QUERIES = "q AS (SELECT MIN(vec_id) AS query_id, label FROM embeddings GROUP BY label), qv AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS qe, q.label FROM q JOIN embeddings ON vec_id = query_id)"
_SIM = "round(list_cosine_similarity(qe, CAST(embedding AS DOUBLE[])), 6)"


def _label_queries(t):
    first = t("embeddings").groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return t("embeddings").join(first.select("vec_id"), "vec_id")


@query("semantic_topk", f"""
WITH {_QUERIES}, s AS (SELECT query_id, vec_id, {_SIM} AS score FROM embeddings, qv)
SELECT query_id, vec_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score > 0) WHERE rn <= 5""")
def semantic_topk(t):
    return V.semantic_topk(t("embeddings"), _label_queries(t).withColumnRenamed("vec_id", "query_id"), 5)


@query("filtered_vector_topk", f"""
WITH {_QUERIES}, s AS (SELECT query_id, vec_id, {_SIM} AS score FROM embeddings e, qv WHERE e.label = 3)
SELECT query_id, vec_id, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score > 0) WHERE rn <= 5""")
def filtered_vector_topk(t):
    return V.semantic_topk(t("embeddings").filter("label = 3"), _label_queries(t).withColumnRenamed("vec_id", "query_id"), 5)


@query("cosine_pairs", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_pairs(t):
    e = t("embeddings").select("vec_id", "embedding")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", S.rounded(V.cosine(F.col("embedding"), F.col("other")), 6).alias("cosine"))


@query("cosine_matrix", f"WITH {_QUERIES} SELECT vec_id, query_id, {_SIM} AS similarity FROM embeddings, qv")
def cosine_matrix(t):
    m = V.cosine_matrix(t("embeddings"), _label_queries(t).withColumnRenamed("vec_id", "query_id"))
    return m.withColumn("similarity", S.rounded(F.col("similarity"), 6))


_PAIRS = """p AS (SELECT a.vec_id AS id, b.vec_id AS other, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, other) AS rn FROM p WHERE s >= 0.35)"""


@query("vector_neighbours", f"WITH {_PAIRS} SELECT id, other, CAST(rn AS INT) AS rank, round(s, 6) AS similarity FROM r WHERE rn <= 5")
def vector_neighbours(t):
    return V.neighbours(t("embeddings"), 5, 0.35).withColumn("similarity", S.rounded(F.col("similarity"), 6))


@query("near_duplicates", f"WITH {_PAIRS} SELECT least(id, other) AS a, greatest(id, other) AS b, round(MAX(s), 6) AS similarity FROM r WHERE rn <= 5 GROUP BY 1, 2")
def near_duplicates(t):
    return V.near_duplicates(t("embeddings"), 0.35).withColumn("similarity", S.rounded(F.col("similarity"), 6))


@query("code_neighbors", f"""
WITH {_QUERIES}, s AS (SELECT query_id, vec_id, {_SIM} AS score, e.label AS name, vec_id % 17 AS nt, qv.label AS qn, query_id % 17 AS qt FROM embeddings e, qv WHERE vec_id <> query_id)
SELECT query_id, vec_id, CAST(rn AS INT) AS rank, score, CASE WHEN name = qn THEN 'name' WHEN abs(nt - qt) < 5 THEN 'structural' ELSE 'semantic' END AS match_type
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rn FROM s WHERE score > 0) WHERE rn <= 10""")
def code_neighbors(t):
    named = lambda df: df.select("vec_id", "embedding", F.col("label").alias("name"), (F.col("vec_id") % 17).alias("n_tokens"))
    return V.code_neighbours(named(t("embeddings")), named(_label_queries(t)), 10)


_EMB_TOKENS = f"[w for w in regexp_extract_all(lower(text), '[a-z0-9_]+') if length(w) > 1 and w not in ({_in(K.EMBED_STOP_WORDS)})]"


def _embed_counts(t, drop=True):
    docs = dealt(t("documents").select("doc_id", "text"), "doc_id", V.TEXT_ROWS)
    return Q.term_counts(docs, "doc_id", X.identifier_tokens(F.col("text"), drop))


def _unit_sql(key: str) -> str:
    return f"SELECT {key}, idx, round(w / sqrt(SUM(w * w) OVER (PARTITION BY {key})), 6) AS value FROM v WHERE w <> 0"


@query("hash_embed_sha", f"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS n FROM tk GROUP BY 1, 2),
v AS (SELECT doc_id, CAST(CAST('0x' || substring(sha256(term), 1, 8) AS BIGINT) % 768 AS INT) AS idx, SUM(n) AS w FROM c GROUP BY 1, 2) {_unit_sql('doc_id')}""")
def hash_embed_sha(t):
    return V.hash_embed_sha(_embed_counts(t, False), "doc_id").withColumn("value", S.rounded(F.col("value"), 6))


@query("hash_embed_signed", f"""
WITH tk AS (SELECT doc_id, unnest({_EMB_TOKENS}) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS n FROM tk GROUP BY 1, 2),
h AS (SELECT doc_id, n, CAST('0x' || right(md5(term), 4) AS BIGINT) AS x FROM c),
v AS (SELECT doc_id, CAST(x % 512 AS INT) AS idx, SUM(CASE WHEN (x // 512) % 2 = 0 THEN n ELSE -n END) AS w FROM h GROUP BY 1, 2) {_unit_sql('doc_id')}""")
def hash_embed_signed(t):
    return V.hash_embed_signed(_embed_counts(t), "doc_id").withColumn("value", S.rounded(F.col("value"), 6))


@query("hash_embed_code", f"""
WITH tk AS (SELECT p_partkey, string_split(lower(p_name), ' ') AS ts FROM part), e AS (SELECT p_partkey, len(ts) AS n, unnest(ts) AS token, generate_subscripts(ts, 1) - 1 AS pos FROM tk),
b AS (SELECT p_partkey, (n - pos) / n AS w, CAST(CAST('0x' || substring(sha256(token), j * 8 + 1, 8) AS BIGINT) % 512 AS INT) AS idx FROM e, range(8) r(j)),
v AS (SELECT p_partkey, idx, SUM(w) AS w FROM b GROUP BY 1, 2) {_unit_sql('p_partkey')}""")
def hash_embed_code(t):
    return V.hash_embed_code(t("part"), "p_partkey", X.code_tokens(F.col("p_name"))).withColumn("value", S.rounded(F.col("value"), 6))


@query("hash_embed_text", """
WITH r AS (SELECT item_id, i, CAST('0x' || substring(sha256(i || ':' || text), 1, 8) AS BIGINT) / 4294967296 AS x FROM benchmark, range(512) g(i))
SELECT item_id, CAST(i AS INT) AS i, round(x / sqrt(SUM(x * x) OVER (PARTITION BY item_id)), 6) AS value FROM r""")
def hash_embed_text(t):
    e = V.hash_embed_text(t("benchmark"), "item_id", F.col("text"))
    return e.select("item_id", F.posexplode("embedding").alias("i", "value")).withColumn("value", S.rounded(F.col("value"), 6))


@query("tfidf_embed", f"""
WITH tk AS (SELECT doc_id, unnest({_EMB_TOKENS}) AS term FROM documents), c AS (SELECT doc_id, term, COUNT(*) AS n FROM tk GROUP BY 1, 2),
d AS (SELECT term, COUNT(*) AS df FROM c GROUP BY term ORDER BY df DESC, term LIMIT 2048), vo AS (SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS idx, ln((1 + (SELECT COUNT(*) FROM documents)) / (1 + df)) + 1 AS idf FROM d),
tt AS (SELECT doc_id, SUM(n) AS total FROM c GROUP BY doc_id), v AS (SELECT doc_id, CAST(idx AS INT) AS idx, n / total * idf AS w FROM c JOIN vo USING (term) JOIN tt USING (doc_id)) {_unit_sql('doc_id')}""")
def tfidf_embed(t):
    n = t("documents").count()
    return V.tfidf_embed(_embed_counts(t), "doc_id", n).withColumn("value", S.rounded(F.col("value"), 6))


@query("tfidf_embed_code")
def tfidf_embed_code(t):
    lines = t("code_lines").select("row_id", "content")
    counts = Q.term_counts(dealt(lines, "row_id", V.CODE_ROWS), "row_id", X.code_tokens(F.col("content")))
    idf = cut_lineage(Q.document_frequency(counts, lines.count()))
    return V.tfidf_embed_code(counts, "row_id", idf).withColumn("value", S.rounded(F.col("value"), 6))


@query("model_embed", """
WITH tk AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM conversations),
h AS (SELECT conv_id, turn, CAST(CAST('0x' || substring(sha256(term), 1, 8) AS BIGINT) % 768 AS INT) AS idx, COUNT(*) AS n FROM tk GROUP BY 1, 2, 3)
SELECT conv_id, turn, idx, round(n / sqrt(SUM(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS value FROM h""")
def model_embed(t):
    e = t("conversations").select("conv_id", "turn", F.posexplode(V.model_embed(F.col("text"))).alias("idx", "value"))
    return e.filter("value <> 0").withColumn("value", S.rounded(F.col("value"), 6))
