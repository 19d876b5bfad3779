"""Chunking, extraction and extension families over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S, text as X
from citeloom.operators import documents as C, extensions as E, vectors as V

from .registry import query
from .scalar_plans import _METRIC_NAME_SQL, _NAME_SQL, _cascade, _in
from .views import AS_OF

NOW = f"TIMESTAMP '{AS_OF}'"
_LINES = "l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents)"


@query("chunk_lines", f"""
WITH {_LINES}, c AS (SELECT doc_id, ls, unnest(range(0, len(ls), 8)) AS st FROM l), d AS (SELECT doc_id, CAST(st // 8 AS INT) AS chunk_index, st, len(ls) AS n, array_to_string(ls[st + 1:st + 10], chr(10)) AS content FROM c)
SELECT doc_id, chunk_index, CAST(st + 1 AS INT) AS start_line, CAST(least(st + 10, n) AS INT) AS end_line, substring(md5(content), 1, 16) AS chunk_id FROM d""")
def chunk_lines(t):
    return C.chunk_lines(t("documents"), "doc_id", "text", 10, 2).select("doc_id", "chunk_index", "start_line", "end_line", "chunk_id")


@query("chunk_store", f"""
WITH {_LINES}, c AS (SELECT doc_id, ls, unnest(range(0, len(ls), 8)) AS st FROM l), d AS (SELECT doc_id, CAST(st // 8 AS INT) AS chunk_index, substring(md5(array_to_string(ls[st + 1:st + 10], chr(10))), 1, 16) AS chunk_id FROM c)
SELECT chunk_id, doc_id, chunk_index FROM d QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id DESC, chunk_index DESC) = 1""")
def chunk_store(t):
    return C.latest_chunks(C.chunk_lines(t("documents"), "doc_id", "text", 10, 2), "doc_id").select("chunk_id", "doc_id", "chunk_index")


@query("chunk_by_size", f"""
WITH RECURSIVE {_LINES},
f AS (SELECT doc_id, 1 AS i, 0 AS prev, 0 AS chunk, length(ls[1]) AS n, length(ls[1]) > 500 AS closes FROM l
  UNION ALL SELECT f.doc_id, i + 1, CASE WHEN closes THEN i ELSE prev END, CASE WHEN closes THEN chunk + 1 ELSE chunk END,
    CASE WHEN closes THEN length(ls[i + 1]) ELSE n + 1 + length(ls[i + 1]) END, CASE WHEN closes THEN length(ls[i + 1]) ELSE n + 1 + length(ls[i + 1]) END > 500 FROM f JOIN l ON l.doc_id = f.doc_id WHERE i < len(ls)),
e AS (SELECT doc_id, chunk, MAX(prev) AS prev, MAX(i) AS last FROM f GROUP BY doc_id, chunk)
SELECT e.doc_id, chunk AS chunk_index, prev + 1 AS start_line, last AS end_line, md5(array_to_string(ls[prev + 1:last], chr(10))) AS content_md5 FROM e JOIN l USING (doc_id)""")
def chunk_by_size(t):
    return C.chunk_by_size(t("documents"), "doc_id", "text", F.col("source"), 500).select(
        "doc_id", "chunk_index", "start_line", "end_line", F.md5("content").alias("content_md5"))


_EMB512 = "SELECT {key} AS {key}, list(CAST('0x' || substring(sha256(i || ':' || text), 1, 8) AS BIGINT) / 4294967296 ORDER BY i) AS e FROM {table}, range(512) g(i) GROUP BY {key}"


@query("retrieve_chunks", f"""
WITH q AS ({_EMB512.format(key='item_id', table='benchmark')}), src AS (SELECT conv_id * 1000 + turn AS chunk, text, role FROM conversations), c AS ({_EMB512.format(key='chunk', table='src')}),
s AS (SELECT item_id, chunk, round(list_cosine_similarity(q.e, c.e), 6) AS score FROM q, c), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk) AS rank FROM s WHERE score > 0)
SELECT item_id, chunk, CAST(rank AS INT) AS rank, score, md5('[' || rank || '] ' || role || chr(10) || text) AS context_md5 FROM r JOIN src USING (chunk) WHERE rank <= 5 AND score >= 0.1""")
def retrieve_chunks(t):
    chunks = t("conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("chunk"), F.col("text").alias("content"), F.col("role").alias("source"))
    q = V.hash_embed_text(t("benchmark"), "item_id", F.col("text"))
    c = V.hash_embed_text(chunks, "chunk", F.col("content"))
    ranked = V.semantic_topk(c, q, 5, key="chunk", query_id="item_id")
    out = C.retrieve_chunks(ranked, chunks, "chunk")
    plain = F.concat(F.format_string("[%d] %s", F.col("rank"), F.col("source")), F.lit("\n"), F.col("content"))
    return out.select("item_id", "chunk", "rank", "score", F.md5(plain).alias("context_md5"))


_NAMED = " OR ".join(f"regexp_matches(s, '{p}')" for _, p in K.SECTION_RULES)
_HEAD = rf"(length(s) >= 2 AND length(s) <= 120 AND (regexp_matches(s, '^\d+(\.\d+)*\s+[A-Z].*$') OR (upper(s) = s AND lower(s) <> s AND len(regexp_split_to_array(s, '\s+')) <= 8) OR {_NAMED}))"


@query("extract_sections", rf"""
WITH t AS (SELECT page_id, string_split(regexp_replace(html, '</?(p|h1|title|li|div|br|b)[^>]*>', chr(10), 'g'), chr(10)) AS ls FROM pages),
x AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t), h AS (SELECT page_id, i, line, trim(line) AS s FROM x),
f AS (SELECT *, CAST({_HEAD} AS INT) AS hd FROM h), g AS (SELECT *, SUM(hd) OVER (PARTITION BY page_id ORDER BY i) AS sec, SUM(hd) OVER (PARTITION BY page_id) AS total FROM f),
b AS (SELECT page_id, CASE WHEN total = 0 THEN 0 ELSE sec - 1 END AS pos, MAX(CASE WHEN hd = 1 THEN trim(regexp_replace(line, '\s+', ' ', 'g')) END) AS title, any_value(total) AS total,
  string_agg(CASE WHEN hd = 0 AND trim(regexp_replace(line, '\s+', ' ', 'g')) <> '' THEN trim(regexp_replace(line, '\s+', ' ', 'g')) END, chr(10) ORDER BY i) AS content,
  trim(string_agg(line, chr(10) ORDER BY i)) AS whole FROM g WHERE total = 0 OR sec > 0 GROUP BY 1, 2)
SELECT page_id, CAST(pos AS INT) AS pos, CASE WHEN total = 0 THEN 'Full Text' ELSE title END AS title, md5(CASE WHEN total = 0 THEN whole ELSE content END) AS content_md5 FROM b WHERE CASE WHEN total = 0 THEN whole ELSE content END <> ''""")
def extract_sections(t):
    pages = t("pages").select("page_id", F.regexp_replace("html", "</?(p|h1|title|li|div|br|b)[^>]*>", "\n").alias("text"))
    return C.extract_sections(pages, "page_id", "text").select("page_id", "pos", "title", F.md5("content").alias("content_md5"))


_EQ_HITS = " UNION ALL ".join(
    "SELECT doc_id, unnest(regexp_extract_all(text, '" + p.replace("'", "''") + "', 1)) AS latex FROM documents" for p in K.EQUATION_DELIMITERS)


@query("extract_equations", rf"""
WITH d AS (SELECT doc_id, trim(regexp_replace(latex, '\s+', ' ', 'g')) AS latex FROM ({_EQ_HITS})),
s AS (SELECT doc_id, trim(x) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)),
y AS (SELECT doc_id, s FROM s WHERE length(s) BETWEEN 6 AND 220 AND NOT regexp_matches(lower(s), '^(algorithm|procedure|figure)')
  AND ((regexp_matches(s, '[=_^{{}}\[\]\\/*+\-<>|≈∑∏]') AND (length(regexp_replace(s, '\s', '', 'g')) - length(regexp_replace(s, '[^\p{{L}}]', '', 'g'))) / greatest(length(regexp_replace(s, '\s', '', 'g')), 1) >= 0.45) OR regexp_matches(s, '^[A-Za-z]\s*=\s*.+')))
SELECT DISTINCT doc_id, latex FROM d WHERE length(latex) >= 2 UNION SELECT doc_id, s FROM y""")
def extract_equations(t):
    return C.extract_equations(t("documents"), "doc_id", "text").select("doc_id", "latex")


@query("extract_algorithms")
def extract_algorithms(t):
    text = F.regexp_replace("text", r"(?m)^(Th|La|Die|El)\b", "Algorithm 1: $1")
    return C.extract_algorithms(t("documents").select("doc_id", text.alias("text")), "doc_id", "text").select(
        "doc_id", "name", "hint", F.md5("pseudocode").alias("code_md5"), F.array_join("inputs", "|").alias("inputs"), F.array_join("outputs", "|").alias("outputs"))


@query("extract_captions_refs", r"""
WITH t AS (SELECT doc_id, text, [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))] AS ls FROM documents)
SELECT doc_id, CAST(len([s for s in ls if regexp_matches(s, '(?i)^(Figure|Fig\.)\s*\d+[:.]?\s*(.*)$')]) AS INT) AS n_captions, array_to_string([s for s in ls if regexp_matches(s, '^\[?\d+\]?\s+\S+')], chr(10)) AS refs,
  array_to_string([k for k in [trim(regexp_replace(z, '\s+', ' ', 'g')) for z in regexp_split_to_array(regexp_extract(text, '(?i)\bkeywords?\b\s*[:\-]\s*([^\n]{3,300})', 1), '[;,]')] if k <> ''], ',') AS keywords FROM t""")
def extract_captions_refs(t):
    text = F.col("text")
    return t("documents").select("doc_id", F.size(C.captions(text)).alias("n_captions"), F.array_join(C.reference_lines(text), "\n").alias("refs"), F.array_join(C.keywords(text), ",").alias("keywords"))


@query("infer_title", r"""
SELECT doc_id, [s for s in [trim(regexp_replace(x, '\s+', ' ', 'g')) for x in string_split(text, chr(10))] if length(s) BETWEEN 8 AND 180 AND NOT starts_with(lower(s), 'arxiv')][1] AS title FROM documents""")
def infer_title(t):
    return t("documents").select("doc_id", C.infer_title(F.col("text")).alias("title"))


@query("html_pdf_link", r"""
WITH p AS (SELECT page_id, url, html || CASE page_id % 4 WHEN 0 THEN '<a href="/files/' || page_id || '.PDF?v=1">x</a>' WHEN 1 THEN '<meta name="citation_pdf_url" content="https://cdn.example.org/' || page_id || '.pdf">' WHEN 2 THEN '<a href="paper.pdf">p</a>' ELSE '' END AS html FROM pages)
SELECT page_id, CASE page_id % 4 WHEN 0 THEN regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1) || '/files/' || page_id || '.PDF?v=1' WHEN 1 THEN 'https://cdn.example.org/' || page_id || '.pdf'
  WHEN 2 THEN regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || 'paper.pdf' END AS pdf FROM p""")
def html_pdf_link(t):
    p, k = F.col("page_id") % 4, F.col("page_id").cast("string")
    extra = (F.when(p == 0, F.concat(F.lit('<a href="/files/'), k, F.lit('.PDF?v=1">x</a>')))
             .when(p == 1, F.concat(F.lit('<meta name="citation_pdf_url" content="https://cdn.example.org/'), k, F.lit('.pdf">')))
             .when(p == 2, '<a href="paper.pdf">p</a>').otherwise(""))
    return t("pages").select("page_id", C.pdf_link(F.col("url"), F.concat("html", extra)).alias("pdf"))


@query("extract_metric_claims", f"""
WITH r AS (SELECT page_id, regexp_extract_all(html, '{K.METRIC_CLAIM}', 1) AS a, regexp_extract_all(html, '{K.METRIC_CLAIM}', 2) AS b, regexp_extract_all(html, '{K.METRIC_CLAIM}', 3) AS c FROM pages),
u AS (SELECT page_id, unnest(a) AS name, unnest(b) AS raw, unnest(c) AS pct, generate_subscripts(a, 1) AS pos FROM r), n AS (SELECT *, {_NAME_SQL.format('name')} AS nm FROM u), m AS (SELECT *, {_METRIC_NAME_SQL} AS metric, CAST(raw AS DOUBLE) AS v FROM n)
SELECT page_id, metric, arg_max(CASE WHEN pct <> '' THEN v / 100 WHEN NOT regexp_matches(metric, 'loss|error|perplexity|latency|time') AND v > 1 AND v <= 100 THEN v / 100 ELSE v END, pos) AS value FROM m WHERE metric <> '' GROUP BY page_id, metric""")
def extract_metric_claims(t):
    return C.metric_claims(t("pages"), "page_id", "html")


@query("equation_comment_scan", r"""
WITH t AS (SELECT doc_id, string_split(regexp_replace(text, '\n(The|La|Die|El) ', chr(10) || '# Equation 7.1: ', 'g') || chr(10) || chr(10) || '# Eq. tail' || chr(10) || 'x = 1', chr(10)) AS ls FROM documents),
f AS (SELECT doc_id, ls, [i for i in range(1, len(ls) + 1) if starts_with(trim(ls[i]), '# Eq')] AS heads, len(ls) AS n FROM t),
b AS (SELECT doc_id, heads[1] AS head, n FROM f)
SELECT doc_id, CASE WHEN head = n - 1 THEN 'tail' ELSE '7.1' END AS eq_id FROM b UNION ALL SELECT doc_id, 'tail' FROM b WHERE head < n - 1""")
def equation_comment_scan(t):
    text = F.concat(F.regexp_replace("text", r"\n(The|La|Die|El) ", "\n# Equation 7.1: "), F.lit("\n\n# Eq. tail\nx = 1"))
    return C.equation_comments(t("documents").select("doc_id", text.alias("text")), "doc_id", "text").select("doc_id", "eq_id")


@query("element_inventory", r"""
SELECT file, line_no, CASE WHEN regexp_matches(content, '^class\s') THEN 'class' WHEN regexp_matches(content, '^def\s') THEN 'function' ELSE 'import' END AS kind,
  CASE WHEN starts_with(content, 'import') THEN regexp_extract(content, '^import\s+(\S+)', 1) ELSE regexp_extract(content, '^(?:class|def)\s+(\w+)', 1) END AS name,
  CASE WHEN starts_with(content, 'def') THEN replace(regexp_extract(content, '\(([^)]*)\)', 1), ', ', '|') ELSE '' END AS params
FROM code_lines WHERE regexp_matches(content, '^(class|def|import)\s')""")
def element_inventory(t):
    return C.element_inventory(t("code_lines")).select("file", "line_no", "kind", "name", F.array_join("parameters", "|").alias("params"))


@query("rename_sweep", r"SELECT doc_id, md5(regexp_replace(text, '\bthe\b', 'thee', 'g')) AS renamed_md5 FROM documents WHERE regexp_matches(text, '\bthe\b')")
def rename_sweep(t):
    return C.rename_sweep(t("documents"), "doc_id", "text", "the", "thee").select("doc_id", F.md5("renamed").alias("renamed_md5"))


# Diffs ------------------------------------------------------------------------

# The diff of two versions line by line: lines that are equal at the same place are in neither side.
@query("count_diff_changes", """
WITH l AS (SELECT pair_id, string_split(original, chr(10)) AS o, string_split(modified, chr(10)) AS m FROM versions),
d AS (SELECT pair_id, [x for x in list_zip(o, m) if x[1] IS DISTINCT FROM x[2]] AS c FROM l)
SELECT pair_id, CAST(len([x for x in c if x[1] IS NOT NULL AND x[1] NOT LIKE '--%']) AS INT) AS deletions, CAST(len([x for x in c if x[2] IS NOT NULL AND x[2] NOT LIKE '++%']) AS INT) AS additions FROM d""")
def count_diff_changes(t):
    pairs = F.arrays_zip(F.split("original", "\n").alias("o"), F.split("modified", "\n").alias("m"))
    v = t("versions").select("pair_id", F.filter(pairs, lambda p: ~p["o"].eqNullSafe(p["m"])).alias("c"))
    side = lambda name, sign: F.transform(F.filter("c", lambda p: p[name].isNotNull()), lambda p: F.concat(F.lit(sign), p[name]))
    diff = F.array_join(F.concat(F.array(F.lit("--- original"), F.lit("+++ modified"), F.lit("@@ @@")), side("o", "-"), side("m", "+")), "\n")
    return v.select("pair_id", E.diff_changes(diff).alias("d")).select("pair_id", "d.deletions", "d.additions")


# Extensions -------------------------------------------------------------------

@query("plugin_transforms", "SELECT lang, COUNT(*) AS n FROM documents WHERE n_chars > 100 GROUP BY lang")
def plugin_transforms(t):
    plugins = E.PluginRegistry()
    plugins.register("after", "count", lambda df: df.groupBy("lang").agg(F.count("*").alias("n")), priority=50)
    plugins.register("after", "broken", lambda df: df.select("no_such_column"), priority=20)
    plugins.register("after", "long_only", lambda df: df.filter("n_chars > 100"), priority=10)
    return plugins.apply("after", t("documents"))


@query("analyzer_udtf", """
SELECT p_brand AS repo, p_type AS item, 'files' AS what, COUNT(*) AS n FROM part GROUP BY 1, 2
UNION ALL SELECT p_brand, split_part(p_name, ' ', 1), 'dependency', COUNT(*) FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2""")
def analyzer_udtf(t):
    manifest = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"dependencies": {"'), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit('": "^1.0"}}'))).otherwise("{}")
    return E.analyze_packages(t("part").select(F.col("p_brand").alias("repo"), F.col("p_type").alias("kind"), manifest.alias("m")), "repo", F.col("m"))


@query("memory_table_ops", f"""
WITH a AS (SELECT id, CASE WHEN memory_type = 'episodic' AND created_at < {NOW} - INTERVAL 30 DAY AND access_count < 2 THEN 'archived' ELSE memory_type END AS memory_type,
  CASE WHEN memory_type = 'episodic' AND created_at < {NOW} - INTERVAL 30 DAY AND access_count < 2 THEN 'cold' ELSE tier END AS tier, importance, access_count, created_at, expires_at FROM memories),
d AS (SELECT id, memory_type, CASE WHEN created_at < {NOW} - INTERVAL 90 DAY AND importance IN (3, 4) THEN importance - 1 ELSE importance END AS importance,
  CASE WHEN created_at < {NOW} - INTERVAL 180 DAY AND tier NOT IN ('frozen', 'cold') THEN 'cold' ELSE tier END AS tier, access_count, expires_at FROM a),
x AS (SELECT * FROM d WHERE NOT coalesce(expires_at < {NOW}, false))
SELECT id, memory_type, importance, CASE WHEN importance = 5 THEN CASE tier WHEN 'cold' THEN 'warm' WHEN 'warm' THEN 'hot' ELSE tier END ELSE tier END AS tier, access_count + CASE WHEN importance = 5 THEN 1 ELSE 0 END AS access_count FROM x""")
def memory_table_ops(t):
    m = E.archive_memories(t("memories"), AS_OF)
    m = E.drop_expired(E.decay_memories(m, AS_OF), AS_OF)
    return E.access_memories(m, m.filter("importance = 5"), AS_OF).select("id", "memory_type", "importance", "tier", "access_count")


@query("memory_consolidation", r"""
WITH w AS (SELECT id, memory_type, access_count, importance, list_distinct([x for x in regexp_split_to_array(lower(content), '\s+') if x <> '']) AS ws FROM memories)
SELECT id FROM w e WHERE memory_type = 'episodic' AND access_count >= 3 AND importance >= 3 AND NOT EXISTS (SELECT 1 FROM w s WHERE s.memory_type = 'semantic' AND len(list_intersect(e.ws, s.ws)) / len(e.ws) >= 0.8)""")
def memory_consolidation(t):
    return E.consolidation_candidates(t("memories"))


@query("paper_library_ops", """
WITH s AS (SELECT CASE doc_id % 3 WHEN 0 THEN 'a' || doc_id % 50 WHEN 1 THEN 'u' || doc_id % 70 ELSE md5(text) END AS library_id, doc_id AS saved_at, lang FROM documents),
n AS (SELECT library_id, COUNT(*) AS uses, MAX(saved_at) AS last_used FROM s GROUP BY library_id)
SELECT library_id, saved_at, lang, uses, last_used FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY library_id ORDER BY saved_at DESC) = 1) JOIN n USING (library_id)""")
def paper_library_ops(t):
    d = F.col("doc_id")
    arxiv = F.when(d % 3 == 0, F.concat(F.lit("a"), (d % 50).cast("string"))).otherwise("")
    url = F.when(d % 3 == 1, F.concat(F.lit("u"), (d % 70).cast("string"))).otherwise("")
    rows = t("documents").select(E.library_key(arxiv, url, F.md5("text")).alias("library_id"), d.alias("saved_at"), "lang")
    saved = E.save_to_library(rows.filter("lang = 'en'"), rows.filter("lang <> 'en'"))
    uses = E.library_usage(rows.select("library_id", F.lit(1).alias("uses"), F.col("saved_at").alias("ts")))
    return saved.join(uses, "library_id")
