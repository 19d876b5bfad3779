"""Scalar column families run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import constants as K, scoring as S, text as X

from .registry import query
from .views import AS_OF_YEAR


def _in(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _cascade(expr: str, rules, default: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({expr}, '{p}') THEN '{label}'" for label, p in rules)
    return f"CASE {cases} ELSE '{default}' END"


SEARCH_TOKENS = (
    "[w for w in regexp_extract_all(lower({0}), '[a-z0-9]+') "
    f"if length(w) > 2 and w not in ({_in(K.SEARCH_STOP_WORDS)})]"
)


@query("tokenize_terms", f"""
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT doc_id, {SEARCH_TOKENS.format('text')} AS t FROM documents)""")
def tokenize_terms(t):
    tokens = X.search_tokens(F.col("text"))
    return t("documents").select("doc_id", tokens.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("tokenize_identifiers", f"""
SELECT doc_id, CAST(len(a) AS BIGINT) AS n_all, CAST(len(k) AS BIGINT) AS n_kept, md5(array_to_string(k, ' ')) AS kept_md5
FROM (SELECT doc_id, a, [w for w in a if length(w) > 1 and w not in ({_in(K.EMBED_STOP_WORDS)})] AS k
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS a FROM documents))""")
def tokenize_identifiers(t):
    return t("documents").select(
        "doc_id", X.identifier_tokens(F.col("text")).alias("a"),
        X.identifier_tokens(F.col("text"), True).alias("k"),
    ).select("doc_id", F.size("a").cast("bigint").alias("n_all"), F.size("k").cast("bigint").alias("n_kept"),
             F.md5(F.array_join("k", " ")).alias("kept_md5"))


@query("tokenize_code", rf"""
WITH stripped AS (
  SELECT row_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
    '#.*', '', 'g'), '(?s)"{{3}}.*?"{{3}}', '', 'g'), '(?s)''{{3}}.*?''{{3}}', '', 'g'), '//.*', '', 'g'), '(?s)/\*.*?\*/', '', 'g') AS c
  FROM code_lines),
marked AS (
  SELECT row_id, regexp_replace(regexp_replace(regexp_replace(c, '([(){{}}\[\].,;:+=*/<>!&|\-])', ' \1 ', 'g'),
    '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g'), '([^0-9\s])([0-9])', '\1 \2', 'g') AS m FROM stripped),
parts AS (SELECT row_id, [p for p in regexp_split_to_array(trim(m), '\s+') if p <> ''] AS ps FROM marked)
SELECT row_id, array_to_string([CASE WHEN p IN ({_in(K.PYTHON_KEYWORDS)}) THEN 'KEYWORD:' || p
  WHEN regexp_matches(p, '^[0-9]+$') THEN 'NUMBER' ELSE lower(p) END for p in ps], ' ') AS tokens
FROM parts""")
def tokenize_code(t):
    return t("code_lines").select("row_id", F.array_join(X.code_tokens(F.col("content")), " ").alias("tokens"))


@query("normalize_ids", r"""
WITH raw AS (
  SELECT doc_id, split_part(text, chr(10), 1) AS title,
    CASE doc_id % 3 WHEN 0 THEN 'https://doi.org/10.' WHEN 1 THEN ' doi:10.' ELSE 'http://dx.doi.org/10.' END || (1000 + doc_id) || '/AbC.' || source AS doi,
    'arxiv:' || (1000 + doc_id % 9000) || '.' || (10000 + doc_id % 80000) || 'v2' AS ref FROM documents)
SELECT doc_id,
  lower(trim(regexp_replace(regexp_replace(trim(doi), '(?i)^https?://(?:dx\.)?doi\.org/', ''), '(?i)^doi:', ''))) AS doi,
  regexp_replace(lower(title), '[^a-z0-9]+', '', 'g') AS title_key,
  regexp_extract(ref, '(\d{4}\.\d{4,5}(?:v\d+)?)', 1) AS arxiv
FROM raw""")
def normalize_ids(t):
    d = F.col("doc_id")
    doi = F.concat(
        F.when(d % 3 == 0, "https://doi.org/10.").when(d % 3 == 1, " doi:10.").otherwise("http://dx.doi.org/10."),
        (d + 1000).cast("string"), F.lit("/AbC."), F.col("source"))
    ref = F.concat(F.lit("arxiv:"), (1000 + d % 9000).cast("string"), F.lit("."), (10000 + d % 80000).cast("string"), F.lit("v2"))
    return t("documents").select(
        "doc_id", X.normalize_doi(doi).alias("doi"),
        X.normalize_title(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"),
        X.arxiv_id(ref).alias("arxiv"))


@query("classify_source_ref", r"""
WITH refs AS (
  SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'arXiv:' || (1000 + page_id) || '.12345'
    WHEN 2 THEN (1000 + page_id) || '.12345' WHEN 3 THEN 'doi:10.' || page_id || '/' || length(html)
    WHEN 4 THEN './papers/' || page_id || '.pdf' ELSE regexp_extract(html, '<title>([^<]*)</title>', 1) END AS ref FROM pages)
SELECT page_id, ref, CASE WHEN regexp_matches(trim(ref), '(?i)^(/|\./|~/).*\.pdf$') THEN 'local_pdf'
  WHEN lower(trim(ref)) LIKE 'arxiv:%' THEN 'arxiv'
  WHEN regexp_matches(trim(ref), '^[A-Za-z\-]+/\d{7}$') OR regexp_matches(trim(ref), '^\d+\.\d+$') THEN 'arxiv'
  WHEN regexp_matches(trim(regexp_replace(trim(ref), '(?i)^doi:', '')), '^10\.') AND contains(ref, '/') THEN 'doi'
  WHEN regexp_matches(trim(ref), '(?i)^https?://') THEN 'url' ELSE 'title' END AS kind
FROM refs""")
def classify_source_ref(t):
    p = F.col("page_id")
    ref = (
        F.when(p % 6 == 0, F.col("url"))
        .when(p % 6 == 1, F.concat(F.lit("arXiv:"), (1000 + p).cast("string"), F.lit(".12345")))
        .when(p % 6 == 2, F.concat((1000 + p).cast("string"), F.lit(".12345")))
        .when(p % 6 == 3, F.concat(F.lit("doi:10."), p.cast("string"), F.lit("/"), F.length("html").cast("string")))
        .when(p % 6 == 4, F.concat(F.lit("./papers/"), p.cast("string"), F.lit(".pdf")))
        .otherwise(F.regexp_extract("html", "<title>([^<]*)</title>", 1)))
    return t("pages").select("page_id", ref.alias("ref")).select(
        "page_id", "ref", X.classify_source_ref(F.col("ref")).alias("kind"))


@query("normalize_url_path", r"""
WITH paths AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path FROM pages),
parts AS (SELECT page_id, string_split(regexp_replace(path, '^/+|/+$', '', 'g'), '/') AS ps FROM paths),
normal AS (SELECT page_id, '/' || array_to_string([CASE WHEN regexp_matches(p, '^\d+$') THEN '{id}'
    WHEN regexp_matches(p, '^[^-]{8}-[^-]{4}-[^-]{4}-[^-]{4}-[^-]{12}$') THEN '{uuid}' ELSE p END for p in ps], '/') AS route FROM parts)
SELECT route, COUNT(*) AS n_pages FROM normal GROUP BY route""")
def normalize_url_path(t):
    route = X.normalize_url_path(X.url_path(F.col("url")))
    return t("pages").groupBy(route.alias("route")).agg(F.count("*").alias("n_pages"))


@query("collapse_whitespace", r"""
SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS squeezed_md5,
  md5(array_to_string([x for x in [trim(regexp_replace(l, '\s+', ' ', 'g')) for l in string_split(text, chr(10))] if x <> ''], chr(10))) AS lines_md5,
  CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines
FROM documents""")
def collapse_whitespace(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id", F.md5(X.squeeze(text)).alias("squeezed_md5"), F.md5(X.squeeze_lines(text)).alias("lines_md5"),
        F.size(F.split(text, "\n")).cast("bigint").alias("n_lines"))


@query("content_fingerprint", r"""
SELECT doc_id, substring(sha256(regexp_replace(text, '\s+', '', 'g')), 1, 16) AS code_hash,
  'title-' || substring(sha256(trim(split_part(text, chr(10), 1))), 1, 16) AS title_hash,
  substring(md5(text), 1, 16) AS chunk_hash, substring(sha256(source), 1, 12) AS path_hash
FROM documents""")
def content_fingerprint(t):
    text = F.col("text")
    return t("documents").select(
        "doc_id", X.code_hash(text).alias("code_hash"),
        X.title_hash(F.split_part(text, F.lit("\n"), F.lit(1))).alias("title_hash"),
        X.chunk_hash(text).alias("chunk_hash"), X.path_hash(F.col("source")).alias("path_hash"))


@query("spec_text_concat", """
SELECT page_id, md5(trim(concat_ws(' ', nullif(url, ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), ''),
  nullif(array_to_string(regexp_extract_all(html, '<a href="([^"]*)"', 1), ' '), '')))) AS spec_md5
FROM pages""")
def spec_text_concat(t):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    links = F.array_join(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), " ")
    return t("pages").select("page_id", F.md5(X.spec_text(F.col("url"), title, links)).alias("spec_md5"))


COST_SQL = """CASE provider
  WHEN 'anthropic' THEN round(coalesce(tokens_used // 2, 0) / 1000000 * 15.0 + coalesce(tokens_used // 2, 0) / 1000000 * 75.0, 6)
  WHEN 'openai' THEN round(coalesce(tokens_used // 2, 0) / 1000000 * 5.0 + coalesce(tokens_used // 2, 0) / 1000000 * 15.0, 6)
  WHEN 'google' THEN round(coalesce(tokens_used // 2, 0) / 1000000 * 1.25 + coalesce(tokens_used // 2, 0) / 1000000 * 5.0, 6) END"""


@query("estimate_cost", f"SELECT event_id, provider, {COST_SQL} AS cost_usd FROM usage")
def estimate_cost(t):
    return t("usage").select(
        "event_id", "provider", S.estimate_cost(F.col("provider"), F.col("tokens_used")).alias("cost_usd"))


@query("step_scores", """
SELECT id, CASE WHEN confidence < 0.2 THEN 'very_low' WHEN confidence < 0.4 THEN 'low' WHEN confidence < 0.6 THEN 'medium'
    WHEN confidence < 0.8 THEN 'high' ELSE 'very_high' END AS level,
  CASE WHEN confidence < 0.2 THEN 'very confident' WHEN confidence < 0.4 THEN 'somewhat confident' WHEN confidence < 0.6 THEN 'neutral'
    WHEN confidence < 0.8 THEN 'uncertain' ELSE 'very uncertain' END AS uncertainty,
  CASE WHEN id % 251 < 10 THEN 1.0e0 WHEN id % 251 < 50 THEN 0.9e0 WHEN id % 251 < 100 THEN 0.7e0 WHEN id % 251 < 200 THEN 0.5e0 ELSE 0.3e0 END AS size_score,
  CASE WHEN id < 1 THEN 1.0e0 WHEN id < 24 THEN 0.9e0 WHEN id < 168 THEN 0.7e0 WHEN id < 720 THEN 0.5e0 WHEN id < 2160 THEN 0.3e0 WHEN id < 8760 THEN 0.2e0 ELSE 0.1e0 END AS recency
FROM predictions""")
def step_scores(t):
    c, i = F.col("confidence"), F.col("id")
    return t("predictions").select(
        "id", S.confidence_level(c).alias("level"), S.uncertainty_level(c).alias("uncertainty"),
        S.patch_size_score(i % 251).alias("size_score"), S.age_score(i).alias("recency"))


@query("adaptive_confidence", """
WITH s AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_quantity / 50 * 0.35 + l_tax * 10 * 0.25
    + CASE WHEN l_quantity * 5 < 10 THEN 1.0 WHEN l_quantity * 5 < 50 THEN 0.9 WHEN l_quantity * 5 < 100 THEN 0.7 WHEN l_quantity * 5 < 200 THEN 0.5 ELSE 0.3 END * 0.15
    + (1.0 - least(l_discount * 12, 1.0)) * 0.15 AS score,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_discount * 10 END AS hist FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  round(greatest(0.0, least(1.0, CASE WHEN hist IS NOT NULL THEN score * 0.9 + hist * 0.10 ELSE score END)), 6) AS confidence
FROM s""")
def adaptive_confidence(t):
    score = S.adaptive_confidence(
        F.col("l_quantity") / 50, F.col("l_tax") * 10, F.col("l_quantity") * 5, F.col("l_discount") * 12,
        F.when(F.col("l_returnflag") != "N", F.col("l_discount") * 10))
    return t("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", S.rounded(score, 6).alias("confidence"))


@query("redact_secrets", rf"""
SELECT doc_id, md5(r) AS redacted_md5, r <> text AS changed
FROM (SELECT doc_id, text, regexp_replace(text, '{K.SECRET_ASSIGNMENT}', '\1=***REDACTED***', 'g') AS r FROM documents)""")
def redact_secrets(t):
    return t("documents").withColumn("r", X.redact_secrets(F.col("text"))).select(
        "doc_id", F.md5("r").alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


def _sanitize_sql(col: str) -> str:
    clean = col
    for p in K.INJECTION_PROMPT:
        clean = f"regexp_replace({clean}, '(?i){p}', '[REDACTED]', 'g')"
    clean = rf"regexp_replace({clean}, '\s{{4,}}', ' ', 'g')"
    danger = "|".join(f"(?:{p})" for p in K.DANGEROUS_PROMPT)
    return f"CASE WHEN regexp_matches({col}, '(?i){danger}') THEN '{K.BLOCKED_NOTICE}' ELSE {clean} END"


@query("sanitize_prompt", f"""
SELECT doc_id, md5(s) AS clean_md5, s = '{K.BLOCKED_NOTICE}' AS blocked
FROM (SELECT doc_id, {_sanitize_sql('text')} AS s FROM documents)""")
def sanitize_prompt(t):
    return t("documents").select("doc_id", X.sanitize_prompt(F.col("text")).alias("s")).select(
        "doc_id", F.md5("s").alias("clean_md5"), (F.col("s") == K.BLOCKED_NOTICE).alias("blocked"))


_KEY_SQL = "CASE " + " ".join(f"WHEN starts_with(k, '{p}') THEN '{v}'" for p, v in K.KEY_PREFIXES) + " ELSE 'custom' END"


@query("detect_key_provider", f"""
WITH keys AS (SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'sk-ant-' WHEN 1 THEN 'sk-or-' WHEN 2 THEN 'sk-' WHEN 3 THEN 'ghp_'
  WHEN 4 THEN 'ya29.' WHEN 5 THEN 'gsk_' ELSE '' END || c_name AS k FROM customer)
SELECT c_custkey, {_KEY_SQL} AS provider FROM keys""")
def detect_key_provider(t):
    c = F.col("c_custkey") % 7
    prefix = (F.when(c == 0, "sk-ant-").when(c == 1, "sk-or-").when(c == 2, "sk-").when(c == 3, "ghp_")
              .when(c == 4, "ya29.").when(c == 5, "gsk_").otherwise(""))
    return t("customer").select(
        "c_custkey", X.detect_key_provider(F.concat(prefix, F.col("c_name"))).alias("provider"))


_EXT_SQL = "CASE " + " ".join(
    f"WHEN ext IN ({_in(exts)}) THEN '{lang}'" for lang, exts in K.LANGUAGE_EXTENSIONS.items()) + " END"
_MARK_SQL = ", ".join(
    "CASE WHEN " + " + ".join(f"CAST(contains(head, '{m}') AS INT)" for m in markers) + f" >= 2 THEN '{lang}' END"
    for lang, markers in K.LANGUAGE_MARKERS)


@query("detect_language", f"""
WITH files AS (SELECT page_id, 'site/p' || page_id || CASE page_id % 4 WHEN 0 THEN '.html' WHEN 1 THEN '.PY' WHEN 2 THEN '.rs' ELSE '.xyz' END AS path, html FROM pages),
heads AS (SELECT page_id, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS ext, lower(array_to_string(string_split(html, chr(10))[1:10], ' ')) AS head FROM files)
SELECT page_id, coalesce({_MARK_SQL}, {_EXT_SQL}) AS language FROM heads""")
def detect_language(t):
    p = F.col("page_id")
    ext = F.when(p % 4 == 0, ".html").when(p % 4 == 1, ".PY").when(p % 4 == 2, ".rs").otherwise(".xyz")
    path = F.concat(F.lit("site/p"), p.cast("string"), ext)
    return t("pages").select("page_id", X.detect_language(path, F.col("html")).alias("language"))


@query("classify_section", rf"""
WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
kinds AS (SELECT {_cascade(r"trim(regexp_replace(line, '\s+', ' ', 'g'))", K.SECTION_RULES, 'unknown')} AS kind FROM lines)
SELECT kind, COUNT(*) AS n_lines FROM kinds GROUP BY kind""")
def classify_section(t):
    lines = t("documents").select(F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy(X.classify_section(F.col("line")).alias("kind")).agg(F.count("*").alias("n_lines"))


@query("classify_equation", rf"""
SELECT conv_id, turn, {_cascade("lower(concat_ws(' ', text, role))", [(k, "|".join(w)) for k, w in K.EQUATION_RULES], 'unknown')} AS kind
FROM conversations""")
def classify_equation(t):
    return t("conversations").select(
        "conv_id", "turn", X.classify_equation(F.col("text"), F.col("role")).alias("kind"))


@query("detect_domain", f"""
SELECT doc_id, {_cascade('lower(text)', [(f'{d}/{s}', p) for d, s, p in K.DOMAIN_RULES], 'theory/general')} AS domain
FROM documents""")
def detect_domain(t):
    return t("documents").select("doc_id", X.detect_domain(F.col("text")).alias("domain"))


_CAT_SQL = "list_max([" + ", ".join(
    "{'n': " + " + ".join(f"CAST(contains(x, '{w}') AS INT)" for w in words) + f", 'p': -{pos}, 'name': '{name}'}}"
    for pos, (name, words) in enumerate(K.CATEGORY_KEYWORDS)) + "]).name"


@query("keyword_argmax_category", f"""
SELECT paper_id, {_CAT_SQL} AS category FROM (SELECT paper_id, lower(concat(title, ' ', abstract)) AS x FROM papers)""")
def keyword_argmax_category(t):
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    return t("papers").select("paper_id", X.keyword_category(text).alias("category"))


_QUALITY_SQL = """least(1.0, length(text) / 1000) * 0.3
  + CASE WHEN contains(text, '```') OR contains(text, '#') OR contains(text, '- ') OR contains(text, '* ') THEN 0.3 ELSE 0.0 END
  + CASE WHEN contains(text, '```') OR contains(text, 'def ') OR contains(text, 'class ') THEN 0.4 ELSE 0.0 END"""


@query("rate_text_quality", rf"""
WITH s AS (
  SELECT conv_id, turn, text, role, {_QUALITY_SQL} AS base,
    list_distinct([w for w in regexp_split_to_array(lower(text), '\s+') if w <> '']) AS got,
    list_distinct([w for w in regexp_split_to_array(lower(first_text), '\s+') if w <> '']) AS want
  FROM (SELECT c.*, MAX(CASE WHEN turn = 0 THEN text END) OVER (PARTITION BY conv_id) AS first_text FROM conversations c)),
q AS (SELECT conv_id, turn, text, (base + least(1.0, len(list_intersect(got, want)) / len(want))) / 2 AS score FROM s)
SELECT conv_id, turn, round(score, 6) AS score,
  CASE WHEN length(text) = 0 THEN 'very_poor' WHEN score >= 0.8 THEN 'excellent' WHEN score >= 0.6 THEN 'good' WHEN score >= 0.4 THEN 'fair'
    WHEN score >= 0.2 THEN 'poor' ELSE 'very_poor' END AS rating,
  concat_ws('; ', CASE WHEN length(text) < 50 THEN 'Output was too brief - may need more detail' END,
    CASE WHEN contains(lower(text), 'error') THEN 'Output contained errors that need addressing' END,
    CASE WHEN contains(lower(text), 'undefined') OR contains(lower(text), 'not found') THEN 'Missing information detected' END) AS lessons
FROM q""")
def rate_text_quality(t):
    turns = t("conversations")
    first = turns.filter("turn = 0").select("conv_id", F.col("text").alias("first_text"))
    scored = turns.join(first, "conv_id", "left").withColumn(
        "score", X.text_quality_score(F.col("text"), F.col("first_text")))
    return scored.select(
        "conv_id", "turn", S.rounded("score", 6).alias("score"),
        X.quality_rating(F.col("text"), F.col("score")).alias("rating"),
        F.array_join(X.lesson_flags(F.col("text")), "; ").alias("lessons"))


def _contains_any(words) -> str:
    return " OR ".join(f"contains(x, '{w}')" for w in words)


_INTENT_CASES = (
    [(f"contains(x, '{trig}')", a, c, cost, 0.9) for trig, a, c, cost in K.COMPOUND_INTENTS]
    + [(_contains_any(words), a, c, cost, 0.85) for a, words, c, cost in K.ACTION_INTENTS]
    + [(_contains_any(K.SPEC_NAMES), "integrate", "complex", 25000, 0.7)])
_INTENT_SQL = "CASE " + " ".join(
    f"WHEN {cond} THEN '{a}|{c}|{cost}|{conf}'" for cond, a, c, cost, conf in _INTENT_CASES) + " ELSE 'unknown|simple|1000|0.3' END"


@query("classify_intent", f"""
SELECT conv_id, turn, split_part(i, '|', 1) AS action, split_part(i, '|', 2) AS complexity,
  CAST(split_part(i, '|', 3) AS INT) AS token_cost, CAST(split_part(i, '|', 4) AS DOUBLE) AS confidence
FROM (SELECT conv_id, turn, {_INTENT_SQL} AS i FROM (SELECT conv_id, turn, lower(trim(text)) AS x FROM conversations))""")
def classify_intent(t):
    return t("conversations").select("conv_id", "turn", X.classify_intent(F.col("text")).alias("i")).select(
        "conv_id", "turn", "i.action", "i.complexity", "i.token_cost", "i.confidence")


_NAME_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9@\s_\-]', '', 'g'),"
    r" '\s+', '_', 'g'), '[-@]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g')")
_METRIC_NAME_SQL = (
    "CASE " + " ".join(f"WHEN nm = '{k}' THEN '{v}'" for k, v in K.METRIC_SYNONYMS.items())
    + " WHEN contains(nm, 'accuracy') THEN nm WHEN contains(nm, 'acc') THEN 'accuracy' WHEN regexp_matches(nm, 'f1|bleu') THEN nm"
    " WHEN contains(nm, 'rouge_l') THEN 'rouge_l' WHEN regexp_matches(nm, 'rouge|mrr|map|auc|precision|recall|loss|perplexity|wer|cer') THEN nm"
    " WHEN starts_with(nm, 'top_1') THEN 'top_1_accuracy' WHEN starts_with(nm, 'top_5') THEN 'top_5_accuracy' ELSE nm END")


@query("normalize_metric_name", f"""
WITH n AS (SELECT p_partkey, {_NAME_SQL.format("CASE p_size % 5 WHEN 0 THEN 'Top 1 ' WHEN 1 THEN 'Test-Accuracy' WHEN 2 THEN 'ACC @ ' WHEN 3 THEN 'Val  Loss ' ELSE '' END || p_name")} AS nm FROM part)
SELECT p_partkey, {_METRIC_NAME_SQL} AS metric FROM n""")
def normalize_metric_name(t):
    s = F.col("p_size") % 5
    raw = F.concat(F.when(s == 0, "Top 1 ").when(s == 1, "Test-Accuracy").when(s == 2, "ACC @ ").when(s == 3, "Val  Loss ").otherwise(""),
                   F.col("p_name"))
    return t("part").select("p_partkey", X.normalize_metric_name(raw).alias("metric"))


@query("coerce_metric_value", """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN value / 100.0e0
  WHEN NOT regexp_matches(event_type, 'loss|error|perplexity|latency|time') AND value > 1.0 AND value <= 100.0 THEN value / 100.0e0
  ELSE value END AS metric_value
FROM events""")
def coerce_metric_value(t):
    return t("events").select("event_id", X.coerce_metric_value(
        F.col("event_type"), F.col("value").cast("string"), F.col("user_id") % 3 == 0).alias("metric_value"))


@query("metric_direction", f"""
WITH m AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'Error-Rate' WHEN 'click' THEN 'VAL LOSS' ELSE event_type END AS name FROM events)
SELECT name, regexp_replace(lower(name), '[- ]', '_', 'g') NOT IN ({_in(K.LOWER_IS_BETTER)}) AS higher_better, COUNT(*) AS n
FROM m GROUP BY name""")
def metric_direction(t):
    e = F.col("event_type")
    name = F.when(e == "error", "Error-Rate").when(e == "click", "VAL LOSS").otherwise(e)
    return t("events").groupBy(name.alias("name")).agg(F.count("*").alias("n")).select(
        "name", X.higher_is_better(F.col("name")).alias("higher_better"), "n")


@query("parse_semver_compat", """
WITH v AS (SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '1.' || (p_size % 3) || '.' || (p_size % 2) WHEN 1 THEN CAST(p_size % 3 AS VARCHAR)
    WHEN 2 THEN '1.0' ELSE 'v' || p_size END AS ver, CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN 'other' ELSE 'mapping' END AS kind FROM part),
p AS (SELECT *, CASE WHEN ok THEN [coalesce(TRY_CAST(ps[1] AS INT), 0), coalesce(TRY_CAST(ps[2] AS INT), 0), coalesce(TRY_CAST(ps[3] AS INT), 0)] END AS n
  FROM (SELECT *, string_split(ver, '.') AS ps, regexp_matches(ver, '^\\d+(\\.\\d+){0,2}$') AS ok FROM v))
SELECT p_partkey, n[1] AS major, n[2] AS minor, n[3] AS patch,
  CAST(CASE WHEN n IS NULL OR n[1] <> 1 THEN 1 ELSE 0 END + CASE WHEN kind <> 'mapping' THEN 1 ELSE 0 END AS BIGINT) AS n_issues,
  CAST(CASE WHEN n[1] = 1 AND n[2] > 0 THEN 1 ELSE 0 END AS BIGINT) AS n_warnings,
  CAST(CASE WHEN n[1] <> 1 OR n[2] > 0 OR (n[2] = 0 AND n[3] > 0) THEN 1 ELSE 0 END AS BIGINT) AS n_notes
FROM p""")
def parse_semver_compat(t):
    s = F.col("p_size")
    ver = (F.when(s % 4 == 0, F.concat(F.lit("1."), (s % 3).cast("string"), F.lit("."), (s % 2).cast("string")))
           .when(s % 4 == 1, (s % 3).cast("string")).when(s % 4 == 2, "1.0").otherwise(F.concat(F.lit("v"), s.cast("string"))))
    kind = F.when(s % 5 == 0, "").when(s % 5 == 1, "other").otherwise("mapping")
    df = t("part").select("p_partkey", ver.alias("ver"), kind.alias("kind"))
    df = df.select("p_partkey", X.parse_semver(F.col("ver")).alias("n"),
                   X.semver_report(F.col("ver"), F.col("kind"), ["mapping"]).alias("r"))
    return df.select(
        "p_partkey", F.col("n")[0].alias("major"), F.col("n")[1].alias("minor"), F.col("n")[2].alias("patch"),
        *[F.size(f"r.{k}").cast("bigint").alias(f"n_{k}") for k in ("issues", "warnings", "notes")])


@query("influence_score", f"""
WITH o AS (SELECT src AS id, COUNT(*) AS refs FROM cites GROUP BY src),
i AS (SELECT dst AS id, COUNT(*) AS cits FROM cites GROUP BY dst)
SELECT id, round(CASE WHEN coalesce(cits, 0) = 0 AND coalesce(refs, 0) = 0 THEN 0.0
  ELSE sqrt(coalesce(cits, 0) * coalesce(refs, 0) + 1) * CASE WHEN year > 0 THEN 1.0 / (1.0 + 0.1 * ({AS_OF_YEAR} - year)) ELSE 1.0 END END, 6) AS influence
FROM cite_nodes LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def influence_score(t):
    from citeloom.operators.graph import degrees

    d = degrees(t("cites"))
    score = S.influence_score(F.coalesce("in_degree", F.lit(0)), F.coalesce("out_degree", F.lit(0)), F.col("year"), AS_OF_YEAR)
    return t("cite_nodes").join(d, "id", "left").select("id", S.rounded(score, 6).alias("influence"))


@query("impact_estimate", """
WITH s AS (SELECT o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'rmsnorm' WHEN '2-HIGH' THEN 'flashattention' WHEN '3-MEDIUM' THEN 'rope' ELSE 'lora' END AS spec, o_orderstatus AS benefit FROM orders),
v AS (SELECT *, CASE spec WHEN 'rmsnorm' THEN 0.07e0 WHEN 'swiglu' THEN 0.1e0 WHEN 'flashattention' THEN 0.25e0 WHEN 'rope' THEN 0.05e0 ELSE 0.05e0 END AS sp,
  CASE spec WHEN 'rmsnorm' THEN 0.02e0 WHEN 'swiglu' THEN 0.05e0 WHEN 'flashattention' THEN 0.3e0 WHEN 'rope' THEN 0.01e0 ELSE 0.02e0 END AS mem FROM s)
SELECT o_custkey AS plan_id, round(least(SUM(sp), 0.5), 6) AS speedup, round(least(SUM(mem), 0.4), 6) AS memory,
  array_to_string(list_sort(list(DISTINCT benefit)), ',') AS benefits
FROM v GROUP BY o_custkey""")
def impact_estimate(t):
    p = F.col("o_orderpriority")
    spec = F.when(p == "1-URGENT", "rmsnorm").when(p == "2-HIGH", "flashattention").when(p == "3-MEDIUM", "rope").otherwise("lora")
    df = t("orders").select("o_custkey", spec.alias("spec"), F.col("o_orderstatus").alias("benefit"))
    return df.groupBy(F.col("o_custkey").alias("plan_id")).agg(
        S.rounded(F.least(F.sum(S.lookup(F.col("spec"), K.SPEEDUP_BY_SPEC, 0.05)), F.lit(0.5)), 6).alias("speedup"),
        S.rounded(F.least(F.sum(S.lookup(F.col("spec"), K.MEMORY_BY_SPEC, 0.02)), F.lit(0.4)), 6).alias("memory"),
        F.array_join(F.array_sort(F.collect_set("benefit")), ",").alias("benefits"))


@query("variant_score", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
  round((1 + l_discount) * 40 + greatest(0.0, 30 - abs(l_tax * 100 - 4) * 3) + l_quantity / 50 * 30, 6) AS score
FROM lineitem""")
def variant_score(t):
    score = S.variant_score(1 + F.col("l_discount"), F.col("l_tax") * 100 - 4, F.col("l_quantity") / 50)
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", S.rounded(score, 6).alias("score"))


@query("speedup_loss_delta", """
SELECT id, CASE WHEN b.score <> 0 THEN round(c.score / greatest(b.score, 1e-9), 4) END AS speedup,
  round((c.score - b.score) / greatest(abs(b.score), 1e-9) * 100.0, 4) AS loss_change
FROM snap_base b JOIN snap_cur c USING (id)""")
def speedup_loss_delta(t):
    b = t("snap_base").select("id", F.col("score").alias("base"))
    c = t("snap_cur").select("id", F.col("score").alias("cur"))
    return b.join(c, "id").select(
        "id", S.speedup_of(F.col("cur"), F.col("base")).alias("speedup"),
        S.loss_change_pct(F.col("cur"), F.col("base")).alias("loss_change"))


@query("json_field_transform", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
  CASE CAST(json_extract(props, '$.k') AS BIGINT) WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE json_extract_string(props, '$.k') END AS mapped
FROM events""")
def json_field_transform(t):
    names = F.create_map(F.lit("1"), F.lit("one"), F.lit("2"), F.lit("two"))
    kept = F.map_filter(F.from_json("props", "map<string,string>"), lambda k, v: k.isin("k"))
    df = t("events").select("event_id", kept["k"].alias("raw"))
    return df.select("event_id", F.col("raw").cast("bigint").alias("k"),
                     F.coalesce(names[F.col("raw")], F.col("raw")).alias("mapped"))


@query("clean_embedded_json", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def clean_embedded_json(t):
    e = F.col("event_id")
    noisy = (F.when(e % 3 == 0, F.col("props"))
             .when(e % 3 == 1, F.concat(F.lit("Result:\n```json\n"), F.col("props"), F.lit("\n```\n")))
             .otherwise(F.concat(F.lit("the value is "), F.col("props"), F.lit(" as asked."))))
    return t("events").select("event_id", F.get_json_object(X.embedded_json(noisy), "$.k").cast("bigint").alias("k"))


@query("truncate_context", """
SELECT conv_id, md5(substring(coalesce(string_agg(CASE WHEN role IN ('user', 'assistant') THEN text END, chr(10) || chr(10) ORDER BY turn), ''), 1, 2000)) AS prompt_md5
FROM conversations GROUP BY conv_id""")
def truncate_context(t):
    from citeloom.operators.documents import truncate_context as truncate

    prompt = truncate(t("conversations"), "conv_id", "turn", "role", "text", ["user", "assistant"], 2000)
    every = t("conversations").select("conv_id").distinct().join(prompt, "conv_id", "left")
    return every.select("conv_id", F.md5(F.coalesce("prompt", F.lit(""))).alias("prompt_md5"))
