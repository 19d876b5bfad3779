"""Text columns: tokenizers, normalisers, classifiers. All native expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from . import constants as K


# Tokenizers -----------------------------------------------------------------

def search_tokens(text: Column) -> Column:
    """Lower-case alphanumeric words longer than two characters, stop words dropped."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*K.SEARCH_STOP_WORDS))


def identifier_tokens(text: Column, drop_stop_words: bool = False) -> Column:
    """``[a-z0-9_]+`` words; the embedding flavour drops stop words and single characters."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1))
    if not drop_stop_words:
        return words
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*K.EMBED_STOP_WORDS))


def strip_comments(code: Column) -> Column:
    """Remove line comments, doc strings and block comments."""
    for pattern in (r"#.*", r'(?s)""".*?"""', r"(?s)'''.*?'''", r"//.*", r"(?s)/\*.*?\*/"):
        code = F.regexp_replace(code, pattern, "")
    return code


def code_tokens(code: Column, keywords: Sequence[str] = tuple(K.PYTHON_KEYWORDS)) -> Column:
    """Code tokens: punctuation kept, camelCase and digit boundaries split.

    Boundaries are marked with spaces first, so one split yields the tokens.
    """
    marked = F.regexp_replace(strip_comments(code), r"([(){}\[\].,;:+=*/<>!&|\-])", " $1 ")
    marked = F.regexp_replace(marked, r"(?<=\p{Ll})(?=\p{Lu})|(?<=[^0-9\s])(?=[0-9])", " ")
    parts = F.filter(F.split(F.trim(marked), r"\s+"), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.when(p.isin(*keywords), F.concat(F.lit("KEYWORD:"), p))
        .when(p.rlike("^[0-9]+$"), F.lit("NUMBER"))
        .otherwise(F.lower(p)),
    )


# Identifiers ----------------------------------------------------------------

def normalize_doi(doi: Column) -> Column:
    bare = F.regexp_replace(F.trim(doi), r"(?i)^https?://(?:dx\.)?doi\.org/", "")
    return F.lower(F.trim(F.regexp_replace(bare, r"(?i)^doi:", "")))


def normalize_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(title), r"[^a-z0-9]+", "")


def arxiv_id(value: Column) -> Column:
    """arXiv id inside a string; without one, the string less its prefix."""
    bare = F.regexp_replace(F.trim(value), r"\.pdf$", "")
    found = F.regexp_extract(bare, r"(\d{4}\.\d{4,5}(?:v\d+)?)", 1)
    return F.when(found != "", found).otherwise(F.trim(F.regexp_replace(bare, "^arxiv:", "")))


def classify_source_ref(ref: Column) -> Column:
    """Kind of a paper reference. A path to a PDF is recognised by its shape."""
    s = F.trim(ref)
    doi = F.trim(F.regexp_replace(s, r"(?i)^doi:", ""))
    return (
        F.when(s.rlike(r"(?i)^(/|\./|~/).*\.pdf$"), "local_pdf")
        .when(F.lower(s).startswith("arxiv:"), "arxiv")
        .when(s.rlike(r"^[A-Za-z\-]+/\d{7}$") | s.rlike(r"^\d+\.\d+$"), "arxiv")
        .when(doi.rlike(r"^10\.") & doi.contains("/"), "doi")
        .when(s.rlike(r"(?i)^https?://"), "url")
        .otherwise("title")
    )


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://[^/?#]*([^?#]*)", 1)


def normalize_url_path(path: Column) -> Column:
    """Numeric parts become ``{id}``, UUID-shaped parts ``{uuid}``."""
    parts = F.split(F.regexp_replace(path, r"^/+|/+$", ""), "/")
    uuid = r"^[^-]{8}-[^-]{4}-[^-]{4}-[^-]{4}-[^-]{12}$"
    return F.concat(
        F.lit("/"),
        F.array_join(
            F.transform(
                parts,
                lambda p: F.when(p.rlike(r"^\d+$"), "{id}").when(p.rlike(uuid), "{uuid}").otherwise(p),
            ),
            "/",
        ),
    )


# Whitespace and hashes ------------------------------------------------------

def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squeeze_lines(text: Column) -> Column:
    """Collapse blanks inside lines and drop blank lines."""
    lines = F.transform(F.split(text, r"\r?\n"), squeeze)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def line_count(text: Column) -> Column:
    """Lines as ``splitlines`` counts them: a trailing newline adds none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return F.when(text == "", 0).otherwise(newlines + F.when(text.endswith("\n"), 0).otherwise(1))


def code_hash(code: Column) -> Column:
    return F.substring(F.sha2(F.regexp_replace(code, r"\s+", ""), 256), 1, 16)


def title_hash(title: Column) -> Column:
    return F.concat(F.lit("title-"), F.substring(F.sha2(F.trim(title), 256), 1, 16))


def chunk_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 16)


def path_hash(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 12)


# Redaction ------------------------------------------------------------------

def redact_secrets(text: Column) -> Column:
    return F.regexp_replace(text, K.SECRET_ASSIGNMENT, "$1=***REDACTED***")


def any_match(text: Column, patterns: Sequence[str], ignore_case: bool = False) -> Column:
    flag = "(?i)" if ignore_case else ""
    return text.rlike(flag + "|".join(f"(?:{p})" for p in patterns))


def sanitize_prompt(text: Column) -> Column:
    clean = text
    for pattern in K.INJECTION_PROMPT:
        clean = F.regexp_replace(clean, "(?i)" + pattern, "[REDACTED]")
    clean = F.regexp_replace(clean, r"\s{4,}", " ")
    return F.when(any_match(text, K.DANGEROUS_PROMPT, True), K.BLOCKED_NOTICE).otherwise(clean)


# Classifiers ----------------------------------------------------------------

def rule_cascade(text: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    """First rule whose pattern occurs in ``text`` names the class."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(default)


def detect_key_provider(key: Column) -> Column:
    out = None
    for prefix, provider in K.KEY_PREFIXES:
        hit = key.startswith(prefix)
        out = F.when(hit, provider) if out is None else out.when(hit, provider)
    return out.otherwise("custom")


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language_by_extension(path: Column) -> Column:
    ext = file_extension(path)
    out = None
    for lang, exts in K.LANGUAGE_EXTENSIONS.items():
        hit = ext.isin(*exts)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out


def marker_hits(text: Column, markers: Sequence[str]) -> Column:
    total = F.lit(0)
    for marker in markers:
        total = total + F.when(text.contains(marker), 1).otherwise(0)
    return total


def detect_language(path: Column, content: Column) -> Column:
    """Two marker hits in the first ten lines decide, else the extension."""
    head = F.lower(F.array_join(F.slice(F.split(content, "\n"), 1, 10), " "))
    by_content = [
        F.when(marker_hits(head, markers) >= 2, lang) for lang, markers in K.LANGUAGE_MARKERS
    ]
    return F.coalesce(*by_content, language_by_extension(path))


def classify_section(title: Column) -> Column:
    return rule_cascade(squeeze(title), K.SECTION_RULES, "unknown")


def classify_equation(latex: Column, context: Column) -> Column:
    text = F.lower(F.concat_ws(" ", latex, context))
    return rule_cascade(text, [(kind, "|".join(words)) for kind, words in K.EQUATION_RULES], "unknown")


def detect_domain(text: Column) -> Column:
    """``domain/subdomain`` of the first matching rule."""
    rules = [(f"{domain}/{sub}", pattern) for domain, sub, pattern in K.DOMAIN_RULES]
    return rule_cascade(F.lower(text), rules, "theory/general")


def keyword_category(text: Column) -> Column:
    """Category with most distinct keywords in the text; ties go to the first listed."""
    scored = [
        F.struct(marker_hits(text, words).alias("n"), F.lit(-pos).alias("p"), F.lit(name).alias("name"))
        for pos, (name, words) in enumerate(K.CATEGORY_KEYWORDS)
    ]
    return F.array_max(F.array(*scored))["name"]


def classify_intent(text: Column) -> Column:
    """Intent of a request: compound trigger, then action keyword, then spec name."""
    lowered = F.lower(F.trim(text))

    def plan(action: str, complexity: str, cost: int, confidence: float) -> Column:
        return F.struct(
            F.lit(action).alias("action"), F.lit(complexity).alias("complexity"),
            F.lit(cost).alias("token_cost"), F.lit(confidence).alias("confidence"),
        )

    cases = [(lowered.contains(t), plan(a, c, cost, 0.9)) for t, a, c, cost in K.COMPOUND_INTENTS]
    for action, words, complexity, cost in K.ACTION_INTENTS:
        hit = F.lit(False)
        for word in words:
            hit = hit | lowered.contains(word)
        cases.append((hit, plan(action, complexity, cost, 0.85)))
    cases.append((any_match(lowered, K.SPEC_NAMES), plan("integrate", "complex", 25000, 0.7)))
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(plan("unknown", "simple", 1000, 0.3))


# Metric names ---------------------------------------------------------------

def normalize_metric_name(raw: Column) -> Column:
    name = F.regexp_replace(F.lower(F.trim(raw)), r"[^a-z0-9@\s_\-]", "")
    name = F.regexp_replace(F.regexp_replace(name, r"\s+", "_"), "[-@]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_+|_+$", "")
    synonyms = F.create_map(*[F.lit(x) for pair in K.METRIC_SYNONYMS.items() for x in pair])
    return (
        F.when(synonyms[name].isNotNull(), synonyms[name])
        .when(name.contains("accuracy"), name)
        .when(name.contains("acc"), "accuracy")
        .when(name.rlike("f1|bleu"), name)
        .when(name.contains("rouge_l"), "rouge_l")
        .when(name.rlike("rouge|mrr|map|auc|precision|recall|loss|perplexity|wer|cer"), name)
        .when(name.startswith("top_1"), "top_1_accuracy")
        .when(name.startswith("top_5"), "top_5_accuracy")
        .otherwise(name)
    )


def coerce_metric_value(name: Column, raw: Column, percent: Column) -> Column:
    value = F.coalesce(raw.try_cast("double"), F.lit(0.0))
    scale_free = any_match(name, K.RAW_VALUE_METRICS)
    return (
        F.when(percent, value / 100.0)
        .when(~scale_free & (value > 1.0) & (value <= 100.0), value / 100.0)
        .otherwise(value)
    )


def higher_is_better(name: Column) -> Column:
    return ~F.regexp_replace(F.lower(name), "[- ]", "_").isin(*K.LOWER_IS_BETTER)


# Quality, structure, JSON ---------------------------------------------------

def has_structure(text: Column) -> Column:
    return text.contains("```") | text.contains("#") | text.contains("- ") | text.contains("* ")


def has_code(text: Column) -> Column:
    return text.contains("```") | text.contains("def ") | text.contains("class ")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""))


def text_quality_score(text: Column, expected: Column | None = None) -> Column:
    score = (
        F.least(F.lit(1.0), F.length(text) / 1000) * 0.3
        + F.when(has_structure(text), 0.3).otherwise(0.0)
        + F.when(has_code(text), 0.4).otherwise(0.0)
    )
    if expected is None:
        return score
    want = _words(expected)
    overlap = F.least(F.lit(1.0), F.size(F.array_intersect(_words(text), want)) / F.size(want))
    return F.when(F.size(want) > 0, (score + overlap) / 2).otherwise(score)


def quality_rating(text: Column, score: Column) -> Column:
    return (
        F.when(F.length(text) == 0, "very_poor")
        .when(score >= 0.8, "excellent").when(score >= 0.6, "good")
        .when(score >= 0.4, "fair").when(score >= 0.2, "poor").otherwise("very_poor")
    )


def lesson_flags(text: Column) -> Column:
    # The messages are fixed values.
    lowered = F.lower(text)
    return F.array_compact(F.array(
        F.when(F.length(text) < 50, "Output was too brief - may need more detail"),
        F.when(lowered.contains("error"), "Output contained errors that need addressing"),
        F.when(lowered.contains("undefined") | lowered.contains("not found"), "Missing information detected"),
    ))


def spec_text(*parts: Column) -> Column:
    """Join the non-empty parts of a record with blanks."""
    return F.trim(F.concat_ws(" ", *[F.when(p != "", p) for p in parts]))


def embedded_json(text: Column) -> Column:
    """JSON object inside free text: whole text, fenced block, else the braces span."""
    whole = F.trim(text)
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    span = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    first = F.regexp_extract(text, r"(\{[^{}]*\})", 1)
    tried = [F.when(F.get_json_object(c, "$").isNotNull() & (c != ""), c) for c in (whole, fenced, span, first)]
    return F.coalesce(*tried)


def truncate_sections(sections: Column, wanted: Sequence[str], budget: int) -> Column:
    """Join the wanted section kinds and cut at the character budget (the feature)."""
    kept = F.filter(sections, lambda s: s["kind"].isin(*wanted))
    return F.substring(F.array_join(F.transform(kept, lambda s: s["content"]), "\n\n"), 1, budget)


# Versions -------------------------------------------------------------------

def parse_semver(version: Column) -> Column:
    """``array<int>`` of major, minor, patch, or NULL."""
    parts = F.split(F.trim(version), r"\.")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    padded = F.slice(F.concat(numbers, F.array(F.lit(0), F.lit(0))), 1, 3)
    ok = (F.size(parts) <= 3) & ~F.exists(numbers, lambda n: n.isNull() | (n < 0)) & (F.trim(version) != "")
    return F.when(ok, padded)


def semver_report(version: Column, payload_type: Column, expected: Sequence[str], supported: str = "1.0.0") -> Column:
    """Compatibility issues, warnings and notes of a payload version."""
    # The messages are fixed values.
    p = parse_semver(version)
    s_major, s_minor, s_patch = (int(x) for x in supported.split("."))
    same_major = p[0] == s_major
    issues = F.array_compact(F.array(
        F.when(p.isNull(), F.concat(F.lit("Invalid schema_version format: "), F.when(F.trim(version) == "", "<empty>").otherwise(F.trim(version)))),
        F.when(payload_type == "", "Missing payload_type in payload metadata.")
        .when(~payload_type.isin(*expected), F.concat(F.lit("Unexpected payload_type: "), payload_type)),
        F.when(p[0] != s_major, F.concat(F.lit("Incompatible schema major version: payload="), F.trim(version), F.lit(f" supported={supported}"))),
    ))
    warnings = F.array_compact(F.array(
        F.when(same_major & (p[1] > s_minor), F.concat(F.lit("Payload minor version is newer ("), F.trim(version), F.lit(f") than supported ({supported})."))),
    ))
    notes = F.array_compact(F.array(
        F.when(p[0] != s_major, "Use a matching major schema consumer or add an explicit migration adapter.")
        .when(same_major & (p[1] > s_minor), "Proceed with caution; newer optional fields may be ignored.")
        .when(same_major & (p[1] < s_minor), F.concat(F.lit("Payload minor version is older ("), F.trim(version), F.lit("); compatibility fallback applied.")))
        .when(same_major & (p[1] == s_minor) & (p[2] > s_patch), F.concat(F.lit("Payload patch version is newer ("), F.trim(version), F.lit("); expected to remain compatible."))),
    ))
    return F.struct(issues.alias("issues"), warnings.alias("warnings"), notes.alias("notes"))
