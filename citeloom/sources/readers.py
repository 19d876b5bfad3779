"""Readers with explicit schemas: logs, graphs, papers, feeds, source trees, key files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from citeloom.functions import text as X
from citeloom.operators.rules import is_ignored_path

USAGE_LOG = "timestamp string, provider string, endpoint string, key_id bigint, tokens_used bigint, cost_usd double, latency_ms bigint, status string, error string"
AUDIT_LOG = "id bigint, timestamp string, event_type string, key_id bigint, success boolean, details map<string,string>"
PAPER_DOCUMENT = (
    "title string, authors array<string>, arxiv_id string, doi string, year int, abstract string, "
    "sections array<struct<title:string,level:int,content:string,page_start:int>>, equations array<struct<latex:string,description:string,page:int>>, "
    "algorithms array<struct<name:string,pseudocode:string,page:int,language_hint:string>>, figures array<struct<caption:string,page:int,image_path:string>>, "
    "full_text string, references array<string>, keywords array<string>, domain string")
GRAPH_NODE = "struct<title:string,year:int,citations:array<string>,references:array<string>>"


def read_jsonl_log(spark: SparkSession, path: str, schema: str = USAGE_LOG, required: tuple[str, ...] = ("timestamp", "provider", "endpoint")) -> tuple[DataFrame, DataFrame]:
    """(events, rejects): lines that are no JSON or miss a required key become rejects."""
    raw = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    good = F.col("_bad").isNull()
    for name in required:
        good = good & F.col(name).isNotNull()
    events = raw.filter(good).drop("_bad")
    if "status" in events.columns:
        events = events.fillna("success", ["status"])
    return events, raw.filter(~good)


def read_paper_documents(spark: SparkSession, path: str) -> DataFrame:
    """Nested paper records; missing strings become '', numbers 0, lists empty."""
    df = spark.read.schema(PAPER_DOCUMENT).json(path)
    fixes = {}
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        if kind == "string":
            fixes[f.name] = F.coalesce(f.name, F.lit(""))
        elif kind == "int":
            fixes[f.name] = F.coalesce(f.name, F.lit(0))
        else:
            fixes[f.name] = F.coalesce(f.name, F.array().cast(f.dataType))
    return df.withColumns(fixes)


def graph_tables(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of rows holding a ``nodes`` map; mentioned ids get a blank node."""
    flat = raw.select(F.explode("nodes").alias("id", "n"))
    nodes = flat.select("id", F.coalesce("n.title", F.lit("")).alias("title"), F.coalesce("n.year", F.lit(0)).alias("year"))
    refs = flat.select(F.col("id").alias("src"), F.explode("n.references").alias("dst"))
    cits = flat.select(F.explode("n.citations").alias("src"), F.col("id").alias("dst"))
    edges = refs.unionByName(cits).distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ghosts = ends.join(nodes, "id", "left_anti").select("id", F.lit("").alias("title"), F.lit(0).alias("year"))
    return nodes.unionByName(ghosts), edges


def read_graph_json(spark: SparkSession, path: str, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Graph files ``{nodes: {id: {...}}}``: pretty-printed ones, or one document per line (splittable)."""
    return graph_tables(spark.read.schema(f"nodes map<string,{GRAPH_NODE}>").option("multiLine", multi_line).json(path))


def scan_source_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Source files below a folder with decoded contents, vendored and built paths left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    path = F.regexp_replace("path", r"^file:/+", "/")
    return files.select(path.alias("path"), F.decode("content", "UTF-8").alias("content"), "length").filter(~is_ignored_path(F.col("path")))


FEED_ENTRY = "id string, title string, summary string, published string, author array<struct<name:string>>, category array<struct<_term:string>>, link array<struct<_href:string,_title:string>>"


def read_feed_xml(spark: SparkSession, path: str) -> DataFrame:
    """Atom entries as paper rows; an unreadable date counts as January 2024."""
    e = spark.read.format("xml").schema(FEED_ENTRY).option("rowTag", "entry").option("multiLine", False).load(path)
    pdf = F.filter(F.coalesce("link", F.array().cast("array<struct<_href:string,_title:string>>")), lambda l: l["_title"] == "pdf")
    return e.select(
        F.regexp_extract("id", r"(\d+\.\d+)", 1).alias("paper_id"), X.squeeze(F.col("title")).alias("title"), X.squeeze(F.col("summary")).alias("abstract"),
        F.transform("author", lambda a: a["name"]).alias("authors"), F.coalesce(F.substring("published", 1, 4).try_cast("int"), F.lit(2024)).alias("year"),
        F.coalesce(F.substring("published", 6, 2).try_cast("int"), F.lit(1)).alias("month"), F.transform("category", lambda c: c["_term"]).alias("categories"),
        F.get(pdf, F.lit(0))["_href"].alias("pdf_url"))


ARTICLE = (
    "MedlineCitation struct<PMID:string,Article:struct<ArticleTitle:string,Abstract:struct<AbstractText:string>,AuthorList:struct<Author:array<struct<ForeName:string,LastName:string>>>,"
    "Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,Month:string>>>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>")
# Month names of the article feed.
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()


def read_article_xml(spark: SparkSession, path: str) -> DataFrame:
    a = spark.read.format("xml").schema(ARTICLE).option("rowTag", "PubmedArticle").option("multiLine", False).load(path)
    art, date = "MedlineCitation.Article", "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    doi = F.filter("PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == "doi")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(f"{date}.Month", 1, 3)).cast("int")
    return a.select(
        F.col("MedlineCitation.PMID").alias("pubmed_id"), F.col(f"{art}.ArticleTitle").alias("title"), F.coalesce(f"{art}.Abstract.AbstractText", F.lit("")).alias("abstract"),
        F.transform(f"{art}.AuthorList.Author", lambda x: F.concat_ws(" ", x["ForeName"], x["LastName"])).alias("authors"),
        F.coalesce(F.col(f"{date}.Year").try_cast("int"), F.lit(2024)).alias("year"),
        F.coalesce(F.when(month > 0, month), F.col(f"{date}.Month").try_cast("int"), F.lit(1)).alias("month"),
        F.col(f"{art}.Journal.Title").alias("journal"), F.coalesce(F.get(doi, F.lit(0))["_VALUE"], F.lit("")).alias("doi"))


# Key imports ------------------------------------------------------------------

def provider_of(text: Column, key: Column) -> Column:
    low = F.lower(text)
    named = (F.when(low.rlike("anthropic|claude"), "anthropic").when(low.rlike("openai|gpt"), "openai")
             .when(low.contains("github"), "github").when(low.contains("google"), "google"))
    return F.coalesce(named, X.detect_key_provider(key))


def read_key_csv(spark: SparkSession, path: str) -> DataFrame:
    """Title/Password/URL/Notes export; rows without a password are marked skipped."""
    df = spark.read.schema("Title string, Password string, URL string, Notes string").option("header", True).csv(path).fillna("")
    return df.select(
        F.col("Title").alias("name"), F.col("Password").alias("key"), provider_of(F.concat_ws(" ", "Title", "Notes", "URL"), F.col("Password")).alias("provider"),
        (F.col("Password") == "").alias("skipped"))


def read_dotenv(spark: SparkSession, path: str) -> DataFrame:
    """NAME=value lines; comments and other lines skipped, quotes stripped."""
    lines = spark.read.text(path)
    name = F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Z_][A-Z0-9_]*)=(.*)$", 1)
    value = F.regexp_replace(F.trim(F.regexp_extract("value", r"^\s*(?:export\s+)?([A-Z_][A-Z0-9_]*)=(.*)$", 2)), r"""^["']|["']$""", "")
    return lines.filter(name != "").select(name.alias("name"), value.alias("key"), provider_of(F.lit(""), value).alias("provider"), (value == "").alias("skipped"))


def dedupe_keys(keys: DataFrame, pos: str) -> DataFrame:
    """First row per sha256 fingerprint of the key."""
    from citeloom.operators.sets import dedupe_first

    return dedupe_first(keys, F.sha2("key", 256), [pos])
