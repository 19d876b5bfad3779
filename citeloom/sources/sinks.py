"""Writers: append logs, nested records, graphs, tables, reports, metrics text, TTL results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def append_jsonl(events: DataFrame, path: str) -> None:
    """Append events to a JSONL log partitioned by day."""
    events.withColumn("date", F.to_date("timestamp")).write.mode("append").partitionBy("date").json(path)


def write_paper_documents(papers: DataFrame, path: str) -> None:
    papers.write.mode("overwrite").json(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link export as two line types, so a hub's adjacency never has to fit one row."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("value"))
    e = edges.select(F.to_json(F.struct(F.lit("link").alias("type"), F.col("src").alias("source"), F.col("dst").alias("target"))).alias("value"))
    return n.unionAll(e)


def write_graph_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    node_link(nodes, edges).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, partition: Sequence[str] = (), sort: Sequence[str] = ()) -> None:
    """Parquet table laid out for pruning: partition columns, rows sorted inside files."""
    out = df.sortWithinPartitions(*sort) if sort else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)


def delete_rows(table: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows left after deleting the given keys."""
    return table.join(keys, list(on), "left_anti")


def export_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def markdown_rows(df: DataFrame) -> DataFrame:
    """Report rows as Markdown table lines."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def write_report(report: DataFrame, path: str) -> None:
    """JSON and Markdown of an aggregated report."""
    report.write.mode("overwrite").json(f"{path}/json")
    markdown_rows(report).write.mode("overwrite").text(f"{path}/markdown")


def prometheus_lines(metrics: DataFrame) -> DataFrame:
    """``name{label="v",...} value`` lines with sorted labels from ``(name, labels map, value)``."""
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.concat_ws(",", pairs), F.lit("}"))).otherwise(""),
                                   F.lit(" "), F.col("value").cast("string")).alias("value"))


# Stage results with a lifetime -------------------------------------------------

def result_key(stage: Column, *args: Column) -> Column:
    """First 32 hex digits of the hash of a stage and its arguments."""
    return F.substring(F.sha2(F.concat_ws("|", stage, *[a.cast("string") for a in args]), 256), 1, 32)


def live_results(results: DataFrame, as_of: Column) -> DataFrame:
    return results.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= as_of))


def result_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length("payload")), F.lit(0)).alias("total_bytes"))
