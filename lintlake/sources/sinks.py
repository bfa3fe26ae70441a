"""Writers: result tables, word lists, snapshots, graph export and the audit log. Only small tables are rendered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_family(df: DataFrame, root: str, name: str, scan_run_id: str, mode: str = "overwrite") -> None:
    """One finding table below ``root`` in a folder per run, so that a run is replaced or read alone."""
    df.write.mode(mode).parquet(f"{root}/{name}/scan_run_id={scan_run_id}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_wordlist(df: DataFrame, column: str, path: str) -> None:
    """Sorted distinct non-null values, one a line; range-partitioned, so the parts in order are the whole list."""
    df.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct().orderBy("value").write.mode("overwrite").text(path)


def write_partitioned(df: DataFrame, path: str, by: str) -> None:
    """The evidence store: one folder per key."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def append_audit(decisions: DataFrame, path: str) -> None:
    decisions.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Node-link form: one JSON line per node and per edge."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/links")


def render_markdown(tables: dict[str, DataFrame], limit: int = 20) -> str:
    """A report of the first rows of each table, in the tables' own order; only ``limit`` rows reach the driver."""
    out = ["# Scan report", ""]
    for title, df in tables.items():
        rows = df.limit(limit).collect()
        out += [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join(str(x).replace("|", "\\|").replace("\n", " ") for x in r) + " |" for r in rows]
        out.append("")
    return "\n".join(out)
