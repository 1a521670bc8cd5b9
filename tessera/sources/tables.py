"""Baselines and reports: Parquet tables by snapshot, with JSON for other programs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, path: str, snapshot: str) -> None:
    """Write under ``snapshot``; other snapshots stay."""
    df.write.mode("overwrite").parquet(f"{path}/snapshot_id={snapshot}")


def load(spark: SparkSession, path: str, snapshot: str, schema: str) -> DataFrame | None:
    """The table of a snapshot, or None if there is none: no baseline is a state of its own."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/snapshot_id={snapshot}")
    except Exception as e:  # the file system says it in its own way
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            return None
        raise


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def one_row_json(report: DataFrame) -> str:
    """A report of one row as indented JSON."""
    return json.dumps(report.first().asDict(recursive=True), indent=2, default=str, ensure_ascii=False)


def markdown(rows: list[dict], title: str) -> str:
    """A table for people."""
    if not rows:
        return f"# {title}\n\nnothing\n"
    names = list(rows[0])
    cell = lambda v: str(v).replace("|", "\\|").replace("\n", " ")
    body = "\n".join("| " + " | ".join(cell(r[n]) for n in names) + " |" for r in rows)
    return f"# {title}\n\n| {' | '.join(names)} |\n|{'-|' * len(names)}\n{body}\n"


def html(rows: list[dict], title: str) -> str:
    from html import escape

    names = list(rows[0]) if rows else []
    head = "".join(f"<th>{escape(n)}</th>" for n in names)
    body = "".join("<tr>" + "".join(f"<td>{escape(str(r[n]))}</td>" for n in names) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1><table><tr>{head}</tr>{body}</table>\n"
