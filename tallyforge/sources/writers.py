"""Writers: tasks by partition, appended runs, publication without the held-out part, text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_tasks(tasks: DataFrame, path: str) -> None:
    """Tasks as JSON lines in a folder for each partition."""
    tasks.write.mode("overwrite").partitionBy("partition").json(path)


def append_runs(runs: DataFrame, path: str) -> None:
    """Runs are added to those that are there; nothing is read or rewritten."""
    runs.write.mode("append").json(path)


def publish(tasks: DataFrame, path: str, embargo: tuple[str, ...] = ("held_out",)) -> None:
    """All partitions but those under embargo; a null partition isn't known to be free and stays too."""
    write_tasks(tasks.where(~F.coalesce(F.col("partition").isin(*embargo), F.lit(True))), path)


def text_table(rows: DataFrame, most: int = 100) -> str:
    """At most ``most`` rows as a table of fixed width, for a report; more rows are a count below it."""
    found = rows.limit(most + 1).collect()
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in found[:most]]]
    width = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, width, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:], *(["..."] if len(found) > most else [])])


def write_lines(rows: DataFrame, path: str, order: str, line: str) -> None:
    """``line`` of all rows, in this order, as one text file: for files that people read, which have an order."""
    rows.orderBy(order).select(line).coalesce(1).write.text(path)


def write_settings(settings: DataFrame, path: str) -> None:
    """Rows (section, place, entry) as a Markdown file: a heading for each section, its entries in order."""
    heads = settings.select("section").distinct().select("section", F.lit(-1).cast("long").alias("place"), F.concat(F.lit("## "), F.col("section")).alias("line"))
    lines = heads.unionByName(settings.select("section", "place", F.col("entry").alias("line")))
    write_lines(lines.select(F.struct("section", "place").alias("at"), "line"), path, "at", "line")
