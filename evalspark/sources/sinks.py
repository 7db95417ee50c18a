"""Sinks: appended logs, whole files with a manifest, summaries, tables in Markdown, label sheets."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.shared import write_text

RESERVED = {"config_fingerprint", "config_name", "task_id", "seed", "ts", "smoke"}
SHEET_CHARS = 1500


def append_log(payload: DataFrame, path: str, identity: dict[str, str], per_file: int | None = None) -> None:
    """Append records; a payload column that the log itself sets is refused. per_file bounds the rows of a file."""
    if clash := (RESERVED - {"task_id", "seed"}) & set(payload.columns):
        raise ValueError(f"the log sets these columns itself: {sorted(clash)}")
    rows = payload.select("*", *(F.lit(v).alias(k) for k, v in identity.items()), F.unix_micros(F.current_timestamp()).cast("double").__truediv__(1e6).alias("ts"))
    writer = rows.write.mode("append")
    if per_file:
        writer = writer.option("maxRecordsPerFile", per_file)
    writer.json(path)


def write_with_manifest(rows: DataFrame, path: str, order: list[str], counts: list[Column] | None = None, parts: int | None = None) -> dict:
    """Write ordered JSON lines as a table of part files and give a manifest: rows, hash, and the named `counts` over the rows.

    Parts are ranges of the order, `parts` of them or as many as Spark deems right. Each written part is read back
    and hashed (SHA-256) by its own task; the manifest's hash is SHA-256 over the parts' hashes in order, or the
    only part's own. What is on the driver is a hash a part.
    """
    spark = rows.sparkSession
    lines = rows.select(*order, F.to_json(F.struct(*rows.columns)).alias("line"))
    ranged = lines.repartitionByRange(parts, *order) if parts else lines.repartitionByRange(*order)
    ranged.sortWithinPartitions(*order, "line").select("line").write.mode("overwrite").text(path)
    written = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("path", F.sha2("content", 256).alias("sha"))
    hashes = [r.sha for r in written.orderBy("path").collect()]
    digest = hashes[0] if len(hashes) == 1 else hashlib.sha256("".join(hashes).encode()).hexdigest()
    found = rows.agg(F.count("*").alias("n"), *(counts or [])).first()
    return {"file": path, "parts": len(hashes), "hash": digest, **found.asDict()}


def training_counts() -> list[Column]:
    """What a manifest of training records says of them: decisions, tasks, the longest, and the tasks by length and text."""
    tasks = F.array_sort(F.collect_set(F.struct(F.length("task_id").alias("n"), F.col("task_id").alias("id"))))
    return [F.coalesce(F.sum("n_decisions"), F.lit(0)).alias("n_decisions"), F.countDistinct("task_id").alias("n_tasks"), F.coalesce(F.max("chars"), F.lit(0)).alias("max_chars"), F.transform(tasks, lambda t: t["id"]).alias("task_ids")]


def write_summary(rows: DataFrame, path: str, most: int = 10_000) -> None:
    """A small aggregate as readable JSON, on any file system; more than `most` rows are refused, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} rows are no summary")
    write_text(rows.sparkSession, path, json.dumps([r.asDict(recursive=True) for r in found], indent=2, default=str, ensure_ascii=False) + "\n")


def percent(value: float | None, complete: bool = True, done: str = "") -> str:
    if not complete:
        return f"{done} so far"
    return "n/a" if value is None else f"{100 * value:.1f} %"


def pivoted(rows: DataFrame, by: str, column: str, value: Column, columns: list) -> DataFrame:
    """One row a value of `by`, a column for each of the given values of `column`."""
    return rows.groupBy(by).pivot(column, columns).agg(value)


def write_cells(rows: DataFrame, folder: str, name: str) -> None:
    """Rows as one folder of JSON lines for each log name, `<folder>/log=<name>/`."""
    rows.withColumnRenamed(name, "log").write.mode("append").partitionBy("log").json(folder)


def markdown(rows: DataFrame, by: str, column: str, value: str, columns: list[str]) -> str:
    """A pivoted table in Markdown."""
    table = pivoted(rows, by, column, F.first(value), columns).orderBy(by).collect()
    head = [f"| {by} | " + " | ".join(columns) + " |", "|" + "---|" * (len(columns) + 1)]
    return "\n".join(head + ["| " + " | ".join([str(r[by]), *(percent(r[c]) for c in columns)]) + " |" for r in table])


def write_label_sheet(rows: DataFrame, path: str) -> None:
    """A CSV for people, with the completion's first characters."""
    cut = rows.withColumn("completion", F.substring("completion", 1, SHEET_CHARS))
    # One file for people; the work in front of it stays spread.
    cut.repartition(1).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
