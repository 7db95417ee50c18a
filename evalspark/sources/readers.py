"""Readers of logs, trajectories, catalogs, documents of functions and label sheets, with explicit schemas."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.canon import mapped_json
from evalspark.operators.catalogs import first_wins, plain_schema, sanitized
from evalspark.operators.invariants import duplicates, require
from evalspark.operators.stats import cell_of_file
from evalspark.shared import read_text

CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,tool_calls:array<{CALL}>,error:string,turn_idx:int,raw_data:string,usage:struct<completion_tokens:int>>"
RUN_LOG = "config_fingerprint string, config_name string, task_id string, seed int, ts double, smoke boolean, mode string, temperature double, tau2_seed int, reward double, trajectory_file string, n_messages int"
FREE_LOG = RUN_LOG + ", catalog int, termination string, backend string, concurrency int, simulator string, threshold double, student_turns int, escalated_turns int, tool_calls int, parse_errors int, context_overflows int, distractor_calls int, hallucinated_calls int, degenerate_user_turn boolean"
TRAJECTORY = f"simulations array<struct<task_id:string,reward_info:struct<reward:double>,messages:array<{MESSAGE}>>>"
COMPLETION = "step_id string, sample int, completion string, prompt_tokens int, completion_tokens int, finish_reason string, token_ids array<int>, token_logprobs array<double>, first_top array<struct<id:int,lp:double>>"
SFT_RECORD = "task_id string, rep int, temperature double, n_decisions int, chars int, segments array<struct<text:string,train:boolean>>"
LABEL_SHEET = "step_id string, auto_bucket string, human_bucket string, reference_tools string, completion string, context string"


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return found is not None and len(found) > 0


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, ordinal, n, text): the lines of files, numbered from 0 in the split they are read by, n how many that split has.

    A file is read by many tasks, each a range of its bytes. Lines are numbered as they come, batch by batch; how
    many a range has is counted apart and joined on (file, range), so no file and no range is one task's alone.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, int] = {}
        for batch in batches:
            at = np.empty(batch.num_rows, np.int64)
            files, blocks = batch.column("file").dictionary_encode(), batch.column("block").to_numpy()
            codes = files.indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if b > a:
                    key = (files.dictionary[int(codes[a])].as_py(), int(blocks[a]))
                    at[a:b] = np.arange(seen.get(key, 0), seen.get(key, 0) + b - a)
                    seen[key] = int(at[b - 1]) + 1
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), pa.array(at), batch.column("text")], ["file", "block", "ordinal", "text"])

    return lines.mapInArrow(number, "file string, block bigint, ordinal bigint, text string")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of append-only logs, with `file` and `line`.

    A missing file is an empty table and blank lines are no records. A last line that can't be read was cut off
    while it was written and is dropped; such a line before it is an error that names file and line. Lines end
    at the line feed only. Large files are read by many tasks.
    """
    fields = T.StructType.fromDDL(schema)
    named = T.StructType([*fields.fields, T.StructField("file", T.StringType()), T.StructField("line", T.LongType())])
    if not exists(spark, path):
        return spark.createDataFrame([], named)
    lines = _numbered(spark, path)
    counts = spark.read.option("lineSep", "\n").text(path).groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).agg(F.count("*").alias("n"))
    whole = Window.partitionBy("file")
    counts = counts.select("file", "block", (F.sum("n").over(whole.orderBy("block")) - F.col("n")).alias("below"), F.sum("n").over(whole).alias("total"))  # a row a range
    placed = lines.join(counts, ["file", "block"]).where(F.trim("text") != "").select("file", "text", (F.col("below") + F.col("ordinal") + 1).alias("line"), "total")
    parsed = T.StructType([*fields.fields, T.StructField("_corrupt", T.StringType())])
    rows = placed.withColumn("r", F.from_json("text", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("r._corrupt").isNotNull() | F.col("r").isNull()
    said = F.concat(F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(" is no JSON record"))
    kept = rows.where(F.when(broken & (F.col("line") < F.col("total")), F.raise_error(said).cast("boolean")).otherwise(~broken))
    return kept.select(*(F.col(f"r.`{f.name}`") for f in fields.fields), "file", "line")


def strict_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of finished files, split over tasks; any bad line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def trajectories(spark: SparkSession, path: str, check: bool = True, lines: bool = False) -> DataFrame:
    """(file, task_id, reward, messages) of the scored simulations; a task scored twice in a file is refused.

    A file is one document, or with `lines` a document a line, each with the name of the `file` it was.
    """
    read = spark.read.schema(TRAJECTORY + (", file string" if lines else "")).option("multiLine", not lines).json(path)
    if not lines:
        read = read.withColumn("file", F.col("_metadata.file_path"))
    sims = read.select("file", F.explode("simulations").alias("s")).where("s.reward_info is not null")
    rows = sims.select("file", "s.task_id", "s.reward_info.reward", "s.messages")
    if check:
        require(duplicates(rows, ["file", "task_id"]), "one scored simulation a task")
    return rows


def log_name(file: Column) -> Column:
    """The log a path belongs to: the last `.jsonl` name in it, a file's or that of a folder of parts, without `column=`."""
    return F.regexp_extract(file, r"([^/=]+\.jsonl)(?:/[^/]*)?$", 1)


def free_cells(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of free-run logs with the label, threshold and catalog their file names hold; other files are left out."""
    rows = jsonl(spark, pattern, FREE_LOG)
    cell = cell_of_file(log_name(F.col("file")))
    return rows.withColumn("cell", cell).where("cell is not null").select("*", F.col("cell.label").alias("file_label"), F.col("cell.threshold").alias("file_threshold"), F.col("cell.catalog").alias("file_catalog")).drop("cell")


def forced_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all forced results in a folder but those of smoke runs."""
    return jsonl(spark, f"{folder}/*forced-*.jsonl", schema).where(~log_name(F.col("file")).endswith(".smoke.jsonl"))


def functions(spark: SparkSession, folder: str) -> DataFrame:
    """(name, doc, schema, file) of function documents: the folder's files, then its multi_turn_func_doc; the first of a name wins.

    A record has a list `function` or is a function itself. schema is the record's parameters as plain JSON Schema.
    """
    def lines(pattern: str, group: int) -> DataFrame:
        if not exists(spark, pattern):
            return spark.createDataFrame([], "group int, file string, block bigint, ordinal bigint, text string")
        return _numbered(spark, pattern).where(F.trim("text") != "").select(F.lit(group).alias("group"), "file", "block", "ordinal", "text")

    read = lines(f"{folder}/*.json", 0).unionByName(lines(f"{folder}/multi_turn_func_doc/*.json", 1))
    listed = F.from_json(F.get_json_object("text", "$.function"), "array<string>")
    docs = read.select("group", "file", "block", "ordinal", F.posexplode(F.coalesce(listed, F.array("text"))).alias("pos", "doc"))
    named = docs.withColumn("name", sanitized(F.get_json_object("doc", "$.name"))).where("name is not null")
    first = first_wins(named, "name", ["group", "file", "block", "ordinal", "pos"])
    return first.select("name", "doc", mapped_json(plain_schema)(F.get_json_object("doc", "$.parameters")).alias("schema"), "file")


def pinned(spark: SparkSession, path: str, sha256: str) -> str:
    """The text of one small file, refused if its hash isn't the pinned one."""
    content = spark.read.format("binaryFile").load(path).select("content", F.sha2("content", 256).alias("sha")).first()
    if content is None or content.sha != sha256:
        raise ValueError(f"{path} isn't the pinned file: {content and content.sha}")
    return bytes(content.content).decode()


def catalog(spark: SparkSession, path: str, sha256: str, size: int) -> list[dict]:
    """The tools of a pinned catalog of the given size."""
    tools = json.loads(pinned(spark, path, sha256))["tools"]
    if len(tools) != size:
        raise ValueError(f"{path} holds {len(tools)} tools instead of {size}")
    return tools


def label_sheet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABEL_SHEET).csv(path, header=True, multiLine=True, escape='"')


def line_counts(spark: SparkSession, pattern: str, expected: int | None = None) -> DataFrame:
    """(file, n) of the lines that aren't blank; with `expected` another total is refused."""
    found = spark.read.text(pattern).where(F.trim("value") != "").groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("n"))
    if expected is not None:
        require(found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).where(F.col("n") != expected), f"{expected} lines in {pattern}")
    return found


def merged(base: dict, over: dict) -> dict:
    """`over` laid over `base`, object by object; lists and other values replace."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def config(path: str | Path, load=json.loads, spark: SparkSession | None = None, _above: tuple = ()) -> dict:
    """A configuration file with those it `extends` (one or a list, from left to right) below it; a circle is refused.

    Paths in `extends` are relative to the file's folder. With a session the files are on any file system it reads.
    """
    here = Path(path).resolve() if spark is None else str(path)
    if here in _above:
        raise ValueError(f"{here} extends itself")
    own = load(here.read_text() if spark is None else read_text(spark, here))
    parents = own.pop("extends", [])
    found: dict = {}
    for parent in [parents] if isinstance(parents, str) else parents:
        beside = here.parent / parent if spark is None else f"{here.rpartition('/')[0]}/{parent}"
        found = merged(found, config(beside, load, spark, (*_above, here)))
    return merged(found, own)
