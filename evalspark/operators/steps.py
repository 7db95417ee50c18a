"""Smaller rules of steps, prompts, served turns and training groups."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalspark.functions.joins import on_groups
from evalspark.functions.text import strip
from evalspark.operators.invariants import duplicates, require
from evalspark.operators.scoring import BUCKETS, OUTSIDE
from evalspark.operators.turns import IM_END, IM_START
from evalspark.shared import written

# Fixed texts: what stands for an empty turn, and for one that didn't fit.
EMPTY_REPLY = "[empty response]"


def step_parts(step_id: Column) -> Column:
    """(task, rep, index) of `task:rep:index`; the task may hold colons. Null if it isn't of that form."""
    part = lambda i: F.regexp_extract(step_id, r"(?s)^(.*):([^:]*):(\d+)$", i)
    return F.when(step_id.rlike(r"(?s)^.*:[^:]*:\d+$"), F.struct(part(1).alias("task"), part(2).alias("rep"), part(3).try_cast("int").alias("index")))


def by_length(key: Column) -> list[Column]:
    """An order that is numeric for numbers without signs: by length, then by text."""
    return [F.length(key), key]


def numbers_first(key: Column) -> list[Column]:
    """Whole numbers by value, everything else after them by text."""
    return [F.coalesce(F.when(key.rlike("^[0-9]+$"), key.try_cast("int")), F.lit(1 << 30)), key]


def places(rows: DataFrame, orders: dict[str, str]) -> DataFrame:
    """`rows` with their place, from 1, in each named order of a unique column.

    An order's rows are range-partitioned and sorted, counted by task, and numbered inside their task: no task
    holds more than a range.
    """
    for name, column in orders.items():
        ranged = rows.repartitionByRange(F.col(column)).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id())
        ranged = written(ranged.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at") - F.shiftleft(F.col("_part"), 33)), "places")
        sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
        below = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_below"))  # a row a partition
        rows = ranged.join(F.broadcast(below), "_part").withColumn(name, F.col("_below") + F.col("_at") + 1).drop("_part", "_at", "_below")
    return rows


def first_present(ordered: DataFrame, present: DataFrame, key: str, ordinal: str, n: int) -> DataFrame:
    """The first n keys by ordinal among those that are present: filtered, then limited."""
    return ordered.join(present.select(key).distinct(), key, "left_semi").orderBy(ordinal).limit(n)


def pending_first(ordered: DataFrame, done: DataFrame, key: str, ordinal: str, n: int) -> DataFrame:
    """The first n keys by ordinal that aren't done: limited, then filtered. A key that is there twice is refused."""
    require(duplicates(ordered, [key]), f"each {key} once")
    return ordered.orderBy(ordinal).limit(n).join(done.select(key).distinct(), key, "left_anti")


def in_catalog_order(catalog: DataFrame, native: DataFrame) -> DataFrame:
    """The catalog with whether each tool is the environment's own; order by its ordinal."""
    return catalog.join(native.select("name").distinct().withColumn("own", F.lit(True)), "name", "left").na.fill(False, ["own"])


def missing_native(catalog: DataFrame, native: DataFrame) -> DataFrame:
    """Native tools the catalog lacks: there must be none."""
    return native.select("name").join(catalog.select("name"), "name", "left_anti")


def tail(prompt: Column, turns: int = 2, chars: int = 600) -> Column:
    """The last turns in front of the decision, each its last characters, for a person to judge."""
    parts = F.split(prompt, r"\Q" + IM_START + r"\E")
    n = F.size(parts)
    start = F.greatest(F.lit(1), n - turns)
    kept = F.slice(parts, start, F.greatest(F.lit(0), n - start))
    return F.array_join(F.transform(kept, lambda t: F.right(strip(F.replace(t, F.lit(IM_END), F.lit(""))), F.lit(chars))), "\n")


def without_fence(text: Column) -> Column:
    """What stands in a code fence that holds the whole text; other texts as they are."""
    pattern = r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$"
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)


def completion_form(text: Column) -> Column:
    """(kind, n_blocks): the part of reading a completion that needs no JSON: reply, empty, unclosed or blocks, and how many."""
    body = F.substring_index(text, IM_END, 1)
    blocks = F.size(F.regexp_extract_all(body, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), 1))
    kind = F.when(F.contains(body, F.lit("<tool_call>")), F.when(blocks > 0, "blocks").otherwise("unclosed")).when(strip(body) != "", "reply").otherwise("empty")
    return F.struct(kind.alias("kind"), blocks.alias("n_blocks"))


def served_turn(parsed: Column, completion: Column, overflow: Column, overflow_reply: str) -> Column:
    """(content, calls) of a turn from `canon.parse_completion`: calls, a reply, or what was said although it can't be read."""
    said = strip(F.substring_index(F.coalesce(completion, F.lit("")), IM_END, 1))
    content = F.when(overflow, F.lit(overflow_reply)).when(parsed["kind"] == "tool_call", F.lit(None)).when(parsed["kind"] == "reply", parsed["text"]).when(said != "", said).otherwise(F.lit(EMPTY_REPLY))
    calls = F.when(~overflow & (parsed["kind"] == "tool_call"), parsed["calls"]).otherwise(F.array().cast("array<struct<name:string,strict:string,normal:string,arguments:string>>"))
    return F.struct(content.alias("content"), calls.alias("calls"))


def student_action(parsed: Column) -> Column:
    """(kind, content, calls, error) of a parsed completion as a caller would execute it; unparsed has no action."""
    kind = F.coalesce(parsed["kind"], F.lit("unparsed"))
    return F.struct(kind.alias("kind"), F.when(kind == "reply", parsed["text"]).alias("content"), F.transform(parsed["calls"], lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments"))).alias("calls"), F.when(kind == "unparsed", parsed["error"]).alias("error"))


def answered_by(escalated: Column, action: Column) -> Column:
    return F.when(~escalated, "student").when(action.isNotNull(), "teacher").otherwise("nobody")


def token_number(token: Column) -> Column:
    """n of `token_id:<n>`; an error for any other text."""
    return F.when(token.rlike(r"^token_id:-?\d+$"), F.regexp_extract(token, r"(-?\d+)$", 1).try_cast("int")).otherwise(F.raise_error(F.concat(token, F.lit(" is no token_id:<n>"))).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    n = F.least(F.size(a), F.size(b))
    differ = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: ~x.eqNullSafe(y))
    at = F.array_position(differ, True)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(n)


def is_prefix(prefix: Column, ids: Column) -> Column:
    """Whether the tokens of a prompt are the first tokens of the whole."""
    return common_prefix(prefix, ids) == F.size(prefix)


def length_guard(rows: DataFrame, length: str, limit: int, aligned: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows that fit, (reason, n) of the others): too_long, or token_boundary where tokens don't line up. Nothing is cut."""
    reason = F.when(F.col(length) > limit, "too_long")
    if aligned:
        reason = F.when(~F.col(aligned), "token_boundary").when(F.col(length) > limit, "too_long")
    marked = rows.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").groupBy(F.col("_reason").alias("reason")).agg(F.count("*").alias("n"))


def longest_over(rows: DataFrame, key: str, length: str, limit: int, shown: int = 5) -> DataFrame:
    """The longest rows over a limit, for a guard that refuses the whole set: it must be empty."""
    return rows.where(F.col(length) > limit).select(key, length).orderBy(F.col(length).desc(), key).limit(shown)


def options(items: Column) -> Column:
    """`name=value` texts as a map; a text without name, sign or value is an error. Values may hold the sign."""
    cut = lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.substring(x, F.locate("=", x) + 1, F.length(x)).alias("v"))
    good = lambda x: x.rlike(r"(?s)^[^=]+=.+$")
    checked = F.transform(items, lambda x: F.when(good(x), cut(x)).otherwise(F.raise_error(F.concat(F.lit("NAME=VALUE expected, not "), x)).cast("struct<k:string,v:string>")))
    return F.map_from_entries(checked)


def parent_of(rows: DataFrame, registry: DataFrame, sha: str, name: str) -> DataFrame:
    """`rows` with the first name that is registered for their hash, null for an unregistered one."""
    first = registry.groupBy(sha).agg(F.min(name).alias("parent"))
    return rows.join(first, sha, "left")


def latest_by_step(rows: DataFrame, key: str, order: str, needed: str | None = None) -> DataFrame:
    """The last row of each key in file order; a kept row without the needed column is an error."""
    if needed is not None:
        there = F.when(F.col(needed).isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit(f"no {needed} in "), F.col(key).cast("string"))).cast("boolean"))
        return latest_by_step(rows, key, order).where(there)
    fields = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(fields, order).alias("_r")).select("_r.*")


def label_agreement(sheet: DataFrame) -> DataFrame:
    """One row: labelled, agreeing, agreement, passes from 90 % on. Blank labels don't count, unknown ones are an error."""
    human = F.trim("human_bucket")
    known = human.isin(*BUCKETS, *OUTSIDE)
    rows = sheet.where(human != "").where(F.when(known, True).otherwise(F.raise_error(F.concat(F.lit("unknown bucket "), human)).cast("boolean")))
    agg = rows.agg(F.count("*").alias("labelled"), F.count_if(human == F.col("auto_bucket")).alias("agreeing"))
    rate = F.try_divide(F.col("agreeing").cast("double"), F.col("labelled").cast("double"))
    return agg.select("labelled", "agreeing", rate.alias("agreement"), F.coalesce(rate >= 0.9, F.lit(False)).alias("passes"))


def failures(rows: DataFrame, by: list[str], key: str, shown: int = 8) -> DataFrame:
    """(by, n, first, more): how many failed, the first keys in order and how many more there are."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(key).alias("_keys"))
    # The rank is filtered right away, so only the first keys of a group leave a task.
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(key))
    top = rows.select(*by, key).distinct().withColumn("_rank", rank).where(F.col("_rank") <= shown)
    firsts = top.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("first"))
    return on_groups(counts, firsts, by).select(*by, "n", "first", F.greatest(F.lit(0), F.col("_keys") - shown).alias("more"))


def policy_metrics(groups: DataFrame, by: list[str], components: list[str]) -> DataFrame:
    """(by, reward, flat_groups, call_rate, truncated, r_<component>) of completions with reward, group, called, cut and components.

    A component's mean is over the completions that have it; flat groups are those whose rewards are all equal.
    """
    per = groups.groupBy(*by, "group").agg(F.stddev_pop("reward").alias("_sd")).groupBy(*by).agg(F.try_divide(F.count_if(F.col("_sd") < 1e-6).cast("double"), F.count("*").cast("double")).alias("flat_groups"))
    rows = groups.groupBy(*by).agg(F.avg("reward").alias("reward"), F.avg(F.col("called").cast("double")).alias("call_rate"), F.avg(F.col("cut").cast("double")).alias("truncated"), *(F.avg(c).alias(f"r_{c}") for c in components))
    return on_groups(rows, per, by)


def rebuilt_context(prior: Column) -> Column:
    """Flattened calls as messages again, one assistant message a call."""
    return F.transform(prior, lambda c: F.struct(F.lit("assistant").alias("role"), F.lit(None).cast("string").alias("content"), F.array(c).alias("tool_calls")))


def cell_name(label: Column, threshold: Column, catalog: Column) -> Column:
    """free-<label>[-esc<t>]-c<n>.jsonl."""
    esc = F.when(threshold.isNotNull(), F.concat(F.lit("-esc"), F.format_string("%.2f", threshold))).otherwise("")
    return F.concat(F.lit("free-"), label, esc, F.lit("-c"), catalog.cast("string"), F.lit(".jsonl"))


def batch_path(folder: Column, session: Column, rep: Column, index: Column) -> Column:
    """Where a batch of episodes is saved: a path of its own for every session."""
    return F.format_string("%s/rep%d-%s-batch%03d.json", folder, rep, session, index)


def slot_choices(requests: DataFrame, pool: str, order: str, tokens: str, size: int) -> DataFrame:
    """(pool, order, slot, shared, reused) of prompts that a pool of `size` prefix caches serves one after another.

    A prompt goes to the slot that shares the longest prefix of tokens with it, among equals the one least
    recently used; if none shares anything, to an empty slot, else the least recently used. reused leaves at least
    one token to feed again. A pool is a sequence by nature: its state is `size` token lists in one task; pools
    run side by side.
    """
    if size < 1:
        raise ValueError("a pool needs at least one slot")

    def serve(table: pa.Table) -> pa.Table:
        held: list[list[int]] = [[] for _ in range(size)]
        used = [0] * size
        rows = sorted(zip(table[order].to_pylist(), table[tokens].to_pylist(), strict=True), key=lambda row: row[0])
        out: dict[str, list] = {"slot": [], "shared": [], "reused": []}
        for clock, (_, prompt) in enumerate(rows, 1):
            prompt = prompt or []
            lengths = [len(os.path.commonprefix([slot, prompt])) for slot in held]
            best = min(range(size), key=lambda i: (-lengths[i], bool(held[i]) if not any(lengths) else False, used[i]))
            out["slot"].append(best)
            out["shared"].append(lengths[best])
            out["reused"].append(max(0, min(lengths[best], len(prompt) - 1)))
            held[best], used[best] = prompt, clock
        return pa.table({pool: pa.array([table[pool][0].as_py()] * len(rows), table.schema.field(pool).type), order: pa.array([r[0] for r in rows], table.schema.field(order).type), **{k: pa.array(v, pa.int32()) for k, v in out.items()}})

    types = {f.name: f.dataType.simpleString() for f in requests.schema}
    return requests.select(pool, order, tokens).groupBy(pool).applyInArrow(serve, f"{pool} {types[pool]}, {order} {types[order]}, slot int, shared int, reused int")
