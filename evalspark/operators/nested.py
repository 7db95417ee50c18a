"""Nested JSON as linked rows, by structural indexing of whole Arrow batches.

The texts of a batch are one byte buffer. Bitmaps of its quotes, brackets, colons and commas come from array
comparisons, the inside of strings from the running parity of unescaped quotes, the depth from a running sum of
brackets; sorting the structural bytes by depth brings each bracket, its separators and its end together, so
the spans of all keys, values and elements of the batch are found without a loop over texts or characters.
Nodes know their parent node, and operators pick rows by masks over parents and keys.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.shared import spread

CHILDREN = "root_table string, root_id bigint, child string, path string"
_CHILDREN_ARROW = pa.schema([("root_table", pa.string()), ("root_id", pa.int64()), ("child", pa.string()), ("path", pa.string())])
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 13, 32]] = True


@dataclass
class Nodes:
    """Values of a batch. parent is a node's index or -1 for a whole text; key spans are -1 in arrays."""

    data: np.ndarray
    row: np.ndarray
    parent: np.ndarray
    position: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: dict = field(default_factory=dict)

    def text(self, node: int) -> str:
        return self.data[self.start[node] : self.end[node]].tobytes().decode("utf-8", "replace")

    def key(self, node: int) -> str:
        raw = self.data[self.key_start[node] : self.key_end[node]].tobytes().decode("utf-8", "replace")
        return json.loads(f'"{raw}"', strict=False) if "\\" in raw else raw

    def first(self) -> np.ndarray:
        """The first byte of each value: { [ " t f n or a number's."""
        if "first" not in self.known:
            self.known["first"] = self.data[self.start]
        return self.known["first"]

    def is_null(self) -> np.ndarray:
        if "null" not in self.known:
            self.known["null"] = self.first() == ord("n")
        return self.known["null"]

    def has_key(self, name: str) -> np.ndarray:
        """Which nodes have this key (spelled without escapes)."""
        if ("key", name) in self.known:
            return self.known["key", name]
        want = np.frombuffer(name.encode(), np.uint8)
        found = self.key_end - self.key_start == len(want)
        at = np.flatnonzero(found & (self.key_start >= 0))
        same = np.ones(len(at), bool)
        for i, byte in enumerate(want):
            same &= self.data[self.key_start[at] + i] == byte
        found[:] = False
        found[at[same]] = True
        self.known["key", name] = found
        return found

    def below(self, parents: np.ndarray) -> np.ndarray:
        """Which nodes are direct children of the nodes in the mask."""
        inner = self.parent >= 0
        return inner & parents[np.maximum(self.parent, 0)]


def structure(texts: list[bytes]) -> Nodes:
    """Index texts that are known to be JSON."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begins = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64) if len(texts) else np.empty(0, np.int64)
    n = len(data)
    index = np.arange(n, dtype=np.int32 if n < 2**31 else np.int64)
    # An escaped byte follows an odd run of backslashes.
    back = data == 92
    if back.any():
        before = np.maximum.accumulate(np.where(back, index.dtype.type(-1), index))
        odd = np.zeros(n, bool)
        odd[1:] = ((index - before)[:-1] & 1).astype(bool)
        quote = (data == 34) & ~odd
    else:
        quote = data == 34
    inside = (np.cumsum(quote, dtype=index.dtype) & 1).astype(bool)  # from an opening quote up to the byte before the closing one
    open_ = ((data == 123) | (data == 91)) & ~inside
    close = ((data == 125) | (data == 93)) & ~inside
    depth = np.cumsum(open_.astype(np.int8) - close.astype(np.int8), dtype=np.int32)
    colon, comma = (data == 58) & ~inside, (data == 44) & ~inside

    # Structural bytes sorted by the depth of the container they belong to, then by place.
    at = np.flatnonzero(open_ | close | comma)
    level = depth[at] + close[at]
    order = np.argsort(level, kind="stable")
    at, level = at[order], level[order]
    opens = open_[at]
    owner = np.maximum.accumulate(np.where(opens, np.arange(len(at)), 0)) if len(at) else at
    # A member ends at a comma or the closing bracket, and begins after the structural byte before it.
    ends = np.flatnonzero(~opens)
    starts, stops, container = at[ends - 1] + 1, at[ends], at[owner[ends]]

    solid = np.cumsum(~_BLANK[data], dtype=index.dtype)
    filled = solid[stops - 1] - solid[np.maximum(starts - 1, 0)] > 0 if len(starts) else np.empty(0, bool)
    starts, stops, container = starts[filled], stops[filled], container[filled]
    # `{}` leaves nothing; members of objects have their colon at the container's own depth.
    colons = np.flatnonzero(colon)
    by_depth = np.lexsort((colons, depth[colons]))
    keyed = data[container] == 123
    key_start = np.full(len(starts), -1, np.int64)
    key_end = np.full(len(starts), -1, np.int64)
    value = starts.copy()
    if keyed.any():
        span = n + 1
        ranks = depth[colons][by_depth].astype(np.int64) * span + colons[by_depth]
        mine = depth[container[keyed]].astype(np.int64) * span + starts[keyed]
        found = colons[by_depth][np.searchsorted(ranks, mine)]
        quotes = np.flatnonzero(quote)
        closing = np.searchsorted(quotes, found) - 1
        key_end[keyed], key_start[keyed] = quotes[closing], quotes[closing - 1] + 1
        value[keyed] = found + 1
    next_solid = _next(~_BLANK[data], forward=True)
    last_solid = _next(~_BLANK[data], forward=False)
    start, end = next_solid[value], last_solid[stops - 1] + 1

    # Whole texts come first, so that every container has a node.
    roots = np.arange(len(texts))
    all_start = np.concatenate((next_solid[begins], start)) if len(texts) else start
    by_start = np.argsort(all_start, kind="stable")
    parent = by_start[np.searchsorted(all_start[by_start], container)] if len(container) else np.empty(0, np.int64)
    row = np.searchsorted(begins, container, side="right") - 1
    rank = np.lexsort((starts, parent))
    position = np.empty(len(starts), np.int64)
    sorted_parent = parent[rank]
    firsts = np.concatenate(([True], sorted_parent[1:] != sorted_parent[:-1])) if len(rank) else np.empty(0, bool)
    ordinal = np.arange(len(rank))
    position[rank] = ordinal - np.maximum.accumulate(np.where(firsts, ordinal, 0)) if len(rank) else ordinal
    none = np.full(len(texts), -1, np.int64)
    return Nodes(
        data,
        np.concatenate((roots, row)).astype(np.int64),
        np.concatenate((none, parent)).astype(np.int64),
        np.concatenate((np.zeros(len(texts), np.int64), position)),
        np.concatenate((none, key_start)),
        np.concatenate((none, key_end)),
        all_start,
        np.concatenate((begins + lengths, end)),
    )


def _next(mask: np.ndarray, forward: bool) -> np.ndarray:
    """The nearest set place at or after (before) each place."""
    index = np.arange(len(mask), dtype=np.int32 if len(mask) < 2**31 else np.int64)
    kind = index.dtype.type
    if forward:
        return np.minimum.accumulate(np.where(mask, index, kind(len(mask) - 1))[::-1])[::-1]
    return np.maximum.accumulate(np.where(mask, index, kind(0)))


def readable(text: str | None) -> bool:
    if not text:
        return False
    try:
        json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False
    return True


def _refuse(word: str):
    raise ValueError(word)


def unwrapped(text: str | None) -> str | None:
    """A readable text; if it is a string that itself holds readable JSON, that; else None."""
    if not readable(text):
        return None
    if text.lstrip()[:1] != '"':
        return text
    inner = json.loads(text)
    return inner if readable(inner) else None


def index_texts(texts: list[str | None]) -> tuple[Nodes, np.ndarray]:
    """Nodes of the readable texts, and which of the given rows each belongs to. JSON in a string is indexed as itself."""
    good = [(i, u) for i, t in enumerate(texts) if (u := unwrapped(t)) is not None]
    nodes = structure([t.encode("utf-8", "replace") for _, t in good])
    rows = np.array([i for i, _ in good], np.int64)
    nodes.row = rows[nodes.row] if len(rows) else nodes.row
    return nodes, rows


def first_level(texts: list[str | None], values: bool = False) -> list[dict[str, str | None]]:
    """For each text the keys of the object it holds, each once; none if it holds no object. With `values` the last value's text."""
    nodes, _ = index_texts(texts)
    objects = (nodes.parent < 0) & (nodes.first() == ord("{")) if len(nodes.row) else np.empty(0, bool)
    found: list[dict[str, str | None]] = [{} for _ in texts]
    for node in np.flatnonzero(nodes.below(objects)) if len(objects) else ():
        found[nodes.row[node]][nodes.key(node)] = nodes.text(node) if values else None
    return found


def first_level_keys(texts: list[str | None]) -> list[list[str]]:
    return [list(x) for x in first_level(texts)]


def _members(nodes: Nodes, holder: np.ndarray, name_key: str, nested: list) -> Iterator[tuple[int, int, str, Nodes, int]]:
    """(row, holder, name, nodes, node) of the non-null members of objects, of arrays of named objects, and of
    either in a string."""
    objects = holder & (nodes.first() == ord("{"))
    for node in np.flatnonzero(nodes.below(objects) & ~nodes.is_null()):
        yield int(nodes.row[node]), int(nodes.parent[node]), nodes.key(node), nodes, int(node)
    arrays = holder & (nodes.first() == ord("["))
    items = nodes.below(arrays) & (nodes.first() == ord("{"))
    names = nodes.below(items) & nodes.has_key(name_key) & (nodes.first() == ord('"'))
    for node in np.flatnonzero(names):
        item = int(nodes.parent[node])
        yield int(nodes.row[node]), int(nodes.parent[item]), json.loads(nodes.text(node), strict=False), nodes, item
    strings = np.flatnonzero(holder & (nodes.first() == ord('"')))
    if nested is not None and len(strings):
        inner, _ = index_texts([json.loads(nodes.text(node), strict=False) for node in strings])
        for row, _, name, inner_nodes, node in _members(inner, inner.parent < 0, name_key, None):
            yield int(nodes.row[strings[row]]), int(strings[row]), name, inner_nodes, node


def report_children(kinds: list[str | None], texts: list[str | None], values: bool = False) -> dict[tuple[int, str, str], str | None]:
    """(row, child, path) of report bodies, each once; with `values` the text of each child."""
    nodes, rows = index_texts(texts)
    if not len(rows):
        return {}
    names = np.array([(k or "").strip().lower() for k in kinds])[nodes.row]
    forced = names == "forced"
    root = nodes.parent < 0
    found: dict[tuple[int, str, str], str | None] = {}
    text = (lambda where, node: where.text(node)) if values else (lambda where, node: None)

    labels = nodes.below(root & forced & (nodes.first() == ord("{"))) & nodes.has_key("labels")
    for row, _, name, where, node in _members(nodes, labels, "label", []):
        found[row, "label", name] = text(where, node)
        inner = _children(where, node)
        held = inner[where.has_key("step_agreement_by_episode")[inner] & ~where.is_null()[inner]] if len(inner) else inner
        if len(held):
            found[row, "interval", f"{name}/step_agreement_by_episode"] = text(where, held[-1])

    compare = root & (names == "compare")
    lists = compare & (nodes.first() == ord("["))
    wrapped = nodes.below(compare & (nodes.first() == ord("{"))) & nodes.has_key("comparisons")
    lists |= wrapped & (nodes.first() == ord("["))
    items = nodes.below(lists) & ~nodes.is_null()
    alone = nodes.below(compare & (nodes.first() == ord("{"))) & (nodes.has_key("rates") | nodes.has_key("base") | nodes.has_key("new"))
    single = np.zeros(len(root), bool)
    single[nodes.parent[alone]] = True
    single[nodes.parent[wrapped]] = False
    comparisons = items | single
    place = np.where(single, 0, nodes.position)
    for node in np.flatnonzero(comparisons):
        found[int(nodes.row[node]), "comparison", str(place[node])] = text(nodes, node)
    rates = nodes.below(comparisons) & nodes.has_key("rates")
    for row, holder, name, where, node in _members(nodes, rates, "name", []):
        found[row, "rate", f"{place[nodes.parent[holder]]}/{name}"] = text(where, node)
    return found


def _children(nodes: Nodes, node: int) -> np.ndarray:
    if "by parent" not in nodes.known:
        nodes.known["by parent"] = np.argsort(nodes.parent, kind="stable")
        nodes.known["parents"] = nodes.parent[nodes.known["by parent"]]
    low, high = np.searchsorted(nodes.known["parents"], [node, node + 1])
    return nodes.known["by parent"][low:high]


# One structural index covers about this many characters, so that its arrays stay small whatever a batch holds.
INDEX_CHARS = 2_000_000


def slices(texts: list[str | None]) -> Iterator[slice]:
    """Runs of rows whose texts are about INDEX_CHARS long together; a longer text is a run of its own."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= INDEX_CHARS:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def report_rows(reports: DataFrame) -> DataFrame:
    """(root_table, root_id, child, path) of the labels, intervals, comparisons and rates in report bodies."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, bodies = (batch.column(c).to_pylist() for c in ("report_id", "report_kind", "body"))
            for part in slices(bodies):
                rows = report_children(kinds[part], bodies[part])
                yield _batch([("report_files", ids[part][row], child, path) for row, child, path in rows])

    return spread(reports.select("report_id", "report_kind", "body").where("body is not null")).mapInArrow(convert, CHILDREN)


def _batch(rows: list[tuple[str, int, str, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _CHILDREN_ARROW, strict=True)], schema=_CHILDREN_ARROW)


def message_parts(episodes: DataFrame) -> DataFrame:
    """(root_id, child, path, arguments): a row for each message and each tool call that isn't null."""
    messages = spread(episodes.select(F.col("episode_id").alias("root_id"), "messages")).select("root_id", F.posexplode("messages").alias("i", "m")).where("m is not null")
    at = F.col("i").cast("string")
    none = F.lit(None).cast("string")
    message = F.array(F.struct(F.lit("message").alias("child"), at.alias("path"), none.alias("arguments")))
    calls = F.transform(
        F.coalesce(F.col("m.tool_calls"), F.array()),
        lambda call, j: F.when(call.isNotNull(), F.struct(F.lit("tool_call").alias("child"), F.concat(at, F.lit("/"), j.cast("string")).alias("path"), call["arguments"].alias("arguments"))),
    )
    parts = messages.select("root_id", F.explode(F.concat(message, F.filter(calls, lambda x: x.isNotNull()))).alias("p"))
    return parts.select("root_id", "p.child", "p.path", "p.arguments")


def episode_rows(episodes: DataFrame) -> DataFrame:
    """(root_table, root_id, child, path) of the messages, tool calls and arguments of episodes."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, paths, texts = (batch.column(c).to_pylist() for c in ("root_id", "child", "path", "arguments"))
            rows = [("episodes", i, c, p) for i, c, p in zip(ids, kinds, paths, strict=True)]
            some = [k for k, text in enumerate(texts) if text]
            for part in slices([texts[k] for k in some]):
                for k, keys in zip(some[part], first_level_keys([texts[k] for k in some[part]]), strict=True):
                    rows += [("episodes", ids[k], "argument", f"{paths[k]}/{key}") for key in keys]
            yield _batch(rows)

    return message_parts(episodes).mapInArrow(convert, CHILDREN)


def linked_children(episodes: DataFrame, reports: DataFrame) -> DataFrame:
    """All linked rows of both tables.

    Null arrays, null elements and unreadable JSON have no children; arguments that are null, blank or no JSON
    object have no `argument` rows; a key that an object repeats gives one row; empty tables give no rows.
    """
    return episode_rows(episodes).unionByName(report_rows(reports))


def message_table(episodes: DataFrame) -> DataFrame:
    """One row a message: its episode, its position there and its own fields."""
    rows = episodes.select("episode_id", F.posexplode("messages").alias("position", "m")).where("m is not null")
    return rows.select("episode_id", "position", "m.role", "m.content", "m.error", "m.turn_idx", F.col("m.usage.completion_tokens").alias("completion_tokens"))


def call_table(episodes: DataFrame) -> DataFrame:
    """One row a tool call: its episode, message and position there, and its own fields."""
    rows = episodes.select("episode_id", F.posexplode("messages").alias("position", "m")).select("episode_id", "position", F.posexplode("m.tool_calls").alias("call", "c")).where("c is not null")
    return rows.select("episode_id", "position", "call", "c.id", "c.name", "c.arguments")


# The kind of a JSON value by its first character; everything else is a number.
_KIND_OF = {"{": "object", "[": "array", '"': "string", "t": "boolean", "f": "boolean", "n": "null"}
ARGUMENTS = "episode_id bigint, position int, call int, argument string, kind string, value string"


def argument_table(episodes: DataFrame) -> DataFrame:
    """One row an argument of a tool call: its episode, message and call, its kind, and its value: a string's text, other values as JSON."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(c).to_pylist() for c in ("episode_id", "position", "call")]
            texts, out = batch.column("arguments").to_pylist(), []
            for part in slices(texts):
                for at, members in enumerate(first_level(texts[part], values=True), part.start):
                    for name, value in members.items():
                        kind = _KIND_OF.get(value[:1], "number")
                        out.append((*(k[at] for k in keys), name, kind, json.loads(value, strict=False) if kind == "string" else value))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            types = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [f.split()[0] for f in ARGUMENTS.split(", ")])

    return call_table(spread(episodes)).select("episode_id", "position", "call", "arguments").where("arguments is not null").mapInArrow(convert, ARGUMENTS)


def report_values(reports: DataFrame) -> DataFrame:
    """(report_id, child, path, value): the labels, intervals, comparisons and rates of report bodies with their JSON."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kinds, bodies = (batch.column(c).to_pylist() for c in ("report_id", "report_kind", "body"))
            for part in slices(bodies):
                rows = [(ids[part][row], child, path, value) for (row, child, path), value in report_children(kinds[part], bodies[part], values=True).items()]
                columns = list(zip(*rows, strict=True)) if rows else [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], ["report_id", "child", "path", "value"])

    return spread(reports.select("report_id", "report_kind", "body").where("body is not null")).mapInArrow(convert, "report_id bigint, child string, path string, value string")


def label_table(reports: DataFrame) -> DataFrame:
    """One row a label of a forced report: its report, its step agreement, and the interval by episode as JSON; null where a report has none."""
    values = report_values(reports).where("child in ('label', 'interval')")
    label = F.when(F.col("child") == "label", F.col("path")).otherwise(F.regexp_replace("path", "/step_agreement_by_episode$", ""))
    of = lambda child, value: F.max(F.when(F.col("child") == child, value))
    agreement = F.get_json_object("value", "$.step_agreement").try_cast("double")
    return values.groupBy("report_id", label.alias("label")).agg(of("label", agreement).alias("step_agreement"), of("interval", F.col("value")).alias("by_episode"))


RATE_FIELDS = ["n_steps", "base", "new", "delta", "ci95_low", "ci95_high"]


def rate_table(reports: DataFrame) -> DataFrame:
    """One row a rate of a comparison: its report, the comparison's position, and its numbers; what isn't a number is null."""
    values = report_values(reports).where("child = 'rate'")
    numbers = [F.get_json_object("value", f"$.{f}").try_cast("double").alias(f) for f in RATE_FIELDS]
    return values.select("report_id", F.substring_index("path", "/", 1).cast("int").alias("comparison"), F.expr("substring(path, instr(path, '/') + 1)").alias("rate"), *numbers)
