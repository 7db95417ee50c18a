"""Queries of the general training-data operators: repeated messages, schema drift, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.operators import delivery, nested, schema_drift
from evalspark.plans.tables import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delivery.repeated_deliveries(table(spark, sf_dir, "free_log"))


def p2_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries and repeated ones of each batch file."""
    log = table(spark, sf_dir, "free_log").select("delivery_id", "batch_file")
    dropped = p2_found(spark, sf_dir).withColumn("dropped", F.lit(1))
    joined = log.join(dropped, "delivery_id", "left")
    return joined.groupBy("batch_file").agg(F.count("*").alias("n_deliveries"), F.count("dropped").alias("n_repeated"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.schema_changes(table(spark, sf_dir, "completion_metas"))


def p4_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.consistent_table(table(spark, sf_dir, "completion_metas"))


def p4_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schema_drift.layouts_in_use(table(spark, sf_dir, "completion_metas"))


def p4_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps between layouts, and how many files took each."""
    return schema_drift.migration_steps(table(spark, sf_dir, "completion_metas"))


def p4_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layouts with their versions and chains of migrations."""
    found = schema_drift.layout_registry(table(spark, sf_dir, "completion_metas"))
    return found.select("layout", "version", F.array_join("chain", ",").alias("chain"), "n_files")


def p4_unknown_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames between files that no migration covers."""
    return schema_drift.unknown_renames(table(spark, sf_dir, "completion_metas"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.linked_children(table(spark, sf_dir, "episodes"), table(spark, sf_dir, "report_files"))


def p5_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of messages, contents as length and hash."""
    rows = nested.message_table(table(spark, sf_dir, "episodes"))
    return rows.select("episode_id", "position", "role", F.length("content").alias("chars"), F.md5(F.coalesce("content", F.lit("")).cast("binary")).alias("hash"), "error", "turn_idx", "completion_tokens")


def p5_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.call_table(table(spark, sf_dir, "episodes"))


def p5_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of arguments; nested and null values by their kind alone."""
    rows = nested.argument_table(table(spark, sf_dir, "episodes"))
    return rows.withColumn("value", F.when(F.col("kind").isin("string", "number", "boolean"), F.col("value")))


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = nested.label_table(table(spark, sf_dir, "report_files"))
    return rows.select("report_id", "label", "step_agreement", F.col("by_episode").isNotNull().alias("has_interval"))


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.rate_table(table(spark, sf_dir, "report_files"))


QUERIES = {"p2_found": p2_found, "p2_by_batch": p2_by_batch, "p4_found": p4_found, "p4_table": p4_table, "p4_layouts": p4_layouts, "p4_steps": p4_steps, "p4_registry": p4_registry, "p4_unknown_renames": p4_unknown_renames, "p5_found": p5_found, "p5_messages": p5_messages, "p5_calls": p5_calls, "p5_arguments": p5_arguments, "p5_labels": p5_labels, "p5_rates": p5_rates}

_KEYED = """
    SELECT delivery_id, batch_file,
        lower(regexp_replace(config_fingerprint, '^\\s+|\\s+$', '', 'g')) AS fp,
        regexp_replace(lower(regexp_replace(task_id, '^\\s+|\\s+$', '', 'g')), '^0+(.)', '\\1') AS task,
        seed, CAST(round(ts * 1000) AS BIGINT) AS ms
    FROM free_log"""
_DROPPED = f"""
    SELECT delivery_id FROM (
        SELECT delivery_id, row_number() OVER (PARTITION BY fp, task, seed, ms ORDER BY delivery_id) AS rn
        FROM ({_KEYED}) WHERE fp <> '' AND task <> '' AND seed IS NOT NULL AND ms IS NOT NULL
    ) WHERE rn > 1"""

_DRIFT = r"""
    WITH f AS (SELECT file_id, file_name, lag(file_id) OVER (PARTITION BY file_name ORDER BY written_at, file_id) AS before, body FROM (SELECT file_id, file_name, written_at, try_cast(body AS json) AS body FROM completion_metas) WHERE json_type(body) = 'OBJECT' AND file_name IS NOT NULL),
    t AS (SELECT f.file_id, replace(substr(e.fullkey, 3), '"', '') AS p, CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS k,
        CASE WHEN e.type IN ('OBJECT', 'ARRAY') THEN NULL WHEN e.type IN ('VARCHAR', 'BOOLEAN') THEN e.value::varchar ELSE try_cast(e.value::varchar AS double)::varchar END AS v, e.value AS raw
        FROM f, json_tree(f.body) AS e WHERE e.fullkey <> '$' AND NOT contains(e.fullkey, '[')),
    n AS (SELECT file_id, p, k, CASE WHEN k = 'array' THEN raw::varchar WHEN k = 'object' THEN (SELECT coalesce(string_agg(substr(u.p, length(t.p) + 1) || '=' || u.k || ':' || coalesce(u.v, CASE WHEN u.k = 'array' THEN u.raw::varchar ELSE '' END), chr(10) ORDER BY u.p), '') FROM t u WHERE u.file_id = t.file_id AND starts_with(u.p, t.p || '.')) ELSE v END AS v FROM t),
    o AS (SELECT f.file_id, n.p, n.k, n.v FROM f JOIN n ON n.file_id = f.before), w AS (SELECT f.file_id, n.p, n.k, n.v FROM f JOIN n ON n.file_id = f.file_id WHERE f.before IS NOT NULL),
    g AS (SELECT o.*, row_number() OVER (PARTITION BY o.file_id, o.k, o.v ORDER BY o.p) AS i FROM o ANTI JOIN w ON o.file_id = w.file_id AND o.p = w.p), c AS (SELECT w.*, row_number() OVER (PARTITION BY w.file_id, w.k, w.v ORDER BY w.p) AS i FROM w ANTI JOIN o ON o.file_id = w.file_id AND o.p = w.p),
    m AS (SELECT g.file_id, g.p AS old, c.p AS new FROM g JOIN c ON g.file_id = c.file_id AND g.k = c.k AND g.v = c.v AND g.i = c.i WHERE g.k <> 'null'),
    s AS (
    SELECT o.file_id, o.p AS field_path, 'retyped' AS change, NULL::varchar AS partner FROM o JOIN w ON o.file_id = w.file_id AND o.p = w.p WHERE o.k <> w.k AND 'null' NOT IN (o.k, w.k)
    UNION ALL SELECT file_id, new, 'renamed', old FROM m
    UNION ALL SELECT file_id, p, 'removed', NULL FROM g WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = g.file_id AND m.old = g.p)
    UNION ALL SELECT file_id, p, 'added', NULL FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.file_id = c.file_id AND m.new = c.p))"""

_NESTED = r"""
    WITH m AS (SELECT episode_id, i, messages[i + 1] AS m FROM episodes, unnest(range(len(messages))) AS t(i) WHERE messages[i + 1] IS NOT NULL),
    c AS (SELECT episode_id, i, j, m.tool_calls[j + 1] AS c FROM m, unnest(range(len(m.tool_calls))) AS t(j) WHERE m.tool_calls[j + 1] IS NOT NULL),
    p AS (SELECT episode_id, i, j, try_cast(c.arguments AS json) AS a FROM c),
    a AS (SELECT episode_id, i, j, CASE WHEN json_type(a) = 'VARCHAR' THEN try_cast(a->>'$' AS json) ELSE a END AS a FROM p),
    k AS (SELECT DISTINCT episode_id, i, j, unnest(json_keys(a)) AS k FROM a WHERE json_type(a) = 'OBJECT'),
    r AS (SELECT report_id, report_kind AS kind, try_cast(body AS json) AS b FROM report_files),
    l0 AS (SELECT report_id, b->'labels' AS l FROM r WHERE kind = 'forced' AND json_type(b) = 'OBJECT'),
    l AS (SELECT report_id, CASE WHEN json_type(l) = 'VARCHAR' THEN try_cast(l->>'$' AS json) ELSE l END AS l FROM l0),
    lb AS (SELECT report_id, key AS name, value AS v FROM (SELECT report_id, e.key, e.value FROM l, json_each(l.l) AS e WHERE json_type(l.l) = 'OBJECT') WHERE json_type(value) <> 'NULL'
        UNION ALL SELECT report_id, e.value->>'label', e.value FROM l, json_each(l.l) AS e WHERE json_type(l.l) = 'ARRAY' AND json_type(e.value->'label') = 'VARCHAR'),
    q AS (SELECT report_id, CASE WHEN json_type(b) = 'OBJECT' AND json_exists(b, '$.comparisons') THEN b->'comparisons' WHEN json_type(b) = 'OBJECT' THEN json_array(b) ELSE b END AS q FROM r WHERE kind = 'compare'),
    cm AS (SELECT report_id, e.key::bigint AS n, e.value AS v FROM q, json_each(q.q) AS e WHERE json_type(q.q) = 'ARRAY' AND json_type(e.value) <> 'NULL'),
    rt AS (SELECT report_id, n, CASE WHEN json_type(v->'rates') = 'VARCHAR' THEN try_cast(v->>'rates' AS json) ELSE v->'rates' END AS r FROM cm),
    rn AS (SELECT report_id, n, e.key AS name, e.value AS v FROM rt, json_each(rt.r) AS e WHERE json_type(rt.r) = 'OBJECT' AND json_type(e.value) <> 'NULL' UNION ALL SELECT report_id, n, e.value->>'name', e.value FROM rt, json_each(rt.r) AS e WHERE json_type(rt.r) = 'ARRAY' AND json_type(e.value->'name') = 'VARCHAR')"""



def _newest(path: str) -> str:
    """Where the migrations move a path, in SQL."""
    for _, rule, old, new in schema_drift.MIGRATIONS:
        if rule == "rename":
            path = f"regexp_replace({path}, '^{old.replace('.', '[.]')}([.]|$)', '{new}\\1')"
    return path


ORACLES = {
    "p2_found": _DROPPED,
    "p2_by_batch": f"""
        SELECT batch_file, count(*) AS n_deliveries, count(d.delivery_id) AS n_repeated
        FROM free_log f LEFT JOIN ({_DROPPED}) d ON f.delivery_id = d.delivery_id GROUP BY batch_file""",
    "p4_found": f"{_DRIFT} SELECT file_id, field_path, change FROM s",
    "p4_steps": f"""{_DRIFT},
    y AS (SELECT file_id, substr(sha256(string_agg(p || chr(9) || k, chr(10) ORDER BY p || chr(9) || k)), 1, 16) AS l FROM t GROUP BY 1)
    SELECT b.l AS before, n.l AS layout, change, field_path, partner, count(*) AS n_files FROM s JOIN f USING (file_id) JOIN y b ON b.file_id = f.before JOIN y n ON n.file_id = s.file_id GROUP BY 1, 2, 3, 4, 5""",
    "p4_unknown_renames": f"{_DRIFT} SELECT partner, field_path, count(*) AS n_files FROM s WHERE change = 'renamed' AND {_newest('partner')} <> {_newest('field_path')} GROUP BY 1, 2",
    "p4_layouts": r"""
    WITH f AS (SELECT file_id, written_at, body FROM (SELECT file_id, written_at, try_cast(body AS json) AS body FROM completion_metas) WHERE json_type(body) = 'OBJECT'),
    t AS (SELECT f.file_id, replace(substr(e.fullkey, 3), '"', '') || chr(9) || CASE e.type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS p
        FROM f, json_tree(f.body) AS e WHERE e.fullkey <> '$' AND NOT contains(e.fullkey, '[')),
    l AS (SELECT file_id, substr(sha256(string_agg(p, chr(10) ORDER BY p)), 1, 16) AS layout FROM t GROUP BY 1)
    SELECT layout, count(*) AS n_files, min(written_at) AS first_written, max(written_at) AS last_written FROM f JOIN l USING (file_id) GROUP BY 1""",
    "p5_found": _NESTED + r"""
    SELECT 'episodes' AS root_table, episode_id AS root_id, 'message' AS child, i::varchar AS path FROM m
    UNION ALL SELECT 'episodes', episode_id, 'tool_call', i || '/' || j FROM c UNION ALL SELECT 'episodes', episode_id, 'argument', i || '/' || j || '/' || k FROM k
    UNION ALL SELECT DISTINCT 'report_files', report_id, 'label', name FROM lb UNION ALL SELECT DISTINCT 'report_files', report_id, 'interval', name || '/step_agreement_by_episode' FROM lb WHERE json_type(v->'step_agreement_by_episode') <> 'NULL'
    UNION ALL SELECT 'report_files', report_id, 'comparison', n::varchar FROM cm UNION ALL SELECT DISTINCT 'report_files', report_id, 'rate', n || '/' || name FROM rn""",
    "p5_messages": _NESTED + " SELECT episode_id, i::int AS position, m.role AS role, length(m.content) AS chars, md5(coalesce(m.content, '')) AS hash, m.error AS error, m.turn_idx AS turn_idx, m.\"usage\".completion_tokens AS completion_tokens FROM m",
    "p5_calls": _NESTED + " SELECT episode_id, i::int AS position, j::int AS call, c.id AS id, c.name AS name, c.arguments AS arguments FROM c",
    "p5_arguments": _NESTED + """, g AS (SELECT episode_id, i, j, k, json_type(a, '$."' || k || '"') AS t, json_extract_string(a, '$."' || k || '"') AS v FROM (SELECT DISTINCT episode_id, i, j, a, unnest(json_keys(a)) AS k FROM a WHERE json_type(a) = 'OBJECT'))
    SELECT episode_id, i::int AS position, j::int AS call, k AS argument, CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind, CASE WHEN t NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN v END AS value FROM g""",
    "p5_labels": _NESTED + " SELECT report_id, name AS label, max(try_cast(v->>'step_agreement' AS double)) AS step_agreement, bool_or(coalesce(json_type(v->'step_agreement_by_episode') <> 'NULL', false)) AS has_interval FROM lb GROUP BY 1, 2",
    "p5_rates": _NESTED + " SELECT report_id, n::int AS comparison, name AS rate, " + ", ".join(f"any_value(try_cast(v->>'{f}' AS double)) AS {f}" for f in nested.RATE_FIELDS) + " FROM rn GROUP BY 1, 2, 3",
}
