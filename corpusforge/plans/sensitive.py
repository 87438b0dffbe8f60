"""Sensitive-data queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.operators import sensitive as S
from corpusforge.plans.registry import query
from corpusforge.session import table


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_LINES = "l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)"
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, line::INT AS line, '{level}' AS level, '{t}' AS type, left(unnest(regexp_extract_all(t, {_quoted(p)})), {w}) AS match FROM l"
    for level, rules, w in (("critical", S.CRITICAL, 80), ("warning", S.WARNING, 40))
    for t, p in rules
)
FINDINGS = f"{_LINES}, f AS ({_FOUND})"


def _found(spark, d):
    return S.findings(table(spark, d, "documents"))


@query("sec1_line_findings", f"WITH {FINDINGS} SELECT * FROM f")
def sec1(spark, d):
    return _found(spark, d)


@query("a7_findings_rollup", f"WITH {FINDINGS} SELECT coalesce(level, 'all') AS level, coalesce(type, 'all') AS type, count(*) AS n, count(DISTINCT doc_id) AS files FROM f GROUP BY ROLLUP (level, type)")
def a7(spark, d):
    return _found(spark, d).rollup("level", "type").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("files")).fillna("all", ["level", "type"])


@query("sec6_clean_gate", f"WITH {FINDINGS} SELECT count(*) FILTER (WHERE level = 'critical') AS critical, count(*) FILTER (WHERE level = 'critical') = 0 AS clean FROM f")
def sec6(spark, d):
    n = F.count_if(F.col("level") == "critical")
    return _found(spark, d).agg(n.alias("critical"), (n == 0).alias("clean"))


def _redacted_sql() -> str:
    text = "text"
    for kind, pattern in S.CRITICAL:
        text = f"regexp_replace({text}, {_quoted(pattern)}, '[REDACTED_{kind}]', 'g')"
    return text


@query("sec4_redaction", f"SELECT doc_id, sha256({_redacted_sql()}) AS sha FROM documents")
def sec4(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(S.redacted(F.col("text")), 256).alias("sha"))


def _kinds(rules, text: str = "text") -> str:
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {_quoted(p)}) THEN '{t}' END" for t, p in rules)
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def _snippets() -> str:
    found = "right(string_split_regex(text, {p})[1], 10) || regexp_extract(text, {p}) || substr(text, length(string_split_regex(text, {p})[1]) + length(regexp_extract(text, {p})) + 1, 10)"
    cases = ", ".join(f"CASE WHEN regexp_matches(text, {_quoted(p)}) THEN {found.format(p=_quoted(p))} END" for _, p in S.BLOCK)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), chr(10))"


_GATE = f"len({_kinds(S.BLOCK)}) > 0 AS blocked, array_to_string({_kinds(S.BLOCK)}, ',') AS block, array_to_string({_kinds(S.WARN)}, ',') AS warn, {_snippets()} AS snippets"


def _gated(rows, *keys):
    g = S.gate(F.col("text"))
    return rows.select(*keys, g["blocked"].alias("blocked"), F.array_join(g["block"], ",").alias("block"), F.array_join(g["warn"], ",").alias("warn"), F.array_join(g["snippets"], "\n").alias("snippets"))


@query("sec3_write_gate", f"SELECT conv_id, turn, {_GATE} FROM conversations")
def sec3(spark, d):
    return _gated(table(spark, d, "conversations"), "conv_id", "turn")


@query("sec3_write_gate_documents", f"SELECT doc_id, {_GATE} FROM documents")
def sec3_documents(spark, d):
    return _gated(table(spark, d, "documents"), "doc_id")


@query("sec5_label_scan", f"SELECT doc_id, array_to_string({_kinds(S.LABELS)}, ',') AS labels, array_to_string({_kinds((*S.CRITICAL, *S.WARNING))}, ',') AS line_rules FROM documents")
def sec5(spark, d):
    joined = lambda rules, name: F.array_join(S.labels(F.col("text"), rules), ",").alias(name)
    return table(spark, d, "documents").select("doc_id", joined(S.LABELS, "labels"), joined((*S.CRITICAL, *S.WARNING), "line_rules"))
