"""Sensitive-data scans: rule catalogues, findings per line, redaction, and the write gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns, names and levels that results must agree on.
CRITICAL = (
    ("api_key", "(?i)(?:api[_-]?key|apikey)\\s*[:=]\\s*[\"']?\\w{20,}[\"']?"),
    ("token", "(?i)(?:access[_-]?token|auth[_-]?token)\\s*[:=]\\s*[\"']?[\\w\\-_.]{20,}[\"']?"),
    ("credential", "(?i)(?:secret|password|passwd)\\s*[:=]\\s*[\"'][^\"']+[\"']"),
    ("private_key", "-----BEGIN (?:RSA|OPENSSH|EC|PGP) PRIVATE KEY-----"),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}"),
    ("email", "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}"),
)
WARNING = (
    ("cn_id", "\\b[1-9]\\d{5}(?:19|20)\\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\\d|3[01])\\d{3}[\\dXx]\\b"),
    ("phone_cn", "\\b1[3-9]\\d{9}\\b"),
    ("possible_cc", "\\b(?:\\d[ -]*?){13,19}\\b"),
)
BLOCK = (
    ("api_key", "(?i)sk-[a-zA-Z0-9_-]{32,}"),
    ("api_key", "AKIA[0-9A-Z]{16}"),
    ("api_key", "ghp_[a-zA-Z0-9]{36}"),
    ("api_key", "gho_[a-zA-Z0-9]{36}"),
    ("api_key", "ghu_[a-zA-Z0-9]{36}"),
    ("private_key", "-----BEGIN (RSA |EC |OPENSSH )?PRIVATE KEY-----"),
    ("jwt_token", "eyJ[A-Za-z0-9_-]{50,}\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    ("credential_assignment", "(?i)(?:TOKEN|SECRET|PASSWORD|API[_-]?KEY)\\s*[=:]\\s*[\"']?\\S{8,}"),
    ("url_password", "://[^@\\s]{1,64}:[^@\\s]{1,64}@"),
)
WARN = (
    ("pii_id", "\\b\\d{17}[\\dXx]\\b"),
    ("pii_phone", "\\b1[3-9]\\d{9}\\b"),
    ("pii_email", "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{2,}"),
    ("pii_internal_ip", "\\b(?:10\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}|172\\.(?:1[6-9]|2\\d|3[01])\\.\\d{1,3}\\.\\d{1,3}|192\\.168\\.\\d{1,3}\\.\\d{1,3}):\\d+\\b"),
)

# Rules of the label scan, with the labels that results must agree on; letters in either case.
LABELS = (
    ("API Key", "(?i)(?:api[_-]?key|apikey)\\s*[=:]\\s*[\"']?\\w{20,}"),
    ("Token/Secret", "(?i)(?:token|secret)\\s*[=:]\\s*[\"']?\\w{20,}"),
    ("Password", "(?i)(?:password|passwd)\\s*[=:]\\s*[\"']\\S+"),
    ("Private Key", "(?i)-----BEGIN\\s+(?:RSA\\s+)?PRIVATE\\s+KEY-----"),
    ("ID Card Number (possible)", "(?i)\\b\\d{15,18}\\b"),
)


def findings(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, line, level, type, match): every match of every rule on every line."""
    rules = [("critical", t, p, 80) for t, p in CRITICAL] + [("warning", t, p, 40) for t, p in WARNING]
    lines = documents.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("n", "text"))

    def matches(level: str, kind: str, pattern: str, width: int) -> Column:
        found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(level).alias("level"), F.lit(kind).alias("type"), F.substring(m, 1, width).alias("match")))

    found = F.flatten(F.array(*[matches(*r) for r in rules]))
    return lines.select("doc_id", (F.col("n") + 1).alias("line"), F.inline(found))


def redacted(text: Column) -> Column:
    """The text with critical matches replaced by their type."""
    for kind, pattern in CRITICAL:
        text = F.regexp_replace(text, pattern, f"[REDACTED_{kind}]")
    return text


def snippet(text: Column, pattern: str, room: int = 10) -> Column:
    """A rule's first match with ``room`` characters on either side."""
    around = F.split(text, pattern, 2)
    return F.concat(F.right(F.get(around, F.lit(0)), F.lit(room)), F.regexp_extract(text, pattern, 0), F.left(F.get(around, F.lit(1)), F.lit(room)))


def gate(text: Column) -> dict[str, Column]:
    """blocked, the types of block and warn rules that match, in rule order, and what each block rule found with its surroundings."""
    kinds = lambda rules: F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in rules]))
    snippets = F.array_compact(F.array(*[F.when(text.rlike(p), snippet(text, p)) for _, p in BLOCK]))
    return {"blocked": F.size(kinds(BLOCK)) > 0, "block": kinds(BLOCK), "warn": kinds(WARN), "snippets": snippets}


def labels(text: Column, rules: tuple = LABELS) -> Column:
    """Labels of the rules that match anywhere in the whole text."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(t)) for t, p in rules]))
