"""Queries over extracted texts and repository files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import extraction as X
from corpusforge.functions.reading import SPACES
from corpusforge.plans.registry import query
from corpusforge.session import table
from corpusforge.sources import views as V

FILES, PAGES = (f"v AS ({V.duck(s)})" for s in (V.FILES, V.DOC_PAGES))
_dense = lambda x: f"regexp_replace({x}, '{SPACES}+', '', 'g')"
_list = lambda items: "(" + ", ".join(f"'{i}'" for i in items) + ")"
_limit = lambda i: "CASE ext " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in X.LIMITS.items() if k) + f" ELSE {X.LIMITS[''][i]} END"
_header = lambda t, n: f"length({_dense(f"regexp_replace({t}, '(?m){X.HEADING}', '', 'g')")}) < {n}"
_tabular = lambda t: f"(regexp_matches({t}, '{X.TABLE_WORDS}') OR len(list_filter(list_transform(string_split({t}, chr(10)), lambda x: regexp_replace(x, '^{SPACES}+', '')), lambda x: x <> '' AND NOT starts_with(x, '#') AND NOT starts_with(x, '|--'))) > 1)"
_LANGUAGE = "CASE " + " ".join(f"WHEN suffix(name, '{k}') THEN '{v}'" for k, v in X.LANGUAGES.items()) + " ELSE 'text' END"
KEYWORDS = ("encryption", "license", "commons")


@query(
    "q14_extraction_gate",
    f"""WITH {FILES}, w AS (SELECT doc_id, ext, coalesce(sample, '') AS t FROM v)
    SELECT doc_id, CASE WHEN {_dense("t")} = '' THEN 'empty' ELSE concat_ws(',', CASE WHEN length({_dense("t")}) < {_limit(0)} THEN 'too_few_chars' END,
      CASE WHEN {_header("t", _limit(0))} THEN 'header_only' END,
      CASE WHEN len(list_filter(string_split_regex(t, '\\n{SPACES}*\\n'), lambda x: length({_dense("x")}) >= 20)) < {_limit(1)} THEN 'too_few_paragraphs' END,
      CASE WHEN 10 * length({_dense(f"regexp_replace(t, '{X.LINKED}', '', 'g')")}) < {_limit(2)} * length({_dense("t")}) THEN 'low_visible_ratio' END,
      CASE WHEN {" OR ".join(f"contains(lower(t), '{m}')" for m in X.ERROR_MARKS)} THEN 'error_mark' END,
      CASE WHEN ext IN {_list(X.TABLES)} AND NOT {_tabular("t")} THEN 'no_table' END) END AS warnings FROM w""",
)
def q14(spark, d):
    return V.view(spark, d, V.FILES).select("doc_id", X.extraction_warnings(F.col("sample"), F.col("ext")).alias("warnings"))


@query("txt15_header_and_table", f"WITH {PAGES} SELECT doc_id, {_header('page_text', 600)} AS header_only, {_tabular('page_text')} AS tabular FROM v")
def txt15(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", X.header_only(F.col("page_text"), F.lit(600)).alias("header_only"), X.tabular(F.col("page_text")).alias("tabular"))


@query("txt16_fenced_code", f"WITH {FILES}, w AS (SELECT doc_id, sample, {_LANGUAGE} AS language FROM v) SELECT doc_id, language, CASE WHEN language = 'markdown' THEN sample ELSE '```' || language || chr(10) || sample || chr(10) || '```' END AS code FROM w")
def txt16(spark, d):
    rows = V.view(spark, d, V.FILES).withColumn("language", X.code_language(F.col("name")))
    return rows.select("doc_id", "language", X.fenced(F.col("sample"), F.col("language")).alias("code"))


@query(
    "pg6_listing_triage",
    f"WITH {FILES}, w AS (SELECT size_bytes, CASE WHEN name IN {_list(X.FIRST_FILES)} THEN 'first' WHEN {' OR '.join(f"suffix(lower(name), '{e}')" for e in X.READABLE)} THEN 'readable' ELSE 'skipped' END AS class, {_LANGUAGE} AS language FROM v) SELECT class, language, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM w GROUP BY class, language",
)
def pg6(spark, d):
    rows = V.view(spark, d, V.FILES).select("size_bytes", X.listing_class(F.col("name")).alias("class"), X.code_language(F.col("name")).alias("language"))
    return rows.groupBy("class", "language").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


@query("src6_json_keywords", f"SELECT doc_id FROM documents WHERE {' OR '.join(f"contains(lower(json_object('doc_id', doc_id, 'lang', lang, 'source', source, 'text', text)::VARCHAR), '{k}')" for k in KEYWORDS)}")
def src6(spark, d):
    whole = F.lower(F.to_json(F.struct("doc_id", "lang", "source", "text")))
    hit = F.lit(False)
    for word in KEYWORDS:
        hit = hit | whole.contains(word)
    return table(spark, d, "documents").where(hit).select("doc_id")
