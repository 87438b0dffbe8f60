"""Quality-score queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import quality as Q
from corpusforge.plans.registry import query
from corpusforge.session import table
from corpusforge.sources import views as V


def _list(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


_COVER = "list_sum(list_transform({terms}, lambda t: length({line}) - length(replace({line}, t, ''))))"
_NAV = f"(({_COVER.format(terms=_list(Q.NAV_CN), line='trim(l)')}) + ({_COVER.format(terms=_list(Q.NAV_EN), line='lower(trim(l))')})) / greatest(length(trim(l)), 1) >= 0.5"
NAV_RATIO = f"SELECT doc_id, round(avg(CASE WHEN {_NAV} THEN 1.0 ELSE 0.0 END), 6) AS ratio FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE trim(l) <> '' GROUP BY doc_id"
LANG = "length(regexp_replace(text, '[^A-Za-z\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}]', '', 'g'))::DOUBLE / length(regexp_replace(text, '\\s', '', 'g'))"
MARKS = Q.MARKS.replace("'", "''")


@query("q2_navigation_ratio", NAV_RATIO)
def q2(spark, d):
    return table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.round(Q.navigation_ratio(F.col("text")), 6).alias("ratio"))


@query(
    "q4_duplication_ratio",
    f"WITH w AS (SELECT doc_id, unnest(list_transform(range(1, length(left(text, 4000)) - 3), lambda i: substr(text, i, 5))) AS w FROM documents) SELECT doc_id, round((count(*) - count(DISTINCT w))::DOUBLE / count(*), 6) AS ratio FROM w WHERE NOT regexp_full_match(w, '{MARKS}+') GROUP BY doc_id",
)
def q4(spark, d):
    rows = table(spark, d, "documents").where("length(text) >= 5")
    return rows.select("doc_id", F.round(Q.duplication_ratio(F.col("text")), 6).alias("ratio"))


@query("q5_language_ratio", f"SELECT doc_id, round({LANG}, 6) AS ratio FROM documents WHERE trim(text) <> ''")
def q5(spark, d):
    return table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.round(Q.language_ratio(F.col("text")), 6).alias("ratio"))


@query(
    "q9_piecewise_scores",
    f"""WITH r AS (SELECT doc_id, length(text)::DOUBLE AS n, {LANG} AS r FROM documents WHERE trim(text) <> '')
    SELECT doc_id, round(CASE WHEN n < 200 THEN 5.0 * (n / 200) WHEN n < 500 THEN 5.0 + 10.0 * ((n - 200) / 300) WHEN n < 2000 THEN 15.0 + 10.0 * ((n - 500) / 1500) ELSE 25.0 + 5.0 * least((n - 2000) / 3000, 1.0) END, 6)::DOUBLE AS length_score,
    round(CASE WHEN r <= 0 THEN 0.0 WHEN r < 0.25 THEN 5.0 * (r / 0.25) WHEN r < 0.5 THEN 5.0 + 10.0 * ((r - 0.25) / 0.25) WHEN r < 0.75 THEN 15.0 + 7.0 * ((r - 0.5) / 0.25) ELSE 22.0 + 3.0 * least((r - 0.75) / 0.25, 1.0) END, 6)::DOUBLE AS language_score FROM r""",
)
def q9(spark, d):
    n, r = F.length("text").cast("double"), Q.language_ratio(F.col("text"))
    return table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.round(Q.length_score(n), 6).alias("length_score"), F.round(Q.language_score(r), 6).alias("language_score"))


def _four(x: str) -> str:
    return f"floor({x}::DOUBLE * 10000 + 0.5::DOUBLE) / 10000::DOUBLE"


def _q(s: str) -> str:
    return s.replace("'", "''")


def _plain_sql(x: str) -> str:
    out = f"coalesce({x}, '')"
    for pattern, put in Q.NOISE:
        put = "chr(10) || chr(10)" if put == "\n\n" else "'" + put.replace("$1", "\\1") + "'"
        out = f"regexp_replace({out}, '{_q(pattern)}', {put}, 'g')"
    return out


def _special_sql(kind: str, x: str) -> str:
    found = " + ".join(f"length(array_to_string(regexp_extract_all({x}, '{_q(p)}'), ''))" for p in Q.SPECIAL[kind])
    return f"least(({found})::DOUBLE / greatest(length({x}), 1), 1.0)"


def _nav_line(x: str) -> str:
    return "(" + _NAV.replace("trim(l)", f"trim({x})") + ")"


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PARAS = "string_split_regex({}, '\\n\\s*\\n')"
_MENU = f"len(string_split(b, chr(10))) > 1 AND len(list_filter(string_split(b, chr(10)), lambda u: trim(u) <> '' AND {_nav_line('u')}))::DOUBLE / len(string_split(b, chr(10))) > 0.6"
_VALID = f"len(list_filter(list_transform({_PARAS}, lambda p: {_STRIP.format('p')}), lambda b: length(b) >= 20 AND NOT regexp_matches(b, '^https?://\\S+$') AND NOT ({_MENU})))"
_FULL = f"list_filter(list_transform({_PARAS}, lambda p: {_STRIP.format('p')}), lambda p: p <> '')"
_CUT = f"(len({_FULL}) >= 2 AND (length({_FULL}[-1])::DOUBLE / (length(array_to_string({_FULL}, '')) - length({_FULL}[-1])) * (len({_FULL}) - 1) < 0.25 OR (length({_FULL}[-1]) > 20 AND NOT regexp_matches({_FULL}[-1], '{_q(Q.SENTENCE_END)}'))))"


def _of(sql: str, x: str) -> str:
    return sql.replace("{}", x)


@query("q3_special_ratios", "SELECT doc_id, " + ", ".join(f"round({_special_sql(k, 'text')}, 6) AS {k}" for k in Q.SPECIAL) + " FROM documents WHERE text IS NOT NULL")
def q3(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", *[F.round(Q.special_ratio(F.col("text"), k), 6).alias(k) for k in Q.SPECIAL])


_PAGES = f"v AS ({V.duck(V.DOC_PAGES)})"


@query("q6_paragraphs", f"WITH {_PAGES} SELECT doc_id, len({_of(_PARAS, 'page_text')}) AS n_paragraphs, {_of(_VALID, 'page_text')} AS n_valid FROM v")
def q6(spark, d):
    text = F.col("page_text")
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", Q.n_paragraphs(text).alias("n_paragraphs"), Q.n_valid_paragraphs(text).alias("n_valid"))


@query("q7_headings_and_code", f"WITH {_PAGES} SELECT doc_id, len(regexp_extract_all(page_text, '(?m)^#{{1,6}}\\s+\\S')) AS n_headings, len(regexp_extract_all(page_text, '```')) // 2 AS n_code FROM v")
def q7(spark, d):
    text = F.col("page_text")
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", Q.n_headings(text).alias("n_headings"), Q.n_code_blocks(text).alias("n_code"))


@query("q8_truncation", f"WITH {_PAGES} SELECT doc_id, {_of(_CUT, 'page_text')} AS truncated FROM v")
def q8(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", Q.truncated(F.col("page_text")).alias("truncated"))


_DUP = f"coalesce((SELECT (count(*) - count(DISTINCT w))::DOUBLE / nullif(count(*), 0) FROM (SELECT unnest(list_transform(range(1, length(left(x, 4000)) - 3), lambda i: substr(x, i, 5))) AS w) WHERE NOT regexp_full_match(w, '{MARKS}+')), 0.0)"


def _report_sql(source: str, keys: str) -> str:
    """The whole report for rows of (keys, title, content, html)."""
    measures = f"""SELECT *, length(x) AS n, CASE WHEN length(x) = 0 THEN 0 ELSE len({_of(_PARAS, 'x')}) END AS np, {_of(_VALID, 'x')} AS nv,
      len(regexp_extract_all(content, '(?m)^#{{1,6}}\\s+\\S')) AS nh, len(regexp_extract_all(content, '```')) // 2 AS nc,
      coalesce((SELECT avg(CASE WHEN {_NAV} THEN 1.0 ELSE 0.0 END) FROM (SELECT unnest(string_split(x, chr(10))) AS l) WHERE trim(l) <> ''), 0.0) AS nr, {_DUP} AS dr,
      coalesce(length(regexp_replace(x, '[^A-Za-z\\x{{4E00}}-\\x{{9FFF}}\\x{{3400}}-\\x{{4DBF}}\\x{{20000}}-\\x{{2A6DF}}\\x{{F900}}-\\x{{FAFF}}]', '', 'g'))::DOUBLE / nullif(length(regexp_replace(x, '\\s', '', 'g')), 0), 0.0) AS lr,
      {_special_sql('script_placeholder', 'x')} AS sr, {_special_sql('login', 'x')} AS gr, {_special_sql('captcha', 'x')} AS cr, {_of(_CUT, 'x')} AS cut FROM t"""
    special = "CASE WHEN n < 500 AND {0} > 0.1 THEN 40.0 WHEN {0} > 0.3 THEN ({0} - 0.3) / 0.7 * 40.0 ELSE 0.0 END"
    excess = "CASE WHEN {0} <= {1} THEN 0.0 ELSE (least({0}, 1.0) - {1}) / (1.0 - {1}) * 25 END"
    flags = ("NOT titled", "n < 200", "nv < 1", "nr > 0.4", "dr > 0.35", "lr < 0.25", *[f"({r} > 0.3 OR (n < 500 AND {r} > 0.1))" for r in ("sr", "gr", "cr")], "(nv <= 1 AND nr > 0.5)", "cut")
    issues = "list_filter([" + ", ".join(f"CASE WHEN {f} THEN '{c}' END" for f, c in zip(flags, Q.ISSUES)) + "], lambda u: u IS NOT NULL)"
    return f"""WITH s AS ({source}),
    t AS (SELECT *, length({_STRIP.format("coalesce(title, '')")}) > 0 AS titled, CASE WHEN length({_plain_sql('content')}) >= length({_SEEN}) THEN {_plain_sql('content')} ELSE {_SEEN} END AS x FROM s),
    m AS ({measures}),
    p AS (SELECT *, CASE WHEN n <= 0 THEN 0.0::DOUBLE WHEN n < 200 THEN 5.0::DOUBLE * (n::DOUBLE / 200) WHEN n < 500 THEN 5.0 + 10.0::DOUBLE * ((n - 200)::DOUBLE / 300) WHEN n < 2000 THEN 15.0 + 10.0::DOUBLE * ((n - 500)::DOUBLE / 1500) ELSE 25.0 + 5.0::DOUBLE * least((n - 2000)::DOUBLE / 3000, 1.0) END
      + CASE WHEN nv <= 0 THEN 0.0 WHEN nv = 1 THEN 5.0 WHEN nv = 2 THEN 10.0 WHEN nv <= 5 THEN 15.0 + 5.0 * ((nv - 3)::DOUBLE / 3) ELSE least(25.0, 20.0 + 5.0 * least((nv - 6)::DOUBLE / 10, 1.0)) END
      + CASE WHEN lr <= 0 THEN 0.0 WHEN lr < 0.25 THEN 5.0 * (lr / 0.25) WHEN lr < 0.5 THEN 5.0 + 10.0 * ((lr - 0.25) / 0.25) WHEN lr < 0.75 THEN 15.0 + 7.0 * ((lr - 0.5) / 0.25) ELSE 22.0 + 3.0 * least((lr - 0.75) / 0.25, 1.0) END
      + least(CASE WHEN titled THEN 10.0 ELSE 0.0 END + CASE WHEN nh >= 1 THEN 5.0 ELSE 0.0 END + least(5.0, nc * 2.5), 20.0)
      - ({excess.format('nr', '0.4')} + {excess.format('dr', '0.35')} + {special.format('sr')} + {special.format('gr')} + {special.format('cr')}) AS raw FROM m),
    r AS (SELECT *, n = 0 AND NOT titled AS nothing FROM p),
    i AS (SELECT *, CASE WHEN nothing THEN ['text_too_short', 'title_missing'] ELSE {issues} END AS issues, CASE WHEN nothing THEN 0 ELSE greatest(0, least(100, round_even(raw, 0)::INT)) END AS score FROM r)
    SELECT {keys}, score, array_to_string(issues, ',') AS issues, NOT list_has_any(issues, ['script_placeholder', 'login_required', 'captcha_detected']) AND score >= 35 AND n >= 200 AND nv >= 1 AS complete,
      n AS analysis_length, nv AS n_valid, {_four('nr')} AS nav_ratio, {_four('dr')} AS dup_ratio, {_four('lr')} AS lang_ratio FROM i"""


_TAGLESS = "html"
for _tag in ("script", "style", "noscript"):
    _TAGLESS = f"regexp_replace({_TAGLESS}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_SEEN = f"trim(regexp_replace(regexp_replace(regexp_replace({_TAGLESS}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))"


def _report_rows(found, key):
    # Engines differ in how they round a half, so both sides do it by floor.
    rounded = [(F.floor(F.col(c) * 10000 + 0.5) / 10000.0).alias(c) for c in ("nav_ratio", "dup_ratio", "lang_ratio")]
    return found.select(key, "score", F.array_join("issues", ",").alias("issues"), "complete", "analysis_length", "n_valid", *rounded)


@query("q12_document_report", _report_sql("SELECT doc_id, source AS title, coalesce(text, '') AS content, '' AS html FROM documents", "doc_id"))
def q12(spark, d):
    return _report_rows(Q.report(table(spark, d, "documents"), F.col("source"), F.col("text")), "doc_id")


_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query("q12_page_report", _report_sql(f"SELECT page_id, {_TITLE} AS title, '' AS content, coalesce(html, '') AS html FROM pages", "page_id"))
def q12_pages(spark, d):
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return _report_rows(Q.report(table(spark, d, "pages"), title, F.lit(""), F.col("html")), "page_id")


@query("q11_issue_counts", f"SELECT issue, count(*) AS n FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM ({_report_sql('''SELECT doc_id, source AS title, coalesce(text, '') AS content, '' AS html FROM documents''', 'doc_id')})) WHERE issue <> '' GROUP BY issue")
def q11(spark, d):
    found = Q.report(table(spark, d, "documents"), F.col("source"), F.col("text"))
    return found.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


@query("q13_incomplete_pages", f"SELECT page_id, score, issues FROM ({_report_sql(f'''SELECT page_id, {_TITLE} AS title, '' AS content, coalesce(html, '') AS html FROM pages''', 'page_id')}) WHERE NOT complete")
def q13(spark, d):
    return q12_pages(spark, d).where("NOT complete").select("page_id", "score", "issues")
