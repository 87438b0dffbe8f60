"""Queries over page titles, snippets, noise and extraction methods."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import reading as R
from corpusforge.plans.registry import query
from corpusforge.session import table
from corpusforge.sources import views as V

PAGES, CAND = (f"v AS ({V.duck(s)})" for s in (V.DOC_PAGES, V.CANDIDATES))
TERMS = ("data", "model", "note")
_trim = lambda x: f"regexp_replace({x}, '{R.EDGES}', '', 'g')"
_HITS = " + ".join(f"(length(lower(p)) - length(replace(lower(p), '{t}', ''))) // {len(t)}" for t in TERMS)
_SHORT = " OR ".join(f"regexp_matches(t, '{p}')" for p in R.NOISE)


@query(
    "txt4_titles",
    f"""WITH {PAGES}, w AS (SELECT doc_id, stem, list_filter(string_split(page_text, chr(10))[1:20], lambda x: starts_with(x, 'title:') OR starts_with(x, '# '))[1] AS l FROM v)
    SELECT doc_id, coalesce({_trim("CASE WHEN contains(l, ':') THEN regexp_replace(l, '^[^:]*:', '') ELSE regexp_replace(l, '^[# ]+', '') END")}, stem) AS title FROM w""",
)
def txt4(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", R.title(F.col("page_text"), F.col("stem")).alias("title"))


@query(
    "txt5_snippets",
    f"""WITH {PAGES}, w AS (SELECT doc_id, page_text, list_filter(list_transform(string_split_regex(page_text, '\\n{R.SPACES}*\\n'), lambda x: {_trim("x")}), lambda x: x <> '') AS ps FROM v),
    e AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM w),
    b AS (SELECT doc_id, arg_max(p, struct_pack(hits := {_HITS}, before := -i)) AS best FROM e GROUP BY doc_id)
    SELECT doc_id, CASE WHEN length(best) > 200 THEN best[1:200] || '…' ELSE coalesce(best, page_text[1:200]) END AS snippet FROM w LEFT JOIN b USING (doc_id)""",
)
def txt5(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", R.snippet(F.col("page_text"), TERMS).alias("snippet"))


@query(
    "txt13_noise",
    f"""WITH v AS (SELECT doc_id, {_trim("coalesce(text, '')")} AS t FROM documents), w AS (SELECT *, string_split(t, chr(10)) AS ls FROM v)
    SELECT doc_id, t = '' OR (length(t) < 50 AND ({_SHORT})) OR (len(ls) > 4 AND 10 * len(list_filter(ls, lambda x: regexp_matches(x, '{R.LOG_MARKS}'))) > 3 * len(ls)) AS noise FROM w""",
)
def txt13(spark, d):
    return table(spark, d, "documents").select("doc_id", R.noise(F.col("text")).alias("noise"))


@query("a8_method_histogram", f"WITH {CAND} SELECT method, count(*) AS n, count(*) FILTER (WHERE quality_complete) AS n_complete, count(*) FILTER (WHERE issue <> '') AS n_issues FROM v GROUP BY method")
def a8(spark, d):
    return V.view(spark, d, V.CANDIDATES).groupBy("method").agg(F.count("*").alias("n"), F.count_if("quality_complete").alias("n_complete"), F.count_if(F.col("issue") != "").alias("n_issues"))
