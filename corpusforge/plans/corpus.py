"""Health, link graph, registry, cache, response and candidate queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusforge.operators import corpus as C
from corpusforge.plans.registry import query
from corpusforge.session import table
from corpusforge.sources import views as V

PAGES, REG, CACHE, RESP, CAND, SNAP = (f"v AS ({V.duck(s)})" for s in (V.DOC_PAGES, V.REGISTRY, V.CACHE, V.RESPONSES, V.CANDIDATES, V.SNAPSHOTS))
LINKS = f"{PAGES}, e AS (SELECT stem AS src, unnest(regexp_extract_all(regexp_replace(page_text, '`[^`]*`', '', 'g'), '\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]', 1)) AS dst FROM v)"
BLOCK = "nullif(regexp_extract(page_text, '^---\\n((?s:.*?))\\n---(?:\\n|$)', 1), '')"
LACKS = "list_filter([CASE WHEN NOT contains(chr(10) || b, chr(10) || 'created:') THEN 'created' END, CASE WHEN NOT contains(chr(10) || b, chr(10) || 'tags:') THEN 'tags' END, CASE WHEN NOT contains(chr(10) || b, chr(10) || 'type:') THEN 'type' END], lambda x: x IS NOT NULL)"
ISSUE = f"CASE WHEN NOT starts_with(page_text, '---') THEN 'MISSING frontmatter' WHEN b IS NULL THEN 'MALFORMED frontmatter' WHEN len({LACKS}) > 0 THEN 'missing: ' || array_to_string({LACKS}, ', ') END"


def _pages(spark, d):
    return V.view(spark, d, V.DOC_PAGES)


@query("txt2_frontmatter_block", f"WITH {PAGES} SELECT doc_id, {BLOCK} AS block FROM v")
def txt2(spark, d):
    return _pages(spark, d).select("doc_id", C.frontmatter(F.col("page_text")).alias("block"))


@query("txt3_title", f"WITH {PAGES} SELECT doc_id, coalesce(nullif(trim(regexp_extract(page_text, '(?m)^# (.*)$', 1)), ''), '[no-title]') AS title FROM v")
def txt3(spark, d):
    return _pages(spark, d).select("doc_id", C.title(F.col("page_text")).alias("title"))


@query("hl1_frontmatter_issues", f"WITH {PAGES}, b AS (SELECT *, {BLOCK} AS b FROM v) SELECT doc_id, {ISSUE} AS issue FROM b WHERE {ISSUE} IS NOT NULL")
def hl1(spark, d):
    return _pages(spark, d).select("doc_id", C.frontmatter_issue(F.col("page_text")).alias("issue")).where("issue IS NOT NULL")


@query("hl2_type_and_dates", f"WITH {PAGES} SELECT doc_id, type NOT IN ('concept', 'source-note', 'project', 'output') AS bad_type, created_day > updated_day AS bad_dates FROM v WHERE type = 'memo' OR created_day > updated_day")
def hl2(spark, d):
    bad = ~F.col("type").isin("concept", "source-note", "project", "output")
    return _pages(spark, d).select("doc_id", bad.alias("bad_type"), (F.col("created_day") > F.col("updated_day")).alias("bad_dates")).where("bad_type OR bad_dates")


@query("dte2_page_age", f"WITH {PAGES} SELECT doc_id, active AND 547 - updated_day > 90 AS stale_active, 547 - updated_day > 365 AS very_old FROM v")
def dte2(spark, d):
    age = F.lit(547) - F.col("updated_day")
    return _pages(spark, d).select("doc_id", (F.col("active") & (age > 90)).alias("stale_active"), (age > 365).alias("very_old"))


@query("flt9_public_titles", f"WITH {PAGES} SELECT doc_id, coalesce(nullif(trim(regexp_extract(page_text, '(?m)^# (.*)$', 1)), ''), '[no-title]') AS title FROM v WHERE privacy <> 'internal'")
def flt9(spark, d):
    return _pages(spark, d).where("privacy <> 'internal'").select("doc_id", C.title(F.col("page_text")).alias("title"))


@query("j4_broken_links", f"WITH {LINKS} SELECT src, dst FROM e WHERE NOT contains(dst, '/') AND dst NOT IN (SELECT stem FROM v)")
def j4(spark, d):
    return C.broken_links(_pages(spark, d))


@query("j5_unindexed_pages", f"WITH {PAGES} SELECT stem FROM v WHERE stem NOT IN (SELECT stem FROM v WHERE doc_id % 9 <> 0)")
def j5(spark, d):
    pages = _pages(spark, d)
    listed = pages.where("doc_id % 9 <> 0").select("stem")
    return pages.join(listed, "stem", "left_anti").select("stem")


@query("j6_orphans", f"WITH {LINKS} SELECT stem FROM v WHERE stem NOT IN (SELECT dst FROM e WHERE src <> dst)")
def j6(spark, d):
    return C.orphans(_pages(spark, d))


@query("j7_related_pages", f"WITH {LINKS} SELECT DISTINCT src AS hit, v.stem, v.section FROM e JOIN v ON v.stem = dst WHERE src IN (SELECT stem FROM v WHERE doc_id % 100 = 0)")
def j7(spark, d):
    """The pages one link away from every hit; the hits are the pages whose id is divisible by 100."""
    pages = _pages(spark, d)
    near = C.edges(pages.where("doc_id % 100 = 0"))
    return near.join(pages.select("stem", "section"), near.dst == F.col("stem")).select(F.col("src").alias("hit"), "stem", "section").distinct()


@query("a18_link_degrees", f"WITH {LINKS} SELECT stem, (SELECT count(*) FROM e WHERE src = stem) AS links_out, (SELECT count(*) FROM e WHERE dst = stem) AS links_in FROM v")
def a18(spark, d):
    return C.degrees(_pages(spark, d))


@query("a6_pages_by_section", f"WITH {PAGES} SELECT coalesce(section, 'all') AS section, count(*) AS n FROM v GROUP BY ROLLUP (section)")
def a6(spark, d):
    return _pages(spark, d).rollup("section").agg(F.count("*").alias("n")).fillna("all", ["section"])


@query(
    "a16_health_report",
    f"WITH {LINKS}, b AS (SELECT *, {BLOCK} AS b FROM v), c AS (SELECT 'frontmatter' AS check_name, stem AS item FROM b WHERE {ISSUE} IS NOT NULL UNION ALL SELECT 'broken_links', src || '>' || dst FROM e WHERE NOT contains(dst, '/') AND dst NOT IN (SELECT stem FROM v) UNION ALL SELECT 'orphans', stem FROM v WHERE stem NOT IN (SELECT dst FROM e WHERE src <> dst)), r AS (SELECT *, row_number() OVER (PARTITION BY check_name ORDER BY item) AS k FROM c) SELECT check_name, count(*) AS n, string_agg(item, ',' ORDER BY item) FILTER (WHERE k <= 20) AS first_items FROM r GROUP BY check_name",
)
def a16(spark, d):
    pages = _pages(spark, d)
    front = pages.where(C.frontmatter_issue(F.col("page_text")).isNotNull()).select(F.lit("frontmatter").alias("check_name"), F.col("stem").alias("item"))
    broken = C.broken_links(pages).select(F.lit("broken_links").alias("check_name"), F.concat_ws(">", "src", "dst").alias("item"))
    alone = C.orphans(pages).select(F.lit("orphans").alias("check_name"), F.col("stem").alias("item"))
    found = front.union(broken).union(alone)
    k = F.row_number().over(Window.partitionBy("check_name").orderBy("item"))
    first = found.withColumn("k", k).where("k <= 20").groupBy("check_name").agg(F.array_join(F.sort_array(F.collect_list("item")), ",").alias("first_items"))
    return found.groupBy("check_name").agg(F.count("*").alias("n")).join(first, "check_name")


@query("j19_source_paths", f"WITH {PAGES} SELECT doc_id, source_path, replace(source_path, '_INBOX/imported', 'raw/imported_processed') AS expected FROM v WHERE starts_with(source_path, '_INBOX/')")
def j19(spark, d):
    stale = _pages(spark, d).where(F.col("source_path").startswith("_INBOX/"))
    return stale.select("doc_id", "source_path", F.replace("source_path", F.lit("_INBOX/imported"), F.lit("raw/imported_processed")).alias("expected"))


@query("j20_snapshot_diff", f"WITH {SNAP} SELECT doc_id, CASE WHEN old_mtime IS NULL THEN 'new' WHEN new_mtime IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM v WHERE old_mtime IS DISTINCT FROM new_mtime")
def j20(spark, d):
    both = V.view(spark, d, V.SNAPSHOTS)
    old = both.where("old_mtime IS NOT NULL").select("doc_id", F.col("old_mtime").alias("mtime"))
    new = both.where("new_mtime IS NOT NULL").select("doc_id", F.col("new_mtime").alias("mtime"))
    return C.snapshot_diff(old, new, "doc_id", "mtime")


ISSN_OK = "(length(g) = 8 AND regexp_matches(g, '^[0-9]{7}') AND substr(g, 8, 1) = CASE WHEN c = 10 THEN 'X' ELSE c::VARCHAR END)"
ISSN = f"{REG}, g AS (SELECT *, regexp_replace(upper(issn), '[^0-9X]', '', 'g') AS g FROM v), c AS (SELECT *, (11 - list_sum(list_transform(range(1, 8), lambda i: (9 - i) * coalesce(try_cast(substr(g, i, 1) AS INT), 0))) % 11) % 11 AS c FROM g)"
LATEST = "SELECT namespace, cache_key, payload, created, expires FROM v QUALIFY row_number() OVER (PARTITION BY namespace, cache_key ORDER BY created DESC, event_id DESC) = 1"


@query("id2_issn_checksum", f"WITH {ISSN} SELECT p_partkey, issn, {ISSN_OK} AS valid FROM c")
def id2(spark, d):
    return V.view(spark, d, V.REGISTRY).select("p_partkey", "issn", C.issn_valid(F.col("issn")).alias("valid"))


@query("id8_registry_key", f"WITH {REG} SELECT p_partkey, concat_ws('|', scheme, edition, issn, lower(journal_name)) AS match_key FROM v")
def id8(spark, d):
    return V.view(spark, d, V.REGISTRY).select("p_partkey", F.concat_ws("|", "scheme", "edition", "issn", F.lower("journal_name")).alias("match_key"))


@query("a14_schemes", f"WITH {REG} SELECT DISTINCT scheme, edition FROM v")
def a14(spark, d):
    return V.view(spark, d, V.REGISTRY).select("scheme", "edition").distinct()


@query("a20_ranking_counts", f"WITH {REG} SELECT coalesce(scheme, 'all') AS scheme, coalesce(edition, 'all') AS edition, count(*) AS n FROM v GROUP BY GROUPING SETS ((scheme, edition), ())")
def a20(spark, d):
    return V.view(spark, d, V.REGISTRY).groupingSets([["scheme", "edition"], []], "scheme", "edition").agg(F.count("*").alias("n")).fillna("all", ["scheme", "edition"])


@query(
    "ddp1_idempotent_import",
    f"WITH {REG}, k AS (SELECT p_partkey, concat_ws('|', scheme, edition, issn, lower(journal_name)) AS match_key FROM v UNION ALL SELECT p_partkey, concat_ws('|', scheme, edition, issn, lower(journal_name)) FROM v WHERE p_partkey % 3 = 0) SELECT count(DISTINCT match_key) AS inserted, count(*) - count(DISTINCT match_key) AS duplicates FROM k",
)
def ddp1(spark, d):
    keys = id8(spark, d)
    again = keys.union(keys.where("p_partkey % 3 = 0"))
    return again.groupBy("match_key").agg(F.count("*").alias("n")).agg(F.count("*").alias("inserted"), (F.sum("n") - F.count("*")).alias("duplicates"))


@query("j21_cache_lookup", f"WITH {CACHE}, l AS ({LATEST}), k AS (SELECT DISTINCT user_id AS cache_key FROM events) SELECT cache_key, payload, l.namespace IS NOT NULL AS hit FROM k LEFT JOIN (SELECT * FROM l WHERE namespace = 'click') l USING (cache_key) WHERE expires IS NULL OR expires >= 5000")
def j21(spark, d):
    kept = C.latest(V.view(spark, d, V.CACHE)).where("namespace = 'click'")
    keys = table(spark, d, "events").select(F.col("user_id").alias("cache_key")).distinct()
    return keys.join(kept, "cache_key", "left").where("expires IS NULL OR expires >= 5000").select("cache_key", "payload", F.col("namespace").isNotNull().alias("hit"))


@query("ddp2_cache_upsert", f"WITH {CACHE} {LATEST}")
def ddp2(spark, d):
    return C.latest(V.view(spark, d, V.CACHE))


@query("ddp7_cache_purge", f"WITH {CACHE}, l AS ({LATEST}) SELECT * FROM l WHERE expires >= 5000")
def ddp7(spark, d):
    return ddp2(spark, d).where("expires >= 5000")


@query("a19_cache_counts", f"WITH {CACHE}, l AS ({LATEST}) SELECT namespace, count(*) AS n FROM l GROUP BY namespace")
def a19(spark, d):
    return ddp2(spark, d).groupBy("namespace").agg(F.count("*").alias("n"))


VERDICT = f"{RESP}, p AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY event_id) AS position, lower(trim(string_split(content_type, ';')[1])) AS kind FROM v), r AS (SELECT event_id, CASE WHEN position > 200 THEN 'over_cap' WHEN status <> 200 THEN 'bad_status' WHEN method = 'OPTIONS' THEN 'preflight' WHEN NOT (contains(kind, 'json') OR contains(kind, 'html') OR kind = 'text/plain') THEN 'bad_type' WHEN declared_size > 524288 THEN 'too_large' ELSE 'accepted' END AS verdict FROM p)"


def _verdicts(spark, d):
    position = F.row_number().over(Window.partitionBy("page").orderBy("event_id"))
    return V.view(spark, d, V.RESPONSES).withColumn("position", position).select("event_id", C.verdict().alias("verdict"))


@query("flt7_response_verdicts", f"WITH {VERDICT} SELECT * FROM r")
def flt7(spark, d):
    return _verdicts(spark, d)


@query("a12_response_funnel", f"WITH {VERDICT} SELECT verdict, count(*) AS n FROM r GROUP BY verdict")
def a12(spark, d):
    return _verdicts(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


NEG = "((contains(lower(json_path), 'comment') OR contains(lower(json_path), 'user') OR contains(lower(json_path), 'recommend')) AND NOT (contains(lower(json_path), 'article') OR contains(lower(json_path), 'content') OR contains(lower(json_path), 'post')))"


@query("flt10_negative_paths", f"WITH {CAND} SELECT page_id, method, {NEG} AS negative FROM v")
def flt10(spark, d):
    return V.view(spark, d, V.CANDIDATES).select("page_id", "method", C.negative_path(F.col("json_path")).alias("negative"))


@query(
    "win6_best_candidate",
    f"WITH {CAND} SELECT * FROM v WHERE content_length >= 100 AND issue NOT IN ('script_placeholder', 'login_required', 'captcha_detected', 'title_missing') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY quality_complete DESC, {NEG}, CASE WHEN quality_complete THEN ranking_score ELSE quality_score END DESC, CASE WHEN quality_complete THEN quality_score ELSE ranking_score END DESC, method) = 1",
)
def win6(spark, d):
    return C.best_candidate(V.view(spark, d, V.CANDIDATES))


@query("win9_top_candidates", f"WITH {CAND} SELECT page_id, method, row_number() OVER (PARTITION BY page_id ORDER BY ranking_score DESC, method) AS n FROM v QUALIFY n <= 2")
def win9(spark, d):
    order = Window.partitionBy("page_id").orderBy(F.desc("ranking_score"), "method")
    return V.view(spark, d, V.CANDIDATES).select("page_id", "method", F.row_number().over(order).alias("n")).where("n <= 2")


@query("url1_canonical", "SELECT page_id, regexp_replace(url, '#.*$', '') AS canonical, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS trimmed FROM pages")
def url1(spark, d):
    bare = F.regexp_replace("url", "#.*$", "")
    return table(spark, d, "pages").select("page_id", bare.alias("canonical"), F.regexp_replace(bare, "/+$", "").alias("trimmed"))


TAGS = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?is)<noscript[^>]*>.*?</noscript>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g')"


@query("txt8_visible_text", f"SELECT page_id, sha256(trim(regexp_replace({TAGS}, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS sha FROM pages")
def txt8(spark, d):
    from corpusforge.functions.text import visible_text

    return table(spark, d, "pages").select("page_id", F.sha2(visible_text(F.col("html")), 256).alias("sha"))


@query("pg2_link_table", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS pos FROM pages) SELECT page_id, href, min(pos)::INT AS pos FROM l GROUP BY ALL")
def pg2(spark, d):
    links = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return links.groupBy("page_id", "href").agg((F.min("pos") + 1).alias("pos"))
