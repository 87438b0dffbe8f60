"""Addresses, links, images, videos and the frontier of pages to visit."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import urls as U
from corpusforge.operators import web as W
from corpusforge.operators.numbering import numbered
from corpusforge.plans.registry import query
from corpusforge.session import table
from corpusforge.sources import views as V

LINKS, MEDIA, FILES, PAGES, RESP = (f"v AS ({V.duck(s)})" for s in (V.LINKS, V.HTML_MEDIA, V.FILES, V.DOC_PAGES, V.RESPONSES))


def _q(s: str) -> str:
    return s.replace("'", "''")


def _first(x: str, rules) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, '{_q(r)}') THEN '{_q(r)}'" for r in rules) + " END"


def _in(items) -> str:
    return "(" + ", ".join(f"'{i}'" for i in items) + ")"


PATH = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)', 1))"
SCHEME = "lower(regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"
ASKED = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
SKIP = f"""(SELECT doc, pos, url, CASE WHEN s NOT IN ('http', 'https') THEN 'scheme: ' || s WHEN regexp_extract(p, '[^/](\\.[^./]+)$', 1) IN {_in((*U.STATIC_EXTENSIONS, *U.IMAGE_EXTENSIONS))}
  THEN 'static: ' || regexp_extract(p, '[^/](\\.[^./]+)$', 1) WHEN {_first('w', U.SKIPPED_LINKS)} IS NOT NULL THEN 'rule: ' || {_first('w', U.SKIPPED_LINKS)} END AS skip, {_first('lower(url)', U.PRIORITY_LINKS)} AS priority
  FROM (SELECT page_id AS doc, pos, url, {SCHEME.format('url')} AS s, {PATH.format('url')} AS p, {PATH.format('url')} || CASE WHEN {ASKED} <> '' THEN '?' || lower({ASKED}) ELSE '' END AS w FROM v))"""


def _links(spark, d):
    return V.view(spark, d, V.LINKS)


@query("url2_sensitive_pages", f"SELECT page_id, {_first(PATH.format('url'), U.SENSITIVE_PATHS)} AS rule FROM pages UNION ALL SELECT page_id, rule FROM (WITH {LINKS} SELECT page_id, {_first(PATH.format('url'), U.SENSITIVE_PATHS)} AS rule FROM v) WHERE rule IS NOT NULL")
def url2(spark, d):
    rule = U.sensitive_rule(F.col("url")).alias("rule")
    return table(spark, d, "pages").select("page_id", rule).union(_links(spark, d).select("page_id", rule).where("rule IS NOT NULL"))


@query("url3_skip_reasons", f"WITH {LINKS} SELECT doc AS page_id, pos, skip FROM {SKIP}")
def url3(spark, d):
    return _links(spark, d).select("page_id", "pos", U.skip_reason(F.col("url")).alias("skip"))


@query("url4_priority_rules", f"WITH {LINKS} SELECT doc AS page_id, pos, priority FROM {SKIP}")
def url4(spark, d):
    return _links(spark, d).select("page_id", "pos", U.priority_rule(F.col("url")).alias("priority"))


_REPO = " ".join(f"WHEN regexp_matches(url, '{p}') THEN concat_ws('|', '{k}', regexp_extract(url, '{p}', 1), regexp_extract(url, '{p}', 2), {chr(39) + 'main' + chr(39) if k == 'repo' else f'''regexp_extract(url, '{p}', 3)'''}, {chr(39) * 2 if k == 'repo' else f'''regexp_extract(url, '{p}', 4)'''})" for k, p in U.REPOSITORY.items())


@query("url5_repositories", f"WITH {LINKS} SELECT page_id, pos, CASE {_REPO} END AS repository FROM v WHERE CASE {_REPO} END IS NOT NULL")
def url5(spark, d):
    found = _links(spark, d).withColumn("r", U.repository(F.col("url"))).where("r IS NOT NULL")
    return found.select("page_id", "pos", F.concat_ws("|", "r.kind", "r.owner", "r.repo", "r.branch", "r.path").alias("repository"))


_CLASS = "CASE WHEN contains(url, 'github.com') THEN 'github' WHEN contains(url, 'mp.weixin.qq.com') THEN 'wechat' WHEN contains(url, 'arxiv.org') THEN 'academic' ELSE 'webpage' END"


@query("url6_site_classes", f"WITH {LINKS} SELECT site, count(*) AS n FROM (SELECT {_CLASS} AS site FROM v UNION ALL SELECT {_CLASS} FROM pages) GROUP BY site")
def url6(spark, d):
    every = _links(spark, d).select("url").union(table(spark, d, "pages").select("url"))
    return every.groupBy(U.site_class(F.col("url")).alias("site")).agg(F.count("*").alias("n"))


_PAIRS = f"list_transform(list_filter(string_split({ASKED}, '&'), lambda p: p <> ''), lambda p: {{'k': regexp_extract(p, '^([^=]*)', 1), 'v': regexp_extract(p, '^[^=]*=(.*)$', 1)}})"


@query("url7_redacted_urls", f"""WITH {LINKS}, u AS (SELECT page_id, pos, url, {_PAIRS} AS a FROM (SELECT page_id, pos, url FROM v UNION ALL SELECT page_id, -1, url FROM pages))
  SELECT page_id, pos, CASE WHEN {ASKED} = '' THEN url ELSE regexp_extract(url, '^([^?#]*)', 1) || '?' || array_to_string(list_transform(list_filter(a, lambda p, i: list_position(list_transform(a, lambda q: q.k), p.k) = i),
  lambda p: p.k || '=' || CASE WHEN lower(p.k) IN {_in(U.SECRET_PARAMS)} THEN '***REDACTED***' ELSE p.v END), '&') || regexp_extract(url, '(#.*)$', 1) END AS url FROM u""")
def url7(spark, d):
    every = _links(spark, d).select("page_id", "pos", "url").union(table(spark, d, "pages").select("page_id", F.lit(-1).alias("pos"), "url"))
    return every.select("page_id", "pos", U.redacted_query(F.col("url")).alias("url"))


_KIND = "lower(trim(string_split(content_type, ';')[1]))"


@query("url8_content_classes", f"WITH {RESP} SELECT class, count(*) AS n FROM (SELECT CASE WHEN contains({_KIND}, 'json') THEN 'json' WHEN contains({_KIND}, 'html') THEN 'html' WHEN {_KIND} = 'text/plain' THEN 'plain' ELSE 'other' END AS class FROM v) GROUP BY class")
def url8(spark, d):
    return V.view(spark, d, V.RESPONSES).groupBy(U.content_class(F.col("content_type")).alias("class")).agg(F.count("*").alias("n"))


def _resolved(href: str) -> str:
    folder = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)', 1)"
    return f"""CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href} WHEN starts_with({href}, '//') THEN {SCHEME.format('url')} || ':' || {href}
      WHEN starts_with({href}, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || {href} WHEN starts_with({href}, '#') THEN regexp_replace(url, '#.*$', '') || {href}
      ELSE {folder} || CASE WHEN ends_with({folder}, '/') THEN '' ELSE '/' END || {href} END"""


_HREFS = "SELECT page_id, url, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1), 1) AS pos FROM pages"


@query("url9_resolved_links", f"SELECT page_id, pos::INT AS pos, {_resolved('href')} AS target FROM ({_HREFS})")
def url9(spark, d):
    return W.page_links(table(spark, d, "pages")).select("page_id", "pos", "target")


@query("ddp4_distinct_links", f"SELECT page_id, target, min(pos)::INT AS pos FROM (SELECT page_id, pos, url, regexp_replace({_resolved('href')}, '#.*$', '') AS target FROM ({_HREFS})) WHERE target <> regexp_replace(url, '#.*$', '') GROUP BY ALL")
def ddp4(spark, d):
    return W.distinct_links(W.page_links(table(spark, d, "pages")))


@query("a9_link_counters", f"WITH {LINKS} SELECT count(*) AS discovered, count(skip) AS skipped, count(*) FILTER (WHERE skip IS NULL AND priority IS NOT NULL) AS priority, count(*) FILTER (WHERE skip IS NULL AND priority IS NULL) AS plain FROM {SKIP}")
def a9(spark, d):
    marked = W.judged_links(_links(spark, d))
    kept = F.col("skip").isNull()
    return marked.agg(F.count("*").alias("discovered"), F.count("skip").alias("skipped"), F.count_if(kept & F.col("priority").isNotNull()).alias("priority"), F.count_if(kept & F.col("priority").isNull()).alias("plain"))


@query("win10_first_priority_links", f"WITH {LINKS} SELECT doc AS page_id, pos, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM {SKIP} WHERE skip IS NULL AND priority IS NOT NULL QUALIFY n <= 5")
def win10(spark, d):
    return W.first_priority(_links(spark, d)).select("page_id", "pos", "n")


@query("j18_unvisited_links", f"WITH {LINKS}, seen AS (SELECT DISTINCT regexp_replace(url, '#.*$', '') AS canonical FROM v WHERE page_id % 3 = 0) SELECT DISTINCT regexp_replace(url, '#.*$', '') AS canonical FROM v WHERE page_id % 3 <> 0 AND canonical NOT IN (SELECT canonical FROM seen)")
def j18(spark, d):
    links = _links(spark, d).select("page_id", F.regexp_replace("url", "#.*$", "").alias("canonical"))
    return links.where("page_id % 3 <> 0").select("canonical").distinct().join(links.where("page_id % 3 = 0").select("canonical").distinct(), "canonical", "left_anti")


@query("vid1_video_kinds", f"WITH {LINKS} SELECT page_id, pos, CASE WHEN regexp_matches(regexp_replace(url, '[?#].*$', ''), '{U.VIDEO_FILE}') THEN 'direct' WHEN regexp_matches(url, '{U.VIDEO_PLATFORM}') THEN 'platform' END AS kind FROM v WHERE kind IS NOT NULL")
def vid1(spark, d):
    return _links(spark, d).select("page_id", "pos", U.video_kind(F.col("url")).alias("kind")).where("kind IS NOT NULL")


_ATTR = lambda name: f"regexp_extract(tag, '\\s{name}=\"([^\"]*)\"', 1)"
_SRCSET = f"coalesce(nullif({_ATTR('srcset')}, ''), {_ATTR('data-srcset')})"
_SIZED = f"list_transform(list_filter(string_split({_SRCSET}, ','), lambda p: trim(p) <> ''), lambda p, i: {{'w': coalesce(try_cast(regexp_extract(p, '^\\s*\\S+\\s+([0-9]+)(?:\\.[0-9]*)?w(?:\\s|$)', 1) AS INT), 0), 'at': -i, 'u': regexp_extract(p, '^\\s*(\\S+)', 1)}})"
_HOLD = lambda u: f"(starts_with(lower({u}), 'data:') OR contains(lower({u}), 'placeholder') OR contains(lower({u}), '/loading.') OR ends_with(lower({u}), 'blank.gif'))"
_USABLE = f"list_filter(list_transform([coalesce(list_max({_SIZED}).u, ''), {', '.join(_ATTR(a) for a in U.LAZY_ATTRIBUTES)}], lambda u: trim(u)), lambda u: u <> '' AND NOT {_HOLD('u')})"
_SMALL = lambda a: f"coalesce(try_cast(regexp_extract({_ATTR(a)}, '^\\s*([0-9]{{1,9}})[px]*\\s*$', 1) AS INT) <= 3, false)"
IMAGES = f"""i AS (SELECT page_id, url, unnest(regexp_extract_all(media, '(?i)<img\\s[^>]*>')) AS tag, generate_subscripts(regexp_extract_all(media, '(?i)<img\\s[^>]*>'), 1) AS pos FROM v),
  j AS (SELECT page_id, pos, tag, CASE WHEN len({_USABLE}) > 0 THEN {_resolved(f'({_USABLE})[1]')} ELSE '' END AS src FROM i),
  k AS (SELECT page_id, pos, src, src <> '' AND (regexp_matches(src, '{U.TRACKING_IMAGE}') OR {_SMALL('width')} OR {_SMALL('height')}) AS decorative FROM j)"""


@query("img1_largest_sources", f"WITH {MEDIA}, i AS (SELECT page_id, unnest(regexp_extract_all(media, '(?i)<img\\s[^>]*>')) AS tag FROM v) SELECT page_id, list_max({_SIZED}).u AS largest FROM i WHERE {_SRCSET} <> ''")
def img1(spark, d):
    srcset = U.attribute(F.col("tag"), "srcset")
    return W.tags(V.view(spark, d, V.HTML_MEDIA), "media", "img").where(srcset != "").select("page_id", U.largest_source(srcset).alias("largest"))


@query("img2_decorative_images", f"WITH {MEDIA}, {IMAGES} SELECT page_id, pos::INT AS pos, src FROM k WHERE decorative")
def img2(spark, d):
    return W.images(V.view(spark, d, V.HTML_MEDIA)).where("decorative").select("page_id", "pos", "src")


@query("img3_best_images", f"WITH {MEDIA}, {IMAGES} SELECT page_id, pos::INT AS pos, src FROM k WHERE src <> ''")
def img3(spark, d):
    return W.images(V.view(spark, d, V.HTML_MEDIA)).where("src <> ''").select("page_id", "pos", "src")


@query("img4_true_file_types", f"WITH {FILES} SELECT doc_id, CASE {' '.join(f'''WHEN regexp_matches(magic, '{p}') THEN '{e}' ''' for e, p in U.MAGIC)} ELSE ext END AS ext FROM v")
def img4(spark, d):
    return V.view(spark, d, V.FILES).select("doc_id", U.sniffed_extension(F.col("magic"), F.col("ext")).alias("ext"))


_BACK = "regexp_extract_all(media, '(?i)background(?:-image)?\\s*:\\s*url\\(([^)]*)\\)', 1)"


@query("pg3_image_table", f"WITH {MEDIA}, {IMAGES}, b AS (SELECT page_id, url, unnest({_BACK}) AS back FROM v) SELECT page_id, src, 'img' AS origin FROM k WHERE src <> '' AND NOT decorative UNION ALL SELECT page_id, {_resolved('back')}, 'css' FROM b")
def pg3(spark, d):
    return W.image_table(V.view(spark, d, V.HTML_MEDIA))


_VIDEO = " UNION ALL ".join(f"SELECT page_id, url, unnest(regexp_extract_all(media, '(?i)<{t}\\s[^>]*{a}=\"([^\"]*)\"', 1)) AS src, '{t}' AS origin FROM v" for t, a in (("video", "src"), ("source", "src"), ("iframe", "src"), ("embed", "src"), ("a", "href")))
_VKIND = f"CASE WHEN regexp_matches(regexp_replace(target, '[?#].*$', ''), '{U.VIDEO_FILE}') THEN 'direct' WHEN regexp_matches(target, '{U.VIDEO_PLATFORM}') THEN 'platform' END"


@query("pg4_video_table", f"WITH {MEDIA} SELECT DISTINCT page_id, target, kind FROM (SELECT page_id, target, {_VKIND} AS kind FROM (SELECT page_id, {_resolved('src')} AS target FROM ({_VIDEO}))) WHERE kind IS NOT NULL")
def pg4(spark, d):
    return W.video_table(V.view(spark, d, V.HTML_MEDIA))


EDGES = "e AS (SELECT stem AS src, unnest(regexp_extract_all(regexp_replace(page_text, '`[^`]*`', '', 'g'), '\\[\\[([^\\]|#]+)(?:[|#][^\\]]+)?\\]\\]', 1)) AS dst FROM v)"


@query("pg5_frontier", f"WITH RECURSIVE {PAGES}, {EDGES}, r AS (SELECT stem, 0 AS depth FROM v WHERE doc_id % 100 = 0 UNION SELECT v.stem, depth + 1 FROM r JOIN e ON e.src = r.stem JOIN v ON v.stem = e.dst WHERE depth < 3) SELECT stem, min(depth) AS depth FROM r GROUP BY stem")
def pg5(spark, d):
    from corpusforge.operators import corpus as C

    pages = V.view(spark, d, V.DOC_PAGES)
    known = pages.select(F.col("stem").alias("dst"))
    edges = C.edges(pages).join(known, "dst", "left_semi").select("src", "dst")
    return W.frontier(pages.where("doc_id % 100 = 0").select("stem"), edges, 3)


@query("snk3_link_inventory", f"WITH {LINKS} SELECT doc AS page_id, pos, '| ' || replace(replace(url, '|', '\\|'), chr(10), ' ') || ' | ' || coalesce(skip, '') || ' |' AS line FROM {SKIP} WHERE skip IS NULL OR priority IS NOT NULL")
def snk3(spark, d):
    safe = F.replace(F.replace("url", F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    kept = W.judged_links(_links(spark, d)).where("skip IS NULL OR priority IS NOT NULL")
    return kept.select("page_id", "pos", F.concat(F.lit("| "), safe, F.lit(" | "), F.coalesce("skip", F.lit("")), F.lit(" |")).alias("line"))


@query("snk4_run_manifest", f"WITH {LINKS}, {MEDIA.replace('v AS', 'm AS')} SELECT (SELECT count(*) FROM pages) AS n_pages, (SELECT count(*) FROM v) AS n_links, (SELECT count(*) FROM m WHERE contains(media, '<img')) AS n_pages_with_images, (SELECT count(DISTINCT regexp_extract(url, '^([A-Za-z]*)://', 1)) FROM pages) AS n_schemes")
def snk4(spark, d):
    pages = table(spark, d, "pages").agg(F.count("*").alias("n_pages"), F.count_distinct(F.regexp_extract("url", "^([A-Za-z]*)://", 1)).alias("n_schemes"))
    links = _links(spark, d).agg(F.count("*").alias("n_links"))
    media = V.view(spark, d, V.HTML_MEDIA).agg(F.count_if(F.col("media").contains("<img")).alias("n_pages_with_images"))
    return pages.join(links).join(media)  # one row each


@query("win12_page_names", "SELECT page_id, n, lpad(n::VARCHAR, 6, '0') || CASE WHEN n = 1 THEN '_MAIN' ELSE '_LINKED' END AS name FROM (SELECT page_id, row_number() OVER (PARTITION BY regexp_extract(url, '^[^:]+://([^/?#]*)', 1) ORDER BY page_id) AS n FROM pages)")
def win12(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"))
    return numbered(pages, ["host"], ["page_id"]).select("page_id", "n").withColumn("name", F.concat(F.lpad(F.col("n").cast("string"), 6, "0"), F.when(F.col("n") == 1, "_MAIN").otherwise("_LINKED")))
