"""Derived views over the driver's tables.

Each view is one SELECT that both Spark SQL and DuckDB run with the same meaning; ``view`` gives it as a
DataFrame, and plans use the text itself in their SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.session import table

DOC_PAGES = """
SELECT doc_id, concat('doc-', doc_id) AS stem,
  CASE doc_id % 4 WHEN 0 THEN 'concepts' WHEN 1 THEN 'sources' WHEN 2 THEN 'projects' ELSE 'outputs' END AS section,
  CASE WHEN doc_id % 23 = 0 THEN 'memo' WHEN doc_id % 4 = 0 THEN 'concept' WHEN doc_id % 4 = 1 THEN 'source-note' WHEN doc_id % 4 = 2 THEN 'project' ELSE 'output' END AS type,
  CAST(doc_id % 300 AS INT) AS created_day, CAST(doc_id % 300 + doc_id % 500 - 5 AS INT) AS updated_day,
  doc_id % 3 = 0 AS active, doc_id % 13 <> 0 AS has_tags,
  CASE WHEN doc_id % 10 = 0 THEN 'internal' ELSE 'public' END AS privacy,
  CASE WHEN doc_id % 19 = 0 THEN concat('_INBOX/imported/f', doc_id, '.txt') ELSE concat('raw/imported_processed/f', doc_id, '.txt') END AS source_path,
  concat(
    CASE WHEN doc_id % 17 = 0 THEN '' ELSE concat('---', chr(10), 'created: d', doc_id % 300, chr(10), 'type: ',
      CASE WHEN doc_id % 23 = 0 THEN 'memo' ELSE 'note' END, chr(10),
      CASE WHEN doc_id % 13 = 0 THEN '' ELSE concat('tags: [', lang, ', ', source, ']', chr(10)) END,
      CASE WHEN doc_id % 31 = 0 THEN '' ELSE concat('---', chr(10)) END) END,
    CASE WHEN doc_id % 6 = 0 THEN concat('doi: 10.1234/d', doc_id, chr(10)) ELSE '' END,
    '# ', replace(substr(text, 1, 40), chr(10), ' '), CASE WHEN doc_id % 12 = 5 THEN ' news' ELSE '' END, chr(10), chr(10),
    CASE WHEN doc_id % 25 = 2 THEN concat('Table of Contents', chr(10), chr(10)) ELSE '' END,
    replace(text, chr(10), concat(chr(10), chr(10))), chr(10), chr(10),
    CASE WHEN doc_id % 10 = 1 THEN concat('arXiv:2401.', lpad(CAST(doc_id % 100000 AS STRING), 5, '0'), chr(10), chr(10)) ELSE '' END,
    '![chart](img/c', doc_id % 7, '.png) ![logo](https://cdn.example.org/l', doc_id % 3, '.png) [source](https://site', doc_id % 50, '.example.org/p/', doc_id, ')', CASE WHEN doc_id % 14 = 3 THEN concat(' PMID: ', 10000000 + doc_id) ELSE '' END, chr(10), chr(10),
    '[[doc-', (doc_id * 7 + 3) % (n_docs + 5), ']] [[doc-', (doc_id * 11 + 1) % n_docs, '|label]] `[[ignored]]` [[a/b]]') AS page_text
FROM (SELECT *, (SELECT count(*) FROM {documents}) AS n_docs FROM {documents}) AS counted
"""

def _check(seven: str) -> str:
    """The check digit modulo 11 of seven digits, as SQL."""
    total = " + ".join(f"{9 - i} * CAST(substr({seven}, {i}, 1) AS INT)" for i in range(1, 8))
    return f"(11 - ({total}) % 11) % 11"


def _issn(seven: str, check: str) -> str:
    return f"concat(substr({seven}, 1, 4), '-', substr({seven}, 5, 3), CASE WHEN {check} = 10 THEN 'X' ELSE CAST({check} AS STRING) END)"


#: Parts with two numbers of seven digits, their check digits, and identifiers made of them; some are missing or wrong.
_PARTS = f"""(
  SELECT *, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 29 = 0 THEN concat(substr(seven, 1, 4), '-', substr(seven, 5, 3), 'Y') ELSE {_issn('seven', 'digit')} END AS print_issn,
    CASE WHEN p_partkey % 4 = 0 THEN {_issn('other', 'other_digit')} ELSE '' END AS web_issn
  FROM (SELECT *, {_check('seven')} AS digit, {_check('other')} AS other_digit
    FROM (SELECT *, lpad(CAST(p_partkey AS STRING), 7, '0') AS seven, lpad(CAST(p_partkey + 5000000 AS STRING), 7, '0') AS other FROM {{part}}) AS numbered) AS checked) AS parts"""


_JOURNAL = "concat(p_name, ' ', p_brand, ' ', p_partkey % 40)"

REGISTRY = f"""
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'CSSCI' WHEN 1 THEN 'PKU_CORE' WHEN 2 THEN 'AMI' WHEN 3 THEN 'CSCD' ELSE 'CUSTOM' END AS scheme,
  CASE p_size % 3 WHEN 0 THEN '2021-2022' WHEN 1 THEN '2023' ELSE '2025-2026' END AS edition,
  {_JOURNAL} AS journal_name, print_issn AS issn, web_issn AS eissn,
  CASE WHEN p_partkey % 2 = 0 THEN print_issn ELSE '' END AS issn_l, lower(p_type) AS level, p_brand AS category
FROM {_PARTS}
"""

#: Lines with their customers; Spark joins in the order given, so for it orders meet customers before the lines, which are many times as many, have to move.
_ORDERED = "{lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey"
_PLACED = "{lineitem} JOIN (SELECT * FROM {orders} JOIN {customer} ON o_custkey = c_custkey) AS placed ON l_orderkey = o_orderkey"

#: Every line of every order as a bibliographic work.
WORKS = f"""
SELECT concat('w', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS work_id, l_orderkey AS n, c_custkey AS author_key, CAST(l_orderkey % 5 + 1 AS INT) AS n_authors,
  concat(CASE WHEN l_orderkey % 5 = 0 THEN 'https://doi.org/' WHEN l_orderkey % 5 = 1 THEN 'DOI: ' ELSE '' END, '10.', 1000 + l_suppkey % 9000, '/O', l_orderkey, '.', l_linenumber) AS doi,
  concat(p_name, ' in ', lower(c_mktsegment)) AS title,
  CASE l_orderkey % 3 WHEN 0 THEN {_JOURNAL} WHEN 1 THEN upper({_JOURNAL}) ELSE concat({_JOURNAL}, 'x') END AS journal_name,
  CASE WHEN l_orderkey % 4 = 1 THEN '' ELSE print_issn END AS issn,
  CASE WHEN l_orderkey % 8 = 1 THEN web_issn ELSE '' END AS eissn,
  CASE WHEN l_orderkey % 8 = 5 AND p_partkey % 2 = 0 THEN print_issn ELSE '' END AS issn_l,
  CAST(1990 + (l_orderkey + l_partkey) % 35 AS INT) AS year, CAST(l_linenumber AS STRING) AS volume,
  CASE WHEN l_orderkey % 6 = 0 THEN '' ELSE CAST(l_orderkey % 12 + 1 AS STRING) END AS issue, concat(l_partkey % 300 + 1, '-', l_partkey % 300 + 9) AS page,
  p_brand AS publisher, CASE WHEN l_orderkey % 50 = 0 THEN 'thesis' ELSE 'article-journal' END AS pub_type,
  CAST(l_orderkey % 120 AS INT) AS cited_by_count, l_orderkey % 9 = 0 AS needs_review, l_orderkey % 37 = 0 AS locked
FROM {_ORDERED} JOIN {_PARTS} ON l_partkey = p_partkey
"""

# Two digits for the place on the page, then the link; @ becomes a number of the page.
_LINK_SHAPES = (
    "https://github.com/org@/repo@", "https://github.com/org@/repo@/blob/main/docs/readme.md", "https://github.com/org@/repo@/tree/dev/src",
    "https://raw.githubusercontent.com/org@/repo@/main/a.py", "https://site@.example/login?next=1", "mailto:team@.example", "https://site@.example/static/app.css",
    "https://arxiv.org/abs/2401.0@", "https://site@.example/docs/guide#frag", "https://site@.example/docs/guide", "https://www.youtube.com/watch?v=@",
    "https://cdn@.example/media/clip.mp4?Token=abc&id=@&Token=zz&id=7&blank", "https://site@.example/share/logo.png", "https://blog@.example/post/@?uid=1&page=2",
)
LINKS = f"""
SELECT page_id, CAST(substr(shape, 1, 2) AS INT) AS pos, replace(substr(shape, 3), '@', CAST(page_id % 50 AS STRING)) AS url
FROM (SELECT page_id, explode(array({", ".join(f"'{i:02d}{u}'" for i, u in enumerate(_LINK_SHAPES))})) AS shape FROM {{pages}}) AS shapes
UNION ALL
SELECT page_id, 100 + nth AS pos, CASE WHEN href LIKE '/%' THEN concat(regexp_extract(url, '^([a-z]+://[^/?#]*)', 1), href) ELSE href END AS url
FROM (SELECT page_id, url, @hrefs@ FROM {{pages}}) AS linked
"""
#: Numbered links of a page's own HTML; engines differ in how they number what an array holds.
_HREFS = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"
_NUMBERED = f"posexplode({_HREFS}) AS (nth, href)", f"unnest({_HREFS}) AS href, CAST(generate_subscripts({_HREFS}, 1) - 1 AS INT) AS nth"

HTML_MEDIA = """
SELECT page_id, url, concat(html, replace(CASE page_id % 6
  WHEN 0 THEN '<p><img srcset="/a-480.jpg 480w, /b-@.jpg 1024w" src="/p.gif"></p>'
  WHEN 1 THEN '<img data-src="/img/@.png" src="data:image/gif;base64,R0"><img src="//cdn.example/x.webp">'
  WHEN 2 THEN '<img src="/pixel.gif" width="1" height="1"><img src="/ok.png" width="2px"><img src="pic/@.png" width="640">'
  WHEN 3 THEN '<video src="https://cdn.example/@.mp4"></video><source src="/alt/@.webm"><a href="https://youtu.be/@">v</a>'
  WHEN 4 THEN '<iframe src="https://player.vimeo.com/video/@"></iframe><iframe src="https://ads.example/f"></iframe>'
  ELSE '<div style="background-image:url(/bg/@.jpg)"></div><img src="/loading.gif"><img data-original="https://i.example/@.jpg" src="/blank.gif">' END, '@', CAST(page_id AS STRING))) AS media
FROM {pages}
"""

FILES = """
SELECT doc_id, concat(CASE doc_id % 3 WHEN 0 THEN 'inbox/' WHEN 1 THEN 'chat/' ELSE 'scan/.git/' END, name) AS path, name, ext, size_bytes, sample,
  CASE doc_id % 3 WHEN 0 THEN 'inbox' WHEN 1 THEN 'chat' ELSE 'scan' END AS source_label, doc_id % 4 = 0 AS processed, magic
FROM (
  SELECT *, concat(CASE WHEN doc_id % 40 = 0 THEN '.env' WHEN doc_id % 40 = 1 THEN concat('id_rsa', doc_id) WHEN doc_id % 12 = 0 THEN 'report' ELSE concat('file-', doc_id) END, ext) AS name
  FROM (
    SELECT doc_id, CASE doc_id % 14 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.pptx' WHEN 3 THEN '.md' WHEN 4 THEN '.txt' WHEN 5 THEN '.doc' WHEN 6 THEN '.csv' WHEN 7 THEN '.html' WHEN 8 THEN '.py' WHEN 9 THEN '.png' WHEN 10 THEN '.zip' WHEN 11 THEN '.json' WHEN 12 THEN '.ppt' ELSE '.xlsx' END AS ext,
      n_chars * (1 + doc_id % 9) AS size_bytes,
      concat(CASE doc_id % 7 WHEN 0 THEN 'university research ' WHEN 1 THEN '作业 ' WHEN 2 THEN '格式 ' WHEN 3 THEN '项目 ' WHEN 4 THEN 'pattern ' WHEN 5 THEN 'api_key = abcdefghij0123456789xy ' ELSE '' END, text) AS sample,
      CASE doc_id % 8 WHEN 0 THEN 'FFD8FFE000104A464946000101' WHEN 1 THEN '89504E470D0A1A0A0000000D' WHEN 2 THEN '474946383961' WHEN 3 THEN '52494646AABBCCDD57454250' WHEN 4 THEN '0000001C6674797061766966' WHEN 5 THEN '20203C737667' WHEN 6 THEN '3C3F786D6C20' ELSE '25504446' END AS magic
    FROM {documents}
  ) AS a
) AS b
"""

CACHE = """
SELECT event_type AS namespace, user_id AS cache_key, event_id, props AS payload, event_id AS created,
  event_id + CASE event_type WHEN 'click' THEN 3000 WHEN 'view' THEN 700 ELSE 100 END AS expires
FROM {events}
"""

RESPONSES = """
SELECT event_id, user_id AS page, CASE event_id % 9 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 204 ELSE 200 END AS status,
  CASE WHEN event_id % 25 = 0 THEN 'OPTIONS' ELSE 'GET' END AS method,
  CASE event_id % 5 WHEN 0 THEN 'application/json; charset=utf-8' WHEN 1 THEN 'text/html' WHEN 2 THEN 'text/plain' WHEN 3 THEN 'image/png' ELSE 'application/ld+json' END AS content_type,
  1000 * event_id % 700000 AS declared_size, props AS body
FROM {events}
"""

_CANDIDATE = """
SELECT page_id, '%M%' AS method, CAST((page_id * %F% + %S%) % 101 AS INT) AS quality_score, (page_id * %F% + %S%) % 101 >= 60 AS quality_complete,
  CAST((page_id * %F% * 3 + %S%) % 121 AS INT) AS ranking_score,
  CASE (page_id + %F%) % 6 WHEN 0 THEN 'data.article.content' WHEN 1 THEN 'data.comments[0].text' WHEN 2 THEN 'result.post.html' WHEN 3 THEN 'user.profile.bio' WHEN 4 THEN 'recommend.items[2].title' ELSE 'post.comments[1].content' END AS json_path,
  CASE WHEN (page_id + %S%) % 11 = 0 THEN 'captcha_detected' WHEN (page_id + %S%) % 7 = 0 THEN 'text_too_short' ELSE '' END AS issue,
  CAST(150 + page_id % 100 - %S% * 5 AS INT) AS content_length
FROM {pages}
"""
CANDIDATES = " UNION ALL ".join(
    _CANDIDATE.replace("%M%", m).replace("%F%", str(f)).replace("%S%", str(s)) for m, f, s in (("http", 7, 3), ("playwright_dom", 11, 5), ("playwright_network", 13, 9))
)

SNAPSHOTS = """
SELECT doc_id, CASE WHEN doc_id % 11 <> 0 THEN doc_id * 10 END AS old_mtime,
  CASE WHEN doc_id % 13 <> 0 THEN doc_id * 10 + CASE WHEN doc_id % 6 = 0 THEN 5 ELSE 0 END END AS new_mtime
FROM {documents}
"""

TABLES = ("documents", "part", "events", "pages", "lineitem", "orders", "customer")


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("@hrefs@", _NUMBERED[0]).replace(_ORDERED, _PLACED), **used)


def duck(sql: str) -> str:
    """The same view for DuckDB."""
    sql = sql.replace("@hrefs@", _NUMBERED[1])
    for t in TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace("AS STRING", "AS VARCHAR").replace("explode(array(", "unnest(list_value(")
