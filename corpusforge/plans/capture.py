"""Queries over page contents, reader output, JSON candidates, and writing and reading pages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusforge.functions import quality as Q
from corpusforge.operators import capture as K
from corpusforge.operators import files as A
from corpusforge.operators import numbering
from corpusforge.operators import users
from corpusforge.plans.quality import _report_sql
from corpusforge.functions.reading import LOG_MARKS
from corpusforge.plans.registry import query
from corpusforge.session import checkpoint_folder, checkpointed, table
from corpusforge.sources import folders as FO
from corpusforge.sources import pages as P
from corpusforge.sources import views as V
from corpusforge.streaming import capture as stream

_s = lambda x: "'" + x.replace("'", "''") + "'"
PAGES, FILES, MEDIA, WORKS = (f"v AS ({V.duck(s)})" for s in (V.DOC_PAGES, V.FILES, V.HTML_MEDIA, V.WORKS))
_edge = lambda x: f"regexp_replace({x}, {_s(K.EDGE)}, '', 'g')"



def _kept(rows, folder):
    """The rows read from a folder, which is deleted."""
    rows = checkpointed(rows)
    FO.deleted(rows.sparkSession, folder)
    return rows


# A reader's output, made of a document and of the site's own lines.
_RAW = """CASE WHEN doc_id % 3 = 0 THEN 'Title: Doc ' || doc_id || chr(10) || 'URL: x' || chr(10) || 'Markdown Content:' || chr(10) ELSE '' END || substr(text, 1, 60) || chr(10) ||
  'See new posts' || chr(10) || '[x](https://x.com/tos)' || chr(10) || CASE WHEN doc_id % 4 = 1 THEN '## New to X?' || chr(10) || 'Sign up now' || chr(10) || '### new to X again' || chr(10) || 'more' || chr(10) ELSE '' END ||
  '# Heading' || chr(10) || text || chr(10) || chr(10) || chr(10) || chr(10) || chr(10) || '  Create account' || chr(10) || 'By signing up, you agree to all' || chr(10) || 'end '"""
_SPARK_RAW = _RAW.replace("chr(10)", "'\\n'")
_AT = "strpos(raw, 'Markdown Content:')"
_BODY = f"CASE WHEN {_AT} > 0 THEN {_edge(f'substr(raw, {_AT} + 17)')} ELSE raw END"
_LINES = f"list_filter(string_split(regexp_replace({_BODY}, {_s(K.READER_SECTION)}, '', 'g'), chr(10)), lambda x: trim(x) NOT IN ({', '.join(map(_s, K.READER_LINES))}) AND NOT regexp_matches(x, {_s(K.READER_LINK)}) AND NOT starts_with(lower(trim(x)), 'by signing up, you agree'))"
_CLEAN = _edge(f"regexp_replace(array_to_string({_LINES}, chr(10)), '\\n{{4,}}', chr(10) || chr(10) || chr(10), 'g')")


@query("txt10_reader_text", f"WITH r AS (SELECT doc_id, {_RAW} AS raw FROM documents WHERE text IS NOT NULL) SELECT doc_id, coalesce(nullif({_edge('''substr(list_filter(string_split(raw, chr(10))[1:20], lambda x: starts_with(x, 'Title:'))[1], 7)''')}, ''), 'doc-' || doc_id) AS title, sha256({_CLEAN}) AS sha FROM r")
def txt10(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.expr(_SPARK_RAW).alias("raw"))
    return rows.select("doc_id", K.reader_title(F.col("raw"), F.concat(F.lit("doc-"), "doc_id")).alias("title"), F.sha2(K.reader_text(F.col("raw")), 256).alias("sha"))


_BASE = "https://raw.example.org/docs/"
_ABS = f"replace(replace(regexp_replace(page_text, '!\\[([^\\]]*)\\]\\([./]*([^)\\s]+)\\)', '![\\1]({_BASE}\\2)', 'g'), '({_BASE}http', '(http'), '({_BASE}data:', '(data:')"


@query("txt14_absolute_images", f"WITH {PAGES}, t AS (SELECT doc_id, {_ABS} AS t FROM v), i AS (SELECT doc_id, unnest(regexp_extract_all(t, '!\\[([^\\]]*)\\]\\(((?:https?:)?//[^)]+)\\)', 2)) AS url FROM t) SELECT doc_id, sha256(t) AS sha, (SELECT count(DISTINCT url) FROM i WHERE i.doc_id = t.doc_id) AS n_images FROM t")
def txt14(spark, d):
    rows = V.view(spark, d, V.DOC_PAGES).select("doc_id", K.absolute_images(F.col("page_text"), _BASE).alias("t"))
    images = K.markdown_images(rows, "t", "doc_id").groupBy("doc_id").agg(F.count("*").alias("n_images"))
    return rows.select("doc_id", F.sha2("t", 256).alias("sha")).join(images, "doc_id", "left").fillna({"n_images": 0})


_TAGLESS = "regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z]+;|&#[0-9]+;', ' ', 'g'), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')"
_NO_NOISE = "regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g')"
for _t in K.NOISE_TAGS:
    _NO_NOISE = f"regexp_replace({_NO_NOISE}, '(?is)<{_t}(\\s[^>]*)?>.*?</{_t}>', ' ', 'g')"
_IN = lambda t: _edge(_TAGLESS.format(f"regexp_extract(clean, '(?is)<{t}(\\s[^>]*)?>(.*)</{t}>', 2)"))
_HOST = "regexp_extract(url, '^[^:]+://([^/?#]*)', 1)"
_NAMED = lambda t: "nullif(" + _edge(_TAGLESS.format(f"regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1)")) + ", '')"


@query(
    "pg1_main_content",
    f"""WITH c AS (SELECT page_id, coalesce({_NAMED('title')}, {_NAMED('h1')}, {_HOST}) AS title, {_NO_NOISE} AS clean FROM pages), t AS (SELECT page_id, title, {_IN('article')} AS a, {_IN('main')} AS m, {_IN('body')} AS b FROM c)
    SELECT page_id, title, CASE WHEN length(a) > 100 THEN 'article' WHEN length(m) > 100 THEN 'main' ELSE 'body' END AS region, sha256(CASE WHEN length(a) > 100 THEN a WHEN length(m) > 100 THEN m ELSE b END) AS sha FROM t""",
)
def pg1(spark, d):
    rows = table(spark, d, "pages").select("page_id", K.main_content(F.col("html"), F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1)).alias("p"))
    return rows.select("page_id", "p.title", "p.region", F.sha2("p.text", 256).alias("sha"))


# JSON texts in four shapes, made of the documents.
_PARAS = "string_split(text, chr(10))"
STRINGS = f"""j AS (SELECT doc_id, text, substr(text, 1, 40) AS title FROM documents WHERE text IS NOT NULL),
  h AS (SELECT doc_id, title, '$.data.article.content' AS path, 'content' AS field, text AS content FROM j WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, title, '$.comments[0].text', 'text', text FROM j WHERE doc_id % 4 = 1
    UNION ALL SELECT doc_id, title, '$.result.post.html', 'html', '<p>' || text || '</p>' FROM j WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, title, '$.page.blocks[' || (i - 1) || '].text', 'text', p FROM (SELECT doc_id, title, unnest({_PARAS}) AS p, generate_subscripts({_PARAS}, 1) AS i FROM j WHERE doc_id % 4 = 3)),
  e AS (SELECT doc_id, title, path, field, {_edge('content')} AS content FROM h),
  s AS (SELECT * FROM e WHERE length(content) >= 200 AND NOT (len(string_split(content, chr(10))) > 4 AND 10 * len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '{LOG_MARKS}'))) > 3 * len(string_split(content, chr(10))))),
  b AS (SELECT doc_id, title, array_to_string(list_filter({_PARAS}, lambda t: length(trim(t)) >= 10), chr(10) || chr(10)) AS content FROM j WHERE doc_id % 4 = 3 AND len({_PARAS}) BETWEEN 2 AND 200 AND len(list_filter({_PARAS}, lambda t: length(trim(t)) >= 10)) >= 2)"""


def _json(spark, d):
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    one = lambda *path: F.struct(one(*path[1:]).alias(path[0])) if len(path) > 1 else path[0]
    text, n = F.col("text"), F.col("doc_id") % 4
    blocks = F.transform(F.split("text", "\n", -1), lambda p: F.struct(F.lit("p").alias("type"), p.alias("text")))
    json = (
        F.when(n == 0, F.to_json(one("data", "article", F.struct(text.alias("content"))))).when(n == 1, F.to_json(F.struct(F.array(F.struct(text.alias("text")), F.struct(F.lit("short").alias("text"))).alias("comments"))))
        .when(n == 2, F.to_json(one("result", "post", F.struct(F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("html"))))).otherwise(F.to_json(one("page", F.struct(blocks.alias("blocks")))))
    )
    return rows.select("doc_id", F.substring("text", 1, 40).alias("title"), json.alias("json"))


@query("jsn1_json_strings", f"WITH {STRINGS} SELECT doc_id, path, field, sha256(content) AS sha FROM s")
def jsn1(spark, d):
    return K.harvested(_json(spark, d), "doc_id", "json").select("doc_id", "path", "field", F.sha2("content", 256).alias("sha"))


# A block's text is the node 6 + 3i and the string 2 + 2i of its document.
_PLACE = "CASE WHEN starts_with(path, '$.page.blocks[') THEN CAST(regexp_extract(path, '\\[([0-9]+)\\]', 1) AS INT) ELSE -1 END"


@query("jsn1_budgets", f"WITH {STRINGS} SELECT 'nodes' AS budget, doc_id, path, sha256(content) AS sha FROM s WHERE 6 + 3 * {_PLACE} <= 9 UNION ALL SELECT 'strings', doc_id, path, sha256(content) FROM s WHERE 2 + 2 * {_PLACE} <= 3 UNION ALL SELECT 'later', doc_id, path, sha256(content) FROM s WHERE 2 + 2 * {_PLACE} > 19")
def jsn1_budgets(spark, d):
    """Budgets small enough to bite: 9 nodes; 3 strings; and what the 20th string and later ones add."""
    rows = _json(spark, d)
    some = lambda name, found: found.select(F.lit(name).alias("budget"), "doc_id", "path", F.sha2("content", 256).alias("sha"))
    deep = K.harvested(rows, "doc_id", "json").join(K.harvested(rows, "doc_id", "json", strings=19), ["doc_id", "path"], "left_anti")
    return some("nodes", K.harvested(rows, "doc_id", "json", nodes=9)).union(some("strings", K.harvested(rows, "doc_id", "json", strings=3))).union(some("later", deep))


def _blocks(spark, d):
    parsed = F.from_json("json", "page STRUCT<blocks: ARRAY<STRUCT<type: STRING, text: STRING>>>")["page"]["blocks"]
    return _json(spark, d).select("doc_id", "title", K.merged_blocks(parsed).alias("content")).where("content IS NOT NULL")


@query("jsn2_merged_blocks", f"WITH {STRINGS} SELECT doc_id, sha256(content) AS sha FROM b WHERE length(trim(content)) >= 200")
def jsn2(spark, d):
    return _blocks(spark, d).select("doc_id", F.sha2("content", 256).alias("sha"))


_UNION = f"""{STRINGS}, u AS (SELECT doc_id, title, path, field, content, '' AS hint, 'application/json' AS content_type, 0 AS place FROM s UNION ALL SELECT doc_id, title, '$.page.blocks', 'blocks', content, 'merged_blocks', 'application/json', 1 FROM b WHERE length(trim(content)) >= 200
    UNION ALL SELECT doc_id, title, '', '', text, 'plain_text', 'text/plain', 2 FROM j WHERE doc_id % 6 < 3),
  x AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(content, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS normal FROM u),
  d AS (SELECT * FROM x WHERE length(normal) >= 50 QUALIFY row_number() OVER (PARTITION BY doc_id, sha256(normal) ORDER BY place, path) = 1)"""


def _candidates(spark, d):
    """All sources of candidates, one row for each content of a document."""
    rows = _json(spark, d)
    strings = K.harvested(rows, "doc_id", "json").join(rows.select("doc_id", "title"), "doc_id").select("doc_id", "title", "path", "field", "content", F.lit("").alias("hint"), F.lit("application/json").alias("content_type"), F.lit(0).alias("place"))
    blocks = _blocks(spark, d).select("doc_id", "title", F.lit("$.page.blocks"), F.lit("blocks"), "content", F.lit("merged_blocks"), F.lit("application/json"), F.lit(1))
    plain = table(spark, d, "documents").where("text IS NOT NULL AND doc_id % 6 < 3").select("doc_id", F.substring("text", 1, 40), F.lit(""), F.lit(""), "text", F.lit("plain_text"), F.lit("text/plain"), F.lit(2))
    every = strings.union(blocks).union(plain).withColumn("normal", K.normal_content(F.col("content"))).where("length(normal) >= 50")
    first = every.groupBy("doc_id", F.sha2("normal", 256).alias("sha")).agg(F.min_by(F.struct("title", "path", "field", "content", "hint", "content_type", "normal"), F.struct("place", "path")).alias("c"))
    return first.select("doc_id", "sha", "c.*")


_KIND = "CASE WHEN hint = 'merged_blocks' THEN 'json_block_array' WHEN hint IN ('html_document', 'plain_text') THEN hint WHEN contains(lower(content_type), 'json') THEN CASE WHEN contains(lower(field), 'html') THEN 'json_html' ELSE 'json_string' END WHEN contains(lower(content_type), 'html') THEN 'html_document' ELSE 'plain_text' END"


@query("ddp5_candidate_sources", f"WITH {_UNION} SELECT doc_id, path, hint, sha256(normal) AS sha FROM d")
def ddp5(spark, d):
    return _candidates(spark, d).select("doc_id", "path", "hint", "sha")


_BONUS = "CASE " + " ".join(f"WHEN lower(field) = '{n}' THEN {p}" for n, p in K.CONTENT_FIELDS.items()) + " ELSE 0.0 END"


@query("jsn4_field_kinds", f"WITH {_UNION} SELECT doc_id, path, hint, {_KIND} AS kind, {_BONUS}::DOUBLE AS bonus FROM d")
def jsn4(spark, d):
    rows = _candidates(spark, d)
    return rows.select("doc_id", "path", "hint", K.source_kind(F.col("hint"), F.col("content_type"), F.col("field")).alias("kind"), K.field_bonus(F.col("field")).alias("bonus"))


_any = lambda words: "(" + " OR ".join(f"contains(lower(path), '{w}')" for w in words) + ")"
_LETTERS = "list_distinct(string_split(regexp_replace(lower({}), '\\s+', '', 'g'), ''))"
_SHARED = f"len(list_filter(list_intersect({_LETTERS.format('title')}, {_LETTERS.format('substr(content, 1, 1000)')}), lambda c: c <> ''))"
_RANK = f"""greatest(0.0, least(120.0, quality::DOUBLE + ({_BONUS}) + CASE WHEN {_any(K.POSITIVE_PATH)} THEN 2.0 ELSE 0.0 END - CASE WHEN {_any(K.NEGATIVE_PATH)} THEN 3.0 ELSE 0.0 END
  + CASE WHEN length(title) > 2 AND shared > 5 THEN least(5.0, shared * 0.3) ELSE 0.0 END + CASE WHEN kind IN ('json_string', 'json_html') AND {_any(K.DETAIL_PATH)} THEN 3.0 ELSE 0.0 END))"""


@query("mth1_ranking_scores", f"WITH {_UNION}, k AS (SELECT *, {_KIND} AS kind, (length(normal) % 101)::INT AS quality, {_SHARED} AS shared FROM d) SELECT doc_id, path, hint, round({_RANK}::DOUBLE, 4) AS score FROM k")
def mth1(spark, d):
    """Ranking of candidates whose quality is given (here made of the content's length)."""
    rows = _candidates(spark, d).withColumn("kind", K.source_kind(F.col("hint"), F.col("content_type"), F.col("field")))
    score = K.ranking_score(F.length("normal") % 101, F.col("field"), F.col("path"), F.col("content"), F.col("title"), F.col("kind"))
    return rows.select("doc_id", "path", "hint", F.round(score, 4).alias("score"))


_REPORTED = _report_sql("SELECT doc_id, path, hint, title, normal AS content, '' AS html FROM d", "doc_id, path, hint")


@query("mth2_scored_candidates", f"WITH {_UNION}, q AS ({_REPORTED}) SELECT doc_id, path, hint, kind, score AS quality, complete, raw_length, normal_length FROM q JOIN (SELECT doc_id, path, hint, {_KIND} AS kind, length(content) AS raw_length, length(normal) AS normal_length FROM d) USING (doc_id, path, hint)")
def mth2(spark, d):
    """Candidates with their quality report."""
    rows = _candidates(spark, d).withColumn("kind", K.source_kind(F.col("hint"), F.col("content_type"), F.col("field")))
    found = Q.report(rows, F.col("title"), F.col("normal"))
    length = lambda c: F.length(c).cast("long")
    return found.select("doc_id", "path", "hint", "kind", F.col("score").alias("quality"), "complete", length("content").alias("raw_length"), length("normal").alias("normal_length"))


# Pages written and read again; packs; images in page texts.


@query("snk1_written_pages", f"WITH {PAGES} SELECT section, stem, sha256(page_text) AS sha FROM v")
def snk1(spark, d):
    folder = f"{checkpoint_folder(spark)}/pages-{uuid.uuid4().hex}"
    P.write_pages(V.view(spark, d, V.DOC_PAGES), folder)
    return _kept(P.scan_pages(spark, folder).select("section", "stem", F.sha2("page_text", 256).alias("sha")), folder)


@query("src1_corpus_scan", f"WITH {PAGES} SELECT count(*) AS n, sum(length(page_text))::BIGINT AS chars FROM v WHERE stem NOT IN ('index', 'log')")
def src1(spark, d):
    """All pages of a written corpus but its index and log."""
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    pages = V.view(spark, d, V.DOC_PAGES)
    extra = spark.createDataFrame([("concepts", "index", "[[doc-1]]"), ("concepts", "log", "x")], "section string, stem string, page_text string")
    P.write_pages(pages.select("section", "stem", "page_text").union(extra), folder)
    return _kept(P.scan_pages(spark, folder).agg(F.count("*").alias("n"), F.sum(F.length("page_text")).alias("chars")), folder)


@query("snk2_json_export", f"WITH {WORKS} SELECT work_id, title, year, journal_name AS journal, cited_by_count AS citations_count, locked FROM v")
def snk2(spark, d):
    folder = f"{checkpoint_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = V.view(spark, d, V.WORKS).select("work_id", "title", "year", F.col("journal_name").alias("journal"), F.col("cited_by_count").alias("citations_count"), "locked")
    rows.write.json(folder)
    return _kept(spark.read.schema(rows.schema).json(folder), folder)


_DEPTH = "(page_id % 3)"


@query("snk6_reading_map", f"SELECT page_id, host, row_number() OVER (PARTITION BY host ORDER BY depth, page_id) AS place, CASE WHEN depth = 0 THEN 'MAIN' ELSE 'LINKED' END AS role, depth, chars FROM (SELECT page_id, {_HOST} AS host, {_DEPTH} AS depth, length(html) AS chars FROM pages)")
def snk6(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[^:]+://([^/?#]*)", 1).alias("host"), F.expr(_DEPTH).alias("depth"), F.length("html").alias("chars"))
    placed = numbering.numbered(rows, ["host"], ["depth", "page_id"], "place")
    return placed.select("page_id", "host", "place", F.when(F.col("depth") == 0, "MAIN").otherwise("LINKED").alias("role"), "depth", "chars")


_PACKS = "SELECT DISTINCT concat('site', doc_id % 80, '.example.org') AS pack FROM {}"


@query("j16_processed_packs", f"WITH {PAGES}, k AS ({_PACKS.format('documents')}), m AS (SELECT DISTINCT unnest(regexp_extract_all(page_text, 'site\\d+\\.example\\.org')) AS pack FROM v WHERE section = 'sources') SELECT pack, pack IN (SELECT pack FROM m) AS processed FROM k")
def j16(spark, d):
    """Packs whose name a source page holds: the names are taken out of the pages, so the join is on equality."""
    packs = table(spark, d, "documents").select(F.concat(F.lit("site"), F.col("doc_id") % 80, F.lit(".example.org")).alias("pack")).distinct()
    named = V.view(spark, d, V.DOC_PAGES).where("section = 'sources'").select(F.explode(F.regexp_extract_all("page_text", F.lit("site\\d+\\.example\\.org"), F.lit(0))).alias("pack")).distinct()
    return packs.join(named.withColumn("processed", F.lit(True)), "pack", "left").select("pack", F.coalesce("processed", F.lit(False)).alias("processed"))


_SRC = "list_distinct(regexp_extract_all(media, '<img[^>]* src=\"(/[^\"]*)\"', 1))"


@query("j17_local_images", f"WITH {MEDIA} SELECT page_id, len({_SRC}) AS n_images, sha256(list_reduce(list_prepend(media, {_SRC}), lambda acc, u: replace(acc, '\"' || u || '\"', '\"assets/' || substr(sha256(u), 1, 12) || '\"'))) AS sha FROM v")
def j17(spark, d):
    """Pages whose images' addresses are replaced by local paths; a page's own images come as one array."""
    pages = V.view(spark, d, V.HTML_MEDIA).select("page_id", "media")
    urls = F.array_distinct(F.regexp_extract_all("media", F.lit('<img[^>]* src="(/[^"]*)"'), F.lit(1)))
    images = pages.select("page_id", F.explode(urls).alias("url")).withColumn("path", F.concat(F.lit("assets/"), F.substring(F.sha2("url", 256), 1, 12)))
    paths = images.groupBy("page_id").agg(F.collect_list(F.struct("url", "path")).alias("images"))
    joined = pages.join(paths, "page_id", "left")
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    body = F.aggregate(F.coalesce("images", F.array().cast("array<struct<url:string,path:string>>")), F.col("media"), lambda acc, i: F.replace(acc, quoted(i["url"]), quoted(i["path"])))
    return joined.select("page_id", F.coalesce(F.size("images"), F.lit(0)).cast("long").alias("n_images"), F.sha2(body, 256).alias("sha"))


_PACK_ROWS = "SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN 'v1-pack-' ELSE 'pack-' END, doc_id) AS pack, doc_id % 7 <> 0 AS has_readme, doc_id % 10 = 0 AS warned FROM documents"


@query("hl4_pack_issues", f"SELECT pack, CASE WHEN NOT has_readme THEN 'missing README.md' ELSE 'v1 pack missing quality warning' END AS issue FROM ({_PACK_ROWS}) WHERE NOT has_readme OR (contains(lower(pack), 'v1') AND NOT warned)")
def hl4(spark, d):
    rows = table(spark, d, "documents").selectExpr("doc_id", "concat(CASE WHEN doc_id % 5 = 0 THEN 'v1-pack-' ELSE 'pack-' END, doc_id) AS pack", "doc_id % 7 <> 0 AS has_readme", "doc_id % 10 = 0 AS warned")
    return rows.select("pack", A.pack_issue(F.col("pack"), F.col("has_readme"), F.col("warned")).alias("issue")).where("issue IS NOT NULL")


_EXTRACT = "doc_id % 6 <> 1 AS extracted, doc_id % 8 <> 3 AS found, doc_id % 9 <> 4 AS is_file, doc_id % 4 <> 3 AS full_mode"
_ROUTE = f"""CASE WHEN NOT found THEN 'file_not_found' WHEN NOT is_file THEN 'not_a_file' WHEN gate <> 'accepted' AND gate <> 'legacy_type' AND gate <> 'unsupported_type' THEN 'import_failed' WHEN NOT full_mode THEN 'safe_mode'
  WHEN ext = '.doc' THEN 'legacy_doc_unsupported' WHEN ext NOT IN ({', '.join(map(_s, A.EXTRACTED))}) THEN 'direct_read' WHEN extracted THEN 'extracted' ELSE 'needs_fallback' END"""


def _routes(spark, d):
    from corpusforge.plans.files import flt8

    rows = V.view(spark, d, V.FILES).selectExpr("doc_id", "ext", *_EXTRACT.split(", "))
    return A.routed(rows.join(flt8(spark, d).withColumnRenamed("verdict", "gate"), "doc_id"))


def _routes_sql() -> str:
    from corpusforge.plans.files import GATE

    return f"SELECT doc_id, {_ROUTE} AS route FROM (SELECT doc_id, ext, {_EXTRACT}, {GATE} AS gate FROM v)"


@query("flt13_ingest_routes", f"WITH {FILES} SELECT doc_id, route, route IN ('legacy_doc_unsupported', 'needs_fallback') AS fallback_required FROM ({_routes_sql()})")
def flt13(spark, d):
    return _routes(spark, d).select("doc_id", "route", "fallback_required")


# Functions that a user plugs in.

_COUNT = lambda c: f"(length(t) - length(replace(t, '{c}', '')))::DOUBLE"


@query("udf1_encoded_documents", f"SELECT doc_id, round({_COUNT('a')} / 100, 6) AS v0, round({_COUNT('e')} / 100, 6) AS v1 FROM (SELECT doc_id, source || chr(10) || substr(coalesce(text, ''), 1, 2000) AS t FROM documents)")
def udf1(spark, d):
    """Vectors of title and first 2,000 characters by a user's function, in batches of 32 (here two letters' counts)."""
    vectors = users.encoded(table(spark, d, "documents"), "doc_id", "source", "text", users.letter_counts)
    return vectors.select("doc_id", F.round(F.col("vector")[0], 6).alias("v0"), F.round(F.col("vector")[1], 6).alias("v1"))


@query("udf2_pair_scores", "SELECT item_id, doc_id, round(least(length(b.text), length(t.text))::DOUBLE / greatest(length(b.text), length(t.text), 1), 6) AS score FROM benchmark b JOIN documents t ON t.doc_id % 100 = b.item_id % 100 WHERE t.text IS NOT NULL AND b.text IS NOT NULL")
def udf2(spark, d):
    """Pairs scored by a user's function of query and text (here the ratio of their lengths)."""
    asked = table(spark, d, "benchmark").where("text IS NOT NULL").select("item_id", F.col("text").alias("query"), (F.col("item_id") % 100).alias("k"))
    docs = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text", (F.col("doc_id") % 100).alias("k"))
    return users.pair_scored(asked.join(docs, "k"), "query", "text", users.length_ratio).select("item_id", "doc_id", F.round("score", 6).alias("score"))


@query("udf3_compatible_forms")
def udf3(spark, d):
    """Texts in compatibility form (NFKC), for which SQL has no function."""
    rows = table(spark, d, "documents").select("doc_id", F.concat(F.lit("ＡＢ①ﬁ "), F.coalesce("text", F.lit(""))).alias("text"))
    return users.compatible(rows, "text").select("doc_id", F.sha2("text", 256).alias("sha"))


@query("udf4_html_function", "SELECT page_id, length(html) AS chars, (length(html) - length(replace(html, '<', ''))) AS tags FROM pages")
def udf4(spark, d):
    """What a user's function makes of each page's HTML."""
    rows = K.with_html_function(table(spark, d, "pages").select("page_id", "html"), lambda h: {"chars": len(h), "tags": h.count("<")}, "chars long, tags long")
    return rows.select("page_id", "chars", "tags")


# Streams.


@query("st5_resumed_batch", "SELECT o_orderkey AS item, CASE WHEN o_orderkey % 3 = 0 THEN 'succeeded' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'succeeded' END AS status, o_orderkey % 3 <> 0 AS done_now FROM orders")
def st5(spark, d):
    """A batch that goes on: what the ledger has as succeeded isn't done again."""
    items = table(spark, d, "orders").select(F.col("o_orderkey").alias("item"))
    ledger = items.where("item % 3 = 0").withColumn("status", F.lit("succeeded")).union(items.where("item % 7 = 0 AND item % 3 <> 0").withColumn("status", F.lit("failed")))
    return A.resumed(items, ledger, F.when(F.col("item") % 11 == 0, "failed").otherwise("succeeded"))


@query("pg7_rebuilt_pages", f"WITH v AS ({V.duck(V.CANDIDATES)}), n AS (SELECT * FROM v WHERE method = 'playwright_network'), h AS (SELECT page_id, quality_score AS before FROM v WHERE method = 'http') SELECT page_id, quality_score AS score, quality_score - before AS gain, CASE WHEN quality_complete THEN 'complete' WHEN quality_score > before THEN 'better' ELSE 'kept' END AS diagnosis, content_length > 200 AS long_enough FROM n JOIN h USING (page_id)")
def pg7(spark, d):
    """Pages rebuilt from their network candidate, with what that changed."""
    rows = V.view(spark, d, V.CANDIDATES)
    before = rows.where("method = 'http'").select("page_id", F.col("quality_score").alias("before"))
    both = rows.where("method = 'playwright_network'").join(before, "page_id")
    diagnosis = F.when(F.col("quality_complete"), "complete").when(F.col("quality_score") > F.col("before"), "better").otherwise("kept")
    return both.select("page_id", F.col("quality_score").alias("score"), (F.col("quality_score") - F.col("before")).alias("gain"), diagnosis.alias("diagnosis"), (F.col("content_length") > 200).alias("long_enough"))


@query("src10_page_source", f"SELECT page_id, {_HOST} AS host, regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1) AS lang, len(regexp_extract_all(html, '(?i)<a\\s')) AS n_links, length(html) AS chars FROM pages")
def src10(spark, d):
    rows = P.html_pages(table(spark, d, "pages"))
    return rows.select("page_id", "host", "lang", F.col("n_links").cast("long").alias("n_links"), F.col("chars").cast("long").alias("chars"))
