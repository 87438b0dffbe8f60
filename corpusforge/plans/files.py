"""Queries over incoming files, candidates and page texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusforge.functions import quality as Q
from corpusforge.operators import corpus as C
from corpusforge.operators import files as A
from corpusforge.operators.numbering import numbered
from corpusforge.plans.quality import _plain_sql
from corpusforge.plans.registry import query
from corpusforge.session import checkpoint_folder, checkpointed, table
from corpusforge.sources import folders as FO
from corpusforge.sources import views as V
from corpusforge.streaming import capture as stream

FILES, CAND, PAGES, SNAP = (f"v AS ({V.duck(s)})" for s in (V.FILES, V.CANDIDATES, V.DOC_PAGES, V.SNAPSHOTS))
_list = lambda items: "(" + ", ".join(f"'{i}'" for i in items) + ")"
_LOW = "lower(name || chr(10) || sample)"
CLASS = "CASE " + " ".join(f"WHEN lower(ext) IN {_list(e)} AND regexp_matches({_LOW}, '{'|'.join(w)}') THEN '{c}'" for c, (e, w) in A.CLASSES.items()) + " ELSE 'unknown' END"
_SECRET = A.SECRET_SAMPLE.replace("'", "''")
GATE = f"""CASE WHEN regexp_matches(path, '(^|/)(\\.[^/]+|node_modules|__pycache__)/') THEN 'pruned' WHEN regexp_matches(name, '{A.SENSITIVE_NAME}') THEN 'sensitive_name' WHEN ext IN {_list(A.LEGACY)} THEN 'legacy_type'
  WHEN ext NOT IN {_list(A.IMPORTED)} THEN 'unsupported_type' WHEN size_bytes > 10485760 THEN 'too_large' WHEN regexp_matches(sample, '{_SECRET}') THEN 'secret_in_text' ELSE 'accepted' END"""


def _files(spark, d):
    return V.view(spark, d, V.FILES)


@query("cls1_content_classes", f"WITH {FILES} SELECT doc_id, {CLASS} AS class FROM v")
def cls1(spark, d):
    return _files(spark, d).select("doc_id", A.content_class(F.col("name"), F.col("ext"), F.col("sample")).alias("class"))


_TARGET = "CASE class " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in A.TARGETS.items() if c) + f" ELSE '{A.TARGETS['']}' END"


@query("cls2_target_sections", f"WITH {FILES} SELECT target, count(*) AS n FROM (SELECT unnest(string_split({_TARGET}, ',')) AS target FROM (SELECT {CLASS} AS class FROM v)) GROUP BY target")
def cls2(spark, d):
    return cls1(spark, d).select(F.explode(F.split(A.targets(F.col("class")), ",")).alias("target")).groupBy("target").agg(F.count("*").alias("n"))


@query("flt8_import_gate", f"WITH {FILES} SELECT doc_id, {GATE} AS verdict FROM v")
def flt8(spark, d):
    return _files(spark, d).select("doc_id", A.gate().alias("verdict"))


# The files of the view, written below a folder of their own each: their names aren't unique.
_TOP = "CASE doc_id % 3 WHEN 0 THEN 'inbox/' WHEN 1 THEN 'chat/' ELSE 'scan/.git/' END || CASE WHEN doc_id % 21 = 5 THEN 'node_modules/' ELSE '' END || "
_DIRS = _TOP + "'d' || doc_id"
# The same files in shared folders: the nth file of a name is in the nth folder, and the first ones of all names are dealt over some.
_SHARED = _TOP + "CASE WHEN nth > 1 THEN 'd' || nth ELSE 's' || pmod(hash(name), 64) END"


def _exported(spark, d):
    """The view's files as real files; their folder."""
    return _written(_files(spark, d), _DIRS)


def _written(rows, place):
    folder = f"{checkpoint_folder(rows.sparkSession)}/files-{uuid.uuid4().hex}"
    path = F.concat(F.expr(place), F.lit("/"), "name")
    FO.exported(rows.select(path.alias("path"), F.col("sample").alias("content")), folder).count()
    return folder


def _exported_together(spark, d):
    """The view's files as real files, without a folder for each: a folder costs the store many times what a file does, to make and to delete."""
    rows = _files(spark, d)
    nth = numbered(rows.select("doc_id", "name").distinct(), ["name"], ["doc_id"], "nth")
    return _written(rows.join(nth, ["doc_id", "name"], "left"), _SHARED)


def _kept(rows, folder):
    rows = checkpointed(rows)
    FO.deleted(rows.sparkSession, folder)
    return rows


@query("src2_pruned_scan", f"WITH {FILES} SELECT {_DIRS} || '/' || name AS path, name, ext, strlen(coalesce(sample, ''))::BIGINT AS length FROM v WHERE doc_id % 3 <> 2 AND doc_id % 21 <> 5")
def src2(spark, d):
    """Files are written and scanned again; hidden and generated directories aren't listed."""
    folder = _exported(spark, d)
    return _kept(FO.scanned(spark, folder).select("path", "name", "ext", "length"), folder)


@query("src3_inbox_listing", f"WITH {FILES} SELECT 'f' || doc_id || '-' || name AS name, ext, strlen(coalesce(sample, ''))::BIGINT AS length, 'inbox_imported' AS source FROM v")
def src3(spark, d):
    """All files right in one folder; hidden ones aren't listed."""
    folder = f"{checkpoint_folder(spark)}/inbox-{uuid.uuid4().hex}"
    rows = _files(spark, d)
    shown = rows.select(F.concat(F.lit("f"), "doc_id", F.lit("-"), "name").alias("path"), F.col("sample").alias("content"))
    hidden = rows.select(F.concat(F.lit(".h"), "doc_id").alias("path"), F.col("name").alias("content"))
    FO.exported(shown.union(hidden), folder).count()
    return _kept(FO.inbox(spark, folder, "inbox_imported", f"{folder}/.listed"), folder)


@query("st6_new_files", f"WITH {FILES} SELECT name, CASE WHEN NOT regexp_matches(coalesce(sample, ''), '\\S') THEN 'empty' ELSE 'read' END AS status, strlen(coalesce(sample, ''))::BIGINT AS length, sha256(coalesce(sample, '')) AS sha FROM v WHERE doc_id % 3 <> 2 AND name NOT LIKE '.%'")
def st6(spark, d):
    """New files as a stream, each with what became of it."""
    folder = _exported_together(spark, d)
    rows = FO.new_texts(spark, folder).select("name", "status", "length", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return _kept(stream.drained(rows), folder)


@query("sec2_sensitive_names", f"WITH {FILES} SELECT doc_id, name FROM v WHERE regexp_matches(name, '{A.SENSITIVE_NAME}')")
def sec2(spark, d):
    return _files(spark, d).where(F.col("name").rlike(A.SENSITIVE_NAME)).select("doc_id", "name")


@query("a15_ingest_plan", f"WITH {FILES} SELECT coalesce(source_label, 'all') AS source, count(*) AS total, count(*) FILTER (WHERE processed) AS done, count(*) FILTER (WHERE NOT processed) AS pending FROM v GROUP BY ROLLUP (source_label)")
def a15(spark, d):
    rolled = _files(spark, d).rollup("source_label").agg(F.count("*").alias("total"), F.count_if("processed").alias("done"), F.count_if(~F.col("processed")).alias("pending"))
    return rolled.select(F.coalesce("source_label", F.lit("all")).alias("source"), "total", "done", "pending")


@query("a17_folder_sizes", f"WITH {FILES} SELECT regexp_extract(path, '^(.*)/', 1) AS folder, count(*) AS n, sum(size_bytes)::BIGINT AS bytes, sum(size_bytes) > 52428800 AS large FROM v GROUP BY folder")
def a17(spark, d):
    return _files(spark, d).groupBy(F.regexp_extract("path", "^(.*)/", 1).alias("folder")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"), (F.sum("size_bytes") > 52428800).alias("large"))


@query("a21_import_report", f"WITH {FILES} SELECT {GATE} AS verdict, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM v GROUP BY verdict")
def a21(spark, d):
    return _files(spark, d).groupBy(A.gate().alias("verdict")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


_AGAIN = "(row_number() OVER (PARTITION BY name ORDER BY doc_id) - 1)"


@query("win11_safe_names", f"WITH {FILES} SELECT doc_id, CASE WHEN {_AGAIN} = 0 THEN name ELSE left(name, length(name) - length(ext)) || '_' || {_AGAIN} || ext END AS safe_name FROM v")
def win11(spark, d):
    return A.safe_names(_files(spark, d)).select("doc_id", "safe_name")


@query("snk5_processed_manifest", f"WITH {FILES} SELECT name, round(strlen(coalesce(sample, '')) / 1024.0::DOUBLE, 1) AS size_kb, true AS timed FROM v WHERE doc_id % 3 <> 2 AND doc_id % 21 <> 5 AND doc_id % 4 = 0")
def snk5(spark, d):
    """The manifest of processed files, written as JSON lines and read back; sizes and times are those of the files."""
    folder = _exported(spark, d)
    found = FO.scanned(spark, folder).where(F.regexp_extract("path", "/d([0-9]+)/", 1).cast("long") % 4 == 0)
    A.processed_manifest(found).write.json(f"{folder}/manifest")
    rows = spark.read.schema("name string, size_kb double, processed_at timestamp").json(f"{folder}/manifest")
    return _kept(rows.select("name", "size_kb", F.col("processed_at").isNotNull().alias("timed")), folder)


@query("j23_new_contents", "SELECT doc_id, substr(sha256(text), 1, 12) AS sha12 FROM documents WHERE doc_id % 2 = 1 AND substr(sha256(text), 1, 12) NOT IN (SELECT substr(sha256(text), 1, 12) FROM documents WHERE doc_id % 2 = 0 AND text IS NOT NULL)")
def j23(spark, d):
    marked = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.substring(F.sha2("text", 256), 1, 12).alias("sha12"))
    return marked.where("doc_id % 2 = 1").join(marked.where("doc_id % 2 = 0").select("sha12"), "sha12", "left_anti").select("doc_id", "sha12")


@query("flt11_fatal_candidates", f"WITH {CAND} SELECT page_id, method FROM v WHERE issue IN ('script_placeholder', 'login_required', 'captcha_detected', 'title_missing')")
def flt11(spark, d):
    return V.view(spark, d, V.CANDIDATES).where(F.col("issue").isin(*C.FATAL)).select("page_id", "method")


_CHOICE = """CASE WHEN hc THEN 'http:http_already_complete' WHEN wc AND NOT oc THEN 'network:network_result_complete' WHEN oc AND NOT wc THEN 'dom:rendered_dom_complete'
  WHEN oc AND wc AND w - o >= 8 AND NOT neg THEN 'network:network_score_significantly_higher' WHEN oc AND wc THEN 'dom:prefer_dom_for_rich_structure'
  WHEN w > h AND w > o AND w - greatest(h, o) >= 5 THEN 'network:network_highest_incomplete' WHEN w > h AND w > o THEN 'dom:incomplete_prefer_dom' WHEN o >= h THEN 'dom:incomplete_dom_highest' ELSE 'http:incomplete_http_highest' END"""
_NEG = "((contains(lower(json_path), 'comment') OR contains(lower(json_path), 'user') OR contains(lower(json_path), 'recommend')) AND NOT (contains(lower(json_path), 'article') OR contains(lower(json_path), 'content') OR contains(lower(json_path), 'post')))"


def _of_method(m: str, x: str) -> str:
    return f"any_value({x}) FILTER (WHERE method = '{m}')"


_SIDES = f"SELECT page_id, {_of_method('http', 'quality_score')} AS h, {_of_method('playwright_dom', 'quality_score')} AS o, {_of_method('playwright_network', 'quality_score')} AS w, {_of_method('http', 'quality_complete')} AS hc, {_of_method('playwright_dom', 'quality_complete')} AS oc, {_of_method('playwright_network', 'quality_complete')} AS wc, {_of_method('playwright_network', _NEG)} AS neg FROM v GROUP BY page_id"


@query("win7_three_way_choice", f"WITH {CAND}, s AS ({_SIDES}) SELECT page_id, {_CHOICE} AS choice FROM s")
def win7(spark, d):
    """One variant of each page with the reason; all three methods have a row for each page here."""
    side = lambda m, c: F.max(F.when(F.col("method") == m, c))
    score, done = F.col("quality_score"), F.col("quality_complete")
    s = V.view(spark, d, V.CANDIDATES).groupBy("page_id").agg(
        side("http", score).alias("h"), side("playwright_dom", score).alias("o"), side("playwright_network", score).alias("w"), side("http", done).alias("hc"),
        side("playwright_dom", done).alias("oc"), side("playwright_network", done).alias("wc"), side("playwright_network", C.negative_path(F.col("json_path"))).alias("neg"),
    )
    h, o, w, hc, oc, wc = (F.col(c) for c in ("h", "o", "w", "hc", "oc", "wc"))
    network_first = (w > h) & (w > o)
    choice = (
        F.when(hc, "http:http_already_complete").when(wc & ~oc, "network:network_result_complete").when(oc & ~wc, "dom:rendered_dom_complete")
        .when(oc & wc & (w - o >= 8) & ~F.col("neg"), "network:network_score_significantly_higher").when(oc & wc, "dom:prefer_dom_for_rich_structure")
        .when(network_first & (w - F.greatest(h, o) >= 5), "network:network_highest_incomplete").when(network_first, "dom:incomplete_prefer_dom")
        .when(o >= h, "dom:incomplete_dom_highest").otherwise("http:incomplete_http_highest")
    )
    return s.select("page_id", choice.alias("choice"))


@query("win8_fallback_if_better", f"WITH {CAND}, s AS ({_SIDES}) SELECT page_id, CASE WHEN o > h THEN 'playwright_dom' ELSE 'http' END AS method, greatest(h, o) AS score FROM s")
def win8(spark, d):
    rows = V.view(spark, d, V.CANDIDATES).where("method IN ('http', 'playwright_dom')")
    best = rows.groupBy("page_id").agg(F.max_by(F.struct("method", "quality_score"), F.struct("quality_score", (F.col("method") == "http").cast("int"))).alias("b"))
    return best.select("page_id", "b.method", F.col("b.quality_score").alias("score"))


@query("cls3_page_types", f"WITH {PAGES} SELECT doc_id, CASE WHEN contains(path, '/concepts/') THEN 'concept' WHEN contains(path, '/sources/') THEN 'source' WHEN contains(path, '/projects/') THEN 'project' WHEN contains(path, '/outputs/') THEN 'output' ELSE 'page' END AS kind FROM (SELECT doc_id, 'wiki/' || section || '/' || stem || '.md' AS path FROM v)")
def cls3(spark, d):
    path = F.concat(F.lit("wiki/"), "section", F.lit("/"), "stem", F.lit(".md"))
    kind = F.when(path.contains("/concepts/"), "concept").when(path.contains("/sources/"), "source").when(path.contains("/projects/"), "project").when(path.contains("/outputs/"), "output").otherwise("page")
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", kind.alias("kind"))


@query("txt7_plain_text", f"WITH {PAGES} SELECT doc_id, sha256({_plain_sql('page_text')}) AS sha FROM v")
def txt7(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", F.sha2(Q.plain_text(F.col("page_text")), 256).alias("sha"))


# Marks of pages that didn't load.
WEAK = (
    "enable javascript", "javascript is not available", "this browser is no longer supported", "something went wrong", "please enable cookies", "access denied", "checking your browser",
    "just a moment", "performing security verification", "requiring captcha", "verify you are human", "target url returned error 403", "log in to", "sign up now",
)
_BARE = "regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '\\s', '', 'g')"


@query("txt9_weak_texts", f"SELECT doc_id, {' OR '.join(f'''contains(lower(text), '{m}')''' for m in WEAK)} OR length({_BARE}) < 350 AS weak FROM documents WHERE text IS NOT NULL")
def txt9(spark, d):
    marked = F.greatest(*[F.lower("text").contains(m) for m in WEAK])
    bare = F.regexp_replace(F.regexp_replace("text", "https?://\\S+", ""), "\\s", "")
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", (marked | (F.length(bare) < 350)).alias("weak"))


_SLUG = "trim(regexp_replace(regexp_replace(regexp_replace(p_name || ' ' || p_brand, '[\\s\\-—]+', '-', 'g'), '[^\\w\\-]', '', 'g'), '-{2,}', '-', 'g'), '-')"


@query("txt11_slugs", f"SELECT p_partkey, left(coalesce(nullif(lower({_SLUG}), ''), 'untitled'), 80) AS slug FROM part")
def txt11(spark, d):
    joined = F.regexp_replace(F.concat_ws(" ", "p_name", "p_brand"), "[\\s\\-—]+", "-")
    slug = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "[^\\w\\-]", ""), "-{2,}", "-"), "^-+|-+$", ""))
    return table(spark, d, "part").select("p_partkey", F.substring(F.coalesce(F.nullif(slug, F.lit("")), F.lit("untitled")), 1, 80).alias("slug"))


@query("hl3_stale_references", f"WITH {PAGES} SELECT doc_id, n, line FROM (SELECT doc_id, unnest(string_split(page_text || chr(10) || source_path, chr(10))) AS line, generate_subscripts(string_split(page_text || chr(10) || source_path, chr(10)), 1)::INT AS n FROM v) WHERE contains(line, '_INBOX/') AND NOT contains(line, '→')")
def hl3(spark, d):
    lines = F.posexplode(F.split(F.concat_ws("\n", "page_text", "source_path"), "\n")).alias("n", "line")
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", lines).where("contains(line, '_INBOX/') AND NOT contains(line, '→')").withColumn("n", F.col("n") + 1)


@query("st4_changed_documents", f"WITH {SNAP} SELECT doc_id, length(text) AS n_chars FROM v JOIN documents USING (doc_id) WHERE new_mtime IS NOT NULL AND (old_mtime IS NULL OR old_mtime <> new_mtime)")
def st4(spark, d):
    both = V.view(spark, d, V.SNAPSHOTS)
    changed = both.where("new_mtime IS NOT NULL AND (old_mtime IS NULL OR old_mtime <> new_mtime)").select("doc_id")
    return table(spark, d, "documents").join(changed, "doc_id", "left_semi").select("doc_id", F.length("text").alias("n_chars"))
