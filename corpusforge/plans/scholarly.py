"""Queries over scholarly signals of pages and over works as records."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusforge.operators import corpus as C
from corpusforge.operators import linkage as L
from corpusforge.operators import scholarly as S
from corpusforge.plans.linkage import REG, WORKS, _key, registry, works
from corpusforge.plans.registry import query
from corpusforge.session import checkpoint_folder, checkpointed, removed
from corpusforge.sources import folders as FO
from corpusforge.sources import views as V

_s = lambda x: "'" + x.replace("'", "''") + "'"
_BODY = "regexp_replace(page_text, '(?s)^---\\n.*?\\n---\\n', '')"
_TITLE = "regexp_extract(page_text, '(?m)^# +(.+)$', 1)"
_pick = lambda p: f"nullif(regexp_extract(page_text, {_s(p)}, 1), '')"


def _first_sql(pairs) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + " END"


_HARD = _first_sql([(f"regexp_matches(lower(title), {_s(p)}) OR regexp_matches(body, {_s(p)})", _s(k)) for k, p in S.HARD])
_SOFT_T = _first_sql([*[(f"contains(title, {_s(w)})", _s("title_cn:" + w)) for w in S.SOFT_TITLE_CN], *[(f"contains(lower(title), {_s(w)})", _s("title_en:" + w)) for w in S.SOFT_TITLE_EN]])
_SOFT_B = _first_sql([(f"regexp_matches(body, {_s(p)})", _s("content:" + k)) for k, p in S.SOFT_BODY])
_MARKS = " + ".join([*[f"contains(body, {_s(w)})::INT" for w in S.STRUCTURE_CN], *[f"contains(lower(body), {_s(w)})::INT" for w in S.STRUCTURE_EN]])
_some = lambda *x: f"list_filter([{', '.join(x)}], lambda u: u IS NOT NULL)"
# What a page says of itself, made of its number as the other columns of the view are.
_FLAGS = "doc_id % 29 = 0 AS declared, doc_id % 37 = 0 AS disabled, doc_id % 41 = 0 AS locked, doc_id % 11 = 4 AS has_issn, (doc_id % 4 = 0)::INT + (doc_id % 3 = 0)::INT + (doc_id % 8 = 0)::INT AS given, (doc_id % 9)::INT // 4 AS volume_fields, CASE WHEN doc_id % 15 = 2 THEN 'https://arxiv.org/abs/' ELSE 'https://site.example/' END || doc_id AS source_url"
_FLAGS_SPARK = (
    "doc_id % 29 = 0 AS declared", "doc_id % 37 = 0 AS disabled", "doc_id % 41 = 0 AS locked", "doc_id % 11 = 4 AS has_issn", "CAST(doc_id % 4 = 0 AS INT) + CAST(doc_id % 3 = 0 AS INT) + CAST(doc_id % 8 = 0 AS INT) AS given",
    "CAST((doc_id % 9) div 4 AS INT) AS volume_fields", "concat(CASE WHEN doc_id % 15 = 2 THEN 'https://arxiv.org/abs/' ELSE 'https://site.example/' END, doc_id) AS source_url",
)
_less = lambda c, by, least: f"CASE WHEN len(soft) > 0 THEN greatest({c} - {by}, {least}) ELSE {c} END"
_SAID = _less("CASE WHEN len(strong) > 0 THEN least(95 + (len(strong) - 1) * 3, 100) ELSE 95 END", 10, 85)
_FIRM = _less("least(least(90 + (len(strong) - 1) * 5, 100) + len(medium) * 2, 100)", 15, 70)
_SEVERAL, _ONE = _less("least(60 + len(medium) * 10, 89)", 20, 40), _less("60", 20, 40)
SIGNALS = f"""p AS (SELECT *, {_BODY} AS body, {_TITLE} AS title, {_FLAGS} FROM ({V.duck(V.DOC_PAGES)})),
  i AS (SELECT *, regexp_replace({_pick(S.DOI)}, '\\.+$', '') AS doi, {_pick(S.ARXIV)} AS arxiv_id, {_pick(S.PMID)} AS pmid, {_HARD} AS hard, {_some(_SOFT_T, _SOFT_B)} AS soft, {_MARKS} AS marks, given + (length(title) > 3)::INT AS bib FROM p),
  g AS (SELECT *, {_some("CASE WHEN doi IS NOT NULL THEN 'doi_identified' END", "CASE WHEN arxiv_id IS NOT NULL THEN 'arxiv_id' END", "CASE WHEN pmid IS NOT NULL THEN 'pmid' END", "CASE WHEN declared THEN 'frontmatter_type_literature' END", f"CASE WHEN {' OR '.join(f'contains(lower(source_url), {_s(a)})' for a in S.ACADEMIC)} THEN 'academic_source_url' END")} AS strong,
    {_some("CASE WHEN bib >= 3 THEN 'bibliographic_fields_' || bib END", "CASE WHEN volume_fields >= 1 THEN 'volume_issue_page_' || volume_fields END", "CASE WHEN has_issn THEN 'has_issn' END", "CASE WHEN marks >= 2 THEN 'scholarly_structure_' || least(marks, 5) END")} AS medium FROM i),
  c AS (SELECT *, (CASE WHEN disabled THEN 0 WHEN declared THEN {_SAID} WHEN hard IS NOT NULL THEN 0 WHEN len(strong) > 0 THEN {_FIRM} WHEN len(medium) >= 2 THEN {_SEVERAL} WHEN len(medium) = 1 THEN {_ONE} ELSE 0 END)::INT AS hundredths FROM g),
  s AS (SELECT *, CASE WHEN disabled THEN false WHEN declared THEN true WHEN hard IS NOT NULL THEN false WHEN len(strong) > 0 THEN true WHEN len(medium) >= 2 THEN hundredths >= 70 WHEN len(medium) = 1 THEN hundredths >= 60 ELSE false END AS is_scholarly FROM c),
  e AS (SELECT *, CASE WHEN disabled THEN false WHEN declared THEN true ELSE is_scholarly AND hundredths >= 90 AND len(strong) > 0 END AS enrich FROM s)"""


def pages(spark, d):
    """Pages with their identifiers, signals and verdict."""
    rows = V.view(spark, d, V.DOC_PAGES).selectExpr("*", *_FLAGS_SPARK)
    rows = rows.withColumn("body", F.regexp_replace("page_text", "(?s)^---\n.*?\n---\n", "")).withColumn("title", F.regexp_extract("page_text", "(?m)^# +(.+)$", 1))
    found = S.identifiers(F.col("page_text"))
    rows = rows.withColumns(found)
    own = {k: F.col(k) for k in found}
    bibliographic = F.col("given") + (F.length("title") > 3).cast("int")
    rows = rows.select(
        "*", S.strong_signals(own, F.col("declared"), F.col("source_url")).alias("strong"), S.medium_signals(F.col("body"), bibliographic, F.col("volume_fields"), F.col("has_issn")).alias("medium"),
        S.hard_exclusion(F.col("title"), F.col("body")).alias("hard"), S.soft_exclusions(F.col("title"), F.col("body")).alias("soft"),
    )
    c = lambda *names: [F.col(n) for n in names]
    rows = rows.withColumn("found", S.verdict(*c("strong", "medium", "hard", "soft", "declared", "disabled")))
    return rows.withColumn("enrich", S.auto_enrich(*c("found", "strong", "declared", "disabled"))).select("*", "found.*")


@query("id5_identifiers", f"WITH {SIGNALS} SELECT doc_id, doi, arxiv_id, pmid FROM i")
def id5(spark, d):
    return V.view(spark, d, V.DOC_PAGES).select("doc_id", *[c.alias(n) for n, c in S.identifiers(F.col("page_text")).items()])


@query("sch1_signals", f"WITH {SIGNALS} SELECT doc_id, array_to_string(strong, ',') AS strong, array_to_string(medium, ',') AS medium, hard, array_to_string(soft, ',') AS soft FROM g")
def sch1(spark, d):
    listed = [F.array_join(k, ",").alias(k) for k in ("strong", "medium", "soft")]
    return pages(spark, d).select("doc_id", *listed, "hard")


@query("sch2_verdicts", f"WITH {SIGNALS} SELECT doc_id, is_scholarly, round(hundredths / 100.0::DOUBLE, 2) AS confidence FROM s")
def sch2(spark, d):
    return pages(spark, d).select("doc_id", "is_scholarly", F.round(F.col("hundredths") / 100.0, 2).alias("confidence"))


_KIND = "CASE doc_id % 13 WHEN 1 THEN 'journal-article' WHEN 2 THEN 'conference' WHEN 3 THEN 'phd-thesis' WHEN 4 THEN 'article' WHEN 5 THEN 'monograph' WHEN 6 THEN 'book-chapter' WHEN 7 THEN 'report' ELSE type END"
_TYPE = """CASE WHEN k IN ('journal-article', 'article-journal', 'journal_article') THEN 'article-journal' WHEN k IN ('paper-conference', 'conference', 'proceedings-article') THEN 'paper-conference' WHEN contains(k, 'thesis') OR contains(k, 'dissertation') THEN 'thesis'
  WHEN k IN ('preprint', 'article') THEN 'preprint' WHEN k IN ('book', 'monograph') THEN 'book' WHEN k IN ('chapter', 'book-chapter') THEN 'chapter' WHEN k IN ('report', 'technical-report') THEN 'report' WHEN arxiv_id IS NOT NULL THEN 'preprint'
  WHEN contains(lower(body), 'doctoral dissertation') OR contains(lower(body), 'master''s thesis') OR contains(lower(body), 'ph.d. thesis') THEN 'thesis' WHEN contains(lower(body), 'conference') AND contains(lower(body), 'proceedings') THEN 'paper-conference' ELSE 'article-journal' END"""


@query("sch3_work_types", f"WITH {SIGNALS} SELECT doc_id, {_TYPE} AS work_type FROM (SELECT *, lower({_KIND}) AS k FROM i)")
def sch3(spark, d):
    return pages(spark, d).select("doc_id", S.work_type(F.expr(_KIND), F.col("arxiv_id"), F.col("body")).alias("work_type"))


@query("flt12_auto_enrich", f"WITH {SIGNALS} SELECT doc_id, enrich FROM e")
def flt12(spark, d):
    return pages(spark, d).select("doc_id", "enrich")


_STATUS = "CASE WHEN locked THEN 'locked' WHEN NOT is_scholarly THEN 'not_scholarly' WHEN NOT enrich THEN 'below_threshold' WHEN coalesce(doi, '') = '' THEN 'no_doi' ELSE 'enriched' END"


def _status(rows):
    return rows.withColumn("status", S.page_status(F.col("locked"), F.col("found"), F.col("enrich"), F.col("doi")))


@query("sch8_page_status", f"WITH {SIGNALS} SELECT doc_id, {_STATUS} AS status FROM e")
def sch8(spark, d):
    return _status(pages(spark, d)).select("doc_id", "status")


@query(
    "bib8_summaries",
    f"""WITH {SIGNALS}, t AS (SELECT *, {_STATUS} AS status FROM e)
    SELECT doc_id, concat_ws(chr(10), 'Scholarly metadata:', '- DOI: ' || doi, CASE WHEN status = 'enriched' THEN '- Title: ' || title END, CASE WHEN status = 'locked' THEN '- Locked by user; skipped' END, CASE WHEN status NOT IN ('enriched', 'locked') THEN '- ' || status END) AS summary FROM t WHERE is_scholarly""",
)
def bib8(spark, d):
    """A few lines of text for each page that is a work."""
    rows = _status(pages(spark, d)).where("is_scholarly")
    status = F.col("status")
    lines = F.concat_ws(
        "\n", F.lit("Scholarly metadata:"), F.concat(F.lit("- DOI: "), "doi"), F.when(status == "enriched", F.concat(F.lit("- Title: "), "title")),
        F.when(status == "locked", "- Locked by user; skipped"), F.when(~status.isin("enriched", "locked"), F.concat(F.lit("- "), "status")),
    )
    return rows.select("doc_id", lines.alias("summary"))


@query(
    "sch6_merged_groups",
    f"""WITH {SIGNALS} SELECT doc_id, CASE WHEN enrich THEN true ELSE declared END AS detected, CASE WHEN enrich THEN coalesce(doi, 'old-' || doc_id) WHEN doc_id % 2 = 0 THEN 'old-' || doc_id END AS doi,
    CASE WHEN doc_id % 5 = 0 THEN '2024-01-0' || (1 + doc_id % 9) WHEN enrich AND NOT locked THEN '2024-07-01' END AS enriched_at, locked, active AS tags_kept FROM e""",
)
def sch6(spark, d):
    """The controlled group of each page: new values win, a time stamp and a lock that are there stay, other columns aren't touched."""
    rows = pages(spark, d)
    old_doi, stamped = F.concat(F.lit("old-"), "doc_id"), F.concat(F.lit("2024-01-0"), 1 + F.col("doc_id") % 9)
    old = F.struct(F.col("declared").alias("detected"), F.when(F.col("doc_id") % 2 == 0, old_doi).alias("doi"), F.when(F.col("doc_id") % 5 == 0, stamped).alias("enriched_at"))
    new = F.struct(F.lit(True).alias("detected"), F.coalesce("doi", old_doi).alias("doi"), F.when(~F.col("locked"), "2024-07-01").alias("enriched_at"))
    rows = rows.select("doc_id", "locked", F.col("active").alias("tags_kept"), "enrich", old.alias("old"), new.alias("new"))
    take = lambda f: F.when(F.col("enrich"), F.col(f"new.{f}")).otherwise(F.col(f"old.{f}"))
    return rows.select("doc_id", take("detected").alias("detected"), take("doi").alias("doi"), F.coalesce("old.enriched_at", take("enriched_at")).alias("enriched_at"), "locked", "tags_kept")


# Works as records.


@query("dte1_years", f"WITH {WORKS} SELECT work_id, coalesce(try_cast(CASE WHEN n % 7 = 0 THEN 'n.d.' WHEN n % 3 = 0 THEN year::VARCHAR ELSE '' END AS INT), try_cast(CASE WHEN n % 11 = 0 THEN 'forthcoming' ELSE (year + 1)::VARCHAR END AS INT)) AS year FROM w")
def dte1(spark, d):
    """The year of the controlled group, else the page's own; what isn't a number is none."""
    group = F.when(F.col("n") % 7 == 0, "n.d.").when(F.col("n") % 3 == 0, F.col("year").cast("string")).otherwise("")
    own = F.when(F.col("n") % 11 == 0, "forthcoming").otherwise((F.col("year") + 1).cast("string"))
    return works(spark, d).select("work_id", F.coalesce(group.try_cast("int"), own.try_cast("int")).alias("year"))


@query(
    "flt2_ranking_facet",
    f"""WITH {WORKS}, {REG}, k AS (SELECT DISTINCT work_id, scheme, edition, level FROM w JOIN (SELECT unnest([issn, issn_l]) AS value, scheme, edition, level FROM r) ON issn = value AND value <> '')
    SELECT DISTINCT work_id FROM k WHERE upper(scheme) = 'CSSCI' AND edition = '2023' AND contains(lower(level), 's')""",
)
def flt2(spark, d):
    """Works with a ranking of one scheme and edition whose level holds an s; upper and lower case are alike."""
    ranked = L.all_rankings(works(spark, d).withColumns({"issn_l": F.lit(""), "eissn": F.lit("")}), registry(spark, d).withColumn("eissn", F.lit("")))
    listed = ranked.groupBy("work_id").agg(F.collect_set(F.struct("scheme", "edition", "level")).alias("rankings"))
    return listed.where(F.exists("rankings", lambda r: (F.upper(r["scheme"]) == "CSSCI") & (r["edition"] == "2023") & F.lower(r["level"]).contains("s"))).select("work_id")


@query(
    "flt4_fields",
    f"""WITH {WORKS} SELECT work_id, CASE WHEN n % 4 = 0 THEN coalesce(nullif('', ''), journal_name) ELSE journal_name END AS journal, CASE WHEN n % 5 = 0 THEN raw_doi ELSE doi END AS doi,
    coalesce(try_cast(CASE WHEN n % 6 = 0 THEN 'many' ELSE cited_by_count::VARCHAR END AS INT), 0) AS cited, needs_review, locked AS is_locked FROM w""",
)
def flt4(spark, d):
    """Fields by their nested name, else by the page's own; a count that isn't a number is 0."""
    n = F.col("n")
    group = F.struct(F.when(n % 4 == 0, F.lit("")).otherwise(F.col("journal_name")).alias("journal"), F.when(n % 5 == 0, F.lit(None)).otherwise(F.col("doi")).alias("doi"), F.col("locked").alias("locked"))
    rows = works(spark, d).withColumn("scholarly", group).withColumn("metrics", F.struct(F.when(n % 6 == 0, "many").otherwise(F.col("cited_by_count").cast("string")).alias("cited")))
    return rows.select(
        "work_id", F.coalesce(F.nullif("scholarly.journal", F.lit("")), "journal_name").alias("journal"), F.coalesce("scholarly.doi", "raw_doi").alias("doi"),
        F.coalesce(F.col("metrics.cited").try_cast("int"), F.lit(0)).alias("cited"), "needs_review", F.col("scholarly.locked").alias("is_locked"),
    )


@query("win13_sorted_works", f"WITH {WORKS} SELECT work_id, row_number() OVER (PARTITION BY publisher ORDER BY year DESC NULLS LAST, lower(title), work_id) AS place FROM w")
def win13(spark, d):
    """Each publisher's works, latest year first, then by title."""
    from pyspark.sql import Window

    order = Window.partitionBy("publisher").orderBy(F.desc_nulls_last("year"), F.lower("title"), "work_id")
    return works(spark, d).select("work_id", F.row_number().over(order).alias("place"))


@query(
    "jsn3_citation_json",
    f"""WITH {WORKS} SELECT work_id, doi AS id, pub_type AS type, title, journal_name AS container, nullif(issue, '') AS issue, coalesce(nullif(issn_l, ''), nullif(issn, '')) AS issn, len(authors) AS n_authors, authors[1].family AS first_family, year FROM w""",
)
def jsn3(spark, d):
    """Works in citation JSON, read back from it."""
    rows = works(spark, d)
    names = ("doi", "pub_type", "title", "journal_name", "volume", "issue", "page", "issn_l", "issn", "publisher", "authors", "year")
    made = rows.select("work_id", S.csl_json({n: F.col(n) for n in names}).alias("json"))
    shape = "id STRING, type STRING, title STRING, `container-title` STRING, issue STRING, ISSN STRING, author ARRAY<STRUCT<family: STRING, given: STRING>>, issued STRUCT<`date-parts`: ARRAY<ARRAY<INT>>>"
    back = made.select("work_id", F.from_json("json", shape).alias("j"))
    return back.select(
        "work_id", "j.id", "j.type", "j.title", F.col("j.container-title").alias("container"), "j.issue", F.col("j.ISSN").alias("issn"), F.size("j.author").cast("long").alias("n_authors"),
        F.element_at("j.author", 1)["family"].alias("first_family"), F.col("j.issued.date-parts")[0][0].alias("year"),
    )


@query("j11_registry_by_part_of_name", f"WITH {REG}, q AS (SELECT DISTINCT lower(category) AS part FROM r) SELECT part, p_partkey FROM q JOIN (SELECT p_partkey, {_key('journal_name')} AS known FROM r) ON contains(known, part)")
def j11(spark, d):
    """Registry rows whose name holds a sought text; distinct names are compared only, and the sought texts are few brand names."""
    r = registry(spark, d)
    return L.names_holding(r, r.select(F.lower("category").alias("part")).distinct())


_RAW = "SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE scheme END AS scheme, CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE journal_name END AS journal_name, edition, issn, level FROM r UNION ALL SELECT p_partkey, scheme, journal_name, edition, issn, level FROM r WHERE p_partkey % 3 = 0"
_OUTCOME = f"SELECT *, CASE WHEN coalesce(scheme, '') = '' OR coalesce(journal_name, '') = '' THEN 'invalid' WHEN row_number() OVER (PARTITION BY scheme, edition, issn, journal_name ORDER BY p_partkey) = 1 THEN 'inserted' ELSE 'duplicate' END AS outcome FROM ({_RAW})"


def _imported(spark, d):
    r = registry(spark, d)
    columns = ["p_partkey", "scheme", "journal_name", "edition", "issn", "level"]
    first = r.withColumn("scheme", F.when(F.col("p_partkey") % 17 == 0, "").otherwise(F.col("scheme"))).withColumn("journal_name", F.when(F.col("p_partkey") % 23 == 0, F.lit(None)).otherwise(F.col("journal_name")))
    raw = first.select(*columns).union(r.where("p_partkey % 3 = 0").select(*columns))
    return L.import_outcomes(raw)


@query("src4_registry_import", f"WITH {REG} SELECT scheme, count(*) AS n, count(*) FILTER (WHERE outcome = 'inserted') AS inserted FROM ({_OUTCOME}) WHERE outcome <> 'invalid' GROUP BY scheme")
def src4(spark, d):
    """Rows of an import that are kept, by scheme; of repeated ones the first."""
    kept = _imported(spark, d).where("outcome <> 'invalid'")
    return kept.groupBy("scheme").agg(F.sum("n").alias("n"), F.count_if(F.col("outcome") == "inserted").alias("inserted"))


# CSV files as they come in: a mark at the beginning, headers in other cases and words, odd records.
_CSV_ROWS = """SELECT p_partkey AS n, row_number() OVER (ORDER BY p_partkey) + 1 AS place, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE scheme END AS scheme,
  CASE WHEN p_partkey % 5 = 0 THEN concat('the "new" ', journal_name, ', b') WHEN p_partkey % 3 = 0 THEN 'Same Name' ELSE journal_name END AS journal_name, edition, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE issn END AS issn,
  CASE WHEN p_partkey % 31 = 0 THEN 'quote is not closed' WHEN p_partkey % 37 = 0 THEN 'more fields than headers' END AS broken FROM {}"""


@query(
    "src4_csv_import",
    f"""WITH {REG}, c AS ({_CSV_ROWS.format('r')}), k AS (SELECT *, CASE WHEN broken IS NOT NULL THEN broken WHEN scheme = '' THEN 'invalid' END AS bad FROM c)
    SELECT place AS line, CASE WHEN bad IS NOT NULL THEN bad WHEN row_number() OVER (PARTITION BY bad, scheme, edition, issn, {_key('journal_name')} ORDER BY place) = 1 THEN 'inserted' ELSE 'duplicate' END AS outcome FROM k""",
)
def src4_csv(spark, d):
    """A CSV file written and imported: what became of each record, by its line."""
    r = registry(spark, d)
    r.createOrReplaceTempView("csv_registry")
    rows = spark.sql(_CSV_ROWS.format("csv_registry"))
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat(
        F.when(F.col("broken") == "quote is not closed", F.lit('"')).otherwise(F.lit("")), F.concat_ws(",", F.concat(F.lit(" "), "scheme"), "edition", quoted("journal_name"), F.concat("issn", F.lit(" "))),
        F.when(F.col("broken") == "more fields than headers", F.lit(",x,y")).otherwise(F.lit("")),
    )
    folder = f"{checkpoint_folder(spark)}/csv-{uuid.uuid4().hex}"
    head = spark.createDataFrame([("\ufeffSCHEME,Edition,Journal Name,ISSN", 1)], "value string, place int")
    head.union(rows.select(line.alias("value"), "place")).repartition(1).sortWithinPartitions("place").select("value").write.text(folder)
    found = FO.csv_records(spark, folder, {"scheme": ("scheme",), "edition": ("edition",), "journal_name": ("journal_name", "journal name"), "issn": ("issn",)})
    done = checkpointed(L.record_outcomes(found).select("line", "outcome"))
    removed(spark, folder)
    return done


@query("a10_import_outcomes", f"WITH {REG} SELECT outcome, count(*) AS n FROM ({_OUTCOME}) GROUP BY outcome")
def a10(spark, d):
    rows = _imported(spark, d)
    counted = rows.select(F.explode(F.array(F.struct(F.col("outcome"), F.when(F.col("outcome") == "invalid", F.col("n")).otherwise(F.lit(1)).alias("n")), F.struct(F.lit("duplicate").alias("outcome"), F.when(F.col("outcome") == "invalid", 0).otherwise(F.col("n") - 1).alias("n")))).alias("o"))
    return counted.groupBy("o.outcome").agg(F.sum("o.n").alias("n")).where("n > 0")


_OA = """SELECT work_id, n, title, journal_name, issn_l, issn, year, page, pub_type, cited_by_count, CASE WHEN n % 4 = 0 THEN 'gold' WHEN n % 4 = 1 THEN 'closed' ELSE '' END AS oa FROM w WHERE n % 9 <> 0"""


@query(
    "src8_decoded_works",
    f"""WITH {WORKS} SELECT work_id, title, journal_name, year, CASE WHEN n % 5 = 0 THEN regexp_extract(page, '^[0-9]+', 0) ELSE page END AS page, CASE WHEN pub_type = 'article-journal' THEN 'article-journal' ELSE pub_type END AS pub_type,
    cited_by_count::DOUBLE AS cited_by, nullif(oa, '') AS oa_status FROM ({_OA})""",
)
def src8(spark, d):
    """Works decoded from a second source's JSON: pages from first and last, the year from a date."""
    rows = works(spark, d).where("n % 9 <> 0")
    n, ends = F.col("n"), F.split("page", "-")
    oa = F.when(n % 4 == 0, "gold").when(n % 4 == 1, "closed").otherwise("")
    payload = F.to_json(
        F.struct(
            F.col("title"), F.struct(F.struct(F.col("journal_name").alias("display_name"), "issn_l", F.array("issn").alias("issn")).alias("source")).alias("primary_location"),
            F.when(n % 2 == 0, F.concat("year", F.lit("-03-01"))).otherwise(F.col("year").cast("string")).alias("publication_date"),
            F.struct("volume", "issue", ends[0].alias("first_page"), F.when(n % 5 != 0, ends[1]).alias("last_page")).alias("biblio"),
            F.when(F.col("pub_type") == "article-journal", "article").otherwise(F.col("pub_type")).alias("type"), "cited_by_count", F.struct(oa.alias("oa_status")).alias("open_access"),
        )
    )
    return L.decoded_works(rows.select("work_id", payload.alias("payload")))


@query(
    "src9_source_metrics",
    f"""WITH {REG}, s AS (SELECT p_partkey, journal_name, issn, eissn, (p_partkey % 70) / 10.0::DOUBLE AS two_year, p_partkey % 90 AS h, CASE WHEN p_partkey % 6 <> 0 THEN p_partkey * 3 END AS works, p_partkey % 5 = 0 AS doaj FROM r)
    SELECT p_partkey, issn, eissn, metric, value FROM (
      SELECT p_partkey, issn, eissn, '2yr_mean_citedness' AS metric, two_year AS value FROM s UNION ALL SELECT p_partkey, issn, eissn, 'h_index', h::DOUBLE FROM s
      UNION ALL SELECT p_partkey, issn, eissn, 'works_count', works::DOUBLE FROM s UNION ALL SELECT p_partkey, issn, eissn, 'is_in_doaj', 1.0::DOUBLE FROM s WHERE doaj) WHERE value IS NOT NULL""",
)
def src9(spark, d):
    """A source's identity and its metrics as rows, decoded from JSON; those that aren't given make no row."""
    k = F.col("p_partkey")
    payload = F.to_json(
        F.struct(
            F.col("journal_name").alias("display_name"), F.array("issn", "eissn").alias("issn"), F.struct(((k % 70) / 10.0).alias("2yr_mean_citedness"), (k % 90).alias("h_index")).alias("summary_stats"),
            F.when(k % 6 != 0, k * 3).alias("works_count"), (k % 5 == 0).alias("is_in_doaj"),
        )
    )
    return L.source_metrics(registry(spark, d).select("p_partkey", payload.alias("payload")), "p_partkey")


_CACHED, _FIRST, _SECOND = "n % 10 = 1", "n % 8 <> 0", "n % 9 <> 0"


@query(
    "sch4_enrichment",
    f"""WITH {WORKS}, {REG}, k AS (SELECT DISTINCT value FROM (SELECT unnest([issn, issn_l]) AS value FROM r) WHERE value <> '')
    SELECT work_id, doi, CASE WHEN NOT regexp_matches(doi, '^10\\.\\d{{4,}}/.+') THEN 'invalid_doi' WHEN {_CACHED} THEN 'cached' WHEN {_FIRST} THEN 'available' WHEN {_SECOND} THEN 'second_only' ELSE 'unavailable' END AS status,
      CASE WHEN {_CACHED} OR {_FIRST} THEN title WHEN {_SECOND} THEN upper(title) END AS title, value IS NOT NULL AS ranked
    FROM w LEFT JOIN k ON issn = value""",
)
def sch4(spark, d):
    """Records by identifier: from the cache, else the first source, else the second, with what is known of the journal."""
    rows, r = works(spark, d), registry(spark, d)
    ranked = r.select(F.explode(F.array("issn", "issn_l")).alias("issn")).where("issn <> ''").distinct().withColumn("ranked", F.lit(True))
    source = lambda where, title: rows.where(where).select("work_id", title.alias("title"))
    return L.enriched(rows.select("work_id", "doi", "issn"), source(_CACHED, F.col("title")), source(_FIRST, F.col("title")), source(_SECOND, F.upper("title")), ranked)


@query("ddp6_set_unions", f"WITH {REG} SELECT p_partkey, len(list_distinct(string_split(lower(journal_name), ' '))) AS n_words, len(list_intersect(list_distinct(string_split(lower(journal_name), ' ')), list_distinct(string_split(lower(level), ' ')))) AS shared, len(list_distinct(list_concat(string_split(lower(journal_name), ' '), string_split(lower(level), ' ')))) AS every FROM r")
def ddp6(spark, d):
    a, b = F.array_distinct(F.split(F.lower("journal_name"), " ")), F.array_distinct(F.split(F.lower("level"), " "))
    size = lambda x: F.size(x).cast("long")
    return registry(spark, d).select("p_partkey", size(a).alias("n_words"), size(F.array_intersect(a, b)).alias("shared"), size(F.array_union(a, b)).alias("every"))
