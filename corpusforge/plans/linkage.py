"""Bibliographic queries over works and the registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusforge.functions import urls as U
from corpusforge.operators import linkage as L
from corpusforge.operators.corpus import issn_valid
from corpusforge.plans.corpus import ISSN_OK
from corpusforge.plans.registry import query
from corpusforge.sources import views as V

_DOI = "trim(regexp_replace(regexp_replace(trim(doi), '(?i)^https?://(dx\\.)?doi\\.org/', ''), '(?i)^doi:\\s*', ''))"
_NORMAL = f"lower(regexp_extract({_DOI}, '^([^/]*)', 1)) || regexp_extract({_DOI}, '^[^/]*(/.*)$', 1)"
_PERSON = "list_transform(range(1, n_authors + 1), lambda i: {'family': CASE WHEN (author_key + i) % 4 = 0 THEN '王' ELSE 'Fam-' || (author_key + i) % 97 END, 'given': CASE WHEN (author_key + i) % 4 = 0 THEN '小明' WHEN (author_key + i) % 3 = 0 THEN 'Anna maria' ELSE 'Bob' END})"
WORKS = f"w AS (SELECT * REPLACE ({_NORMAL} AS doi), doi AS raw_doi, {_PERSON} AS authors FROM ({V.duck(V.WORKS)}))"
REG = f"r AS ({V.duck(V.REGISTRY)})"


def _key(x: str) -> str:
    return f"lower(trim(regexp_replace(translate(regexp_replace(coalesce({x}, ''), '[《》〈〉]', '', 'g'), '（）：，', '():,'), '\\s+', ' ', 'g')))"


def _ok(x: str) -> str:
    g = f"regexp_replace(upper({x}), '[^0-9X]', '', 'g')"
    c = f"((11 - list_sum(list_transform(range(1, 8), lambda i: (9 - i) * coalesce(try_cast(substr({g}, i, 1) AS INT), 0))) % 11) % 11)"
    return ISSN_OK.replace("g)", f"{g})").replace("(g,", f"({g},").replace("CASE WHEN c = 10", f"CASE WHEN {c} = 10").replace("c::VARCHAR", f"{c}::VARCHAR")


def works(spark, d):
    """The works view with authors as structs and plain identifiers."""
    i = lambda i: F.col("author_key") + i
    person = lambda k: F.struct(
        F.when(i(k) % 4 == 0, "王").otherwise(F.concat(F.lit("Fam-"), i(k) % 97)).alias("family"), F.when(i(k) % 4 == 0, "小明").when(i(k) % 3 == 0, "Anna maria").otherwise("Bob").alias("given")
    )
    rows = V.view(spark, d, V.WORKS).withColumn("raw_doi", F.col("doi"))
    return rows.withColumn("doi", U.normal_doi(F.col("doi"))).withColumn("authors", F.transform(F.sequence(F.lit(1), F.col("n_authors")), person))


def registry(spark, d):
    return V.view(spark, d, V.REGISTRY)


@query("id1_normal_dois", f"WITH {WORKS} SELECT work_id, doi, regexp_matches(doi, '^10\\.\\d{{4,}}/.+') AS like_doi FROM w")
def id1(spark, d):
    return works(spark, d).select("work_id", "doi", F.col("doi").rlike("^10\\.\\d{4,}/.+").alias("like_doi"))


@query("id3_journal_name_keys", f"WITH {REG} SELECT p_partkey, {_key('''concat('《', journal_name, '》 （', category, '）')''')} AS name FROM r")
def id3(spark, d):
    odd = F.concat(F.lit("《"), "journal_name", F.lit("》 （"), "category", F.lit("）"))
    return registry(spark, d).select("p_partkey", L.name_key(odd).alias("name"))


_COLLAPSE = lambda x: "regexp_replace(lower({}), '{}', '', 'g')".format(x, L.PUNCTUATION)
_BI = lambda x: f"list_distinct(list_transform(range(1, length({_COLLAPSE(x)})), lambda i: substr({_COLLAPSE(x)}, i, 2)))"
_DICE = lambda a, b: f"(2.0::DOUBLE * len(list_intersect({_BI(a)}, {_BI(b)})) / (len({_BI(a)}) + len({_BI(b)})))"


@query("id4_name_similarity", f"WITH {REG} SELECT p_partkey, round({_DICE('journal_name', '''concat(level, ' ', category)''')}, 6) AS score FROM r")
def id4(spark, d):
    return registry(spark, d).select("p_partkey", F.round(L.similarity(F.col("journal_name"), F.concat_ws(" ", "level", "category")), 6).alias("score"))


@query("id6_stable_ids", f"WITH {WORKS} SELECT work_id, 'ref-' || substr(sha256(concat_ws('|', title, year::VARCHAR, authors[1].family)), 1, 8) AS stable_id FROM w")
def id6(spark, d):
    first = F.get("authors", F.lit(0))["family"]
    return works(spark, d).select("work_id", F.concat(F.lit("ref-"), F.substring(F.sha2(F.concat_ws("|", "title", F.col("year").cast("string"), first), 256), 1, 8)).alias("stable_id"))


@query("id7_author_names", f"WITH {WORKS} SELECT work_id, array_to_string(list_transform(authors, lambda a: CASE WHEN regexp_matches(a.family || a.given, '{L.CJK}') THEN a.family || a.given ELSE a.given || ' ' || a.family END), '; ') AS names FROM w")
def id7(spark, d):
    return works(spark, d).select("work_id", F.array_join(L.author_names(F.col("authors")), "; ").alias("names"))


@query("id10_author_labels", f"WITH {WORKS} SELECT work_id, array_to_string(list_transform(authors, lambda a: a.family || ', ' || a.given), '; ') AS authors, concat_ws(' ', 'cited_by', cited_by_count) AS label FROM w")
def id10(spark, d):
    listed = F.array_join(F.transform("authors", lambda a: F.concat(a["family"], F.lit(", "), a["given"])), "; ")
    return works(spark, d).select("work_id", listed.alias("authors"), F.concat_ws(" ", F.lit("cited_by"), F.col("cited_by_count").cast("string")).alias("label"))


def _by(columns: str) -> str:
    return f"(SELECT value, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, unnest([{columns}]) AS value FROM r) WHERE value <> '' GROUP BY value)"


#: Names and the registry names that hold their first w characters: by equal pieces where a name has so many.
_HELD = """SELECT name, known, p_partkey FROM {n} JOIN (SELECT known, p_partkey, unnest(list_distinct(list_transform(range(1, greatest(length(known) - {w} + 1, 1) + 1), lambda i: substr(known, i, {w})))) AS piece FROM k) ON piece = left(name, {w}) WHERE length(name) >= {w}
  UNION ALL SELECT name, known, p_partkey FROM {n} JOIN k ON contains(known, name) WHERE length(name) < {w}"""

_MATCH = f"""x AS (SELECT work_id, CASE WHEN {_ok('issn')} THEN issn ELSE '' END AS a, CASE WHEN {_ok('issn_l')} THEN issn_l ELSE '' END AS l, CASE WHEN {_ok('eissn')} THEN eissn ELSE '' END AS e, {_key('journal_name')} AS name FROM w),
  q AS (SELECT *, {_key('journal_name')} AS known FROM r),
  s AS (SELECT work_id, p_partkey, 0 AS place, 'issn' AS method, 1.0 AS confidence FROM x JOIN {_by('issn, issn_l')} ON a = value AND a <> '' UNION ALL SELECT work_id, p_partkey, 1, 'issn_l', 0.98 FROM x JOIN {_by('issn_l')} ON l = value AND l <> ''
    UNION ALL SELECT work_id, p_partkey, 2, 'eissn', 0.97 FROM x JOIN {_by('eissn')} ON e = value AND e <> '' UNION ALL SELECT work_id, k.p_partkey, 3, 'name', 0.92 FROM x JOIN (SELECT known, min(p_partkey) AS p_partkey FROM q GROUP BY known) k ON known = name),
  exact AS MATERIALIZED (SELECT work_id, p_partkey, method, confidence::DOUBLE AS confidence FROM s QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY place, p_partkey) = 1),
  n AS MATERIALIZED (SELECT DISTINCT name FROM x ANTI JOIN exact USING (work_id) WHERE name <> ''), k AS MATERIALIZED (SELECT known, min(p_partkey) AS p_partkey FROM q GROUP BY known),
  c1 AS MATERIALIZED ({_HELD.format(n='n', w=30)}), n2 AS MATERIALIZED (SELECT name FROM n ANTI JOIN c1 USING (name)), c AS MATERIALIZED (SELECT * FROM c1 UNION ALL {_HELD.format(n='n2', w=15)}),
  b AS MATERIALIZED (SELECT name, p_partkey, {_DICE('name', 'known')} AS score FROM c QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, p_partkey) = 1),
  m AS (SELECT * FROM exact UNION ALL SELECT work_id, p_partkey, 'similar', score FROM x JOIN b USING (name) WHERE score >= 0.8 AND NOT EXISTS (SELECT 1 FROM exact e WHERE e.work_id = x.work_id) QUALIFY row_number() OVER (PARTITION BY work_id ORDER BY score DESC, p_partkey) = 1)"""


@query("j8_registry_by_issn", f"WITH {WORKS}, {REG} SELECT work_id, p_partkey FROM w JOIN {_by('issn, issn_l')} ON issn = value")
def j8(spark, d):
    return L.match_by_value(works(spark, d), F.col("issn"), registry(spark, d), ["issn", "issn_l"])


@query("j9_registry_by_eissn", f"WITH {WORKS}, {REG} SELECT work_id, p_partkey, 'eissn' AS kind FROM w JOIN {_by('eissn')} ON eissn = value UNION ALL SELECT work_id, p_partkey, 'issn_l' FROM w JOIN {_by('issn_l')} ON issn_l = value")
def j9(spark, d):
    w, r = works(spark, d), registry(spark, d)
    return L.match_by_value(w, F.col("eissn"), r, ["eissn"]).withColumn("kind", F.lit("eissn")).union(L.match_by_value(w, F.col("issn_l"), r, ["issn_l"]).withColumn("kind", F.lit("issn_l")))


@query("j10_registry_by_name", f"WITH {WORKS}, {REG} SELECT work_id, k.p_partkey FROM w JOIN (SELECT {_key('journal_name')} AS known, min(p_partkey) AS p_partkey FROM r GROUP BY known) k ON known = {_key('journal_name')}")
def j10(spark, d):
    r = registry(spark, d).withColumn("key", L.name_key(F.col("journal_name")))
    return L.match_by_value(works(spark, d), L.name_key(F.col("journal_name")), r, ["key"])


@query("j12_similar_names", f"WITH {WORKS}, {REG}, {_MATCH} SELECT name, p_partkey, round(score, 6) AS score FROM b WHERE score >= 0.8")
def j12(spark, d):
    w, r = works(spark, d), registry(spark, d)
    return L.similar_names(L.unmatched_names(w, L.exact_matches(w, r)), r).select("name", "p_partkey", F.round("score", 6).alias("score"))


@query("j13_match_chain", f"WITH {WORKS}, {REG}, {_MATCH} SELECT work_id, p_partkey, method, round(confidence, 6) AS confidence, method = 'name' OR (method = 'similar' AND confidence < 0.92) AS review FROM m")
def j13(spark, d):
    return L.match_works(works(spark, d), registry(spark, d)).withColumn("confidence", F.round("confidence", 6))


_ALL = "unnest(list_distinct([issn, issn_l, eissn])) AS value"


@query("j14_all_rankings", f"WITH {WORKS}, {REG} SELECT DISTINCT work_id, key, scheme, edition, level FROM (SELECT work_id, {_ALL} FROM w) JOIN (SELECT {_ALL}, concat_ws('|', scheme, edition, issn, {_key('journal_name')}) AS key, scheme, edition, level FROM r) USING (value) WHERE value <> ''")
def j14(spark, d):
    return L.all_rankings(works(spark, d), registry(spark, d))


_MERGED = f"WITH {WORKS} SELECT work_id, coalesce(nullif(a.title, ''), b.title) AS title, coalesce(nullif(a.publisher, ''), b.publisher) AS publisher, coalesce(nullif(a.issue, ''), b.issue) AS issue FROM (SELECT work_id, CASE WHEN n % 7 = 0 THEN '' ELSE title END AS title, publisher, issue FROM w WHERE n % 8 <> 0) a FULL JOIN (SELECT work_id, title, upper(publisher) AS publisher, coalesce(nullif(issue, ''), volume) AS issue FROM w WHERE n % 9 <> 0) b USING (work_id)"


def _sources(spark, d):
    """The two payload tables, as JSON texts."""
    w = works(spark, d)
    shape = lambda title, publisher, issue: F.to_json(F.struct(F.struct(title.alias("title"), publisher.alias("publisher"), issue.alias("issue")).alias("message"))).alias("payload")
    left = w.where("n % 8 <> 0").select("work_id", shape(F.when(F.col("n") % 7 == 0, "").otherwise(F.col("title")), F.col("publisher"), F.col("issue")))
    right = w.where("n % 9 <> 0").select("work_id", shape(F.col("title"), F.upper("publisher"), F.coalesce(F.nullif("issue", F.lit("")), F.col("volume"))))
    return left, right


def _decoded(rows):
    found = F.from_json("payload", "message STRUCT<title: STRING, publisher: STRING, issue: STRING>")["message"].alias("m")
    return rows.select("work_id", found).select("work_id", "m.*")


@query("src7_decoded_payloads", f"WITH {WORKS} SELECT work_id, CASE WHEN n % 7 = 0 THEN '' ELSE title END AS title, publisher, issue FROM w WHERE n % 8 <> 0")
def src7(spark, d):
    return _decoded(_sources(spark, d)[0])


@query("j15_merged_sources", _MERGED)
def j15(spark, d):
    left, right = _sources(spark, d)
    return L.merged(_decoded(left), _decoded(right), "work_id", ["title", "publisher", "issue"])


_FACETS = "year BETWEEN 2000 AND 2015 AND contains(lower(journal_name), 'bolt') AND cited_by_count >= 20 AND NOT needs_review"


@query("flt1_literature_facets", f"WITH {WORKS}, {REG} SELECT work_id, year, title FROM w WHERE {_FACETS} AND EXISTS (SELECT 1 FROM r WHERE lower(scheme) = 'cssci' AND r.issn = w.issn AND r.issn <> '')")
def flt1(spark, d):
    ranked = registry(spark, d).where("lower(scheme) = 'cssci' AND issn <> ''").select("issn")
    return works(spark, d).where(_FACETS).join(ranked, "issn", "left_semi").select("work_id", "year", "title")


@query("flt3_missing_fields", f"WITH {WORKS} SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN issn = '' THEN 'issn' END, CASE WHEN eissn = '' THEN 'eissn' END, CASE WHEN issue = '' THEN 'issue' END], lambda x: x IS NOT NULL)) AS field FROM w) GROUP BY field")
def flt3(spark, d):
    missing = F.array_compact(F.array(*[F.when(F.col(c) == "", c) for c in ("issn", "eissn", "issue")]))
    return works(spark, d).select(F.explode(missing).alias("field")).groupBy("field").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN locked THEN 'locked' WHEN doi = '' THEN 'no_doi' WHEN issn <> '' AND issue <> '' AND year > 0 THEN 'complete' ELSE 'pending' END"


@query("flt5_batch_status", f"WITH {WORKS} SELECT work_id, {_STATUS} AS status FROM w")
def flt5(spark, d):
    status = F.when(F.col("locked"), "locked").when(F.col("doi") == "", "no_doi").when((F.col("issn") != "") & (F.col("issue") != "") & (F.col("year") > 0), "complete").otherwise("pending")
    return works(spark, d).select("work_id", status.alias("status"))


@query("a11_batch_counts", f"WITH {WORKS} SELECT {_STATUS} AS status, count(*) AS n FROM w GROUP BY 1")
def a11(spark, d):
    return flt5(spark, d).groupBy("status").agg(F.count("*").alias("n"))


@query("a13_literature_totals", f"WITH {WORKS} SELECT count(*) AS matches, count(*) FILTER (WHERE needs_review) AS needs_review, count(*) FILTER (WHERE locked) AS locked FROM w WHERE year >= 2000")
def a13(spark, d):
    return works(spark, d).where("year >= 2000").agg(F.count("*").alias("matches"), F.count_if("needs_review").alias("needs_review"), F.count_if("locked").alias("locked"))


@query("sch5_match_outcomes", f"WITH {WORKS}, {REG}, {_MATCH} SELECT coalesce(method, 'none') AS method, count(*) AS n FROM w LEFT JOIN m USING (work_id) GROUP BY 1")
def sch5(spark, d):
    return L.match_outcomes(works(spark, d), registry(spark, d))


@query("sch7_changed_records", f"WITH {WORKS}, s AS ({_MERGED}) SELECT work_id FROM w JOIN s USING (work_id) WHERE sha256(concat_ws('|', w.title, w.publisher, w.issue)) <> sha256(concat_ws('|', s.title, s.publisher, s.issue))")
def sch7(spark, d):
    mark = F.sha2(F.concat_ws("|", "title", "publisher", "issue"), 256)
    old, new = works(spark, d).select("work_id", mark.alias("old")), j15(spark, d).select("work_id", mark.alias("new"))
    return old.join(new, "work_id").where("old <> new").select("work_id")


_INI = lambda mark, sep: f"array_to_string(list_transform(list_filter(string_split_regex(trim(a.given), '\\s+'), lambda z: z <> ''), lambda z: upper(substr(z, 1, 1)) || '{mark}'), '{sep}')"
_ISCJK = f"regexp_matches(a.family || a.given, '{L.CJK}')"
_NUM = f"list_transform(authors, lambda a: CASE WHEN {_ISCJK} THEN a.family || a.given ELSE trim(a.family || ' ' || {_INI('', ' ')}) END)"
_AUTH = f"CASE WHEN len(authors) > 3 THEN array_to_string(({_NUM})[1:3], ', ') || ', ' || CASE WHEN regexp_matches(authors[1].family || authors[1].given, '{L.CJK}') THEN '等' ELSE 'et al' END ELSE array_to_string({_NUM}, ', ') END"
_VI = "volume || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END"
_APA = f"list_transform(authors, lambda a: a.family || ', ' || {_INI('.', ' ')})"
_ART = "CASE WHEN pub_type <> 'article-journal' THEN '[UNSUPPORTED TYPE: ' || pub_type || ']' ELSE {} END"
_LINE = lambda name, x: f"CASE WHEN {x} <> '' THEN '  {name} = {{' || {x} || '}},' END"
_PEOPLE = "array_to_string(list_transform(authors, lambda a: a.family || ', ' || a.given), ' and ')"
_FIELDS = ", ".join(_LINE(n, x) for n, x in (("title", "title"), ("author", _PEOPLE), ("journal", "journal_name"), ("year", "year::VARCHAR"), ("volume", "volume"), ("number", "issue"), ("pages", "page"), ("doi", "doi"), ("publisher", "publisher"), ("issn", "issn_l")))
_BIB = f"concat_ws(chr(10), '@' || CASE WHEN contains(pub_type, 'thesis') THEN 'phdthesis' ELSE 'article' END || '{{' || lower(left(regexp_replace(authors[1].family, '[^a-zA-Z0-9]', '', 'g'), 6)) || CASE WHEN regexp_replace(authors[1].family, '[^a-zA-Z0-9]', '', 'g') = '' THEN 'author' ELSE '' END || year || lower(regexp_extract(title, '([a-zA-Z]+)', 1)) || ',', {_FIELDS}, '}}')"
_TAG = lambda t, x: f"CASE WHEN {x} <> '' THEN '{t}  - ' || {x} END"
_RIS = "concat_ws(chr(10), 'TY  - ' || CASE WHEN pub_type = 'thesis' THEN 'THES' ELSE 'JOUR' END, " + _TAG("TI", "title") + ", array_to_string(list_transform(authors, lambda a: 'AU  - ' || a.given || ' ' || a.family), chr(10)), " + ", ".join(_TAG(t, x) for t, x in (("JO", "journal_name"), ("JF", "journal_name"), ("PY", "year::VARCHAR"), ("VL", "volume"), ("IS", "issue"), ("SP", "string_split(page, '-')[1]"), ("EP", "string_split(page, '-')[2]"), ("DO", "doi"), ("SN", "coalesce(nullif(issn_l, ''), issn)"), ("PB", "publisher"))) + ", 'ER  - ')"
_STYLES = {
    "numeric": _ART.format(f"{_AUTH} || '. ' || title || '[J]. ' || journal_name || ', ' || year || ', ' || {_VI} || ': ' || page || '.'"),
    "author_date": _ART.format(f"{_AUTH} || '. (' || year || '). ' || title || '[J]. ' || journal_name || ', ' || {_VI} || ': ' || page || '.'"),
    "apa": _ART.format(f"CASE WHEN len(authors) = 1 THEN ({_APA})[1] ELSE array_to_string(({_APA})[1:len(authors) - 1], ', ') || ', & ' || ({_APA})[-1] END || ' (' || year || '). ' || title || '. *' || journal_name || '*, *' || volume || '*' || CASE WHEN issue <> '' THEN '(' || issue || ')' ELSE '' END || ', ' || page || '. https://doi.org/' || doi"),
    "bibtex": _BIB, "ris": _RIS,
}
_CITED = " UNION ALL ".join(f"SELECT work_id, '{s}' AS style, {x} AS text FROM w" for s, x in _STYLES.items())


@query("bib1_citations", f"WITH {WORKS} {_CITED}")
def bib1(spark, d):
    return L.citations(works(spark, d))


@query("bib7_cited_texts_by_style", f"WITH {WORKS}, c AS ({_CITED}) SELECT style, count(*) AS n, sum(length(text))::BIGINT AS chars FROM c WHERE NOT starts_with(text, '[UNSUPPORTED') GROUP BY style")
def bib7(spark, d):
    return L.citations(works(spark, d)).where("NOT startswith(text, '[UNSUPPORTED')").groupBy("style").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("src5_registry_checks", f"WITH {REG} SELECT p_partkey, concat_ws(',', CASE WHEN scheme = '' THEN 'no_scheme' END, CASE WHEN issn <> '' AND NOT {_ok('issn')} THEN 'bad_issn' END, CASE WHEN eissn <> '' AND NOT {_ok('eissn')} THEN 'bad_eissn' END) AS problems FROM r")
def src5(spark, d):
    bad = lambda c: F.when((F.col(c) != "") & ~issn_valid(F.col(c)), f"bad_{c}")
    return registry(spark, d).select("p_partkey", F.concat_ws(",", F.when(F.col("scheme") == "", "no_scheme"), bad("issn"), bad("eissn")).alias("problems"))
