"""Retrieval queries over documents, embeddings and benchmark."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusforge.functions.text import collapsed_sha, dice, occurrences, tokens
from corpusforge.operators import corpus as C
from corpusforge.operators import retrieval as R
from corpusforge.operators import stored_index as X
from corpusforge.plans.registry import query
from corpusforge.session import checkpoint_folder, checkpointed, removed, table
from corpusforge.sources import views as V

WORDS = "list_filter(string_split_regex(regexp_replace(lower({}), '([\\x{{4E00}}-\\x{{9FFF}}])', ' \\1 ', 'g'), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: (length(t) > 1 OR regexp_full_match(t, '[\\x{{4E00}}-\\x{{9FFF}}]')) AND NOT regexp_full_match(t, '\\p{{Nd}}+'))"
DOC_WORDS = WORDS.format("text")
TF = f"tok AS (SELECT doc_id, unnest({DOC_WORDS}) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL)"
LEN = f"len AS (SELECT doc_id, len({DOC_WORDS}) AS len FROM documents)"
BM25 = f"""{TF}, {LEN},
st AS (SELECT count(*) AS n, avg(len) AS avgdl FROM len),
idf AS (SELECT term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), st),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({DOC_WORDS}) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT qid, doc_id, round(sum(qtf * idf * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * (len / greatest(avgdl, 1.0))))), 6) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN len USING (doc_id), st GROUP BY ALL)"""
TOP = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {} QUALIFY rank <= {}"
VEC = """qv AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
ve AS (SELECT qid, vec_id AS doc_id, round(list_dot_product(q, embedding::DOUBLE[]), 9) AS score FROM qv, embeddings WHERE round(list_dot_product(q, embedding::DOUBLE[]), 9) > 0)"""


def _docs(spark, d):
    return table(spark, d, "documents")


#: Folders of the documents' indexes, by application and tables.
_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, d):
    """The stored index of the documents: built when it is first asked for, brought up to date when it is asked for again."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
        index = X.built(_docs(spark, d), folder)
        _INDEXES[key] = folder
        return index
    return X.refreshed(X.opened(spark, _INDEXES[key]), _docs(spark, d))


def _kept(rows, folder):
    """The rows of an index that isn't needed any more."""
    rows = checkpointed(rows)
    removed(rows.sparkSession, folder)
    return rows


def _bm25(spark, d):
    return X.scores(table(spark, d, "benchmark"), _index(spark, d))


def _best(spark, d, k):
    return X.best(table(spark, d, "benchmark"), _index(spark, d), k)


def _vectors(spark, d):
    rows = table(spark, d, "embeddings")
    return R.cosine(rows, rows.where("vec_id % 50 = 0"))


def _nearest(spark, d, k):
    rows = table(spark, d, "embeddings")
    return R.nearest(rows, rows.where("vec_id % 50 = 0"), k)


@query("txt1_tokenize", f"SELECT doc_id, len({DOC_WORDS}) AS n_tokens, sha256(array_to_string({DOC_WORDS}, ' ')) AS tokens_sha FROM documents")
def txt1(spark, d):
    words = tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.sha2(F.array_join(words, " "), 256).alias("tokens_sha"))


@query("a1_postings", f"WITH {TF} SELECT * FROM tf")
def a1(spark, d):
    return R.postings(_docs(spark, d))


@query("a2_idf", f"WITH {TF}, n AS (SELECT count(*) AS n FROM documents) SELECT term, df, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), n")
def a2(spark, d):
    docs = _docs(spark, d)
    return R.term_stats(R.postings(docs), F.lit(docs.count())).withColumn("idf", F.round("idf", 6))


@query("a3_corpus_stats", f"WITH {LEN} SELECT count(*) AS n, sum(len)::BIGINT AS total, round(avg(len), 6) AS avgdl FROM len")
def a3(spark, d):
    return R.corpus_stats(R.doc_stats(_docs(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@query("j1_matched_postings", f"""WITH {TF}, {LEN}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest({DOC_WORDS}) AS term FROM benchmark) GROUP BY ALL)
SELECT qid, doc_id, term, qtf, tf, df, len FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id)""")
def j1(spark, d):
    return X.matched(table(spark, d, "benchmark"), _index(spark, d))


#: A page's tags, if its block is whole, and its body.
_TAGS = "CASE WHEN regexp_matches(page_text, '^---\\n(?s:.*?)\\n---(?:\\n|$)') THEN regexp_replace(regexp_extract(regexp_extract(page_text, '^---\\n((?s:.*?))\\n---(?:\\n|$)', 1), '(?m)^tags: \\[(.*)\\]$', 1), ',', ' ', 'g') ELSE '' END"
_BODY = "regexp_replace(page_text, '^---\\n(?s:.*?)\\n---(?:\\n|$)', '')"


@query(
    "a1_page_postings",
    f"""WITH v AS ({V.duck(V.DOC_PAGES)}), t AS (SELECT doc_id, {_TAGS} || ' ' || {_TAGS} || ' ' || {_BODY} AS text FROM v),
tok AS (SELECT doc_id, unnest({DOC_WORDS}) AS term FROM t), len AS (SELECT doc_id, len({DOC_WORDS}) AS len FROM t)
SELECT doc_id, term, tf, len FROM (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY ALL) JOIN len USING (doc_id)""",
)
def a1_pages(spark, d):
    """The stored index of the pages, in which tags count twice."""
    pages = V.view(spark, d, V.DOC_PAGES)
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index = X.built(pages, folder, X.weighted(C.body(F.col("page_text")), C.tags(F.col("page_text"))))
    return _kept(X.live_postings(spark, index), folder)


@query("st4_refreshed_index", f"WITH {TF} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY term")
def st4_index(spark, d):
    """An index of older documents (some missing, some with other texts, some that are gone since), refreshed with the given ones."""
    docs = _docs(spark, d).select("doc_id", "text")
    older = docs.where("doc_id % 10 <> 3").withColumn("text", F.expr("CASE WHEN doc_id % 10 = 4 THEN concat(text, ' olderwords') ELSE text END"))
    older = older.union(docs.where("doc_id % 10 = 5").selectExpr("-1 - doc_id", "concat(text, ' gonewords')"))
    folder = f"{checkpoint_folder(spark)}/index-{uuid.uuid4().hex}"
    index = X.refreshed(X.built(older, folder), docs)
    return _kept(X.live_postings(spark, index).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), folder)


@query("a4_bm25_scores", f"WITH {BM25} SELECT * FROM bm")
def a4(spark, d):
    return _bm25(spark, d)


@query("win1_bm25_top10", f"WITH {BM25} {TOP.format('bm', 10)}")
def win1(spark, d):
    return _best(spark, d, 10)


@query("j2_vector_scores", f"WITH {VEC} SELECT * FROM ve")
def j2(spark, d):
    return _vectors(spark, d)


@query("win2_vector_top50", f"WITH {VEC} {TOP.format('ve', 50)}")
def win2(spark, d):
    return _nearest(spark, d, R.POOL)


HYBRID = f"""{BM25}, {VEC}, a AS ({TOP.format('bm', 50)}), b AS ({TOP.format('(SELECT qid // 50 AS qid, doc_id, score FROM ve)', 50)}),
fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.doc_id, b.doc_id) AS doc_id,
  round(coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS score, coalesce(a.score, 0) AS bm25, coalesce(b.score, 0) AS vector
  FROM a FULL JOIN b ON a.qid = b.qid AND a.doc_id = b.doc_id)"""


def _hybrid(spark, d):
    # Item i's vector is that of embedding 50 * i.
    vectors = _nearest(spark, d, R.POOL).withColumn("qid", F.expr("qid div 50"))
    return R.fuse(_best(spark, d, R.POOL), vectors)


@query("j3_rrf_fusion", f"WITH {HYBRID} SELECT * FROM fu")
def j3(spark, d):
    return _hybrid(spark, d)


@query("win3_hybrid_top10", f"WITH {HYBRID} {TOP.format('fu', 10)}")
def win3(spark, d):
    return R.top(_hybrid(spark, d), 10)


@query("win5_bm25_when_no_vectors", f"WITH {BM25}, a AS ({TOP.format('bm', 50)}), fu AS (SELECT qid, doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, score AS bm25, 0.0::DOUBLE AS vector FROM a) {TOP.format('fu', 10)}")
def win5(spark, d):
    return R.top(R.fuse(_best(spark, d, R.POOL), R.top(_vectors(spark, d).where("false"), R.POOL)), 10)


PAIRS = "list_distinct(list_transform(list_zip(string_split({0}, '')[:-2], string_split({0}, '')[2:]), lambda p: p[1] || p[2]))"
DICE = f"2.0 * len(list_intersect({PAIRS.format('x')}, {PAIRS.format('y')})) / (len({PAIRS.format('x')}) + len({PAIRS.format('y')}))"


@query(
    "win4_rerank_dice",
    f"""WITH {HYBRID}, o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS old FROM fu),
    p AS (SELECT o.*, coalesce(b.text, '') AS x, coalesce(t.text, '') AS y FROM o LEFT JOIN benchmark b ON b.item_id = qid LEFT JOIN documents t USING (doc_id)),
    r AS (SELECT *, CASE WHEN old <= 20 THEN coalesce(round({DICE}, 6), 0) END AS rerank FROM p)
    SELECT qid, doc_id, score, old, rerank, row_number() OVER (PARTITION BY qid ORDER BY rerank DESC NULLS LAST, old) AS rank FROM r""",
)
def win4(spark, d):
    texts = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("x"))
    docs = _docs(spark, d).select("doc_id", F.col("text").alias("y"))
    hits = checkpointed(_hybrid(spark, d))
    # Only the hits' texts are moved.
    found = hits.select("doc_id").distinct()
    docs = docs.join(F.broadcast(found) if hits.count() <= R.BROADCAST_ROWS else found, "doc_id", "left_semi")
    pairs = hits.join(texts, "qid", "left").join(docs, "doc_id", "left")
    return R.rerank(pairs, F.round(dice(F.coalesce("x", F.lit("")), F.coalesce("y", F.lit(""))), 6)).select("qid", "doc_id", "score", "old", "rerank", "rank")


@query(
    "j22_knowledge_gaps",
    f"WITH {TF}, q AS (SELECT item_id, unnest({DOC_WORDS}) AS term FROM benchmark UNION ALL SELECT -1 - item_id, 'zz' || item_id || 'q' FROM benchmark) SELECT DISTINCT item_id FROM q WHERE item_id NOT IN (SELECT item_id FROM q JOIN tf USING (term))",
)
def j22(spark, d):
    """Questions without a hit: of all items, and of one made-up word for each."""
    items = table(spark, d, "benchmark")
    asked = items.select("item_id", "text").union(items.select(-1 - F.col("item_id"), F.concat(F.lit("zz"), "item_id", F.lit("q"))))
    return R.without_hits(_docs(spark, d), asked)


KW = "(SELECT item_id, unnest(list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> ''))) AS k FROM benchmark)"


@query(
    "a5_keyword_scores",
    f"""WITH q AS {KW}, n AS (SELECT k, doc_id, (length(low) - length(replace(low, k, ''))) // length(k) AS n FROM (SELECT DISTINCT k FROM q), (SELECT doc_id, lower(text) AS low FROM documents)),
    s AS (SELECT item_id AS qid, doc_id, sum(n)::BIGINT AS hits FROM q JOIN (SELECT * FROM n WHERE n > 0) USING (k) GROUP BY ALL)
    SELECT qid, doc_id, hits, round(hits / max(hits) OVER (PARTITION BY qid), 2) AS relevance FROM s""",
)
def a5(spark, d):
    """How often each item's words occur in each document, as parts of words too; all items and all their words."""
    return R.keyword_scores(_docs(spark, d), table(spark, d, "benchmark"))


@query(
    "flt6_hits_by_type",
    f"WITH {BM25}, t AS ({TOP.format('bm', 50)}) SELECT qid, t.doc_id, t.score, rank FROM t JOIN documents USING (doc_id) WHERE lang = 'en' AND t.score >= 5 AND rank <= 50",
)
def flt6(spark, d):
    pool = _best(spark, d, R.POOL).where("score >= 5")
    return pool.join(_docs(spark, d).where("lang = 'en'").select("doc_id"), "doc_id").select("qid", "doc_id", "score", "rank")


@query(
    "snk7_search_export",
    f"""WITH {BM25}, t AS ({TOP.format('bm', 5)}) SELECT qid, count(*) AS n, string_agg(doc_id || ':' || floor(score * 10000 + 0.5)::BIGINT, ',' ORDER BY rank) AS hits FROM t GROUP BY qid""",
)
def snk7(spark, d):
    hits = _best(spark, d, 5).withColumn("h", F.struct("rank", F.concat_ws(":", "doc_id", F.floor(F.col("score") * 10000 + 0.5)).alias("t")))
    return hits.groupBy("qid").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("h")), lambda h: h["t"]), ",").alias("hits"))


@query("txt6_keyword_snippet", "SELECT doc_id, trim(replace(substr(text, greatest(strpos(lower(text), 'the') - 50, 1), 200), chr(10), ' ')) AS snippet FROM documents WHERE strpos(lower(text), 'the') > 0")
def txt6(spark, d):
    at = F.locate("the", F.lower("text"))
    return _docs(spark, d).where(at > 0).select("doc_id", F.trim(F.replace(F.substring(F.col("text"), F.greatest(at - 50, F.lit(1)), F.lit(200)), F.lit("\n"), F.lit(" "))).alias("snippet"))


COLLAPSED = "sha256(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g')))"


@query("txt12_content_identity", f"SELECT doc_id, {COLLAPSED} AS sha FROM documents")
def txt12(spark, d):
    return _docs(spark, d).select("doc_id", collapsed_sha(F.col("text")).alias("sha"))


@query("ddp3_content_dedup", f"SELECT doc_id, sha, n = 1 AS kept, first_id FROM (SELECT doc_id, {COLLAPSED} AS sha, row_number() OVER (PARTITION BY {COLLAPSED} ORDER BY doc_id) AS n, min(doc_id) OVER (PARTITION BY {COLLAPSED}) AS first_id FROM documents)")
def ddp3(spark, d):
    # Minima are combined before the shuffle, so a hot content doesn't gather its rows in one window.
    rows = _docs(spark, d).select("doc_id", collapsed_sha(F.col("text")).alias("sha"))
    first = rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"))
    return rows.join(first, "sha").select("doc_id", "sha", (F.col("doc_id") == F.col("first_id")).alias("kept"), "first_id")


@query("id9_content_name", "SELECT doc_id, 'doc-' || doc_id || '-' || left(sha256(text), 12) || '.md' AS name FROM documents")
def id9(spark, d):
    return _docs(spark, d).select("doc_id", F.concat(F.lit("doc-"), "doc_id", F.lit("-"), F.substring(F.sha2("text", 256), 1, 12), F.lit(".md")).alias("name"))


@query(
    "txt17_capture_composition",
    "SELECT conv_id, count(*) AS n, sha256(string_agg('## ' || (turn + 1) || '. ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS body_sha FROM conversations GROUP BY conv_id",
)
def txt17(spark, d):
    piece = F.struct("turn", F.concat(F.lit("## "), (F.col("turn") + 1).cast("string"), F.lit(". "), "role", F.lit("\n"), "text").alias("t"))
    ordered = F.sort_array(F.collect_list(piece))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(ordered, lambda p: p["t"]), "\n\n"), 256).alias("body_sha"))
