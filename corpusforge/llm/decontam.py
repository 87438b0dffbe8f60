"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. Postings: each document is split into words; (document, position) is stored for the index terms.
   For every 13-word window of a test item these are the words that are rarest among the items.
2. Anchors: with the terms' counts in the corpus, each window takes its two rarest stored terms.
3. Intersection: a posting at position p of a term at offset o of an item means alignment p - o. The
   offset-adjusted lists are intersected by grouping on (document, item, alignment): an alignment
   stays if one window has all of its anchors there.
4. Phrases: alignments are checked word by word against the whole text. Runs of 13 equal words (of the
   whole item if it is shorter) are exact matches.

``proximity_matches`` uses the same postings for windows whose anchors lie close, in any order.

Defined cases: a null or empty text has no words, as an item or as a document; items without an id are
ignored; several rows with one item id count as one item; repeated documents get the same result each;
empty tables give no hits. Other columns of the inputs are ignored or returned as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.llm.common import ascii_lower, same
from corpusforge.session import checkpointed

#: Everything of ASCII but digits and letters separates words; a lower-cased text has no A-Z.
SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The test items' side is broadcast while it has at most so many rows; beyond that joins shuffle.
BROADCAST_ROWS = 200_000
#: Whole documents with hits are told by so many broadcast keys at most; beyond that the join shuffles.
BROADCAST_HITS = 200_000
SALTS = 16


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, item_id, words, m) of items with words; m is the length of their windows."""
    words = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    return words.where(F.size("words") > 0).distinct().select(F.xxhash64("item_id", "words").alias("item"), "item_id", "words", F.least(F.lit(window), F.size("words")).alias("m"))


def _windows(items: DataFrame) -> DataFrame:
    """(item, window, offset, term): every word position of every window."""
    starts = items.select("item", "words", "m", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("m"))).alias("window"))
    return starts.select("item", "window", F.posexplode(F.slice("words", F.col("window") + 1, F.col("m"))).alias("i", "term")).select(
        "item", "window", (F.col("window") + F.col("i")).alias("offset"), "term"
    )


def postings(documents: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The stored index: (doc_id, text_key, pos, term) of the given terms, over whole texts."""
    rows = documents.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), words_of(F.col("text")).alias("words"))
    each = rows.select("doc_id", "text_key", F.posexplode("words").alias("pos", "word"))
    wanted = terms.select(F.col("term").alias("word"), "term_id")
    if n_terms <= BROADCAST_ROWS:
        return each.join(F.broadcast(wanted), "word").select("doc_id", "text_key", "pos", "term_id")
    # Words differ much in how common they are: each word's rows are dealt over some salts, and the terms repeated for each.
    salted = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "pos"), F.lit(SALTS))).join(salted, ["word", "salt"]).select("doc_id", "text_key", "pos", "term_id")


def _index(documents: DataFrame, items: DataFrame, stored: int) -> tuple[DataFrame, DataFrame]:
    """The stored postings, and the windows' stored terms with their corpus counts."""
    in_items = items.select("item", F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("item", "window").orderBy("held", F.length("term").desc(), "term", "offset")
    picked = checkpointed(
        _windows(items).join(in_items, "term").withColumn("k", F.row_number().over(rarest)).where(F.col("k") <= stored).withColumn("term_id", F.xxhash64("term")).drop("k", "held")
    )
    terms = picked.select("term", "term_id").distinct()
    index = checkpointed(postings(documents, terms, picked.count()))
    counts = index.groupBy("term_id").agg(F.count("*").alias("df"))
    return index, picked.join(counts, "term_id")


def _anchored(documents: DataFrame, benchmark: DataFrame, window: int, anchors: int, stored: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Items, postings, and (item, window, offset, term_id, need): each window's rarest stored terms.

    A window with a stored term that no document has can't occur and gets no anchors.
    """
    items = checkpointed(items_of(benchmark, window))
    index, picked = _index(documents, items, stored)
    have = Window.partitionBy("item", "window")
    order = have.orderBy("df", "offset")
    wanted = items.select("item", F.least(F.lit(stored), F.col("m")).alias("stored"))
    anchored = (
        picked.withColumn("present", F.count("*").over(have)).join(wanted, "item").where("present = stored")
        .withColumn("k", F.row_number().over(order)).where(F.col("k") <= anchors)
        .withColumn("need", F.count("*").over(have)).select("item", "window", "offset", "term_id", "need")
    )
    return items, index, checkpointed(anchored)


def _alignments(index: DataFrame, anchored: DataFrame) -> DataFrame:
    """(doc_id, text_key, item, shift) at which some window has all of its anchors."""
    at = anchored.select("item", "offset", "term_id").distinct()
    needs = anchored.groupBy("item", "window").agg(F.collect_set("offset").alias("offsets")).groupBy("item").agg(F.collect_set("offsets").alias("windows"))
    rows = anchored.count()
    met = (
        index.join(_small(at, rows), "term_id")
        .groupBy("doc_id", "text_key", "item", (F.col("pos") - F.col("offset")).alias("shift"))
        .agg(F.collect_set("offset").alias("seen"))
    )
    return met.join(_small(needs, rows), "item").where(F.exists("windows", lambda w: F.size(F.array_except(w, F.col("seen"))) == 0)).select("doc_id", "text_key", "item", "shift")


def _runs(equal: Column, m: Column) -> Column:
    """Flags as text of 1 and 0; runs of ones shorter than m become zeros."""
    flags = F.array_join(F.transform(equal, lambda e: F.when(e, F.lit("1")).otherwise(F.lit("0"))), "")
    parts = F.regexp_extract_all(flags, F.lit("0+|1+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda r: F.when(r.startswith("1") & (F.length(r) >= m), r).otherwise(F.repeat(F.lit("0"), F.length(r)))), "")


def _hits(documents: DataFrame, benchmark: DataFrame, window: int, anchors: int, stored: int) -> DataFrame:
    """(doc_id, text_key, n_words, hits, items) of the documents in which a window occurs; only these texts move."""
    items, index, anchored = _anchored(documents, benchmark, window, anchors, stored)
    # An item's words are held once for each document that meets it, however often it does.
    by_item = _alignments(index, anchored).groupBy("doc_id", "text_key", "item").agg(F.collect_list("shift").alias("shifts"))
    by_doc = by_item.join(_small(items, items.count()), "item").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("item_id", "shifts", "words", "m")).alias("found"))
    by_doc = checkpointed(by_doc)
    some = F.broadcast(by_doc) if by_doc.count() <= BROADCAST_HITS // 10 else by_doc
    rows = documents.select("doc_id", _text_key(), F.col("text").alias("whole"))
    both = rows.alias("l").join(some.alias("r"), same("doc_id", "text_key")).select("l.doc_id", "l.text_key", "r.found", words_of(F.col("whole")).alias("doc_words"))

    def check(f: Column) -> Column:
        places = F.flatten(F.transform(f["shifts"], lambda shift: _places(F.col("doc_words"), f["words"], shift, f["m"])))
        return F.struct(f["item_id"].alias("item_id"), places.alias("places"))

    checked = both.select("doc_id", "text_key", F.size("doc_words").cast("long").alias("n_words"), F.filter(F.transform("found", check), lambda f: F.size(f["places"]) > 0).alias("checked"))
    return checked.where(F.size("checked") > 0).dropDuplicates(["doc_id", "text_key"]).select(
        "doc_id", "text_key", "n_words",
        F.array_distinct(F.flatten(F.transform("checked", lambda f: f["places"]))).alias("hits"),
        F.sort_array(F.array_distinct(F.transform("checked", lambda f: f["item_id"]))).alias("items"),
    )


def _places(doc_words: Column, words: Column, shift: Column, m: Column) -> Column:
    """The positions in a document that lie in runs of m words or more which equal an item's words at this alignment."""
    first = F.greatest(F.lit(0), -shift)
    here = F.slice(doc_words, shift + first + 1, F.size(words) - first)
    there = F.slice(words, first + 1, F.size(words))
    marks = _runs(F.zip_with(here, there, lambda a, b: F.coalesce(a == b, F.lit(False))), m)
    return F.array_compact(F.transform(F.split(marks, ""), lambda c, i: F.when(c == "1", shift + first + i)))


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key")


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = 13, anchors: int = 2, stored: int = 3) -> DataFrame:
    """One row per document: n_words, hits (positions of hit words) and items (ids with occurring windows).

    Documents without hits only give their number of words; their texts aren't shuffled.
    """
    found = checkpointed(_hits(documents, benchmark, window, anchors, stored))
    found = F.broadcast(found) if found.count() <= BROADCAST_HITS // 10 else found
    rows = documents.select("doc_id", _text_key(), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    return rows.alias("l").join(found.alias("r"), same("doc_id", "text_key"), "left").select(
        "l.doc_id", "l.n_words", F.coalesce("r.hits", F.array().cast("array<int>")).alias("hits"), F.coalesce("r.items", F.array().cast("array<string>")).alias("items")
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 13, anchors: int = 2, stored: int = 3) -> DataFrame:
    """The rows that aren't contaminated, with all their columns."""
    found = _hits(documents, benchmark, window, anchors, stored)
    bad = checkpointed(found.where(contaminated()).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")))
    bad = F.broadcast(bad) if bad.count() <= BROADCAST_HITS else bad
    return documents.join(bad, F.col("doc_id").eqNullSafe(F.col("bad_id")) & (_text_key() == F.col("bad_key")), "left_anti")


def contaminated() -> Column:
    """A twentieth of the words or more is hit."""
    return (F.size("hits") > 0) & (20 * F.size("hits") >= F.col("n_words"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
    )


def proximity_matches(documents: DataFrame, benchmark: DataFrame, window: int = 13, reach: int = 26, anchors: int = 3) -> DataFrame:
    """(doc_id, item_id, start, end): stretches of at most ``reach`` words that hold all anchors of a window, in any order.

    A term that is an anchor twice must be there twice. Of stretches within each other the shortest are given.
    Postings are filed by half-overlapping stretches of the document, so that terms that lie close
    meet in one file; no pairs of postings are made. In each file, of 2 * ``reach`` words at most, a stretch ends at
    each posting and begins where the last ones of all anchors up to there begin.
    """
    items, index, anchored = _anchored(documents, benchmark, window, anchors, anchors)
    # Windows of an item with the same anchors have the same matches.
    by_window = anchored.groupBy("item", "window").agg(F.sort_array(F.collect_list("term_id")).alias("terms"))
    sought = checkpointed(by_window.select("item", "terms").distinct().withColumn("sought", F.xxhash64("item", "terms")))
    kinds = F.array_distinct("terms")
    wanted = sought.select("item", "sought", F.transform(kinds, lambda t: F.struct(t.alias("term_id"), F.size(F.filter("terms", lambda x: x == t)).alias("times"))).alias("wanted"))
    at = sought.select("sought", F.posexplode(kinds).alias("k", "term_id")).withColumn("bit", F.expr("shiftleft(1, k)")).drop("k")
    rows = sought.count()
    block = F.floor(F.col("pos") / reach)
    filed = index.join(_small(at, rows * anchors), "term_id").withColumn("file", F.explode(F.array(block, block - 1)))
    # Repeated documents have the same postings.
    met = filed.groupBy("doc_id", "text_key", "sought", "file").agg(F.bit_or("bit").alias("bits"), F.collect_set(F.struct("pos", "term_id")).alias("held"))
    full = met.join(_small(wanted, rows), "sought").where(F.bit_count("bits") == F.size("wanted")).withColumn("held", F.sort_array("held"))

    def begins(end: Column) -> Column:
        def last(w: Column) -> Column:
            return F.try_element_at(F.filter("held", lambda h: (h["term_id"] == w["term_id"]) & (h["pos"] <= end)), -w["times"])["pos"]

        firsts = F.transform("wanted", last)
        return F.when(F.forall(firsts, lambda p: p.isNotNull()), F.array_min(firsts))

    ends = full.select("doc_id", "text_key", "item", "sought", F.explode(F.transform("held", lambda h: F.struct(begins(h["pos"]).alias("start"), h["pos"].alias("last")))).alias("s"))
    shortest = ends.where(F.col("s.last") - F.col("s.start") < reach).groupBy("doc_id", "text_key", "item", "sought", F.col("s.start").alias("start")).agg(F.min("s.last").alias("last"))
    return shortest.join(items.select("item", "item_id"), "item").select("doc_id", "item_id", "start", (F.col("last") + 1).alias("end")).distinct()
