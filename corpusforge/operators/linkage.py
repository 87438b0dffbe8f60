"""Bibliographic records: authors, matching to a registry, merging of sources, citations."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusforge.functions.text import character_pairs, dice
from corpusforge.operators.corpus import issn_valid
from corpusforge.session import checkpoint_folder, checkpointed, removed, swept

CJK = "[\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}]"
#: Characters left out before names are compared.
PUNCTUATION = "[\\s\\-_.,;:!?()\\[\\]{}/\\\\|—–（）、。，．：；！？《》〈〉“”‘’【】「」]+"
#: A registry name is a candidate if it contains this many first characters of a record's name, else the second number.
BLOCKS = (30, 15)
#: So many of the rarest character pairs must be shared before two names of a very large block are compared.
SHARED = 5
#: About so many names of a block meet in one group; blocks of more known names than the second number are very large.
PART, LARGE = 1_000, 100_000
#: What a work is matched by, and the methods of equality in their order, each with its confidence.
ASKED = ("issn", "issn_l", "eissn", "journal_name")
EQUAL = (("issn", 1.0), ("issn_l", 0.98), ("eissn", 0.97), ("name", 0.92))


def name_key(name: Column) -> Column:
    """A journal's name without title brackets, with plain punctuation, single blanks and lower case."""
    plain = F.translate(F.regexp_replace(F.coalesce(name, F.lit("")), "[《》〈〉]", ""), "（）：，", "():,")
    return F.lower(F.trim(F.regexp_replace(plain, "\\s+", " ")))


def collapsed(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), PUNCTUATION, "")


def similarity(a: Column, b: Column) -> Column:
    """Dice similarity of two names' character pairs, punctuation left out."""
    return dice(collapsed(a), collapsed(b))


def ranking_key() -> Column:
    return F.concat_ws("|", "scheme", "edition", "issn", name_key(F.col("journal_name")))


def _by(registry: DataFrame, columns: list[str]) -> DataFrame:
    """The first registry row (by key p_partkey) of each value found in any of the columns."""
    rows = registry.select("p_partkey", F.explode(F.array_distinct(F.array(*columns))).alias("value")).where("value <> ''")
    return rows.groupBy("value").agg(F.min("p_partkey").alias("p_partkey"))


def match_by_value(works: DataFrame, value: Column, registry: DataFrame, columns: list[str]) -> DataFrame:
    """(work_id, p_partkey) of works whose value equals one of the registry's columns: an equality join, not a join on OR."""
    asked = works.select("work_id", value.alias("value")).where("value <> ''")
    return asked.join(_by(registry, columns), "value").select("work_id", "p_partkey")


def _with_pairs(rows: DataFrame, name: str) -> DataFrame:
    """Rows with the distinct character pairs of a name, punctuation left out."""
    return rows.withColumn("pairs", character_pairs(collapsed(F.col(name)))).withColumn("n", F.size("pairs"))


def _prefixes(rows: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """(piece, name, n, pair) of the pairs of each name that come first in its block: those that fewest of the block's registry names have.

    Names with Dice 0.8 share two thirds of either one's pairs at least, so they share ``SHARED`` (or all of those two thirds) of each one's first
    ``n - ceil(2n/3) + SHARED`` in any order that both keep.
    """
    each = rows.select("piece", name, "n", F.explode("pairs").alias("pair")).join(counts, ["piece", "pair"], "left").withColumn("held", F.coalesce("held", F.lit(0)))
    order = Window.partitionBy("piece", name).orderBy("held", "pair")
    return each.withColumn("place", F.row_number().over(order)).where(F.expr(f"place <= n - (2 * n + 2) div 3 + {SHARED}")).select("piece", name, "n", "pair")


def similar_pairs(asked: DataFrame, pieces: DataFrame) -> DataFrame:
    """(name, known, p_partkey) of names in one block that may have a Dice similarity of 0.8.

    A set-similarity join: sizes must allow it, and some of each name's rarest pairs must be shared. In a block of names that begin alike the common
    beginning's pairs come last, so names don't meet for it.
    """
    left, right = checkpointed(_with_pairs(asked, "name")), checkpointed(_with_pairs(pieces, "known"))
    counts = checkpointed(right.select("piece", F.explode("pairs").alias("pair")).groupBy("piece", "pair").agg(F.count("*").alias("held")))
    a, b = _prefixes(left, counts, "name").alias("a"), _prefixes(right, counts, "known").alias("b")
    fits = (F.col("a.piece") == F.col("b.piece")) & (F.col("a.pair") == F.col("b.pair")) & (3 * F.least("a.n", "b.n") >= 2 * F.greatest("a.n", "b.n"))
    least = F.least(F.lit(SHARED), F.expr("(2 * least(a.n, b.n) + 2) div 3"))
    met = a.join(b, fits).groupBy("a.name", "b.known", least.alias("least")).agg(F.count_distinct("a.pair").alias("shared")).where("shared >= least")
    # Names without pairs have a similarity of 0 and are never found; the others' keys come back by their name.
    return met.join(pieces.select("known", "p_partkey").distinct(), "known").select("name", "known", "p_partkey")


def _best(scored: DataFrame) -> DataFrame:
    """(name, p_partkey, score) of the best score of each name, of equal ones the smallest key."""
    return scored.groupBy("name").agg(F.max_by(F.struct("p_partkey", "score"), F.struct("score", -F.col("p_partkey"))).alias("b")).select("name", "b.*")


def _dealt(rows: DataFrame, name: str, side: str) -> DataFrame:
    """Rows with a number for each part of their block: a block's names are dealt by a hash into parts of about ``PART`` names."""
    sizes = rows.groupBy("piece").agg(F.ceil(F.count("*") / PART).cast("int").alias(f"{side}_parts"))
    return rows.join(sizes, "piece").withColumn(f"{side}_part", F.pmod(F.hash(name), F.col(f"{side}_parts")))


def most_similar(asked: DataFrame, pieces: DataFrame) -> DataFrame:
    """(name, p_partkey, score) of the most similar known name of each name's block, by Dice similarity, of equal ones the smallest key; none under 0.8.

    Each part of a block's names meets each part of its known ones in a group of bounded size, where one matrix product of
    names by character pairs gives all common pairs; only each name's best of the group leaves it.
    """
    left, right = _dealt(asked.select("piece", "name"), "name", "a"), _dealt(pieces.select("piece", "known", "p_partkey"), "known", "b")
    pairs = lambda name: character_pairs(collapsed(F.col(name))).alias("pairs")
    counts = lambda rows, side: rows.select("piece", f"{side}_parts").distinct()
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(f"{side}_parts") - 1)).alias(f"{side}_part")
    left, right = (
        left.join(counts(right, "b"), "piece").select("piece", "a_part", every("b"), "name", pairs("name")),
        right.join(counts(left, "a"), "piece").select("piece", every("a"), "b_part", "known", "p_partkey", pairs("known")),
    )

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        places: dict[str, int] = {}
        for found in (*a["pairs"], *b["pairs"]):
            for pair in found:
                places.setdefault(pair, len(places))

        def matrix(rows):
            out = np.zeros((len(rows), len(places)), np.float32)
            for i, found in enumerate(rows):
                out[i, [places[p] for p in found]] = 1
            return out

        b = b.sort_values("p_partkey", kind="stable")
        if not len(a) or not len(b) or not places:
            return pd.DataFrame({"name": [], "p_partkey": [], "score": []})
        x, y = matrix(a["pairs"]), matrix(b["pairs"])
        sizes = x.sum(axis=1, dtype=np.float64)[:, None] + y.sum(axis=1, dtype=np.float64)[None, :]
        score = 2.0 * (x @ y.T).astype(np.float64) / np.maximum(sizes, 1.0)
        first = score.argmax(axis=1)  # the first of equals, which has the smallest key
        out = pd.DataFrame({"name": a["name"].to_numpy(), "p_partkey": b["p_partkey"].to_numpy()[first], "score": score[np.arange(len(a)), first]})
        return out[out["score"] >= 0.8]

    keys = ["piece", "a_part", "b_part"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, f"name string, p_partkey {pieces.schema['p_partkey'].dataType.simpleString()}, score double")
    return _best(found)


def similar_names(names: DataFrame, registry: DataFrame) -> DataFrame:
    """(name, p_partkey, score) of the most similar registry row of each name, among those with its first characters.

    Blocks come from an equality join: registry names give their pieces of the lengths asked for (at most 30). Scores under 0.8
    are left out; ties go to the smallest key.
    """
    known = checkpointed(registry.select("p_partkey", name_key(F.col("journal_name")).alias("known")).groupBy("known").agg(F.min("p_partkey").alias("p_partkey")))
    left, found = checkpointed(names.select("name").where("name <> ''").distinct()), None
    for width in BLOCKS:
        asked = left.withColumn("piece", F.substring("name", 1, width))
        lengths = asked.select(F.length("piece").alias("w")).distinct()  # at most `width` rows
        starts = F.sequence(F.lit(1), F.greatest(F.length("known") - F.col("w") + 1, F.lit(1)))
        sized = known.join(F.broadcast(lengths), F.length("known") >= F.col("w"))
        pieces = sized.select("known", "p_partkey", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("known", i, F.col("w"))))).alias("piece"))
        pieces = checkpointed(pieces.join(asked.select("piece").distinct(), "piece", "left_semi"))
        large = checkpointed(pieces.groupBy("piece").count().where(F.col("count") > LARGE).select("piece"))
        part = most_similar(asked, pieces.join(large, "piece", "left_anti"))
        if large.count():
            part = part.union(_best(similar_pairs(asked.join(large, "piece", "left_semi"), pieces).withColumn("score", similarity(F.col("name"), F.col("known"))).where("score >= 0.8")))
        found = part if found is None else found.union(part)
        # Whoever has a block has had its turn, similar names or not.
        left = checkpointed(asked.join(pieces.select("piece").distinct(), "piece", "left_anti").select("name"))
    return found


def exact_matches(works: DataFrame, registry: DataFrame) -> DataFrame:
    """(work_id, p_partkey, method, confidence) by identifier, linking identifier, electronic identifier or equal name, whichever comes first.

    All that a work asks for goes through one join with all that the registry answers, so works are read once.
    """
    ok = lambda c: F.when(issn_valid(F.col(c)), F.col(c)).otherwise("")
    keyed = registry.withColumn("key", name_key(F.col("journal_name")))
    looked_up = ((ok("issn"), ["issn", "issn_l"]), (ok("issn_l"), ["issn_l"]), (ok("eissn"), ["eissn"]), (name_key(F.col("journal_name")), ["key"]))
    steps = [(*method, *by) for method, by in zip(EQUAL, looked_up, strict=True)]
    asks = F.array(*[F.struct(F.lit(i).alias("place"), value.alias("value")) for i, (_, _, value, _) in enumerate(steps)])
    asked = works.select("work_id", F.inline(F.filter(asks, lambda a: a["value"] != "")))
    known = None
    for place, (method, confidence, _, columns) in enumerate(steps):
        rows = _by(keyed, columns).select(F.lit(place).alias("place"), "value", "p_partkey", F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))
        known = rows if known is None else known.union(rows)
    tried = asked.join(known, ["place", "value"])
    return tried.groupBy("work_id").agg(F.min_by(F.struct("p_partkey", "method", "confidence"), F.struct("place", "p_partkey")).alias("m")).select("work_id", "m.*")


def unmatched_names(works: DataFrame, exact: DataFrame) -> DataFrame:
    """(work_id, name) of the works that equality leaves over."""
    return works.join(exact, "work_id", "left_anti").select("work_id", name_key(F.col("journal_name")).alias("name"))


def _hashed(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *ASKED)


def _matched_asks(asked: DataFrame, registry: DataFrame) -> tuple[DataFrame, int]:
    """(ask, place, p_partkey, similar_key, score) of distinct asks by their hash, and a seed by which no two of them have one hash.

    Works ask for few journals each time anew, so the registry is asked once for each distinct set of identifiers and name. A similar name is sought where
    equality finds none, and for works without a ``work_id``, of which nothing tells whether equality found them.
    """
    spark = asked.sparkSession
    folder = f"{checkpoint_folder(spark)}/asks-{uuid.uuid4().hex}"
    asked.groupBy(*ASKED).agg(F.bool_or(F.col("work_id").isNull()).alias("alone")).write.parquet(folder)
    swept(spark)  # the works' joins
    asks, seed = spark.read.parquet(folder), 0
    while not asks.groupBy(_hashed(seed)).count().where("count > 1").isEmpty():
        seed += 1
    asks = asks.withColumn("ask", _hashed(seed))
    place = F.array_position(F.array(*[F.lit(method) for method, _ in EQUAL]), F.col("method")).cast("int")
    exact = checkpointed(exact_matches(asks.withColumnRenamed("ask", "work_id"), registry).select(F.col("work_id").alias("ask"), place.alias("place"), "p_partkey"))
    # An ask that equality answers, and that has works with and without an id, is here for those without.
    rest = asks.join(exact, "ask", "left").where("alone OR place IS NULL").select("ask", name_key(F.col("journal_name")).alias("name"))
    rest = checkpointed(rest)  # used twice
    alike = rest.join(similar_names(rest, registry), "name").select("ask", F.col("p_partkey").alias("similar_key"), "score")
    matches = checkpointed(exact.join(alike, "ask", "full_outer"))
    removed(spark, folder)
    swept(spark)
    return matches, seed


def matched_works(works: DataFrame, registry: DataFrame) -> DataFrame:
    """(work_id, n, match) of each work, with the number of its rows; match is its first row of ``match_works``, or null.

    Works meet their matches by a hash of eight bytes, and are counted where their best match is chosen: they are never exploded, kept or read for a join again.
    Works without a ``work_id`` are one work here, whose match by similarity is in ``other``.
    """
    asked = works.select("work_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ASKED])
    matches, seed = _matched_asks(asked, registry)
    rows = asked.select("work_id", _hashed(seed).alias("ask")).join(matches, "ask", "left")
    equal = F.when(F.col("place").isNotNull(), F.struct("place", "p_partkey"))
    alike = F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("similar_key")).alias("last"), F.col("similar_key").alias("p_partkey")))
    best = rows.groupBy("work_id").agg(F.count("*").alias("n"), F.min(equal).alias("e"), F.max(alike).alias("s"))
    given = lambda c, method, confidence: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.p_partkey"), method.alias("method"), confidence.alias("confidence")))
    of_place = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in EQUAL]), F.col("e.place"))
    equal, alike = given("e", of_place(0), of_place(1)), given("s", F.lit("similar"), F.col("s.score"))
    return best.select("work_id", "n", F.coalesce(equal, alike).alias("match"), F.when(F.col("work_id").isNull() & F.col("e").isNotNull(), alike).alias("other"))


def match_works(works: DataFrame, registry: DataFrame) -> DataFrame:
    """The registry row of each work by the first method that finds one, with its confidence and whether to review it.

    Identifier, linking identifier, electronic identifier, equal name, similar name. Identifiers with a wrong
    check digit are not tried. Only works that equality leaves over go through the similarity join. Rows with one
    ``work_id`` are one work: it takes the best match of any of them, of equal ones the smallest registry key.
    """
    found = matched_works(works, registry).select("work_id", F.inline(F.array_compact(F.array("match", "other"))))
    return found.withColumn("review", (F.col("method") == "name") | ((F.col("method") == "similar") & (F.col("confidence") < 0.92)))


def match_outcomes(works: DataFrame, registry: DataFrame) -> DataFrame:
    """(method, n): the rows of works by the method that ``match_works`` finds their work with, or none; a row without ``work_id`` has none."""
    method = F.when(F.col("work_id").isNotNull(), F.col("match.method"))
    return matched_works(works, registry).groupBy(F.coalesce(method, F.lit("none")).alias("method")).agg(F.sum("n").alias("n"))


def all_rankings(works: DataFrame, registry: DataFrame) -> DataFrame:
    """Every ranking (scheme, edition, level) of the journal a work's identifiers name, once for each key."""
    known = registry.select(F.explode(F.array_distinct(F.array("issn", "issn_l", "eissn"))).alias("value"), ranking_key().alias("key"), "scheme", "edition", "level").where("value <> ''")
    asked = works.select("work_id", F.explode(F.array_distinct(F.array("issn", "issn_l", "eissn"))).alias("value")).where("value <> ''")
    return asked.join(known, "value").select("work_id", "key", "scheme", "edition", "level").distinct()


def merged(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Two sources of records as one: each field from the left source, or from the right where that is empty or null."""
    a = left.select(key, *[F.col(f).alias(f"_l_{f}") for f in fields])
    b = right.select(key, *[F.col(f).alias(f"_r_{f}") for f in fields])
    return a.join(b, key, "full_outer").select(key, *[F.coalesce(F.nullif(F.col(f"_l_{f}"), F.lit("")), F.col(f"_r_{f}")).alias(f) for f in fields])


def initials(given: Column, mark: str, between: str) -> Column:
    words = F.filter(F.split(F.trim(given), "\\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lit(mark))), between)


def is_cjk(a: Column) -> Column:
    return F.concat(a["family"], a["given"]).rlike(CJK)


def author_names(authors: Column) -> Column:
    """Display names: family and given joined for CJK names, else given name first."""
    return F.transform(authors, lambda a: F.when(is_cjk(a), F.concat(a["family"], a["given"])).otherwise(F.trim(F.concat(a["given"], F.lit(" "), a["family"]))))


def numeric_authors(authors: Column) -> Column:
    """Up to three authors, then a mark in the first author's script."""
    shown = F.transform(authors, lambda a: F.when(is_cjk(a), F.concat(a["family"], a["given"])).otherwise(F.trim(F.concat(a["family"], F.lit(" "), initials(a["given"], "", " ")))))
    more = F.when(is_cjk(F.get(authors, F.lit(0))), "等").otherwise("et al")
    return F.when(F.size(authors) > 3, F.concat(F.array_join(F.slice(shown, 1, 3), ", "), F.lit(", "), more)).otherwise(F.array_join(shown, ", "))


def _issue(first: Column) -> Column:
    return F.concat(first, F.when(F.col("issue") != "", F.concat(F.lit("("), F.col("issue"), F.lit(")"))).otherwise(""))


def cite_numeric() -> Column:
    where = F.concat(F.col("year").cast("string"), F.lit(", "), _issue(F.col("volume")), F.lit(": "), F.col("page"))
    return F.concat(numeric_authors(F.col("authors")), F.lit(". "), F.col("title"), F.lit("[J]. "), F.col("journal_name"), F.lit(", "), where, F.lit("."))


def cite_author_date() -> Column:
    head = F.concat(numeric_authors(F.col("authors")), F.lit(". ("), F.col("year").cast("string"), F.lit("). "), F.col("title"), F.lit("[J]"))
    return F.concat(head, F.lit(". "), F.col("journal_name"), F.lit(", "), _issue(F.col("volume")), F.lit(": "), F.col("page"), F.lit("."))


def cite_apa() -> Column:
    names = F.transform("authors", lambda a: F.concat(a["family"], F.lit(", "), initials(a["given"], ".", " ")))
    n = F.size(names)
    listed = F.when(n == 1, F.get(names, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(names, 1, n - 1), ", "), F.lit(", & "), F.element_at(names, -1)))
    parts = (listed, " (", F.col("year").cast("string"), "). ", F.col("title"), ". *", F.col("journal_name"), "*, *", F.col("volume"), "*", F.when(F.col("issue") != "", F.concat(F.lit("("), F.col("issue"), F.lit(")"))).otherwise(""), ", ", F.col("page"), ". https://doi.org/", F.col("doi"))
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def bibtex_key() -> Column:
    family = F.lower(F.substring(F.regexp_replace(F.get("authors", F.lit(0))["family"], "[^a-zA-Z0-9]", ""), 1, 6))
    word = F.lower(F.regexp_extract("title", "([a-zA-Z]+)", 1))
    return F.concat(F.when(family == "", "author").otherwise(family), F.col("year").cast("string"), word)


def bibtex() -> Column:
    """A BibTeX entry; empty fields give no line."""
    kind = F.when(F.col("pub_type").contains("thesis"), "phdthesis").when(F.col("pub_type").contains("book"), "book").otherwise("article")
    people = F.array_join(F.transform("authors", lambda a: F.concat(a["family"], F.lit(", "), a["given"])), " and ")
    fields = (("title", F.col("title")), ("author", people), ("journal", F.col("journal_name")), ("year", F.col("year").cast("string")), ("volume", F.col("volume")), ("number", F.col("issue")), ("pages", F.col("page")), ("doi", F.col("doi")), ("publisher", F.col("publisher")), ("issn", F.col("issn_l")))
    lines = [F.when(value != "", F.concat(F.lit(f"  {name} = {{"), value, F.lit("},"))) for name, value in fields]
    return F.concat_ws("\n", F.concat(F.lit("@"), kind, F.lit("{"), bibtex_key(), F.lit(",")), *lines, F.lit("}"))


def ris() -> Column:
    """A RIS record; empty fields give no line."""
    line = lambda tag, value: F.when(value != "", F.concat(F.lit(f"{tag}  - "), value))
    people = F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a["given"], F.lit(" "), a["family"]))
    number = F.coalesce(F.nullif("issn_l", F.lit("")), F.col("issn"))
    ends = F.split("page", "-")
    return F.concat_ws(
        "\n", F.concat(F.lit("TY  - "), F.when(F.col("pub_type") == "thesis", "THES").otherwise("JOUR")), line("TI", F.col("title")), F.array_join(people, "\n"), line("JO", F.col("journal_name")),
        line("JF", F.col("journal_name")), line("PY", F.col("year").cast("string")), line("VL", F.col("volume")), line("IS", F.col("issue")), line("SP", F.get(ends, F.lit(0))), line("EP", F.get(ends, F.lit(1))),
        line("DO", F.col("doi")), line("SN", number), line("PB", F.col("publisher")), F.lit("ER  - "),
    )


def citations(works: DataFrame) -> DataFrame:
    """(work_id, style, text): every style of every work; the numeric and dated styles take journal articles only."""
    article = F.col("pub_type") == "article-journal"
    refused = F.concat(F.lit("[UNSUPPORTED TYPE: "), F.col("pub_type"), F.lit("]"))
    styles = {
        "numeric": F.when(article, cite_numeric()).otherwise(refused), "author_date": F.when(article, cite_author_date()).otherwise(refused),
        "apa": F.when(article, cite_apa()).otherwise(refused), "bibtex": bibtex(), "ris": ris(),
    }
    every = F.array(*[F.struct(F.lit(s).alias("style"), t.alias("text")) for s, t in styles.items()])
    return works.select("work_id", F.inline(every))


def names_holding(registry: DataFrame, parts: DataFrame, most: int = 10_000) -> DataFrame:
    """(part, p_partkey) of the registry rows whose name holds a part; parts are broadcast, as a join on "contains" has no key.

    More than ``most`` parts are an error: such a set asks for words, not for parts of names.
    """
    asked = parts.count()
    if asked > most:
        raise ValueError(f"{asked} parts of names; at most {most} are compared with every name")
    names = registry.select("p_partkey", name_key(F.col("journal_name")).alias("known"))
    return names.join(F.broadcast(parts), F.col("known").contains(F.col("part"))).select("part", "p_partkey")


def import_outcomes(rows: DataFrame) -> DataFrame:
    """One row for each key of an import with its number of rows, inserted once, or invalid for rows without scheme or name.

    Repeated keys are counted before they meet, so a key in many rows stays small.
    """
    given = (F.coalesce("scheme", F.lit("")) != "") & (F.coalesce("journal_name", F.lit("")) != "")
    kept = rows.where(given).groupBy("scheme", "edition", "issn", "journal_name").agg(F.count("*").alias("n")).select("scheme", F.lit("inserted").alias("outcome"), "n")
    return kept.union(rows.where(~given).agg(F.count("*").alias("n")).select(F.lit(None).cast("string"), F.lit("invalid"), "n"))


def decoded_works(rows: DataFrame) -> DataFrame:
    """Works from (work_id, payload) of a source that gives places of publication, dates and page ends."""
    shape = """title STRING, primary_location STRUCT<source: STRUCT<display_name: STRING, issn_l: STRING, issn: ARRAY<STRING>>>, publication_date STRING, biblio STRUCT<first_page: STRING, last_page: STRING>,
      type STRING, cited_by_count DOUBLE, open_access STRUCT<oa_status: STRING>"""
    w = rows.select("work_id", F.from_json("payload", shape).alias("w")).select("work_id", "w.*")
    first, last = F.nullif("biblio.first_page", F.lit("")), F.nullif("biblio.last_page", F.lit(""))
    return w.select(
        "work_id", "title", F.col("primary_location.source.display_name").alias("journal_name"), F.split("publication_date", "-")[0].try_cast("int").alias("year"),
        F.when(first.isNotNull() & last.isNotNull(), F.concat(first, F.lit("-"), last)).otherwise(first).alias("page"),
        F.when(F.col("type") == "article", "article-journal").otherwise(F.coalesce(F.nullif("type", F.lit("")), F.lit("article-journal"))).alias("pub_type"),
        F.col("cited_by_count").alias("cited_by"), F.nullif("open_access.oa_status", F.lit("")).alias("oa_status"),
    )


def source_metrics(rows: DataFrame, key: str) -> DataFrame:
    """(key, issn, eissn, metric, value): what a source's payload says of it, one row for each given metric."""
    shape = "display_name STRING, issn ARRAY<STRING>, summary_stats STRUCT<`2yr_mean_citedness`: DOUBLE, h_index: DOUBLE>, works_count DOUBLE, is_in_doaj BOOLEAN"
    s = rows.select(key, F.from_json("payload", shape).alias("s")).select(key, "s.*")
    one = lambda name, value: F.struct(F.lit(name).alias("metric"), value.alias("value"))
    metrics = F.array(
        one("2yr_mean_citedness", F.col("summary_stats.2yr_mean_citedness")), one("h_index", F.col("summary_stats.h_index")), one("works_count", F.col("works_count")), one("is_in_doaj", F.when(F.col("is_in_doaj"), 1.0))
    )
    return s.select(key, F.get("issn", F.lit(0)).alias("issn"), F.get("issn", F.lit(1)).alias("eissn"), F.inline(F.filter(metrics, lambda m: m["value"].isNotNull())))


def enriched(works: DataFrame, cached: DataFrame, first: DataFrame, second: DataFrame, ranked: DataFrame) -> DataFrame:
    """Each work with where its record came from: the cache, the first source, the second one, or none."""
    named = lambda df, name: df.dropDuplicates(["work_id"]).select("work_id", F.col("title").alias(f"{name}_title"), F.lit(True).alias(name))
    rows = works
    for name, df in (("cached", cached), ("first", first), ("second", second)):
        rows = rows.join(named(df, name), "work_id", "left")
    status = F.when(~F.col("doi").rlike("^10\\.\\d{4,}/.+"), "invalid_doi").when(F.col("cached"), "cached").when(F.col("first"), "available").when(F.col("second"), "second_only").otherwise("unavailable")
    title = F.coalesce("cached_title", "first_title", "second_title")
    return rows.join(ranked, "issn", "left").select("work_id", "doi", status.alias("status"), title.alias("title"), F.coalesce("ranked", F.lit(False)).alias("ranked"))


def record_outcomes(records: DataFrame) -> DataFrame:
    """Records of CSV files with their outcome: the reason they can't be read, invalid, inserted (the first of a key) or duplicate."""
    bad = F.coalesce(F.col("reason"), F.when((F.col("scheme") == "") | (F.col("journal_name") == ""), "invalid"))
    marked = checkpointed(records.withColumn("bad", bad).withColumn("key", ranking_key()))
    first = marked.where("bad IS NULL").groupBy("key").agg(F.min(F.struct("file", "line")).alias("first"))
    return marked.join(first, "key", "left").withColumn("outcome", F.coalesce("bad", F.when(F.struct("file", "line") == F.col("first"), "inserted").otherwise("duplicate"))).drop("bad", "first", "key")
