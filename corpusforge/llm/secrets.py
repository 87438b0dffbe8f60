"""Secret scan with corpus-wide ownership frequency, in DataFrame operations only.

Every text is scanned for three base kinds (assigned values, access keys, hex runs) and for long
mixed tokens. The hash of each candidate's value is counted over the corpus by distinct repository
and owner. A value that many owners hold is a widely copied example; one that few owners hold and
that looks random is reported as a live-looking credential of its own kind, ``live``.

Defined cases: a null text is an empty one; null repositories or owners count as one value of their
own; repeated rows get the same result each and do not change ownership counts; an empty table gives
an empty result; further columns of the input are ignored, whatever their names. Texts are read whole, and
the cost of a text grows with its length and its matches, not with their square.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import before, same, with_value
from corpusforge.session import checkpointed

KINDS = ("assign", "access", "hex", "live")
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_-]{20,}"
DUMMY = "(?i)example|sample|placeholder|changeme|dummy|xxxx|0123456|abcdefg|(.)\\1{5}"

#: Rows that have candidates are broadcast while there are at most so many; beyond that the join shuffles.
BROADCAST_ROWS = 50_000
MATCH = "array<struct<start:int,rank:int,end:int,value:string>>"


def _matches(text: Column, pattern: str, rank: int, value_group: int = 0) -> Column:
    """start, rank, end (code points, end exclusive) and value of each match, in order.

    The pieces between matches and the matches themselves alternate, so their lengths add up to positions.
    """
    between = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = whole if value_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group))
    parts = F.zip_with(whole, F.slice(between, F.lit(1), F.size(whole)), lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size")))

    def placed(parts: Column) -> Column:
        ends = before(F.transform(parts, lambda p: p["gap"] + p["size"]), lambda a, n: a + n, F.lit(0))
        spans = F.zip_with(parts, ends, lambda p, at: F.struct((at + p["gap"]).alias("start"), F.lit(rank).alias("rank"), (at + p["gap"] + p["size"]).alias("end")))
        return F.zip_with(spans, value, lambda s, v: F.struct(s["start"], s["rank"], s["end"], v.alias("value")))

    return F.when(text.rlike(pattern), with_value(parts, placed)).otherwise(F.array().cast(MATCH)).cast(MATCH)


def looks_live(value: Column) -> Column:
    """Random-looking: letters and digits, at least ten different characters, no dummy wording."""
    letters = F.array_distinct(F.split(value, ""))
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(letters) >= 10) & ~value.rlike(DUMMY)


def _within(spans: Column, base: Column, block: int = 256) -> Column:
    """The spans, with rank 4 for those that lie inside one of the base spans (sorted by start).

    A span is held against a block of base spans only where it lies between the block's ends.
    """

    def marked(base: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(base), F.lit(1)), F.lit(block))

        def cut(first: Column) -> Column:
            own = F.slice(base, first, F.lit(block))
            return with_value(own, lambda o: F.struct(F.array_min(F.transform(o, lambda b: b["start"])).alias("low"), F.array_max(F.transform(o, lambda b: b["end"])).alias("high"), o.alias("own")))

        def flagged(blocks: Column) -> Column:
            inside = lambda t, b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])
            held = lambda t: F.exists(blocks, lambda k: (k["low"] <= t["start"]) & (k["high"] >= t["end"]) & F.exists(k["own"], lambda b: inside(t, b)))
            return F.transform(spans, lambda t: F.struct(t["start"], F.when(held(t), 4).otherwise(t["rank"]).alias("rank"), t["end"], t["value"]))

        return with_value(F.transform(firsts, cut), flagged)

    return F.when(F.size(spans) == 0, spans).otherwise(with_value(base, marked)).cast(MATCH)


def scan(documents: DataFrame, text_col: str = "text") -> dict[str, Column]:
    """Expressions of the base matches and the further candidates of each text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    assign = F.filter(_matches(text, ASSIGN, 0, 2), lambda m: F.length(m["value"]) >= 6)
    base = F.sort_array(F.concat(assign, _matches(text, ACCESS, 1), _matches(text, HEX, 2)))
    return {"base": base, "tokens": F.filter(_matches(text, TOKEN, 3), lambda m: looks_live(m["value"]))}


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["rank"]], s["start"], s["end"])), ",")


def scan_secrets(
    documents: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    repo: Column | None = None,
    owner: Column | None = None,
    copied_owners: int = 3,
    copied_repos: int = 5,
    hot_rows: int = 10_000,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``base`` and ``live`` span arrays and how its values are owned.

    ``repo`` and ``owner`` say where a text is from; by default the owner is ``source`` and the
    repository is source and language. A value held by ``copied_owners`` distinct owners or in ``copied_repos`` distinct
    repositories is an example.
    ``keep`` names input columns to return as well (the text, say).
    """
    owner = F.col("source") if owner is None else owner
    repo = F.concat_ws("/", F.col("source"), F.col("lang")) if repo is None else repo
    found = scan(documents, text_col)
    # Rows are known again by id and text hash, so a repeated id with another text keeps its own spans.
    row = [F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_key")]
    scanned = documents.select(*row, owner.cast("string").alias("owner"), repo.cast("string").alias("repo"), found["base"].alias("base"), found["tokens"].alias("tokens"))
    scanned = scanned.withColumn("tokens", _within(F.col("tokens"), F.col("base")))
    some = (F.size("base") > 0) | (F.size("tokens") > 0)
    # With columns to keep, the rows without candidates aren't asked for again.
    scanned = checkpointed(scanned.where(some) if keep else scanned)

    held = scanned.where(some).select("doc_id", "text_key", "owner", "repo", F.explode(F.concat("base", "tokens")).alias("span")).withColumn("hash", F.sha2("span.value", 256))
    # Ownership: aggregations that are combined before their shuffle, so that a value held everywhere stays small.
    by_owner = held.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n")).groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("rows"))
    by_repo = held.groupBy("hash", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("repos"))
    counted = checkpointed(by_owner.join(by_repo, "hash"))
    # A hot value may be in a third of all rows: there its rows are dealt over 16 salts, and its counts repeated for each. There are few
    # such values (each has ``hot_rows`` rows or more).
    salts = F.when(F.col("rows") >= hot_rows, F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).otherwise(F.array(F.lit(-1).cast("long")))
    wide = counted.withColumn("salt", F.explode(salts))
    hot = counted.where(F.col("rows") >= hot_rows).select("hash", F.lit(True).alias("is_hot"))
    hot = F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot
    salt = F.when(F.col("is_hot"), F.pmod(F.xxhash64("doc_id", "text_key", "span.start"), F.lit(16))).otherwise(F.lit(-1).cast("long"))
    # A value in many repositories or with many owners is an example; with one owner and one repository it is that owner's own.
    owned = (
        held.join(hot, "hash", "left").withColumn("salt", salt).drop("is_hot").join(wide, ["hash", "salt"])
        .withColumn("copied", (F.col("owners") >= copied_owners) | (F.col("repos") >= copied_repos))
        .withColumn("added", (F.col("span.rank") == 3) & ~F.col("copied"))
        .groupBy("doc_id", "text_key")
        .agg(
            F.sort_array(F.collect_set(F.when(F.col("added"), F.struct("span.start", "span.rank", "span.end", "span.value")))).alias("live"),
            F.count_distinct(F.when(F.col("copied") & (F.col("span.rank") < 3), F.col("hash"))).alias("n_copied"),
            F.count_distinct(F.when(~F.col("copied") & (F.col("span.rank") < 3), F.col("hash"))).alias("n_owned"),
            F.max("owners").alias("max_owners"),
            F.max("repos").alias("max_repos"),
        )
    )
    extra = [k for k in keep if k != "doc_id"]
    left = scanned.select("doc_id", "text_key", "base")
    if keep:
        # Whole rows meet their spans: a row that has none needn't move if the others are few.
        spans = scanned.groupBy("doc_id", "text_key").agg(F.first("base").alias("base"))
        owned = checkpointed(spans.alias("l").join(owned.alias("r"), same("doc_id", "text_key")).select("l.*", *[f"r.{c}" for c in owned.columns[2:]]))
        owned = F.broadcast(owned) if owned.count() <= BROADCAST_ROWS else owned
        left = documents.select(*row, *[F.col(k) for k in extra])
    base = F.coalesce("r.base", F.array().cast(MATCH)) if keep else F.col("l.base")
    count = lambda c: F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c)
    return left.alias("l").join(owned.alias("r"), same("doc_id", "text_key"), "left").select(
        "l.doc_id", "l.text_key", base.alias("base"), *[F.col(f"l.{n}") for n in extra], F.coalesce("r.live", F.array().cast(MATCH)).alias("live"),
        count("n_copied"), count("n_owned"), count("max_owners"), count("max_repos"),
    )


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per kind, a hash of the base spans, and all spans as text."""
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return scanned.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.sort_array(F.concat("base", "live"))).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        "n_copied",
        "n_owned",
        "max_owners",
        "max_repos",
    )


def redacted(text: Column, spans: Column, mark: str = "[SECRET]", block: int = 256) -> Column:
    """The text with every span (overlaps merged) replaced by ``mark``.

    Taking a part of a text walks to it from its beginning, so parts are taken from the stretch of a block of spans.
    """

    def pieces(spans: Column) -> Column:
        ends = before(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0))
        # What stands before each span and after what was covered until then; none where it overlaps.
        gaps = F.zip_with(spans, ends, lambda s, at: F.struct(at.alias("at"), s["start"].alias("to"), s["end"].alias("end")))
        firsts = F.sequence(F.lit(1), F.size(spans), F.lit(block))
        return with_value(gaps, lambda gaps: F.concat(F.flatten(F.transform(firsts, lambda first: cut(F.slice(gaps, first, F.lit(block))))), F.array(tail(gaps))))

    def cut(some: Column) -> Column:
        start = F.element_at(some, 1)["at"]
        return with_value(
            F.substring(text, start + 1, F.element_at(some, -1)["to"] - start),
            lambda stretch: F.transform(some, lambda g: F.when(g["to"] < g["at"], F.lit("")).otherwise(F.concat(F.substring(stretch, g["at"] - start + 1, g["to"] - g["at"]), F.lit(mark)))),
        )

    def tail(gaps: Column) -> Column:
        last = F.element_at(gaps, -1)
        return F.substring(text, F.greatest(last["at"], last["end"]) + 1, F.length(text))

    return F.when(F.size(spans) == 0, text).otherwise(F.array_join(with_value(F.sort_array(spans), pieces), ""))


def without_secrets(documents: DataFrame, **options) -> DataFrame:
    """All rows and columns, with every secret's span in ``text`` replaced (and ``n_chars`` set anew, where there is one)."""
    found = scan_secrets(documents, keep=tuple(c for c in documents.columns if c != "doc_id"), **options)
    found = found.withColumn("text", redacted(F.col("text"), F.concat("base", "live")))
    return (found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else found).select(*documents.columns)
