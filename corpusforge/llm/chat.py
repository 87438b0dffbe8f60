"""Chat formatting of typed content parts, in DataFrame operations only.

A visitor flattens each turn's parts (text, image, audio, document) into text with ordered
placeholders, and records every attachment's reference and expanded token count. Turns are then
written with a template whose control strings can't occur in the texts: where a text holds one, a
backslash is put after its first character (one more if it has some), which ``unescaped`` undoes. Texts are
escaped after a turn's parts are joined, so parts can't form a control string together. Until then a placeholder
stands between two marks (U+0001 and a letter), which the texts' own marks are told from in the same way.

Defined cases: a null text, role or part list is empty; null turns come first; rows with one turn
number are ordered by role and text, and all are kept; a conversation's rows form one output row;
parts of an unknown type are placeholders of that name (the given table of conversations has texts only, so
each of its rows is one text part, and its attachments are none); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.llm.common import before, with_value

MARK = "\x01"
TURN, END = "<|turn|>", "<|end|>\n"
PART = "struct<type:string,text:string,ref:string,tokens:bigint>"
#: Tokens that one attachment stands for, where its part doesn't say.
EXPANDED = {"image": 256, "audio": 750, "document": 1024}
_CONTROL = "([<\\[])(\\\\*)(\\||/?s>|/?INST\\])"
_ESCAPED = "([<\\[])\\\\(\\\\*)(\\||/?s>|/?INST\\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, "$1\\\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _role_out(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(unescaped(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def text_part(text: Column) -> Column:
    """A plain text as a list of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _kind(part: Column) -> Column:
    return F.regexp_replace(F.coalesce(part["type"], F.lit("text")), "[^A-Za-z0-9_]", "_")


def _placeholder(part: Column, turn: Column, i: Column) -> Column:
    return F.concat(_kind(part), F.lit(":"), turn, F.lit("."), i)


def _visit(part: Column, turn: Column, i: Column) -> Column:
    """What a part becomes in the turn's text, before that is escaped."""
    own = F.replace(F.coalesce(part["text"], F.lit("")), F.lit(MARK), F.lit(MARK + "a"))
    return F.when(_kind(part) == "text", own).otherwise(F.concat(F.lit(MARK + "b"), _placeholder(part, turn, i), F.lit(MARK + "c")))


def _written(joined: Column) -> Column:
    """A turn's text: escaped, with its placeholders."""
    return F.regexp_replace(escaped(joined), f"{MARK}b([^{MARK}]*){MARK}c", "<|$1|>")


def _read(written: Column) -> Column:
    """The text of a turn as it was, with its placeholders."""
    return F.replace(unescaped(written), F.lit(MARK + "a"), F.lit(MARK))


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", parts: Column | None = None, text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, loss_mask (start and length of spans), attachments, expanded_tokens.

    ``parts`` is an array of structs (type, text, ref, tokens); by default ``text_col`` is the only part.
    """
    parts = text_part(F.col(text_col)) if parts is None else F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), parts.alias("parts")).alias("row"))
    # One conversation is one training example, so its turns are one row of the result.
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))

    def piece(row: Column, t: Column) -> Column:
        content = _written(F.array_join(F.transform(row["parts"], lambda p, i: _visit(p, t, i)), ""))
        return F.struct(F.concat(F.lit(TURN), _role_out(row["role"]), F.lit("\n")).alias("head"), content.alias("content"), (row["role"] == loss_role).alias("loss"))

    def attached(row: Column, t: Column) -> Column:
        tokens = F.lit(None).cast("bigint")
        shown = F.transform(
            row["parts"],
            lambda p, i: F.struct(
                t.alias("turn"), i.alias("part"), _kind(p).alias("type"), p["ref"].alias("ref"), F.concat(F.lit("<|"), _placeholder(p, t, i), F.lit("|>")).alias("placeholder"),
                F.coalesce(p["tokens"], *[F.when(_kind(p) == k, F.lit(n).cast("bigint")) for k, n in EXPANDED.items()], tokens, F.lit(1).cast("bigint")).alias("tokens"),
            ),
        )
        return F.filter(shown, lambda a: a["type"] != "text")

    pieces = gathered.select("conv_id", F.transform("rows", piece).alias("pieces"), F.flatten(F.transform("rows", attached)).alias("attachments"))

    def spans(pieces: Column) -> Column:
        starts = before(F.transform(pieces, lambda p: F.length(p["head"]) + F.length(p["content"]) + len(END)), lambda a, n: a + n, F.lit(0))
        all_spans = F.zip_with(pieces, starts, lambda p, at: F.struct(p["loss"], (at + F.length(p["head"])).alias("start"), F.length(p["content"]).alias("length")))
        return F.transform(F.filter(all_spans, lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        with_value(F.col("pieces"), spans).alias("loss_mask"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda acc, a: acc + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """role and text (with placeholders) of each turn, from the formatted text."""
    pieces = F.filter(F.split(formatted, "<\\|end\\|>\n", -1), lambda p: p.startswith(TURN))
    return F.transform(
        pieces,
        lambda p: F.struct(
            _role_in(F.substring_index(F.substring(p, len(TURN) + 1, F.length(p)), "\n", 1)).alias("role"),
            _read(F.substring(p, F.locate("\n", p) + 1, F.length(p))).alias("text"),
        ),
    )


def digest(formatted: DataFrame) -> DataFrame:
    """What the contract asks for, read back from the formatted text and its loss mask."""
    turns = read_turns(F.col("formatted"))
    loss = F.array_join(F.transform("loss_mask", lambda s: _read(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens").select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_attachments",
        "expanded_tokens",
    )
