"""Chat formatting, with DataFrame functions only: fold an event log into messages, render them, read them back.

Template: a turn is ``### role:``, a line break, the text and ``</turn>`` with a line break.  Inside roles and texts
the characters that control strings are made of are escaped, so that no control string can occur there: a backslash
becomes ``\\b``, ``#`` ``\\h``, ``<`` ``\\l``; in roles also ``:`` ``\\c`` and the line break ``\\n``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, AFTER_ROLE, END = "### ", ":\n", "</turn>\n"
_TEXT = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
_ROLE = (*_TEXT, (":", "\\c"), ("\n", "\\n"))
RESETS = ("message", "edit", "regenerate")


def _escape(x: Column, rules: tuple[tuple[str, str], ...] = _TEXT) -> Column:
    for plain, code in rules:
        x = F.replace(x, F.lit(plain), F.lit(code))
    return x


def _unescape(x: Column, rules: tuple[tuple[str, str], ...] = _TEXT) -> Column:
    for plain, code in reversed(rules):
        x = F.replace(x, F.lit(code), F.lit(plain))
    return x


def fold(events: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Messages (conv_id, place, role, text) of a log with conv_id, turn, seq, event, role and text.

    A conversation's events stand in the order of turn, seq, event, role, text.  ``message`` opens a message; in the
    same turn ``delta`` adds text to the last one opened, ``edit`` replaces its text, ``regenerate`` drops its text and
    begins anew with its own.  A delta, edit or regeneration before any message of its turn opens one; an unknown or
    null event counts as message.  The role is the last one given that is not null.  Null text is empty.  Exact
    repetitions of a row are events of their own.  One shuffle, by conversation, then one sort.
    """
    known = F.when(F.col("event").isin("delta", "edit", "regenerate"), F.col("event")).otherwise("message")
    log = events.select(
        F.col(conv_id).alias("conv_id"), F.col("turn").alias("turn"), F.col("seq").alias("seq"), known.alias("event"),
        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "seq", "event", "role", "text")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = (F.col("event") == "message") | (F.row_number().over(order) == 1) | ~F.col("turn").eqNullSafe(F.lag("turn").over(order))
    log = log.withColumn("_opens", opens.cast("int")).withColumn("place", F.sum("_opens").over(running))
    log = log.withColumn("_version", F.sum(((F.col("_opens") == 1) | F.col("event").isin("edit", "regenerate")).cast("int")).over(running))
    log = log.withColumn("_n", F.row_number().over(order))
    part = F.transform(F.sort_array(F.collect_list(F.struct("_version", "_n", "text"))), lambda x: x)
    message = log.groupBy("conv_id", "place").agg(part.alias("_parts"), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("_n"))).alias("role"))
    last = F.element_at("_parts", -1)["_version"]
    return message.select("conv_id", "place", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(F.filter("_parts", lambda x: x["_version"] == last), lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, and loss_spans: where in formatted (code points, from 0) the texts of the learnt roles stand.

    A conversation is one output row, so its messages meet in one task: the row's own size bounds that.  Null and
    empty texts are turns without text; no messages give no rows.
    """
    turn = F.concat(F.lit(HEAD), _escape(F.col("role"), _ROLE), F.lit(AFTER_ROLE), _escape(F.col("text")), F.lit(END))
    each = messages.select("conv_id", "place", "role", turn.alias("turn"), F.char_length(turn).cast("long").alias("size"), F.char_length(_escape(F.col("text"))).cast("long").alias("inner"))
    before = F.sum("size").over(Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    each = each.withColumn("stop", before - len(END))
    span = F.when(F.col("role").isin(*learn), F.struct((F.col("stop") - F.col("inner")).alias("start"), F.col("stop").alias("stop")))
    return each.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "turn"))), lambda x: x["turn"]), "").alias("formatted"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, parsed from formatted), loss_text (the spans, unescaped, one after another), formatted_chars.

    The inverse of render() for any texts and roles; a conversation without a learnt role has an empty loss_text.
    """
    pieces = F.filter(F.split("formatted", F.lit(END)), lambda x: x != "")
    at = lambda x: F.instr(x, AFTER_ROLE)
    turns = F.transform(
        pieces,
        lambda x: F.struct(
            _unescape(F.substr(x, F.lit(len(HEAD) + 1), at(x) - len(HEAD) - 1), _ROLE).alias("role"),
            _unescape(F.substr(x, at(x) + len(AFTER_ROLE))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: _unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return rendered.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


def digest(read: DataFrame) -> DataFrame:
    """Counts and hashes of what was read back: turns, loss text and formatted length."""
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars",
    )
