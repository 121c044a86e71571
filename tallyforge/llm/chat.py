r"""Chat formatting from an event log, in DataFrame operations only.

A log is a table of events: conversation, sequence number, turn, kind, role, text. Kinds: `message` sets a turn's text, `delta` adds to it, `edit` replaces what it held so far, `regenerate` empties it (its new text follows), `delete` takes the turn away until a later event brings it back. The log is partitioned by conversation and turn, each turn's events are sorted by sequence and folded to its final message (only those from its last resetting event on count), and the messages of a conversation, by turn, are rendered in one string. A turn's text is folded before a conversation is brought together, so a conversation's rows meet only as the messages that its rendering holds anyway.

Template: a turn is `<|im_start|>` role `\n` text `<|im_end|>` `\n`. Inside texts and roles the control strings are escaped: where `<` and `|`, `s>` or `/s>`, or `[` and `INST]` or `/INST]`, stand together or have only backslashes between them, one backslash is added after the bracket. Unescaping takes one away, so every text comes back exactly, and no text can hold a mark. The loss mask is the spans (code points) of assistant texts.

Defined cases: a null text counts as empty, a null role as an empty one (a role's line breaks are escaped as a mark `<|nl|>`); rows with a null conv_id are one conversation, whose conv_id stays null; a null turn comes before all others; texts are handled whole; events that tie in sequence and turn are ordered by kind and text, and of repeated `message` rows for one turn and sequence all are kept, as turns of their own (a log that repeats a turn has two); an empty log gives no conversations; other columns of the log are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The template's marks and the control strings that texts must not hold.
START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")
LOSS_ROLE = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"<(\\*)(\||/?s>)", r"<\\$1$2"), r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"<\\(\\*)(\||/?s>)", r"<$1$2"), r"\[\\(\\*)(/?INST\])", r"[$1$2")


def escape_role(x: Column) -> Column:
    return F.replace(escape(x), F.lit("\n"), F.lit("<|nl|>"))


def unescape_role(x: Column) -> Column:
    return unescape(F.replace(x, F.lit("<|nl|>"), F.lit("\n")))


def as_events(turns: DataFrame) -> DataFrame:
    """A log of whole messages (conv_id, turn, role, text) as events, as a chat in use would leave them: an assistant's turn is opened, begun, regenerated and then filled by deltas of a line each; another role's turn is a draft, which an edit empties and deltas fill."""
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "(?<=\n)", -1)
    copies = W.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = turns.select("conv_id", "turn", "role", "text").withColumn("copy", F.row_number().over(copies))
    event = lambda part, kind, piece: F.struct(F.lit(part).alias("part"), kind.alias("kind"), F.lit(piece).alias("piece"))
    ours = F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    opened = F.array(event(0, F.lit("message"), "Well"), event(1, F.when(ours, "delta").otherwise("edit"), ""), event(2, F.when(ours, "regenerate").otherwise("delta"), ""))
    filled = F.transform(lines, lambda x, k: F.struct((k + 3).alias("part"), F.lit("delta").alias("kind"), x.alias("piece")))
    return numbered.select("conv_id", "turn", "copy", "role", F.explode(F.concat(opened, filled)).alias("e")).select("conv_id", "turn", "copy", F.col("e.part").cast("long").alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.piece").alias("text"))


def fold(events: DataFrame) -> DataFrame:
    """The final messages (conv_id, turn, copy, role, text) of a log. copy tells repeated turns apart; a log without that column has one of each."""
    if "copy" not in events.columns:
        events = events.withColumn("copy", F.lit(1))
    e = events.select("conv_id", "turn", "copy", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = e.groupBy("conv_id", "turn", "copy").agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("es"))
    last = F.array_max(F.transform("es", lambda x, k: F.when(x["kind"].isin(*RESETS), k).otherwise(F.lit(-1))))
    live = F.slice("es", F.greatest(F.col("last"), F.lit(0)) + 1, F.size("es"))
    role = F.try_element_at(F.filter(F.transform("es", lambda x: x["role"]), lambda r: r != ""), F.lit(-1))
    return (
        rows.withColumn("last", last)
        .withColumn("live", live)
        .where(~((F.col("last") >= 0) & (F.element_at("live", 1)["kind"] == "delete") & (F.size("live") == 1)))
        .select("conv_id", "turn", "copy", F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (array of struct start, end; code points, end exclusive), n_turns."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "copy", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    piece = F.concat("head", "body", F.lit(END))
    ends = F.sum(F.length(piece)).over(W.partitionBy("conv_id").orderBy("turn", "copy").rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = parts.select("conv_id", "turn", "copy", piece.alias("piece"), F.when(F.col("loss"), F.struct((ends - F.length(F.lit(END)) - F.length("body")).alias("start"), (ends - F.length(F.lit(END))).alias("end"))).alias("span"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "copy", "piece"))).alias("ps"), F.array_sort(F.collect_list("span")).alias("loss_spans"), F.count(F.lit(1)).alias("n_turns"))
    return rows.select("conv_id", F.array_join(F.transform("ps", lambda p: p["piece"]), "").alias("formatted"), "loss_spans", "n_turns")


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, k (place), role, text, loss of each turn, and the formatted_chars of its conversation, from the rendered strings and their masks alone."""
    pieces = F.filter(F.split("formatted", r"(?<=<\|im_end\|>\n)(?=<\|im_start\|>|$)", -1), lambda p: p != "")
    at = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.posexplode(pieces).alias("k", "piece"))
    ends = F.sum(F.length("piece")).over(W.partitionBy("conv_id").orderBy("k").rowsBetween(W.unboundedPreceding, W.currentRow))
    inner = F.expr(f"substring(piece, {len(START) + 1}, length(piece) - {len(START) + len(END)})")
    cut = F.locate("\n", inner)
    turns = at.withColumn("stop", ends - len(END)).withColumn("inner", inner).withColumn("cut", cut)
    turns = turns.select("conv_id", "k", "formatted_chars", unescape_role(F.expr("substring(inner, 1, cut - 1)")).alias("role"), F.expr("substring(inner, cut + 1)").alias("body"), "stop")
    spans = formatted.select(F.col("conv_id").alias("of"), F.explode("loss_spans").alias("s")).select("of", F.col("s.start").alias("from"), F.col("s.end").alias("to"))
    marked = turns.join(spans, turns["conv_id"].eqNullSafe(spans["of"]) & (turns["stop"] == spans["to"]), "left")
    return marked.select("conv_id", "k", "role", unescape(F.col("body")).alias("text"), (F.coalesce(F.col("stop") - F.col("from") == F.length("body"), F.lit(False))).alias("loss"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """conversations and the contract's conversation -7, whose texts hold control strings."""
    turn = conversations.sparkSession.range(2)
    probe = turn.select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def digest(turns: DataFrame) -> DataFrame:
    """One row for each conversation: digests of the turns read back (read_back()), and of the text under the mask."""
    row = F.struct("k", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("whole"), F.when(F.col("loss"), F.col("text")).otherwise("").alias("loss"))
    back = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(row)).alias("ts"), F.max("formatted_chars").alias("formatted_chars"))
    text = lambda c: F.array_join(F.transform("ts", lambda t: t[c]), "")
    return back.select("conv_id", "n_turns", F.sha2(text("whole"), 256).alias("turns_sha256"), F.length(text("loss")).cast("long").alias("loss_chars"), F.sha2(text("loss"), 256).alias("loss_sha256"), "formatted_chars")


#: The digests of all conversations and the probe, in DuckDB.
ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(\||/?s>)', '<\\\1\2', 'g'), '\[(\\*)(/?INST\])', '[\\\1\2', 'g') AS body FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + length(body) + 11)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
