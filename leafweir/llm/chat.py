"""Chat formatting from event logs (op 7), with DataFrame functions only.

``fold`` rebuilds messages from a log of events, ordered within a conversation by ``seq`` (ties by
turn, kind, role and text):

* ``message``: begins a turn anew with its role and text;
* ``delta``: adds text to the turn;
* ``edit``: replaces the turn's text;
* ``regenerate``: empties the turn's text and takes back every later turn.

``render`` writes each conversation in one template, a turn as ``<|im_start|>role\\ntext<|im_end|>\\n``.
Control strings inside roles and texts get one backslash after their first character, and strings
that already have backslashes there one more; ``unescape`` takes one away, so any text comes back.
The loss mask has one span for each assistant turn, over its text and nothing else. ``parse`` reads
turns back from the formatted string alone, ``masked_text`` what the mask covers.

A conversation is one training example and so one row; windows by conversation sort with spill, and
only its final messages are gathered. Messages are pre-shortened to those that survive.

Defined results: null texts and roles count as empty; events of unknown kind are ignored; a turn
that never began with a message takes the last role any of its events names; null conversation ids
form one conversation; repeated rows are turns of their own (``log_of_turns`` numbers them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that a template of this or another kind may mean as control.
_REST = r"(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)"
ESCAPE = rf"([<\[])(\\*){_REST}"
_UNESCAPE = rf"([<\[])\\(\\*){_REST}"
_FOLDED = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    """A role is one line: newlines and backslashes are written with a backslash."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def log_of_turns(rows: DataFrame) -> DataFrame:
    """Events of a table conv_id, turn, role, text, as a chat leaves them behind.

    An assistant streams a draft, to which a next turn is already begun, is told to regenerate (which takes
    both back) and streams its text in two deltas. Of other turns every third is corrected by an edit.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "text")
    texts = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("at", F.row_number().over(order).cast("long"))
    event = lambda n, kind, text, ahead=0: F.struct((F.col("at") * 8 + n).alias("seq"), F.lit(kind).alias("kind"), (F.col("at") + ahead).alias("turn"), text.alias("text"))
    half, none = F.floor(F.length("text") / 2).cast("int"), F.lit("")
    first, second = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    streamed = F.array(event(0, "message", none), event(1, "delta", F.concat(F.lit("A draft: "), second)), event(2, "message", F.lit("Wait."), 1), event(3, "regenerate", none), event(4, "delta", first), event(5, "delta", second))
    corrected = F.array(event(0, "message", F.concat("text", F.lit(" (uncorrected)"))), event(1, "edit", F.col("text")))
    events = F.when(F.col("role") == "assistant", streamed).when(F.col("at") % 3 == 0, corrected).otherwise(F.array(event(0, "message", F.col("text"))))
    return texts.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "e.turn", "role", "e.text")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: final messages of a log conv_id, seq, kind, turn, role, text."""
    log = events.select("conv_id", "seq", "kind", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).filter(F.col("kind").isin(*_FOLDED))
    conversation = Window.partitionBy("conv_id").orderBy(*[F.col(c).asc_nulls_first() for c in ("seq", "turn", "kind", "role", "text")])
    log = log.withColumn("at", F.row_number().over(conversation))
    after = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)
    taken_back = F.coalesce(F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(after) < F.col("turn"), F.lit(False))
    log = log.withColumn("void", taken_back).filter(~F.col("void"))
    turn = Window.partitionBy("conv_id", "turn")
    log = log.withColumn("reset", F.coalesce(F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(turn), F.lit(0)))
    said = F.when((F.col("kind") != "regenerate") & (F.col("at") >= F.col("reset")), F.struct("at", "text"))
    named = F.coalesce(F.max_by("role", F.when((F.col("kind") == "message") & F.col("role").isNotNull(), F.col("at"))), F.max_by("role", F.when(F.col("role").isNotNull(), F.col("at"))))
    return log.groupBy("conv_id", "turn").agg(named.alias("role"), F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda x: x["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, n_turns, formatted, loss: one row per conversation.

    ``loss`` is array<struct<start, length, turn, at>>: code points in formatted, and the same place
    as ``at`` code points into turn number ``turn`` (from 1).
    """
    role, text = _escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    rows = messages.select("conv_id", "turn", (F.col("role") == "assistant").alias("mine"), role.alias("r"), text.alias("t")).select("conv_id", "turn", "mine", F.concat(F.lit(START), "r", F.lit("\n"), "t", F.lit(END)).alias("piece"), (F.lit(len(START) + 1) + F.length("r")).alias("head"), F.length("t").alias("n"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "piece")
    before = F.coalesce(F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"begin": before, "k": F.row_number().over(order)})
    span = F.when(F.col("mine"), F.struct((F.col("begin") + F.col("head")).alias("start"), F.col("n").cast("long").alias("length"), F.col("k").alias("turn"), F.col("head").alias("at")))
    grouped = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sort_array(F.collect_list(F.struct("k", "piece"))).alias("pieces"), F.sort_array(F.collect_list(span)).alias("loss"))
    return grouped.select("conv_id", "n_turns", F.array_join(F.transform("pieces", lambda x: x["piece"]), "").alias("formatted"), "loss")


def _segments(formatted: Column) -> Column:
    """What follows each turn's start mark, in order."""
    return F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 2**30)


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted string."""

    def turn(s: Column) -> Column:
        role = F.substring_index(s, "\n", 1)
        text = F.substring(s, F.length(role) + 2, F.length(s) - F.length(role) - 1 - len(END))
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    return F.transform(_segments(formatted), turn)


def masked_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    segments = _segments(formatted)
    cut = F.zip_with(F.transform(loss, lambda m: F.get(segments, m["turn"] - 1)), loss, lambda s, m: unescape(F.substring(s, m["at"] - len(START) + 1, m["length"].cast("int"))))
    return F.array_join(cut, "")


def digests(rendered: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    read = rendered.select("conv_id", parse(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss")).alias("learned"), F.length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")


ORACLE = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped as (
  select *, regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g') as held from said
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>') + length(role) + 1 + length(held) + length('<|im_end|>') + 1) as bigint) as formatted_chars
from escaped group by conv_id
"""
