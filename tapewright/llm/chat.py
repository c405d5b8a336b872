"""Chat formatting: conversations rebuilt from event logs, rendered with a reversible template. No Python on executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The template: a turn is HEAD role MID text TAIL. Texts and roles never hold < or #, which are written as escapes.
HEAD, MID, TAIL = "### ", ":\n", "</turn>\n"
#: What stands for the characters that control strings are made of, in the order of replacement.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c"))
#: Kinds of event: a delta adds to its message, an edit replaces its text, a regeneration discards it.
DELTA, EDIT, REGENERATE = "delta", "edit", "regenerate"


def escaped(text: Column, colon: bool = False) -> Column:
    for raw, code in ESCAPES[: 4 if colon else 3]:
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for raw, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def messages(log: DataFrame) -> DataFrame:
    """Fold a log (conv_id, seq, message, event, role, text) into one row per conversation: conv_id and ``turns``,
    an array of (message, role, text) in the order of ``message``.

    Events of a message apply by seq (ties: by kind, then text): a delta appends its text, an edit replaces what is
    there, a regeneration empties it; the role is the last one given. Null text counts as empty. The log is dealt by
    conversation once; both folds use that partitioning."""
    dealt = log.repartition("conv_id")
    events = F.sort_array(F.collect_list(F.struct("seq", "event", F.coalesce("text", F.lit("")).alias("text"), "role")))
    folded = dealt.groupBy("conv_id", "message").agg(events.alias("e"))
    folded = folded.withColumn("base", F.coalesce(F.array_max(F.transform("e", lambda x, i: F.when(x["event"] != DELTA, i))), F.lit(-1)))
    first = F.when((F.col("base") >= 0) & (F.get("e", F.col("base"))["event"] == EDIT), F.get("e", F.col("base"))["text"]).otherwise("")
    rest = F.array_join(F.transform(F.slice("e", F.col("base") + 2, F.size("e")), lambda x: x["text"]), "")
    roles = F.filter("e", lambda x: x["role"].isNotNull())
    folded = folded.select("conv_id", "message", F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"), F.concat(first, rest).alias("text"))
    return folded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))


def render(folded: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans: array of (start, length) in code points of the ``learned`` role's escaped texts."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.concat(F.lit(HEAD), escaped(t["role"], colon=True), F.lit(MID)).alias("head"), escaped(t["text"]).alias("body")))
    d = folded.select("conv_id", parts.alias("p"))
    d = d.withColumn("formatted", F.array_join(F.flatten(F.transform("p", lambda x: F.array(x["head"], x["body"], F.lit(TAIL)))), ""))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(a, x):
        start = a["at"] + F.char_length(x["head"])
        size = F.char_length(x["body"])
        span = F.array(F.struct(start.alias("start"), size.alias("length")))
        return F.struct((start + size + len(TAIL)).alias("at"), F.when(x["role"] == learned, F.concat(a["spans"], span)).otherwise(a["spans"]).alias("spans"))

    return d.select("conv_id", "formatted", F.aggregate("p", zero, step)["spans"].alias("loss_spans"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a rendered conversation."""
    turns = F.filter(F.split(formatted, TAIL), lambda x: x != "")

    def turn(x):
        cut = F.instr(x, MID)
        role = F.substring(x, F.lit(len(HEAD) + 1), cut - len(HEAD) - 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substring(x, cut + len(MID), F.char_length(x))).alias("text"))

    return F.transform(turns, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substring(formatted, s["start"] + 1, s["length"])), ""))


def event_log(conversations: DataFrame) -> DataFrame:
    """The log that a streaming front end would have left of finished conversations: users' texts typed and corrected
    by an edit, the others streamed in halves after a first answer was discarded. Rows of a conversation are numbered
    by turn, then role, then text, so repeated rows stay messages of their own."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    c = conversations.select(F.col("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    c = c.withColumn("message", F.row_number().over(order))
    half = F.floor(F.char_length("text") / 2).cast("int")
    left, right = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.char_length("text"))
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("event"), text.alias("text"))
    typed = F.array(event(0, DELTA, right), event(1, EDIT, F.col("text")))
    streamed = F.array(event(0, DELTA, left), event(1, REGENERATE, F.lit("")), event(2, DELTA, left), event(3, DELTA, right))
    events = F.explode(F.when(F.col("role") == "user", typed).otherwise(streamed)).alias("x")
    return c.select("conv_id", "message", "role", events).select("conv_id", (F.col("message") * 4 + F.col("x.k")).alias("seq"), "message", "x.event", "role", "x.text")


def format_conversations(log: DataFrame, learned: str = "assistant") -> DataFrame:
    """Rebuild conversations from their event log and render them: conv_id, formatted, loss_spans.

    Null conv_id: one conversation of its own. Null role: empty. A conversation without events has no row; an empty
    log gives an empty table; further columns of the log are ignored, whatever their names. A text of any length is rendered
    whole. Events of one conversation are folded by (sequence, ...) as messages() says; a repeated event counts again."""
    return render(messages(log), learned)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from the rendered text alone."""
    d = formatted.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode(F.col("loss"), "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle(table: str = "conversations") -> str:
    """The contract in DuckDB SQL: the digests of the conversations as they stand in the table."""
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {table}
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
e AS (SELECT *, replace(replace(replace(text, '\\', '\\b'), '<', '\\l'), '#', '\\h') AS body FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum({len(HEAD) + len(MID) + len(TAIL)} + length(role) + length(body))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id"""
