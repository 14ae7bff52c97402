r"""Operator 11: chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of a formatted conversation (a control string is one only where no
backslash stands right before it)::

    chat = turn*
    turn = "### " role ": " text "\n</turn>\n"

``parse`` reads it back deterministically: it cuts at every control ``### ``,
each piece at its one control ``</turn>``, and the role off at the first
``": "``. One backslash before ``### `` or ``</turn>`` is taken off a text, and
the letters of ``ROLE_ESCAPES`` are put back into a role.

Most texts are written as they are. Every turn is rendered, reparsed and
compared with its source; what does not come back identical is rendered once
more with its text's control strings escaped, and if that is not enough with
its role escaped too. After that the parser's reading is the source: an escaped
text holds no control string, its end can't touch one (a line break stands
between), taking one backslash off before every control string undoes putting
one there, and an escaped role holds none of ``# < :``. The whole formatted
conversation is parsed once more and compared with its turns; a difference
would be an error, not a wrong row.

The turns are rendered and compared row by row, before they meet; only the
running length of the rendered turns and the final line-up need a shuffle, one
for both, by conversation. A conversation is one row of the result, so it has
to fit one (2 GB); its turns are streamed through the window.

Defined cases: null roles and texts are empty ones; turns are in order of
``turn`` (null first), then role and text; repeated rows are turns of their
own; rows without a ``conv_id`` are one conversation, whose id is null; an
empty table gives no rows; columns of other names are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

START, COLON, END = "### ", ": ", "</turn>"
LEARNT = "assistant"
# What an escaped role has in place of the characters that could be read as control strings.
ROLE_ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))
#: How often a turn may be escaped anew: not at all, its text, its role too.
ROUNDS = 3


def escape_text(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescape_text(text: Column) -> Column:
    for mark in (START, END):
        text = F.replace(text, F.lit("\\" + mark), F.lit(mark))
    return text


def escape_role(role: Column) -> Column:
    for char, code in ROLE_ESCAPES:
        role = F.replace(role, F.lit(char), F.lit(code))
    return role


def unescape_role(role: Column) -> Column:
    for char, code in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(code), F.lit(char))
    return role


def head(role: Column, escapes: Column) -> Column:
    """What stands before a turn's text."""
    return F.concat(F.lit(START), F.when(escapes > 1, escape_role(role)).otherwise(role), F.lit(COLON))


def body(text: Column, escapes: Column) -> Column:
    """A turn's text as written."""
    return F.when(escapes > 0, escape_text(text)).otherwise(text)


def render(role: Column, text: Column, escapes: Column) -> Column:
    return F.concat(head(role, escapes), body(text, escapes), F.lit("\n" + END + "\n"))


def parse(formatted: Column) -> Column:
    """``array<struct<role, text>>`` of a formatted chat; null, or null turns, where it does not follow the grammar."""
    control = lambda mark: r"(?<!\\)" + mark
    pieces = F.split(formatted, control(START), -1)

    def turn(parts: Column) -> Column:
        whole = parts[0]
        colon = F.instr(whole, COLON)
        follows = (F.size(parts) == 2) & (parts[1] == "\n") & whole.endswith("\n") & (colon > 0)
        text = whole.substr(colon + len(COLON), F.length(whole) - colon - len(COLON))
        return F.when(follows, F.struct(unescape_role(whole.substr(F.lit(1), colon - 1)).alias("role"),
                                        unescape_text(text).alias("text")))

    # the pieces are split in a step of their own, so that no piece is split once per use
    def turns(pieces: Column) -> Column:
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        return F.when(pieces[0] == "", F.transform(F.transform(rest, lambda p: F.split(p, control(END), -1)), turn))

    return F.transform(F.array(pieces), turns)[0]


def pair(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def escapes_needed(role: Column, text: Column) -> Column:
    """The first round of escaping after which the turn, parsed back, is its source."""
    need = None
    for k in range(ROUNDS):
        back = parse(render(role, text, F.lit(k)))
        same = back.eqNullSafe(F.array(pair(role, text)))
        need = F.when(same, F.lit(k)) if need is None else need.when(same, F.lit(k))
    return need.otherwise(F.raise_error(F.lit("a turn does not come back from its formatted text")).cast("int"))


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text`` without null roles and texts."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), empty(role_col).alias("role"),
                     empty(text_col).alias("text"))


def format_chats(turns: DataFrame, learnt: str = LEARNT) -> DataFrame:
    """``conv_id, formatted, loss, n_escaped`` per conversation (``turns``: as of ``turns_of``).

    ``loss`` lists the spans ``start, stop`` (code points of ``formatted``,
    from 0) of the texts that a model learns from, those of role ``learnt``;
    ``n_escaped`` counts the turns that were not written as they are.
    """
    role, text, escapes = F.col("role"), F.col("text"), F.col("escapes")
    t = turns.withColumn("escapes", escapes_needed(role, text))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = F.coalesce(F.sum(F.length(render(role, text, escapes))).over(
        order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.select("conv_id", "role", "text", "escapes", F.row_number().over(order).alias("k"),
                 (before + F.length(head(role, escapes))).cast("bigint").alias("start"))
    t = t.withColumn("stop", F.col("start") + F.length(body(text, escapes)))
    chats = t.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("k", "role", "text", "escapes", "start", "stop"))).alias("turns"))      # one row of the result
    chats = chats.withColumn("formatted", F.array_join(
        F.transform("turns", lambda x: render(x["role"], x["text"], x["escapes"])), ""))
    same = parse(F.col("formatted")).eqNullSafe(F.transform("turns", lambda x: pair(x["role"], x["text"])))
    wrong = F.raise_error(F.lit("a formatted conversation does not parse to its turns")).cast("string")
    loss = F.transform(F.filter("turns", lambda x: x["role"] == learnt), lambda x: F.struct(x["start"], x["stop"]))
    return chats.select("conv_id", F.when(same, F.col("formatted")).otherwise(wrong).alias("formatted"), loss.alias("loss"),
                        F.size(F.filter("turns", lambda x: x["escapes"] > 0)).cast("bigint").alias("n_escaped"))


def under_mask(formatted: Column, loss: Column) -> Column:
    """The unescaped texts of the spans, in order; four bytes a code point, so that a span is cut off without a search."""
    def texts(wide: Column) -> Column:
        return F.transform(loss, lambda s: unescape_text(F.decode(
            F.substring(wide, (s["start"] * 4 + 1).cast("int"), ((s["stop"] - s["start"]) * 4).cast("int")), "UTF-32")))

    return F.transform(F.array(F.encode(formatted, "UTF-32")), texts)[0]


def read_back(chats: DataFrame) -> DataFrame:
    """``conv_id, formatted, turns, learnt``: what the parser and the loss mask give of ``format_chats``."""
    return chats.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"),
                        under_mask(F.col("formatted"), F.col("loss")).alias("learnt"))


def digests(chats: DataFrame) -> DataFrame:
    """Counts and digests of the turns and of the learnt text, read back from the formatted conversations."""
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = read_back(chats).withColumn("said", F.array_join("learnt", ""))
    return learnt.select("conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
                         F.length("said").cast("bigint").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"),
                         F.length("formatted").cast("bigint").alias("formatted_chars"))


def planted(spark: SparkSession) -> DataFrame:
    """Conversation -7: two turns that hold the template's own control strings, one of them behind a backslash."""
    said = "'\\\\### Assistant: </turn> ok'"
    return spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', {said}), (-7L, 1L, 'assistant', {said}) AS t(conv_id, turn, role, text)")


def formatted_conversations(spark: SparkSession, df: DataFrame) -> DataFrame:
    rows = turns_of(df).withColumns({"conv_id": F.col("conv_id").cast("bigint"), "turn": F.col("turn").cast("bigint")})
    return digests(format_chats(rows.unionByName(planted(spark))))


def oracle(conversations: str = "conversations") -> str:
    """The same digests in DuckDB SQL, from the source; only the formatted length repeats the template."""
    text = "text"
    for mark in (START, END):
        text = f"replace({text}, '{mark}', '\\{mark}')"
    role = "role"
    for char, code in ROLE_ESCAPES:
        role = f"replace({role}, '{char}', '{code}')"
    plain = "NOT (contains(role, '### ') OR contains(role, '</turn>') OR contains(role, ': ') OR regexp_matches(role, '\\\\[bhlc]'))"
    order = "ORDER BY turn NULLS FIRST, role, text"
    said = r"'\### Assistant: </turn> ok'"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM {conversations}
  UNION ALL VALUES (-7, 0, 'user', {said}), (-7, 1, 'assistant', {said})),
r AS (SELECT *, CASE WHEN {plain} THEN role ELSE {role} END AS role_written, {text} AS text_written FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{LEARNT}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LEARNT}'), '')) AS loss_sha256,
       sum({len(START + COLON + END) + 2} + length(role_written) + length(text_written))::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""
