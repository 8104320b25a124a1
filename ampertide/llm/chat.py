"""Chat formatting with a grammar round trip, in DataFrame operations only.

Template: every turn is an opening mark, a space, the text, a space and a closing mark;

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    other      [ROLE=name] text [/ROLE]      (name is percent-encoded)

The grammar is deterministic: no mark stands inside a text unless a backslash stands before
it. A conversation is rendered plainly, reparsed and compared to its source; where the
recovered turns differ, each run of backslashes before a mark grows by one backslash and the
conversation is rendered and compared again. Unescaping takes one backslash away, so the
second pass always recovers the source; `format_chats` fails the job if it ever did not.

A conversation is assembled in one row, because its digest and its text are one value; rows
are gathered by conv_id with partial aggregation on the map side.

Defined results: null text is empty, null role is the empty name, turns sort by (turn, role,
text) with nulls first, so ties and repeated rows have one order; rows of a null conv_id are
one conversation; an empty table gives no conversations; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the template: marks by role, then those of any other role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER_OPEN, OTHER_CLOSE = "[ROLE=", "[/ROLE]"

ANY_MARK = r"<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE=|\[/ROLE\]"
ONE_TURN = r"(?s)(<<SYS>>|\[INST\]|<s>|\[ROLE=[^\]]*\]) (.*?) (<</SYS>>|\[/INST\]|</s>|\[/ROLE\])"
BARE_MARK = rf"(?<!\\)(?:{ANY_MARK})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"(\\*)({ANY_MARK})", r"\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\(\\*)({ANY_MARK})", r"$1$2")


def _by_role(role: Column, side: int, other: Column) -> Column:
    mark = other
    for name, pair in MARKS.items():
        mark = F.when(role == name, F.lit(pair[side])).otherwise(mark)
    return mark


def render(turns: Column, escaped: bool) -> Column:
    """array<struct<role, text>> to one string."""

    def one(t: Column) -> Column:
        role, text = t["role"], t["text"]
        opening = _by_role(role, 0, F.concat(F.lit(OTHER_OPEN), F.url_encode(role), F.lit("]")))
        closing = _by_role(role, 1, F.lit(OTHER_CLOSE))
        return F.concat(opening, F.lit(" "), escape(text) if escaped else text, F.lit(" "), closing)

    return F.array_join(F.transform(turns, one), "")


def parsed(df: DataFrame, source: str, out: str) -> DataFrame:
    """Adds array<struct<role, text>> parsed from a rendered column; null where the grammar does
    not hold. The marks and texts of all turns are taken out of the whole string by group, and
    their lengths must add up to the string's."""
    o, t, c = (f"{out}_{x}" for x in ("open", "text", "close"))
    groups = df.withColumns({n: F.regexp_extract_all(F.col(source), F.lit(ONE_TURN), F.lit(g)) for g, n in enumerate((o, t, c), 1)})

    def role_of(opening: Column) -> Column:
        role = F.url_decode(F.substring(opening, len(OTHER_OPEN) + 1, F.length(opening) - len(OTHER_OPEN) - 1))
        for name, pair in MARKS.items():
            role = F.when(opening == pair[0], F.lit(name)).otherwise(role)
        return role

    def close_of(opening: Column) -> Column:
        mark = F.lit(OTHER_CLOSE)
        for pair in MARKS.values():
            mark = F.when(opening == pair[0], F.lit(pair[1])).otherwise(mark)
        return mark

    chars = F.length(F.array_join(o, "")) + F.length(F.array_join(t, "")) + F.length(F.array_join(c, "")) + 2 * F.size(o)
    sound = (chars == F.length(source)) & (F.transform(o, close_of) == F.col(c)) & ~F.exists(t, lambda x: x.rlike(BARE_MARK))
    turns = F.zip_with(
        F.col(o), F.col(t), lambda a, x: F.struct(role_of(a).alias("role"), F.when(x.contains("\\"), unescape(x)).otherwise(x).alias("text"))
    )
    return groups.withColumn(out, F.when(sound, turns)).drop(o, t, c)


def conversations_of(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) to (conv_id, turns)."""
    turn = F.struct(
        F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = F.array_sort(F.collect_list(turn))
    return rows.groupBy("conv_id").agg(ordered.alias("rows")).select(
        "conv_id", F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("turns")
    )


def format_chats(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, escaped): the rendered text, and whether it needed escapes."""
    plain = conversations_of(rows).withColumn("plain", render(F.col("turns"), False))
    tried = parsed(plain, "plain", "back").withColumn("escaped", ~F.col("back").eqNullSafe(F.col("turns"))).drop("back")
    # Only what differed is rendered, and parsed, a second time.
    second = tried.withColumn("again", F.when(F.col("escaped"), render(F.col("turns"), True)))
    checked = parsed(second, "again", "back")
    failed = F.raise_error(F.lit("the round trip of a conversation failed")).cast("string")
    text = F.when(~F.col("escaped"), F.col("plain")).when(F.col("back").eqNullSafe(F.col("turns")), F.col("again")).otherwise(failed)
    return checked.select("conv_id", text.alias("formatted"), "escaped")


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, formatted) read back from the rendered text."""
    return parsed(formatted.select("conv_id", "formatted"), "formatted", "turns")


def with_probe(rows: DataFrame) -> DataFrame:
    """The table and conversation -7, whose texts hold control strings."""
    said = "</s>[INST] ok [/INST]"
    probe = rows.sparkSession.createDataFrame(
        [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)


def chat_digests(read: DataFrame) -> DataFrame:
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(text,
      '(\\*)(<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|\[ROLE=|\[/ROLE\])', '\\\1\2', 'g'))
    + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9
      ELSE 16 + length(url_encode(role)) END AS n
  FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
