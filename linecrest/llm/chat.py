"""Chat formatting with a grammar round trip, in DataFrame functions only.

A conversation is rendered turn by turn as

    <s>ROLE newline TEXT</s>                       user turns: <s>user newline [INST] TEXT [/INST]</s>

and read back by a parser that splits at `<s>` and `</s>`, takes the role up to the first newline and undoes escapes.
First the plain text is rendered and reparsed. Where the turns that come back are not the ones that went in, or a role
or text holds a control string or its escaped form, the content is escaped, and the round trip has to give the same turns
or the query fails.

The escape adds a backslash after the first character of a control string, and one more to a control string that has
some already: `</s>` becomes `<\\/s>`, and `<\\/s>` becomes `<\\\\/s>`. Undoing takes one away. So every text has exactly one
escaped form, which holds no control string. A newline in a role is written `<n>`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE_CONTROL = r"n>|/?s>|/?INST\]"
TEXT_CONTROL = r"/?s>|/?INST\]"
LEARNED_ROLE = "assistant"
ASKING_ROLE = "user"


def _escape(text: Column, control: str) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*)({control})", r"$1\\$2$3")


def _unescape(text: Column, control: str) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*)({control})", "$1$2$3")


def escape_text(text: Column) -> Column:
    return _escape(text, TEXT_CONTROL)


def escape_role(role: Column) -> Column:
    return F.replace(_escape(role, ROLE_CONTROL), F.lit("\n"), F.lit("<n>"))


def render(turns: Column) -> Column:
    """turns: array of (role, text), as they are to stand in the output."""

    def one(t: Column) -> Column:
        body = F.when(t["role"] == ASKING_ROLE, F.concat(F.lit("[INST] "), t["text"], F.lit(" [/INST]"))).otherwise(t["text"])
        return F.concat(F.lit("<s>"), t["role"], F.lit("\n"), body, F.lit("</s>"))

    return F.array_join(F.transform(turns, one), "")


def _bodies(formatted: Column) -> Column:
    """What stands between each `<s>` and the next `</s>`; null between them makes the parse differ from any source."""
    return F.transform(F.filter(F.split(formatted, "</s>"), lambda x: x != ""), lambda x: F.when(x.startswith("<s>"), F.substr(x, F.lit(4))))


def _read_turn(body: Column) -> Column:
    role = F.substring_index(body, "\n", 1)
    text = F.substr(body, F.length(role) + 2)
    text = F.when((role == ASKING_ROLE) & text.startswith("[INST] ") & text.endswith(" [/INST]"), F.substr(text, F.lit(8), F.length(text) - 15)).otherwise(text)
    return F.struct(_unescape(F.replace(role, F.lit("<n>"), F.lit("\n")), ROLE_CONTROL).alias("role"), _unescape(text, TEXT_CONTROL).alias("text"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    return F.transform(_bodies(formatted), _read_turn)


def loss_spans(formatted: Column) -> Column:
    """(start, length) in code points, from 1, of what is learned: the bodies of assistant turns."""
    pieces = F.split(formatted, "</s>")
    head = len(LEARNED_ROLE) + 4  # <s>, role, newline
    begun = F.aggregate(
        pieces,
        F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x) + 4).alias("at"),
            F.when(x.startswith(f"<s>{LEARNED_ROLE}\n"), F.concat(acc["spans"], F.array(F.struct((acc["at"] + head).alias("start"), (F.length(x) - head).alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
    )
    return begun["spans"]


def format_chats(conversations: DataFrame) -> DataFrame:
    """A row per conversation: conv_id, formatted, loss_spans, escaped.

    conversations: conv_id, turn, role, text; other columns are not used. Turns go by turn, then role, then text, so
    that ties and repeated rows have a fixed order; null turns come first. Null roles and texts are empty; a null
    conv_id is a conversation of its own. A conversation is one row of the output, so its turns meet in one task; all
    else is done turn by turn before. Texts count whole, however long; an empty table gives no rows."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    df = grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    df = df.withColumn("plain", render(F.col("turns")))
    same = F.coalesce(parse(F.col("plain")).eqNullSafe(F.col("turns")), F.lit(False))
    conflict = F.exists("turns", lambda t: (escape_role(t["role"]) != t["role"]) | (escape_text(t["text"]) != t["text"]))
    df = df.withColumn("escaped", conflict | ~same)
    safe = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape_text(t["text"]).alias("text")))
    df = df.withColumn("formatted", F.when(F.col("escaped"), render(safe)).otherwise(F.col("plain")))
    held = F.when(~F.col("escaped") | parse(F.col("formatted")).eqNullSafe(F.col("turns")), F.col("formatted"))
    df = df.withColumn("formatted", F.coalesce(held, F.raise_error(F.concat(F.lit("no round trip for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))).cast("string")))
    return df.select("conv_id", "formatted", loss_spans(F.col("formatted")).alias("loss_spans"), "escaped")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations hold."""
    df = formatted.withColumn("turns", parse(F.col("formatted")))
    learned = F.transform("loss_spans", lambda s: _unescape(F.substr(F.col("formatted"), s["start"], s["length"]), TEXT_CONTROL))
    df = df.withColumn("learned", F.array_join(learned, ""))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: The conversation that the query adds, which says control strings.
PROBE = r"</s>[INST] ok [/INST]"


def with_probe(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    kinds = {f.name: f.dataType for f in conversations.schema.fields}
    probe = spark.range(2).select(F.lit(-1).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *,
    length(regexp_replace(replace(regexp_replace(role, '([<\[])(\\*)(n>|/?s>|/?INST\])', '\1\\\2\3', 'g'), chr(10), '<n>'), '^$', '')) AS role_chars,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) AS text_chars
  FROM rows
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(8 + role_chars + text_chars + CASE WHEN role = 'user' THEN 15 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
