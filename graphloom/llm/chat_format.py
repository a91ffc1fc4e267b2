r"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

A turn is written as ``<s>role[INST]text[/INST]</s>`` and a line feed. Inside roles and texts a control string gets a backslash
after its first character, and one more if it has some already, so that marks can't be forged and reading back is exact.
An example is the text of a conversation up to one reply, with the span (in code points) of that reply as the only trainable part;
a conversation that does not end in a reply also gets one example of all its turns with an empty span, so that no turn is lost.
All of it is DataFrame functions: one shuffle by conversation, no second one for reading back. The examples of a conversation of
n turns hold n * n / 2 turns by definition; rows stay apart by conversation.

Defined cases: null text or role counts as empty; turns are ordered by (turn, role, text), nulls first; repeated rows are repeated turns;
rows with a null conv_id form one conversation; a conversation without a reply has no loss text; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

OPEN, MIDDLE, CLOSE = "<s>", "[INST]", "[/INST]</s>\n"
#: What follows the first character of a control string.
REST = r"(/?INST\]|/?s>|</?SYS>>)"
ESCAPE, UNESCAPE = r"([\[<])(\\*)" + REST, r"([\[<])\\(\\*)" + REST
TRAINED = "assistant"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(ESCAPE), F.lit(r"$1\\$2$3"))


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, F.lit(UNESCAPE), F.lit("$1$2$3"))


def conversations(rows: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (role, body) in order, both escaped."""
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))
    return grouped.select("conv_id", F.transform("rows", lambda r: F.struct((r.role == TRAINED).alias("trained"), escape(r.role).alias("role"), escape(r.text).alias("body"))).alias("turns"))


def examples(rows: DataFrame) -> DataFrame:
    """conv_id, target (number of the trained turn from 0, or of the last if none is), text, loss_start, loss_end."""
    turns = conversations(rows)
    text = F.array_join(F.transform(F.slice("turns", 1, F.col("at") + 1), lambda t: F.concat(F.lit(OPEN), t.role, F.lit(MIDDLE), t.body, F.lit(CLOSE))), "")
    each = turns.select("conv_id", "turns", F.posexplode("turns").alias("at", "own")).where(F.col("own.trained") | (F.col("at") + 1 == F.size("turns")))
    made = each.select("conv_id", F.col("at").alias("target"), text.alias("text"), F.when(F.col("own.trained"), F.length("own.body")).otherwise(0).alias("reply"))
    end = F.length("text") - F.when(F.col("reply") > 0, len(CLOSE)).otherwise(0)
    return made.select("conv_id", "target", "text", (end - F.col("reply")).alias("loss_start"), end.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """What examples hold, by conversation: the turns of its longest one, and the text under every loss mask."""
    masked = F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    each = formatted.select("conv_id", "target", "text", unescape(masked).alias("reply"), F.length("text").cast("long").alias("chars"))
    whole = each.groupBy("conv_id").agg(F.max_by("text", "target").alias("text"), F.sort_array(F.collect_list(F.struct("target", "reply"))).alias("replies"), F.sum("chars").alias("formatted_chars"))
    parts = F.filter(F.split("text", F.lit(r"\[/INST\]</s>\n"), -1), lambda x: x.startswith(OPEN))
    mark = F.lit(MIDDLE)
    role = lambda x: F.substring_index(x, MIDDLE, 1)
    turn = lambda x: F.struct(unescape(F.substring(role(x), F.lit(len(OPEN) + 1), F.length(x))).alias("role"), unescape(F.substring(x, F.length(role(x)) + F.length(mark) + 1, F.length(x))).alias("text"))
    return whole.select("conv_id", F.transform(parts, turn).alias("turns"), F.array_join(F.transform("replies", lambda r: r.reply), "").alias("loss"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    back = read_back(examples(rows))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(role, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g'))
              + length(regexp_replace(text, '([\[<])(\\*)(/?INST\]|/?s>|</?SYS>>)', '\1\\\2\3', 'g')) + 21 AS chars,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM c),
p AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
