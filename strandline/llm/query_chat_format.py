"""Query op1: every conversation, formatted, and what is read back from the output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import chat_format as C
from strandline.llm.common import let, table

PROBE = (-1, [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")])


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a table of another layout
    probe = spark.createDataFrame([PROBE], "id long, messages array<struct<role:string,content:string>>")
    turns = C.canonical_rows(table(spark, sf_dir, "conversations")).unionByName(C.canonical_nested(probe, "id"))
    done = C.format_turns(turns)
    # what follows looks at the formatted text and its mask alone
    back = let(C.read_back(F.col("formatted")), lambda t: F.struct(F.size(t).cast("long").alias("n"), F.array_join(F.transform(t, lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "").alias("all")))
    loss = F.array_join(F.transform("loss_spans", lambda s: C.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return done.select("conv_id", back.alias("b"), loss.alias("l"), F.length("formatted").cast("long").alias("formatted_chars")).select(
        "conv_id", F.col("b.n").alias("n_turns"), F.sha2("b.all", 256).alias("turns_sha256"), F.length("l").cast("long").alias("loss_chars"), F.sha2("l", 256).alias("loss_sha256"), "formatted_chars"
    )


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for plain, broken in C.CONTROL_STRINGS:
        out = f"replace({out}, '{plain}', '{broken}')"
    return out


QUERIES = {"op1_chat_format": op1_chat_format}
SQL = {
    "op1_chat_format": f"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length({_escaped("role")}) + length({_escaped("text")}) + {len(C.TURN + C.TEXT + C.END)}) AS formatted_chars
  FROM t GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""
}
