"""op3: all conversations, formatted and read back."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import chat as C
from gridloom.llm.shared import table

#: Fixed value of the contract: what conversation -1 says.
TRICKY = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    turns = rows.unionByName(more).select("conv_id", "turn", "role", C.text_parts(F.col("text")).alias("parts"))
    made = C.format_chats(turns)
    made = made.select("conv_id", "formatted", C.read_back(F.col("formatted")).alias("turns"), C.under_mask(F.col("formatted"), F.col("mask")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), digest.alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


_long = lambda c: f"(length({c}) + 4 * (length({c}) - length(replace({c}, '&', ''))) + 4 * (length({c}) - length(replace({c}, '[', ''))) + 3 * (length({c}) - length(replace({c}, '<', ''))))"

OP3_SQL = f"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}')
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum({_long('role')} + {_long('text')} + 17)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
