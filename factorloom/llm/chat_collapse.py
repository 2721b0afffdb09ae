"""Chat formatting with collapse of cumulative snapshots.

Loggers often store a conversation again after every turn. Hashes of the turns, each with its place, are rolled up
turn by turn: a conversation whose whole hash is the hash of a shorter part of another is a snapshot of it. An
anti-join leaves the conversations that extend no further, and these are rendered. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _placed(turns: DataFrame) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select("conv_id", "turn", "role", "text").where("conv_id is not null").withColumn("pos", F.row_number().over(order))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, p1, p2, n): two rolling hashes of the first pos turns, and how many turns there are."""
    whole = Window.partitionBy("conv_id")
    rolled = whole.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    parts = [F.col("pos"), *[x for c in ("role", "text") for x in (F.col(c).isNull(), F.coalesce(c, F.lit("")))]]
    each = _placed(turns).withColumns({f"h{i}": F.xxhash64(F.lit(i), *parts) for i in (1, 2)})
    return each.select("conv_id", "pos", *[F.bit_xor(f"h{i}").over(rolled).alias(f"p{i}") for i in (1, 2)], F.max("pos").over(whole.orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n, copies) of the conversations that are no prefix of a longer one; of equal ones the smallest conv_id stands for all its copies."""
    each, key = prefixes(turns), ["pos", "p1", "p2"]
    whole = each.where("pos = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    parts = each.where("pos < n").select(*key).distinct()
    return whole.join(parts, key, "left_anti").select("conv_id", F.col("pos").alias("n"), "copies")


def render(turns: DataFrame, head: str = "<|", after_role: str = "|>\n", tail: str = "<|end|>\n") -> DataFrame:
    """(conv_id, n_turns, copies, chat) of the maximal conversations.

    Turns are in order of turn, then role, then text; repeated turns count. A null role or text shows as nothing but differs from an empty one in comparisons. Rows without a conv_id belong to no conversation. Turns of any length are rendered whole; a conversation is one row, so its turns meet in one task."""
    rows = _placed(turns).join(maximal(turns), "conv_id")
    said = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(after_role), F.coalesce("text", F.lit("")), F.lit(tail))
    grouped = rows.groupBy("conv_id").agg(F.first("n").cast("long").alias("n_turns"), F.first("copies").alias("copies"), F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"))
    return grouped.select("conv_id", "n_turns", "copies", F.array_join("all.said", "").alias("chat"))


def op4_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximal conversations of the table, rendered; see ``render`` for nulls, ties, repeats and long ones. Other columns are not read; an empty table gives an empty one."""
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP4_SQL = """
WITH t AS (SELECT conv_id, coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') AS turn_key,
                  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT conv_id, pos, string_agg(turn_key, chr(2)) OVER (PARTITION BY conv_id ORDER BY pos) AS pre,
             count(*) OVER (PARTITION BY conv_id) AS n FROM t),
f AS (SELECT pos, pre, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE pos = n GROUP BY pos, pre),
m AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = f.pos AND p.pre = f.pre))
SELECT m.conv_id, count(*) AS n_turns, any_value(m.copies) AS copies, string_agg(t.said, '' ORDER BY t.pos) AS chat
FROM m JOIN t ON t.conv_id = m.conv_id GROUP BY m.conv_id
"""
