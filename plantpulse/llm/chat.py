"""Chat formatting by cumulative-snapshot collapse (native DataFrame code only).

A chat service logs a conversation again after every exchange, so the log
holds many conversations that are prefixes of longer ones. Every prefix of a
conversation gets a rolling hash; a conversation whose whole hash is a proper
prefix hash of another is dropped by an anti-join, identical conversations
keep the smallest id, and only the maximal ones are rendered.

Defined cases: turns are ordered by (turn, role, text), NULLs first; exact
repeated rows of a conversation count once; NULL role renders as ``unknown``
and NULL text as empty, but both stay distinct from '' when hashes are
compared; rows with a NULL conversation id form one conversation, like any
SQL group; an empty table gives an empty result. Template markers inside a
text are broken up so that no text can open or close a turn.

A rendered conversation is one row, so its turns meet in one task; everything
that spans conversations (common first turns, thousands of copies) is
pre-aggregated by hash before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import llm_query, table

#: Turn template and the marker that must not occur inside a text.
OPEN, CLOSE, MARKER, BROKEN = "<|im_start|>", "<|im_end|>", "<|im_", "<| im_"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, msgs): the ordered distinct turns of each conversation."""
    msg = F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"),
                   F.col("text").cast("string").alias("text"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_set(msg)).alias("msgs"))


def prefix_hashes(convs: DataFrame) -> DataFrame:
    """One row per turn prefix: (conv_id, k, h1, h2, whole). The hash of a
    prefix is the exclusive-or of its (position, role, text) hashes under two
    seeds, so it rolls forward by one term per turn. The rows stay in the
    hash partitioning of ``conv_id``: no shuffle."""
    one = convs.select("conv_id", F.size("msgs").alias("n"), F.posexplode("msgs").alias("pos", "m"))
    parts = [F.col("pos"), F.col("m.role").isNull(), F.coalesce(F.col("m.role"), F.lit("")),
             F.col("m.text").isNull(), F.coalesce(F.col("m.text"), F.lit(""))]
    upto = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return one.select("conv_id", (F.col("pos") + 1).alias("k"), (F.col("pos") + 1 == F.col("n")).alias("whole"),
                      F.bit_xor(F.xxhash64(F.lit(1), *parts)).over(upto).alias("h1"),
                      F.bit_xor(F.xxhash64(F.lit(2), *parts)).over(upto).alias("h2"))


def collapse(turns: DataFrame) -> DataFrame:
    """Maximal conversations: (conv_id, n_copies, msgs)."""
    convs = conversations(turns)
    hashes = prefix_hashes(convs)
    key = ["k", "h1", "h2"]
    whole = (hashes.where("whole").groupBy(*key)
             .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies")))
    inner = hashes.where(~F.col("whole")).groupBy(*key).agg(F.count(F.lit(1)).alias("n_longer")).drop("n_longer")
    kept = whole.join(inner, key, "left_anti").select(F.col("conv_id").alias("kept_id"), "n_copies")
    return (convs.join(kept, convs.conv_id.eqNullSafe(kept.kept_id))
            .select("conv_id", "n_copies", "msgs"))


def render(convs: DataFrame, open_: str = OPEN, close: str = CLOSE) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) by a turn template."""
    def line(m):
        body = F.replace(F.coalesce(m["text"], F.lit("")), F.lit(MARKER), F.lit(BROKEN))
        return F.concat(F.lit(open_), F.coalesce(m["role"], F.lit("unknown")), F.lit("\n"), body,
                        F.lit(close + "\n"))
    return convs.select("conv_id", F.size("msgs").cast("long").alias("n_turns"), "n_copies",
                        F.array_join(F.transform("msgs", line), "").alias("rendered"))


SQL = """
WITH m AS (
  SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS msgs
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id),
inner_prefixes AS (
  SELECT DISTINCT msgs[1:k] AS msgs FROM m, LATERAL (SELECT unnest(range(1, len(msgs))) AS k)),
whole AS (SELECT min(conv_id) AS conv_id, count(*) AS n_copies, msgs FROM m GROUP BY msgs)
SELECT conv_id, len(msgs)::BIGINT AS n_turns, n_copies,
       array_to_string(list_transform(msgs, lambda x: '<|im_start|>' || coalesce(x.role, 'unknown') || chr(10)
         || replace(coalesce(x.text, ''), '<|im_', '<| im_') || '<|im_end|>' || chr(10)), '') AS rendered
FROM whole WHERE NOT EXISTS (SELECT 1 FROM inner_prefixes p WHERE p.msgs = whole.msgs)
"""


@llm_query("op9_chat_snapshots", SQL)
def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maximal logged conversations, rendered."""
    return render(collapse(table(spark, sf_dir, "conversations")))
