"""Chat formatting: cumulative snapshots are collapsed, then conversations are rendered.

A log that stores a conversation again after every turn holds each prefix of it.
A turn's hash covers its number, role and text; the rolling hash of a prefix is
the running sum of its turns' hashes, kept as two 128-bit-wide decimal sums next
to the number of rows. A conversation whose whole hash is the hash of a proper
prefix of any conversation goes by an anti-join; of equal conversations, that
with the smallest conv_id stays. What is left is maximal and is rendered:

    <|im_start|>role<newline>text<|im_end|><newline>

for every turn in order; ``<|`` inside a role or a text becomes ``< |``.

Running sums are taken in blocks of 1024 turn numbers with block totals
added, so a conversation of any length is not one window. Prefix hashes are made
distinct before they are compared, so a first turn that many share is one row.
Only DataFrame functions are used.

Edge cases: a null turn is turn -1; a null role or text is ''; rows of one turn
are ordered by role and text and rendered all, also if they repeat; prefixes end
at whole turns; rows with a null conv_id are one conversation, whose id comes
last among equals; other columns are not read; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BLOCK = 1024


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n, s1, s2, last): the rolling hash after each turn of each conversation."""
    wide = "decimal(20,0)"
    each = turns.groupBy("conv_id", "turn").agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("turn", "role", "text").cast(wide)).alias("s1"),
        F.sum(F.xxhash64(F.lit(1), "turn", "role", "text").cast(wide)).alias("s2"),
    )
    each = each.withColumn("block", F.floor(F.col("turn") / BLOCK))
    within = Window.partitionBy("conv_id", "block").orderBy("turn")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    follows = Window.partitionBy("conv_id").orderBy("block")
    blocks = each.groupBy("conv_id", "block").agg(
        *[F.sum(c).alias(c) for c in ("n", "s1", "s2")], F.max("turn").alias("last_turn")
    )
    blocks = blocks.select(
        F.col("conv_id").alias("_conv"),
        F.col("block").alias("_block"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in ("n", "s1", "s2")],
        F.when(F.lead("block").over(follows).isNull(), F.col("last_turn")).alias("_last"),
    )
    same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block"))
    total = lambda c: (F.sum(c).over(within) + F.col(f"_{c}")).cast("decimal(38,0)").alias(c)
    return each.join(blocks, same).select(
        "conv_id", "turn", total("n"), total("s1"), total("s2"), F.col("turn").eqNullSafe(F.col("_last")).alias("last")
    )


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, copies, rendered: one row per conversation that stays."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(
        "conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"), text("role"), text("text")
    )
    rolling = prefixes(turns)
    key = ["n", "s1", "s2"]
    proper = rolling.filter(~F.col("last")).select(*key).distinct()
    whole = rolling.filter("last").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("copies")
    )
    kept = whole.join(proper, key, "left_anti").select(F.col("conv_id").alias("_conv"), "copies")
    safe = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    line = F.concat(F.lit("<|im_start|>"), safe("role"), F.lit("\n"), safe("text"), F.lit("<|im_end|>\n"))
    rows = turns.withColumn("line", line).join(kept, F.col("conv_id").eqNullSafe(F.col("_conv")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line")))
    return (
        rows.groupBy("conv_id", "copies")
        .agg(ordered.alias("l"))
        .select(
            "conv_id",
            F.size("l").cast("long").alias("n_turns"),
            "copies",
            F.array_join(F.transform("l", lambda t: t["line"]), "").alias("rendered"),
        )
    )


ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations),
c AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
    list({'t': turn, 'r': role, 'x': text} ORDER BY turn, role, text) AS l,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |')
      || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered
  FROM t GROUP BY conv_id),
p AS (SELECT DISTINCT l[1:i] AS l FROM (SELECT l, unnest(range(1, len(l))) AS i FROM c)),
w AS (SELECT l, min(conv_id) AS conv_id, count(*)::BIGINT AS copies FROM c GROUP BY l)
SELECT c.conv_id, c.n_turns, w.copies, c.rendered
FROM w JOIN c ON c.conv_id = w.conv_id WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l = w.l)
"""
