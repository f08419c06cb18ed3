"""Multi-party perspective rotation: every participant's view of a dialogue as a training text with a loss mask.

In the view of a participant, their own turns are the assistant's and carry loss; the turns of all others are a named user's and carry
none. A view holds the whole dialogue. Only one of more than PART_BYTES bytes, which no single text can hold at any size, goes on in a next
part, a sample of its own, as does a dialogue beyond `window` turns if a window is asked for; every turn is in one part of every view. All in
DataFrame functions: a turn is rendered once for each view, and the pieces of one sample meet in one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Bytes of turns after which a dialogue goes on in a next part, bytes that a turn counts besides its role and text, turns of a cell.
PART_BYTES, TURN, CELL = 16 << 20, 64, 4_096
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: What an own turn begins with.
OWN = f"{OPEN}assistant\n"


def _escaped(c):
    """Markers in the data can't be taken for markers of the format."""
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<¦$1¦>")


def rotated(turns: DataFrame, window: int | None = None, part_bytes: int = PART_BYTES, cell: int = CELL) -> DataFrame:
    """Views of turns (conv_id, turn, role, text; other columns are ignored): a row for each conversation, part and participant.

    Returns conv_id, part (from 0; there is one alone unless the dialogue is longer than part_bytes, or than window turns), speaker, n_turns, n_own, text, mask (array of [start, end) in characters of text that
    carry loss, one for each own turn: its content and its end marker). Participants are the distinct roles of the conversation; a null
    role is the participant 'unknown'. A null text is an empty turn. Turns are ordered by turn, role, text; nulls come first, repeated
    turns stay. A null conv_id is a conversation of its own. A view whose speaker is silent in a part has an empty mask there. A turn is
    never cut, so a very long text makes a part longer than part_bytes. An empty table gives an empty result.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))
    # Rank in two steps: cells of turn numbers, then inside a cell, so that a huge conversation is ranked in many tasks.
    rows = rows.withColumn("cell", F.coalesce(F.floor(F.col("turn") / cell), F.lit(-(1 << 62))))
    rows = rows.withColumn("bytes", F.octet_length("text") + F.octet_length("role") + TURN)
    cells = rows.groupBy("key", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("key", "cell", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("n", "b")])
    inside = Window.partitionBy("key", "cell").orderBy("turn", "role", "text")
    rows = rows.withColumns({"at": F.row_number().over(inside) - 1, "to": F.sum("bytes").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")})
    rows = rows.join(cells, ["key", "cell"]).withColumn("rank", F.col("n_before") + F.col("at"))
    rows = rows.withColumn("part", F.floor(F.col("rank") / window) if window else F.floor((F.col("b_before") + F.col("to")) / part_bytes))
    named = lambda role: F.concat(F.lit(f"{OPEN}user name="), _escaped(role), F.lit("\n"))
    tail = lambda text: F.concat(_escaped(text), F.lit(CLOSE))
    # Where a turn would begin in its part if all turns were those of others.
    before = Window.partitionBy("key", "part").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length(named(F.col("role"))) + F.length(tail(F.col("text"))) + 1).over(before), F.lit(0))
    rows = rows.select("key", "conv_id", "part", "rank", "role", "text").withColumn("at", at)
    sample = rows.groupBy("key", "part").agg(
        F.first("conv_id").alias("conv_id"), F.sort_array(F.collect_list(F.struct("rank", "role", "text", "at"))).alias("turns")
    )
    speakers = rows.select("key", F.col("role").alias("speaker")).distinct()
    views = sample.join(speakers, "key")
    own = lambda t: t["role"] == F.col("speaker")
    head = lambda t: F.when(own(t), OWN).otherwise(named(t["role"]))
    # Own turns have all one name, so the k-th of them begins k times the same difference further on than in `at`.
    less = F.lit(len(OWN)) - F.length(named(F.col("speaker")))
    start = lambda t, k: t["at"] + k * less + len(OWN)
    spans = F.transform(F.filter("turns", own), lambda t, k: F.struct(start(t, k).cast("int").alias("start"), (start(t, k) + F.length(tail(t["text"]))).cast("int").alias("end")))
    return views.select(
        "conv_id", F.col("part").cast("long").alias("part"), "speaker", F.size("turns").cast("long").alias("n_turns"),
        F.size(F.filter("turns", own)).cast("long").alias("n_own"),
        F.concat_ws("", F.transform("turns", lambda t: F.concat(head(t), tail(t["text"]), F.lit("\n")))).alias("text"),
        spans.alias("mask"),
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rotated(table(spark, sf_dir, "conversations"))
    return out.withColumn("mask", F.concat_ws(" ", F.transform("mask", lambda s: F.concat_ws("-", s["start"], s["end"]))))


_ESC = "regexp_replace({}, '<\\|(im_start|im_end)\\|>', '<¦\\1¦>', 'g')"
ORACLE_OP10 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
r AS (
  SELECT *, row_number() OVER w - 1 AS rank, sum(strlen(role) + strlen(text) + {TURN}) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - strlen(role) - strlen(text) - {TURN} AS before
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
v AS (
  SELECT r.conv_id, (before // {PART_BYTES})::BIGINT AS part, rank, speaker, role = speaker AS own,
    '{OPEN}' || CASE WHEN role = speaker THEN 'assistant' ELSE 'user name=' || {_ESC.format('role')} END || chr(10) AS head,
    {_ESC.format('text')} || '{CLOSE}' AS tail
  FROM r JOIN s ON r.conv_id IS NOT DISTINCT FROM s.conv_id),
p AS (
  SELECT *, coalesce(sum(length(head) + length(tail) + 1) OVER (PARTITION BY conv_id, part, speaker ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM v)
SELECT conv_id, part::BIGINT AS part, speaker, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  string_agg(head || tail || chr(10), '' ORDER BY rank) AS text,
  coalesce(string_agg(start::BIGINT || '-' || (start + length(tail))::BIGINT, ' ' ORDER BY rank) FILTER (own), '') AS mask
FROM p GROUP BY conv_id, part, speaker
"""
