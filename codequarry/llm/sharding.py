"""Proportional stratified interleaving, in DataFrame functions alone.

Rows of each source take a seeded random order. A row's fraction is its rank there, moved by an offset of the source between 0 and 1, over
the size of the source, so that sorting all rows by fraction spreads every source evenly over the order, and equal cuts of the order follow
the mixture. Offsets of sources of one size are spread evenly too: many small sources share out over all shards. Shard sizes differ by
one row at most (the law `rows`), and a shard's share of a source differs from the mixture by about one row.

No source and no fraction is ranked in one task. A rank is the number of rows in smaller cells plus the rank inside a cell; cells are cut
by the seeded hash, or by the fraction, so that each holds about CELL rows whatever the skew of the sources, and only the table of cell
sizes, a row for each cell, is added up over cells. The seeded hash is of the row's id, text and number among its like, so that rows
without an id, or alike in everything, don't meet in one cell either.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

SHARDS, SEED, CELL = 24, "interleave-2", 2_000
#: Bits of the seeded hash, of an offset, and of a fraction.
_BITS, _OFFSET, _FRACTION = 60, 20, 40
#: Step between the offsets of neighbouring sources of one size: the golden section of 2**20, made odd.
_STEP = 648_055
#: Like rows that are numbered together.
_RUN = 4_096


def _draw(*parts: Column) -> Column:
    """A seeded hash of 60 bits."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), *parts).cast("binary")), 1, _BITS // 4), 16, 10).cast("long")


def _cell(draw: str, bits: int, cells: int) -> Column:
    return F.floor(F.col(draw) / F.lit((1 << bits) // cells + 1))


def _ranked(rows: DataFrame, group: list[str], cell: str, order: list[Column], name: str, of_groups: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows with `name`, the rank from 0 by (cell, *order) inside each group, and, if of_groups is given, with what it adds to the table of
    groups and their sizes (`of`)."""
    sizes = rows.groupBy(*group, cell).agg(F.count(F.lit(1)).alias("_n"))
    # Running totals by blocks of cells first, so that no task adds up more than about the square root of the cells.
    block = sizes.withColumn("_block", F.floor(F.col(cell) / 1024))
    of_block = block.groupBy(*group, "_block").agg(F.sum("_n").alias("_b"))
    part = lambda *cols: Window.partitionBy(*(cols or (F.lit(0),)))
    up = lambda w, by: w.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    of_block = of_block.withColumn("_skip", F.coalesce(F.sum("_b").over(up(part(*group), "_block")), F.lit(0))).drop("_b")
    inner = block.withColumn("_in", F.coalesce(F.sum("_n").over(up(part(*group, "_block"), cell)), F.lit(0)))
    base = inner.join(of_block, [*group, "_block"]).select(*group, cell, (F.col("_skip") + F.col("_in")).alias("_base"))
    if of_groups is not None:  # this reaches a group's rows by way of its cells, so that a hot group isn't joined in one task
        base = base.join(of_groups(sizes.groupBy(*group).agg(F.sum("_n").alias("of"))), group)
    inside = rows.withColumn("_at", F.row_number().over(Window.partitionBy(*group, cell).orderBy(*order)) - 1)
    return inside.join(base, [*group, cell]).withColumn(name, (F.col("_base") + F.col("_at")).cast("long")).drop("_base", "_at")


def _offsets(sources: DataFrame, cells: int) -> DataFrame:
    """sources (stratum, of) with their offsets in 2**20ths: sources of one size, in seeded order, are a golden section apart."""
    drawn = sources.withColumn("draw", _draw(F.lit("source:"), F.col("stratum"))).withColumn("cell", _cell("draw", _BITS, cells))
    ranked = _ranked(drawn, ["of"], "cell", [F.col("draw"), F.col("stratum")], "nth")
    first = _draw(F.lit("size:"), F.col("of").cast("string"))
    return ranked.select("stratum", "of", F.pmod(F.col("nth") * _STEP + F.pmod(first, F.lit(1 << _OFFSET)), F.lit(1 << _OFFSET)).alias("offset"))


def _fraction(rank: str, offset: str, of: str) -> Column:
    """(rank + offset / 2**20) / of, as a 40-bit whole number: exact, so that every engine sorts alike. The product needs more than 64 bits."""
    up = 1 << (_FRACTION - _OFFSET)
    return F.expr(f"cast(cast({rank} * {1 << _OFFSET}L + {offset} as decimal(20, 0)) * cast({up} as decimal(8, 0)) div cast({of} as decimal(20, 0)) as long)")


def interleaved(docs: DataFrame, shards: int = SHARDS, cell: int = CELL) -> DataFrame:
    """doc_id, source, size, text_crc32, shard, slot for every row of docs (doc_id, text, source; other columns are ignored).

    size: UTF-8 bytes of the text plus 8; a null text counts as an empty one. A null source is a source of its own. Rows with one
    doc_id, or with none, are told apart by their texts, and rows alike in id, text and source by numbers that they take in any order.
    An empty table gives an empty result; with fewer rows than shards, some shards are empty. Texts may be of any length: they are read
    once, for a size and two digests.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(text.cast("binary")).alias("digest"),
    )
    like = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    like = like.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {_RUN}"))))
    like = like.withColumn("copy", F.explode(F.expr(f"sequence(run * {_RUN}, least(n, (run + 1) * {_RUN}) - 1)")))
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(":"), F.col("copy").cast("string")]
    rows = like.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("stratum"), *rows.columns[:-1], _draw(*key).alias("draw"))
    rows = written(rows, "interleave")
    n = rows.count()
    cells = max(1, n // cell)
    rows = rows.withColumn("cell", _cell("draw", _BITS, cells))
    rows = written(_ranked(rows, ["stratum"], "cell", [F.col("draw")], "rank", lambda sources: _offsets(sources, cells)), "interleave")
    rows = rows.drop("cell").withColumn("fraction", _fraction("rank", "offset", "of"))
    rows = rows.withColumn("cell", _cell("fraction", _FRACTION, cells))
    rows = _ranked(rows, [], "cell", [F.col("fraction"), F.col("stratum"), F.col("rank")], "place")
    shard = F.expr(f"place * {shards} div {max(n, 1)}").cast("int")
    return rows.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", "shard", F.expr(f"place - (shard * cast({n} as long) + {shards - 1}) div {shards}").cast("long").alias("slot")
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleaved(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def _draw_sql(parts: str) -> str:
    return f"('0x' || substr(md5('{SEED}:' || {parts}), 1, {_BITS // 4}))::BIGINT"


#: Every column but text_crc32, which DuckDB has no function for: the tests compare with this, and with zlib for the rest.
ORACLE_OP4 = f"""
WITH like_rows AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS stratum, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS copy
  FROM documents),
drawn AS (SELECT *, {_draw_sql("coalesce(doc_id::VARCHAR, 'null') || ':' || digest || ':' || copy")} AS draw FROM like_rows),
sources AS (SELECT stratum, count(*) AS n_of FROM drawn GROUP BY stratum),
offsets AS (
  SELECT *, ((row_number() OVER (PARTITION BY n_of ORDER BY {_draw_sql("'source:' || stratum")}, stratum) - 1) * {_STEP} + {_draw_sql("'size:' || n_of")} % {1 << _OFFSET}) % {1 << _OFFSET} AS shift
  FROM sources),
ranked AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY draw) - 1 AS rank FROM drawn JOIN offsets USING (stratum)),
placed AS (
  SELECT *, row_number() OVER (ORDER BY ((rank * {1 << _OFFSET} + shift)::HUGEINT * {1 << (_FRACTION - _OFFSET)} // n_of), stratum, rank) - 1 AS place, count(*) OVER () AS n
  FROM ranked),
cut AS (SELECT *, (place * {SHARDS} // n)::INTEGER AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, 'rows' AS law, shard, (place - (shard * n + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, source FROM cut
"""
