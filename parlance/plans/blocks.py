"""File-order blocks: the unit in which a chat of any size is spread over tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.plans.once import once

BLOCK_ROWS = 1 << 16
#: Rows of a block whose rows share their lookups, and of the runs such blocks are made of.
PACK_ROWS, RUN_ROWS = 1 << 9, 1 << 6
#: Blocks of a task.
TASK_BLOCKS = 1 << 4
#: Blocks that may ask for one key before its rows are salted.
KEY_BLOCKS = 1 << 16
#: Cells by hash that the hits of a block lie in.
HIT_CELLS = 256


def block_of(seq: Column, rows: int = BLOCK_ROWS) -> Column:
    return F.floor(seq / F.lit(rows)).cast("bigint")


def attach(
    rows: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str],
    *,
    blocks_from: DataFrame | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Left join a one-row-per-key table to rows that carry ``seq``.

    The join key is (keys, block): a small chat is one block and needs one copy of its row, a huge
    chat gets one copy per block, so no join key ever gathers more than ``block_rows`` rows.
    ``blocks_from`` may name a cheaper frame holding at least the same (keys, seq).
    """
    block = block_of(F.col("seq"), block_rows)
    blocks = (blocks_from if blocks_from is not None else rows).select(
        *keys, block.alias("_block")
    )
    lookup = blocks.distinct().join(per_key, list(keys))
    return (
        rows.withColumn("_block", block)
        .join(lookup, [*keys, "_block"], "left")
        .drop("_block")
    )


def tail(
    rows: DataFrame, n: int, keys: Sequence[str], *, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The last ``n`` rows per key in ``seq`` order.

    Row counts per block decide which blocks are kept whole; only the one block on the edge is
    ranked, so neither the size of ``n`` nor of a chat ends up in one window group.
    """
    keys = list(keys)
    blocked = rows.withColumn("_block", block_of(F.col("seq"), block_rows))
    newest_first = Window.partitionBy(*keys).orderBy(F.desc("_block"))
    before = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    room = (
        blocked.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_room", F.lit(n) - F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_room") > 0)
        .drop("_n")
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(F.desc("seq")))
    return (
        blocked.join(room, [*keys, "_block"])
        .withColumn("_rank", rank)
        .where(F.col("_rank") <= F.col("_room"))
        .drop("_block", "_room", "_rank")
    )


def salted_lookup(
    rows: DataFrame, table: DataFrame, on: str, by: Sequence[str], *, salts: int = 16, how: str = "left"
) -> DataFrame:
    """Join a table that is unique on ``on`` to rows in which one value may be very frequent.

    The rows of one value are spread over ``salts`` join keys (by the hash of ``by``) and the table
    is repeated that often.  Spark takes the copies for as small as the table, so they are never broadcast.
    """
    if salts == 1:
        return rows.join(table, on, how)
    salt = F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    copies = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies.hint("merge"), [on, "_salt"], how).drop("_salt")


def salts_of(blocks: int) -> int:
    """Salts for rows that have each value once per block at most: one for every ``KEY_BLOCKS`` blocks."""
    return -(-blocks // KEY_BLOCKS)


def packed(
    rows: DataFrame, keys: Sequence[str], name: str, *, block_rows: int = PACK_ROWS
) -> tuple[DataFrame, int]:
    """Add a block number: blocks hold about ``block_rows`` rows each, whatever the sizes of the chats.
    The number of blocks comes with the rows.  A block lies in one partition, and partitions hold about
    ``TASK_BLOCKS`` blocks, so the memory of a task does not grow with the input.

    Runs of ``RUN_ROWS`` rows of a chat are dealt out by their hash, so small chats share a block
    and a huge one is spread.  One count reaches the driver.
    """
    blocks = max(1, -(-rows.count() // block_rows))
    run = F.xxhash64(*keys, block_of(F.col("seq"), RUN_ROWS))
    return rows.withColumn(name, F.pmod(run, F.lit(blocks))).repartition(_tasks(rows, blocks), name), blocks


def _tasks(rows: DataFrame, blocks: int) -> int:
    """Partitions for so many blocks: some for each core, as blocks differ."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return max(min(blocks, 2 * cores), -(-blocks // TASK_BLOCKS))


def hits_per_block(found: DataFrame, key: str, value: str, blocks: int, block: str = "_block") -> DataFrame:
    """(block, _hits): the distinct keys of each block with their values, in cells by the key's hash.

    Looking a key up in a map compares it with one entry after another; cells keep them few.  The hits
    are dealt out like the rows that ``packed`` cut into ``blocks``, which they are joined to.
    """
    found = found.select(block, key, value).repartition(_tasks(found, blocks), block)
    entry = F.collect_list(F.struct(F.col(key), F.col(value)))
    cells = found.groupBy(block, _cell(F.col(key)).alias("_cell")).agg(F.map_from_entries(entry).alias("_map"))
    every = cells.groupBy(block).agg(F.collect_list(F.struct("_cell", "_map")).alias("_list"))
    every = once(every, "_cells", F.map_from_entries("_list"))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(HIT_CELLS - 1)), lambda i: F.try_element_at("_cells", i))
    return every.select(block, dealt.alias("_hits"))


def hit_of(hits: Column, key: Column) -> Column:
    """The value of a key in the hits of its block, null if there is none."""
    return F.try_element_at(F.get(hits, _cell(key)), key)


def _cell(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HIT_CELLS)).cast("int")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Text work is bound by CPU, and a scan of few files may offer fewer splits than cores; an input
    with enough splits is left alone and pays no shuffle.  Meant for plain scans: asking a plan with
    shuffles for its partitions would run them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
