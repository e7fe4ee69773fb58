"""Narrowing a huge table to what many requests may name, before anything of it is shuffled.

A Bloom filter of the requested values is sent to every task of the scan. Its size is bounded
whatever the number of requests: beyond the bound it only lets more rows through, and the
exact join after it drops those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A block of the filter is 64 words of 64 bits; a value sets ``TESTS`` bits of one block.
WORDS, TESTS = 64, 5
BITS_A_VALUE = 16
#: At most so many blocks, 16 MB.
MOST_BLOCKS = 1 << 15


def _places(value: Column, n_blocks: int) -> tuple[Column, Column]:
    """The block of a value, and its bits in it."""
    block = F.pmod(F.xxhash64(value), F.lit(n_blocks)).cast("int")
    other = F.xxhash64(F.lit("bits"), value)
    bits = [F.shiftrightunsigned(other, 12 * i).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for i in range(TESTS)]
    return block, F.array(*bits)


def bloom_blocks(values: DataFrame, n: int, most_blocks: int = MOST_BLOCKS) -> tuple[DataFrame, int]:
    """``_block, _words`` of a filter of the one column of ``values``, about ``n`` of them, and the number of
    blocks. Nulls are not in it."""
    n_blocks = max(1, min(most_blocks, -(-n * BITS_A_VALUE // (64 * WORDS))))
    value = F.col(values.columns[0])
    block, bits = _places(value, n_blocks)
    placed = values.where(value.isNotNull()).select(block.alias("_block"), F.explode(bits).alias("_bit"))
    words = placed.groupBy("_block", F.shiftright("_bit", 6).alias("_word")).agg(
        F.bit_or(F.expr("shiftleft(1L, _bit & 63)")).alias("_set")
    )
    by_word = F.map_from_entries(F.collect_list(F.struct("_word", "_set")))
    blocks = words.groupBy("_block").agg(by_word.alias("_by_word"))
    every = F.expr(f"transform(sequence(0, {WORDS - 1}), w -> coalesce(element_at(_by_word, w), 0L))")
    return blocks.select("_block", every.alias("_words")), n_blocks


def possibly_in(
    rows: DataFrame,
    column: str,
    asked: DataFrame,
    n: int | None = None,
    most_blocks: int = MOST_BLOCKS,
) -> DataFrame:
    """The rows whose ``column`` may be among the values of the one column of ``asked``.

    Every row whose value is asked for stays; of the others about one in a thousand does
    while ``asked`` has fewer values than the filter has room for (8 million as it is by
    default), and more beyond. Rows without a value go. ``n`` is the number of values, or a bound on it; without
    it the rows of ``asked`` are counted.
    """
    n = asked.count() if n is None else n
    blocks, n_blocks = bloom_blocks(asked, n, most_blocks)
    block, bits = _places(F.col(column), n_blocks)
    test = F.expr("forall(_bits, b -> getbit(element_at(_words, cast(shiftright(b, 6) AS int) + 1), b & 63) = 1)")
    marked = rows.where(F.col(column).isNotNull()).withColumns({"_block": block, "_bits": bits})
    return marked.join(F.broadcast(blocks), "_block").where(test).select(*rows.columns)


def narrowed(
    inventory: DataFrame, requests: DataFrame, *names: str, most_blocks: int = MOST_BLOCKS
) -> DataFrame:
    """The inventory's rows that may carry a requested project name, for more requests than a
    broadcast holds. Name and owner lookups give the same results on them."""
    asked = None
    for name in names or ("project_name",):
        one = requests.select(F.lower(F.col(name)).alias("project_name"))
        asked = one if asked is None else asked.union(one)
    return possibly_in(inventory, "project_name", asked, most_blocks=most_blocks)
