"""Distinct texts of a table in blocks of bounded size, for tables that are compared with all documents a block at a time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_blocks(rows: DataFrame, block_chars: int) -> Iterator[tuple[list[str], bool]]:
    """(sorted distinct texts that are not null, whether these are the last) of about `block_chars` characters at most, one block at least.

    Texts are hashed to sixteen slots a block, whose sizes are counted; neighbouring slots are put together up to `block_chars`.
    """
    texts = rows.select(F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    slots = 16 * max(1, -(-(texts.agg(F.sum(F.length("text") + 1)).first()[0] or 0) // block_chars))
    slot = F.pmod(F.xxhash64("text"), F.lit(slots))
    blocks, held = [[]], 0
    for r in texts.groupBy(slot.alias("slot")).agg(F.sum(F.length("text") + 1).alias("c")).orderBy("slot").collect():
        if blocks[-1] and held + r["c"] > block_chars:
            blocks.append([])
            held = 0
        blocks[-1].append(r["slot"])
        held += r["c"]
    for b in blocks:
        part = texts.filter((slot >= b[0]) & (slot <= b[-1])).orderBy("text").collect() if b else []
        yield [r["text"] for r in part], b is blocks[-1]
