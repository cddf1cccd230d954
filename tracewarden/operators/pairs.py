"""All pairs of sets, block against block, where a join on what they share would make a row of every shared item."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewarden.plans.storage import cut

LARGEST = 8192  # sets of a block
ITEMS = 4_000_000  # items of a block, about


def shared_counts() -> Callable:
    """shared(a, b) for lists as (lengths, values): yields (first, counts) for ranges of a's sets, where counts[x, y] is how
    many items set first + x has in common with set y of b. Made inside, so that workers need not import this module."""
    import numpy as np

    def dense(lengths, values, items):
        out = np.zeros((len(lengths), len(items)), np.float32)
        at = np.minimum(np.searchsorted(items, values), len(items) - 1)
        here = items[at] == values
        out[np.repeat(np.arange(len(lengths)), lengths)[here], at[here]] = 1
        return out

    def shared(a, b, tile: int = 512, cells: int = 1 << 24):
        (al, av), (bl, bv) = a, b
        items, start = np.intersect1d(av, bv), np.concatenate(([0], np.cumsum(al)))
        step = max(64, cells // max(1, len(bl)))
        parts = [items[c : c + step] for c in range(0, len(items), step)]
        whole = dense(bl, bv, parts[0]) if len(parts) == 1 else None
        for lo in range(0, len(al), tile):
            own = al[lo : lo + tile], av[start[lo] : start[min(lo + tile, len(al))]]
            n = np.zeros((len(own[0]), len(bl)), np.int32)
            for p in parts:
                n += (dense(*own, p) @ (dense(bl, bv, p) if whole is None else whole).T).astype(np.int32)
            yield lo, n

    return shared


def in_blocks(sets: DataFrame, order: str) -> Callable[[Callable, str], DataFrame]:
    """over(kernel, schema): what kernel(left, right, same) yields as record batches over all pairs of blocks of rows of sets.

    left and right map columns to Arrow arrays, and columns that are arrays (of numbers, each once) to (lengths, values).
    Blocks are runs in order of a column, so a row of left comes before one of right; where `same`, both are one block. A task
    holds two blocks, whose rows and items are bounded whatever the input, and blocks are small enough for some hundred pairs.
    """
    lists = [f.name for f in sets.schema if f.dataType.typeName() == "array"]
    items = sum((F.size(c) for c in lists), F.lit(1))
    numbered = cut(sets.orderBy(order).withColumn("_at", F.monotonically_increasing_id()))  # numbers must not change
    n, total = numbered.agg(F.count("*"), F.coalesce(F.sum(items), F.lit(0))).first()
    size = min(LARGEST, max(64, -(-n // 24)), max(1, ITEMS * n // max(1, total)))
    block = F.shiftright("_at", 33) * (1 << 33) + F.floor(F.col("_at").bitwiseAND((1 << 33) - 1) / size)  # of one part each
    packed = cut(numbered.groupBy(block.alias("i")).agg(F.sort_array(F.collect_list(F.struct("_at", *sets.columns))).alias("s")))
    ids = sorted(r["i"] for r in packed.select("i").collect())
    known = F.array(*map(F.lit, ids)).cast("array<long>")
    left = packed.select("i", F.explode(F.filter(known, lambda x: x >= F.col("i"))).alias("j"), F.col("s").alias("left"))
    right = packed.select(F.explode(F.filter(known, lambda x: x <= F.col("i"))).alias("i"), F.col("i").alias("j"), F.col("s").alias("right"))
    parts = max(1, min(4096, len(ids) * (len(ids) + 1) // 2))
    both = left.repartition(parts, "i", "j").join(right.repartition(parts, "i", "j").hint("merge"), ["i", "j"])

    def over(kernel: Callable, schema: str) -> DataFrame:
        def run(batches):
            def columns(cell):
                rows = cell.values
                named = dict(zip([f.name for f in rows.type], rows.flatten(), strict=True))
                return {k: (v.value_lengths().to_numpy(zero_copy_only=False), v.flatten().to_numpy(zero_copy_only=False)) if k in lists else v for k, v in named.items()}

            for batch in batches:
                for k in range(batch.num_rows):
                    yield from kernel(columns(batch["left"][k]), columns(batch["right"][k]), batch["i"][k].as_py() == batch["j"][k].as_py())

        return both.select("i", "j", "left", "right").mapInArrow(run, schema)

    return over
