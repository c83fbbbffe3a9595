"""Sharding by minimax contiguous partition of ordered groups (DataFrame functions only)."""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Bins of the prefix sums that one search round looks at: a constant, whatever the number of groups.
SEARCH_BINS = 1 << 15


class _Prefixes:
    """Bounds on `the largest prefix sum <= x`, from bins that hold their smallest and largest sum."""

    def __init__(self, rows: list[tuple[int, int]]):
        self.low, self.high = [r[0] for r in rows], [r[1] for r in rows]

    def bounds(self, x: int) -> tuple[int, int]:
        i = bisect.bisect_right(self.low, x) - 1
        if i < 0:
            return 0, 0
        return (self.high[i],) * 2 if self.high[i] <= x else (self.low[i], min(self.high[i], x))

    def walk(self, capacity: int, lead: int, total: int, shards: int) -> tuple[list[int], list[int]]:
        """Lower and upper bounds on the greedy cuts: no shard above `capacity`, no cut more than `lead` beyond its even share."""
        least, most = [0], [0]
        for k in range(1, shards + 1):
            share = total * k // shards + lead
            least.append(self.bounds(min(least[-1] + capacity, share))[0])
            most.append(self.bounds(min(most[-1] + capacity, share))[1])
        return least[1:], most[1:]


def _smallest(test, low: int, high: int) -> int:
    """The smallest value in (low, high] that passes; `high` passes, `low` does not."""
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if test(mid) else (mid, high)
    return high


def _search(sums: DataFrame, total: int, walk, low: int, high: int) -> tuple[int, list[int]]:
    """The smallest value in (low, high] at which the greedy cuts reach `total`, and these cuts.

    The driver searches over at most SEARCH_BINS bins of prefix sums; each round then looks closer, only at where cuts
    can still lie, until all bounds are exact. A round is one aggregation; the groups never leave the executors.
    """
    windows = [(0, total)]
    while True:
        span = sum(b - a + 1 for a, b in windows)
        width = max(1, -(-span // SEARCH_BINS))
        inside = F.lit(False)
        for a, b in windows:
            inside = inside | F.col("prefix").between(a, b)
        bins = sums.filter(inside).groupBy(F.floor(F.col("prefix") / width).alias("bin")).agg(F.min("prefix").alias("low"), F.max("prefix").alias("high"))
        known = _Prefixes(sorted((r["low"], r["high"]) for r in bins.collect()))
        feasible = _smallest(lambda c: walk(known, c)[0][-1] >= total, low, high)
        low = _smallest(lambda c: walk(known, c)[1][-1] >= total, low, feasible) - 1
        high = feasible
        if high - low == 1:
            least, most = walk(known, high)
            if least == most:
                return high, least
        else:
            least, most = walk(known, low)[0], walk(known, high)[1]
        windows = []
        for a, b in zip(least, most):
            if windows and a <= windows[-1][1]:
                windows[-1] = (windows[-1][0], max(b, windows[-1][1]))
            else:
                windows.append((a, b))


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """The cuts of `shards` contiguous shards at the smallest capacity that fits them.

    sums: one row for each group, `prefix` = bytes up to and with it. The capacity is binary-searched, each value checked
    greedily. Of the partitions that it allows, the one whose cuts run least ahead of even shares is taken, so that the
    last shards don't go short.
    """
    if not total:
        return [0] * shards
    share = -(-total // shards)
    capacity, _ = _search(sums, total, lambda known, c: known.walk(c, total, total, shards), max(share, largest) - 1, share + largest)
    return _search(sums, total, lambda known, lead: known.walk(capacity, lead, total, shards), -1, total)[1]


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", bins: int = 256) -> DataFrame:
    """Put documents into `shards` shards of near equal bytes; equal texts stay together.

    Groups are the distinct texts in the order of their digests, a row's size is its UTF-8 bytes plus 16. The smallest
    feasible capacity of a contiguous partition is searched, with a greedy check, and the groups are cut there.
    Returns doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    A missing text counts as an empty one, and goes with empty texts. Ids may be missing or repeat: each row gets a slot
    of its own. An empty table gives an empty result; with fewer groups than shards, the last shards stay empty. Other
    columns are not read. Documents are read once; after that only digests and sizes move. A group of any number of
    copies is summed before the shuffle, and its rows are numbered in `bins` tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.md5(text).alias("digest"),
    )
    rows = common.store(common.with_bin(rows, bins), "rows")
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"))
    part = F.substring("digest", 1, 3)
    so_far = Window.partitionBy("part").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    groups = common.store(groups.withColumn("part", part).withColumn("in_part", F.sum("bytes").over(so_far)), "groups")
    # at most 16 ** 3 parts, so one task may sum them up
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = groups.groupBy("part").agg(F.max("in_part").alias("of_part"))
    parts = parts.select("part", F.coalesce(F.sum("of_part").over(before), F.lit(0)).alias("before"))
    sums = groups.join(F.broadcast(parts), "part").select("digest", (F.col("before") + F.col("in_part")).alias("prefix"))
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()
    cuts = sorted(set(minimax_cuts(sums, total, largest, shards)))
    ends = [r["digest"] for r in sums.filter(F.col("prefix").isin(cuts)).select("digest").collect()]  # one for each cut
    shard = sum((F.when(F.col("digest") > e, 1).otherwise(0) for e in sorted(ends)), F.lit(0))
    placed = rows.withColumn("shard", shard.cast("int"))
    placed = common.number_within(placed, ["shard"], ["doc_id", "digest"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op8_query(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 39 by the `bytes` law."""
    out = shard_documents(common.table(spark, sf_dir, "documents"), shards=40)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
