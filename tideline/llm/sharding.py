"""Sharding by longest-processing-time scheduling.

Rows with equal texts form a group that stays together. Groups, largest first,
go to the least loaded shard, which a heap yields. The schedule is made over the
histogram of group sizes (sizes of 64 KB and more share a bin with those up to
1/1024 larger), which stays small however many groups there are: a bin is dealt
as runs of equal jobs, and each group then finds its shard by its rank in its bin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.ranking import parts_for, ranked
from tideline.llm.storage import stored

#: Sizes below this have bins of their own; above, 1024 to each doubling.
EXACT = 1 << 16
OVERHEAD = 8


def size_bin(size: F.Column) -> F.Column:
    return F.when(size < EXACT, size).otherwise(F.lit(EXACT) + F.floor(F.log2(size / F.lit(float(EXACT))) * 1024)).cast("long")


def schedule(bins: list[tuple[int, int, int]], shards: int) -> Iterator[tuple[int, int, int, list[int]]]:
    """bins: (bin, groups, bytes). Yields (bin, first rank, width, shards): the first width ranks from there go to the first of these shards, the next width to the second, and so on.

    The heap holds (load, shard). Where a bin has more groups than the loads'
    differences can tell apart, whole rounds of one group for each shard are
    dealt at once, which is what the heap would do one by one. Runs of equal width
    that follow each other share a row: a bin has a row for its rounds and few more.
    """
    heap = [(0.0, s) for s in range(shards)]
    for b, groups, total in sorted(bins, key=lambda x: (-(x[2] / x[1]), x[0])):
        each, at = total / groups, 0
        row: tuple[int, int, int, list[int]] | None = None
        while at < groups:
            spread = max(heap)[0] - heap[0][0]
            rounds = (groups - at) // shards if spread <= each else 0
            if rounds:
                # Within one job of each other: every shard gets one in each round.
                order, width = [s for _, s in sorted(heap)], rounds
                heap = [(load + rounds * each, s) for load, s in heap]
                heapq.heapify(heap)
            else:
                load, s = heapq.heappop(heap)
                # As many as keep this shard the least loaded.
                room = max(1, int((heap[0][0] - load) // each) if heap else groups)
                order, width = [s], min(groups - at, room)
                heapq.heappush(heap, (load + width * each, s))
            if row and row[2] == width:
                row[3].extend(order)
            else:
                if row:
                    yield row
                row = (b, at, width, order)
            at += width * len(order)
        if row:
            yield row


def shard_by_size(docs: DataFrame, shards: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of each row of docs; law: nearly equal bytes.

    size is the text's UTF-8 bytes plus OVERHEAD; a null text has no bytes, the
    crc of no bytes, and forms a group apart from empty texts. Rows that repeat
    an id are rows like others, with slots of their own. Slots in a shard run
    from 0 without gaps. A single group larger than a shard's share is not cut:
    equal texts stay together by contract. An empty table gives none, other columns
    are not looked at, and of a text only its length and hashes move, however long.
    """
    t = F.col(text).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (F.coalesce(F.octet_length(t), F.lit(0)) + OVERHEAD).cast("long").alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h1"), F.conv(F.substring(F.md5(F.coalesce(t, F.lit("null")).cast("binary")), 1, 15), 16, 10).cast("long").alias("h2"), t.isNull().alias("none"))
    key = ["size", "h1", "h2", "none"]
    rows = stored(rows)
    groups = stored(rows.groupBy(*key).agg((F.sum("size")).alias("bytes"), F.count("*").alias("n")).withColumn("bin", size_bin(F.col("bytes"))))
    bins = [(r["bin"], r["n"], r["b"]) for r in groups.groupBy("bin").agg(F.count("*").alias("n"), F.sum("bytes").alias("b")).collect()]
    rows_of = "bin long, since long, width long, order array<int>"
    runs = docs.sparkSession.createDataFrame(pd.DataFrame(schedule(bins, shards), columns=["bin", "since", "width", "order"]), rows_of) if bins else docs.sparkSession.createDataFrame([], rows_of)
    parts = parts_for(sum(n for _, n, _ in bins))
    each = runs.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("since", "width", "order"))).alias("runs"))
    placed = ranked(groups, "bin", key, "rank", parts).join(each, "bin")  # by Spark's own check of the size
    # The run of a rank: the last that begins at or before it.
    run = F.element_at(F.filter("runs", lambda r: r["since"] <= F.col("rank")), -1)
    placed = placed.withColumn("run", run)
    shard = F.get(F.col("run.order"), F.floor((F.col("rank") - F.col("run.since")) / F.col("run.width")).cast("int"))
    shard_of = stored(placed.select(*key, shard.alias("shard")))
    dealt = stored(rows.join(shard_of, key).select("id", "size", "text_crc32", "shard"))
    total = dealt.count()
    return ranked(dealt, "shard", ["id", "text_crc32", "size"], "slot", max(8, -(-parts_for(total) // shards))).select("id", "size", "text_crc32", "shard", "slot")
