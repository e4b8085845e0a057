"""Operator 1, resharding by minimum-cost flow.

From the byte sizes of the old shards and the capacities of the new ones a small flow network is
solved whose cost is the number of bytes that change shards. The flows are then laid over blocks
of documents: whole blocks move, and only the few blocks that a flow's border cuts are divided.
What reaches the driver is one row per block, and the number of blocks has a fixed bound
(``n_old * MAX_BLOCKS``); documents never do. Files of the shards that change are written anew,
for which a text is shuffled once (twice in a divided block).
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, text_or_empty

#: Documents that a block has at least on average, and blocks that an old shard has at most.
BLOCK_ROWS, MAX_BLOCKS = 1024, 4096
#: Slots of a shard that one task writes.
FILE_SLOTS = 8192


@dataclass(frozen=True)
class Plan:
    """``whole``: block to new shard. ``split``: block to [(new shard, bytes)]. ``moved``: bytes that change shards."""

    flows: dict[tuple[int, int], int]
    whole: dict[int, int]
    split: dict[int, list[tuple[int, int]]]

    @property
    def moved(self) -> int:
        return sum(x for (i, j), x in self.flows.items() if i != j)


def equal_capacities(total: int, n: int) -> list[int]:
    return [total // n + (k < total % n) for k in range(n)]


def min_cost_flow(supply: list[int], capacity: list[int]) -> dict[tuple[int, int], int]:
    """Flows from old shards to new ones by successive shortest paths; a byte costs 1 unless it stays.

    Costs are 0 or 1, so shortest paths are found by a deque search over the residual network.
    ``sum(supply) == sum(capacity)`` must hold.
    """
    n, m = len(supply), len(capacity)
    left, room, flow = list(supply), list(capacity), {}
    for i in range(min(n, m)):  # the zero-cost paths
        x = min(left[i], room[i])
        if x:
            flow[i, i] = x
            left[i] -= x
            room[i] -= x
    for i in range(n):
        while left[i]:
            cost, before, queue = {("o", i): 0}, {}, deque([("o", i)])
            while queue:
                kind, k = node = queue.popleft()
                if kind == "o":
                    steps = [(("n", j), int(j != k)) for j in range(m)]
                else:
                    steps = [(("o", a), -int(a != k)) for a in range(n) if flow.get((a, k))]
                for to, c in steps:
                    if to not in cost or cost[node] + c < cost[to]:
                        cost[to], before[to] = cost[node] + c, node
                        queue.append(to)
            end = min((x for x in cost if x[0] == "n" and room[x[1]]), key=lambda x: (cost[x], x[1]))
            path = [end]
            while path[-1] != ("o", i):
                path.append(before[path[-1]])
            path.reverse()
            arcs = list(zip(path, path[1:]))
            x = min([left[i], room[end[1]], *(flow[b[1], a[1]] for a, b in arcs if a[0] == "n")])
            for a, b in arcs:
                arc, sign = ((a[1], b[1]), 1) if a[0] == "o" else ((b[1], a[1]), -1)
                flow[arc] = flow.get(arc, 0) + sign * x
                if not flow[arc]:
                    del flow[arc]
            left[i] -= x
            room[end[1]] -= x
    return flow


def plan_transfers(blocks: dict[int, tuple[int, int]], n_old: int, capacity: list[int]) -> Plan:
    """``blocks``: block to (old shard, bytes)."""
    supply = [0] * n_old
    for old, size in blocks.values():
        supply[old] += size
    flows = min_cost_flow(supply, capacity)
    todo = {i: sorted(((j, x) for (a, j), x in flows.items() if a == i), key=lambda t: (t[0] != i, t[0])) for i in range(n_old)}
    whole, split = {}, {}
    for block, (old, size) in sorted(blocks.items()):
        parts, targets = [], todo[old]
        while size:
            j, x = targets[0]
            take = min(size, x)
            parts.append((j, take))
            size -= take
            targets[0] = (j, x - take)
            if take == x:
                targets.pop(0)
        if len(parts) == 1:
            whole[block] = parts[0][0]
        elif parts:
            split[block] = parts
    return Plan(flows, whole, split)


def _divide(parts: dict[int, list[tuple[int, int]]]):
    def divide(rows: pd.DataFrame) -> pd.DataFrame:
        """Documents from large to small, each to the shard of the block that still lacks most bytes; ``rank``: its place in that shard's part."""
        rows = rows.sort_values("at")
        lack, shards = dict(parts[int(rows["block"].iloc[0])]), []
        for size in rows["size"].tolist():
            j = max(lack, key=lambda k: (lack[k], -k))
            lack[j] -= size
            shards.append(j)
        return rows[["block", "at"]].assign(shard=shards, rank=pd.Series(shards, rows.index).groupby(shards).cumcount())

    return divide


def byte_size(text: str | Column = "text") -> Column:
    return (F.octet_length(text_or_empty(text)) + 1).cast("long")


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, capacity: list[int] | None = None) -> tuple[DataFrame, Plan]:
    """Assign every row to one of ``n_new`` shards, moving the fewest bytes from the old layout.

    ``old_shard`` is an integer column from 0 to ``n_old`` - 1. Returns rows (doc_id, size, text_crc32,
    old_shard, shard, slot) and the plan. Capacities default to equal shares of all bytes. A null
    text has size 1 and the checksum of no bytes; a null doc_id is a value like any other; rows that
    repeat are placed one by one; an empty table gives no rows. Columns beyond doc_id and text are
    read only by ``old_shard``.
    """
    scratch = Scratch(docs.sparkSession, "reshard")
    rows = scratch.save(_measured(docs, old_shard))
    plan, layout = _layout(scratch, rows, n_old, n_new, capacity)
    return layout.placed(rows).select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot"), plan


def _measured(docs: DataFrame, old_shard: Column, *more: Column) -> DataFrame:
    crc = F.crc32(F.encode(text_or_empty(docs["text"]), "UTF-8")).alias("text_crc32")
    return docs.select(docs["doc_id"].alias("doc_id"), byte_size(docs["text"]).alias("size"), crc, old_shard.cast("int").alias("old_shard"), *more)


def _numbered(rows: DataFrame) -> DataFrame:
    """``at``: a row's place in its block, from large to small. Rows alike in doc_id, size and checksum can change places with each other."""
    order = Window.partitionBy("block").orderBy(F.desc("size"), "doc_id", "text_crc32")
    return rows.withColumn("at", F.row_number().over(order))


@dataclass
class _Layout:
    """Where blocks go. ``moves``: (block, shard, base) of whole blocks; ``parts``: (block, at, shard, slot) of divided ones."""

    per_shard: int
    moves: DataFrame
    cut: list[int]
    parts: DataFrame

    def blocks(self, rows: DataFrame) -> DataFrame:
        key = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(self.per_shard)).cast("int")
        return rows.withColumn("block", F.col("old_shard") * self.per_shard + key)

    def placed(self, rows: DataFrame, shards: list[int] | None = None) -> DataFrame:
        """``rows`` with shard, slot and ``file`` (a range of slots), dealt out by shard and file; only those of ``shards`` if given."""
        rows = self.blocks(rows)
        here = F.lit(True) if shards is None else F.col("shard").isin(shards)
        file = lambda slot: F.floor(slot / FILE_SLOTS)
        whole = rows.join(F.broadcast(self.moves), "block").where(here).withColumn("file", file(F.col("base"))).repartition("shard", "file")
        order = Window.partitionBy("shard", "file", "block").orderBy(F.desc("size"), "doc_id", "text_crc32")
        whole = whole.withColumn("slot", F.col("base") + F.row_number().over(order) - 1).drop("base", "block")
        if not self.cut:
            return whole
        divided = _numbered(rows.where(F.col("block").isin(self.cut))).join(self.parts, ["block", "at"]).where(here)
        divided = divided.drop("block", "at").withColumn("file", file(F.col("slot"))).repartition("shard", "file")
        return whole.unionByName(divided)


def _layout(scratch: Scratch, rows: DataFrame, n_old: int, n_new: int, capacity: list[int] | None) -> tuple[Plan, _Layout]:
    spark = rows.sparkSession
    count, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    layout = _Layout(max(1, min(MAX_BLOCKS, count // (n_old * BLOCK_ROWS))), rows, [], rows)
    rows = layout.blocks(rows)
    sums = {r["block"]: (r["size"], r["n"]) for r in rows.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}  # n_old * MAX_BLOCKS rows at most
    plan = plan_transfers({b: (b // layout.per_shard, size) for b, (size, _) in sums.items()}, n_old, capacity or equal_capacities(total, n_new))
    layout.cut = [*plan.split]
    counts = [(shard, block, sums[block][1]) for block, shard in plan.whole.items()]
    if layout.cut:
        cut = _numbered(rows.where(F.col("block").isin(layout.cut))).select("block", "at", "size")
        layout.parts = scratch.save(cut.groupBy("block").applyInPandas(_divide(plan.split), "block int, at int, shard int, rank long"))
        counts += [(r["shard"], r["block"], r["count"]) for r in layout.parts.groupBy("shard", "block").count().collect()]
    # slots: a running count over the blocks of a shard, on the driver, plus a rank within the block
    base, offsets = {}, []
    for shard, block, n in sorted(counts):
        offsets.append((block, shard, base.get(shard, 0)))
        base[shard] = base.get(shard, 0) + n
    bases = spark.createDataFrame(offsets, "block int, shard int, base long")
    layout.moves = bases.where(~F.col("block").isin(layout.cut)) if layout.cut else bases
    if layout.cut:
        layout.parts = layout.parts.join(F.broadcast(bases), ["block", "shard"]).select("block", "at", "shard", (F.col("base") + F.col("rank")).alias("slot"))
    return plan, layout


def rewrite_affected(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, path: str | None = None, capacity: list[int] | None = None) -> tuple[DataFrame, list[int]]:
    """Reshard and write the new files of every shard that gains or loses bytes under ``path``/shard=N.

    ``path`` is a new folder (scratch without one); ``swap_shards`` puts its shards in the place of old ones. Files have (row, old_shard, slot):
    ``row`` holds all columns of ``docs``, repeated rows and nulls as they are. A task writes ranges of a shard's slots in order.
    Returns (doc_id, size, text_crc32, old_shard, shard, slot), read back from the files and, for
    shards that keep their files, from the plan's placement; and the shards written.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "reshard-files")
    path = path or f"{scratch.base}/files"
    rows = scratch.save(_measured(docs, old_shard))
    plan, layout = _layout(scratch, rows, n_old, n_new, capacity)
    changed = sorted({k for (i, j) in plan.flows if i != j for k in (i, j) if k < n_new})
    held = _measured(docs, old_shard, F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"))
    full = layout.placed(held, changed).select("row", "old_shard", "shard", "slot").sortWithinPartitions("shard", "slot")
    full.write.partitionBy("shard").parquet(path)
    back = spark.read.schema(full.schema).parquet(path)
    text = F.col("row.text")
    crc = F.crc32(F.encode(text_or_empty(text), "UTF-8")).alias("text_crc32")
    names = ["doc_id", "size", "text_crc32", "old_shard", "shard", "slot"]
    back = back.select(F.col("row.doc_id").alias("doc_id"), byte_size(text).alias("size"), crc, "old_shard", "shard", "slot")
    rest = sorted({*range(n_new)} - {*changed})
    return (back.unionByName(layout.placed(rows, rest).select(*names)) if rest else back), changed


def swap_shards(spark: SparkSession, root: str, written: str, changed: list[int]) -> None:
    """Put the folders of the shards written under ``written`` in the place of those under ``root``; all other shards' files stay untouched.

    A shard that lost all rows has no new folder and loses its old one. Whoever runs this again after it broke off ends it.
    """
    jvm = spark.sparkContext._jvm
    to = lambda base, k: jvm.org.apache.hadoop.fs.Path(f"{base}/shard={k}")
    files = to(root, 0).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = jvm.org.apache.hadoop.fs.Path(f"{written}/_swapped")
    files.mkdirs(done)
    for k in changed:
        mark = jvm.org.apache.hadoop.fs.Path(done, f"shard-{k}")
        if files.exists(mark):
            continue
        new, old = to(written, k), to(root, k)
        aside = jvm.org.apache.hadoop.fs.Path(done, f"old-{k}")
        if files.exists(old) and not files.exists(aside):
            files.rename(old, aside)
        if files.exists(new):
            files.rename(new, old)
        files.mkdirs(mark)
        files.delete(aside, True)
