"""Resharding by minimum-cost flow: fewest bytes moved, equal new shards, and only affected files rewritten."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm._common import cut, new_path, small

#: Bytes of a block, about; only whole blocks move, but for those in which a transfer ends.
BLOCK_BYTES = 4_000_000
#: Blocks at most; larger inputs have larger blocks.
BLOCKS = 40_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Amounts from each source to each sink that meet all supplies at the least total cost.

    ``cost(i, j)`` is for one unit.  Shortest augmenting paths with potentials;
    the capacities together are at least the supplies.
    """
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities are too small")
    n, m = len(supply), len(capacity)
    left, room = list(supply), list(capacity)
    flow: dict[tuple[int, int], int] = {}
    into: list[dict[int, int]] = [{} for _ in range(m)]
    price = [0] * (n + m)
    for source in range(n):
        while left[source]:
            dist, back, done = {source: 0}, {}, set()
            queue = [(0, source)]
            goal = None
            while queue:
                d, u = heapq.heappop(queue)
                if u in done:
                    continue
                done.add(u)
                if u >= n and room[u - n]:
                    goal = u
                    break
                if u < n:
                    steps = ((n + j, cost(u, j)) for j in range(m))
                else:
                    steps = ((i, -cost(i, u - n)) for i in into[u - n])
                for v, c in steps:
                    to = d + c + price[u] - price[v]
                    if v not in done and to < dist.get(v, float("inf")):
                        dist[v], back[v] = to, u
                        heapq.heappush(queue, (to, v))
            for u in range(n + m):
                price[u] += min(dist.get(u, dist[goal]), dist[goal])
            path = [goal]
            while path[-1] in back:
                path.append(back[path[-1]])
            path.reverse()
            amount = min(left[source], room[goal - n])
            for u, v in zip(path, path[1:]):
                if u >= n:
                    amount = min(amount, flow[v, u - n])
            for u, v in zip(path, path[1:]):
                i, j, sign = (u, v - n, 1) if u < n else (v, u - n, -1)
                flow[i, j] = into[j][i] = flow.get((i, j), 0) + sign * amount
                if not flow[i, j]:
                    del flow[i, j], into[j][i]
            left[source] -= amount
            room[goal - n] -= amount
    return flow


@dataclass
class Plan:
    """Which bytes of each block go to which new shard: (old shard, block, from byte, to byte, new shard)."""

    parts: list[tuple[int, int, int, int, int]]
    moved: int
    rewritten: list[str] = field(default_factory=list)


def plan_transfers(blocks: dict[tuple[int, int], int], shards: int) -> Plan:
    """Block transfers from block sizes by (old shard, block); old shard k may stay as new shard k."""
    olds = sorted({old for old, _ in blocks})
    supply = [sum(n for (o, _), n in blocks.items() if o == old) for old in olds]
    total = sum(supply)
    capacity = [total // shards + (k < total % shards) for k in range(shards)]
    flow = min_cost_flow(supply, capacity, lambda i, j: int(olds[i] != j))
    by_old: dict[int, list[tuple[int, int]]] = {}
    for (old, block), n in sorted(blocks.items()):
        by_old.setdefault(old, []).append((block, n))
    parts = []
    for i, old in enumerate(olds):
        targets = [[j, flow[i, j]] for j in range(shards) if flow.get((i, j))]
        for block, n in by_old[old]:
            done = 0
            while done < n:
                take = min(targets[0][1], n - done)
                parts.append((old, block, done, done + take, targets[0][0]))
                done += take
                targets[0][1] -= take
                if not targets[0][1]:
                    targets.pop(0)
    return Plan(parts, sum(b - a for old, _, a, b, new in parts if old != new))


def _longs(spark: SparkSession, rows: list[tuple], *names: str) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType([T.StructField(n, T.LongType()) for n in names]))


def numbered_rows(spark: SparkSession, source: str, text_col: str = "text") -> tuple[DataFrame, list[str]]:
    """A parquet table's rows as ``row`` (a struct of its columns), ``old`` (the number of the file, in order of name), ``at`` (the place there) and ``size``; and the files.

    A place in a file is the same whenever it is read, so that rows have names
    without a shuffle.
    """
    found = spark.read.parquet(source)
    names = sorted(found.inputFiles())
    meta = found.metadataColumn("_metadata")
    size = (F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 1).cast("long")
    rows = found.select(F.struct(*(F.col(f"`{c}`") for c in found.columns)).alias("row"), meta.getField("file_path").alias("file"), meta.getField("row_index").alias("at"), size.alias("size"))
    files = spark.createDataFrame(list(zip(names, range(len(names)))), "name string, old long")  # a row for each file
    # one name has two spellings as a URI
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, r"\+", "%2B")), "^file:/+", "file:/")
    joined = rows.join(F.broadcast(files.select(plain(F.col("name")).alias("name"), "old")), plain(F.col("file")) == F.col("name"))
    return joined.select("row", "old", "at", "size"), names


def _largest_first(rows: DataFrame) -> DataFrame:
    """Rows of cut blocks with ``middle``, the place of the middle byte, and ``nth`` in their block, the largest first; a block is bounded, so is its window."""
    order = Window.partitionBy("old", "block").orderBy(F.desc("size"), "at")
    middle = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.expr("size div 2") - 1
    return rows.withColumn("middle", middle).withColumn("nth", F.row_number().over(order) - 1)


def reshard(spark: SparkSession, source: str, path: str, shards: int, text_col: str = "text") -> tuple[DataFrame, Plan]:
    """The rows of a parquet table, whose files are the old shards in order of name, in ``shards`` new ones of equal size.

    A row's size is the UTF-8 bytes of its text (null: none) plus 1.  Old shard k
    may stay as new shard k.  Files that lose rows are rewritten under ``path``,
    a folder for each shard; other files stay as they are and where they are.
    Nothing is exchanged: a flow has fewer arcs than there are old and new
    shards, so what a task reads goes to few of them and it writes their files
    itself.  The source is left alone until the caller drops the files that were
    rewritten (``Plan.rewritten``).

    Returns the rows as read back, with ``size``, ``shard`` and ``slot``, which
    counts a shard's rows from 0 without gaps.  The new shards' sizes differ by
    the sizes of a few rows at most.  What the driver holds is at most about
    BLOCKS block sizes and a number for each file.  Null ids and repeated rows
    are rows like any other; an empty table gives an empty result; columns of the
    result's names are replaced, all others stay, whatever their names.
    """
    rows, names = numbered_rows(spark, source, text_col)
    schema = spark.read.parquet(source).schema
    meta = cut(rows.select("old", "at", "size"))
    held = {r.old: (r.n, r.total) for r in meta.groupBy("old").agg(F.count("*").alias("n"), F.sum("size").alias("total")).collect()}  # a row for each file
    size = max(BLOCK_BYTES, -(-sum(total for _, total in held.values()) // BLOCKS))
    steps = F.broadcast(_longs(spark, [(old, max(1, n * size // total)) for old, (n, total) in held.items()], "of", "step"))

    def blocked(df: DataFrame) -> DataFrame:
        return df.join(steps, F.col("old") == F.col("of")).withColumn("block", F.floor(F.col("at") / F.col("step")).cast("long")).withColumn("nth", F.col("at") - F.col("block") * F.col("step")).drop("of", "step")

    blocks = {(r.old, r.block): (r.total, r.n) for r in blocked(meta).groupBy("old", "block").agg(F.sum("size").alias("total"), F.count("*").alias("n")).collect()}
    plan = plan_transfers({k: total for k, (total, _) in blocks.items()}, shards)
    pieces: dict[tuple[int, int], list] = {}
    for old, block, first, last, new in plan.parts:
        pieces.setdefault((old, block), []).append((first, last, new))
    whole = {key: parts[0][2] for key, parts in pieces.items() if len(parts) == 1}
    divided = _longs(spark, [(*key, *part) for key, parts in pieces.items() if len(parts) > 1 for part in parts], "of_old", "of_block", "first", "last", "new")
    here = (F.col("old") == F.col("of_old")) & (F.col("block") == F.col("of_block"))
    some = blocked(meta).join(F.broadcast(divided.select("of_old", "of_block").distinct()), here, "left_semi").drop("nth")
    some = _largest_first(some).join(F.broadcast(divided), here & (F.col("middle") >= F.col("first")) & (F.col("middle") < F.col("last")))
    some = cut(some.select("old", "block", "at", "new", F.row_number().over(Window.partitionBy("old", "block", "new").orderBy("nth")).alias("place")))
    filled: dict[int, int] = {}
    bases = []
    counts = [(new, *key, blocks[key][1]) for key, new in whole.items()]
    counts += [(r.new, r.old, r.block, r.n) for r in some.groupBy("old", "block", "new").agg(F.count("*").alias("n")).collect()]  # a row for each part of a cut block
    for new, old, block, n in sorted(counts):
        bases.append((old, block, new, filled.get(new, 0)))
        filled[new] = filled.get(new, 0) + n
    known = _longs(spark, [b for b in bases if (b[0], b[1]) in whole], "of_old", "of_block", "to", "base")
    single = some.join(F.broadcast(_longs(spark, [b for b in bases if (b[0], b[1]) not in whole], "of_old", "of_block", "to", "base")), here & (F.col("new") == F.col("to")))
    single = small(single.select(F.col("old").alias("its_old"), F.col("at").alias("its_at"), "new", (F.col("base") + F.col("place") - 1).alias("its_slot")))
    placed = blocked(rows).join(F.broadcast(known), here, "left").join(single, (F.col("old") == F.col("its_old")) & (F.col("at") == F.col("its_at")), "left")
    placed = placed.select("row", "old", "at", "size", F.coalesce("new", "to").cast("int").alias("shard"), F.coalesce("its_slot", F.col("base") + F.col("nth")).alias("slot"))
    result = {"size": F.col("size"), "shard": F.col("shard"), "slot": F.col("slot")}

    def flat(df: DataFrame) -> DataFrame:
        return df.select(*(F.col(f"row.`{c}`").alias(c) for c in schema.names if c not in result), *(c.alias(name) for name, c in result.items()))

    loses = sorted({old for old, _, _, _, new in plan.parts if old != new})
    plan.rewritten = [names[old] for old in loses]
    affected = F.broadcast(_longs(spark, [(old,) for old in loses], "loser"))
    rewritten = flat(placed.join(affected, F.col("old") == F.col("loser"), "left_semi"))
    rewritten.write.partitionBy("shard").parquet(path)
    as_read = T.StructType([*(f for f in rewritten.schema if f.name != "shard"), T.StructField("shard", T.IntegerType())])
    back = spark.read.schema(as_read).parquet(path)
    if len(loses) < len(held):
        back = back.unionByName(flat(placed.join(affected, F.col("old") == F.col("loser"), "left_anti")))
    return back, plan


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    rows, _ = reshard(spark, f"{sf_dir}/documents.parquet", new_path(spark, "shards"), shards=8)
    return rows.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )
