"""Which part an entity belongs to, how parts depend on each other, and how evenly they are loaded."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

# An entity costs as much as so many ratings besides its own, and so many are given back when it moves; what work and messages weigh; passes.
ENTITY, MOVED = 10.0, 7.1
BY_WORK, BY_MESSAGES = 10000.0, 0.0
PASSES = 3
#: Entities that the driver assigns one by one, at most.
ONE_BY_ONE = 20_000_000


def block(position: Column, n: int, parts: int) -> Column:
    """Contiguous parts of n div parts entities; the last one takes the rest."""
    size = max(n // parts, 1)
    return F.least(F.floor(position / size), F.lit(parts - 1)).cast("int")


def range_of(positions: DataFrame, ranges: DataFrame, position: str = "id") -> DataFrame:
    """positions with `part`, from ranges (part, lo, hi), lo included; ranges are as few as parts."""
    return positions.join(F.broadcast(ranges), (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))).drop("lo", "hi")


def balanced(counts: DataFrame, parts: int, exact: int = 1024) -> DataFrame:
    """From (id, nnz): (id, nnz, part) with nearly equal work, an entity's being 10 + nnz.

    Entities with equal nnz are alike, so only how many there are of each nnz comes to the driver, where the least loaded part takes the next
    heaviest. Of a nnz with more than `exact` entities, the parts take equal shares by a hash of the id.
    """
    classes = counts.groupBy("nnz").agg(F.count("*").alias("c")).orderBy(F.desc("nnz")).collect()
    load = [(0.0, p) for p in range(parts)]
    rows = []
    for nnz, c in classes:
        if c > exact:
            load = [(w + c / parts * (ENTITY + nnz), p) for w, p in load]
            heapq.heapify(load)
            continue
        for nth in range(1, c + 1):
            w, p = heapq.heappop(load)
            rows.append((nnz, nth, p))
            heapq.heappush(load, (w + ENTITY + nnz, p))
    taken = counts.sparkSession.createDataFrame(rows, "nnz long, nth int, part int")
    large = [nnz for nnz, c in classes if c > exact]
    few = counts.where(~F.col("nnz").isin(large)) if large else counts
    nth = few.withColumn("nth", F.row_number().over(Window.partitionBy("nnz").orderBy("id")))
    out = nth.join(F.broadcast(taken), ["nnz", "nth"]).select("id", "nnz", "part")
    if not large:
        return out
    return out.unionByName(counts.where(F.col("nnz").isin(large)).select("id", "nnz", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")))


@dataclass
class Loads:
    """Work by part, and all of it."""

    work: np.ndarray
    total: float = 0.01

    def change(self, part: int, by: float) -> None:
        self.work[part] += by
        self.total += by

    def cheapest(self, by_work: float, messages: np.ndarray | float) -> int:
        """The part with the least weighted sum of its share of the work and of the entity's messages; the last of several."""
        cost = by_work * (self.work / self.total) + messages
        return len(cost) - 1 - int(cost[::-1].argmin())


def assigned(counts: DataFrame, parts: int, costs: DataFrame | None = None, by_work: float = BY_WORK, by_messages: float = BY_MESSAGES, passes: int = PASSES) -> DataFrame:
    """From (id, nnz): (id, nnz, part), entity by entity in the order of their ids, each to the part that costs least, in several passes.

    costs (item, part, cost), as `comm_cost` gives them, are weighed in by `by_messages`; an entity without costs has none. This is a loop on the driver over
    a few bytes an entity; of more than ONE_BY_ONE entities `balanced` deals out whole classes instead, so these are an error.
    """
    n = counts.limit(ONE_BY_ONE + 1).count()
    if n > ONE_BY_ONE:
        raise ValueError(f"more than {ONE_BY_ONE} entities are too many to assign one by one; use balanced()")
    kind = counts.schema["id"].dataType
    rows = counts.select("id", F.col("nnz").cast("double").alias("nnz")).orderBy("id").toArrow()
    nnz = rows.column("nnz").to_numpy()
    messages: np.ndarray | list = [0.0] * n
    if costs is not None and by_messages:
        wide = F.array(*[F.coalesce(F.max(F.when(F.col("part") == p, F.col("cost"))), F.lit(0)).cast("double") for p in range(parts)])
        of = counts.select("id").join(costs.groupBy(F.col("item").alias("id")).agg(wide.alias("c")), "id", "left").select("id", F.coalesce("c", F.array_repeat(F.lit(0.0), parts)).alias("c"))
        messages = by_messages * np.asarray(of.orderBy("id").toArrow().column("c").combine_chunks().flatten()).reshape(n, parts)
    loads, where = Loads(np.zeros(parts)), np.full(n, -1, np.int32)
    for _ in range(passes):
        for i in range(n):
            if where[i] >= 0:
                loads.change(where[i], -(MOVED + nnz[i]))
            where[i] = loads.cheapest(by_work, messages[i])
            loads.change(where[i], ENTITY + nnz[i])
    found = pa.table({"id": rows.column("id"), "part": pa.array(where)})
    return counts.join(counts.sparkSession.createDataFrame(found).select(F.col("id").cast(kind).alias("id"), "part"), "id")


def alternating(pattern: DataFrame, items: DataFrame, users: DataFrame, parts: int, by_work: float = BY_WORK, by_messages: float = BY_MESSAGES, rounds: int = 2) -> tuple[DataFrame, DataFrame]:
    """(id, nnz, part) of both sides from cells (user, item) and each side's (id, nnz): items first, then users knowing where items are, and so on in turn."""
    found: dict[str, DataFrame] = {}
    for _ in range(rounds):
        for side, other, counts in (("item", "user", items), ("user", "item", users)):
            costs = None
            if other in found:
                cells = pattern.select(F.col(side).alias("item"), F.col(other).alias("user"))
                costs = comm_cost(cells, counts, found[other], parts)
            found[side] = materialize(assigned(counts, parts, costs, by_work, by_messages))
    return found["item"], found["user"]


def positions(assigned: DataFrame) -> DataFrame:
    """(id, part, position): part by part, in the order of ids within each."""
    nth = F.row_number().over(Window.partitionBy("part").orderBy("id")).cast("long")
    return assigned.join(F.broadcast(prefix_sums(assigned)), "part").select("id", "part", (F.col("lo") + nth - 1).alias("position"))


def prefix_sums(assigned: DataFrame) -> DataFrame:
    """(part, lo, hi): where each part's entities stand if parts are laid end to end."""
    n = assigned.groupBy("part").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("part"))  # as many rows as parts
    return n.select("part", (upto - F.col("n")).alias("lo"), upto.alias("hi"))


def connectivity(pattern: DataFrame, items: DataFrame, users: DataFrame) -> DataFrame:
    """(item, part, needed_by): for each item the other parts that have a user of it, from cells and (id, part) of both sides."""
    cells = pattern.join(users.select(F.col("id").alias("user"), F.col("part").alias("to")), "user").join(items.select(F.col("id").alias("item"), "part"), "item")
    return cells.where("to <> part").groupBy("item", "part").agg(F.sort_array(F.collect_set("to")).alias("needed_by"))


def needs(needed_by: Column, part: int) -> Column:
    """Whether a part needs an item."""
    return F.array_contains(needed_by, F.lit(part))


def sent(conn: DataFrame, src: int, dst: int | None = None) -> DataFrame:
    """The items that a part sends to another, or to any."""
    own = conn.where(F.col("part") == src)
    return own if dst is None else own.where(needs(F.col("needed_by"), dst))


def comm_cost(pattern: DataFrame, items: DataFrame, users: DataFrame, parts: int) -> DataFrame:
    """(item, part, cost): an item's cells whose users aren't in that part."""
    cells = pattern.join(users.select(F.col("id").alias("user"), "part"), "user").groupBy("item").pivot("part", list(range(parts))).count().fillna(0)
    total = sum((F.col(str(p)) for p in range(parts)), F.lit(0))
    costs = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), (total - F.col(str(p))).alias("cost")) for p in range(parts)]))
    return cells.select("item", costs.alias("c")).select("item", "c.part", "c.cost")


def messages(conn: DataFrame) -> DataFrame:
    """(src, dst, n): how many items a part sends to another."""
    return conn.select(F.col("part").alias("src"), F.explode("needed_by").alias("dst")).groupBy("src", "dst").agg(F.count("*").alias("n"))


def load(assigned: DataFrame) -> DataFrame:
    """One row: least, largest and mean ratings, entities and work of the parts, and how far apart they are, in percent of a mean."""
    each = assigned.groupBy("part").agg(F.sum("nnz").alias("nnz"), F.count("*").alias("entities"), F.sum(F.col("nnz") + ENTITY).alias("work"))
    found = []
    for c in ("nnz", "entities", "work"):
        found += [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"), F.avg(c).alias(f"avg_{c}"), ((F.max(c) - F.min(c)) * 100.0 / F.avg(c)).alias(f"unbalance_{c}")]
    return each.agg(*found)


def islands(ids: DataFrame, by: str | None = None, step: int = 1 << 20) -> DataFrame:
    """(first, last) of runs of adjacent ids, within each value of `by`. Runs are found within ranges of `step` ids, and then joined where ranges meet."""
    keys = [by] if by else []
    cells = ids.withColumn("_step", F.floor(F.col("id") / step))
    runs = cells.withColumn("_run", F.col("id") - F.row_number().over(Window.partitionBy(*keys, "_step").orderBy("id")))
    short = runs.groupBy(*keys, "_step", "_run").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    inner = short.where((F.col("first") % step != 0) & ((F.col("last") + 1) % step != 0)).select(*keys, "first", "last")
    order = Window.partitionBy(*keys).orderBy("first")  # two runs a range at most
    edge = short.where((F.col("first") % step == 0) | ((F.col("last") + 1) % step == 0)).withColumn("_new", F.coalesce(F.lag("last").over(order) + 1 != F.col("first"), F.lit(True)).cast("int"))
    edge = edge.withColumn("_run", F.sum("_new").over(order)).groupBy(*keys, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_run")
    return inner.unionByName(edge)


def by_connectivity(conn: DataFrame, parts: int) -> DataFrame:
    """conn with `place`, its order within its part: by the set of parts that need it, as a binary number with the last part's bit first, then by item. Neighbours are sent to the same places."""
    bits = F.concat(*[F.when(needs(F.col("needed_by"), p), "1").otherwise("0") for p in reversed(range(parts))])
    return conn.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(bits, "item")))
