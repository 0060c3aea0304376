"""Balanced label propagation: documents with common links gather in one shard, shards stay even.

Rows start in the shard of their hash. In each round the members of every link are counted by shard (one partial
aggregation), a join brings the counts back to the rows, and each row asks for the shard where most of its links'
members are; it counts itself once, and a link's members agree on ties, so pairs don't swap for ever. What two shards ask of each
other is exchanged row for row, which needs no room; further requests are granted as far as linked rows leave room below the
quota. Every other round asks for shards with room alone, so that rows of a link too large for its shard gather in the
next. Grants go link by link in hash order, and within the link on the border row by row. Rows without links
fill up: a last step ranks each shard's rows,
linked ones first, and moves what exceeds the quota to where rows lack, so counts differ by one at most.

Nothing but a number for each pair of shards reaches the driver. A link with a third of all rows is counted by partial
aggregation, joined under the adaptive skew join, and split over as many shards as it needs. Ranks are counted in
buckets whose number follows the row count.

Defined cases: null links are no links; texts are not read, so that their length costs nothing; rows repeated in full are rows of
their own; equal ids go by the order columns; other columns keep their values, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import cut

_BUCKETS = 4096


def _linked(rows: DataFrame, links: list[str]) -> DataFrame:
    """rows with _linked: whether any link has another member."""
    any_link = F.lit(False)
    for i, link in enumerate(links):
        shared = cut(rows.where(F.col(link).isNotNull()).groupBy(link).count().where("count > 1").select(link, F.lit(True).alias(f"_l{i}")))
        rows = rows.join(shared, link, "left")
        any_link = any_link | F.col(f"_l{i}").isNotNull()
    return rows.withColumn("_linked", any_link).drop(*(f"_l{i}" for i in range(len(links))))


def _limits(flow: dict[tuple[int, int], int], room: list[int]) -> list[tuple[int, int, int]]:
    """(from, to, rows granted): what is asked both ways is exchanged, and the rest gets the room that is left."""
    left, out = [max(0, r) for r in room], []
    for (a, b), n in sorted(flow.items()):
        swapped = min(n, flow.get((b, a), 0))
        more = min(n - swapped, left[b])
        left[b] -= more
        out.append((a, b, swapped + more))
    return out


def _round(state: DataFrame, links: list[str], n: int, room: list[int], exchange: bool, seed: int) -> DataFrame:
    """state with _shard moved and _moved set. exchange: full shards may be asked for, too."""
    own = sum((F.col(x).isNotNull().cast("int") for x in links), F.lit(0))
    total = [-F.when(F.col("_shard") == s, F.greatest(own - 1, F.lit(0))).otherwise(0) for s in range(n)]
    asked = state
    for i, link in enumerate(links):
        by_shard = [F.count(F.when(F.col("_shard") == s, 1)).alias(f"_c{i}_{s}") for s in range(n)]
        counts = cut(state.where(F.col(link).isNotNull()).groupBy(link).agg(*by_shard))
        asked = asked.join(counts, link, "left")
        total = [t + F.coalesce(F.col(f"_c{i}_{s}"), F.lit(0)) for s, t in enumerate(total)]
    first = F.coalesce(*(F.col(x).cast("string") for x in links))
    turn = lambda s: F.pmod(F.xxhash64(first, F.lit(seed)) + s, F.lit(n)).cast("int")
    wish = F.array_max(F.array(*(F.when((F.col("_shard") == s) | F.lit(exchange or room[s] > 0), F.struct(total[s].alias("c"), turn(s).alias("t"), F.lit(s).alias("s"))) for s in range(n))))
    asked = asked.withColumn("_to", wish["s"]).withColumn("_b", F.pmod(F.xxhash64(first, F.lit(seed + 1)), F.lit(_BUCKETS)).cast("int"))
    asked = cut(asked.select(*state.columns, "_to", "_b"))
    pair = ["_shard", "_to"]
    wants = cut(asked.where("_to != _shard").groupBy(*pair, "_b").agg(F.count("*").alias("_n")))
    # at most shards squared numbers
    flow = {(r["_shard"], r["_to"]): r["n"] for r in wants.groupBy(*pair).agg(F.sum("_n").alias("n")).collect()}
    limits = state.sparkSession.createDataFrame(_limits(flow, room), "_shard int, _to int, _limit long")
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*pair).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = wants.withColumn("_before", before).join(F.broadcast(limits), pair)
    # the bucket in which a pair's grants end
    border = placed.where("_before <= _limit and _limit < _before + _n").select(*pair, F.col("_b").alias("_border"), ((F.col("_limit") - F.col("_before")) / F.col("_n")).alias("_part"))
    chance = F.pmod(F.xxhash64("_id", F.lit(seed + 2)), F.lit(1 << 20)) / float(1 << 20)
    granted = F.col("_border").isNull() | (F.col("_b") < F.col("_border")) | ((F.col("_b") == F.col("_border")) & (chance < F.col("_part")))
    moved = asked.join(F.broadcast(border), pair, "left").withColumn("_moved", (F.col("_to") != F.col("_shard")) & granted)
    return cut(moved.withColumn("_shard", F.when(F.col("_moved"), F.col("_to")).otherwise(F.col("_shard"))).select(*state.columns, "_moved"))


def balanced_label_propagation(docs: DataFrame, id_col: str, links: list[str], n_shards: int = 8, rounds: int = 6, seed: int = 7, order: list[str] | None = None, still: float = 0.001) -> DataFrame:
    """docs with shard and slot; counts differ by one at most, slots have no gaps.

    links: columns whose equal values link rows. order: columns that decide ties of id_col. Propagation ends after rounds, or
    when two in succession moved no more than still of the linked rows; still = 0 runs to a fixed point. Columns of docs named
    shard or slot give way to the results.
    """
    named = lambda prefix, columns: [docs[f"`{c}`"].alias(f"{prefix}{i}") for i, c in enumerate(columns)]
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    ties = [id_col, *(order or [])]
    base = docs.select(F.struct(*(docs[f"`{c}`"] for c in own)).alias("_row"), *named("_link", links), *named("_tie", ties))
    links, ties = [f"_link{i}" for i in range(len(links))], [f"_tie{i}" for i in range(len(ties))]
    base = base.withColumn("_id", F.xxhash64("_tie0"))
    base = base.withColumn("_shard", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(n_shards)).cast("int"))
    base = cut(_linked(cut(base), links))
    total = base.count()
    quota = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    state, single = base.where("_linked"), base.where("not _linked")
    many, quiet = state.count(), 0
    for k in range(rounds if many else 0):
        load = {r["_shard"]: r["count"] for r in state.groupBy("_shard").count().collect()}
        moved = _round(state.select(base.columns), links, n_shards, [quota[s] - load.get(s, 0) for s in range(n_shards)], k % 2 == 0, seed + 10 * k)
        state = moved.select(base.columns)
        quiet = quiet + 1 if moved.where("_moved").count() <= still * many else 0
        if quiet == 2:
            break
    return _even(state.unionByName(single), own, ties, quota, total, seed)


def _even(rows: DataFrame, own: list[str], ties: list[str], quota: list[int], total: int, seed: int) -> DataFrame:
    n = len(quota)
    load = {r["_shard"]: r["count"] for r in rows.groupBy("_shard").count().collect()}
    over = [max(0, load.get(s, 0) - quota[s]) for s in range(n)]
    lack = [max(0, quota[s] - load.get(s, 0)) for s in range(n)]
    upto = lambda xs: [sum(xs[:s]) for s in range(n)]
    pick = lambda xs, at: F.element_at(F.array(*(F.lit(x).cast("long") for x in xs)), at + 1)
    buckets = max(64, total // 160_000)
    rows = rows.withColumn("_k", F.when(F.col("_linked"), 0).otherwise(1)).withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(seed + 3)), F.lit(buckets)))
    place = ["_shard", "_k", "_b"]
    counts = rows.groupBy(*place).count()
    before = F.sum("count").over(Window.partitionBy("_shard").orderBy("_k", "_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*place, F.coalesce(before, F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy(*place).orderBy(*ties)) - 1
    ranked = rows.withColumn("_r", rank).join(offsets, place).withColumn("_r", F.col("_r") + F.col("_before"))
    spare = F.col("_r") - pick(quota, F.col("_shard")) + pick(upto(over), F.col("_shard"))
    ends = [a + b for a, b in zip(upto(lack), lack)]
    new: Column = F.lit(n - 1)
    for s in reversed(range(n)):
        new = F.when(spare < ends[s], F.lit(s)).otherwise(new)
    stays = F.col("_r") < pick(quota, F.col("_shard"))
    ranked = ranked.withColumn("shard", F.when(stays, F.col("_shard")).otherwise(new).cast("int"))
    slot = F.when(stays, F.col("_r")).otherwise(spare - pick(upto(lack), F.col("shard")) + pick([load.get(s, 0) for s in range(n)], F.col("shard")))
    return ranked.withColumn("slot", slot.cast("long")).select(*(F.col("_row").getField(c).alias(c) for c in own), "shard", "slot")
