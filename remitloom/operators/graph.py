"""Scatter-gather pairs: two accounts joined through many middle accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom.operators.aggregates import peers
from remitloom.operators.joins import broadcast_if_small
from remitloom.sources.shared import written

#: Edges on either side of one middle that one task pairs, about: a hub is cut into blocks of so many.
BLOCK_EDGES = 2_000
#: Paths that one task makes, and most tasks; beyond both a task makes more.
TASK_PATHS, MOST_TASKS = 250_000, 20_000
#: Most times edges are pruned.
ROUNDS = 3


def distinct_edges(rows: DataFrame) -> DataFrame:
    """Distinct (o, x) of origin and destination; rows with a NULL end are no edge. Self-transfers are edges."""
    return rows.select(F.col("account_origin").alias("o"), F.col("account_destination").alias("x")).dropna().distinct()


def qualified_edges(edges: DataFrame, side: str, least: int) -> DataFrame:
    """Edges whose ``side`` has at least ``least`` distinct peers (semi join; one row per edge)."""
    keep = peers(edges, side, least).select(F.col("account").alias(side))
    return edges.join(keep, side, "left_semi").select("o", "x")


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, middle) of numbers in place of names, and (n, account) to get the names back. Both are written."""
    names = edges.select(F.col("o").alias("account")).unionByName(edges.select(F.col("x").alias("account"))).distinct()
    ids = written(names.select(F.monotonically_increasing_id().alias("n"), "account"), "accounts")
    of = lambda side, out: broadcast_if_small(ids.select(F.col("n").alias(out), F.col("account").alias(side)))
    return written(edges.join(of("o", "a"), "o").join(of("x", "b"), "x").select("a", "b"), "edges"), ids


def _sizes(first: DataFrame, second: DataFrame) -> DataFrame:
    """(middle, n_in, n_out): edges of every middle on either side."""
    ends = first.select("middle", F.lit(1).alias("_side")).unionByName(second.select("middle", F.lit(2).alias("_side")))
    count = lambda side: F.count(F.when(F.col("_side") == side, 1))
    return ends.groupBy("middle").agg(count(1).alias("n_in"), count(2).alias("n_out"))


def _pruned(edges: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, middle), (middle, b) and their sizes: edges (a, b) that can be on a path of a pair with ``least`` middles, written.

    Origins and destinations need that many edges, and a middle needs an edge on both sides. Dropping middles takes edges
    from the ends, so this is done again where a tenth of the edges has a middle with one side only, at most ROUNDS times;
    what is left then is correct all the same, as this only saves work.
    """
    first, second = edges.select("a", F.col("b").alias("middle")), edges.select(F.col("a").alias("middle"), "b")
    for again in range(ROUNDS):
        first = first.join(peers(first, "a", least).select(F.col("account").alias("a")), "a", "left_semi")
        second = second.join(peers(second, "b", least).select(F.col("account").alias("b")), "b", "left_semi")
        sides = first.select(F.lit(1).alias("side"), "middle", F.col("a").alias("end")).unionByName(second.select(F.lit(2).alias("side"), "middle", F.col("b").alias("end")))
        sides = written(sides, "sides")
        first, second = sides.filter("side = 1").select(F.col("end").alias("a"), "middle"), sides.filter("side = 2").select("middle", F.col("end").alias("b"))
        sizes = written(_sizes(first, second), "sizes")
        alone, all_edges = sizes.agg(F.sum(F.when((F.col("n_in") == 0) | (F.col("n_out") == 0), F.col("n_in") + F.col("n_out"))), F.sum(F.col("n_in") + F.col("n_out"))).first()
        if (alone or 0) * 10 <= (all_edges or 0) or again + 1 == ROUNDS:
            break
        both = broadcast_if_small(sizes.filter("n_in > 0 and n_out > 0").select("middle"))
        first, second = first.join(both, "middle", "left_semi"), second.join(both, "middle", "left_semi")
    return first, second, sizes


def two_hop_paths(first: DataFrame, second: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(a, middle, b): all paths of an edge (a, middle) and an edge (middle, b); ``a`` and ``b`` may be one account.

    Edges of a hub are cut into blocks by their other end, as many as its edges need on either side, and every pair of
    blocks is one join key: no task holds more than about BLOCK_EDGES edges of a hub a side, however large it is. Middles
    with fewer edges are one block and are not repeated. The number of paths is known before they are made, from the sizes of
    the middles, and sets the number of tasks: the edges' own size says nothing about the work.
    """
    sizes = sizes or written(_sizes(first, second), "sizes")
    paths, hub = sizes.filter("n_in > 0 and n_out > 0").agg(F.sum(F.col("n_in").cast("double") * F.col("n_out")), F.max(F.greatest("n_in", "n_out"))).first()
    tasks = min(MOST_TASKS, max(1, int((paths or 0) / TASK_PATHS)))
    if (hub or 0) <= BLOCK_EDGES:
        return first.repartition(tasks, "middle").join(second.repartition(tasks, "middle"), "middle").select("a", "middle", "b")
    blocks = [F.ceil(F.col(n) / BLOCK_EDGES).cast("int").alias(b) for n, b in (("n_in", "_blocks_1"), ("n_out", "_blocks_2"))]
    hubs = broadcast_if_small(written(sizes.filter((F.col("n_in") > BLOCK_EDGES) | (F.col("n_out") > BLOCK_EDGES)).select("middle", *blocks), "hubs"))
    one = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), one(c) - 1))
    block = lambda end, c: F.pmod(F.xxhash64(end), one(c)).cast("int")
    keys = ["middle", "_i", "_j"]
    first = first.join(hubs, "middle", "left").withColumn("_i", block("a", "_blocks_1")).withColumn("_j", every("_blocks_2")).select("a", *keys)
    second = second.join(hubs, "middle", "left").withColumn("_j", block("b", "_blocks_2")).withColumn("_i", every("_blocks_1")).select("b", *keys)
    return first.repartition(tasks, *keys).join(second.repartition(tasks, *keys), keys).select("a", "middle", "b")


def scatter_gather_pairs(edges: DataFrame, least: int = 5) -> DataFrame:
    """(account_origin, account_destination, middles) with ``least`` or more middles and different ends.

    Accounts are numbered and the distinct edges written once. Before paths are paired, edges that can be on none are pruned
    from both ends. The path join and the final count are the only steps whose size is not linear in the edges; they work on
    numbers, and the partial count combines pairs before they shuffle. Edges are distinct, so counting rows counts middles.
    """
    numbered, ids = _numbered(written(edges, "edges"))
    paths = two_hop_paths(*_pruned(numbered, least)).filter(F.col("a") != F.col("b"))
    pairs = paths.groupBy("a", "b").agg(F.count(F.lit(1)).alias("middles")).filter(F.col("middles") >= least)
    name = lambda n, out: broadcast_if_small(ids.select(F.col("n").alias(n), F.col("account").alias(out)))
    return pairs.join(name("a", "account_origin"), "a").join(name("b", "account_destination"), "b").select("account_origin", "account_destination", "middles")


def flatten_pairs(pairs: DataFrame) -> DataFrame:
    """One account per row, two rows per pair; an account of several pairs repeats."""
    return pairs.select(F.explode(F.array("account_origin", "account_destination")).alias("account"))
