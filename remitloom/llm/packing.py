"""Filling fixed-capacity containers: vector best-fit over shards of items."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from remitloom.llm.tokens import with_token_counts
from remitloom.sources.shared import written

#: Items that one task packs at a time, about. More items leave less room unused per shard, at more work per item.
SHARD_ITEMS = 4096
#: Most documents in a container, as a share of its tokens: one for every eight tokens.
DOCS_PER_TOKEN = 1 / 8
#: Weights of the residuals of tokens, documents and attention cost when containers are compared.
WEIGHTS = (1.0, 0.05, 0.05)


def best_fit(sizes: np.ndarray, tokens: float, docs: float, attention: float, weights: tuple[float, float, float] = WEIGHTS) -> np.ndarray:
    """Container number of each item, under all three capacities.

    Every item has three demands: its tokens, one document, and its squared length as the cost of attention within
    it. Items come in order of falling size. An item goes to the open container in which the weighted norm of the
    three residuals, each as a share of its capacity, is least after it - among those that can hold it under every
    constraint - and to a new one if there is none. Of equal containers the oldest is taken. An item beyond a
    capacity on its own gets a container to itself.
    """
    n = len(sizes)
    bins = np.zeros(n, np.int64)
    order = np.argsort(-sizes, kind="stable")
    room = np.empty((3, n))
    open_ids = np.empty(n, np.int64)
    capacity = np.array([tokens, docs, attention], float)
    scale = np.array(weights) / capacity**2
    smallest, count, used = float(sizes.min()) if n else 0.0, 0, 0
    for step, k in enumerate(order):
        size = float(sizes[k])
        need = (size, 1.0, size * size)
        best = -1
        if used:
            t, d, a = room[0, :used] - need[0], room[1, :used] - need[1], room[2, :used] - need[2]
            cost = scale[0] * t * t + scale[1] * d * d + scale[2] * a * a
            cost[(t < 0) | (d < 0) | (a < 0)] = np.inf
            best = int(cost.argmin())
            if cost[best] == np.inf:
                best = -1
        if best < 0:
            best = used
            room[:, best] = capacity
            open_ids[best] = count
            count, used = count + 1, used + 1
        bins[k] = open_ids[best]
        room[:, best] -= need
        if room[0, best] < smallest or room[1, best] < 1 or room[2, best] < smallest * smallest:
            # full: nothing that is left fits; keep the order of the others, which decides among equals
            room[:, best : used - 1] = room[:, best + 1 : used]
            open_ids[best : used - 1] = open_ids[best + 1 : used]
            used -= 1
    return bins


def _pack(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values(["doc_id", "piece_no"], kind="stable").reset_index(drop=True)
    first = group.iloc[0]
    numbers = best_fit(group["n_tokens"].to_numpy(), first["capacity_tokens"], first["max_docs"], first["max_attention"])
    group["container_id"] = [f"{first['container_kind']}-{first['shard']}-{b}" for b in numbers]
    return group[["container_kind", "container_id", "doc_id", "piece_no", "token_start", "n_tokens"]]


def fill_containers(docs: DataFrame, specs: DataFrame, shard_items: int = SHARD_ITEMS, docs_per_token: float = DOCS_PER_TOKEN, attention_share: float = 1.0, path: str | None = None) -> DataFrame:
    """(container_kind, container_id, doc_id, piece_no, token_start, n_tokens): every document in containers of each kind.

    ``docs`` has a unique doc_id and text, ``specs`` container_kind and capacity_tokens; extra columns are ignored.
    Documents within a capacity stay whole (piece 0). Longer ones are cut into pieces of exactly the capacity, each a
    container of its own, and a rest that is packed like a document. NULL and empty texts have 0 tokens and take a
    place in a container too. A container holds at most ``capacity_tokens * docs_per_token`` documents and an attention
    cost of ``capacity_tokens ** 2 * attention_share``, but always at least one item.

    Items are hashed into shards of about ``shard_items``, which are packed apart: the shards grow in number, not in
    size, with the data, and each leaves at most its last few containers badly filled. Kinds with a NULL capacity or
    one below 1 are left out; the table of kinds is configuration and read by the driver.
    """
    kinds = [(r[0], int(r[1])) for r in specs.select("container_kind", "capacity_tokens").distinct().collect() if r[1] and r[1] >= 1]
    sizes = written(with_token_counts(docs, ["doc_id"], path), "sizes")
    schema = "container_kind string, container_id string, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"
    if not kinds:
        return sizes.sparkSession.createDataFrame([], schema)
    shards = max(1, math.ceil(sizes.count() / shard_items))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity_tokens")) for k, c in kinds]))
    items = sizes.select("doc_id", F.col("n_tokens").alias("size"), each.alias("k")).select("doc_id", "size", "k.*")
    last = F.greatest(F.ceil(F.col("size") / F.col("capacity_tokens")), F.lit(1)) - 1
    pieces = items.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    start = F.col("piece_no") * F.col("capacity_tokens")
    pieces = pieces.select("container_kind", "capacity_tokens", "doc_id", F.col("piece_no").cast("int").alias("piece_no"), start.alias("token_start"), F.least(F.col("size") - start, "capacity_tokens").alias("n_tokens"))
    whole = F.col("n_tokens") == F.col("capacity_tokens")
    alone = pieces.filter(whole).withColumn("container_id", F.concat_ws("-", "container_kind", F.lit("full"), "doc_id", "piece_no"))
    rest = (
        pieces.filter(~whole)
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
        .withColumn("max_docs", F.greatest(F.floor(F.col("capacity_tokens") * F.lit(docs_per_token)), F.lit(1)).cast("double"))
        .withColumn("max_attention", F.col("capacity_tokens").cast("double") * F.col("capacity_tokens") * F.lit(attention_share))
    )
    packed = rest.groupBy("container_kind", "shard").applyInPandas(_pack, schema)
    return packed.unionByName(alone.select(*packed.columns))


def fill_report(assigned: DataFrame, specs: DataFrame) -> DataFrame:
    """Per kind: containers, documents, tokens, the share of room filled, and the fewest containers that could do."""
    kinds = specs.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens"))
    sums = assigned.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    out = sums.groupBy("container_kind").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))
    out = out.join(kinds, "container_kind")
    return out.select("container_kind", "capacity_tokens", "containers", "items", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("fill"), F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("fewest"))


def constraint_report(assigned: DataFrame, specs: DataFrame, docs_per_token: float = DOCS_PER_TOKEN, attention_share: float = 1.0) -> DataFrame:
    """Per kind: containers, those full up to the attention cost of their smallest item, those with one item beyond it, and those
    that break each of the three capacities with more than one item, of which there must be none."""
    capacity = F.col("capacity_tokens")
    kinds = specs.select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity_tokens")).filter(capacity >= 1).distinct()
    cost = F.col("n_tokens").cast("double") * F.col("n_tokens")
    sums = assigned.groupBy("container_kind", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"), F.sum(cost).alias("attention"), F.min(cost).alias("least"))
    most = capacity.cast("double") * capacity * attention_share
    shared = F.col("items") > 1
    count = lambda c: F.count(F.when(c, 1))
    return sums.join(kinds, "container_kind").groupBy("container_kind").agg(
        F.count(F.lit(1)).alias("containers"),
        count(F.col("attention") + F.col("least") > most).alias("bound_by_attention"),
        count(~shared & (F.col("attention") > most)).alias("alone_beyond_attention"),
        count(shared & (F.col("tokens") > capacity)).alias("over_tokens"),
        count(shared & (F.col("items") > F.greatest(F.floor(capacity * docs_per_token), F.lit(1)))).alias("over_documents"),
        count(shared & (F.col("attention") > most)).alias("over_attention"),
    )
