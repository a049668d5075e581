"""Mixing sources to target weights: weighted fair queueing over shuffled documents."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from remitloom.llm.tokens import with_token_counts
from remitloom.operators.prefix import running_total
from remitloom.sources.shared import written

SEED = 20220901


def source_name(name: Column) -> Column:
    """A source in one spelling: lower case, outer blanks off, blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"[\s\-_]+", "_")


def virtual_time(budget: float, sources: list[tuple[float, float]]) -> float:
    """The time at which sources of (share, tokens at most) have together given ``budget`` tokens; inf if they can't.

    A source gives tokens in proportion to its share until it runs dry; from then on the others fill its place.
    """
    left, weight, now = budget, sum(w for w, _ in sources), 0.0
    for dry, w, cap in sorted((cap / w, w, cap) for w, cap in sources):
        if weight * dry >= left:
            return left / weight
        left, weight, now = left - cap, weight - w, dry
        if weight <= 1e-12:
            break
    return now if left <= 0 else math.inf


def sized_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of documents with a source and at least one token, written once."""
    named = docs.withColumn("source", source_name(F.col("source"))).filter(F.col("source").isNotNull())
    return written(with_token_counts(named, ["doc_id", "source"], path).filter("n_tokens > 0"), "sizes")


def mix_sources(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens, finish): the mixture, each row one use of a document.

    ``sized`` comes from :func:`sized_documents`; ``targets`` has source, target_share, max_repeats. Sources that have
    no documents can give nothing: the others keep their proportions. Sources without a target, with a share or a
    number of repeats below what can be used, give nothing. Without ``total_tokens`` the budget is the largest at
    which every source that has documents reaches its share within its repeats.

    The documents of a source are shuffled by a keyed hash, anew for every repetition, and all of them are used once
    before any is used again. Each use gets a virtual finish time, the running total of its source's tokens divided by
    the target share; uses are put in order of finish time over all sources and cut where the budget is reached. Both
    running totals are distributed. Only one row per source of the targets table, which is configuration, reaches the
    driver.
    """
    plans = targets.select(source_name(F.col("source")).alias("source"), "target_share", F.col("max_repeats").cast("int").alias("max_repeats"))
    plans = plans.filter((F.col("target_share") > 0) & (F.col("max_repeats") > 0)).groupBy("source").agg(F.max("target_share").alias("share"), F.max("max_repeats").alias("repeats"))
    own = sized.join(plans, "source")
    stats = own.groupBy("source", "share", "repeats").agg(F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("longest")).collect()  # one row per target
    schema = "doc_id bigint, source string, copy_no int, n_tokens bigint, finish double"
    if not stats:
        return sized.sparkSession.createDataFrame([], schema)
    weight = sum(r["share"] for r in stats)
    if total_tokens is None:
        total_tokens = int(min(r["tokens"] * r["repeats"] / r["share"] for r in stats) * weight)
    until = virtual_time(total_tokens, [(r["share"], float(r["tokens"] * r["repeats"])) for r in stats])
    # whatever finishes by then fits the budget; the cut can lie later by at most all sources' longest documents
    slack = sum(r["longest"] for r in stats) / min(r["share"] for r in stats)
    copies = {r["source"]: r["repeats"] if math.isinf(until) else max(1, min(r["repeats"], math.ceil((until + slack) * r["share"] / r["tokens"]))) for r in stats}
    count = F.create_map(*[F.lit(x) for s, n in copies.items() for x in (s, n)])[F.col("source")]
    uses = own.select("doc_id", "source", "share", "n_tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("copy_no"))
    shuffled = F.xxhash64("doc_id", "copy_no", F.lit(seed))
    queued = running_total(uses, ["source"], [F.col("copy_no"), shuffled, F.col("doc_id")], "n_tokens", "served", "queues")
    timed = queued.withColumn("finish", F.col("served") / F.col("share"))
    if not math.isinf(until):
        timed = timed.filter(F.col("finish") <= until + slack)
    ordered = running_total(timed.select("doc_id", "source", "copy_no", "n_tokens", "finish"), [], [F.col(c) for c in ("finish", "source", "copy_no", "doc_id")], "n_tokens", "total", "mixture")
    return ordered.filter(F.col("total") <= total_tokens).select("doc_id", "source", "copy_no", "n_tokens", "finish")


def shares(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: source, target_share, actual_share, tokens, documents, uses, most_repeats; 0 where a source gave nothing."""
    per_document = mixture.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("times"), F.sum("n_tokens").alias("tokens"))
    given = per_document.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.sum("times").alias("uses"), F.max("times").alias("most_repeats"))
    total = given.agg(F.sum("tokens")).scalar()
    plans = targets.select(source_name(F.col("source")).alias("source"), "target_share")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    share = F.coalesce(F.col("tokens") / total, F.lit(0.0)).alias("actual_share")
    return plans.join(given, "source", "left").select("source", "target_share", share, zero("tokens"), zero("documents"), zero("uses"), zero("most_repeats"))
