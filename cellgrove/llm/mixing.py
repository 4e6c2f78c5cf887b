"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, word_count

BLOCK_TOKENS = 16
SHARD_TOKENS = 1 << 20
#: A source has this many shards at most; beyond, they grow.
MOST_SHARDS = 1 << 16
SEED = 17


def sainte_lague(df: DataFrame, group: list[str], item: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each row when its group's `seats` go to the highest quotients votes/(2k-1).

    Rounded quotas come first; what they give too little or too much is settled by ranking only the quotients that
    can still win or lose a seat, at most about three a row, so nothing is exploded by the number of seats. Groups
    without votes get no seats; equal quotients go to the smaller item.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    d = (
        df.withColumn("_v", F.sum(F.col(votes).cast("double")).over(whole))
        .withColumn("_n", F.count(F.lit(1)).over(whole))
        .withColumn("_q", F.coalesce(F.try_divide(F.col(votes) * F.col(seats), F.col("_v")), F.lit(0.0)))
        .withColumn("_s0", F.floor(F.col("_q") + 0.5))
        .withColumn("_d", F.when(F.col("_v") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("_s0").over(whole))
        .withColumn("_reach", F.ceil((F.abs("_d") + F.col("_n")) * F.coalesce(F.try_divide(F.col(votes), F.col("_v")), F.lit(0.0))) + 1)
    )
    more = F.sequence(F.col("_s0") + 1, F.col("_s0") + F.col("_reach"))
    fewer = F.sequence(F.greatest(F.col("_s0") - F.col("_reach") + 1, F.lit(1).cast("long")), F.col("_s0"))
    none = F.array().cast("array<bigint>")
    ks = F.when((F.col("_d") > 0) & (F.col(votes) > 0), more).when((F.col("_d") < 0) & (F.col("_s0") > 0), fewer).otherwise(none)
    c = d.select(*group, *item, "_d", F.explode(ks).alias("_k"), F.col(votes).alias("_vote"))
    quotient = F.col("_vote") / (2 * F.col("_k") - 1)
    names = [F.col(x).asc_nulls_last() for x in item]
    ranks = Window.partitionBy(*(group or [F.lit(0)]), F.col("_d") > 0)
    ranked = c.withColumn("_r", F.when(F.col("_d") > 0, F.row_number().over(ranks.orderBy(quotient.desc(), *names, "_k"))).otherwise(F.row_number().over(ranks.orderBy(quotient.asc(), *[F.col(x).desc_nulls_first() for x in item], F.col("_k").desc()))))
    moved = ranked.where(F.col("_r") <= F.abs("_d")).groupBy(*group, *item).agg(F.sum(F.signum(F.col("_d").cast("double"))).cast("long").alias("_m"))
    keys = [*group, *item]
    m = moved.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_m")
    on = None
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_k_{k}")) if on is None else on & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return d.join(m, on, "left").withColumn(out, (F.col("_s0") + F.coalesce("_m", F.lit(0))).cast("long")).select(*df.columns, out)


def targets(sources: DataFrame, cap: float = 3.0) -> DataFrame:
    """Adds `target` to rows (source, source_size): weights 1, 2, 3, repeating in code point order, share all sizes.

    A target stops at cap times its source's size and the excess goes to the others by weight: the level L with
    sum(min(cap * size, L * weight)) = total, found from running sums over the sources ordered by cap * size / weight.
    """
    w = Window.partitionBy(F.lit(0))
    d = (
        sources.withColumn("_w", (F.pmod(F.row_number().over(w.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(3)) + 1).cast("double"))
        .withColumn("_cap", F.col("source_size") * F.lit(cap))
        .withColumn("_r", F.col("_cap") / F.col("_w"))
    )
    order = w.orderBy("_r", F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing))
    d = d.withColumn("_level", (F.sum("source_size").over(w) - before) / rest)
    level = F.max(F.when(F.col("_level") <= F.col("_r") * (1 + 1e-12), F.col("_level"))).over(w)
    return d.withColumn("target", F.least(F.col("_cap"), F.coalesce(level, F.lit(0.0)) * F.col("_w"))).select(*sources.columns, "target")


def mix(docs: DataFrame, size: Column | None = None, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, shard, taken.

    Each source is split into shards of about shard_tokens by a hash of doc_id, so that a hot source is many tasks (one
    for its at most MOST_SHARDS shard totals; sources are few, their totals meet in one task). Blocks of block_tokens
    go to the sources, then to each source's shards, by highest quotient. A shard's documents stand in seeded order and
    are cut into blocks; it is taken as a whole as often as its quota allows, and of the rest so many blocks as fit
    come from a seeded, evenly spaced choice. So a document is taken by whole blocks, parts of which may lie in the
    documents beside it, and never beyond 3 times its size.
    Null text counts 0 words; a null source is a source of its own, last; repeated rows are rows of their own; an
    empty table gives an empty result. Further columns are ignored.
    """
    # rows without doc_id are told apart by their text, else they would all be one shard
    tie = F.when(F.col("doc_id").isNull(), F.xxhash64("text")) if "text" in docs.columns else F.lit(None).cast("long")
    sized = settle(docs.select("doc_id", "source", (word_count(F.col("text")) if size is None else size).alias("size"), tie.alias("_tie")))
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = Window.partitionBy(F.lit(0))
    aimed = targets(sources).withColumn("_seats", F.round(F.sum("target").over(total) / block_tokens).cast("long"))
    aimed = sainte_lague(aimed, [], ["source"], "target", "_seats", "_blocks").drop("_seats")
    aimed = settle(aimed.withColumn("_shards", F.greatest(F.least(F.ceil(F.col("source_size") / shard_tokens), F.lit(MOST_SHARDS)), F.lit(1))))
    src = aimed.select(F.col("source").alias("_source"), "source_size", "target", "_blocks", "_shards")
    placed = sized.join(src, F.col("source").eqNullSafe(F.col("_source"))).withColumn("shard", F.pmod(F.xxhash64("doc_id", "_tie", F.lit(seed)), F.col("_shards")).cast("int"))
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("_z"), F.first("_blocks").alias("_blocks"))
    quotas = sainte_lague(shards, ["source"], ["shard"], "_z", "_blocks", "_quota")
    quotas = quotas.select(F.col("source").alias("_qs"), F.col("shard").alias("_qh"), "_z", F.least(F.col("_quota") * block_tokens, 3 * F.col("_z")).alias("_need"))
    order = Window.partitionBy("source", "shard").orderBy(F.xxhash64("doc_id", "_tie", F.lit(seed + 1)), "doc_id", "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = placed.join(quotas, F.col("source").eqNullSafe(F.col("_qs")) & (F.col("shard") == F.col("_qh")))
    times = F.when(F.col("_z") > 0, F.floor(F.col("_need") / F.col("_z"))).otherwise(F.lit(0))
    d = d.withColumn("_times", times).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    blocks = F.ceil(F.col("_z") / block_tokens)
    d = d.withColumn("_all", F.greatest(blocks, F.lit(1))).withColumn("_some", F.least(F.round((F.col("_need") - F.col("_times") * F.col("_z")) / block_tokens).cast("long"), blocks))
    # the place of the first chosen block comes from the seed; the last, shorter one is only taken with all others
    spare = F.greatest(F.col("_all") - F.col("_some"), F.lit(1))
    d = d.withColumn("_u", F.when(F.col("_some") < F.col("_all"), F.col("_some") + F.pmod(F.xxhash64("source", "shard", F.lit(seed)), spare)).otherwise(F.lit(0)))
    part = _taken_before(F.col("_before") + F.col("size"), block_tokens) - _taken_before(F.col("_before"), block_tokens)
    return d.select("doc_id", "source", "size", "source_size", "target", "shard", (F.col("_times") * F.col("size") + part).cast("long").alias("taken"))


def _taken_before(place: Column, block: int) -> Column:
    """The words before a place of a shard that lie in chosen blocks: block j is chosen where (j * _some + _u) div _all steps up."""
    j = F.floor(place / block)
    step = lambda k: F.floor((k * F.col("_some") + F.col("_u")) / F.col("_all"))
    return block * step(j) + (step(j + 1) - step(j)) * (place - j * block)
