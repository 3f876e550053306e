"""Mixing sources to target weights: Sainte-Laguë apportionment of equal-token blocks, in DataFrame operations alone.

The words of a source, its documents in seeded order, form one stream that is cut into blocks of as many
words each. Seats of a mix are given to sources by highest quotients target / (2 seats + 1); as more seats
never take one from a source, the quotas of each shard are differences of two such allotments, whole numbers
that add up. A source fills its quota with its blocks in a seeded order, from the start again when all are used.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import Workspace, documents

WORDS = r"[^\x20\x09-\x0D]+"
#: Strides of the seeded block order; the first that does not divide the number of blocks is used.
STRIDES = (1000003, 1000033, 1000037, 1000039)
#: Documents that a bucket of a source's stream has, about.
BUCKET = 2000


def sized(frame: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source and size in words (0 for a null text), and what else is named; else the texts end here, in the scan."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORDS)), F.lit(0)).cast("bigint")
    return documents(frame, F.col("source").cast("string").alias("source"), *more).withColumn("size", size.alias("size")).drop("text")


def targets(sources: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """source_key, nth, source_size, target, total: weights repeat over sources in code point order, null last.

    A target is the smaller of most times the size and level times the weight; the level at which they add up
    to share times all sizes is the largest of those that the sources up to each one (by size for its weight)
    leave to the rest. There is one row a source.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    out = sources.selectExpr("*", "row_number() over (order by source nulls last) as nth", "sum(source_size) over () as total").withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(most)))
    below = "(order by most / weight, nth rows between unbounded preceding and current row)"
    out = out.selectExpr("*", f"({share}D * total - (sum(most) over {below} - most)) / (sum(weight) over () - (sum(weight) over {below} - weight)) as level")
    return out.selectExpr("source_key", "nth", "source_size", "least(most, max(level) over () * weight) as target", "total")


def apportioned(sources: DataFrame, share: float, shards: int, block: int | None) -> DataFrame:
    """sources with block (its words) and quotas: the seats of all shards up to each, an array.

    Of each source only the seats near its exact share are ranked; all seats before those are won, all after
    lost, for rounding moves the sum of all sources by half their number at most.
    """
    # a source misses its target by two blocks at most, so the smallest one has many
    per_block = f"cast({block} as bigint)" if block else "greatest(1, least(1024, total div 65536, coalesce(min(nullif(source_size, 0)) over (), 0) div 64))"
    base = sources.selectExpr("*", f"{per_block} as block", "count(1) over () as n").selectExpr("*", f"cast(floor({share}D * total / block) as bigint) as seats")
    each = base.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards)))).selectExpr("*", f"seats * shard div {shards} as upto", f"target / greatest(1D, {share}D * total) as part")
    each = each.selectExpr("*", "cast(greatest(0, floor(part * (upto - n / 2 - 1) + 0.5D)) as bigint) as won", "cast(case when part > 0 then ceil(part * (upto + n / 2 + 1)) + 1 else 0 end as bigint) as last")
    near = each.where("last > won").selectExpr("shard", "nth", "target", "explode(sequence(won + 1, last)) as seat")
    ranked = near.selectExpr("shard", "nth", "row_number() over (partition by shard order by target / (2 * seat - 1) desc, nth) as place")
    to_win = each.groupBy("shard").agg(F.max(F.col("upto")).alias("upto"), F.sum("won").alias("won_all"))
    gained = ranked.join(to_win, "shard").where("place <= upto - won_all").groupBy("shard", "nth").agg(F.count(F.lit(1)).alias("gained"))
    quota = each.join(gained, ["shard", "nth"], "left").selectExpr("nth", "shard", "won + coalesce(gained, 0) as quota")
    lists = quota.groupBy("nth").agg(F.expr("transform(array_sort(collect_list(struct(shard, quota))), x -> x.quota)").alias("quotas"))
    return base.join(lists, "nth")


def picks(b: Column) -> Column:
    """How often the source's quota takes block b."""
    return F.least(F.lit(2), F.expr("quota div blocks") + (place(b) < F.expr("quota % blocks")).cast("bigint"))


def place(b: Column) -> Column:
    """The block's place in its source's seeded order, a permutation."""
    return (F.col("stride") * b + F.col("shift")) % F.col("blocks")


def mix(frame: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = (3, 1, 2), shards: int = 16, seed: str = "mix", block: int | None = None, detail: bool = False, carry: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, block (its words), quota (blocks that the source gets) and shard_quotas (how many of them in each shard, comma-joined) of every document; with detail also its picked blocks and their shards, with carry its whole row.

    A null source is a source of its own; null texts have no words and are not taken. Streams are prefix sums
    in two steps, over buckets of a source's seeded order and within them, so that a source with most of the
    rows, or rows of one id, are spread over many tasks; rows equal in id and text stay together. Rows equal in id,
    text, source and size may change places. A block has a word for every 65,536 of the whole corpus, 1024 at most and
    no more than a 64th of the smallest source that has words, 1 at least, or as many as block says. No documents give no rows.
    """
    space = Workspace(frame.sparkSession, "mixing")
    # rows without an id, or with the same one, are told apart by their texts
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    rows = sized(frame, key.alias("key"), *[F.struct("*").alias("row")] * carry).withColumn("source_key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")))
    saved = space.save(rows, "sizes")
    digits = max(1, math.ceil(math.log(max(saved.count(), 1) / BUCKET + 1, 16)))
    saved = saved.withColumn("bucket", F.substring("key", 1, digits))
    buckets = saved.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"), F.max("source").alias("source"))
    # sums before each bucket in two steps, over groups of buckets and within them, so that no task has all buckets of a source
    buckets = buckets.withColumn("part", F.substring("bucket", 1, (digits + 1) // 2))
    parts = buckets.groupBy("source_key", "part").agg(F.sum("words").alias("part_words")).selectExpr("source_key", "part", "sum(part_words) over (partition by source_key order by part rows between unbounded preceding and current row) - part_words as part_base")
    inside = buckets.selectExpr("*", "sum(words) over (partition by source_key, part order by bucket rows between unbounded preceding and current row) - words as inner_base")
    buckets = space.save(inside.join(parts, ["source_key", "part"]).withColumn("base", F.col("part_base") + F.col("inner_base")).drop("part", "part_base", "inner_base"), "buckets")
    sources = buckets.groupBy("source_key").agg(F.sum("words").alias("source_size"), F.max("source").alias("source"))
    known = apportioned(targets(sources, share, most, weights), share, shards, block)
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "source_key")), 1, 8), 16, 10).cast("bigint")
    stride = reduce(lambda rest, p: F.when(F.col("blocks") % p != 0, p).otherwise(rest), reversed(STRIDES[:-1]), F.lit(STRIDES[-1]))
    per_shard = F.array_join(F.transform("quotas", lambda q, at: (q - F.coalesce(F.get("quotas", at - 1), F.lit(0))).cast("string")), ",")
    known = known.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / F.col("block"))).cast("bigint"))
    known = known.select("source_key", "source_size", "target", "block", "blocks", "quotas", F.element_at("quotas", -1).alias("quota"), per_shard.alias("shard_quotas"), shift.alias("shift"), stride.cast("bigint").alias("stride"))
    streams = saved.selectExpr("*", "sum(size) over (partition by source_key, bucket order by key, doc_id, size rows between unbounded preceding and current row) - size as within")
    placed = streams.join(buckets.select("source_key", "bucket", "base").join(known, "source_key"), ["source_key", "bucket"]).withColumn("first", F.col("base") + F.col("within"))
    span = F.sequence(F.expr("first div block"), F.expr("(first + size - 1) div block"))

    def overlap(b: Column) -> Column:
        return F.least(F.col("first") + F.col("size"), (b + 1) * F.col("block")) - F.greatest(F.col("first"), b * F.col("block"))

    taken = F.when(F.col("size") > 0, F.aggregate(span, F.lit(0).cast("bigint"), lambda sofar, b: sofar + overlap(b) * picks(b))).otherwise(F.lit(0).cast("bigint"))
    out = placed.withColumn("taken", taken)
    columns = ["doc_id", "source", "size", "source_size", "target", "taken", "block", "quota", "shard_quotas"] + ["row"] * carry
    if detail:
        def seat(b: Column, turn: Column) -> Column:
            at = turn * F.col("blocks") + place(b)
            return F.struct(b.alias("block"), turn.alias("turn"), (F.size(F.filter("quotas", lambda q: q <= at)) + 1).alias("shard"), F.greatest(F.lit(0), b * F.col("block") - F.col("first")).alias("from_word"), overlap(b).alias("words"))

        turns = F.flatten(F.transform(F.filter(span, lambda b: picks(b) > 0), lambda b: F.transform(F.sequence(F.lit(0).cast("bigint"), picks(b) - 1), lambda turn: seat(b, turn))))
        out, columns = out.withColumn("picked", F.when(F.col("size") > 0, turns)), [*columns, "picked"]
    return out.select(*columns)


def mixed(frame: DataFrame, **options) -> DataFrame:
    """The mix itself: of each document one row for each time that its source is gone through, with the words of its picked blocks; all its columns stay.

    A text all of whose words are picked stays as it is; else it has the picked words and the white space after each.
    """
    found = mix(frame, detail=True, carry=True, **options)
    turned = found.where("taken > 0").withColumn("turn", F.explode(F.array_distinct(F.transform("picked", lambda p: p["turn"]))))
    own = F.filter("picked", lambda p: p["turn"] == F.col("turn"))
    words = F.regexp_extract_all(F.col("row.text"), F.lit(WORDS + r"[\x20\x09-\x0D]*"), F.lit(0))
    turned = turned.withColumn("own", own).withColumn("all_words", F.aggregate("own", F.lit(0).cast("bigint"), lambda n, p: n + p["words"]) == F.col("size"))
    cut = turned.withColumn("words", F.when(~F.col("all_words"), words))
    parts = F.flatten(F.transform("own", lambda p: F.slice("words", (p["from_word"] + 1).cast("int"), p["words"].cast("int"))))
    text = F.when(F.col("all_words"), F.col("row.text")).otherwise(F.array_join(parts, ""))
    return cut.select(*(text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in frame.columns))
