"""Mixing sources to target weights: Sainte-Laguë quotas of equal-token blocks.

Every source is cut into shards, every shard into blocks of ``block`` words over its
documents in a seeded order. Sources, and then the shards of a source, receive whole
blocks by highest quotients t/(2k+1). A shard with a quota of q over n blocks takes every
block q // n times and a seeded, evenly spread q % n of them once more.

Defined cases: a null or empty text has size 0 and nothing is taken of it; a null source is
a source of its own, ordered last; a source of size 0 has target 0; repeated rows are separate
documents; an empty table gives an empty result; columns other than id, text and source
are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airlattice.llm.common import WORD_GAP, Scratch

WEIGHTS = (3, 1, 2)
SHARE = (3, 2)          # the mix holds 3/2 of all words
CAP = 2                 # no source, and no document, more than twice
BLOCK = 16              # words of a block
SHARD_WORDS = 1 << 20   # words of a shard: bounds what one task orders
SEED = "mix-1"


def word_count(text):
    """Words of a text column, 0 for null."""
    parts = F.split(F.coalesce(text, F.lit("")), WORD_GAP)
    blank = F.when(parts[0] == "", 1).otherwise(0) + F.when(
        (F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - blank).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, cap: int = CAP) -> DataFrame:
    """(source, source_size) -> plus idx (1.. by code point, null last), weight, target.

    Water filling: targets grow with the weights until one reaches cap * size and stops; what
    it leaves goes to the rest by weight. With the sources ordered by size / weight, the
    first k stop and the others share what is left, so one ordered pass finds them all.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    byratio = Window.orderBy(F.col("source_size") / F.col("weight"), "idx")
    upto = byratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = byratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    num, den = share
    w = F.array(*[F.lit(int(x)).cast("long") for x in weights])
    base = (sources.withColumn("idx", F.row_number().over(order))
            .withColumn("weight", F.element_at(w, ((F.col("idx") - 1) % len(weights) + 1).cast("int")))
            .withColumn("all_size", F.sum("source_size").over(whole))
            .withColumn("stopped", F.coalesce(F.sum(F.col("source_size") * cap).over(upto), F.lit(0)))
            .withColumn("w_rest", F.sum("weight").over(rest)))
    left = F.col("all_size") * num - F.col("stopped") * den   # times den
    base = (base.withColumn("left", left)
            .withColumn("free", F.col("left").cast("decimal(38,0)") * F.col("weight").cast("decimal(20,0)")
                        < (F.col("source_size") * (cap * den)).cast("decimal(38,0)") * F.col("w_rest").cast("decimal(20,0)")))
    first = F.min(F.when(F.col("free"), F.struct(F.col("source_size") / F.col("weight"), F.col("idx"),
                                                 F.col("left").alias("l"), F.col("w_rest").alias("w")))).over(whole)
    base = base.withColumn("first", first)
    at = F.struct((F.col("source_size") / F.col("weight")).alias("r"), F.col("idx"))
    fill = F.col("weight") * F.col("first.l") / (F.lit(float(den)) * F.col("first.w"))
    stopped = F.col("first").isNull() | (at < F.struct(F.col("first.col1").alias("r"), F.col("first.idx")))
    return base.select("source", "source_size", "idx", "weight",
                       F.when(stopped, (F.col("source_size") * cap).cast("double")).otherwise(fill).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], vote: str, seats: str, order: str) -> DataFrame:
    """Add ``quota``: the ``seats`` of each group go to its parties by highest quotients vote/(2k+1).

    Seats are first set to the nearest whole share. The true apportionment differs from that
    by at most the party's part of half the party count, and one more for rounding, so only
    the seats near there compete: about 7 rows per party whatever the number of seats.
    Ties go to the lower ``order``. Groups without votes give no seats.
    """
    g = Window.partitionBy(*group)
    share = F.when(F.col("_votes") > 0, F.col(vote) / F.col("_votes")).otherwise(F.lit(0.0))
    near = (parties.withColumn("_votes", F.sum(vote).over(g)).withColumn("_n", F.count(F.lit(1)).over(g))
            .withColumn("_near", F.floor(share * F.col(seats) + 0.5))
            .withColumn("_reach", F.ceil(share * F.col("_n") / 2).cast("long") + 2)
            .withColumn("_sure", F.greatest(F.lit(0).cast("long"), F.col("_near") - F.col("_reach"))))
    near = near.withColumn("_open", F.col(seats) - F.sum("_sure").over(g))
    rivals = near.where((F.col("_votes") > 0) & (F.col(vote) > 0)).select(
        *group, order, vote, "_open", F.explode(F.sequence("_sure", F.col("_near") + F.col("_reach"))).alias("_seat"))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(
        (F.col(vote) / (2 * F.col("_seat") + 1)).desc(), F.col(order)))
    won = (rivals.withColumn("_rank", rank).where("_rank <= _open")
           .groupBy(*group, order).agg(F.count(F.lit(1)).alias("_won")))
    cond = [F.col(f"n.{c}").eqNullSafe(F.col(f"x.{c}")) for c in [*group, order]]
    return near.alias("n").join(won.alias("x"), cond, "left").select(
        *[F.col(f"n.{c}") for c in parties.columns],
        F.when(F.col("n._votes") > 0, F.col("n._sure") + F.coalesce(F.col("x._won"), F.lit(0)))
         .otherwise(F.lit(0)).cast("long").alias("quota"))


def mix(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", source: str = "source",
        weights=WEIGHTS, share=SHARE, cap: int = CAP, block: int = BLOCK,
        shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """documents -> doc_id, size, source, source_size, target, taken."""
    mark = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    sized = scratch.save(docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"),
        word_count(F.col(text)).alias("size"), mark.alias("mark")), "mix-sized")
    src = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    src = scratch.save(src.withColumn("n_shards", F.greatest(
        F.lit(1).cast("long"), F.ceil(F.col("source_size") / shard_words))), "mix-sources")

    spread = sized.join(F.broadcast(src) if src.count() <= 10_000 else src,
                        sized["source"].eqNullSafe(src["source"])) \
        .select("doc_id", "size", "mark", "idx", "n_shards",
                (F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % F.col("n_shards")).alias("shard"))
    shards = spread.groupBy("idx", "shard").agg(F.sum("size").alias("shard_size"))
    shards = scratch.save(shards.where("shard_size > 0").withColumn(
        "n_blocks", F.ceil(F.col("shard_size") / block).cast("long")), "mix-shards")

    # Targets in blocks: the words of a source over its own mean block, so a full one is whole.
    votes = (src.join(shards.groupBy("idx").agg(F.sum("n_blocks").alias("n")), "idx")
             .select("idx", (F.col("target") * F.col("n") / F.col("source_size")).alias("votes"))
             .withColumn("all_sources", F.lit(0)))
    votes = votes.withColumn("seats", F.round(F.sum("votes").over(Window.partitionBy("all_sources"))).cast("long"))
    won = sainte_lague(votes, ["all_sources"], "votes", "seats", "idx").select("idx", F.col("quota").alias("seats"))
    quota = sainte_lague(shards.join(won, "idx"), ["idx"], "n_blocks", "seats", "shard").select(
        "idx", "shard", "shard_size", "n_blocks",
        F.least("quota", F.col("n_blocks") * cap).alias("quota"))
    quota = scratch.save(quota, "mix-quotas")

    line = Window.partitionBy("idx", "shard").orderBy("mark", "doc_id", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = spread.where("size > 0").withColumn("end", F.sum("size").over(line)) \
        .withColumn("start", F.col("end") - F.col("size")).join(quota, ["idx", "shard"])
    again, n = F.col("quota") % F.col("n_blocks"), F.col("n_blocks")
    turn = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col("idx").cast("string"), F.lit("|"),
                                             F.col("shard").cast("string"))), 1, 7), 16, 10).cast("long") % n

    def picked(k):
        """Blocks before block k that are taken once more (evenly spread, turned by the seed)."""
        return F.floor((k * again + turn) / n) - F.floor(turn / n)

    def words_before(pos):
        """Words of those blocks before a position of the shard."""
        k = F.floor(pos / block)
        return picked(k) * block + (picked(k + 1) - picked(k)) * (pos - k * block)

    taken = F.floor(F.col("quota") / n) * F.col("size") + words_before(F.col("end")) - words_before(F.col("start"))
    # The last block of a shard may be short; a position never lies beyond it, so sums stay right.
    some = placed.select("doc_id", "size", "idx", taken.cast("long").alias("taken"))
    none = spread.where("size = 0").select("doc_id", "size", "idx", F.lit(0).cast("long").alias("taken"))
    return some.unionByName(none).join(
        F.broadcast(src) if src.count() <= 10_000 else src, "idx").select(
        "doc_id", "size", "source", "source_size", "target", "taken")
