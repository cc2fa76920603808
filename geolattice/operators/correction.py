"""Coverage corrected for what a reviewed sample says of each stratum: shares are drawn, things kept by them, and the covered counted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolattice.functions.draws import jeffreys, uniform

#: Draws that one number holds, a bit for each.
WORD = 64


def drawn_shares(strata: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(draw, stratum, share) of (stratum, yes, no): ``draws`` rows for each stratum."""
    every = strata.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    return every.select("draw", "stratum", jeffreys(F.col("yes"), F.col("no"), F.lit(seed), F.col("draw"), F.col("stratum")).alias("share"))


def kept_words(things: DataFrame, shares: DataFrame, draws: int, seed: int = 0) -> DataFrame:
    """(thing, word, bits): in which draws each thing (thing, stratum, known boolean or null) is kept: in all or none if known, else by its stratum's share.

    Unknown things of strata that weren't reviewed are in none. Unknown things are dealt out by number: they are small rows with many draws each.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // WORD)))
    always = things.filter("known").select("thing", every.alias("word"), F.lit(-1).cast("long").alias("bits"))
    words = shares.groupBy("stratum", F.floor(F.col("draw") / WORD).cast("int").alias("word")).agg(F.collect_list(F.struct("draw", "share")).alias("s"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda x: F.when(uniform(F.lit(seed), F.lit("keep"), x["draw"], F.col("thing")) < x["share"], F.call_function("shiftleft", one, (x["draw"] % WORD).cast("int"))).otherwise(none)
    n = int(things.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = things.filter("known is null").repartition(n, "thing").join(F.broadcast(words), "stratum").select("thing", "word", F.aggregate("s", none, lambda bits, x: bits.bitwiseOR(bit(x))).alias("bits"))
    return always.unionByName(drawn.filter("bits <> 0"))


def covered(kept: DataFrame, covers: DataFrame, people: DataFrame, draws: int) -> DataFrame:
    """(draw, share) of the people (block, pop) whose block some kept thing covers (thing, block), for each draw.

    A block is covered in the draws of any of its things, so bits of draws are joined by OR, WORD draws a row; no row is made for a draw and a
    pair of thing and block.
    """
    any_ = covers.select("thing", "block").join(kept, "thing").groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))
    bit = F.expr(f"transform(sequence(0, {WORD - 1}), k -> shiftrightunsigned(bits, k) & 1L)")
    sums = any_.join(people, "block").select("word", "pop", F.posexplode(bit).alias("k", "on")).filter("on = 1").groupBy((F.col("word") * WORD + F.col("k")).alias("draw")).agg(F.sum("pop").alias("n"))
    all_ = people.agg(F.sum("pop").cast("double").alias("all"))
    every = people.sparkSession.range(draws).select(F.col("id").cast("int").alias("draw"))
    return every.join(sums, "draw", "left").join(F.broadcast(all_)).select("draw", (F.coalesce("n", F.lit(0)) / F.col("all")).alias("share"))
