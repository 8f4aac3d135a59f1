"""Overlap queries on fragments (contig, start, stop, length ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.intervals import MAX_LENGTH
from tidelane.operators.parallel import spread

#: Width of the bins that a batch of regions is joined by.
BIN = 5_000
#: Bins of all regions that are broadcast (about 100 bytes each); more are joined in a shuffle.
MAX_BROADCAST_BINS = 400_000
#: Fragments of a bin per salt, where the join is a shuffle: bins of deep coverage are split. Totals: regions' ends of a bin per salt.
BIN_ROWS = 50_000


def overlaps(contig: str | None, start: int, stop: int, max_length: int = MAX_LENGTH, midpoint: bool = False) -> Column:
    """Fragments that overlap [start, stop), of one contig or (None) of every one, and are no longer than ``max_length``.

    The lower bound on the start follows from the others; it is there for Parquet's statistics, which can't use a sum.
    """
    fits = (F.lit(True) if contig is None else F.col("contig") == contig) & (F.col("start") < stop) & (F.col("start") >= start - max_length) & (F.col("stop") > start) & (F.col("length") <= max_length)
    if midpoint:
        middle = F.col("start") - start + F.floor(F.col("length") / 2)
        fits = fits & (middle >= 0) & (middle < stop - start)
    return fits


def by_chunk(fragments: DataFrame, width: int) -> DataFrame:
    """Adds the chunk of its contig that owns each fragment: the one that its start lies in."""
    return fragments.withColumn("chunk", F.expr(f"cast(start div {width} as int)"))


def length_histogram(fragments: DataFrame, by_contig: bool = False, longest: int = MAX_LENGTH) -> DataFrame:
    """(length, n) for every length from 0 to ``longest``, zeros included; per contig only lengths that occur."""
    if by_contig:
        return fragments.groupBy("contig", "length").agg(F.count("*").alias("n"))
    counts = fragments.groupBy("length").agg(F.count("*").alias("n"))
    lengths = fragments.sparkSession.range(longest + 1).select(F.col("id").cast("int").alias("length"))
    return lengths.join(counts, "length", "left").select("length", F.coalesce("n", F.lit(0)).alias("n"))


def overlap_join(fragments: DataFrame, regions: DataFrame, max_length: int = MAX_LENGTH, midpoint: bool = False, max_broadcast: int = MAX_BROADCAST_BINS) -> DataFrame:
    """Every (region, fragment) pair that a single-region query would give; regions: (region_id, contig, region_start, region_stop).

    Both sides are cut into bins; a pair counts in the later of its two first bins only. Regions are few against
    fragments: up to ``max_broadcast`` bins of them are broadcast, so that fragments aren't shuffled. Beyond, bins with more
    than BIN_ROWS fragments are salted: their fragments are dealt out by a hash, their regions repeated.
    """
    first = lambda c: F.floor(F.greatest(F.col(c), F.lit(0)) / BIN)
    last = lambda stop, start: F.floor(F.greatest(F.col(stop) - 1, F.col(start), F.lit(0)) / BIN)
    r = regions.select("region_id", F.col("contig").alias("r_contig"), "region_start", "region_stop", first("region_start").alias("r_first"), F.explode(F.sequence(first("region_start"), last("region_stop", "region_start"))).alias("r_bin"))
    few = (regions.agg(F.sum(last("region_stop", "region_start") - first("region_start") + 1)).first()[0] or 0) <= max_broadcast
    f = (spread(fragments) if few else fragments).where(F.col("length") <= max_length).select("*", first("start").alias("f_first"), F.explode(F.sequence(first("start"), last("stop", "start"))).alias("f_bin"))
    fits = (F.col("contig") == F.col("r_contig")) & (F.col("f_bin") == F.col("r_bin")) & (F.col("f_bin") == F.greatest("f_first", "r_first")) & (F.col("start") < F.col("region_stop")) & (F.col("stop") > F.col("region_start"))
    if midpoint:
        middle = F.col("start") - F.col("region_start") + F.floor(F.col("length") / 2)
        fits = fits & (middle >= 0) & (middle < F.col("region_stop") - F.col("region_start"))
    helpers = ("f_first", "f_bin", "r_first", "r_bin", "r_contig")
    if few:
        return f.join(F.broadcast(r), fits).drop(*helpers)
    deep = f.groupBy("contig", "f_bin").agg(F.count("*").alias("d_n")).where(F.col("d_n") > BIN_ROWS).select(F.col("contig").alias("d_contig"), F.col("f_bin").alias("d_bin"), (F.floor(F.col("d_n") / BIN_ROWS) + 1).alias("salts"))
    salts = lambda df, contig, at: df.join(deep, (F.col(contig) == F.col("d_contig")) & (F.col(at) == F.col("d_bin")), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    f_salted = salts(f, "contig", "f_bin").withColumn("f_salt", F.pmod(F.xxhash64(*fragments.columns), F.col("salts"))).drop("d_contig", "d_bin", "salts")
    r_salted = salts(r, "r_contig", "r_bin").withColumn("r_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("d_contig", "d_bin", "salts")
    return f_salted.join(r_salted, fits & (F.col("f_salt") == F.col("r_salt"))).drop(*helpers, "f_salt", "r_salt")


def overlap_totals(fragments: DataFrame, regions: DataFrame, max_length: int = MAX_LENGTH, midpoint: bool = False) -> DataFrame:
    """(region_id, n, bases): number and summed lengths of the fragments that ``overlap_join`` gives a region, for each region_id that has any; no pair is formed.

    A fragment fits a region if it opens before the region's stop and closes behind its start. One that closes at or before the start also opens before the stop, so
    a region has those that open before its stop less those that close up to its start: two running sums over positions. They start anew in
    each bin from the sum of all bins before, over a bin's distinct positions (BIN at most, however deep the coverage); bins in which more than BIN_ROWS
    regions end are salted. Regions that are empty or reversed, and fragments that close before they open, don't subtract so: only those are joined.
    """
    start, stop, middle = F.col("start").cast("long"), F.col("stop").cast("long"), F.col("start") + F.floor(F.col("length") / 2)
    opens, closes = (F.greatest(start, middle), F.least(stop, middle + 1)) if midpoint else (start, stop)
    whole, straight = F.col("region_start") < F.col("region_stop"), opens <= closes
    f = fragments.where((F.col("length") <= max_length) & F.col("contig").isNotNull() & F.col("start").isNotNull() & F.col("stop").isNotNull())
    r = regions.where(F.col("contig").isNotNull())
    at_bin = F.floor(F.col("at") / BIN).alias("bin")
    ends = f.where(straight).select("contig", "length", F.stack(F.lit(2), F.lit(0), opens, F.lit(1), closes).alias("side", "at"))
    asks = r.where(whole).select("region_id", "contig", F.stack(F.lit(2), F.lit(0), F.col("region_stop").cast("long") - 1, F.lit(1), F.col("region_start").cast("long")).alias("side", "at")).select("*", at_bin)
    key, zero, none = ["contig", "side", "bin"], F.lit(0).cast("long"), F.lit(None).cast(regions.schema["region_id"].dataType).alias("region_id")

    points = ends.groupBy("contig", "side", "at").agg(F.count("*").alias("n"), F.sum("length").alias("bases")).select("contig", "side", at_bin, "at", "n", "bases")
    bins = ends.select("contig", "side", at_bin, F.lit(1).alias("n"), "length").unionAll(asks.select(*key, F.lit(0), F.lit(0))).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("length").alias("bases"))
    ahead = Window.partitionBy("contig", "side").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    before = bins.select(*key, (F.col("bin") * BIN).alias("at"), *[F.coalesce(F.sum(c).over(ahead), zero).alias(c) for c in ("n", "bases")])
    deep = F.broadcast(asks.groupBy(*key).agg(F.count("*").alias("d_n")).where(F.col("d_n") > BIN_ROWS).select(*key, (F.floor(F.col("d_n") / BIN_ROWS) + 1).alias("salts")))
    salts = lambda df: df.join(deep, key, "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    known = salts(points.unionByName(before)).select(*key, F.explode(F.sequence(zero, F.col("salts") - 1)).alias("salt"), "at", "n", "bases", none, F.lit(False).alias("asked"))
    asked = salts(asks).select(*key, F.pmod(F.xxhash64("region_id", "at"), F.col("salts")).alias("salt"), "at", zero.alias("n"), zero.alias("bases"), "region_id", F.lit(True).alias("asked"))
    so_far = Window.partitionBy(*key, "salt").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    signed = lambda c: F.when(F.col("side") == 0, F.col(c)).otherwise(-F.col(c)).alias(c)
    found = known.unionByName(asked).select("region_id", "side", "asked", *[F.sum(c).over(so_far).alias(c) for c in ("n", "bases")]).where("asked").select("region_id", signed("n"), signed("bases"))

    pairs = []
    if r.agg(F.count_if(~whole)).first()[0]:
        pairs.append(overlap_join(f, r.where(~whole), max_length, midpoint))
    if f.agg(F.count_if(~straight)).first()[0]:
        pairs.append(overlap_join(f.where(~straight), r.where(whole), max_length, midpoint))
    for p in pairs:
        found = found.unionAll(p.select("region_id", zero + 1, F.col("length").cast("long")))
    return found.groupBy("region_id").agg(F.sum("n").alias("n"), F.sum("bases").alias("bases")).where(F.col("n") > 0)
