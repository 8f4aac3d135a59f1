"""GC content of fragments from a blocked reference: two joins on block numbers, whatever a fragment's length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.functions.sequences import gc_sixths
from tidelane.operators.parallel import spread

BLOCK = 512


def reference_blocks(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """(contig, block_id, seq, gc_before) of (contig, sequence); a last, empty block lets a stop at the end find its place.

    gc_before is the weight of C and G ahead of the block, in sixths. Its running sum is over one contig's blocks.
    """
    pieces = F.regexp_extract_all("sequence", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))  # one pass over the sequence
    ended = F.when(F.length("sequence") % block == 0, F.concat(pieces, F.array(F.lit("")))).otherwise(pieces)
    return with_running_gc(spread(sequences).where(F.col("sequence").isNotNull()).select("contig", F.posexplode(ended).alias("block_id", "seq")))


def with_running_gc(blocks: DataFrame) -> DataFrame:
    """Adds gc_before. A window holds one contig's blocks, so its size is bounded by the longest sequence, however many fragments there are."""
    before = Window.partitionBy("contig").orderBy("block_id").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("w", gc_sixths(F.col("seq"))).withColumn("gc_before", F.coalesce(F.sum("w").over(before), F.lit(0))).drop("w")


def with_gc(fragments: DataFrame, blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds gc_sixths and gc (not rounded): null where the contig has no sequence or the length is 0; a stop past the end is an error."""
    for at, name in (("start", "g0"), ("stop", "g1")):
        b = blocks.select(F.col("contig").alias("_c"), F.col("block_id").alias("_b"), F.col("seq").alias("_s"), F.col("gc_before").alias("_g"))
        rest = F.col(at) % block
        here = F.when(rest <= F.length("_s"), F.col("_g") + gc_sixths(F.substr("_s", F.lit(1), rest))).when(F.col("_s").isNotNull(), F.raise_error(F.lit(f"a fragment's {at} lies past the end of its contig")).cast("long"))
        fragments = fragments.join(b, (F.col("contig") == F.col("_c")) & (F.floor(F.col(at) / block) == F.col("_b")), "left").withColumn(name, here).drop("_c", "_b", "_s", "_g")
    sixths = F.col("g1") - F.col("g0")
    return fragments.withColumn("gc_sixths", sixths).withColumn("gc", F.when(F.col("stop") > F.col("start"), sixths / (6.0 * (F.col("stop") - F.col("start"))))).drop("g0", "g1")
