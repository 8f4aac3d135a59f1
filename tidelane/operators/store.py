"""The fragment store: Parquet sorted by (contig, start) with a small table of facts beside it."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.intervals import MAX_LENGTH, gc_dequantize
from tidelane.operators.overlap import length_histogram, overlap_join, overlaps

METHYL_COLUMNS = ["num_cpgs", "num_converted_cpgs", "num_cytosines", "num_converted_cytosines"]
#: Fixed value: block size that the format names; Parquet's statistics do its work here.
INDEX_BLOCK = 5_000


def write_store(fragments: DataFrame, path: str, facts: dict) -> None:
    """Sorted by contig, start and input order over range partitions; an existing store is an error, and so is an empty one, which leaves nothing behind."""
    ordered = fragments.repartitionByRange("contig", "start").sortWithinPartitions("contig", "start", "ord")
    ordered.write.mode("errorifexists").option("compression", "zstd").parquet(f"{path}/data")
    spark = fragments.sparkSession
    written = spark.read.schema(fragments.schema).parquet(f"{path}/data")
    n, longest = written.agg(F.count("*"), F.max("length")).first()
    if not n:
        _delete(spark, path)
        raise ValueError("No fragments were extracted")
    whole = {"index_block_size": INDEX_BLOCK, "max_fragment_length": MAX_LENGTH, "n_fragments": n, "observed_max_length": longest, **facts}
    spark.createDataFrame([(json.dumps(whole),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/facts")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


class FragmentStore:
    """Queries on a store. Holds the path and the facts only, so it can be pickled and sent; ``open`` gives it a session again."""

    def __init__(self, path: str, facts: dict, columns: list[str], spark: SparkSession | None = None):
        self.path, self.facts, self.columns, self._spark = path, facts, columns, spark

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FragmentStore:
        facts = json.loads(spark.read.text(f"{path}/facts").first()["value"])
        return cls(path, facts, spark.read.parquet(f"{path}/data").columns, spark)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_spark": None}

    def __enter__(self) -> FragmentStore:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        self._spark = None

    @property
    def name(self) -> str:
        return self.path

    filename = name

    def cache_pointers(self) -> None:
        """Nothing to prepare: Spark plans each query."""

    @property
    def fragments(self) -> DataFrame:
        spark = self._spark or SparkSession.getActiveSession()
        if spark is None:
            raise RuntimeError("no active Spark session")
        return spark.read.parquet(f"{self.path}/data")

    contig_lengths = property(lambda self: dict(self.facts.get("contig_lengths", {})))
    source_format = property(lambda self: self.facts.get("source_format", "BAM"))
    header = property(lambda self: self.facts.get("header", ""))
    build_argv = property(lambda self: self.facts.get("build_argv"))
    build_version = property(lambda self: self.facts.get("build_version"))
    max_fragment_length = property(lambda self: self.facts["max_fragment_length"])
    index_block_size = property(lambda self: self.facts["index_block_size"])
    n_fragments = property(lambda self: self.facts["n_fragments"])
    n_frags = n_fragments
    has_gc = property(lambda self: "gc_code" in self.columns)
    has_strand = property(lambda self: "strand" in self.columns)
    has_methyl = property(lambda self: METHYL_COLUMNS[0] in self.columns)
    has_fragment_end_clipped = property(lambda self: "fragment_end_clipped" in self.columns)

    def fragment_length_counts(self, by_contig: bool = False) -> DataFrame:
        return length_histogram(self.fragments, by_contig)

    def _region(self, contig: str, start: int | None, stop: int | None) -> tuple[int, int]:
        lengths = self.contig_lengths
        if contig not in lengths:
            raise KeyError(contig)
        start, stop = start or 0, lengths[contig] if stop is None else stop
        if start >= lengths[contig]:
            raise ValueError(f"the region starts at {start}, past the end of {contig} ({lengths[contig]})")
        return start, stop

    def _wanted(self, mapqs: bool, gc: bool, strand: bool, methyl: bool | None, clipped: bool | None) -> list:
        for asked, there, what in ((gc, self.has_gc, "gc"), (strand, self.has_strand, "strand"), (methyl, self.has_methyl, "methylation"), (clipped, self.has_fragment_end_clipped, "fragment end clipping")):
            if asked and not there:
                raise ValueError(f"the store {self.path} holds no {what}")
        out: list = ["contig", "start", "stop"]
        out += ["mapq1", "mapq2"] * mapqs
        out += [gc_dequantize(F.col("gc_code")).alias("gc")] if gc else []
        out += ["strand"] * strand
        out += METHYL_COLUMNS if (self.has_methyl if methyl is None else methyl) else []
        return out + ["fragment_end_clipped"] * (self.has_fragment_end_clipped if clipped is None else clipped)

    def fetch_array(self, contig: str, region_start: int | None = None, region_stop: int | None = None, max_frag_len: int | None = None, return_mapqs: bool = False, return_gc: bool = False, return_strand: bool = False, return_methyl: bool | None = None, return_fragment_end_clipped: bool | None = None, filter_to_midpoint_frags: bool = False) -> DataFrame:
        """Fragments that overlap the region, in order of start; only the wanted columns are read."""
        start, stop = self._region(contig, region_start, region_stop)
        wanted = self._wanted(return_mapqs, return_gc, return_strand, return_methyl, return_fragment_end_clipped)
        longest = min(self.max_fragment_length if max_frag_len is None else max_frag_len, self.facts["observed_max_length"])
        found = self.fragments.where(overlaps(contig, start, stop, longest, filter_to_midpoint_frags))
        return found.select(*wanted, F.col("ord").alias("_ord")).orderBy("start", "_ord").drop("_ord")

    def fetch(self, contig: str | None = None, start: int | None = None, stop: int | None = None, max_frag_len: int | None = None, return_mapqs: bool = True, return_gc: bool = False, return_strand: bool | None = None, return_methyl: bool | None = None, return_fragment_end_clipped: bool | None = None) -> Iterator[Row]:
        """Rows of one contig's region, or of all contigs in their order; strand by default where the store has it."""
        if contig is None and (start is not None or stop is not None):
            raise ValueError("a start or stop needs a contig")
        strand = self.has_strand if return_strand is None else return_strand
        for one in self.contig_lengths if contig is None else [contig]:
            yield from self.fetch_array(one, start, stop, max_frag_len, return_mapqs, return_gc, strand, return_methyl, return_fragment_end_clipped).toLocalIterator()

    def fetch_counts(self, contig: str, region_start: int | None = None, region_stop: int | None = None, max_frag_len: int | None = None, filter_to_midpoint_frags: bool = False) -> int:
        start, stop = self._region(contig, region_start, region_stop)
        longest = self.max_fragment_length if max_frag_len is None else max_frag_len
        return self.fragments.where(overlaps(contig, start, stop, longest, filter_to_midpoint_frags)).count()

    def overlap_join(self, regions: DataFrame, max_frag_len: int | None = None, filter_to_midpoint_frags: bool = False) -> DataFrame:
        """A batch of regions (region_id, contig, region_start, region_stop) in one job."""
        return overlap_join(self.fragments, regions, self.max_fragment_length if max_frag_len is None else max_frag_len, filter_to_midpoint_frags)

    def array_view(self, found: DataFrame) -> DataFrame:
        """Nulls as the sentinels that array users expect: quality -1, gc NaN, clipped 255, strand N."""
        given = {"mapq1": F.lit(-1), "mapq2": F.lit(-1), "gc": F.lit(float("nan")), "strand": F.lit("N")}
        out = found.withColumns({c: F.coalesce(c, v) for c, v in given.items() if c in found.columns})
        return out.withColumn("fragment_end_clipped", F.coalesce(F.col("fragment_end_clipped").cast("short"), F.lit(255).cast("short"))) if "fragment_end_clipped" in found.columns else out
