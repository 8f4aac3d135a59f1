"""Building a store: source, selection, enrichment, sorted write; one declarative plan from input to Parquet."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions import alignments as A
from tidelane.functions.intervals import MAX_LENGTH, checked_gc, gc_quantize
from tidelane.operators.gc import with_gc, with_running_gc
from tidelane.operators.store import METHYL_COLUMNS, FragmentStore, write_store
from tidelane.sources import binary, text

log = logging.getLogger(__name__)
VERSION = "0.1.0"


def paired_fragments(rows: DataFrame, *, min_mapq: int = 0, include_duplicates: bool = False, mapq_255_to_null: bool = False, methyl: bool = False, max_tlen: int = MAX_LENGTH) -> DataFrame:
    kept = rows.where(A.paired_ok(F.col("flag"), F.col("tlen"), max_tlen, include_duplicates) & A.mapq_ok(F.col("mapq"), F.col("mq"), min_mapq))
    start, stop = A.extent_start(F.col("pos"), F.col("ref_end"), F.col("tlen")), A.extent_stop(F.col("pos"), F.col("ref_end"), F.col("tlen"))
    clipped = A.end_clipped(F.col("cigar"), F.col("mc"), F.col("flag"))
    counts = [F.col("ym_counts")[n] for n in A.METHYL_FIELDS] if methyl else []
    if methyl:
        kept = kept.withColumn("ym_counts", A.methyl(F.col("ym"), F.col("qname")))
    extra = [(counts[2] + counts[3]).alias(METHYL_COLUMNS[0]), counts[3].alias(METHYL_COLUMNS[1]), (counts[0] + counts[1]).alias(METHYL_COLUMNS[2]), counts[1].alias(METHYL_COLUMNS[3])] if methyl else []
    return kept.select(
        F.col("rname").alias("contig"), start.cast("int").alias("start"), stop.cast("int").alias("stop"), (stop - start).cast("int").alias("length"),
        A.known_mapq(F.col("mapq"), mapq_255_to_null).alias("mapq1"), A.known_mapq(F.col("mq"), mapq_255_to_null).alias("mapq2"),
        A.strand_paired(F.col("flag")).alias("strand"), F.col("cb").alias("cell_barcode"), clipped.alias("fragment_end_clipped"), *extra, "ord",
    )


def single_fragments(rows: DataFrame, *, min_mapq: int = 0, include_duplicates: bool = False, mapq_255_to_null: bool = False, max_length: int | None = None) -> DataFrame:
    """One fragment per primary read; without a cap, a longer one than a store holds is an error that names it."""
    kept = rows.where(A.primary(F.col("flag"), include_duplicates) & A.mapq_ok(F.col("mapq"), None, min_mapq))
    span = F.col("ref_end") - F.col("pos")
    if max_length is not None:
        kept, length = kept.where(span <= max_length), span
    else:
        message = F.concat(F.lit("span "), span.cast("string"), F.lit(" exceeds 65535: contig "), "rname", F.lit(", start "), F.col("pos").cast("string"), F.lit(", read "), "qname", F.lit(", CIGAR "), "cigar")
        length = F.when(span > MAX_LENGTH, F.raise_error(message).cast("int")).otherwise(span)
    null = lambda kind: F.lit(None).cast(kind)
    return kept.select(
        F.col("rname").alias("contig"), F.col("pos").alias("start"), F.col("ref_end").alias("stop"), length.cast("int").alias("length"),
        A.known_mapq(F.col("mapq"), mapq_255_to_null).alias("mapq1"), null("int").alias("mapq2"), A.strand_single(F.col("flag")).alias("strand"),
        null("string").alias("cell_barcode"), null("boolean").alias("fragment_end_clipped"), "ord",
    )


def interval_fragments(spark: SparkSession, path: str) -> DataFrame:
    null = lambda kind: F.lit(None).cast(kind)
    return text.read_intervals(spark, path).select("contig", "start", "stop", "length", null("int").alias("mapq1"), null("int").alias("mapq2"), "strand", "cell_barcode", null("boolean").alias("fragment_end_clipped"), "ord")


def of_contigs(rows: DataFrame, contigs: list[str], column: str = "contig") -> DataFrame:
    """Only rows of the allowed contigs."""
    return rows.where(F.col(column).isin(contigs))


def within_contigs(fragments: DataFrame, lengths: dict[str, int]) -> DataFrame:
    """Fragments of the contigs that start before their contig's end; as many lengths as a genome has contigs."""
    limits = fragments.sparkSession.createDataFrame(list(lengths.items()) or [("", 0)], "contig string, contig_length long")
    return fragments.join(F.broadcast(limits), "contig").where(F.col("start") < F.col("contig_length")).drop("contig_length")


def check_lengths(source: dict[str, int], reference: dict[str, int]) -> None:
    for contig in sorted(set(source) & set(reference)):
        if source[contig] != reference[contig]:
            raise ValueError(f"contig {contig} has length {source[contig]} in the alignments and {reference[contig]} in the reference")


def build_store(spark: SparkSession, source: str, path: str, fasta: str | None = None, contigs: list[str] | None = None, *, set_mapq_255_to_none: bool = False, read_strand: bool = True, read_methyl: bool = False, single_end: bool = False, se_max_fragment_length: int | None = None, include_duplicates: bool = False, store_fragment_end_clipped: bool = True, contig_name_map: dict[str, str] | None = None, min_mapq: int | None = None, build_argv: list[str] | None = None) -> FragmentStore:
    """A store of ``source``: BAM, SAM text (``.sam``, ``.sam.gz``) or interval text (``.tsv.gz``, ``.bed.gz``)."""
    names, binary_names = contig_name_map or {}, source.endswith(".bam")
    binary.register(spark)
    blocks = with_running_gc(spark.read.format("fasta").load(fasta)) if fasta else None
    reference = {r["contig"]: r["n"] for r in blocks.groupBy("contig").agg(F.sum(F.length("seq")).alias("n")).collect()} if blocks is not None else {}
    if text.is_fragment_file(source):
        if read_methyl:
            raise ValueError("interval text holds no methylation")
        if blocks is None:
            raise ValueError("interval text needs a FASTA file")
        if single_end or se_max_fragment_length is not None or min_mapq or include_duplicates or set_mapq_255_to_none:
            log.warning("options on alignments don't apply to interval text")
        store_fragment_end_clipped = False
        lines = text.read_lines(spark, source)
        read_strand = read_strand and text.file_width(lines) >= 6
        found, header, source_format = interval_fragments(spark, source), "", "TSV"
        present = [r["contig"] for r in found.select("contig").distinct().collect()]
        lengths = {c: reference.get(names.get(c, c)) for c in sorted(present)}
        if contigs is not None:
            lengths = {c: lengths[c] if c in lengths else reference.get(names.get(c, c)) for c in contigs}
        if missing := [c for c, n in lengths.items() if n is None]:
            raise ValueError(f"contigs missing from the reference: {', '.join(missing)}")
    else:
        if single_end and read_methyl:
            raise ValueError("single-end reads hold no methylation")
        if binary_names:
            header, pairs = binary.bam_header(source)
            rows = spark.read.format("bam").load(source)
        else:
            lines = text.read_lines(spark, source)
            header = "\n".join(r["value"] for r in lines.where(F.col("value").startswith("@")).orderBy("ord").collect())
            pairs = [tuple(r) for r in text.sam_contigs(lines).collect()]
            rows = text.parse_sam(lines)
        source_format, lengths = "BAM", dict(pairs)
        if contigs is not None:
            lengths = {c: lengths[c] for c in contigs}  # an unknown name is a KeyError
        common = {"min_mapq": min_mapq or 0, "include_duplicates": include_duplicates, "mapq_255_to_null": set_mapq_255_to_none}
        rows = of_contigs(rows, list(lengths), "rname")
        if single_end:
            found = single_fragments(rows, **common, max_length=se_max_fragment_length)
        else:
            check_lengths({names.get(c, c): n for c, n in lengths.items()}, reference)
            found = paired_fragments(rows, **common, methyl=read_methyl)
    found = text.rename_contigs(within_contigs(found, lengths), names)
    if blocks is not None:
        found = with_gc(found, blocks).withColumn("gc_code", gc_quantize(checked_gc(F.col("gc")))).drop("gc", "gc_sixths")
    drop = ["cell_barcode", *["strand"] * (not read_strand), *["fragment_end_clipped"] * (not store_fragment_end_clipped)]
    facts = {"source_format": source_format, "header": header, "contig_lengths": {names.get(c, c): n for c, n in lengths.items()}, "build_version": VERSION}
    write_store(found.drop(*drop), path, facts | ({"build_argv": build_argv} if build_argv else {}))
    return FragmentStore.open(spark, path)
