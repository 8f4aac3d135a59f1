"""``python -m tidelane.cli INPUT OUTPUT``: build a store."""

from __future__ import annotations

import argparse
import logging
import sys

from tidelane.functions.intervals import MAX_LENGTH
from tidelane.sources.text import is_fragment_file, read_contig_map


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidelane", description="Build a fragment store from alignments or interval text.")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--fasta", help="reference sequence; enables GC content, required for interval text")
    p.add_argument("--contigs", nargs="+", help="only these contigs, by their names in the input")
    p.add_argument("--contig-name-map", help="file of two TAB columns: input name, stored name")
    p.add_argument("--set-mapq-255-to-none", action="store_true")
    p.add_argument("--exclude-strand", action="store_true")
    p.add_argument("--read-methyl", action="store_true")
    p.add_argument("--single-end", action="store_true")
    p.add_argument("--se-max-fragment-length", type=int)
    p.add_argument("--min-mapq", type=int)
    p.add_argument("--include-duplicates", action="store_true")
    p.add_argument("--num-processes", default=None, help="a number or 'all'; Spark's own parallelism applies")
    p.add_argument("--no-store-fragment-end-clipped", action="store_true")
    p.add_argument("--skip-chunking", action="store_true", help="no effect: partitions follow the data")
    how_much = p.add_mutually_exclusive_group()
    for flags, level in ((("--quiet", "-q"), logging.ERROR), (("--verbose", "-v"), logging.INFO), (("--debug",), logging.DEBUG)):
        how_much.add_argument(*flags, dest="level", action="store_const", const=level, default=logging.WARNING)
    p.add_argument("--log-format", default="%(levelname)s %(name)s %(message)s")
    p.add_argument("--log-filename")
    p.add_argument("--log-file-verbosity-level", choices=["ERROR", "WARNING", "INFO", "DEBUG"])
    p.add_argument("--log-file-format")
    return p


def parse(argv: list[str]) -> argparse.Namespace:
    """Checked arguments; a usage error exits with 2 before anything is read."""
    p = parser()
    a = p.parse_args(argv)
    if a.se_max_fragment_length is not None and not 1 <= a.se_max_fragment_length <= MAX_LENGTH:
        p.error(f"--se-max-fragment-length must lie between 1 and {MAX_LENGTH}")
    if a.min_mapq is not None and a.min_mapq < 0:
        p.error("--min-mapq must not be negative")
    if a.num_processes not in (None, "all") and not str(a.num_processes).isdigit():
        p.error("--num-processes must be a number or 'all'")
    if not is_fragment_file(a.input):
        if a.single_end and a.se_max_fragment_length is None:
            p.error("--single-end needs --se-max-fragment-length")
        if a.se_max_fragment_length is not None and not a.single_end:
            p.error("--se-max-fragment-length needs --single-end")
    if (a.log_file_verbosity_level or a.log_file_format) and not a.log_filename:
        p.error("options on the log file need --log-filename")
    return a


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    a = parse(argv)
    logging.basicConfig(level=a.level, format=a.log_format)
    if a.log_filename:
        handler = logging.FileHandler(a.log_filename)
        handler.setLevel(a.log_file_verbosity_level or a.level)
        handler.setFormatter(logging.Formatter(a.log_file_format or a.log_format))
        logging.getLogger().addHandler(handler)
    names = None
    if a.contig_name_map:
        from tidelane.sources.binary import open_file

        with open_file(a.contig_name_map) as f:  # a local file, or any by URI
            names = read_contig_map(f.read().decode().splitlines())
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession

    from tidelane.operators.store import exists
    from tidelane.plans.build import build_store

    spark = SparkSession.builder.appName("tidelane").getOrCreate()
    if exists(spark, a.output):
        logging.getLogger(__name__).error("the output %s exists already; remove it or name another", a.output)
        return 1
    try:
        build_store(spark, a.input, a.output, a.fasta, a.contigs, set_mapq_255_to_none=a.set_mapq_255_to_none, read_strand=not a.exclude_strand, read_methyl=a.read_methyl, single_end=a.single_end, se_max_fragment_length=a.se_max_fragment_length, include_duplicates=a.include_duplicates, store_fragment_end_clipped=not a.no_store_fragment_end_clipped, contig_name_map=names, min_mapq=a.min_mapq, build_argv=argv)
    except (ValueError, KeyError, AnalysisException) as e:
        logging.getLogger(__name__).error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
