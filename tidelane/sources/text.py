"""Interval text (TSV, BED) and SAM text as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.functions.alignments import reference_span
from tidelane.functions.intervals import MAX_LENGTH

MOST_SKIPPED = 0.5


def is_fragment_file(path: str) -> bool:
    return path.endswith((".tsv.gz", ".bed.gz"))


def split_lines(lines: DataFrame) -> DataFrame:
    """(ord, p): the columns p of each line (value, ord). Filters on what a generator makes stay above it, so that no line is made or split anew for each use of a column."""
    return lines.select("ord", F.explode(F.array(F.split("value", "\t"))).alias("p"))


def _number(c: Column) -> Column:
    """An integer as Python reads it, or null: signs and digits by the cast alone, all other texts by a pattern."""
    plain = c.try_cast("long")
    other = F.when(c.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.regexp_replace(F.trim(c), "[+_]", "").try_cast("long"))
    return F.when(plain.isNotNull() & F.ascii(c).between(43, 57) & F.ascii(F.substring(c, -1, 1)).between(48, 57), plain).otherwise(other)


def marked_intervals(lines: DataFrame, width: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """(contig, start, stop, length, cell_barcode, strand, skipped, too_long, ord) of the lines (value, ord) of a file of ``width`` columns.

    ``skipped`` marks rows of another width or under three columns, with coordinates that are no integers, negative or
    empty. Comments are no rows.
    """
    part = lambda k: F.try_element_at("p", F.lit(k + 1))
    cell = lambda k: F.when(part(k) != "", part(k))
    rows = split_lines(lines).where(~part(0).startswith("#") & ((F.size("p") > 1) | (part(0) != "")))
    fields = {"n": F.size("p"), "contig": part(0), "start": _number(part(1)), "stop": _number(part(2)), "cell_barcode": cell(3), "strand": F.when(part(5).isin("+", "-"), part(5))}
    cut = rows.select("ord", F.inline(F.array(F.struct(*[c.alias(n) for n, c in fields.items()]))))
    bad = (F.col("n") < 3) | (F.col("n") != width) | F.col("start").isNull() | F.col("stop").isNull() | (F.col("start") < 0) | (F.col("stop") <= F.col("start"))
    marked = cut.withColumn("skipped", F.coalesce(bad, F.lit(True))).withColumn("length", F.col("stop") - F.col("start"))
    too_long: Column = ~F.col("skipped") & (F.col("length") > max_length)
    fits = ~F.col("skipped") & ~F.col("too_long")
    return marked.withColumn("too_long", too_long).select("contig", *[F.when(fits, F.col(c)).cast("int").alias(c) for c in ("start", "stop", "length")], "cell_barcode", "strand", "skipped", "too_long", "ord")


def parse_intervals(lines: DataFrame, width: int, max_length: int = MAX_LENGTH) -> DataFrame:
    """The marked intervals without those that are too long, which are dropped without counting as malformed."""
    return marked_intervals(lines, width, max_length).where(~F.col("too_long")).drop("too_long")


def skip_counts(marked: DataFrame) -> DataFrame:
    """(contig, n, bad): all rows of a contig, too long ones as well, and the malformed ones among them."""
    return marked.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.col("skipped").cast("int")).alias("bad"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, ord): a line's place within its partition and file orders equal starts."""
    return spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())


def file_width(lines: DataFrame) -> int:
    """Columns of the first row."""
    first = lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).orderBy("ord").first()
    if first is None:
        raise ValueError("the interval file has no rows")
    return len(first["value"].split("\t"))


def read_intervals(spark: SparkSession, path: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """The intervals of a file. More than half of a contig's rows malformed is an error."""
    lines = read_lines(spark, path)
    marked = marked_intervals(lines, file_width(lines), max_length)
    worst = skip_counts(marked).where(F.col("bad") > MOST_SKIPPED * F.col("n")).first()
    if worst is not None:
        raise ValueError(f"{worst['bad']} of {worst['n']} rows of contig {worst['contig']} in {path} are malformed")
    return marked.where(~F.col("skipped") & ~F.col("too_long")).drop("skipped", "too_long")


def parse_sam(lines: DataFrame) -> DataFrame:
    """Alignments of SAM lines (value, ord): rname, pos (from 0), ref_end, tlen, mapq, flag, cigar, qname, mq, mc, cb, ym, ord."""
    part = lambda k: F.get("p", F.lit(k))
    record = ~part(0).startswith("@") & ((F.size("p") > 1) | (part(0) != ""))
    # Null on header lines, as the optimizer may evaluate later filters before the one on the line's kind.
    rows = split_lines(lines).where(record).select("ord", F.when(record, F.col("p")).alias("p")).withColumn("tags", F.concat(F.lit("\t"), F.array_join(F.slice("p", 12, F.size("p")), "\t")))
    tag = lambda name: F.nullif(F.when(F.col("tags").contains(f"\t{name}:"), F.regexp_extract("tags", rf"\t{name}:[A-Za-z]:([^\t]*)", 1)), F.lit(""))
    cut = rows.select("ord", *[part(k).alias(n) for k, n in ((0, "qname"), (2, "rname"), (5, "cigar"))], *[part(k).cast("int").alias(n) for k, n in ((1, "flag"), (4, "mapq"), (8, "tlen"))], (part(3).cast("int") - 1).alias("pos"), tag("MQ").cast("int").alias("mq"), tag("MC").alias("mc"), tag("CB").alias("cb"), tag("YM").alias("ym"))
    return cut.withColumn("ref_end", (F.col("pos") + reference_span(F.col("cigar"))).cast("int"))


def sam_contigs(lines: DataFrame) -> DataFrame:
    """(contig, length) of the header, in order."""
    return lines.where(F.col("value").startswith("@SQ")).orderBy("ord").select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("contig"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def read_contig_map(lines: list[str]) -> dict[str, str]:
    """Input to output names: two TAB columns; blank lines and comments are skipped; two inputs on one output are an error."""
    names: dict[str, str] = {}
    for line in lines:
        line = line.rstrip("\r\n")
        if not line.strip() or line.startswith("#"):
            continue
        parts = line.split("\t")
        if len(parts) != 2:
            raise ValueError(f"a contig map line needs two columns: {line!r}")
        names[parts[0]] = parts[1]
    if len(set(names.values())) < len(names):
        raise ValueError("two contigs are mapped to one name")
    return names


def rename_contigs(fragments: DataFrame, names: dict[str, str]) -> DataFrame:
    if not names:
        return fragments
    table = fragments.sparkSession.createDataFrame(list(names.items()), "contig string, _new string")  # as many rows as a genome has contigs
    return fragments.join(F.broadcast(table), "contig", "left").withColumn("contig", F.coalesce("_new", "contig")).drop("_new")
