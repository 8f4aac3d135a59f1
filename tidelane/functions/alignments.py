"""Rules on alignment records as column expressions: flag filters, extent, strand, clipping, tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flag bits of the SAM format.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, READ1, READ2, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40, 0x80, 0x100, 0x200, 0x400, 0x800
#: Fields of the methylation tag, in order.
METHYL_FIELDS = ("unconverted_cytosines", "converted_cytosines", "unconverted_cpgs", "converted_cpgs")
_METHYL = "^" + ";".join(f"{f}:(\\d+)" for f in METHYL_FIELDS) + "$"


def has(flag: Column, bit: int) -> Column:
    return flag.bitwiseAND(F.lit(bit)) != 0


def primary(flag: Column, include_duplicates: bool = False) -> Column:
    """Neither failed, secondary, supplementary, unmapped nor (unless asked for) a duplicate."""
    return flag.bitwiseAND(F.lit(QC_FAIL | SECONDARY | SUPPLEMENTARY | UNMAPPED | (0 if include_duplicates else DUPLICATE))) == 0


def paired_ok(flag: Column, tlen: Column, max_tlen: int, include_duplicates: bool = False) -> Column:
    """A pair counts once, by its leftmost mate: the one with a positive template length."""
    return primary(flag, include_duplicates) & ~has(flag, MATE_UNMAPPED) & tlen.between(1, max_tlen)


def mapq_ok(mapq: Column, mate: Column | None, least: int) -> Column:
    """A missing mate quality doesn't reject."""
    return (mapq >= least) if mate is None else (mapq >= least) & F.coalesce(mate >= least, F.lit(True))


def known_mapq(mapq: Column, to_null: bool) -> Column:
    """255 means unknown: null on request, else an error."""
    return F.nullif(mapq, F.lit(255)) if to_null else F.when(mapq == 255, F.raise_error(F.lit("mapping quality 255 found; pass set_mapq_255_to_none to store it as null")).cast("int")).otherwise(mapq)


def reference_span(cigar: Column) -> Column:
    """Reference bases that a CIGAR covers: its M, D, N, = and X operations."""
    return F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)[MDN=X]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))


def extent_start(pos: Column, end: Column, tlen: Column) -> Column:
    return F.when(tlen > 0, pos).when(tlen < 0, end + tlen).otherwise(F.raise_error(F.lit("template length 0")).cast("int"))


def extent_stop(pos: Column, end: Column, tlen: Column) -> Column:
    return F.when(tlen > 0, pos + tlen).when(tlen < 0, end).otherwise(F.raise_error(F.lit("template length 0")).cast("int"))


def strand_paired(flag: Column) -> Column:
    """Read 1 gives its own direction, read 2 the opposite one."""
    return F.when(has(flag, READ1), F.when(has(flag, REVERSE), "-").otherwise("+")).when(has(flag, READ2), F.when(has(flag, REVERSE), "+").otherwise("-"))


def strand_single(flag: Column) -> Column:
    return F.when(has(flag, REVERSE), "-").otherwise("+")


def end_matches(cigar: Column, reverse: Column) -> Column:
    """Whether the read's outer end (the last operation of a reverse read, the first of a forward one) is aligned."""
    return F.when(reverse, cigar.rlike("[M=]$")).otherwise(cigar.rlike(r"^\d+[M=]"))


def end_clipped(cigar: Column, mate_cigar: Column, flag: Column) -> Column:
    """Null without the mate's CIGAR."""
    return F.when(mate_cigar.isNotNull(), ~(end_matches(cigar, has(flag, REVERSE)) & end_matches(mate_cigar, has(flag, MATE_REVERSE))))


def methyl(tag: Column, qname: Column | None = None) -> Column:
    """The methylation counts as a struct; a missing or malformed tag is an error that names the read."""
    fine = tag.rlike(_METHYL)
    error = F.raise_error(F.concat(F.lit("no valid methylation tag on read "), F.coalesce(qname if qname is not None else F.lit("?"), F.lit("?")))).cast("int")
    return F.struct(*[F.when(fine, F.regexp_extract(tag, _METHYL, k + 1).cast("int")).otherwise(error).alias(f) for k, f in enumerate(METHYL_FIELDS)])
