"""Single fragments as Python values, as row iterators hand them out, and their rules as column expressions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, Row
from pyspark.sql import functions as F

from tidelane.functions.alignments import METHYL_FIELDS

STRANDS = ("+", "-")


@dataclasses.dataclass(eq=True, repr=False)
class Fragment:
    """Two fragments are equal if all their fields are; the representation leaves missing ones out."""

    chrom: str
    start: int
    stop: int
    mapq1: int | None = None
    mapq2: int | None = None
    gc: float | None = None
    strand: str | None = None
    cell_barcode: str | None = None
    methyl_counts: dict[str, int] | None = None
    fragment_end_clipped: bool | None = None

    def __post_init__(self) -> None:
        if isinstance(self.strand, bytes):
            self.strand = self.strand.decode()
        if self.strand is not None and self.strand not in STRANDS:
            raise AssertionError(f"a strand is + or -, not {self.strand!r}")
        if isinstance(self.start, bool) or not hasattr(self.start, "__index__"):
            raise AssertionError(f"a start is an integer, not {self.start!r}")

    def __repr__(self) -> str:
        shown = [(name, getattr(self, name)) for name in self.field_names()]
        return f"Fragment({','.join(f'{name}={value!r}' for name, value in shown if value is not None)})"

    @classmethod
    def field_names(cls) -> list[str]:
        return [f.name for f in dataclasses.fields(cls)]

    @classmethod
    def field_types(cls) -> list[str]:
        return [f.type for f in dataclasses.fields(cls)]

    @classmethod
    def from_row(cls, row: Row) -> Fragment:
        """Of a row that ``FragmentStore.fetch`` gives, or of any with some of the fields; ``contig`` is the chrom."""
        held = row.asDict()
        counts = {k: held[k] for k in ("num_cpgs", "num_converted_cpgs", "num_cytosines", "num_converted_cytosines") if k in held}
        named = {k: held[k] for k in cls.field_names() if k in held}
        return cls(**{"chrom": held.get("contig"), **({"methyl_counts": counts} if counts else {}), **named})

    def replace(self, **changes: object) -> Fragment:
        return dataclasses.replace(self, **changes)

    @property
    def length(self) -> int:
        return self.stop - self.start

    tlen = length

    @property
    def midpoint(self) -> int:
        return self.start + self.length // 2

    @property
    def mapq12_min(self) -> int | None:
        return min((q for q in (self.mapq1, self.mapq2) if q is not None), default=None)

    def mapq_gte(self, threshold: int) -> bool:
        least = self.mapq12_min
        return least is None or least >= threshold


def unparse(value: Column) -> Column:
    """Text of a value; nothing for a missing one."""
    return F.coalesce(value.cast("string"), F.lit(""))


def checked_strand(strand: Column) -> Column:
    """+, - or null, of text or bytes; anything else is an error."""
    text = strand.cast("string")
    return F.when(text.isNull() | text.isin(*STRANDS), text).otherwise(F.raise_error(F.concat(F.lit("no strand: "), text)).cast("string"))


def equal_fragments(a: str, b: str, fields: list[str]) -> Column:
    """Whether the structs ``a`` and ``b`` agree in all fields; missing values agree."""
    same = F.lit(True)
    for name in fields:
        same = same & F.col(f"{a}.{name}").eqNullSafe(F.col(f"{b}.{name}"))
    return same


def methyl_items(counts: Column) -> Column:
    """The counts of a methylation struct as (name, value) pairs, in the tag's order."""
    return F.array(*[F.struct(F.lit(name).alias("name"), counts[name].alias("value")) for name in METHYL_FIELDS])
