"""Sequence functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_THIRD = 0.3333333432674408  # the float32 third, as stored weights have it
#: Weights of A, C, G and T per base letter; other letters have none.
BASES = {
    "A": (1.0, 0.0, 0.0, 0.0), "C": (0.0, 1.0, 0.0, 0.0), "G": (0.0, 0.0, 1.0, 0.0), "T": (0.0, 0.0, 0.0, 1.0),
    "K": (0.0, 0.0, 0.5, 0.5), "M": (0.5, 0.5, 0.0, 0.0), "R": (0.5, 0.0, 0.5, 0.0), "Y": (0.0, 0.5, 0.0, 0.5), "S": (0.0, 0.5, 0.5, 0.0), "W": (0.5, 0.0, 0.0, 0.5),
    "B": (0.0, _THIRD, _THIRD, _THIRD), "V": (_THIRD, _THIRD, _THIRD, 0.0), "H": (_THIRD, _THIRD, 0.0, _THIRD), "D": (_THIRD, 0.0, _THIRD, _THIRD),
    "X": (0.25, 0.25, 0.25, 0.25), "N": (0.25, 0.25, 0.25, 0.25),
}
#: Letters by sixths of a C or G that they count as.
_SIXTHS = {6: "CGS", 4: "BV", 3: "KMRYXN", 2: "HD"}


def count_letters(sequence: Column, letters: str) -> Column:
    return (F.length(sequence) - F.length(F.translate(sequence, letters, ""))).cast("long")


def gc_sixths(sequence: Column) -> Column:
    """Weight of C and G in sixths, an exact integer; ambiguous letters count in part, case doesn't matter."""
    total = F.lit(0).cast("long")
    for sixths, letters in _SIXTHS.items():
        total = total + count_letters(sequence, letters + letters.lower()) * sixths
    return total


def percent_gc(sequence: Column) -> Column:
    """G and C among A, C, G and T; N left out, other letters an error; null for no base."""
    gc, at = count_letters(sequence, "GCgc"), count_letters(sequence, "ATat")
    return F.when(sequence.rlike("[^ACGTNacgtn]"), F.raise_error(F.lit("unexpected letter in sequence")).cast("double")).when(gc + at > 0, gc / (gc + at))


def one_hot(sequence: Column) -> Column:
    """An array of (A, C, G, T) weights per base."""
    weights = F.create_map(*[x for b, w in BASES.items() for letter in (b, b.lower()) for x in (F.lit(letter), F.array(*map(F.lit, w)).cast("array<float>"))])
    none = F.array(*[F.lit(0.0)] * 4).cast("array<float>")
    return F.when(F.length(sequence) == 0, F.array().cast("array<array<float>>")).otherwise(F.transform(F.split(sequence, ""), lambda b: F.coalesce(F.try_element_at(weights, b), none)))


def one_hot_padded(sequence: Column, length: int) -> Column:
    """Padded with zeros to a common length."""
    none = F.array(*[F.lit(0.0)] * 4).cast("array<float>")
    return F.concat(one_hot(sequence), F.array_repeat(none, F.greatest(F.lit(length) - F.length(sequence), F.lit(0))))


def reverse_complement(sequence: Column) -> Column:
    """Upper-case A, C, G, T and N only; anything else is an error."""
    return F.when(sequence.rlike("[^ACGTN]"), F.raise_error(F.lit("unexpected letter in sequence")).cast("string")).otherwise(F.translate(F.reverse(sequence), "ACGT", "TGCA"))


def random_sequences(spark: SparkSession, n: int, length: int, seed: int | None = None) -> DataFrame:
    one = [F.substr(F.lit("ACGT"), (F.rand(None if seed is None else seed + k) * 4).cast("int") + 1, F.lit(1)) for k in range(length)]
    return spark.range(n).select("id", (F.concat(*one) if one else F.lit("")).alias("sequence"))
