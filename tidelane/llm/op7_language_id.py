"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter n-gram is the product of its
letters' vectors, each permuted by its place (rotated); a text is the bundle (sum) of its n-grams' vectors, and a
language's prototype the sum of the unit bundles of its training texts. A text gets the language whose prototype
has the largest cosine with its bundle.

Whole texts are read: letters of any script lower-cased, everything else a word boundary. Learning adds up one
vector per language in each task, so that only languages times dimensions numbers are gathered. It reads every text
with a language outside the held-out fold, and so do the floors; a prototype is of unit length however many texts it has, so rare languages are learned like others. (A caller
may ask for fewer texts by ``max_training``, in equal parts by language; neither the query nor the pipeline does.) Scoring has no shuffle. n-gram vectors are rebuilt from
their letters when a worker's table is full, so memory is bounded for any script.

Defined cases: a null text, or one without a letter (digits, fractions and marks are none), is ``und`` with score 0; ties between languages go to the
smaller name; a null language or a null id is never learned from; without any learned language everything is
``und``; repeated rows are each scored; texts of any length are read whole; a null id is marked as held out, as it belongs to no fold; empty tables give no
rows; only doc_id, text and lang are read. All columns are kept, whatever their names, but those called like a result, in any case, give way to it in ``identify``,
and stay in ``speakable``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.common import held_out, plain_names, release, small_batches, stored

DIMENSIONS = 1024
ORDER = 3
SEED = 20_251
#: Languages whose sampling rates are broadcast, not joined by a shuffle.
MAX_BROADCAST = 10_000
#: n-grams whose vectors a worker keeps (1 KB each).
MAX_TABLE = 60_000
#: Below this cosine a text resembles no learned language, whatever its training texts' scores.
MIN_SCORE = 0.05
#: Of the training texts' scores, the quantile of which FLOOR_SHARE is the least that a text of the language must reach.
FLOOR_QUANTILE, FLOOR_SHARE = 0.01, 0.14
UNKNOWN = "und"


@cache
def letter_table() -> np.ndarray:
    """For each code point: 2 for a letter (of the Unicode categories L), 1 for a mark that letters carry (M), else 0."""
    return np.fromiter(({"L": 2, "M": 1}.get(unicodedata.category(c)[0], 0) for c in map(chr, range(0x110000))), np.int8, 0x110000)


class Profiles:
    """Bundles of letter n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER, seed: int = SEED, max_table: int = MAX_TABLE):
        self.dimensions, self.order, self.seed, self.max_table = dimensions, order, seed, max_table
        self.letters: dict[int, np.ndarray] = {}
        self.row: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if (v := self.letters.get(code)) is None:
            if len(self.letters) > self.max_table:
                self.letters.clear()
            v = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8) * 2 - 1
            self.letters[code] = v
        return v

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        """The n-grams' vectors; a gram holds its letters' code points, 21 bits each."""
        if len(self.row) + len(grams) > self.max_table:
            self.row.clear()
        for g in grams.tolist():
            if g not in self.row:
                v = np.ones(self.dimensions, np.int8)
                for place in range(self.order):
                    v = v * np.roll(self._letter(g >> 21 * place & 0x1FFFFF), place)
                k = len(self.row)
                if k == len(self.table):
                    self.table = np.concatenate([self.table, np.empty_like(self.table)])
                self.table[k] = v
                self.row[g] = k
        return self.table[[self.row[g] for g in grams.tolist()]]

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of the text's letters with their counts; word boundaries are blanks."""
        codes = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        kind = letter_table()[codes]
        if not (kind == 2).any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        letter = kind > 0
        codes[~letter] = ord(" ")
        kept = letter.copy()
        kept[1:] |= letter[:-1]  # a blank after each word, and one before the first
        codes = codes[kept]
        codes = np.concatenate([[ord(" ")][: int(codes[0] != ord(" "))], codes, [ord(" ")][: int(codes[-1] != ord(" "))]]).astype(np.int64)
        gram = sum(codes[k : len(codes) - self.order + 1 + k] << 21 * k for k in range(self.order))
        return np.unique(gram, return_counts=True)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A bundle per text (zero if it has no letter), a few texts at a time."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        parts = [self.grams(t) for t in texts]
        for at in range(0, len(texts), 32):
            some = parts[at : at + 32]
            every = np.unique(np.concatenate([g for g, _ in some]))
            for low in range(0, len(every), 8192):  # texts of many scripts: never more than so many vectors at once
                piece = every[low : low + 8192]
                counts = np.zeros((len(some), len(piece)), np.float32)
                for k, (g, n) in enumerate(some):
                    here = slice(*np.searchsorted(g, (piece[0], piece[-1] + 1)))
                    counts[k, np.searchsorted(piece, g[here])] = n[here]
                out[at : at + 32] += counts @ self._vectors(piece).astype(np.float32)
        return out


def _unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def training(docs: DataFrame, max_training: int | None = None) -> DataFrame:
    """(text, lang) of the documents outside the held-out fold; of about ``max_training`` of them, if given, as many of each language where there are as many."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    if max_training is None:
        return known.select("text", "lang")
    counts = stored(known.groupBy("lang").count(), "language-counts")
    n = counts.count()
    share = max(1, max_training // max(1, n))
    rates = counts.select("lang", F.when(F.col("count") > share, F.round(1e6 * F.lit(share) / F.col("count"))).otherwise(1e6).cast("long").alias("rate"))
    return known.join(F.broadcast(rates) if n <= MAX_BROADCAST else rates, "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < F.col("rate")).select("text", "lang")


def learn(docs: DataFrame, max_training: int | None = None, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """A unit prototype per language, from documents outside the held-out fold."""
    spark = docs.sparkSession
    small_batches(spark)
    known = training(docs, max_training)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            langs = np.array(batch.column(1).to_pylist(), object)
            units = _unit(profiles.bundles(batch.column(0).to_pylist()))
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, 0) + units[langs == lang].sum(0, dtype=np.float64)
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = known.select("text", "lang").mapInArrow(add_up, "lang string, v array<double>")
    # Dimensions are rounded before they are added, so that the order of partitions can't show in a last digit.
    whole = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum(F.round(F.col("x") * 1e6).cast("long")).alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return {r["lang"]: _unit(np.array([p["x"] for p in r["v"]], np.float64)).astype(np.float32) for r in whole.toLocalIterator()}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> DataFrame:
    """The documents' columns with lang_pred and score (the cosine, at least 0)."""
    spark = docs.sparkSession
    small_batches(spark)
    names = sorted(prototypes)
    sent = spark.sparkContext.broadcast(np.stack([prototypes[k] for k in names]) if names else np.empty((0, dimensions), np.float32))
    columns = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, matrix = Profiles(dimensions), sent.value
        for batch in batches:
            units = _unit(profiles.bundles(batch.column(at).to_pylist()))
            cosine = np.round(units @ matrix.T, 6) if names else np.zeros((len(units), 1), np.float32)
            best = cosine.argmax(1)
            some = units.any(1) & bool(names)
            pred = [names[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), some.tolist(), strict=True)]
            score = np.where(some, np.clip(cosine[np.arange(len(best)), best], 0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*columns, "lang_pred", "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    return plain_names(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def floors(docs: DataFrame, prototypes: dict[str, np.ndarray], max_training: int | None = None) -> dict[str, float]:
    """Per language the score below which a text is like none of its training texts: FLOOR_SHARE of their FLOOR_QUANTILE, at least MIN_SCORE.

    The quantile is exact, between the two scores beside it. Equal scores are counted; sums by thousandths tell which thousandths hold the two, and only
    those are put in order: scores have six digits, so no task orders more than about 2 000 rows of a language, whatever the table's size.
    """
    scored = identify(training(docs, max_training), prototypes).where(F.col("lang") == F.col("lang_pred"))
    counts = stored(scored.groupBy("lang", "score").count().withColumn("part", F.floor(F.col("score") * 1000)), "language-scores")
    by, at = Window.partitionBy("lang"), F.lit(FLOOR_QUANTILE) * (F.col("n") - 1)
    parts = counts.groupBy("lang", "part").agg(F.sum("count").alias("c")).select("lang", "part", "c", F.sum("c").over(by.orderBy("part")).alias("upto"), F.sum("c").over(by).alias("n"))
    parts = parts.where((F.col("upto") > F.floor(at)) & (F.col("upto") - F.col("c") <= F.ceil(at))).select("lang", "part", "n", (F.col("upto") - F.col("c")).alias("before"))
    upto = F.min("before").over(by) + F.sum("count").over(by.orderBy("score"))
    ranked = counts.join(parts, ["lang", "part"]).select("lang", "n", "score", upto.alias("upto"))
    beside = ranked.groupBy("lang", "n").agg(F.min(F.when(F.col("upto") > F.floor(at), F.col("score"))).alias("low"), F.min(F.when(F.col("upto") > F.ceil(at), F.col("score"))).alias("high"))
    low = beside.select("lang", (F.col("low") + (F.col("high") - F.col("low")) * (at - F.floor(at))).alias("low")).collect()
    release(counts)
    return {r["lang"]: max(MIN_SCORE, FLOOR_SHARE * r["low"]) for r in low}


def speakable(docs: DataFrame, prototypes: dict[str, np.ndarray], least: dict[str, float] | None = None) -> DataFrame:
    """The documents in a learned language; those without letters or, by ``least`` (else MIN_SCORE), like no language go."""
    floor = F.coalesce(F.create_map(*[F.lit(x) for pair in (least or {"": MIN_SCORE}).items() for x in pair])[F.col("lang_pred")], F.lit(MIN_SCORE))
    named = [c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]  # no name can clash, or need quotes
    said = identify(docs.toDF(*named), prototypes)
    return said.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= floor)).drop("lang_pred", "score").toDF(*docs.columns)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), learn(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op7_language_id": op7_language_id}
ORACLE_SQL: dict[str, str] = {}
