"""Token counts: one exact histogram of encoded lengths answers every total, quantile and context limit.

The texts are encoded once: each task folds its documents into (length, documents) pairs, so what is
shuffled is bounded by the number of distinct lengths, not by the number of documents, and the merged
histogram is written, as all answers read it more than once. Suffix sums over it then give, for every length L: documents and tokens at or above L, and the tokens
kept if every document is truncated to L.

Defined cases: a null text counts as a document of 0 tokens, like an empty one; repeated rows count as
often as they occur; an empty table gives an empty histogram; other columns are never read, so clashing
names do no harm; special-token strings in a text are ordinary text; texts of any length are encoded whole. A very
long run of blanks inside a text, which the pattern's engine can't take, is cut where the pattern ends a word
anyhow: before its last blank. So the pieces' counts add up to the whole's.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import read_bytes, small_batches, stored

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the word pattern that the public byte-level BPE vocabularies are used with.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Inner runs of blanks from this length on are encoded apart.
LONG_RUN = 10_000
#: The blanks that the pattern's engine knows.
_LONG_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Lengths per block of the two-level suffix sums.
SPAN = 256


def cut_at_long_runs(text: str) -> Iterator[str]:
    """Pieces of the text that BYTE_BPE_PATTERN cuts there too: a run of blanks but its last one is a word of its own."""
    at = 0
    for m in _LONG_BLANKS.finditer(text):
        if m.end() < len(text):  # at the end of the text the pattern takes the run at once
            yield text[at : m.start()]
            yield text[m.start() : m.end() - 1]
            at = m.end() - 1
    yield text[at:]


def make_counter(name: str, content: bytes, pattern: str = BYTE_BPE_PATTERN) -> Callable[[list[str]], list[int]]:
    """A function from texts to token counts for a .tiktoken, tokenizers .json or sentencepiece .model file."""
    if name.endswith(".tiktoken"):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in content.splitlines() if line)}
        encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        if pattern != BYTE_BPE_PATTERN:
            return lambda texts: [len(encode(t)) for t in texts]
        return lambda texts: [len(encode(t)) if len(t) < LONG_RUN else sum(len(encode(piece)) for piece in cut_at_long_runs(t)) for t in texts]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_buffer(content)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"unknown kind of vocabulary file: {name}")


def length_histogram(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, text: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents encode to each length."""
    spark = docs.sparkSession
    small_batches(spark)
    file = spark.sparkContext.broadcast((vocabulary, read_bytes(spark, vocabulary)))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make_counter(*file.value)
        seen: Counter[int] = Counter()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            seen.update(count([t for t in texts if t]))
            if empty := sum(not t for t in texts):
                seen[0] += empty
        if seen:
            lengths = sorted(seen)
            yield pa.record_batch([pa.array(lengths, pa.int64()), pa.array([seen[k] for k in lengths], pa.int64())], names=["n_tokens", "n_docs"])

    parts = docs.select(F.col(text).alias("text")).mapInArrow(fold, "n_tokens long, n_docs long")
    return stored(parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs")), "token-lengths")


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """Per length: documents and tokens at or above it, totals, and the tokens kept under that context limit.

    Two levels: sums inside blocks of SPAN lengths, then over the few block totals, so no task
    sorts the whole histogram.
    """
    h = histogram.withColumn("block", F.floor(F.col("n_tokens") / SPAN)).withColumn("n_sum", F.col("n_tokens") * F.col("n_docs"))
    inside = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    blocks = (
        h.groupBy("block")
        .agg(F.sum("n_docs").alias("d"), F.sum("n_sum").alias("t"))
        .select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"), F.sum("d").over(everything).alias("total_docs"), F.sum("t").over(everything).alias("total_tokens"))
    )
    summed = h.withColumn("d_in", F.sum("n_docs").over(inside)).withColumn("t_in", F.sum("n_sum").over(inside)).join(blocks, "block")
    docs_ge, tokens_ge = F.col("docs_above") + F.col("d_in"), F.col("tokens_above") + F.col("t_in")
    return summed.select(
        "n_tokens", "n_docs", docs_ge.alias("docs_ge"), tokens_ge.alias("tokens_ge"),
        (F.col("total_tokens") - tokens_ge + docs_ge * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("total_docs") - docs_ge + F.col("n_docs")) / F.col("total_docs")).alias("quantile"),
        "total_docs", "total_tokens",
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context_limit, truncated_total, n_truncated) for any limits, from the histogram alone."""
    sums = [F.struct(F.lit(int(k)).cast("long").alias("context_limit"), F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(int(k))) * F.col("n_docs")), F.lit(0)).alias("truncated_total"), F.coalesce(F.sum(F.when(F.col("n_tokens") > k, F.col("n_docs"))), F.lit(0)).alias("n_truncated")) for k in limits]
    return histogram.agg(F.array(*sums).alias("x")).select(F.inline("x"))


def length_quantiles(histogram: DataFrame, probabilities: list[float]) -> DataFrame:
    """(p, n_tokens): the smallest length with at least a share p of the documents at or below it."""
    sums = suffix_sums(histogram)
    least = [F.struct(F.lit(float(p)).alias("p"), F.min(F.when(F.col("quantile") >= p, F.col("n_tokens"))).alias("n_tokens")) for p in probabilities]
    return sums.agg(F.array(*least).alias("x")).select(F.inline("x"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_sums(length_histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLE_SQL: dict[str, str] = {}
