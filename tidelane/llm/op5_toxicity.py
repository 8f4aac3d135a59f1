"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The features of a text are densities of a lexicon, nearness of lexicon words to words of the second person,
capitals, punctuation and obfuscation (digits and signs inside words, stretched letters, lexicon words that
show only after look-alike signs are put back). The lexicon holds words and word beginnings that the labelled
rows use far more often in toxic texts; boosting is Newton boosting over histograms; the calibration joins the
pool-adjacent-violators blocks by lines, so that scores keep their order.

Learning uses rows outside the held-out fold only, split by the same remainder: 0 and 3 for the lexicon, 1 and 3
for the trees, 0 for the calibration. It reads at most about MAX_TRAINING labelled ids, chosen by a hash, and of each id one text (the smallest, where rows with one id differ).
Lexicon counts are added up in the tasks; only numbers (one row of features per sampled row, at most MAX_LEXICON
words) reach the driver. Scoring reads each whole text once and has no shuffle.

Defined cases: null and empty texts have features of 0 and get the score that those have; without labels, or with
labels of one kind, every score is the share of toxic labels (0 without any); null labels and null ids are not
learned from; several labels of a document: it is toxic if one says so; repeated rows are each scored; empty tables
give no rows; texts of any length are read whole, and words over LONG letters stand by a hash in the lexicon; a null id is marked as held out, as it belongs to no fold; only doc_id and text are read for a
score; all other columns are kept, whatever their names, but one called score, in any case, gives way to the result in ``score``, and stays in ``civil``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane.llm.common import crc_mod4, held_out, plain_names, release, small_batches, stored

#: Labelled rows that are learned from, about.
MAX_TRAINING = 24_000
MAX_LEXICON = 4_000
#: Tokens that a worker remembers, none longer than LONG.
MAX_SEEN = 200_000
LONG = 40
PREFIXES = (3, 4, 5, 6)
THRESHOLD = 0.3

#: Words that address somebody, in English, German, French and Spanish.
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos tú ti usted ustedes tus vosotros os".split())
#: Signs that stand for letters in disguised words.
LOOK_ALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": None, ".": None, "-": None, "_": None})
FEATURES = ("words", "hits", "density", "distinct_hits", "best_weight", "weight_sum", "second_person", "proximity", "capitals", "capital_words", "exclamations", "punctuation", "digits", "obfuscation", "disguised", "stretched")

#: What most tokens are: no weight, no mark.
PLAIN = (0.0, False, False, False, False)
_EDGES = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])) + "«»„“”’‘…–—¿¡"
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
_UPPER, _LOWER, _DIGIT, _PUNCT = (np.array([chr(b) in kind for b in range(256)]) for kind in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def term(word: str) -> str:
    """The word as a lexicon holds it: a very long one by its beginning and a hash."""
    return word if len(word) <= LONG else f"{word[:LONG]}#{xxhash.xxh3_128_hexdigest(word)}"


def terms_of(text: str) -> set[str]:
    """Words of the text and their beginnings (marked by ``^``): what a lexicon may hold."""
    words = {term(w) for w in (x.strip(_EDGES) for x in set(text.lower().split())) if w}
    return words | {"^" + w[:k] for w in words for k in PREFIXES if len(w) > k}


def stretches(text: str) -> int:
    """How often a letter stands four times or more in a row; the pattern runs only where some sign does."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    same = codes[1:] == codes[:-1]
    return len(_STRETCHED.findall(text)) if (same[2:] & same[1:-1] & same[:-2]).any() else 0


class Features:
    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.heads = {e[1:4] if e.startswith("^") else e[:3] for e in lexicon}  # a word that begins otherwise has no weight
        self.seen: dict[str, tuple] = {}
        self.plain: set[str] = set()

    def weight(self, word: str) -> float:
        """The largest weight of the word and its beginnings; 0 if the lexicon has none."""
        if word[:3] not in self.heads:
            return 0.0
        get = self.lexicon.get
        return max([get(term(word), 0.0), *(get("^" + word[:k], 0.0) for k in PREFIXES if len(word) > k)])

    def _look(self, token: str) -> tuple[float, bool, bool, bool, bool]:
        """A token's weight, and whether it is odd, disguised, an address, in capitals."""
        word = token.lower().strip(_EDGES)
        capital = len(token) > 2 and token.isupper()
        if not word or word[:3] not in self.heads and word.isalpha() and not capital and word not in SECOND_PERSON:
            return PLAIN
        w, odd, disguised = self.weight(word), False, False
        if w == 0 and not word.isalpha():
            odd = True
            if not word.isdigit() and (plain := word.translate(LOOK_ALIKES)) != word and (w := self.weight(plain)):
                disguised = True
        return (w, odd, disguised, word in SECOND_PERSON, capital)

    def _marked(self, tokens: set[str]) -> list[tuple[str, tuple]]:
        """The tokens that are not plain. What was seen before is looked up; the tables are emptied when full."""
        if len(self.plain) + len(self.seen) > MAX_SEEN:
            self.plain.clear()
            self.seen.clear()
        out, new = [], []
        for token in tokens - self.plain:
            if (found := self.seen.get(token)) is None:
                found = self._look(token)
                if found is PLAIN:
                    if len(token) <= LONG:
                        new.append(token)
                    continue
                if len(token) <= LONG:
                    self.seen[token] = found
            out.append((token, found))
        self.plain.update(new)
        return out

    def of(self, text: str | None) -> list[float]:
        if not text or not (raw := text.split()):
            return [0.0] * len(FEATURES)
        n = len(raw)
        bytes_ = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
        upper, lower, digits, punctuation = (int(bytes_[kind].sum()) for kind in (_UPPER, _LOWER, _DIGIT, _PUNCT))
        marked = self._marked(set(raw))
        weights = {token: m[0] for token, m in marked if m[0]}
        odd, disguised, capital = (sum(m[k] for _, m in marked) for k in (1, 2, 4))
        address = {token for token, m in marked if m[3]}
        places = [k for k, x in enumerate(raw) if x in weights] if weights else []
        spoken = [k for k, x in enumerate(raw) if x in address] if address else []
        near = 0.0
        if places and spoken:
            at = np.array(spoken)
            nearest = np.searchsorted(at, places)
            gap = np.minimum(np.abs(at[np.minimum(nearest, len(at) - 1)] - places), np.abs(at[np.maximum(nearest - 1, 0)] - places))
            near = float(np.sum(1.0 / (1.0 + gap)))
        letters = max(1, upper + lower)
        size = max(1, len(text))
        return [
            np.log1p(n), np.log1p(len(places)), 100.0 * len(places) / n, np.log1p(len(weights)), max(weights.values(), default=0.0),
            sum(weights[raw[k]] for k in places) / n**0.5, 100.0 * len(spoken) / n, near, upper / letters, 100.0 * capital / n,
            100.0 * (bytes_[33] + bytes_[63]) / size, 100.0 * punctuation / size, 100.0 * digits / size, 100.0 * odd / n, float(disguised), 100.0 * stretches(text) / n,
        ]


class Trees:
    """Newton boosting of shallow trees on binned features, for log loss."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least: float = 2.0, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.least, self.penalty = rounds, depth, rate, bins, least, penalty
        self.start, self.trees, self.edges = 0.0, [], []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for c in x.T]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(p / (1 - p)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), int), {}
            for level in range(self.depth + 1):
                first, width = 2**level - 1, 2**level
                for k in range(first, first + width):
                    rows = np.flatnonzero(node == k)
                    if not len(rows):
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = (1e-6, -1, 0)
                    if level < self.depth:
                        for j in range(x.shape[1]):
                            gl = np.cumsum(np.bincount(b[rows, j], g[rows], self.bins + 1))[:-1]
                            hl = np.cumsum(np.bincount(b[rows, j], h[rows], self.bins + 1))[:-1]
                            gain = gl**2 / (hl + self.penalty) + (gs - gl) ** 2 / (hs - hl + self.penalty) - gs**2 / (hs + self.penalty)
                            gain[(hl < self.least) | (hs - hl < self.least)] = 0
                            at = int(gain.argmax())
                            if gain[at] > best[0] + 1e-9:
                                best = (gain[at], j, at)
                    if best[1] < 0:
                        tree[k] = (-1, 0, self.rate * gs / (hs + self.penalty))
                        score[rows] += tree[k][2]
                        node[rows] = -1
                    else:
                        tree[k] = (best[1], best[2], 0.0)
                        node[rows] = 2 * k + 1 + (b[rows, best[1]] > best[2])
            self.trees.append(tree)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b, score = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            node = np.zeros(len(x), int)
            while (live := np.flatnonzero(node >= 0)).size:
                for k in np.unique(node[live]):
                    rows = live[node[live] == k]
                    feature, at, value = tree[int(k)]
                    if feature < 0:
                        score[rows] += value
                        node[rows] = -1
                    else:
                        node[rows] = 2 * k + 1 + (b[rows, feature] > at)
        return score


class Isotonic:
    """Pool adjacent violators; between the blocks' middles the value runs on lines."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []  # sum of y, sum of scores, rows
        values, first = np.unique(score[order], return_index=True)
        for v, a, z in zip(values, first, [*first[1:], len(order)], strict=True):
            blocks.append([float(y[order[a:z]].sum()), float(v * (z - a)), float(z - a)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        self.x = np.array([b[1] / b[2] for b in blocks])
        self.y = np.array([(b[0] + 0.02) / (b[2] + 0.2) for b in blocks])
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        inside = np.interp(score, self.x, self.y)
        return np.clip(0.999 * inside + 0.001 / (1 + np.exp(-score)), 0, 1)  # the rest keeps the order inside a level


class Model:
    """Lexicon, trees and calibration; without trees a constant."""

    def __init__(self, lexicon: dict[str, float], trees: Trees | None, calibration: Isotonic | None, constant: float = 0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def scores(self, features: np.ndarray) -> np.ndarray:
        if self.trees is None or self.calibration is None:
            return np.full(len(features), self.constant)
        return self.calibration(self.trees.raw(features))


def learn(docs: DataFrame, labels: DataFrame, max_training: int = MAX_TRAINING, max_lexicon: int = MAX_LEXICON) -> Model:
    spark = docs.sparkSession
    small_batches(spark)
    marks = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n, toxic = marks.agg(F.count("*"), F.sum(F.expr("int(toxic > 0)"))).first()
    if not n or not toxic or toxic == n:
        return Model({}, None, None, float(bool(n) and bool(toxic)))
    if n > max_training:
        marks = marks.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1_000_000)) < round(1e6 * max_training / n))
    # At most max_training marks about, of 12 bytes each, whatever the table's size, and one text for each. The texts are written once and read three times.
    one = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    rows = one.select("text", (F.col("toxic") > 0).alias("toxic"), crc_mod4(F.col("doc_id")).alias("fold"))
    rows = stored(rows, "toxicity-training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, list[int]] = {}
        for batch in batches:
            for text, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in terms_of(text or ""):
                    seen.setdefault(term, [0, 0])[bad] += 1
        if seen:
            names = list(seen)
            yield pa.record_batch([pa.array(names, pa.string()), pa.array([seen[t][0] for t in names], pa.int64()), pa.array([seen[t][1] for t in names], pa.int64())], names=["term", "clean", "toxic"])

    of_kind = rows.where("fold in (0, 3)").groupBy("toxic").count().collect()
    n_toxic, n_clean = (next((r["count"] for r in of_kind if r["toxic"] == kind), 0) for kind in (True, False))
    terms = rows.where("fold in (0, 3)").select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log(((F.col("toxic") + 0.2) / (n_toxic + 0.4)) / ((F.col("clean") + 0.2) / (n_clean + 0.4)))
    least = max(2, n_toxic // 1000)
    lexicon = {r["term"]: float(r["w"]) for r in terms.where(F.col("toxic") >= least).withColumn("w", weight).where((F.col("w") >= 2.5) & (F.col("toxic") >= F.col("clean"))).orderBy(F.desc(F.col("w") * F.log1p("toxic")), "term").limit(max_lexicon).collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(lexicon)
        for batch in batches:
            yield pa.record_batch([pa.array([features.of(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64())), batch.column(1), batch.column(2)], names=["x", "toxic", "fold"])

    table = rows.select("text", "toxic", "fold").mapInArrow(measure, "x array<double>, toxic boolean, fold long").toPandas()  # a row of numbers for each labelled id
    release(rows)
    if table.empty:
        return Model({}, None, None, toxic / n)
    x, y, fold = np.array(table["x"].tolist(), float), table["toxic"].to_numpy(float), table["fold"].to_numpy()
    order = np.lexsort((*x.T, y))  # the same rows give the same model, in whatever order they came
    x, y, fold = x[order], y[order], fold[order]
    grow, calibrate = fold != 0, fold == 0
    if y[grow].min(initial=1) == y[grow].max(initial=0) or y[calibrate].min(initial=1) == y[calibrate].max(initial=0):
        return Model({}, None, None, toxic / n)
    trees = Trees().fit(x[grow], y[grow])
    return Model(lexicon, trees, Isotonic().fit(trees.raw(x[calibrate]), y[calibrate]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents' columns with ``score``."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)
    columns = [c for c in docs.columns if c.lower() != "score"]
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(sent.value.lexicon)
        for batch in batches:
            x = np.array([features.of(t) for t in batch.column(at).to_pylist()], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(x), pa.float64())], names=[*columns, "score"])

    kept = docs.select(*[F.col(f"`{c}`") for c in columns])
    return plain_names(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def civil(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, their columns as they were."""
    named = [c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]  # no name can clash, or need quotes
    scored = score(docs.toDF(*named), model).where(F.col("score") < threshold)
    return scored.drop("score").toDF(*docs.columns)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLE_SQL: dict[str, str] = {}
