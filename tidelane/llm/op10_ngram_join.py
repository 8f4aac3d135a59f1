"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures.

Documents become sorted arrays of distinct 64-bit hashes of 5-word shingles. Two of them link when their
intersection is at least 80 % of their union. What makes that cheap is a chain of exact bounds, each a
superset of the links, and a last exact test:

1. Equal sets form classes by digest; one representative stands for a class.
2. Shingles have one global order, rare ones first: by a table of counters over all documents, which grows with the
   corpus from 2^20 to 2^24 counters, then by
   hash. In this order linked sets share a shingle among their first n - ceil(0.8 n) + 1, and the smaller
   one has it among its first n - ceil(8 n / 9) + 1. Documents with such a shingle in common meet in its tile.
3. Inside tiles, each document is first compared with the tiles' most frequent centre and with its most
   frequent neighbour in size: copies of one text are tied together by as many comparisons as documents.
4. Documents of one component need no further comparison with each other. Tiles that still hold several
   components are cut into size bands, large ones salted; a band meets itself and the next, and inside that join a
   pair goes on only if sizes, the places of the tile's shingle and (in tiles of over SIGNED rows) the bit counts of bitmap signatures allow enough
   overlap: at most n_x - |X and not Y| shingles of x can be in y. Only such pairs are ever written. Wider signatures of all of them are
   looked at next.
5. What passes, and was not compared yet, is decided by the exact intersection of the sorted arrays.

Tiles whose counter exceeds HOT rows are never gathered in a task: what a tile must know as a whole is aggregated and
joined back, where a join may be split; smaller ones use windows. Copies in one task are posted once. Nothing is sampled or
capped; the order table's size changes only the tiles' sizes, never the links. Pairs of a tile are looked at in the join, so a
passage that very many otherwise different documents of one size share costs comparisons of signatures with the square of their number, though no
rows. Texts that are fetched for comparisons are those of documents in a shared tile only.

Defined cases: a null or wordless text has no shingle and links with nothing; a text of fewer words than a
shingle is one shingle, different from any full one; texts of any length are read whole; repeated rows, and rows of one doc_id with different
texts, are one node; a null doc_id is in no component (null); an empty table gives no rows; only doc_id and text
are read. ``one_of_each`` keeps all columns, whatever their names, and of different rows with one kept id the one with the smallest text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import release, small_batches, stored
from tidelane.llm.components import components

WORDS = 5
PERCENT = 80
#: Counters of the order table, by powers of two: for small and for very large corpora, and shingles for each of them between.
FEWEST_COUNTERS, MOST_COUNTERS, SHINGLES_EACH = 20, 24, 64
COUNTER_SLICES = 256
#: Rows from which a tile counts as hot.
HOT = 2_000
#: Documents of a tile per salt.
BLOCK = 512
#: Signatures have about four bits a shingle, within these limits.
FEWEST_BITS, MOST_BITS = 256, 4096
#: Rows up to which a tile is joined without signatures, as it makes few pairs for each of its rows; and the bits of those of larger tiles, 64 in a number.
SIGNED = 4
TILE_BITS = 1024
#: Ids (8 bytes each) that may be broadcast to fetch texts without shuffling all of them.
MAX_BROADCAST_IDS = 2_000_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of a word that the table hashes, each with its place; longer words are hashed one by one. Bytes of a text that are hashed at once.
TABLE_BYTES, PIECE_BYTES = 64, 1 << 22
_BLANK = re.compile(rb"[ \t-\r]")
_SPACE = np.array([b in b" \t\n\v\f\r" for b in range(256)])


class Shingler:
    """Sorted distinct shingle hashes of a text. Words are hashed by sums of random numbers, one for each byte and place, for all words of a piece at once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.table = np.random.default_rng(20_263).integers(0, 1 << 64, TABLE_BYTES << 8, np.uint64)

    def _hashes(self, data: bytes) -> np.ndarray:
        """The words' hashes, in order, of bytes that end with a whole word."""
        raw = np.frombuffer(data, np.uint8)
        inside = ~_SPACE[raw]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, sizes = edges[::2], edges[1::2] - edges[::2]
        if not len(starts):
            return np.empty(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        own = raw[inside]
        place = np.arange(len(own)) - np.repeat(first, sizes)
        if (long := np.flatnonzero(sizes > TABLE_BYTES)).size:
            place = np.minimum(place, TABLE_BYTES - 1)
        out = np.add.reduceat(self.table[place << 8 | own], first)
        for k in long.tolist():
            out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : starts[k] + sizes[k]])
        with np.errstate(over="ignore"):
            return (out ^ out >> np.uint64(32)) * _MULTIPLIER

    def set_of(self, text: str | None) -> np.ndarray:
        data, at, parts = text.encode().lower() if text else b"", 0, []
        while at < len(data):
            end = len(data)
            if end - at > PIECE_BYTES:  # a piece ends before a blank
                found = _BLANK.search(data, at + PIECE_BYTES)
                end = found.start() if found else end
            parts.append(self._hashes(data[at:end]))
            at = end
        hashes = np.concatenate(parts) if parts else np.empty(0, np.uint64)
        if not len(hashes):
            return hashes
        k = min(self.words, len(hashes))
        mixed = np.full(len(hashes) - k + 1, k, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(k):
                mixed = (mixed ^ hashes[at : len(hashes) - k + 1 + at]) * _MULTIPLIER
                mixed ^= mixed >> np.uint64(29)
        mixed.sort()
        return mixed[np.concatenate(([True], mixed[1:] != mixed[:-1]))]


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, percent: int = PERCENT):
    """The smallest intersection with 100 * i >= percent * (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if not len(a) or not len(b):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signature(shingles: np.ndarray) -> bytes:
    """A bitmap; its width follows the size band, a power of two, so that a wider one folds onto a narrower."""
    bits = min(MOST_BITS, max(FEWEST_BITS, 1 << int(4 * len(shingles) - 1).bit_length()))
    on = np.zeros(bits, bool)
    on[(shingles >> np.uint64(40)).astype(np.int64) & (bits - 1)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def tile_bits(shingles: np.ndarray) -> bytes:
    on = np.zeros(TILE_BITS, bool)
    on[(shingles >> np.uint64(40)).astype(np.int64) & (TILE_BITS - 1)] = True
    return np.packbits(on, bitorder="little").tobytes()


def counters_for(docs: DataFrame) -> int:
    """The order table's size for the corpus: there are about as many shingles as words."""
    words = (docs.agg(F.sum(F.length("text"))).first()[0] or 0) // 6
    return 1 << min(MOST_COUNTERS, max(FEWEST_COUNTERS, int(words // SHINGLES_EACH).bit_length()))


def profiles(docs: DataFrame, counters: int, words: int = WORDS) -> DataFrame:
    """One row per document (id, n, digest d1 d2), and per task the slices of its counter table (k, blob)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts, mask = Shingler(words), np.zeros(counters, np.uint32), np.uint64(counters - 1)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingler.set_of(text)
                np.add.at(counts, (s & mask).astype(np.int64), np.uint32(1))
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                rows.append((doc_id, len(s), _signed(d & (1 << 64) - 1), _signed(d >> 64)))
            yield _rows(rows)
        slices = counts.reshape(COUNTER_SLICES, -1)
        some = [k for k in range(COUNTER_SLICES) if slices[k].any()]
        if some:
            nothing = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([nothing, nothing, nothing, nothing, pa.array(some, pa.int32()), pa.array([zlib.compress(slices[k].tobytes(), 1) for k in some], pa.binary())], names=["doc_id", "n", "d1", "d2", "k", "blob"])

    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        return pa.record_batch([*(pa.array(c, pa.int64()) for c in columns), pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "n", "d1", "d2", "k", "blob"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, k int, blob binary")


def counter_table(slices: DataFrame, counters: int) -> np.ndarray:
    """The tasks' counter tables added up: 2^MOST_COUNTERS numbers at most."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + np.frombuffer(zlib.decompress(blob), np.uint32).astype(np.uint64)
        yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["k", "blob"])

    table = np.zeros((COUNTER_SLICES, counters // COUNTER_SLICES), np.uint64)
    for row in slices.repartition("k").mapInArrow(add, "k int, blob binary").toLocalIterator():
        table[row["k"]] += np.frombuffer(row["blob"], np.uint64)
    return table.reshape(-1)


def postings(docs: DataFrame, table: np.ndarray, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(key, doc_id, n, d1, d2, pos, hot): the tiles that each document is in, at which place of its order the tile's shingle stands, and whether the tile may be hot."""
    sent = docs.sparkSession.sparkContext.broadcast(np.minimum(table, (1 << 32) - 1).astype(np.uint32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, counts = Shingler(words), sent.value
        mask = np.uint64(len(counts) - 1)
        names = ["key", "doc_id", "n", "d1", "d2", "pos", "hot"]
        posted: dict[int, int] = {}  # the smallest id of each set so far
        for batch in batches:
            parts: list[list[np.ndarray]] = [[] for _ in names]
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingler.set_of(text)
                n = len(s)
                if not n or doc_id is None:
                    continue
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                if posted.get(d, doc_id + 1) <= doc_id:
                    continue
                if len(posted) > 200_000:
                    posted.clear()
                posted[d] = doc_id
                first = n - -(-percent * n // 100) + 1
                load = counts[(s & mask).astype(np.int64)].astype(np.uint64)
                order = np.argsort(load << np.uint64(32) | s >> np.uint64(32), kind="stable")[:first]
                for part, x in zip(parts, (s[order].view(np.int64), np.full(first, doc_id, np.int64), np.full(first, n, np.int32), np.full(first, _signed(d & (1 << 64) - 1)), np.full(first, _signed(d >> 64)), np.arange(first, dtype=np.int32), load[order] > hot), strict=True):
                    part.append(x)
                held += first
                if held > 100_000:
                    yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], names=names)
                    parts, held = [[] for _ in names], 0
            if held:
                yield pa.record_batch([pa.array(np.concatenate(p)) for p in parts], names=names)

    return docs.mapInArrow(run, "key long, doc_id long, n int, d1 long, d2 long, pos int, hot boolean")


def differing(rows: DataFrame, what: str) -> DataFrame:
    """The rows of tiles in which ``what`` has several values, with the tile's number of rows, m: by a window, or for hot tiles by an aggregation that is joined back."""
    tile = Window.partitionBy("key")
    cold = rows.where("not hot").withColumn("lo", F.min(what).over(tile)).withColumn("hi", F.max(what).over(tile)).withColumn("m", F.count("*").over(tile)).where("lo <> hi").drop("lo", "hi")
    of = rows.where("hot").groupBy("key").agg(F.min(what).alias("lo"), F.max(what).alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("key", "m")
    return cold.unionByName(rows.where("hot").join(of, "key"))


def shared_tiles(posted: DataFrame) -> DataFrame:
    """Tiles in which different sets meet: (key, hot, node, d1, n, pos, m), one row per class of equal sets; m: about as many rows has the tile."""
    met = differing(posted, "d1")
    return met.groupBy("key", "d1", "d2", "n").agg(F.min("doc_id").alias("node"), F.min("pos").alias("pos"), F.max("hot").alias("hot"), F.max("m").alias("m")).select("key", "hot", "node", "d1", "n", "pos", "m")


def _open(a: str, b: str, percent: int) -> str:
    """Sizes are near enough, and if this tile is the first that two sets share, what stands behind their places is long enough."""
    least = f"(({percent} * ({a}.n + {b}.n) + {99 + percent}) div {100 + percent})"
    return f"({a}.node <> {b}.node or {a}.d1 <> {b}.d1) and 100L * least({a}.n, {b}.n) >= {percent}L * greatest({a}.n, {b}.n) and {least} <= least({a}.n - {a}.pos, {b}.n - {b}.pos)"


def _pairs(met: DataFrame) -> DataFrame:
    """Each pair once, as (a, b) of (node, d1), the smaller first."""
    a, b = (F.struct(F.col(f"{x}.node").alias("node"), F.col(f"{x}.d1").alias("d1")) for x in "ab")
    return met.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def first_pairs(tiles: DataFrame, percent: int = PERCENT) -> DataFrame:
    """At most two comparisons per document: with the centre it meets most often, and with the neighbour below it in size."""
    row = F.struct("node", "d1", "n", "pos")
    centre = tiles.groupBy("key").agg(F.min(row).alias("a"))
    by_centre = tiles.select("key", row.alias("b")).join(centre, "key").select("a", "b")
    part = F.pmod(F.xxhash64("node", "d1"), F.floor(F.col("m") / HOT) + 1)  # of a hot tile: any neighbour will do here
    by_size = tiles.withColumn("part", part).select(F.lag(row).over(Window.partitionBy("key", "part").orderBy("n", "node", "d1")).alias("a"), row.alias("b")).where("a is not null")

    def most_met(met: DataFrame) -> DataFrame:
        fit = met.where(_open("a", "b", percent)).groupBy(F.struct("a.node", "a.d1").alias("a"), F.struct("b.node", "b.d1").alias("b")).count()
        return fit.groupBy("b").agg(F.min(F.struct((-F.col("count")).alias("c"), "a")).alias("x")).select("x.a", "b")

    return _pairs(most_met(by_centre).union(most_met(by_size)))


def banded(tiles: DataFrame, found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of tiles that still hold several components, with comp, size band and the tile's salts."""
    labelled = tiles.drop("m").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    several = differing(labelled, "comp").withColumn("salts", (F.col("m") / BLOCK).cast("int") + 1)
    return several.select("key", "node", "d1", "n", "pos", "comp", "m", "salts", F.floor(F.log("n") / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int").alias("band"))


def open_pairs(rows: DataFrame, signs: DataFrame | None = None, percent: int = PERCENT) -> DataFrame:
    """Pairs of different components that meet in a tile of their size band and that sizes, places and, with ``signs`` (node, d1, tile), bit counts leave open.

    A band spans sizes up to the factor that linked sets may differ by, so a set meets its own band and the
    next. Within a tile one side is salted and the other repeated for each salt, by the tile's size.
    """
    signed = rows if signs is None else rows.join(signs, ["node", "d1"])
    row = F.struct("node", "d1", "n", "pos", "comp", *["tile"] * (signs is not None))
    # The smaller set of a linked pair has the shingle among its first ones: at least so much of it stands behind.
    early = signed.where(f"({2 * percent}L * n + {99 + percent}) div {100 + percent} <= n - pos")
    small = early.select("key", F.explode(F.array("band", F.col("band") + 1)).alias("band"), F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), row.alias("a"))
    large = signed.select("key", "band", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), row.alias("b"))
    close = "true"
    if signs is not None:  # both ways, bits of one that the other lacks are shingles it lacks
        least = f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"
        lacks = lambda x, y: " + ".join(f"bit_count({x}.tile[{k}] & ~{y}.tile[{k}])" for k in range(TILE_BITS // 64))
        close = f"a.n - ({lacks('a', 'b')}) >= {least} and b.n - ({lacks('b', 'a')}) >= {least}"
    met = small.join(large, ["key", "band", "salt"]).where(f"a.comp <> b.comp and (a.n < b.n or a.n = b.n and a.node < b.node or a.n = b.n and a.node = b.node and a.d1 < b.d1) and {_open('a', 'b', percent)} and {close}")
    return met.select(F.struct("a.node", "a.d1").alias("a"), F.struct("b.node", "b.d1").alias("b"))


def ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a.node", "b.node")).alias("node"))


def fetched(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, d1, text, n, bits) of the documents with the ids."""
    nodes = stored(nodes.distinct(), "join-nodes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
            d1 = [_signed(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1) for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(d1, pa.int64()), batch.column(1), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary())], names=["node", "d1", "text", "n", "bits"])

    known = stored(_of_nodes(docs, nodes).mapInArrow(run, "node long, d1 long, text string, n int, bits binary"), "join-texts")
    repeated = known.groupBy("node", "d1").count().where("count > 1")
    return known if repeated.isEmpty() else stored(known.dropDuplicates(["node", "d1"]), "join-texts")


def _of_nodes(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) of the stored, distinct nodes."""
    wanted = F.broadcast(nodes) if nodes.count() <= MAX_BROADCAST_IDS else nodes
    return docs.join(wanted, docs["doc_id"] == nodes["node"], "left_semi").select("doc_id", "text")


def tile_signs(docs: DataFrame, nodes: DataFrame, words: int = WORDS) -> DataFrame:
    """(node, d1, tile): the bitmaps that large tiles are joined with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for batch in batches:
            sets = [shingler.set_of(t) for t in batch.column(1).to_pylist()]
            d1 = [_signed(xxhash.xxh3_128_intdigest(s.tobytes()) & (1 << 64) - 1) for s in sets]
            yield pa.record_batch([batch.column(0), pa.array(d1, pa.int64()), pa.array([np.frombuffer(tile_bits(s), np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "d1", "tile"])

    nodes = stored(nodes.distinct(), "join-nodes")
    return stored(_of_nodes(docs, nodes).mapInArrow(run, "node long, d1 long, tile array<long>").dropDuplicates(["node", "d1"]), "join-signs")


def within_bounds(pairs: DataFrame, known: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose signatures allow enough overlap: at most n_x - |X and not Y| shingles of x are in y, and the same the other way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x, percent) for x in zip(*(batch.column(c).to_pylist() for c in ("a_n", "a_bits", "b_n", "b_bits")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = _with(_with(pairs, known, "a", "n", "bits"), known, "b", "n", "bits")
    return both.select("a", "b", "a_n", "a_bits", "b_n", "b_bits").mapInArrow(run, pairs.schema)


def may_link(n: int, x: bytes, m: int, y: bytes, percent: int = PERCENT) -> bool:
    width = min(len(x), len(y))
    bx, by = (np.bitwise_or.reduce(np.frombuffer(z, np.uint8).reshape(-1, width), 0).view(np.uint64) for z in (x, y))
    most = min(n - int(np.bitwise_count(bx & ~by).sum()), m - int(np.bitwise_count(by & ~bx).sum()))
    return most >= least_overlap(n, m, percent)


def _with(pairs: DataFrame, known: DataFrame, side: str, *columns: str) -> DataFrame:
    of = known.select(F.struct("node", "d1").alias(side), *[F.col(c).alias(f"{side}_{c}") for c in columns])
    return pairs.join(of, side)


def verified(pairs: DataFrame, known: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(a, b): nodes whose sorted arrays really overlap enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, last = Shingler(words), (None, None)
        for batch in batches:
            keep = []
            for a, ta, tb in zip(*(batch.column(c).to_pylist() for c in ("a", "a_text", "b_text")), strict=True):
                if last[0] != a:
                    last = (a, shingler.set_of(ta))
                keep.append(linked(last[1], shingler.set_of(tb), percent))
            found = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield pa.record_batch([pc.struct_field(found.column(c), "node") for c in ("a", "b")], names=["a", "b"])

    # b goes along first: a centre of many pairs is mostly the smaller id, a, whose join AQE can split.
    both = _with(_with(pairs, known, "b", "text"), known, "a", "text")
    return both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long")


def join_documents(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, hot: int = HOT) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    counters = counters_for(texts)
    both = stored(profiles(texts, counters, words), "join-profiles")
    table = counter_table(both.where("k is not null").select("k", "blob"), counters)
    rows = both.where("k is null").select("doc_id", "n", "d1", "d2")
    posted = stored(postings(texts, table, words, percent, hot), "join-posted")
    tiles = stored(shared_tiles(posted), "join-tiles")
    release(posted)
    tried = stored(first_pairs(tiles, percent), "join-first")
    known = fetched(texts, ends(tried), words)
    ties = stored(verified(tried, known, words, percent), "join-ties")
    release(known)
    found = stored(components(ties, "join-stars"), "join-found")
    open_ = stored(banded(tiles, found, percent), "join-banded")
    many = open_.where(F.col("m") > SIGNED)
    signs = tile_signs(texts, many.select("node"), words)
    met = open_pairs(open_.where(F.col("m") <= SIGNED), None, percent).union(open_pairs(many, signs, percent))
    left = stored(_pairs(met).join(tried, ["a", "b"], "left_anti"), "join-open")
    known = fetched(texts, ends(left), words)
    close = stored(within_bounds(left, known, percent), "join-close")
    more = stored(verified(close, known, words, percent), "join-more")
    release(known, signs, tiles, tried, open_, left, close, found)
    # Rows of one id with different texts, and classes of equal sets, are edges too.
    classes = stored(rows.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("node")), "join-sets")
    member = stored(rows.where("n > 0 and doc_id is not null").join(classes, ["n", "d1", "d2"]).select("doc_id", "node").distinct(), "join-classes")
    split = member.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    same = member.join(split, "doc_id").select("a", F.col("node").alias("b"))
    final = stored(components(ties.union(more).union(same), "join-stars"), "join-final")
    of_id = member.groupBy("doc_id").agg(F.min("node").alias("node")).join(final, "node", "left").select("doc_id", F.coalesce("component", "node").alias("of"))
    return rows.join(of_id, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("of", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents' columns: of each component the document with the smallest id, of repeated rows one; documents without an id stay."""
    found = stored(join_documents(docs, words, percent), "join-result")
    drop = stored(found.where("doc_id is not null and component_id <> doc_id").select(F.col("doc_id").alias("_gone")).distinct(), "join-drop")
    kept = docs.join(F.broadcast(drop) if drop.count() <= MAX_BROADCAST_IDS else drop, F.col("doc_id") == F.col("_gone"), "left_anti")
    again = stored(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_gone")).join(drop, "_gone", "left_anti"), "join-again")
    if again.isEmpty():
        return kept
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    repeated = kept.join(again, F.col("doc_id") == F.col("_gone"), "left_semi")
    one = repeated.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*hashed))).alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns])
    return kept.join(again, F.col("doc_id") == F.col("_gone"), "left_anti").union(one)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op10_ngram_join": op10_ngram_join}
ORACLE_SQL: dict[str, str] = {}
