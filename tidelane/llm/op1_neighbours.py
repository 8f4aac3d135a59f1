"""Approximate nearest neighbours: low-dimensional stable projections indexed by a kd-tree.

A Gaussian (2-stable) projection to DIMENSIONS numbers turns a distance d into d * chi, with chi^2 following the
chi-square law of DIMENSIONS degrees. A kd-tree over the projections returns leaves in order of nearness; their
vectors are verified with the exact measure, until the next leaf is so far, against the k-th best found so far, that
a better vector would lie that far with a probability of at most 1 - CONFIDENCE. Largest inner products become
least distances by one further component, sqrt(M^2 - |x|^2) with M the largest norm and 0 for queries, for vectors of any
length.

The upper tree is fitted on a bounded sample (MAX_SAMPLE projections, chosen by a hash of the id) and then routes
every row to a cell; cells become blocks of about BLOCK rows, with a kd-tree of their own inside, and a cell of very
many vectors becomes many blocks. Neighbouring cells form a branch of about GROUP blocks; a larger branch has several
groups. Queries, packed by branch, travel to data; data never travels to queries: a task holds one group of blocks and
lets packs stream by, and a group that very many packs ask for is repeated, each copy for some of them. A first round searches a
group of each query's own branch and so gives it a bound; then each pack walks the tree's branches (whose boxes are broadcast: as many as the
sample has leaves, at most), and only those of its queries that the stopping test leaves open are sent on to a
branch. Results are merged in two levels. No task holds more than a group and a pack.

Of equal vectors only the k + 1 with the smallest ids are indexed: no query can have others among its k nearest.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
without an id or with another length than the commonest (the longer, if tied), as they have no inner product with those; a query's candidates are all rows with other ids;
ties go to the smaller id; fewer candidates than k are all returned; of rows with one id and several vectors the
smallest vector is the query, and as a candidate the id counts once, by its best vector; equal rows count once; an empty table gives no rows; vectors so long or short that
their squares leave the range of doubles are scaled by a power of two meanwhile (their scores may then be infinite or 0, but are ranked by
what they stand for); other columns are never read, so their names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import release, small_batches, stored, temporary

K = 20
#: Projected dimensions; even, so that the chi-square law has a closed form.
DIMENSIONS = 12
CONFIDENCE = 0.98
SEED = 61
MAX_SAMPLE = 16_384
#: Rows per block of data, about; vectors per leaf inside; queries per pack.
BLOCK, LEAF, PACK = 2_048, 64, 512
#: Blocks that a task holds; packs that a copy of them serves, about.
GROUP, FAN = 24, 64
_SALTS = 1 << 24
_SLACK = 1e-9


def chi_square_quantile(p: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability p."""
    low, high = 0.0, 1000.0 + 10 * degrees
    for _ in range(200):
        x = (low + high) / 2
        term = total = 1.0
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - math.exp(-x / 2) * total < p else (low, x)
    return high


def projection(dimensions: int, seed: int = SEED) -> np.ndarray:
    """Gaussian, for vectors with one component more than the table's."""
    return np.random.default_rng(seed).standard_normal((dimensions + 1, DIMENSIONS))


def augmented(x: np.ndarray, largest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(largest**2 - (x * x).sum(1, keepdims=True), 0))], 1)


class Cells:
    """The upper kd-tree: splits of the projected space, as a heap; a point's cell is its path."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis, self.at = np.zeros(1 << depth, int), np.zeros(1 << depth)
        rows = {1: points}
        for node in range(1, 1 << depth):
            own = rows.pop(node, np.empty((0, DIMENSIONS)))
            if len(own) > 1:
                self.axis[node] = int(np.ptp(own, axis=0).argmax())
                self.at[node] = float(np.median(own[:, self.axis[node]]))
            right = own[:, self.axis[node]] > self.at[node]
            rows[2 * node], rows[2 * node + 1] = own[~right], own[right]

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] > self.at[node])
        return node - (1 << self.depth)


def leaf_order(points: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """Row order in which each run of ``leaf`` rows is a leaf of a kd-tree split at medians."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            done.append(rows)
            continue
        own = points[rows]
        axis = int(np.ptp(own, axis=0).argmax())
        half = leaf * max(1, round(len(rows) / leaf / 2))
        order = rows[np.argsort(own[:, axis], kind="stable")]
        todo += [order[half:], order[:half]]
    return np.concatenate(done) if done else np.empty(0, int)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x): the rows that take part, in double precision."""
    x = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull())
    fine = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0))
    common = fine.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return fine.where(F.size("x") == (common["d"] if common else 0))


def indexed(rows: DataFrame, k: int) -> DataFrame:
    """(vec_id, x) without equal rows, and of equal vectors the k + 1 smallest ids. Most of a common vector's rows go before the shuffle."""
    same = rows.withColumn("h", F.xxhash64("x"))
    place = F.dense_rank().over(Window.partitionBy("h", "x").orderBy("vec_id"))
    return same.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("h", "x", "vec_id").agg(F.lit(1)).select("vec_id", "x")


def best(ids: np.ndarray, found: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best (largest score, then smallest id) per query number, each (query, id) once."""
    order = np.lexsort((-scores, found, ids))
    i, f = ids[order], found[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (i[1:] != i[:-1]) | (f[1:] != f[:-1])
    order = order[fresh]
    order = order[np.lexsort((found[order], -scores[order], ids[order]))]
    i = ids[order]
    starts = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1]))) if len(i) else np.empty(0, int)
    place = np.arange(len(i)) - np.repeat(starts, np.diff(np.append(starts, len(i))))
    return order[place < k]


def search(queries: dict, blocks: list[dict], bound: np.ndarray, largest: float, stop: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query positions, ids, scores) of what the blocks have to offer, and the queries' k-th best scores by now; ``bound``: those before."""
    qv, qz, qid = queries["x"], queries["z"], queries["id"]
    fars = []  # from each query to each leaf, in the projection
    for block in blocks:
        gap = np.maximum(np.maximum(block["low"][None] - qz[:, None], qz[:, None] - block["high"][None]), 0)
        fars.append((gap * gap).sum(2))
    order = sorted((near, n, leaf) for n, far in enumerate(fars) for leaf, near in enumerate(far.min(0).tolist()))
    reach = largest**2 + (qv * qv).sum(1)
    kth = bound.copy()
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pending = 0
    for _, n, leaf in order:
        live = np.flatnonzero(fars[n][:, leaf] <= stop * np.maximum(reach - 2 * kth, 0) + _SLACK)
        if not len(live):
            continue
        xv, xid = blocks[n]["x"][leaf * LEAF : (leaf + 1) * LEAF], blocks[n]["id"][leaf * LEAF : (leaf + 1) * LEAF]
        scores = qv[live] @ xv.T
        least = kth[live, None]
        a, x = np.nonzero(scores >= least - _SLACK * np.maximum(1, np.abs(np.where(np.isfinite(least), least, 1))))
        q = live[a]
        other = qid[q] != xid[x]
        q, x = q[other], x[other]
        # The same sum, in the same order, for equal vectors wherever they stand: ties stay ties.
        hits.append((q, xid[x], (qv[q] * xv[x]).sum(1)))
        pending += len(q)
        if pending > 4 * k * len(qid):
            hits, pending = [_shrunk(hits, kth, k)], 0
    return *_shrunk(hits, kth, k), kth


def _shrunk(hits: list, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    q, v, s = (np.concatenate([np.empty(0, t), *(h[c] for h in hits)]) for c, t in enumerate((np.int64, np.int64, float)))
    keep = best(q, v, s, k)
    q, v, s = q[keep], v[keep], s[keep]
    full = np.bincount(q, minlength=len(kth)) >= k
    if full.any():
        least = np.full(len(kth), np.inf)
        np.minimum.at(least, q, s)
        kth[full] = np.maximum(kth[full], least[full])
    return q, v, s


def _bytes(x: np.ndarray) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes()], pa.binary())


def _pack_block(dimensions: int):
    """A block of data as one row, its vectors in leaves of a kd-tree."""

    def run(table: pa.Table) -> pa.Table:
        ids = np.array(table.column("vec_id").to_pylist(), np.int64)
        x = np.frombuffer(b"".join(table.column("x").to_pylist())).reshape(-1, dimensions)
        z = np.frombuffer(b"".join(table.column("z").to_pylist())).reshape(-1, DIMENSIONS)
        order = leaf_order(z)
        ids, x, z = ids[order], x[order], z[order]
        cuts = range(0, len(ids), LEAF)
        low, high = (np.stack([f(z[c : c + LEAF], axis=0) for c in cuts]) for f in (np.min, np.max))
        return pa.table({"grp": table.column("grp").slice(0, 1), "branch": table.column("branch").slice(0, 1), "id": _bytes(ids), "x": _bytes(x), "low": _bytes(low), "high": _bytes(high), "near": pa.array([low.min(0).tolist()], pa.list_(pa.float64())), "away": pa.array([high.max(0).tolist()], pa.list_(pa.float64()))})

    return run, "grp long, branch long, id binary, x binary, low binary, high binary, near array<double>, away array<double>"


def _pack_queries(table: pa.Table) -> pa.Table:
    return pa.table({"q": table.column("q").slice(0, 1), "branch": table.column("branch").slice(0, 1), **{n: pa.array([b"".join(table.column(c).to_pylist())], pa.binary()) for n, c in (("id", "raw_id"), ("x", "x"), ("z", "z"))}})


def _queries(row: dict, dimensions: int) -> dict:
    return {"id": np.frombuffer(row["id"], np.int64), "x": np.frombuffer(row["x"]).reshape(-1, dimensions), "z": np.frombuffer(row["z"]).reshape(-1, DIMENSIONS)}


_FOUND = "q long, part long, home long, qid binary, vid binary, score binary, id binary, x binary, z binary, bound binary"


def _searched(packs: DataFrame, data: DataFrame, dimensions: int, largest: float, k: int, whole: bool) -> DataFrame:
    """The packed results of packs (q, grp, id, x, z, bound) in the groups they are sent to; ``whole``: with the packs and their new bounds."""
    stop = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    copies = packs.groupBy("grp").agg((F.floor((F.count("*") - 1) / FAN) + 1).alias("copies"))
    sent = packs.join(copies.hint("merge"), "grp").select("grp", F.pmod(F.xxhash64("q"), F.col("copies")).alias("copy"), F.lit(1).alias("kind"), "q", "id", "x", "z", F.lit(None).cast("binary").alias("low"), F.lit(None).cast("binary").alias("high"), "bound")
    held = data.join(copies.hint("merge"), "grp").select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("q"), "id", "x", F.lit(None).cast("binary").alias("z"), "low", "high", F.lit(None).cast("binary").alias("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, of, fresh = [], None, True
        for batch in batches:
            for k_at in range(batch.num_rows):
                row = {c: batch.column(c)[k_at].as_py() for c in batch.schema.names}
                if of != (row["grp"], row["copy"]):
                    blocks, of = [], (row["grp"], row["copy"])
                if row["kind"] == 0:
                    get = lambda c, w, row=row: np.frombuffer(row[c]).reshape(-1, w)
                    blocks.append({"id": np.frombuffer(row["id"], np.int64), "x": get("x", dimensions), "low": get("low", DIMENSIONS), "high": get("high", DIMENSIONS)})
                    continue
                queries = _queries(row, dimensions)
                bound = np.frombuffer(row["bound"]) if row["bound"] else np.full(len(queries["id"]), -np.inf)
                q, v, s, kth = search(queries, blocks, bound, largest, stop, k)
                own = [pa.array([row[c]], pa.binary()) for c in ("id", "x", "z")] + [_bytes(kth)] if whole else [pa.nulls(1, pa.binary())] * 4
                yield pa.record_batch([pa.array([row["q"]], pa.int64()), pa.array([row["grp"]], pa.int64()), pa.array([row["grp"]], pa.int64()), _bytes(queries["id"][q]), _bytes(v), _bytes(s), *own], names=["q", "part", "home", "qid", "vid", "score", "id", "x", "z", "bound"])

    met = held.union(sent).repartition("grp", "copy").sortWithinPartitions("grp", "copy", "kind", "q")
    return met.mapInArrow(run, _FOUND)


def _walked(once: DataFrame, boxes: list[tuple], dimensions: int, largest: float) -> DataFrame:
    """(branch, q, home, id, x, z, bound): the queries of each pack that the stopping test leaves open, by branch of the tree."""
    stop = chi_square_quantile(CONFIDENCE, DIMENSIONS)
    sent = once.sparkSession.sparkContext.broadcast(([b[0] for b in boxes], np.array([b[1] for b in boxes]), np.array([b[2] for b in boxes])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, low, high = sent.value
        for batch in batches:
            for row in batch.to_pylist():
                queries, bound = _queries(row, dimensions), np.frombuffer(row["bound"])
                open_ = stop * np.maximum(largest**2 + (queries["x"] ** 2).sum(1) - 2 * bound, 0) + _SLACK
                for name, a, z in zip(names, low, high, strict=True):
                    gap = np.maximum(np.maximum(a - queries["z"], queries["z"] - z), 0)
                    live = np.flatnonzero((gap * gap).sum(1) <= open_)
                    if len(live):
                        yield pa.record_batch([pa.array([name], pa.int64()), pa.array([row["q"]], pa.int64()), pa.array([row["home"]], pa.int64()), *(_bytes(queries[c][live]) for c in ("id", "x", "z")), _bytes(bound[live])], names=["branch", "q", "home", "id", "x", "z", "bound"])

    return once.select("q", "home", "id", "x", "z", "bound").mapInArrow(run, "branch long, q long, home long, id binary, x binary, z binary, bound binary")


def _merged(parts: DataFrame, k: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        q, v, s = (np.frombuffer(b"".join(table.column(c).to_pylist()), t) for c, t in (("qid", np.int64), ("vid", np.int64), ("score", float)))
        keep = best(q, v, s, k)
        return pa.table({"q": table.column("q").slice(0, 1), "part": table.column("part").slice(0, 1), **{c: pa.array([z[keep].tobytes()], pa.binary()) for c, z in (("qid", q), ("vid", v), ("score", s))}})

    return parts.groupBy("q", "part").applyInArrow(run, "q long, part long, qid binary, vid binary, score binary")


def _nearest(vectors: DataFrame, every: int, k: int) -> tuple[DataFrame, int] | None:
    """The packed and merged results, written, and the power of two that vectors were scaled by; None without queries."""
    spark = vectors.sparkSession
    fine = usable(vectors)
    questions = stored(fine.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("x").alias("x")), "near-questions")
    rows = stored(indexed(fine, k), "near-rows")
    n, dimensions, most = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not n or questions.isEmpty():
        return None
    exponent = math.frexp(most)[1]
    scale = 0 if -400 < exponent < 400 else -exponent  # a power of two changes no digit
    grown = F.transform("x", lambda v: v * F.lit(math.ldexp(1.0, scale // 2)) * F.lit(math.ldexp(1.0, scale - scale // 2)))
    if scale:
        rows, questions = (df.withColumn("x", grown) for df in (rows, questions))
    largest = math.sqrt(rows.agg(F.max(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).first()[0]) * (1 + 1e-12)
    matrix = projection(dimensions)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(SEED)), F.lit(1_000_000)) < math.ceil(1e6 * min(1, 0.95 * MAX_SAMPLE / n))).select("x").limit(MAX_SAMPLE).toPandas()
    points = augmented(np.array(sample["x"].tolist(), float).reshape(-1, dimensions), largest) @ matrix
    depth = min(max(0, math.ceil(math.log2(n / BLOCK))), max(0, int(math.log2(max(1, len(points) / 4)))))
    cells = Cells(points, depth)
    bits = min(depth, max(0, int(math.log2(max(1, GROUP * BLOCK * 2**depth / n)))))  # cells of a branch: two to this power

    def place(further):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), float).reshape(-1, dimensions)
                z = further(x) @ matrix
                yield pa.record_batch([batch.column(0), pa.array([v.tobytes() for v in batch.column(0).to_numpy()], pa.binary()), pa.array([v.tobytes() for v in x], pa.binary()), pa.array([v.tobytes() for v in z], pa.binary()), pa.array(cells.of(z), pa.int64())], names=["vec_id", "raw_id", "x", "z", "cell"])

        return run, "vec_id long, raw_id binary, x binary, z binary, cell long"

    small_batches(spark)
    placed = stored(rows.select("vec_id", "x").mapInArrow(*place(lambda x: augmented(x, largest))), "near-placed")
    asked = stored(questions.select("vec_id", "x").mapInArrow(*place(lambda x: np.pad(x, ((0, 0), (0, 1))))).withColumn("branch", F.shiftright("cell", bits)), "near-asked")
    # As many cells as the sample has leaves, at most. Blocks are numbered within their branch, and so fall into groups.
    counts = placed.groupBy("cell").agg((F.floor((F.count("*") - 1) / BLOCK) + 1).alias("salts")).withColumn("branch", F.shiftright("cell", bits))
    before = Window.partitionBy("branch").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("first", F.coalesce(F.sum("salts").over(before), F.lit(0))), "near-cells")
    salted = placed.join(F.broadcast(counts), "cell").withColumn("number", F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("salts")))
    pack, packed = _pack_block(dimensions)
    data = stored(salted.withColumn("grp", F.col("branch") * _SALTS + F.expr(f"number div {GROUP}")).groupBy("branch", "number").applyInArrow(pack, packed), "near-data")
    release(placed)
    packs = asked.groupBy("branch").agg((F.floor((F.count("*") - 1) / PACK) + 1).alias("packs"))
    homed = asked.join(F.broadcast(packs), "branch").withColumn("q", F.col("branch") * _SALTS + F.pmod(F.xxhash64("vec_id", F.lit(4)), F.col("packs")))
    asked_packs = stored(homed.select("q", "branch", "raw_id", "x", "z").groupBy("q").applyInArrow(_pack_queries, "q long, branch long, id binary, x binary, z binary"), "near-packs")
    key, kept = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, "8")  # rows are whole blocks here
    try:
        groups = stored(data.select("branch", "grp").distinct(), "near-groups")
        homes = groups.groupBy("branch").agg(F.min("grp").alias("grp"), F.count("*").alias("n"))
        homeless = asked_packs.join(homes, "branch", "left_anti").select("q", F.lit(groups.agg(F.min("grp")).first()[0]).alias("grp"), "id", "x", "z")
        at_home = asked_packs.join(homes, "branch").select("q", (F.col("grp") + F.pmod("q", "n")).alias("grp"), "id", "x", "z").union(homeless)
        once = stored(_searched(at_home.withColumn("bound", F.lit(None).cast("binary")), data, dimensions, largest, k, True), "near-once")
        boxes = [(r["branch"], r["low"], r["high"]) for r in data.select("branch", F.posexplode("near").alias("i", "low"), F.col("away")).withColumn("high", F.element_at("away", F.col("i") + 1)).groupBy("branch", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("i", "low", "high"))).alias("b")).select("branch", F.col("b.low").alias("low"), F.col("b.high").alias("high")).orderBy("branch").collect()]
        others = _walked(once, boxes, dimensions, largest).join(groups.hint("merge"), "branch").where("grp <> home").select("q", "grp", "id", "x", "z", "bound")
        rest = stored(_searched(stored(others, "near-others"), data, dimensions, largest, k, False), "near-rest")
        spread = math.isqrt(groups.count()) + 1
        found = once.select("q", "part", "qid", "vid", "score").union(rest.select("q", "part", "qid", "vid", "score"))
        level = stored(_merged(found.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(spread))), k), "near-level")
        whole = stored(_merged(level.withColumn("part", F.lit(0).cast("long")), k), "near-whole")
    finally:
        spark.conf.set(key, kept)
    return whole, scale


def neighbours(vectors: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products for each row whose id is divisible by ``every``."""
    with temporary() as kept:
        found = _nearest(vectors, every, k)
        if found is None:
            return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        whole, scale = found
        kept.append(whole)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q, v, s = np.frombuffer(row["qid"], np.int64), np.frombuffer(row["vid"], np.int64), np.frombuffer(row["score"])
                starts = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1]))) if len(q) else np.empty(0, int)
                rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) + 1
                with np.errstate(over="ignore", under="ignore"):
                    yield pa.record_batch([pa.array(q), pa.array(rank.astype(np.int32)), pa.array(v), pa.array(np.ldexp(s, -2 * scale))], names=["query_id", "rank", "vec_id", "score"])

    return whole.mapInArrow(rows_of, "query_id long, rank int, vec_id long, score double")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_neighbours": op1_neighbours}
ORACLE_SQL: dict[str, str] = {}
