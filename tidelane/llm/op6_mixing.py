"""Mixing sources to target weights by weighted fair queueing.

Every document gets a place in a shuffle (md5 of seed and id). Its virtual finish time is the number of
words of its source up to and including it, divided by the source's target; a second pass over a source
continues where the first ends. Taking copies in order of virtual finish time serves all sources at their
weights at every moment; the mix ends where the total budget is spent.

Nothing sorts a whole source in one task. Equal rows are counted before anything is shuffled, and stand as one row with
a multiplicity, or one for every CHUNK of them: they are neighbours in the queue, so their finish times are known from
the first one's. Running sums have two levels: rows are ranged over partitions by their whole order (so a hot source or a
hot id is cut by place, size and content), cut into slices of SLICE_ROWS, summed inside, and then over the slices' totals.
The ranks of sources and the water level of their targets are found by the same sums. The end of the mix
is found from totals per slice of virtual time and then inside the one slice it falls into. Texts are read once,
to count their words, and by ``mixed`` once more.

Defined cases: a null or blank text has size 0 and is never taken; a null source is a source of its own,
last in order; repeated rows are documents of their own; documents with equal places in the shuffle (same
id) are ordered by size (and in the mix itself by their other columns), and equal ones are interchangeable; a null id shuffles as the text ``null``; texts
of any length are counted whole, by the JVM; empty tables give no rows; ``mixed`` keeps all columns, whatever their names, and where one is called like an added
one, the added one gets a further underscore. Reruns agree, as no order depends on partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm.common import stored, temporary

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_PASSES = 2
SEED = "mix"
#: Rows per slice of an order or of virtual time, about.
SLICE_ROWS = 500
#: Slices at most, as one task sums up their totals; beyond, slices hold more rows.
MAX_SLICES = 1 << 20
#: Equal rows that stand as one row of the queue, at most.
CHUNK = 1024
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame, keep: list[str | Column] | None = None, text: str = "text") -> DataFrame:
    """The kept columns with ``size``: the words of the text."""
    return docs.select(*(keep or ["doc_id", "source"]), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def running(rows: DataFrame, by: list[str], order: list[str | Column], name: str, slice_rows: int = SLICE_ROWS, **sums: str) -> DataFrame:
    """Adds for each of ``sums`` (name=column) the column's sum over the rows before, in ``order`` among equal ``by``, written out."""
    key = [*by, *order]
    place = F.monotonically_increasing_id()  # of the sorted rows: the partition, and the place in it in the low 33 bits
    size = max(slice_rows, -(-rows.count() // MAX_SLICES))
    cut = F.shiftleft(F.shiftright("_at", 33), 33) + F.expr(f"(_at & {(1 << 33) - 1}L) div {size}L")
    sliced = stored(rows.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("_at", place).withColumn("_slice", cut), f"{name}-ordered")
    inside = Window.partitionBy(*by, "_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    totals = sliced.groupBy(*by, "_slice").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_slice").alias("_of"), *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    summed = sliced.select("*", *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(n) for n, c in sums.items()])
    met = summed.join(offsets, [F.col("_slice") == F.col("_of"), *[F.col(c) == F.col(f"_{c}") for c in by]])
    return met.select(*rows.columns, *[(F.col(n) + F.col(f"_{n}")).alias(n) for n in sums])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES) -> DataFrame:
    """(source, source_rank, source_size, target): the budget poured out by weight, none above ``passes`` times its size.

    Sources fill up in order of capacity per weight; the level is where the rest of the budget meets the rest of the weights.
    """
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("source_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("k")).alias("source_size")).withColumn("one", F.lit(1))
    ranked = running(totals, [], [F.asc_nulls_last("source")], "mix-ranks", below="one").select("source", (F.col("below") + 1).alias("source_rank"), "source_size").withColumn("w", pick)
    cap = F.col("source_size") * passes
    filled = stored(running(ranked.withColumn("cap", cap).withColumn("r", cap.cast("double") / F.col("w")), [], ["r", "source_rank"], "mix-filled", cap_before="cap", w_before="w"), "mix-levels")
    all_size, all_w = filled.agg(F.sum("source_size"), F.sum("w")).first()
    candidate = (F.lit((all_size or 0) * float(share)) - F.col("cap_before").cast("double")) / (F.lit(all_w) - F.col("w_before")).cast("double")
    first = filled.withColumn("candidate", candidate).where("candidate <= r").agg(F.min(F.struct("r", "source_rank", "candidate")).alias("x")).first()["x"]
    level = F.lit(first["candidate"] if first else None).cast("double")
    return filled.select("source", "source_rank", "source_size", F.coalesce(F.least(level * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double")).alias("target"))


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.encode(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))), "UTF-8"))


def chunked(grouped: DataFrame) -> DataFrame:
    """Rows with a multiplicity ``k`` as one row for every CHUNK of them."""
    pieces = grouped.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(k - 1) div {CHUNK}"))))
    return pieces.withColumn("k", F.least(F.lit(CHUNK).cast("long"), F.col("k") - F.col("chunk") * CHUNK))


def queued(sized: DataFrame, plan: DataFrame, seed: str = SEED, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds place, chunk, and ``served``: the words of the source before the row's documents in shuffle order."""
    placed = (
        sized.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")))
        .select("d.*", "p.source_rank", "p.source_size", "p.target")
        .withColumn("place", shuffle_key(F.col("doc_id"), seed))
    )
    content = [c for c in ("content",) if c in sized.columns]
    return running(chunked(placed).withColumn("words", F.col("size") * F.col("k")), ["source_rank"], ["place", "size", *content, "chunk"], "mix-queue", slice_rows, served="words").drop("words")


def each(queue: DataFrame) -> DataFrame:
    """A row per document; ``served`` now counts the document itself."""
    one = queue.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    return one.withColumn("served", F.col("served") + F.col("_i") * F.col("size")).drop("_i", "k", "chunk")


def finish(epoch: int) -> Column:
    return (F.col("served") + F.col("source_size") * epoch) / F.col("target")


def _copies(documents: DataFrame, passes: int, *keep: str) -> DataFrame:
    copies = F.explode(F.array(*[F.struct(finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in range(passes)]))
    return documents.where("size > 0 and target > 0").select(*keep, "source_rank", "place", "size", copies.alias("c")).select("*", "c.*").drop("c")


def cut(queue: DataFrame, budget: float, passes: int = MOST_PASSES, slice_rows: int = SLICE_ROWS) -> tuple | None:
    """The last copy that fits into the budget: (finish, source_rank, place, size, epoch); None if none does.

    At a finish time of 1 every source has had its target, so the end lies near it: later times than 2 share one slice.
    """
    order = ["finish", "source_rank", "place", "size", "epoch"]
    copies = _copies(each(queue), passes)
    slices = max(1, min(MAX_SLICES, passes * (queue.agg(F.sum("k")).first()[0] or 0) // slice_rows))
    sliced = copies.withColumn("slice", F.floor(F.least(F.col("finish"), F.lit(2.0)) * slices))
    totals = sliced.groupBy("slice").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(Window.orderBy("slice")))
    last = totals.where(F.col("upto") > budget).orderBy("slice").select("slice", (F.col("upto") - F.col("n")).alias("start")).first()
    if last is None:
        row = totals.orderBy(F.desc("slice")).first()
        if row is None:
            return None
        inside, start = sliced.where(F.col("slice") == row["slice"]), 0
        kept = inside.orderBy(*[F.desc(c) for c in order]).first()
    else:
        inside, start = sliced.where(F.col("slice") == last["slice"]), last["start"]
        run = inside.withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(start))
        kept = run.where(F.col("upto") <= budget).orderBy(*[F.desc(c) for c in order]).first()
        if kept is None:  # the slice's first copy is already too much: the end lies before it
            kept = sliced.where(F.col("slice") < last["slice"]).orderBy(*[F.desc(c) for c in order]).first()
    return kept and tuple(kept[c] for c in order)


def _within(limit: tuple | None, value: Column, epoch: Column) -> Column:
    if limit is None:
        return F.lit(False)
    f, rank, place, size, last = limit
    key = F.struct(value.alias("a"), F.col("source_rank").alias("b"), F.col("place").alias("c"), F.col("size").alias("d"), epoch.alias("e"))
    end = F.struct(F.lit(f).alias("a"), F.lit(rank).alias("b"), F.lit(place).alias("c"), F.lit(size).cast("long").alias("d"), F.lit(last).alias("e"))
    return (F.col("size") > 0) & (F.col("target") > 0) & (key <= end)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES, seed: str = SEED, keep: list[str | Column] | None = None) -> tuple[DataFrame, tuple | None]:
    """The queue, a row for equal documents without their text, and the last copy taken."""
    counted = sizes(docs, keep)
    with temporary() as kept:
        sized = stored(counted.groupBy(*counted.columns).agg(F.count("*").alias("k")), "mix-sizes")
        plan = stored(targets(sized, weights, share, passes), "mix-targets")
        queue = stored(queued(sized, plan, seed), "mix-queue")
        kept.append(queue)
        total = plan.agg(F.sum("source_size")).first()[0] or 0
    return queue, cut(queue, total * share, passes)


def taken(queue: DataFrame, limit: tuple | None, passes: int = MOST_PASSES) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) per document."""
    copies = sum((_within(limit, finish(e), F.lit(e)).cast("long") for e in range(passes)), F.lit(0).cast("long"))
    return each(queue).select("doc_id", "source", "size", "source_size", "target", F.coalesce(F.col("size") * copies, F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, passes: int = MOST_PASSES, seed: str = SEED) -> DataFrame:
    """The mix itself: the documents' columns, a row per copy taken, with its finish time and epoch, in mix order over range partitions.

    Documents meet the queue by place, size and a hash of their columns; those that are equal in these are counted on both sides.
    """
    content = _content(docs)
    queue, limit = plan_mix(docs, weights, share, passes, seed, ["doc_id", "source", content])
    same = ["place", "size", "content"]
    open_ = queue.where(F.col("size") > 0).select(*same, "chunk", "k", "served", "source_rank", "source_size", "target")
    rows = sizes(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), shuffle_key(F.col("doc_id"), seed).alias("place"), content]).where("size > 0")  # one column: no name can clash
    texts = chunked(rows.groupBy(*same).agg(F.first("_row").alias("_row"), F.count("*").alias("k"))).drop("k")
    met = each(texts.join(open_, [*same, "chunk"]).withColumn("chunk", F.lit(0)))
    out = _copies(met, passes, "_row", "target").where(_within(limit, F.col("finish"), F.col("epoch")))
    order = ["finish", "source_rank", "place", "epoch"]
    named = {c.lower() for c in docs.columns}
    added = [next(n for k in range(len(named) + 1) if (n := c + "_" * k) not in named) for c in ("mix_finish", "mix_epoch")]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col("_row").getField(c).alias(c) for c in docs.columns], F.col("finish").alias(added[0]), F.col("epoch").alias(added[1]))


def _content(docs: DataFrame) -> Column:
    """A hash of all columns (but maps, which have none), nulls told from their neighbours."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return F.xxhash64(*[x for c in hashed for x in (c, c.isNull())]).alias("content")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue, limit = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return taken(queue, limit).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op6_mixing": op6_mixing}
ORACLE_SQL = {
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS source_rank FROM totals
), weighted AS (
  SELECT *, CASE (source_rank - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked
), ratio AS (
  SELECT *, (source_size * 2)::DOUBLE / w AS r FROM weighted
), leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size * 2) OVER (ORDER BY r, source_rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
            / (sum(w) OVER (ORDER BY r, source_rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS candidate
  FROM ratio
), lv AS (SELECT candidate AS level FROM leveled WHERE candidate <= r ORDER BY r, source_rank LIMIT 1),
plan AS (
  SELECT source, source_rank, source_size,
         coalesce(least((SELECT level FROM lv) * w, (source_size * 2)::DOUBLE), (source_size * 2)::DOUBLE) AS target FROM leveled
), queued AS (
  SELECT d.doc_id, d.size, p.source_rank, p.source_size, p.target, md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')) AS place,
         sum(d.size) OVER (PARTITION BY p.source_rank ORDER BY md5('mix:' || coalesce(d.doc_id::VARCHAR, 'null')), d.size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
), copies AS (
  SELECT doc_id, source_rank, place, size, epoch, (served + source_size * epoch)::DOUBLE / target AS finish
  FROM queued, (VALUES (0), (1)) e(epoch) WHERE size > 0 AND target > 0
), run AS (
  SELECT *, sum(size) OVER (ORDER BY finish, source_rank, place, size, epoch ROWS UNBOUNDED PRECEDING) AS upto FROM copies
), got AS (
  SELECT doc_id, place, size, sum(size)::BIGINT AS taken FROM run
  WHERE upto <= (SELECT 1.5::DOUBLE * sum(source_size) FROM plan) GROUP BY doc_id, place, size
)
SELECT q.doc_id, q.size, q.source_size, q.target, coalesce(g.taken, 0)::BIGINT AS taken
FROM queued q LEFT JOIN got g ON q.place = g.place AND q.size = g.size AND q.doc_id IS NOT DISTINCT FROM g.doc_id
"""
}
