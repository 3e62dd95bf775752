"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source lays the words of its documents, in the order of a seeded hash, on a line and cuts it
into blocks of equal length. Its target, in blocks, is its exact quota. A binary tree splits the
vector of quotas: each node draws how many blocks of each source go left, from the multivariate
hypergeometric distribution, and the rest goes right; the leaves are the output shards. A source's
blocks are permuted, and each leaf owns the next disjoint stretch of the permutation. Within a
shard the draws are ordered by a seeded hash (`place`). All of it is DataFrame and SQL functions.

A quota above the number of blocks wraps round, so a block is drawn at most twice, and a document
gives at most twice its size. Words of one document may lie in several blocks.

Null text has size 0; a null source is a source of its own, ordered last. A document without words
is never drawn and keeps its row. Results depend on ids, sources and sizes only, so reruns agree;
rows equal in all three are interchangeable. A source without words has target 0. An empty table
gives no rows. In `mixed_rows` all other columns are passed on, whatever their names.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowkit.llm.common import WORD, free_name
from flowkit.staging import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BLOCK_WORDS = 1024
LEAST_BLOCKS = 1000
SHARD_WORDS = 4 << 20
SPREAD_LEVEL = 8
# Two primes. One of them does not divide a number of blocks below 10**14.
STRIDES = (10_000_019, 10_000_079)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|mix")))


def source_plan(sizes: DataFrame) -> DataFrame:
    """Per source: s (rank), source, source_size, target, block (words), blocks, quota (blocks).

    The level to which all sources are filled, by weight, is the largest of the levels that follow
    from capping the k sources that reach their cap first.
    """
    every = Window.orderBy(F.col("source").asc_nulls_last())
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("s", F.row_number().over(every) - 1)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in WEIGHTS]), F.col("s") % len(WEIGHTS) + 1)
    cap = F.lit(float(MOST)) * F.col("source_size")
    weighed = ranked.withColumn("weight", weight).withColumn("cap", cap)
    all_ = Window.partitionBy()
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "s").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    left = SHARE * F.sum("source_size").over(all_) - F.sum("cap").over(by_cap) + F.col("cap")
    open_weight = F.sum("weight").over(all_) - F.sum("weight").over(by_cap) + F.col("weight")
    filled = weighed.withColumn("level", left / open_weight)
    target = F.least("cap", F.max("level").over(all_) * F.col("weight"))
    block = F.greatest(
        F.lit(1), F.least(F.lit(BLOCK_WORDS), F.expr(f"source_size div {LEAST_BLOCKS}")))
    return (
        filled.withColumn("target", target).withColumn("block", block.cast("long"))
        .withColumn("blocks", F.expr("(source_size + block - 1) div block"))
        .withColumn("quota", F.when(F.col("source_size") > 0, F.round(
            F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0).cast("long"))
        .select("s", "source", "source_size", "target", "block", "blocks", "quota")
    )


def hypergeometric(total: str, marked: str, drawn: str, u: str) -> str:
    """SQL for a draw: marked ones among `drawn` of `total`, of which `marked` are marked.

    Inverts the distribution function from the mode outwards, 12 standard deviations each way.
    """
    bind = f"""transform(array(struct(
        cast({total} as double) as n, cast({marked} as double) as k, cast({drawn} as double) as d,
        {u} as u,
        cast(greatest(0, {drawn} - ({total} - {marked})) as bigint) as lo,
        cast(least({marked}, {drawn}) as bigint) as hi)), p -> struct(p as p,
        least(p.hi, greatest(p.lo, cast(floor((p.d + 1) * (p.k + 1) / (p.n + 2)) as bigint))) as m,
        cast(ceil(12 * sqrt(p.d * p.k / greatest(p.n, 1) * (1 - p.k / greatest(p.n, 1))
            * (p.n - p.d) / greatest(p.n - 1, 1))) + 12 as bigint) as r))[0]"""
    up = "(a.p.k - x) * (a.p.d - x) / ((x + 1) * (a.p.n - a.p.k - a.p.d + x + 1))"
    down = "x * (a.p.n - a.p.k - a.p.d + x) / ((a.p.k - x + 1) * (a.p.d - x + 1))"
    rise = "sequence(a.m, least(a.p.hi, a.m + a.r))"
    fall = "sequence(a.m, greatest(a.p.lo, a.m - a.r), -1)"
    zero = "named_struct('w', 1D, 't', 0D)"

    def mass(walk: str, ratio: str) -> str:
        return (f"aggregate({walk}, {zero}, (z, x) -> named_struct('w', z.w * {ratio}, 't', z.t + z.w),"
                " z -> z.t)")

    def pick(walk: str, ratio: str, goal: str) -> str:
        start = "named_struct('w', 1D, 't', 0D, 'x', cast(null as bigint))"
        return (f"aggregate({walk}, {start}, (z, x) -> named_struct('w', z.w * {ratio}, 't', z.t + z.w,"
                f" 'x', coalesce(z.x, if(z.t + z.w > {goal}, x, null))), z -> z.x)")

    return f"""transform(transform(array({bind}), a -> struct(a as a,
        {mass(rise, up)} as up, {mass(fall, down)} - 1 as down)), c -> transform(array(c.a), a ->
        if(c.a.p.u * (c.up + c.down) < c.up,
           coalesce({pick(rise, up, 'c.a.p.u * (c.up + c.down)')}, a.m),
           coalesce({pick(fall, down, '(c.a.p.u * (c.up + c.down) - c.up + 1)')}, a.m)))[0])[0]"""


def shard_quotas(plan: DataFrame, levels: int) -> DataFrame:
    """Leaves of the splitting tree: (shard, s, first, n): the stretch of each source's draws."""
    spark = plan.sparkSession
    root = plan.agg(F.sort_array(F.collect_list(F.struct("s", "quota"))).alias("q")).select(
        F.lit(0).cast("long").alias("node"), F.expr("transform(q, x -> x.quota)").alias("q"),
        F.expr("transform(q, x -> 0L)").alias("first"))
    nodes = root
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for level in range(levels):
        u = f"pmod(xxhash64(node, size(z.l), {level}), 1073741824L) / 1073741824D"
        draw = hypergeometric("z.n", "k", "z.d", u)
        sum_ = "aggregate(q, 0L, (t, k) -> t + k)"
        left = f"""aggregate(q,
            named_struct('n', {sum_}, 'd', {sum_} div 2, 'l', cast(array() as array<bigint>)),
            (z, k) -> transform(array({draw}), x -> named_struct(
                'n', z.n - k, 'd', z.d - x, 'l', concat(z.l, array(x))))[0], z -> z.l)"""
        nodes = nodes.select(F.expr(f"""inline(flatten(transform(array({left}), l -> array(
            struct(node * 2 as node, l as q, first as first),
            struct(node * 2 + 1 as node, zip_with(q, l, (k, x) -> k - x) as q,
                   zip_with(first, l, (f, x) -> f + x) as first)))))"""))
        if level == SPREAD_LEVEL:
            nodes = nodes.repartition(partitions, "node")
    return nodes.select(
        F.col("node").alias("shard"), F.expr("posexplode(arrays_zip(q, first))").alias("s", "x")
    ).select("shard", "s", F.col("x.first").alias("first"), F.col("x.q").alias("n")).where("n > 0")


def place_on_lines(sizes: DataFrame) -> DataFrame:
    """`sizes` with `at`: words of the same source before the row. Prefix sums over hash buckets,
    then within each bucket, so that a large source is not one group."""
    bucketed = sizes.withColumn("bucket", F.substring("key", 1, 3))
    sums = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = sums.select(
        F.col("source").alias("base_source"), F.col("bucket").alias("base_bucket"),
        (F.sum("in_bucket").over(before) - F.col("in_bucket")).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inside = bucketed.withColumn("inside", F.sum("size").over(within) - F.col("size"))
    return inside.join(
        base, (F.col("bucket") == F.col("base_bucket")) & F.col("source").eqNullSafe(F.col("base_source")),
    ).withColumn("at", F.col("base") + F.col("inside")).drop(
        "base_source", "base_bucket", "base", "inside", "bucket")


def draw_blocks(sizes: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row per document and drawn block, and one with nulls for a document that gives nothing.

    `sizes` has doc_id, source, size and key (the order). Adds source_size, target, at, s, draw
    (its number among the source's draws), from_word, to_word (words of the document), shard, place.
    """
    plan = stage(source_plan(sizes))
    words = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    levels = ceil(log2(max(1.0, words / shard_words)))
    leaves = stage(shard_quotas(plan, levels))
    known = plan.withColumnRenamed("source", "plan_source")
    lines = place_on_lines(sizes).join(
        known, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    stride = F.when(F.col("blocks") % STRIDES[0] != 0, F.lit(STRIDES[0])).otherwise(F.lit(STRIDES[1]))
    blocks = lines.withColumn("b", F.explode_outer(F.when(
        F.col("size") > 0, F.expr("sequence(at div block, (at + size - 1) div block)"))))
    position = F.expr("pmod(stride * b + s, blocks)")
    drawn = (
        blocks.withColumn("stride", stride.cast("long")).withColumn("p", position)
        .withColumn("draw", F.explode_outer(F.expr(
            "filter(array(p, p + blocks), x -> x < quota)")))
        .withColumn("from_word", F.when(F.col("draw").isNotNull(), F.expr("greatest(b * block - at, 0L)")))
        .withColumn("to_word", F.when(F.col("draw").isNotNull(), F.expr("least((b + 1) * block - at, size)")))
    )
    cell = f"greatest(1L, quota div {2 ** levels})"
    drawn = drawn.withColumn("cell", F.expr(f"draw div {cell}"))
    owners = leaves.join(plan.select("s", "quota"), "s").select(
        F.col("s").alias("leaf_s"), "first", "n", "shard",
        F.explode(F.expr(f"sequence(first div {cell}, (first + n - 1) div {cell})")).alias("leaf_cell"))
    found = drawn.join(
        owners, (F.col("s") == F.col("leaf_s")) & (F.col("cell") == F.col("leaf_cell"))
        & (F.col("draw") >= F.col("first")) & (F.col("draw") < F.col("first") + F.col("n")), "left")
    place = F.xxhash64("shard", "s", "draw", "at")
    return found.withColumn("place", F.when(F.col("shard").isNotNull(), place)).drop(
        "b", "p", "stride", "cell", "leaf_s", "leaf_cell", "first", "n", "block", "blocks", "quota")


def taken_words(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row."""
    sizes = stage(docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), order_key(F.col("doc_id")).alias("key")))
    rows = draw_blocks(sizes, shard_words)
    keys = ["doc_id", "size", "source_size", "target"]
    some = rows.where("size > 0").groupBy("s", "at", *keys).agg(
        F.coalesce(F.sum(F.col("to_word") - F.col("from_word")), F.lit(0)).cast("long").alias("taken"))
    none = rows.where("size = 0").select(*keys, F.lit(0).cast("long").alias("taken"))
    return some.select(*keys, "taken").union(none)


def mixed_rows(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The mix as rows of `docs`: one row per document and round in which it gives words.

    A document drawn whole keeps its text; of one drawn in part the drawn words remain, joined by
    single spaces.
    """
    row, plan = free_name(docs, "row"), free_name(docs, "parts")
    kept = stage(docs.withColumn(row, F.monotonically_increasing_id()))
    sizes = stage(kept.select(
        F.col(row).alias("mix_row"), "doc_id", "source", word_count(F.col("text")).alias("size"),
        order_key(F.col("doc_id")).alias("key")))
    source = source_plan(sizes).select(F.col("s").alias("own_s"), "blocks")
    drawn = draw_blocks(sizes, shard_words).where("shard is not null").join(
        source, F.col("s") == F.col("own_s"))
    parts = drawn.groupBy("mix_row", F.expr("draw div blocks").alias("round"), "size").agg(
        F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias(plan),
        F.sum(F.col("to_word") - F.col("from_word")).alias("got"))
    words = F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0))
    cut = F.array_join(F.flatten(F.transform(F.array(words), lambda w: F.flatten(F.transform(
        F.col(plan), lambda p: F.slice(
            w, p["from_word"].cast("int") + 1, (p["to_word"] - p["from_word"]).cast("int")))))), " ")
    chosen = parts.select(
        F.col("mix_row").alias(row), F.when(F.col("got") < F.col("size"), F.col(plan)).alias(plan))
    joined = kept.join(chosen, row)
    text = F.when(F.col(plan).isNull(), F.col("text")).otherwise(cut)
    return joined.select(*[
        (text.alias(c) if c.lower() == "text" else F.col(f"`{c}`")) for c in docs.columns])


TAKEN_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|mix') AS key,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
p0 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS s
  FROM d GROUP BY source),
p1 AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         CASE s % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p0),
p2 AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - sum(cap) OVER w + cap)
            / (sum(weight) OVER () - sum(weight) OVER w + weight) AS level
  FROM p1 WINDOW w AS (ORDER BY cap / weight, s ROWS UNBOUNDED PRECEDING)),
p3 AS (
  SELECT *, least(cap, max(level) OVER () * weight) AS target,
         CAST(greatest(1, least({BLOCK_WORDS}, source_size // {LEAST_BLOCKS})) AS BIGINT) AS block FROM p2),
p AS (
  SELECT *, (source_size + block - 1) // block AS blocks,
         CASE WHEN source_size > 0
              THEN CAST(round(target / source_size * ((source_size + block - 1) // block)) AS BIGINT)
              ELSE 0 END AS quota FROM p3),
x AS (
  SELECT d.doc_id, d.size, CAST(p.source_size AS BIGINT) AS source_size, p.target, p.s, p.block,
         p.blocks, p.quota, row_number() OVER () AS r,
         CAST(sum(d.size) OVER (PARTITION BY p.s ORDER BY d.key, d.doc_id, d.size
                                ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS pos
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
b AS (SELECT *, unnest(range(pos // block, (pos + size - 1) // block + 1)) AS b FROM x WHERE size > 0),
t AS (
  SELECT r, sum((least((b + 1) * block - pos, size) - greatest(b * block - pos, 0))
           * ((CASE WHEN q < quota THEN 1 ELSE 0 END) + (CASE WHEN q + blocks < quota THEN 1 ELSE 0 END)))
         AS taken
  FROM (SELECT *, (CASE WHEN blocks % {STRIDES[0]} <> 0 THEN {STRIDES[0]} ELSE {STRIDES[1]} END * b + s)
               % blocks AS q FROM b) GROUP BY r)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken
FROM x LEFT JOIN t USING (r)
"""
