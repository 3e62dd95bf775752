"""Queries for the composite jobs (J1 to J13) and the flagship report."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.growing import FEATURES as GROWN
from flowkit.catalog.growing import _generator
from flowkit.catalog.registry import query
from flowkit.catalog.sampling import balance_sql
from flowkit.catalog.scoring import (
    NUMBERS, PERT_TAGS, VALUES, VOTED_PAIRS, ensemble_inputs, ensemble_sql,
)
from flowkit.catalog.standins import (
    ATTACKS, CLASSES, DIRTY_SPEC, FEATURES, FLOW_HASH, FLOW_SPEC, FLOWS, IDS, K, MERGED, SKEWED, VECTORS,
    TYPED, TYPED_BAD, TYPED_NEGATIVE, VOTERS, dirty, flows, skewed, sources,
    sql_hash, table, vectors,
)
from flowkit.catalog.training import PARAMETER_FILES, PATIENCE, PORTS, noisy_rows
from flowkit.operators import clean, dedup, encode, report, sample, train
from flowkit.plans import jobs
from flowkit.spec import DatasetSpec
from flowkit.staging import shared_folder, stage

ID_LIST = ", ".join(IDS)
CLEAN = f"""clean AS (SELECT DISTINCT port, flag, value, spare, "Label" FROM typed
  WHERE NOT {TYPED_BAD} AND "Label" <> 'Label' AND NOT ({TYPED_NEGATIVE}))"""


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


SPLIT_SPEC = DatasetSpec(
    name="flows", features=("port", "flag", "quantity", "price", "discount", "tax"),
    cat=("port",), binary=("flag",),
)


@query("clean_split_report", f"""WITH {FLOWS}, u AS (
  SELECT DISTINCT port, flag, quantity::FLOAT, price::FLOAT, discount::FLOAT, tax::FLOAT, "Label" FROM flows),
c AS (SELECT "Label", count(*) AS n FROM u GROUP BY "Label" HAVING count(*) >= 2),
s AS (SELECT "Label", CAST(ceil(n * 0.3::DOUBLE) AS BIGINT) AS test, n FROM c)
SELECT coalesce("Label", 'all') AS "Label", sum(test)::BIGINT AS test, sum(n - test)::BIGINT AS train, sum(n)::BIGINT AS total
FROM s GROUP BY GROUPING SETS (("Label"), ())""")
def clean_split_report(spark: SparkSession, d: str) -> DataFrame:
    """Select, coerce, clean, de-duplicate, split 70/30 per label, label x subset counts."""
    rows = stage(dedup.dedup(clean.clean_rows(flows(spark, d), SPLIT_SPEC)))
    parts = sample.split_by_label(clean.with_row_key(rows, rows.columns), ["_key_"])
    return report.crosstab(parts, "Label", "subset", ["test", "train"])


CLEAN_OUT = """SELECT port, flag, round(value::DOUBLE, 4) + 0.0 AS value, round(spare::DOUBLE, 4) AS spare, "Label" FROM clean"""


def _clean_out(rows: DataFrame) -> DataFrame:
    return rows.select(
        "port", "flag", (F.round(F.col("value").cast("double"), 4) + 0.0).alias("value"),
        F.round(F.col("spare").cast("double"), 4).alias("spare"), "Label",
    )


@query("j1_clean_flows", f"WITH {TYPED}, {CLEAN} {CLEAN_OUT}")
def j1(spark: SparkSession, d: str) -> DataFrame:
    """From CSV files of two header kinds to distinct clean rows, written by label."""
    folder = _folder(spark, "raw")
    rows = dirty(spark, d)
    rows.where("event_id % 4 > 0").repartition(3).write.csv(folder, header=True)
    rows.where("event_id % 4 = 0").select(F.lit("x").alias("Src IP"), "*").coalesce(1).write.mode(
        "append"
    ).csv(folder, header=True)
    return _clean_out(jobs.clean_flows(spark, folder, DIRTY_SPEC, _folder(spark, "clean")).rows)


@query("j1_cleaning_report", f"""WITH {TYPED}, fates AS (
  SELECT *, CASE WHEN "Label" = 'Label' THEN 'header' WHEN {TYPED_BAD} THEN 'bad' WHEN {TYPED_NEGATIVE} THEN 'negative' ELSE 'kept' END AS fate FROM typed)
SELECT count(*) AS rows_read, count_if(fate = 'bad')::BIGINT AS bad_rows, count_if(fate = 'negative')::BIGINT AS negative_rows,
  count_if(fate = 'header')::BIGINT AS header_rows FROM fates""")
def j1_report(spark: SparkSession, d: str) -> DataFrame:
    """The report of the job that writes by label: input rows and what was dropped, from the one scan."""
    done = jobs.clean_table(dirty(spark, d), DIRTY_SPEC, _folder(spark, "clean"))
    return done.report.select("rows_read", "bad_rows", "negative_rows", "header_rows")


@query("j1_clean_table", f"WITH {TYPED}, {CLEAN} {CLEAN_OUT}")
def j1_table(spark: SparkSession, d: str) -> DataFrame:
    return _clean_out(jobs.clean_table(dirty(spark, d), DIRTY_SPEC).rows)


TEXT_SPEC = DatasetSpec(
    name="orders", features=("priority", "urgent", "customer", "month"),
    cat=("priority",), binary=("urgent",), onehot=("priority",),
    raw_columns=("customer", "priority", "urgent", "month", "attack"),
    label_map={"DoS": ("F", "smurf"), "Probe": ("P",)},
    majority=("Benign", "DoS"), minority=("Probe",), require_all_features=True, has_quantile=False,
)


@query("j2_clean_headerless", """WITH r AS (SELECT DISTINCT o_custkey, o_orderpriority, o_orderpriority LIKE '1%' AS u,
  month(o_orderdate) AS m, CASE o_orderstatus WHEN 'F' THEN 'DoS' WHEN 'P' THEN 'Probe' ELSE 'Benign' END AS l FROM orders),
c AS (SELECT l AS "Label", count(*) AS n, CAST(ceil(count(*) * 0.3::DOUBLE) AS BIGINT) AS test FROM r GROUP BY l)
SELECT "Label", test, n - test AS train, (SELECT count(DISTINCT o_orderpriority) FROM r) AS priorities FROM c""")
def j2(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "text")
    p = F.col("o_orderpriority")
    table(spark, d, "orders").select(
        "o_custkey", p, p.startswith("1").cast("int"), F.month("o_orderdate"), "o_orderstatus"
    ).write.csv(path, header=False)
    parts, cards, enc = jobs.clean_headerless(spark, path, TEXT_SPEC)
    sides = parts.groupBy("Label").agg(
        F.count_if(F.col("subset") == "test").alias("test"),
        F.count_if(F.col("subset") == "train").alias("train"),
    )
    return sides.withColumn(
        "priorities", cards.where(F.col("column") == "priority").select("cardinality").scalar()
    )


@query("j3_split", f"""WITH {SKEWED}, c AS (SELECT "Label", count(*) AS total FROM skewed GROUP BY "Label")
SELECT "Label", total, CASE WHEN total < 2 THEN 0 ELSE CAST(ceil(total * 0.3::DOUBLE) AS BIGINT) END AS test,
  CASE WHEN total < 2 THEN 0 ELSE total - CAST(ceil(total * 0.3::DOUBLE) AS BIGINT) END AS train FROM c""")
def j3(spark: SparkSession, d: str) -> DataFrame:
    rows, out = skewed(spark, d), _folder(spark, "split")
    jobs.split(rows, ["event_id"], out=out)
    return jobs.split_report(rows, spark.read.parquet(out))


@query("j4_encode", f"""WITH {FLOWS}, fit AS (SELECT avg(price) AS pm, stddev_pop(price) AS ps FROM flows),
lc AS (SELECT "Label" AS l, CAST(row_number() OVER (ORDER BY "Label") - 1 AS INTEGER) AS code FROM (SELECT DISTINCT "Label" FROM flows))
SELECT {ID_LIST}, round((price - pm) / ps, 6) + 0.0 AS price, code AS "Label", 'train' AS __subset__
FROM flows JOIN lc ON "Label" = l, fit WHERE "Label" IN ('AF', 'NF', 'NO')""")
def j4(spark: SparkSession, d: str) -> DataFrame:
    rows, out = flows(spark, d), _folder(spark, "encoded")
    keyed = rows.withColumn("__rowid__", F.xxhash64(*IDS))
    enc = encode.fit_encoders(rows, FLOW_SPEC)
    jobs.encode_labels(keyed, enc, FLOW_SPEC, "standard", exclude=["AO"], out=out)
    return spark.read.parquet(out).select(
        *IDS, (F.round("price", 6) + 0.0).alias("price"), "Label", "__subset__"
    )


@query("j5_compress")
def j5(spark: SparkSession, d: str) -> DataFrame:
    """Every majority label to the budget; rows per label are the budget."""
    spec = DatasetSpec(name="vectors", features=("features",), majority=("a", "b"))
    rows = vectors(spark, d).drop("cluster")
    return jobs.compress_majority(rows, 50, ["vec_id"], spec).select("vec_id", "Label")


@query("j5_rows_per_label", f"""WITH {VECTORS}
SELECT "Label", least(count(*), 50)::BIGINT AS rows FROM vectors WHERE "Label" IN ('a', 'b') GROUP BY "Label" """)
def j5_rows(spark: SparkSession, d: str) -> DataFrame:
    spec = DatasetSpec(name="vectors", features=("features",), majority=("a", "b"))
    kept = jobs.compress_majority(vectors(spark, d).drop("cluster"), 50, ["vec_id"], spec)
    return kept.groupBy("Label").agg(F.countDistinct("vec_id").alias("rows"))


@query("j6_augment", f"""WITH {FLOWS}, o AS (SELECT count(DISTINCT (quantity, price)) AS o FROM flows WHERE "Label" = 'RF'),
n AS (SELECT count(*) AS n FROM flows WHERE "Label" = 'RF')
SELECT 'RF' AS "Label", o + 500 AS rows FROM o, n""")
def j6(spark: SparkSession, d: str) -> DataFrame:
    """A small label grows by exactly the admitted rows."""
    everything = flows(spark, d).select(*IDS, *GROWN, "Label")
    rows = everything.where("Label = 'RF'")
    grown = jobs.augment_label(
        everything.select(*GROWN, "Label"), everything.where("Label = 'AF'").select(*GROWN, "Label"),
        "RF", rows.count() + 500, _generator(rows), GROWN, ["gen_id"], FLOW_SPEC,
    )
    return grown.groupBy("Label").agg(F.count("*").alias("rows"))


@query("j7_merge", f"""WITH {FLOWS}, u AS (
  SELECT DISTINCT {ID_LIST}, CASE WHEN "Label" LIKE 'R%' THEN 'minor:' || "Label" || ':wgan' ELSE 'major:' || "Label" END AS __source__ FROM flows)
SELECT {ID_LIST}, __source__, row_number() OVER (ORDER BY {FLOW_HASH}) AS position FROM u""")
def j7(spark: SparkSession, d: str) -> DataFrame:
    rows, out = flows(spark, d).select(*IDS, "Label"), _folder(spark, "merged")
    part = lambda x: rows.where(F.col("Label") == x)
    jobs.merge(
        [(x, part(x)) for x in FLOW_SPEC.majority],
        [(x, "wgan", part(x)) for x in FLOW_SPEC.minority], IDS, out,
    )
    return spark.read.parquet(out).drop("Label")


VALIDATION = f"n AS (SELECT count(*) AS rows FROM flows WHERE {sql_hash(7, IDS)} >= 'cc')"


@query("j8_train_evaluate", f"""WITH {FLOWS}, {VALIDATION}
SELECT rows, 9::BIGINT AS cells, true AS learned FROM n""")
def j8(spark: SparkSession, d: str) -> DataFrame:
    """The confusion matrix of a forest by its published parameters: its total, its cells, and whether
    its diagonal beats the largest class by a tenth of the rows."""
    rows, val = noisy_rows(spark, d)
    model = train.train("bagging", rows, 3, train.load_params(PARAMETER_FILES["bagging"], "bagging"))
    cells = jobs.evaluate(model, val, [0, 1, 2])[1]
    truth, pred = cells.columns[:2]
    right = F.sum(F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0))
    by_class = cells.groupBy(truth).agg(F.sum("n").alias("n"), F.count("*").alias("cells"), right.alias("right"))
    return by_class.agg(F.sum("n").alias("rows"), F.sum("cells").alias("cells"),
                        (F.sum("right") > F.max("n") + 0.1 * F.sum("n")).alias("learned"))


@query("j9_ensemble", f"""WITH {FLOWS}, {VALIDATION} SELECT rows, true AS learned FROM n""")
def j9(spark: SparkSession, d: str) -> DataFrame:
    """Vote of three kinds by their published parameters; one vote per validation row."""
    rows, val = noisy_rows(spark, d)
    more = {"bagging": {}, "gbm": {"patience": PATIENCE}, "dnn": {"categories": {4: PORTS}}}
    models = [train.train(k, rows, 3, {**train.load_params(PARAMETER_FILES[k], k), **p}, val=val) for k, p in more.items()]
    voted = jobs.ensemble(models, val, 3, IDS, prefer="gbm").join(val.select(*IDS, "y"), IDS)
    right = F.avg((F.col("pred") == F.col("y")).cast("int"))
    return voted.agg(F.count("*").alias("rows"), (right > 0.6).alias("learned"))


PLAIN = """plain AS (SELECT DISTINCT f1, f2 FROM sources WHERE __attack__ = 'view' AND "Label" = 'c0')"""


@query("j10_merge_perturbed", f"""WITH {MERGED.replace('FROM sources GROUP', 'FROM (SELECT * FROM sources) GROUP')}, {PLAIN}
SELECT f1, f2, "Label", __attack__ FROM merged m
WHERE NOT EXISTS (SELECT 1 FROM plain p WHERE p.f1 = m.f1 AND p.f2 = m.f2)""")
def j10(spark: SparkSession, d: str) -> DataFrame:
    rows = sources(spark, d)
    plain = rows.where("__attack__ = 'view' AND Label = 'c0'")
    return jobs.merge_perturbed(rows, plain, FEATURES, ["event_id"], ATTACKS, CLASSES).rows


@query("j11_balance_perturbed", balance_sql(150))
def j11(spark: SparkSession, d: str) -> DataFrame:
    merged = dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"])
    return jobs.balance_perturbed(merged, 150, FEATURES, FEATURES)


@query("j12_distribution_report", f"""WITH {MERGED}, x AS (
  SELECT "Label", unnest(string_split(__attack__, '|')) AS a FROM merged)
SELECT coalesce(a, 'all') AS __attack__, {', '.join(f"count_if(\"Label\" = '{c}')::BIGINT AS {c}" for c in CLASSES)},
  count(*) AS total FROM x WHERE a IN ('click', 'view') GROUP BY GROUPING SETS ((a), ())""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    merged = dedup.merge_sources(sources(spark, d), FEATURES, ["event_id"])
    return jobs.distribution_report(merged, ["click", "view"], labels=CLASSES)


KEPT = [m for m in VOTERS if m != "gbm"]


def _best(t: str) -> str:
    p = [f"{t}.p{c}" for c in range(K)]
    tops = " ".join(f"WHEN {x} THEN {c}" for c, x in enumerate(p))
    return f"CAST(CASE greatest({', '.join(p)}) {tops} END AS INTEGER)"


SINGLE_PAIRS = " UNION ALL ".join(
    f"""SELECT a.model, '{attack}', CAST(o_custkey % {K} AS INTEGER), {_best('a')}, {_best('b')}
  FROM orders JOIN probs a ON a.sample_id = o_orderkey
    JOIN probs_{t} b ON b.sample_id = a.sample_id AND b.model = a.model WHERE a.model <> 'gbm'"""
    for attack, t in PERT_TAGS.items()
)


@query("j13_robustness_report", f"WITH {ensemble_sql(f'{VOTED_PAIRS} UNION ALL {SINGLE_PAIRS}')} SELECT model, attack, {NUMBERS} FROM robust")
def j13(spark: SparkSession, d: str) -> DataFrame:
    plain, pert, truth = ensemble_inputs(spark, d)
    return jobs.robustness_report(plain, pert, truth, K, KEPT).select(
        "model", "attack", *[F.round(v, 6).alias(v) for v in VALUES]
    )
