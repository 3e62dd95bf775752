"""Queries for encoders and model input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.catalog.registry import query
from flowkit.catalog.standins import (
    DIRTY, FLOW_SPEC, FLOWS, IDS, REPEATED, _NUM, dirty, flows, repeated, sql_hash, table,
)
from flowkit.functions import sanitize_port
from flowkit.operators import encode
from flowkit.spec import DatasetSpec

ID_LIST = ", ".join(IDS)
NUMERIC = ["quantity", "price", "discount", "tax"]
STATS = ", ".join(
    f"min({c}) AS {c}_lo, max({c}) AS {c}_hi, avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std"
    for c in ["port", *NUMERIC]
)
FITTED = f"{FLOWS}, fit AS (SELECT {STATS} FROM flows)"
LABELS = """labels_code AS (SELECT "Label" AS l, CAST(row_number() OVER (ORDER BY "Label") - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT "Label" FROM flows))"""


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> list:
    return [(F.round(F.col(n), digits) + 0.0).alias(n) for n in names]


def _sql_std(c: str, digits: int = 6) -> str:
    return f"round(({c} - {c}_mean) / {c}_std, {digits}) + 0.0 AS {c}"


def _sql_minmax(c: str) -> str:
    return f"round(({c} - {c}_lo) / ({c}_hi - {c}_lo), 6) + 0.0 AS {c}"


@query("e1_fit_encoders", f"""WITH {FLOWS}, t AS (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(42, IDS)}) AS rn,
         count(*) OVER (PARTITION BY "Label") AS n FROM flows),
flows2 AS (SELECT * FROM t WHERE rn > ceil(n * 0.3::DOUBLE)) """ + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", min({c})::DOUBLE + 0.0 AS min, max({c})::DOUBLE AS max,
    round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS std FROM flows2""" for c in ["port", *NUMERIC]
))
def e1(spark: SparkSession, d: str) -> DataFrame:
    """Fitted on the train part of a split only."""
    from flowkit.operators.sample import split_by_label

    train = split_by_label(flows(spark, d), IDS).where("subset = 'train'")
    return encode.fit_encoders(train, FLOW_SPEC).numeric.select(
        "column", (F.col("min") + 0.0).alias("min"), "max", *_rounded(train, "mean", "std", digits=4)
    )


@query("e2_minmax", f"WITH {FITTED} SELECT {ID_LIST}, {', '.join(map(_sql_minmax, NUMERIC))} FROM flows, fit")
def e2(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    return encode.minmax(rows, encode.fit_numeric(rows, NUMERIC)).select(*IDS, *_rounded(rows, *NUMERIC))


@query("e2_minmax_inverse", f"WITH {FLOWS} SELECT {ID_LIST}, "
       + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NUMERIC) + " FROM flows")
def e2_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_numeric(rows, NUMERIC)
    back = encode.minmax(encode.minmax(rows, params), params, inverse=True)
    return back.select(*IDS, *_rounded(rows, *NUMERIC))


@query("e3_standardize", f"""WITH {FITTED}
SELECT {ID_LIST}, port, {', '.join(map(_sql_std, NUMERIC))} FROM flows, fit""")
def e3(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_numeric(rows, ["port", *NUMERIC])
    return encode.standardize(rows, params, keep_raw=["port"]).select(
        *IDS, "port", *_rounded(rows, *NUMERIC)
    )


@query("e3_standardize_inverse", f"WITH {FLOWS} SELECT {ID_LIST}, "
       + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in NUMERIC) + " FROM flows")
def e3_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_numeric(rows, NUMERIC)
    back = encode.standardize(encode.standardize(rows, params), params, inverse=True)
    return back.select(*IDS, *_rounded(rows, *NUMERIC))


N_QUANTILES = 101
GRID = "[" + ", ".join(f"{i / (N_QUANTILES - 1)!r}" for i in range(N_QUANTILES)) + "]"


def _uniform_sql(c: str) -> str:
    """Position in the fitted quantiles: the step's middle on a hit, else linear in between."""
    step = float(N_QUANTILES - 1)
    below, upto = f"len(list_filter(q_{c}, lambda e: e < {c}))", f"len(list_filter(q_{c}, lambda e: e <= {c}))"
    return f"""round(CASE WHEN {c} <= q_{c}[1] THEN 0.0::DOUBLE WHEN {c} >= q_{c}[{N_QUANTILES}] THEN 1.0::DOUBLE
      WHEN {below} < {upto} THEN ({below} + {upto} - 1) / 2.0::DOUBLE / {step}
      ELSE ({upto} - 1 + ({c} - q_{c}[{upto}]) / (q_{c}[{upto} + 1] - q_{c}[{upto}])) / {step} END, 6) AS {c}"""


@query("e4_quantile_uniform", f"""WITH {FLOWS}, fit AS (
  SELECT quantile_cont(price, {GRID}::DOUBLE[]) AS q_price, quantile_cont(quantity, {GRID}::DOUBLE[]) AS q_quantity
  FROM flows)
SELECT {ID_LIST}, {_uniform_sql('price')}, {_uniform_sql('quantity')} FROM flows, fit""")
def e4(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_quantiles(rows, ["price", "quantity"], IDS, N_QUANTILES)
    return encode.quantile_uniform(rows, params).select(*IDS, *_rounded(rows, "price", "quantity"))


@query("e4_quantile_uniform_inverse", f"""WITH {FLOWS}, fit AS (
  SELECT quantile_cont(price, {GRID}::DOUBLE[]) AS q FROM flows)
SELECT {ID_LIST}, round(greatest(q[1], least(q[{N_QUANTILES}], price)), 4) AS price FROM flows, fit""")
def e4_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_quantiles(rows, ["price"], IDS, N_QUANTILES)
    back = encode.quantile_uniform(encode.quantile_uniform(rows, params), params, inverse=True)
    return back.select(*IDS, *_rounded(rows, "price", digits=4))


@query("e5_quantile_normal")
def e5(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_quantiles(rows, ["price", "quantity"], IDS)
    return encode.quantile_normal(rows, params).select(*IDS, "price", "quantity")


@query("e5_quantile_normal_inverse", f"""WITH {FLOWS}, fit AS (
  SELECT min(price) AS lo, max(price) AS hi FROM flows)
SELECT {ID_LIST}, round(greatest(lo, least(hi, price)), 2) AS price FROM flows, fit""")
def e5_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    params = encode.fit_quantiles(rows, ["price"], IDS)
    back = encode.quantile_normal(encode.quantile_normal(rows, params), params, inverse=True)
    return back.select(*IDS, *_rounded(rows, "price", digits=2))


PART_CATS = ["p_type", "p_brand"]


@query("e6_onehot", """SELECT p_partkey, p_size, """ + ", ".join(
    f"(p_type = '{v}')::INT::DOUBLE AS \"p_type_{v}\""
    for v in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
) + " FROM part")
def e6(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_type", "p_size")
    return encode.onehot(rows, encode.fit_categories(rows, ["p_type"]))


@query("e6_onehot_inverse", """SELECT p_partkey, p_type,
  CASE WHEN p_brand = 'Brand#7' THEN '?' ELSE p_brand END AS p_brand FROM part""")
def e6_inverse(spark: SparkSession, d: str) -> DataFrame:
    """One brand is unknown to the encoder and comes back as missing."""
    rows = table(spark, d, "part").select("p_partkey", *PART_CATS)
    cats = encode.fit_categories(rows.where("p_brand <> 'Brand#7'"), PART_CATS)
    return encode.onehot_inverse(encode.onehot(rows, cats), cats).na.fill("?", ["p_brand"])


BRANDS = """brands AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT p_brand FROM part WHERE p_size > 3))"""


@query("e7_ordinal", f"""WITH {BRANDS}
SELECT p_partkey, coalesce(code, -1) AS p_brand FROM part p LEFT JOIN brands b ON p.p_brand = b.p_brand""")
def e7(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    cats = encode.fit_categories(rows.where("p_size > 3"), ["p_brand"])
    return encode.ordinal(rows, cats, ["p_brand"], unknown=-1).drop("p_size")


@query("e7_ordinal_inverse", "SELECT p_partkey, p_brand, p_type FROM part")
def e7_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", *PART_CATS)
    cats = encode.fit_categories(rows, PART_CATS)
    return encode.ordinal(encode.ordinal(rows, cats, PART_CATS), cats, PART_CATS, inverse=True)


@query("e7_ordinal_port", f"""WITH {FLOWS}
SELECT {ID_LIST}, CASE WHEN port BETWEEN 1 AND 65535 THEN port - 1 ELSE -1 END AS port FROM flows""")
def e7_port(spark: SparkSession, d: str) -> DataFrame:
    return encode.ordinal_port(flows(spark, d), "port").select(*IDS, "port")


@query("e8_sanitize_port", f"""WITH {DIRTY}, n AS (SELECT event_id, {_NUM.format('port')} AS x FROM dirty)
SELECT event_id, CASE WHEN x IS NULL THEN 1
  ELSE CAST(greatest(1, least(65535, round_even(x, 0))) AS INTEGER) END AS port FROM n""")
def e8(spark: SparkSession, d: str) -> DataFrame:
    return dirty(spark, d).select("event_id", sanitize_port(F.col("port")).alias("port"))


@query("e9_binary", f"""WITH {FLOWS}
SELECT {ID_LIST}, flag, CAST(discount > 0.5 AS INTEGER) AS discount, CAST(quantity > 0.5 AS INTEGER) AS quantity
FROM flows""")
def e9(spark: SparkSession, d: str) -> DataFrame:
    rows = encode.binary(flows(spark, d), ["flag"])
    return encode.binary(rows, ["discount", "quantity"], inverse=True).select(
        *IDS, "flag", "discount", "quantity"
    )


@query("e10_label_encode", f"""WITH {FLOWS}, {LABELS}
SELECT {ID_LIST}, code AS "Label" FROM flows JOIN labels_code ON "Label" = l""")
def e10(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select(*IDS, "Label")
    return encode.label_encode(rows, encode.fit_labels(rows))


@query("e10_label_decode", f"""WITH {FLOWS} SELECT {ID_LIST}, "Label" FROM flows""")
def e10_inverse(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d).select(*IDS, "Label")
    labels = encode.fit_labels(rows)
    return encode.label_encode(encode.label_encode(rows, labels), labels, inverse=True)


@query("e11_inverse_transform", f"""WITH {FLOWS}
SELECT CAST(greatest(1, port) AS INTEGER) AS port, flag, round(quantity, 6) AS quantity, round(price, 6) AS price,
  round(discount, 6) + 0.0 AS discount, round(tax, 6) + 0.0 AS tax, "Label" FROM flows""")
def e11(spark: SparkSession, d: str) -> DataFrame:
    """Min-max encoded rows decoded again."""
    rows = flows(spark, d)
    enc = encode.fit_encoders(rows, FLOW_SPEC)
    encoded = encode.encode_minority(rows, enc, FLOW_SPEC, "minmax")
    return encode.inverse_transform(encoded, enc, FLOW_SPEC, "minmax").select(
        "port", "flag", *_rounded(rows, *NUMERIC), "Label"
    )


@query("e12_clean_decoded", """SELECT c_custkey, CASE WHEN abs(x) < 1e-9 OR x < 0 THEN 0.0::DOUBLE
  ELSE round(round_even(x * 1e8::DOUBLE, 0) / 1e8::DOUBLE, 8) END AS x
FROM (SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 1e-12::DOUBLE ELSE c_acctbal / 7.0::DOUBLE END AS x FROM customer)""")
def e12(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("c_custkey") % 10 == 0, 1e-12).otherwise(F.col("c_acctbal") / 7.0)
    rows = table(spark, d, "customer").select("c_custkey", x.alias("x"))
    return encode.clean_decoded(rows, ["x"]).withColumn("x", F.round("x", 8))


SMALL_SPEC = DatasetSpec(
    name="small", features=("quantity", "discount", "tax"), cat=(), binary=("tax",),
)


@query("e13_encode_majority", f"""WITH {REPEATED}, fit AS (
  SELECT avg(quantity) AS qm, stddev_pop(quantity) AS qs, avg(discount) AS dm, stddev_pop(discount) AS ds FROM repeated),
lc AS (SELECT "Label" AS l, CAST(row_number() OVER (ORDER BY "Label") - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT "Label" FROM repeated)),
g AS (SELECT quantity, discount, tax, "Label", min(__rowid__) AS __rowid__ FROM repeated GROUP BY ALL)
SELECT round((quantity - qm) / qs, 6) AS quantity, round((discount - dm) / ds, 6) AS discount, tax, code AS "Label",
  __rowid__, 'train' AS __subset__ FROM g JOIN lc ON "Label" = l, fit""")
def e13(spark: SparkSession, d: str) -> DataFrame:
    rows = repeated(spark, d)
    enc = encode.fit_encoders(rows, SMALL_SPEC)
    return encode.encode_majority(rows, enc, SMALL_SPEC).select(
        *_rounded(rows, "quantity", "discount"), "tax", "Label", "__rowid__", "__subset__"
    )


@query("e14_encode_minority", f"""WITH {FITTED}, {LABELS}
SELECT {ID_LIST}, flag, {', '.join(map(_sql_minmax, ['port', *NUMERIC]))}, code AS "Label"
FROM flows JOIN labels_code ON "Label" = l, fit""")
def e14(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    enc = encode.fit_encoders(rows, FLOW_SPEC)
    return encode.encode_minority(rows, enc, FLOW_SPEC, "minmax").select(
        *IDS, "flag", *_rounded(rows, "port", *NUMERIC), "Label"
    )


@query("e14_encode_minority_quantile")
def e14_quantile(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    enc = encode.fit_encoders(rows, FLOW_SPEC, IDS)
    return encode.encode_minority(rows, enc, FLOW_SPEC, "quantile_uniform")


PREP_SPEC = DatasetSpec(
    name="prep", features=("tax", "quantity", "discount"), binary=("tax",),
)
PREP_IDS = ["tax", "quantity", "discount", "Label"]
PREP_COLS = ["tax", "quantity", "discount", '"Label"']


@query("e15_prepare_training", f"""WITH {REPEATED}, lc AS (
  SELECT "Label" AS l, CAST(row_number() OVER (ORDER BY "Label") - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT "Label" FROM repeated)),
u AS (SELECT DISTINCT tax, quantity, discount, code AS "Label" FROM repeated JOIN lc ON "Label" = l),
c AS (SELECT "Label", count(*) AS n FROM u GROUP BY "Label"),
t AS (SELECT ceil(sum(n) * 0.1::DOUBLE) AS t, sum(n) AS s FROM c),
b AS (SELECT "Label", n * t / s AS share, floor(n * t / s) AS base, t FROM c, t),
q AS (SELECT "Label", base + CASE WHEN row_number() OVER (ORDER BY round(share - base, 9) DESC, "Label")
        <= t - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {sql_hash(42, PREP_COLS)}) AS rn FROM u),
z AS (SELECT r.*, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END AS subset FROM r JOIN q ON r."Label" = q."Label")
SELECT tax, quantity, discount, "Label", subset,
  (SELECT min(least(tax, quantity, discount))::DOUBLE FROM z WHERE subset = 'train') AS clip_min,
  (SELECT max(greatest(tax, quantity, discount))::DOUBLE FROM z WHERE subset = 'train') AS clip_max,
  (SELECT round(avg(quantity), 4) FROM u) AS quantity_mean,
  (SELECT round(stddev_pop(quantity), 4) FROM u) AS quantity_std FROM z""")
def e15(spark: SparkSession, d: str) -> DataFrame:
    rows = repeated(spark, d)
    prep = encode.prepare_training(rows, encode.fit_encoders(rows, PREP_SPEC), PREP_SPEC, ids=PREP_IDS)
    stat = prep.stats.where("column = 'quantity'")
    return prep.rows.select(
        "*", prep.clip.select("clip_min").scalar().alias("clip_min"),
        prep.clip.select("clip_max").scalar().alias("clip_max"),
        stat.select(F.round("mean", 4)).scalar().alias("quantity_mean"),
        stat.select(F.round("std", 4)).scalar().alias("quantity_std"),
    )


@query("e16_prepare_input", f"""WITH {FLOWS}, {LABELS}
SELECT CAST(greatest(1, port) - 1 AS INTEGER) AS port, flag, quantity, price, discount, tax + 0.0 AS tax, code AS "Label",
  (SELECT min(least(greatest(1, port) - 1, flag, quantity, price, discount, tax))::DOUBLE + 0.0 FROM flows) AS clip_min,
  (SELECT max(greatest(port - 1, flag, quantity, price, discount, tax))::DOUBLE FROM flows) AS clip_max
FROM flows JOIN labels_code ON "Label" = l""")
def e16(spark: SparkSession, d: str) -> DataFrame:
    rows = flows(spark, d)
    prep = encode.prepare_input(rows, encode.fit_encoders(rows, FLOW_SPEC), FLOW_SPEC)
    return prep.rows.withColumn("tax", F.col("tax") + 0.0).select(
        "*", (prep.clip.select("clip_min").scalar() + 0.0).alias("clip_min"),
        prep.clip.select("clip_max").scalar().alias("clip_max"),
    )


@query("e17_squeeze_features", f"""WITH {FLOWS}, c AS (SELECT min(quantity) AS lo, max(quantity) AS hi FROM flows)
SELECT {ID_LIST}, round(round_even((quantity - lo) / (hi - lo) * 15.0::DOUBLE, 0) / 15.0::DOUBLE * (hi - lo) + lo, 6) AS quantity
FROM flows, c""")
def e17(spark: SparkSession, d: str) -> DataFrame:
    from flowkit.operators.report import global_clip

    rows = flows(spark, d)
    out = encode.squeeze_features(rows, ["quantity"], 4, global_clip(rows, ["quantity"]))
    return out.select(*IDS, *_rounded(rows, "quantity"))


@query("e18_input_norm", f"""WITH {FITTED}
SELECT {ID_LIST}, {', '.join(_sql_std(c) for c in NUMERIC)} FROM flows, fit""")
def e18(spark: SparkSession, d: str) -> DataFrame:
    from flowkit.operators.report import continuous_stats

    rows = flows(spark, d)
    return encode.input_norm(rows, continuous_stats(rows, NUMERIC)).select(
        *IDS, *_rounded(rows, *NUMERIC)
    )
