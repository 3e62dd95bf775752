"""Flow-like views of the given tables, each as a Spark plan and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.functions import order_hash
from flowkit.spec import DatasetSpec


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_hash(seed: int | str, ids: list[str], alias: str = "") -> str:
    """SQL text of `order_hash`."""
    dot = f"{alias}." if alias else ""
    return f"md5(concat_ws('|', '{seed}', {', '.join(dot + i for i in ids)}))"


# ---- flows: lineitem, six labels ------------------------------------------------------------

IDS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day"]

FLOW_SPEC = DatasetSpec(
    name="flows",
    features=("port", "flag", "quantity", "price", "discount", "tax"),
    cat=("port",), binary=("flag",), scaled_cat=("port",), port="port", drop=("l_shipdate",),
    majority=("AF", "AO", "NF", "NO"), minority=("RF", "RO"),
    accept_rates={"RF": 0.5},
)


def flows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"),
        (F.col("l_partkey") % 70_000).cast("int").alias("port"),
        (F.col("l_linenumber") % 2).cast("int").alias("flag"),
        F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.concat("l_returnflag", "l_linestatus").alias("Label"),
    )


FLOWS = """flows AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
         strftime(l_shipdate, '%Y-%m-%d') AS day,
         CAST(l_partkey % 70000 AS INTEGER) AS port, CAST(l_linenumber % 2 AS INTEGER) AS flag,
         l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
         l_returnflag || l_linestatus AS "Label"
  FROM lineitem)"""
FLOW_HASH = sql_hash(42, IDS)


# ---- repeated flows: few distinct rows, a row id --------------------------------------------

def repeated(spark: SparkSession, d: str) -> DataFrame:
    return flows(spark, d).select(
        F.col("quantity").cast("int").alias("quantity"),
        F.rint(F.col("discount") * 100).cast("int").alias("discount"),
        F.rint(F.col("tax") * 100).cast("int").alias("tax"), "Label",
        order_hash("row", IDS).alias("__rowid__"),
    )


REPEATED = FLOWS + f""", repeated AS (
  SELECT CAST(quantity AS INTEGER) AS quantity, CAST(round_even(discount * 100, 0) AS INTEGER) AS discount,
         CAST(round_even(tax * 100, 0) AS INTEGER) AS tax, "Label",
         {sql_hash('row', IDS)} AS __rowid__
  FROM flows)"""


# ---- dirty text flows: events with injected bad cells ---------------------------------------

DIRTY_SPEC = DatasetSpec(
    name="dirty", features=("port", "flag", "value", "spare", "absent"),
    cat=("port",), binary=("flag",), port="port", drop=("props",),
)

_DIRTY = """
    event_id,
    CASE CAST(event_id % 11 AS INT) WHEN 0 THEN '70000' WHEN 1 THEN '0' WHEN 2 THEN NULL
         WHEN 3 THEN 'x' WHEN 4 THEN '80.0' WHEN 5 THEN '12.7' WHEN 6 THEN '-7'
         ELSE CAST(user_id AS STRING) END AS port,
    CASE WHEN event_id % 13 = 0 THEN '2.5' ELSE CAST(event_id % 2 AS STRING) END AS flag,
    CASE CAST(event_id % 17 AS INT) WHEN 0 THEN NULL WHEN 1 THEN 'NaN' WHEN 2 THEN 'Infinity'
         WHEN 3 THEN '-Infinity' WHEN 4 THEN 'abc' WHEN 5 THEN '-1' WHEN 6 THEN '12.0'
         WHEN 7 THEN '-0.0' ELSE CONCAT(CAST(event_id % 40 AS STRING), '.5') END AS value,
    CASE WHEN event_id % 3 = 0 THEN '0' ELSE CAST(event_id % 5 AS STRING) END AS spare,
    props,
    CASE CAST(event_id % 23 AS INT) WHEN 0 THEN 'Label' WHEN 1 THEN CONCAT('  ', event_type, ' ')
         WHEN 2 THEN NULL ELSE event_type END AS Label
"""


def dirty(spark: SparkSession, d: str) -> DataFrame:
    fields = _split_fields(_DIRTY)
    return table(spark, d, "events").selectExpr(*fields)


def _split_fields(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


DIRTY = f"dirty AS (SELECT {_DIRTY} FROM events)".replace("STRING", "VARCHAR").replace(
    "AS Label", 'AS "Label"'
)
_NUM = "CASE WHEN isnan(TRY_CAST({0} AS DOUBLE)) THEN NULL ELSE TRY_CAST({0} AS DOUBLE) END"
_INT = (
    "CASE WHEN {n} = round_even({n}, 0) AND abs({n}) < 2147483647 THEN CAST({n} AS INTEGER) END"
)


def _int(c: str) -> str:
    n = f"({_NUM.format(c)})"
    return _INT.format(n=n)


TYPED = DIRTY + f""", typed AS (
  SELECT event_id, {_int('port')} AS port, {_int('flag')} AS flag,
         CAST({_NUM.format('value')} AS FLOAT) AS value,
         CAST({_NUM.format('spare')} AS FLOAT) AS spare, trim("Label") AS "Label"
  FROM dirty)"""
TYPED_BAD = (
    "(port IS NULL OR flag IS NULL OR value IS NULL OR isinf(value) OR spare IS NULL "
    "OR isinf(spare) OR \"Label\" IS NULL)"
)
TYPED_NEGATIVE = "NOT (port >= 0 AND flag >= 0 AND value >= 0 AND spare >= 0)"


# ---- several sources: events as attack rows -------------------------------------------------

ATTACKS = ["click", "error", "purchase", "signup", "view"]
CLASSES = ["c0", "c1", "c2", "c3", "c4"]
FEATURES = ["f1", "f2"]


def sources(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        "event_id", F.col("user_id").alias("f1"),
        F.floor(F.col("value") / 4.0).cast("int").alias("f2"),
        F.concat(F.lit("c"), (F.col("event_id") % 5).cast("string")).alias("Label"),
        F.col("event_type").alias("__attack__"),
    )


SOURCES = """sources AS (
  SELECT event_id, user_id AS f1, CAST(floor(value / 4.0::DOUBLE) AS INTEGER) AS f2,
         'c' || CAST(event_id % 5 AS VARCHAR) AS "Label", event_type AS __attack__
  FROM events)"""
MERGED = SOURCES + """, merged AS (
  SELECT f1, f2, arg_min("Label", event_id) AS "Label",
         string_agg(DISTINCT __attack__, '|' ORDER BY __attack__) AS __attack__
  FROM sources GROUP BY f1, f2)"""


# ---- skewed labels --------------------------------------------------------------------------

def skewed(spark: SparkSession, d: str) -> DataFrame:
    """Events whose types are thinned very unevenly into labels; half of all rows share one."""
    e = F.col("event_id")
    return table(spark, d, "events").select(
        "event_id", "user_id",
        F.when(e % 2 == 0, "bulk").when(e % 10 == 1, "tenth").when(e % 100 == 3, "rare")
        .when(e % 997 == 5, "scarce").otherwise(F.col("event_type")).alias("Label"),
    )


SKEWED = """skewed AS (
  SELECT event_id, user_id,
         CASE WHEN event_id % 2 = 0 THEN 'bulk' WHEN event_id % 10 = 1 THEN 'tenth'
              WHEN event_id % 100 = 3 THEN 'rare' WHEN event_id % 997 = 5 THEN 'scarce'
              ELSE event_type END AS "Label"
  FROM events)"""


# ---- vectors with given clusters ------------------------------------------------------------

DIM = 64


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(
        "vec_id", F.col("label").alias("cluster"),
        F.col("embedding").cast("array<double>").alias("features"),
        F.when(F.col("vec_id") % 3 == 0, "a").otherwise("b").alias("Label"),
    )


VECTORS = """vectors AS (
  SELECT vec_id, label AS cluster, embedding::DOUBLE[] AS features,
         CASE WHEN vec_id % 3 = 0 THEN 'a' ELSE 'b' END AS "Label" FROM embeddings),
cells AS (SELECT cluster, unnest(features) AS x, generate_subscripts(features, 1) AS i FROM vectors),
centres AS (
  SELECT cluster, list(m ORDER BY i) AS centre
  FROM (SELECT cluster, i, avg(x) AS m FROM cells GROUP BY cluster, i) GROUP BY cluster),
placed AS (
  SELECT vec_id, v.cluster, features, "Label", round(list_distance(features, centre), 6) AS dist
  FROM vectors v JOIN centres c ON v.cluster = c.cluster)"""


# ---- truth and predictions ------------------------------------------------------------------

MODELS = ["alpha", "beta", "gamma"]
K = 4


def judged(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, model, attack, y, plain_pred, pert_pred): rule models over labelled documents."""
    n, i = F.col("n_chars"), F.col("doc_id")
    base = table(spark, d, "labels").join(
        table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id"
    ).withColumn("y", (F.col("quality") + 2 * F.col("toxic")).cast("int"))
    rules = F.explode(F.array(*[
        F.struct(F.lit(m).alias("model"), F.lit(j).alias("j")) for j, m in enumerate(MODELS)
    ]))
    moves = F.explode(F.array(*[
        F.struct(F.lit(a).alias("attack"), F.lit(s).alias("s"))
        for s, a in enumerate(("flip", "shift"), start=2)
    ]))
    plain = F.when(n % (F.col("j") + 3) == 0, (F.col("y") + 1) % K).otherwise(F.col("y"))
    pert = F.when((n + i) % F.col("s") == 0, (F.col("plain_pred") + F.col("s")) % K).otherwise(
        F.col("plain_pred")
    )
    return (
        base.select("doc_id", "n_chars", "y", rules.alias("r")).select("*", "r.*")
        .select("*", moves.alias("m")).select("*", "m.*")
        .withColumn("plain_pred", plain.cast("int")).withColumn("pert_pred", pert.cast("int"))
        .select(F.col("doc_id").alias("sample_id"), "model", "attack", "y", "plain_pred", "pert_pred")
    )


JUDGED = f"""judged AS (
  SELECT sample_id, model, attack, y, plain_pred,
         CAST(CASE WHEN (n_chars + sample_id) % s = 0 THEN (plain_pred + s) % {K} ELSE plain_pred END AS INTEGER) AS pert_pred
  FROM (
    SELECT l.doc_id AS sample_id, model, attack, s, n_chars, CAST(quality + 2 * toxic AS INTEGER) AS y,
           CAST(CASE WHEN n_chars % (j + 3) = 0 THEN (quality + 2 * toxic + 1) % {K}
                     ELSE quality + 2 * toxic END AS INTEGER) AS plain_pred
    FROM labels l JOIN documents d ON l.doc_id = d.doc_id,
         (VALUES ('alpha', 0), ('beta', 1), ('gamma', 2)) AS r(model, j),
         (VALUES ('flip', 2), ('shift', 3)) AS m(attack, s)))"""


# ---- class probabilities --------------------------------------------------------------------

VOTERS = ["xgb", "dnn", "bagging", "gbm", "histgbm", "unlisted"]


def probabilities(spark: SparkSession, d: str, tag: str = "") -> DataFrame:
    """(sample_id, model, proba): hashed class scores per order and model, summing to 1."""
    model = F.explode(F.array(*[F.lit(m) for m in VOTERS]))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), model.alias("model"))

    def raw(c: int):
        h = F.md5(F.concat_ws("|", F.lit(f"p{tag}"), F.col("sample_id").cast("string"), "model", F.lit(str(c))))
        return (F.conv(F.substring(h, 1, 4), 16, 10).cast("double") + 1.0).alias(f"r{c}")

    scored = rows.select("*", *[raw(c) for c in range(K)])
    total = sum((F.col(f"r{c}") for c in range(1, K)), F.col("r0"))
    return scored.select(
        "sample_id", "model", F.array(*[F.col(f"r{c}") / total for c in range(K)]).alias("proba")
    )


def probabilities_sql(name: str = "probs", tag: str = "") -> str:
    raws = ", ".join(
        f"CAST(('0x' || substr(md5(concat_ws('|', 'p{tag}', sample_id, model, '{c}')), 1, 4)) AS INTEGER)::DOUBLE + 1.0 AS r{c}"
        for c in range(K)
    )
    total = " + ".join(f"r{c}" for c in range(K))
    shares = ", ".join(f"r{c} / ({total}) AS p{c}" for c in range(K))
    models = ", ".join(f"('{m}')" for m in VOTERS)
    return f"""{name} AS (
  SELECT sample_id, model, {shares} FROM (
    SELECT o_orderkey AS sample_id, model, {raws.replace('sample_id', 'o_orderkey')}
    FROM orders, (VALUES {models}) AS v(model)))"""
