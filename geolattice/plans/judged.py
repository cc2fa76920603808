"""Forests judged by folds, and scenes by their processing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.operators.forest import fold_quality, out_of_fold, stratified_folds
from geolattice.plans.registry import query
from geolattice.session import saved, table
from geolattice.sources.catalog import newest_per_tile

FEATURES = ["n_orders", "n_urgent", "n_open", "first_key", "balance"]


def buyers(spark: SparkSession, folder: str) -> DataFrame:
    """(id, label, rule, FEATURES): whether what a customer ordered comes to more than two million, from everything but the prices; the rule asks for ten orders."""
    o = table(spark, folder, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("total"), F.count("*").cast("double").alias("n_orders"), F.count_if(F.col("o_orderpriority") == "1-URGENT").cast("double").alias("n_urgent"),
        F.count_if(F.col("o_orderstatus") == "O").cast("double").alias("n_open"), (F.min("o_orderkey") % 97).cast("double").alias("first_key"),
    )
    both = table(spark, folder, "customer").join(o, "c_custkey")
    return both.select(F.col("c_custkey").alias("id"), (F.col("total") > 2_000_000).cast("int").alias("label"), (F.col("n_orders") >= 10).cast("int").alias("rule"), *FEATURES[:4], F.col("c_acctbal").cast("double").alias("balance"))


@query("""with b as (select o_custkey as id, (sum(o_totalprice) > 2000000)::int as label from orders join customer on c_custkey = o_custkey group by 1),
 e as (select id, label, repeat::int as repeat, md5('7:' || repeat || ':' || id) as h from b, (select unnest(range(1, 21)) as repeat) r)
 select id, label, repeat, ((row_number() over (partition by repeat, label order by h, id) - 1) % 5)::int as fold from e""")
def repeated_folds(spark: SparkSession, folder: str) -> DataFrame:
    """All customers that ordered, dealt to five folds twenty times, each class evenly."""
    return stratified_folds(buyers(spark, folder).select("id", "label"), key="id", label="label")


@query()
def forest_against_rule(spark: SparkSession, folder: str) -> DataFrame:
    """(repeat, fold, n, forest, precision, recall, rule): balanced accuracy of forests out of fold and of the rule. 5 x 2 folds of 40 trees; the operator's own numbers are 5 x 20 and 500."""
    scored = saved(out_of_fold(buyers(spark, folder), saved, key="id", label="label", features=FEATURES, repeats=2, trees=40, depth=5).withColumn("guess", (F.col("score") >= 0.5).cast("int")), "scored")
    rule = fold_quality(scored, label="label", guess="rule").select("repeat", "fold", F.col("balanced_accuracy").alias("rule"))
    return fold_quality(scored, label="label", guess="guess").withColumnRenamed("balanced_accuracy", "forest").join(rule, ["repeat", "fold"])


def processed_scenes(spark: SparkSession, folder: str) -> DataFrame:
    """(day, tile, id, baseline, assets): orders as scenes of seven tiles, processed in versions; one band of some is not at an open address."""
    where = F.when(F.col("o_orderkey") % 11 == 0, "s3://paid/").otherwise("https://open/")
    asset = lambda band, at: (F.lit(band), F.struct(F.concat(at, F.col("o_orderkey").cast("string"), F.lit(f"/{band}")).alias("href")))
    assets = F.create_map(*asset("red", F.lit("https://open/")), *asset("nir", where))
    return table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 7).alias("tile"), F.col("o_orderkey").alias("id"), F.concat(F.lit("0"), (F.col("o_orderkey") % 5).cast("string"), F.lit(".00")).alias("baseline"), assets.alias("assets"))


@query("""select o_orderdate::date as day, o_custkey % 7 as tile, o_orderkey as id, '0' || (o_orderkey % 5) || '.00' as baseline from orders where o_orderkey % 11 <> 0
 qualify row_number() over (partition by o_orderdate::date, o_custkey % 7 order by o_orderkey % 5 desc, o_orderkey desc) = 1""")
def newest_processing(spark: SparkSession, folder: str) -> DataFrame:
    """Of each day and tile the scene of the newest baseline whose bands can all be read."""
    return newest_per_tile(processed_scenes(spark, folder), ["red", "nir"]).drop("assets")
