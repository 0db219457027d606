"""Products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemart.fixed_values import UNKNOWN_KEY
from tidemart.operators.keys import per_key

LARGE_BASKET = 1000


def _named(lines: DataFrame) -> DataFrame:
    """Lines under a basket name that is never null; the lines without a transaction are one basket.

    Spark reads a key that may be null with another filter for each kind of join. Without that, all joins below
    hang on the same shuffles, which are then written once.
    """
    basket = F.coalesce(F.concat(F.lit("+"), "transaction_id"), F.lit(""))
    return lines.select(basket.alias("transaction_id"), "product_key")


def _frequent(lines: DataFrame, min_support: int) -> DataFrame:
    """Lines whose product is in at least ``min_support`` baskets."""
    counted = per_key(lines, "product_key", F.count(F.lit(1)).alias("n"))
    often = counted.filter(F.col("n") >= min_support).select("product_key")
    return lines.join(often, "product_key", "left_semi")


def _ordinary_pairs(lines: DataFrame) -> DataFrame:
    """Pair counts of baskets known to be short: each becomes one sorted list, paired in place.

    One shuffle of the lines. (A self join would shuffle and sort them twice.)
    """
    baskets = lines.groupBy("transaction_id").agg(F.sort_array(F.collect_list("product_key")).alias("items"))
    heads = baskets.filter(F.size("items") > 1).select("items", F.posexplode("items").alias("i", "product_a"))
    return (
        heads.select("product_a", F.explode(F.slice("items", F.col("i") + 2, F.size("items"))).alias("product_b"))
        .groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("n"))
    )


def _joined_pairs(lines: DataFrame) -> DataFrame:
    """Pair counts by self join, which spreads one long basket over many tasks."""
    a = lines.select("transaction_id", F.col("product_key").alias("product_a"))
    b = lines.select("transaction_id", F.col("product_key").alias("product_b"))
    return (
        a.join(b, "transaction_id").filter("product_a < product_b")
        .groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("n"))
    )


def pair_counts(lines: DataFrame, min_support: int, large_basket: int = LARGE_BASKET) -> DataFrame:
    """(product_a, product_b, times_bought_together) with at least ``min_support`` baskets; exact, and one plan.

    ``lines`` holds a product at most once per transaction. A product in fewer than ``min_support``
    baskets cannot be in a result pair, so its lines go first.

    A basket of more than ``large_basket`` lines is never gathered into one row nor unfolded into all
    its pairs. Its pairs are counted in two ways that together miss none:
      * pairs also seen in an ordinary basket, often enough that the large ones could make up the rest:
        looked up in the large baskets;
      * pairs seen in large baskets only: both products then sit in ``min_support`` large baskets,
        and only such products are paired. While there are fewer large baskets than that, none do.
    Both hang on the lines of large baskets: where there are none, the adaptive planner drops these branches.
    """
    likely = _frequent(_named(lines), min_support)
    sizes = per_key(likely, "transaction_id", F.count(F.lit(1)).alias("size"))
    large_ids = sizes.filter(F.col("size") > large_basket).select("transaction_id")
    n_large = large_ids.agg(F.count(F.lit(1))).scalar()
    large = likely.join(large_ids, "transaction_id", "left_semi")
    small = _ordinary_pairs(likely.join(large_ids, "transaction_id", "left_anti"))

    in_a = large.select(F.col("product_key").alias("product_a"), "transaction_id")
    in_b = large.select(F.col("product_key").alias("product_b"), "transaction_id")
    near = small.filter(F.col("n") >= min_support - n_large).select("product_a", "product_b")
    looked_up = (
        near.join(in_a, "product_a").join(in_b, ["product_b", "transaction_id"])
        .groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("n"))
    )
    enough = large.filter(n_large >= min_support)
    only_large = _joined_pairs(_frequent(enough, min_support)).join(
        small.select("product_a", "product_b"), ["product_a", "product_b"], "left_anti")
    found = small.unionByName(looked_up).unionByName(only_large).groupBy("product_a", "product_b").agg(F.sum("n").alias("n"))
    return found.filter(F.col("n") >= min_support).withColumnRenamed("n", "times_bought_together")


def market_basket(
    fact: DataFrame, products: DataFrame, min_support: int = 3, large_basket: int = LARGE_BASKET
) -> DataFrame:
    """Pairs with their product names, most frequent first. Names are looked up after counting."""
    lines = fact.filter(F.col("product_key") != UNKNOWN_KEY).select("transaction_id", "product_key")
    pairs = pair_counts(lines, min_support, large_basket)
    name_a = products.select(F.col("product_key").alias("product_a"), F.col("product_name").alias("product_a_name"))
    name_b = products.select(F.col("product_key").alias("product_b"), F.col("product_name").alias("product_b_name"))
    return (
        pairs.join(name_a, "product_a", "left").join(name_b, "product_b", "left")
        .select("product_a_name", "product_b_name", "times_bought_together", "product_a", "product_b")
        .orderBy(F.desc("times_bought_together"), "product_a", "product_b")
    )
