"""Review histories: chosen users, their first reviews, product details, held-out last review, split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.text import first_nonempty, with_excerpt
from histloom.operators.lookups import frequent
from histloom.operators.ordering import (
    first_distinct,
    full_groups,
    keep_last,
    split_name,
)
from histloom.operators.skew import lookup_join
from histloom.session import written


def products_from_meta(meta: DataFrame, needed: DataFrame | None = None) -> DataFrame:
    """One product per id: the later row wins, a price that is no number is null.

    `needed` (parent_asin) cuts the metadata to those ids before rows are compared.
    """
    ids = first_nonempty(F.col("parent_asin"), F.col("asin"))
    keyed = meta.withColumn("parent_asin", ids).drop("asin").filter(F.col("parent_asin") != "")
    if needed is not None:
        keyed = keyed.join(needed, "parent_asin", "left_semi")
    price = F.expr("try_cast(price as double)").alias("price")
    return keep_last(keyed, ["parent_asin"], ["seq"]).select(
        "parent_asin", F.struct("title", "brand", price, "main_category").alias("product")
    )


def review_histories(
    reviews: DataFrame,
    meta: DataFrame,
    five_core: DataFrame,
    target_users: int = K.TARGET_USERS,
    per_user: int = K.REVIEWS_PER_USER,
    cuts: tuple[int, int] = K.SPLIT_CUTS,
) -> DataFrame:
    """One row per kept review with `role`, `split`, its product and its excerpt.

    `reviews` (user_id, category, parent_asin, timestamp, rating, title, text, seq), `meta`
    (parent_asin, asin, title, brand, price text, main_category, seq), `five_core` (user_id,
    category, seq). All categories run in one job. There are at most `target_users` users per
    category and `per_user` reviews per user, whatever the size of the files; Spark measures these
    sides and broadcasts them unless categories are very many, so neither reviews nor metadata are
    shuffled before they are cut down. With groups that small, held-out rows and splits are windows over what is left. What is kept is
    written once, so that looking up its products does not scan the reviews again.
    """
    chosen = first_distinct(five_core, "category", "user_id", "seq", target_users)
    users = chosen.select("category", "user_id")
    own = reviews.join(users, ["category", "user_id"], "left_semi")
    full = full_groups(own, ["category", "user_id"], [F.col("seq")], per_user).drop("rn")
    kept = written(full, "kept_reviews")
    newest = Window.partitionBy("category", "user_id").orderBy(F.desc("timestamp"), F.desc("seq"))
    index = F.dense_rank().over(Window.partitionBy("category").orderBy("user_id")) - 1
    marked = (
        kept.withColumn("timestamp", F.coalesce("timestamp", F.lit(0).cast("long")))
        .withColumn("role", F.when(F.row_number().over(newest) == 1, "heldout").otherwise("history"))
        .withColumn("split", split_name(index, cuts))
    )
    products = products_from_meta(meta, kept.select("parent_asin").distinct())
    return with_excerpt(marked, "text", "review_excerpt").join(products, "parent_asin", "left")


def qualifying_reviews(reviews: DataFrame, more_than: int = 6, n: int = 30) -> DataFrame:
    """The first `n` reviews, in file order, of users with more than `more_than` reviews.

    Each task keeps only its own first `n` rows, so the sort never sees the table.
    """
    active = frequent(reviews, "user_id", more_than).select("user_id")
    own = lookup_join(reviews, active, ["user_id"], "left_semi", spread_by=["seq"])
    return own.orderBy("seq").limit(n)


def nested_histories(rows: DataFrame) -> DataFrame:
    """One record per user: the ordered `history` array, `heldout`, and `split`. Histories are
    bounded by the reviews kept per user."""
    review = F.struct(
        "parent_asin",
        "rating",
        F.col("timestamp").alias("timestamp_ms"),
        "review_excerpt",
        F.col("text").alias("review_full"),
        F.col("title").alias("review_title"),
        "product",
    )
    at = F.struct("timestamp", "seq", review.alias("review"))
    past = F.array_sort(F.collect_list(F.when(F.col("role") == "history", at)))
    return rows.groupBy("category", "user_id", "split").agg(
        F.transform(past, lambda x: x["review"]).alias("history"),
        F.max(F.when(F.col("role") == "heldout", at))["review"].alias("heldout"),
    )
