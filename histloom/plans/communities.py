"""Users active in several communities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from histloom import constants as K
from histloom.functions.text import first_nonempty
from histloom.operators.skew import PAGE_ROWS, first_per_group, lookup_join, nest

PREFIX_PARTS = 128


def named_posts(posts: DataFrame) -> DataFrame:
    """Posts with a known author and community."""
    author = F.col("author")
    return posts.filter(
        (author != "") & (author != K.DELETED_AUTHOR) & (F.col("subreddit") != "")
    )


def active_in(df: DataFrame, key: str, of: str, at_least: int) -> DataFrame:
    """Keys with at least so many distinct values. Pairs are made distinct before they are
    counted, so a key with very many rows reaches the count as few pairs."""
    pairs = df.select(key, of).filter(F.col(of).isNotNull()).distinct()
    counts = pairs.groupBy(key).agg(F.count(F.lit(1)).alias("communities"))
    return counts.filter(F.col("communities") >= at_least)


def posts_of(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Posts of the given authors."""
    return lookup_join(posts, authors.select("author"), ["author"], "left_semi", spread_by=["seq"])


def community_posts(
    posts: DataFrame,
    min_communities: int = K.MIN_COMMUNITIES,
    per_community: int = K.POSTS_PER_COMMUNITY,
    min_chars: int = K.MIN_POST_CHARS,
) -> DataFrame:
    """The first long posts of users who have enough of them in enough communities, and the
    place of the user's first post of any length there (`first_seq`).

    A post is long with more than `min_chars` characters. A community counts with
    `per_community` long posts, a user with `min_communities` such communities; that already
    implies activity in so many communities, so posts are read once. Ranks past
    `per_community` are dropped before the shuffle.
    """
    text = first_nonempty(F.col("content"), F.col("body"))
    long = named_posts(posts).withColumn("post", text).filter(F.length("post") > min_chars)
    slim = long.select("author", "subreddit", "seq", "post")
    first = first_per_group(slim, ["author", "subreddit"], [F.col("seq")], per_community)
    full = first.groupBy("author", "subreddit").agg(
        F.array_sort(F.collect_list(F.struct("rn", "post"))).alias("posts")
    ).filter(F.size("posts") >= per_community)
    users = full.groupBy("author").agg(F.count(F.lit(1)).alias("_n")).filter(
        F.col("_n") >= min_communities
    )
    seen = named_posts(posts).groupBy("author", "subreddit").agg(F.min("seq").alias("first_seq"))
    return full.join(users.select("author"), "author", "left_semi").join(seen, ["author", "subreddit"]).select(
        "author", "subreddit", "first_seq", F.transform("posts", lambda p: p["post"]).alias("posts")
    )


def community_users(rows: DataFrame, max_rows: int = PAGE_ROWS) -> DataFrame:
    """Nested users: their communities, in the order of the user's first post there, and a few
    posts each; in pages of `max_rows` communities numbered by `part`."""
    paged = nest(rows, ["author"], ["first_seq"], ["subreddit", "posts"], "history", max_rows)
    subreddits = F.transform("history", lambda h: h["subreddit"]).alias("subreddits")
    return paged.select(F.col("author").alias("user_id"), "part", subreddits, "history")


def corpus(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], text: str, max_chars: int, sep: str = " "
) -> DataFrame:
    """The texts of each group in order, joined and cut to `max_chars` characters.

    `order` is unique within a group. A text belongs to the result if the texts before it do not
    fill it yet (one that only brings the last separator counts). That can be asked of any part of a group: what the part's own texts before it fill
    is out for good. So a group is cut by hash into PREFIX_PARTS parts, each keeps its own prefix,
    and the prefixes are merged the same way; a group of any size brings no more than a full result
    per part to one task, and the texts are read once.
    """
    cut = F.left(F.coalesce(F.col(text), F.lit("")), F.lit(max_chars))
    part = F.pmod(F.xxhash64(*order), F.lit(PREFIX_PARTS)).cast("int")
    pieces = df.select(*keys, *order, cut.alias("_t"), part.alias("_p"))
    for by in ([*keys, "_p"], [*keys]):
        so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum(F.length("_t") + len(sep)).over(so_far), F.lit(0))
        pieces = pieces.withColumn("_before", before).filter(F.col("_before") < max_chars + len(sep)).drop("_before")
    item = F.struct(F.struct(*order).alias("_o"), "_t")
    return pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_all")).select(
        *keys,
        F.left(F.concat_ws(sep, F.transform("_all", lambda x: x["_t"])), F.lit(max_chars)).alias("corpus"),
    )
