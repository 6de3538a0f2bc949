"""User records, the subscription index and user-side lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import numbered
from ..sources.fixtures import topics_array
from .seen_filter import only_maybe_in


def build_subscription_index(users: DataFrame) -> DataFrame:
    """Interests -> (topic, uid, created_ts), idempotent (distinct)."""
    return users.select(F.explode("interests").alias("topic"), "uid", "created_ts").distinct()


def user_interests_lookup(uids: DataFrame, users: DataFrame) -> DataFrame:
    """Requested uids with interests; an unknown user gets an empty list, not a missing row."""
    u = users.select("uid", "interests")
    return uids.select("uid").distinct().join(u, "uid", "left").select(
        "uid", F.coalesce("interests", F.array().cast("array<string>")).alias("interests"),
        F.col("interests").isNotNull().alias("known"))


def upsert_users(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert-if-absent. Existing users keep their interests; ``created`` marks inserts."""
    cols = ["uid", "interests"]
    fresh = new.select(*cols).join(existing.select("uid"), "uid", "left_anti")
    return (existing.select(*cols, F.lit(False).alias("created"))
            .unionByName(fresh.select(*cols, F.lit(True).alias("created"))))


def users_seeded(new: DataFrame, existing: DataFrame) -> DataFrame:
    """How many candidate users were created and how many skipped."""
    mark = new.select("uid").join(existing.select("uid", F.lit(True).alias("_e")), "uid", "left")
    return mark.agg(F.count_if(F.col("_e").isNull()).alias("created"),
                    F.count_if(F.col("_e").isNotNull()).alias("skipped"))


def feed_user_context(feed: DataFrame, users: DataFrame) -> DataFrame:
    """Feed rows with their user's interests; none for users without a record (NULL)."""
    return feed.join(users.select("uid", "interests"), "uid", "left")


def topic_subscribers(spark_df_for_topics: DataFrame, subs: DataFrame) -> DataFrame:
    """Subscribers per topic, topics without subscribers included with 0."""
    topics = spark_df_for_topics.sparkSession.range(1).select(F.explode(topics_array()).alias("topic"))
    counts = subs.groupBy("topic").agg(F.countDistinct("uid").alias("subscribers"))
    return topics.join(counts, "topic", "left").select(
        "topic", F.coalesce("subscribers", F.lit(0)).cast("bigint").alias("subscribers"))


def latest_uid(users: DataFrame) -> DataFrame:
    """Highest created uid (0 when there are no users)."""
    return users.agg(F.coalesce(F.max("uid"), F.lit(0)).alias("latest_uid"))


def subscribers_lexical(subs: DataFrame) -> DataFrame:
    """G1: subscribers of each topic ordered by uid *as a string* -> lex_pos (1-based).

    Numbered by ranges, so a big topic is not ranked in one task.
    """
    s = subs.select("topic", "uid", F.col("uid").cast("string").alias("_u"))
    r = numbered(s, ["topic"], ["_u"], out="lex_pos")
    return r.select("topic", "uid", "lex_pos")


def set_add(existing: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent insert into a set; returns only the members that are new.

    Of the existing members only those that may be in the batch (by a Bloom filter of the batch) are shuffled.
    """
    new = batch.select(*keys).distinct()
    return new.join(only_maybe_in(existing.select(*keys), new, keys), keys, "left_anti")
