"""Account events: subscription state, rate breaches, monthly quota."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegauge.constants import DEFAULT_RATE_LIMIT, FREE_ANALYSES_PER_MONTH, ROUTE_RATE_LIMITS
from sitegauge.operators.joins import join_reduced

# --- fixed values: event types of the payment log ---
COMPLETED = "checkout.session.completed"
DELETED = "customer.subscription.deleted"
UPDATED = "customer.subscription.updated"


def subscription_state(accounts: DataFrame, events: DataFrame) -> DataFrame:
    """Fold the payment log into the accounts: ``(email, customer_id, premium, since)``.

    A completed checkout is matched by e-mail and sets the customer id; deleted and updated
    subscriptions are matched by customer id, hence ignored before the first checkout of an
    account without one. The last event that counts decides, so the fold is two aggregates
    with map-side combine, whatever the number of events per customer.
    """
    relevant = events.where(F.col("type").isin(COMPLETED, DELETED, UPDATED))
    checkouts = relevant.where(F.col("type") == COMPLETED).groupBy("email").agg(
        F.max(F.struct("ts", "event_id", "customer")).alias("last_checkout")
    )
    changes = relevant.where(F.col("type") != COMPLETED).groupBy("customer").agg(
        F.max(F.struct("ts", "event_id", "type", "status")).alias("last_change")
    )
    joined = accounts.join(checkouts, "email", "left")
    known = join_reduced(joined.withColumn("customer", F.coalesce("last_checkout.customer", "customer_id")), changes, "customer", "left", F.xxhash64("email"))
    change, checkout = F.col("last_change"), F.col("last_checkout")
    follows = change.isNotNull() & (
        (checkout.isNotNull() & (F.struct(change["ts"], change["event_id"]) > F.struct(checkout["ts"], checkout["event_id"])))
        | (checkout.isNull() & F.col("customer_id").isNotNull())
    )
    active = (change["type"] == UPDATED) & F.coalesce(change["status"] == "active", F.lit(False))
    premium = F.when(follows, active).when(checkout.isNotNull(), True).otherwise(F.col("premium"))
    since = F.when(follows, F.when(active, change["ts"])).when(checkout.isNotNull(), checkout["ts"])
    return known.select("email", F.col("customer").alias("customer_id"), premium.alias("premium"), since.alias("since"))


def premium_flag(state: DataFrame) -> DataFrame:
    return state.select("email", F.coalesce("premium", F.lit(False)).alias("premium"), "since")


def rate_limit_column(route: Column) -> Column:
    limit = F.when(F.lit(False), 0)
    for name, value in ROUTE_RATE_LIMITS.items():
        limit = limit.when(route == name, value)
    return limit.otherwise(DEFAULT_RATE_LIMIT)


def request_counts(log: DataFrame, window: str = "1 minute") -> DataFrame:
    """Requests by client, route and fixed window."""
    return (
        log.groupBy(F.window("ts", window), "client", "route").agg(F.count("*").alias("n"))
        .select("client", "route", F.col("window.start").alias("window_start"), "n")
    )


def rate_breaches(log: DataFrame, window: str = "1 minute", limit: Column | None = None) -> DataFrame:
    counted = request_counts(log, window).withColumn("limit", rate_limit_column(F.col("route")) if limit is None else limit)
    return counted.where(F.col("n") > F.col("limit"))


def monthly_quota(log: DataFrame, route: str = "analyze", quota: int = FREE_ANALYSES_PER_MONTH) -> DataFrame:
    """Analyses by account and month against the free quota."""
    counted = log.where(F.col("route") == route).groupBy(
        F.col("client").alias("account"), F.to_date(F.date_trunc("month", "ts")).alias("month")
    ).agg(F.count("*").alias("n"))
    return counted.withColumn("over_quota", F.col("n") > quota)
