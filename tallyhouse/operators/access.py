"""Who may ask: role checks over a table of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles let through and the outcome texts.
ALLOWED_ROLES = ("analysis", "admin")
ALLOWED, DENIED, FAILED = "allowed", "Permission Denied", "error"


def with_decision(requests: DataFrame, user_role: DataFrame) -> DataFrame:
    """Each request with its user's role and the outcome.

    A user without a role row ends in the error outcome, like a failed lookup.
    Names are unique after the grouping, so no request is repeated; whether the
    role side is broadcast is left to its measured size, and a user sending
    much of the traffic is split by the skew join otherwise.
    """
    roles = user_role.groupBy("username").agg(F.min("role").alias("role"))
    outcome = (
        F.when(F.col("role").isNull(), FAILED)
        .when(F.col("role").isin(*ALLOWED_ROLES), ALLOWED)
        .otherwise(DENIED)
    )
    return requests.join(roles, "username", "left").withColumn("outcome", outcome)


def allowed_requests(requests: DataFrame, user_role: DataFrame) -> DataFrame:
    return requests.join(_allowed_users(user_role), "username", "left_semi")


def refused_requests(requests: DataFrame, user_role: DataFrame) -> DataFrame:
    return requests.join(_allowed_users(user_role), "username", "left_anti")


def _allowed_users(user_role: DataFrame) -> DataFrame:
    roles = user_role.groupBy("username").agg(F.min("role").alias("role"))
    return roles.where(F.col("role").isin(*ALLOWED_ROLES)).select("username")
