"""Devices and their keys: who a token belongs to, and tickets that are good for one use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.paths import is_hash
from palimpsest.model import ENROLL_MS, TICKET_MS
from palimpsest.operators.history import expired


def lookup_tokens(asked: DataFrame, devices: DataFrame) -> DataFrame:
    """The asked rows (token) with device_id; null for tokens that are not 64 hexadecimal digits or that nobody has."""
    own = devices.select(F.col("bearer_token").alias("__token"), "device_id").dropDuplicates(["__token"])
    return asked.join(own, is_hash("token") & (F.col("token") == F.col("__token")), "left").drop("__token")


def issue(keys: DataFrame, created_ms: str, kind: str = "ticket") -> DataFrame:
    """The rows with expires_at, by the life of a ticket or an enrollment code."""
    return keys.withColumn("expires_at", F.col(created_ms) + {"ticket": TICKET_MS, "enrollment": ENROLL_MS}[kind])


def claim_tickets(claims: DataFrame, tickets: DataFrame, kind: str = "ticket") -> DataFrame:
    """The claims (ticket, at_ms, seq) with device_id, null for those that fail.

    The first claim of a ticket uses it up, in time or not; a ticket is good through its last millisecond.
    """
    first = F.row_number().over(Window.partitionBy("ticket").orderBy("at_ms", "seq")) == 1
    own = tickets.select(F.col("ticket").alias("__ticket"), F.col("device_id").alias("__device"), "expires_at").dropDuplicates(["__ticket"])
    met = claims.withColumn("__first", first).join(own, F.col("ticket") == F.col("__ticket"), "left")
    good = F.col("__first") & ~expired(kind, F.col("at_ms"))
    return met.withColumn("device_id", F.when(good, F.col("__device"))).drop("__first", "__ticket", "__device", "expires_at")
