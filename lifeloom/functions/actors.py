"""Who edits: IP addresses and bots, decided once for each distinct user."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How a user name is taken for a bot's. "property": exact name on the list, or ends with bot in any case.
#: "class": listed in any case, or starts or ends with bot.
BOT_RULES = ("property", "class")


def _is_address(name: str | None) -> bool:
    try:
        ipaddress.ip_address(name or "")
        return True
    except ValueError:
        return False


@F.pandas_udf(T.BooleanType())
def is_ip(names: pd.Series) -> pd.Series:
    """IPv4 or IPv6 address, as Python reads them; names are not trimmed."""
    return names.map(_is_address).astype(bool)


def looks_like_bot(user: Column, rule: str) -> Column:
    low = F.lower(F.trim(user)) if rule == "class" else F.lower(user)
    return low.endswith("bot") | low.startswith("bot") if rule == "class" else low.endswith("bot")


def with_flags(users: DataFrame, bots: DataFrame | None = None, rule: str = "class", column: str = "user") -> DataFrame:
    """Distinct users with is_ip and is_bot. bots: a table with column `name`.

    Rows with a null user are left out. The list is joined by name, in any case under the "class" rule.
    """
    if rule not in BOT_RULES:
        raise ValueError(f"rule is one of {BOT_RULES}")
    own = users.select(F.col(column).alias("user")).where("user is not null").distinct()
    key = F.lower(F.trim("user")) if rule == "class" else F.col("user")
    flagged = own.withColumns({"key": key, "like": looks_like_bot(F.col("user"), rule)})
    address = is_ip(F.trim("user") if rule == "class" else F.col("user"))
    if bots is None:
        return flagged.select("user", address.alias("is_ip"), F.col("like").alias("is_bot"))
    listed = bots.select((F.lower(F.trim("name")) if rule == "class" else F.col("name")).alias("key")).distinct()
    listed = listed.withColumn("listed", F.lit(True))
    return flagged.join(listed, "key", "left").select(
        "user", address.alias("is_ip"), (F.coalesce("listed", F.lit(False)) | F.col("like")).alias("is_bot")
    )


def humans_only(rows: DataFrame, flags: DataFrame, column: str = "user") -> DataFrame:
    """Rows whose user is known and neither an address nor a bot."""
    good = flags.where(~F.col("is_ip") & ~F.col("is_bot")).select(F.col("user").alias(column))
    return rows.join(good, column, "left_semi")
