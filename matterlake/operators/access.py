"""Role gates, session cut-offs and use-once codes over whole tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import temporal as M
from matterlake.plans.skew import top_per_group


def authorised_pairs(requests: DataFrame, firm_users: DataFrame) -> DataFrame:
    """Requests (request_id, firm_id, caller_id, target_id) with a verdict.

    The caller must be an active owner or admin of the firm, the target any
    member of the same firm.  ``reason`` is null when allowed.
    """
    member = firm_users.select("user_id", "firm_id", "role", "status")
    caller = member.select(
        "firm_id",
        F.col("user_id").alias("caller_id"),
        F.col("role").alias("caller_role"),
        F.col("status").alias("_caller_status"),
    )
    target = member.select(
        "firm_id",
        F.col("user_id").alias("target_id"),
        F.col("role").alias("target_role"),
    )
    joined = requests.join(caller, ["firm_id", "caller_id"], "left").join(
        target, ["firm_id", "target_id"], "left"
    )
    may = (F.col("_caller_status") == "active") & F.col("caller_role").isin(
        "owner", "admin"
    )
    reason = (
        F.when(F.col("caller_id").isNull(), "caller not authenticated")
        .when(~F.coalesce(may, F.lit(False)), "caller is not an active owner or admin")
        .when(F.col("target_role").isNull(), "target is not a member of this firm")
    )
    return joined.select(
        "request_id",
        "firm_id",
        "caller_id",
        "target_id",
        "caller_role",
        "target_role",
        reason.alias("reason"),
        reason.isNull().alias("allowed"),
    )


def users_by_email(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Requests (request_id, email) with the user of that address, if any."""
    known = top_per_group(
        users.select("user_id", F.lower("email").alias("_email")),
        ["_email"],
        [F.col("user_id").asc()],
        1,
    ).select("_email", "user_id")
    return (
        requests.withColumn("_email", F.lower("email"))
        .join(known, "_email", "left")
        .select(*requests.columns, "user_id")
    )


def revoke(
    firm_users: DataFrame, allowed: DataFrame, now: Column | None = None
) -> DataFrame:
    """Membership rows with the cut-off set for every allowed target."""
    now = F.current_timestamp() if now is None else now
    hit = (
        allowed.where(F.col("allowed"))
        .select("firm_id", F.col("target_id").alias("user_id"))
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    stamped = F.when(F.col("_hit"), now).otherwise(F.col("min_token_iat"))
    return firm_users.join(hit, ["firm_id", "user_id"], "left").select(
        *[
            stamped.alias(c) if c == "min_token_iat" else F.col(c)
            for c in firm_users.columns
        ]
    )


def judged_sessions(sessions: DataFrame, firm_users: DataFrame) -> DataFrame:
    """Sessions with ``valid``: not issued before the user's cut-off.

    Works on a batch and, with a static ``firm_users``, on a stream.
    """
    cut_offs = firm_users.where(F.col("min_token_iat").isNotNull()).select(
        "user_id", "firm_id", "min_token_iat"
    )
    revoked = M.issued_before(F.col("iat"), F.col("min_token_iat"))
    return sessions.join(cut_offs, ["user_id", "firm_id"], "left").select(
        *sessions.columns, (~revoked).alias("valid")
    )


def valid_sessions(sessions: DataFrame, firm_users: DataFrame) -> DataFrame:
    return judged_sessions(sessions, firm_users).where("valid").drop("valid")


def first_redemptions(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """The first attempt on each code that is known, unused and unexpired.

    Attempts: (attempt_id, code, attempted_at).
    """
    usable = codes.where(F.col("redeemed_at").isNull()).select(
        "code", "client_id", "user_id", "firm_id", "expires_at"
    )
    timely = attempts.join(usable, "code").where(
        M.unexpired(F.col("expires_at"), F.col("attempted_at"))
    )
    first = [F.col("attempted_at").asc(), F.col("attempt_id").asc()]
    return top_per_group(timely, ["code"], first, 1).select(
        "code",
        "attempt_id",
        F.col("attempted_at").alias("redeemed_at"),
        "client_id",
        "user_id",
        "firm_id",
    )
