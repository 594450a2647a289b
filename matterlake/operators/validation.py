"""Constraints as data: every broken rule of a row becomes a reason."""

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from matterlake import schemas as S


def required(name: str) -> dict[str, Column]:
    return {f"{name} is missing": F.col(name).isNotNull()}


def in_set(name: str, allowed: Sequence[str]) -> dict[str, Column]:
    c = F.col(name)
    return {f"{name} is not an allowed value": c.isNull() | c.isin(*allowed)}


def in_range(name: str, low=None, high=None) -> dict[str, Column]:
    c = F.col(name)
    ok = F.lit(True)
    if low is not None:
        ok = ok & (c >= low)
    if high is not None:
        ok = ok & (c <= high)
    return {f"{name} is out of range": c.isNull() | ok}


def length_between(name: str, low: int = 0, high: int | None = None) -> dict:
    n = F.length(F.col(name))
    ok = n >= low
    if high is not None:
        ok = ok & (n <= high)
    return {f"{name} has a bad length": n.isNull() | ok}


def rules(*parts: Mapping[str, Column]) -> dict[str, Column]:
    merged: dict[str, Column] = {}
    for part in parts:
        merged.update(part)
    return merged


def firm_rules():
    return rules(
        *map(required, ("id", "name", "status")), in_set("status", S.FIRM_STATUSES)
    )


def firm_user_rules():
    return rules(
        *map(required, ("user_id", "firm_id", "role", "status")),
        in_set("role", S.MEMBER_ROLES),
        in_set("status", S.MEMBER_STATUSES),
    )


def matter_rules():
    return rules(
        in_set("stage", S.MATTER_STAGES),
        in_set("privilege_scope", S.PRIVILEGE_SCOPES),
    )


def position_rules():
    return rules(
        *map(
            required,
            ("id", "firm_id", "matter_id", "clause_type", "value", "extracted_by"),
        ),
        required("status"),
        in_set("status", S.POSITION_STATUSES),
        in_set("party_role", S.PARTY_ROLES),
        in_range("confidence", 0, 1),
    )


def job_rules():
    return rules(
        *map(required, ("id", "firm_id", "document_id", "status", "triggered_by")),
        in_set("status", S.JOB_STATUSES),
        in_set("triggered_by", S.JOB_TRIGGERS),
    )


def handoff_rules():
    return rules(
        *map(required, ("firm_id", "doc_title", "summary")),
        in_range("paragraph_count", 0),
        in_range("word_count", 0),
        in_range("turn_count", 0),
    )


def audit_rules():
    return rules(
        *map(required, ("firm_id", "action", "result")),
        in_set("result", S.AUDIT_RESULTS),
    )


# Fixed values below: the bounds of each feed.
def upload_rules():
    return rules(
        *map(required, ("matter_id", "name", "content")),
        length_between("name", 1, 500),
        length_between("content", 20, 500_000),
        length_between("doc_type", 1, 100),
        length_between("word_doc_id", 1, 2048),
    )


def note_rules():
    return rules(
        *map(required, ("matter_id", "note")),
        length_between("note", 3, 4000),
        in_set("note_type", S.NOTE_TYPES),
        in_set("scope", S.NOTE_SCOPES),
    )


def signal_rules(update: bool = False):
    base = rules(
        *map(required, ("doc_title", "paragraph_count", "word_count")),
        length_between("doc_title", 1, 500),
        in_range("paragraph_count", 0),
        in_range("word_count", 0),
    )
    if not update:
        return base
    return rules(
        base,
        required("summary"),
        length_between("summary", 1, 4000),
        in_range("turn_count", 0),
    )


def assert_rules():
    return rules(
        *map(required, ("matter_id", "clause_type", "value", "status")),
        length_between("clause_type", 1),
        in_set("status", S.POSITION_STATUSES),
        length_between("counterparty_name", 1),
        in_set("party_role", S.PARTY_ROLES),
    )


def edit_rules():
    return rules(
        *map(required, ("old_text", "new_text")),
        length_between("old_text", 1, 50_000),
        length_between("new_text", 0, 50_000),
    )


def draft_rules():
    return rules(
        required("document_text"), length_between("document_text", S.MIN_CONTENT_CHARS)
    )


def search_rules():
    return rules(required("query"), length_between("query", 3))


# The rules of every table and feed by name.
RULE_SETS: dict[str, Callable[[], dict[str, Column]]] = {
    "firms": firm_rules,
    "firm_users": firm_user_rules,
    "matters": matter_rules,
    "positions": position_rules,
    "extraction_jobs": job_rules,
    "document_handoffs": handoff_rules,
    "audit_log": audit_rules,
    "uploads": upload_rules,
    "notes": note_rules,
    "signals": signal_rules,
    "signal_updates": lambda: signal_rules(update=True),
    "asserts": assert_rules,
    "edits": edit_rules,
    "drafts": draft_rules,
    "searches": search_rules,
}


def with_reasons(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Adds ``reasons``: the rules the row breaks, in rule order."""
    reasons = [F.when(~ok, F.lit(reason)) for reason, ok in checks.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*reasons)))


def validate(
    df: DataFrame, checks: Mapping[str, Column]
) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with ``reasons``), one scan each."""
    judged = with_reasons(df, checks)
    valid = judged.where(F.size("reasons") == 0).drop("reasons")
    return valid, judged.where(F.size("reasons") > 0)


def write_judged(
    df: DataFrame, checks: Mapping[str, Column], path: str
) -> dict[str, int]:
    """Store all rows with ``reasons``, apart by ``valid``; count while writing.

    Returns the rows (under ``rows``) and, per reason, the rows that break it.
    The table is read and judged once: the counts are observed on the way to the
    files, and nothing but them comes to the driver.  Read both sides with
    ``judged_rows``.
    """
    seen = Observation()
    counts = [
        F.count_if(F.array_contains("reasons", reason)).alias(f"_{i}")
        for i, reason in enumerate(checks)
    ]
    (
        with_reasons(df, checks)
        .observe(seen, F.count(F.lit(1)).alias("rows"), *counts)
        .withColumn("valid", F.size("reasons") == 0)
        .write.partitionBy("valid")
        .parquet(path)
    )
    found = seen.get
    named = {reason: found[f"_{i}"] for i, reason in enumerate(checks)}
    return {"rows": found["rows"], **named}


def judged_rows(df: DataFrame, path: str, valid: bool) -> DataFrame:
    """The stored rows that are (not) valid; ``df`` gives the columns."""
    schema = df.withColumns(
        {"reasons": F.array().cast("array<string>"), "valid": F.lit(True)}
    ).schema
    rows = df.sparkSession.read.schema(schema).parquet(path)
    kept = rows.where(F.col("valid") == valid).drop("valid")
    return kept.drop("reasons") if valid else kept


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def orphans(
    child: DataFrame, child_key: str, parent: DataFrame, parent_key: str
) -> DataFrame:
    """Child rows whose reference is set but points nowhere."""
    known = parent.select(F.col(parent_key).alias(child_key))
    return (
        child.where(F.col(child_key).isNotNull())
        .join(known, child_key, "left_anti")
        .select(*child.columns)
    )
