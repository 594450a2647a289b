"""Rules of every table and feed, on rows some of which break them."""

from collections.abc import Callable

from pyspark.sql import functions as F

from matterlake.operators import validation as V
from matterlake.plans.storage import scratch_path
from matterlake.workload.registry import query


def _given(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c} is missing", f"{c} IS NULL") for c in columns]


def _one_of(column: str, allowed: str) -> list[tuple[str, str]]:
    listed = ", ".join(f"'{a}'" for a in allowed.split())
    return [(f"{column} is not an allowed value", f"{column} NOT IN ({listed})")]


def _least(*columns: str) -> list[tuple[str, str]]:
    return [(f"{c} is out of range", f"{c} < 0") for c in columns]


def _long(column: str, low: int, high: int | None = None) -> list[tuple[str, str]]:
    bad = f"length({column}) < {low}"
    if high is not None:
        bad = f"({bad} OR length({column}) > {high})"
    return [(f"{column} has a bad length", bad)]


# Per rule set: the stand-in, and what breaks its rules, in SQL.
BROKEN: dict[str, tuple[str, list[tuple[str, str]]]] = {
    "firms": (
        "raw_firms",
        _given("id", "name", "status") + _one_of("status", "active suspended archived"),
    ),
    "firm_users": (
        "raw_firm_users",
        _given("user_id", "firm_id", "role", "status")
        + _one_of("role", "owner admin member")
        + _one_of("status", "active suspended removed"),
    ),
    "matters": (
        "raw_matters",
        _one_of("stage", "pre_draft in_negotiation settled executed closed")
        + _one_of("privilege_scope", "privileged work_product common_interest open"),
    ),
    "extraction_jobs": (
        "raw_jobs",
        _given("id", "firm_id", "document_id", "status", "triggered_by")
        + _one_of("status", "pending running completed failed cancelled skipped")
        + _one_of("triggered_by", "document_upload manual_reextract tool_call scheduled_backfill"),
    ),
    "document_handoffs": (
        "raw_handoffs",
        _given("firm_id", "doc_title", "summary")
        + _least("paragraph_count", "word_count", "turn_count"),
    ),
    "audit_log": (
        "raw_audit",
        _given("firm_id", "action", "result") + _one_of("result", "success denied error"),
    ),
    "notes": (
        "raw_notes",
        _given("matter_id", "note")
        + _long("note", 3, 4000)
        + _one_of("note_type", "decision preference context")
        + _one_of("scope", "matter client"),
    ),
    "signals": (
        "raw_signals",
        _given("doc_title", "paragraph_count", "word_count")
        + _long("doc_title", 1, 500)
        + _least("paragraph_count", "word_count"),
    ),
    "signal_updates": (
        "raw_signals",
        _given("doc_title", "paragraph_count", "word_count")
        + _long("doc_title", 1, 500)
        + _least("paragraph_count", "word_count")
        + _given("summary")
        + _long("summary", 1, 4000)
        + _least("turn_count"),
    ),
    "asserts": (
        "raw_asserts",
        _given("matter_id", "clause_type", "value", "status")
        + _long("clause_type", 1)
        + _one_of("status", "proposed open settled rejected")
        + _long("counterparty_name", 1)
        + _one_of("party_role", "our_side counterparty neutral mutual"),
    ),
    "edits": (
        "raw_edits",
        _given("old_text", "new_text") + _long("old_text", 1, 50_000) + _long("new_text", 0, 50_000),
    ),
    "drafts": ("raw_drafts", _given("document_text") + _long("document_text", 50)),
    "searches": ("raw_searches", _given("query") + _long("query", 3)),
}
_NAMES = {"extraction_jobs": "row_name"}


def _reasons(broken: list[tuple[str, str]]) -> str:
    cases = ", ".join(f"CASE WHEN {bad} THEN '{reason}' END" for reason, bad in broken)
    return f"array_to_string(list_filter([{cases}], lambda x: x IS NOT NULL), '; ')"


def _validated(rule_set: str, source: str) -> Callable:
    def run(s):
        judged = V.with_reasons(getattr(s, source), V.RULE_SETS[rule_set]())
        return judged.select(
            F.col(_NAMES.get(rule_set, "id")).alias("id"),
            F.array_join("reasons", "; ").alias("reasons"),
        )

    return run


for _set, (_source, _broken) in BROKEN.items():
    query(
        f"validate_{_set}",
        f"SELECT {_NAMES.get(_set, 'id')} AS id, {_reasons(_broken)} AS reasons FROM {_source}",
        _source,
    )(_validated(_set, _source))


def _counts_sql() -> str:
    parts = []
    for rule_set, (source, broken) in BROKEN.items():
        parts.append(f"SELECT '{rule_set}' AS rules, 'rows' AS reason, count(*) AS n FROM {source}")
        parts += [
            f"SELECT '{rule_set}', '{reason}', count(*) FILTER (WHERE {bad}) FROM {source}"
            for reason, bad in broken
        ]
    return " UNION ALL ".join(parts)


@query("validation_counts", _counts_sql(), " ".join(sorted({s for s, _ in BROKEN.values()})))
def validation_counts(s):
    """Per rule set the rows and how many break each rule, seen while writing."""
    found = []
    for rule_set, (source, _) in BROKEN.items():
        path = scratch_path(s.spark, f"judged-{rule_set}")
        counts = V.write_judged(getattr(s, source), V.RULE_SETS[rule_set](), path)
        found += [(rule_set, reason, n) for reason, n in counts.items()]
    return s.spark.createDataFrame(found, "rules string, reason string, n long")


@query(
    "judged_notes",
    f"""SELECT id, note_type, reasons = '' AS valid FROM (
          SELECT *, {_reasons(BROKEN["notes"][1])} AS reasons FROM raw_notes)""",
    "raw_notes",
)
def judged_notes(s):
    """Both sides of a stored, judged table."""
    path = scratch_path(s.spark, "judged-notes")
    rows = s.raw_notes
    V.write_judged(rows, V.RULE_SETS["notes"](), path)
    sides = [
        V.judged_rows(rows, path, valid).select("id", "note_type", F.lit(valid).alias("valid"))
        for valid in (True, False)
    ]
    return sides[0].unionByName(sides[1])
