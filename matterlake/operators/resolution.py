"""Which matter does a document belong to: four rules, the first hit wins.

Hints: (request_id, firm_id, word_doc_id, document_name, content_snippet).
Every step answers the requests that no earlier step answered and gives
(request_id, firm_id, step, matter_id, document_id, document_name_found,
is_precedent, alternatives, confidence).
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import text as X
from matterlake.plans.containment import containment_pairs, newest_first
from matterlake.plans.skew import top_per_group
from matterlake.plans.storage import written
from matterlake.plans.wordmatch import word_matches

ANSWER = (
    "request_id",
    "firm_id",
    "step",
    "matter_id",
    "document_id",
    "document_name_found",
    "is_precedent",
    "alternatives",
    "confidence",
)


# A request belongs to a firm: two firms may use the same request id.
REQUEST = ("request_id", "firm_id")


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _no_alternatives() -> Column:
    return F.array().cast("array<string>")


def _known_matter(answers: DataFrame, matters: DataFrame) -> DataFrame:
    """Blank a document's matter when the firm has no such matter."""
    known = matters.select(
        "firm_id", F.col("id").alias("matter_id"), F.lit(True).alias("_known")
    )
    return answers.join(known, ["firm_id", "matter_id"], "left").withColumn(
        "matter_id", F.when(F.col("_known"), F.col("matter_id"))
    )


def by_office_id(
    hints: DataFrame, documents: DataFrame, matters: DataFrame
) -> DataFrame:
    """Step 1: the office id of exactly one document of the firm."""
    asked = hints.where(_given(F.col("word_doc_id")))
    key = ["firm_id", "word_doc_id"]
    # Two documents of an id tell as much as all: the rest stays in its map task.
    stored = documents.select(*key, "id", "matter_id", "name", "is_precedent")
    two = top_per_group(
        stored.where(F.col("word_doc_id").isNotNull()), key, [F.col("id").asc()], 2
    )
    # Only documents somebody asks for are grouped.
    single = (
        two.join(asked.select(*key), key, "left_semi")
        .groupBy("firm_id", "word_doc_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.first("id").alias("document_id"),
            F.first("matter_id").alias("matter_id"),
            F.first("name").alias("document_name_found"),
            F.first("is_precedent").alias("is_precedent"),
        )
        .where(F.col("_n") == 1)
    )
    found = asked.join(single, key)
    return _known_matter(found, matters).select(
        "request_id",
        "firm_id",
        F.lit(1).alias("step"),
        "matter_id",
        "document_id",
        "document_name_found",
        F.coalesce("is_precedent", F.lit(False)).alias("is_precedent"),
        _no_alternatives().alias("alternatives"),
        F.lit("exact").alias("confidence"),
    )


def _by_name(documents: DataFrame, matters: DataFrame) -> DataFrame:
    """Per stored name and known matter (or none): how many documents, the first."""
    stored = documents.where(F.col("name").isNotNull()).select(
        "firm_id", F.col("name").alias("text"), "id", "matter_id", "is_precedent"
    )
    first = F.struct("id", F.coalesce("is_precedent", F.lit(False)).alias("is_precedent"))
    # Copies of a name become one row per matter, in the map tasks already.
    return _known_matter(stored, matters).groupBy("firm_id", "text", "matter_id").agg(
        F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n")
    )


def _first_documents(documents: DataFrame, matters: DataFrame, k: int) -> DataFrame:
    """The first ``k`` documents of each name, one by one."""
    named = top_per_group(
        documents.where(F.col("name").isNotNull()).select(
            "firm_id", F.col("name").alias("text"), "id", "matter_id", "is_precedent"
        ),
        ["firm_id", "text"],
        [F.col("id").asc()],
        k,
    ).drop("rank")
    first = F.struct("id", F.coalesce("is_precedent", F.lit(False)).alias("is_precedent"))
    return _known_matter(named, matters).select(
        "firm_id", "text", "matter_id", first.alias("_first"), F.lit(1).alias("_n")
    )


def by_document_name(
    hints: DataFrame,
    documents: DataFrame,
    matters: DataFrame,
    literal: bool = False,
    k: int | None = None,
    alternatives: int | None = None,
) -> DataFrame:
    """Step 2: stored names that contain the given file name.

    Matters are looked up first.  The very name wins, then documents with a
    known matter, then order by (name, id).  Alternatives are the known matters
    of all other hits, each once, in that order.  With ``k`` only the first
    ``k`` hits by (very name, name, id) count, whatever their matters; with
    ``alternatives`` only so many are listed.  By default pattern characters are
    removed from the given name first; ``literal`` keeps them.
    """
    asked = hints.where(_given(F.col("document_name"))).select(
        "firm_id", F.col("document_name").alias("pattern")
    )

    def needle(p: Column) -> Column:
        return p if literal else X.strip_wildcards(p)

    # Read for the names and again for their hits.
    stored = written(
        _by_name(documents, matters) if k is None else _first_documents(documents, matters, k),
        "names",
    )
    pairs = containment_pairs(
        asked.distinct(),
        stored.select("firm_id", "text").distinct(),
        lambda p, t: X.contains_ignoring_case(t, needle(p)),
        literal=needle,
    )
    other_name = F.col("pattern") != F.col("text")
    unknown = F.lit(False) if k is not None else F.col("matter_id").isNull()
    if k is not None:
        pairs = top_per_group(
            pairs, ["firm_id", "pattern"], [other_name.asc(), F.col("text").asc()], k
        ).drop("rank")
    hits = pairs.join(stored, ["firm_id", "text"])
    if k is not None:
        order = [other_name.asc(), F.col("text").asc(), F.col("_first.id").asc()]
        hits = top_per_group(hits, ["firm_id", "pattern"], order, k).drop("rank")
    place = F.struct(
        other_name.alias("other_name"),
        unknown.alias("unknown"),
        F.col("text"),
        F.col("_first.id").alias("id"),
    )
    best = F.struct(
        place.alias("place"),
        F.col("matter_id"),
        F.col("_first.is_precedent").alias("is_precedent"),
    )
    # One row per pattern and matter is left; the best hit stands in one of them.
    per_matter = hits.groupBy("firm_id", "pattern", "matter_id").agg(
        F.min(best).alias("_best"), F.sum("_n").alias("_n")
    )
    listed = F.struct("_best.place", "matter_id", "_n")
    per_name = (
        per_matter.groupBy("firm_id", "pattern")
        .agg(
            F.min("_best").alias("_best"),
            F.array_sort(
                F.collect_list(F.when(F.col("matter_id").isNotNull(), listed))
            ).alias("_matters"),
        )
        .withColumn("_own", F.col("_best.matter_id"))
        .withColumn(
            "alternatives",
            F.transform(
                # The best hit's own matter counts if another hit has it too.
                F.filter(
                    "_matters",
                    lambda m: ~m["matter_id"].eqNullSafe(F.col("_own")) | (m["_n"] > 1),
                ),
                lambda m: m["matter_id"],
            ),
        )
    )
    if alternatives is not None:
        per_name = per_name.withColumn("alternatives", F.slice("alternatives", 1, alternatives))
    answered = hints.select(
        "request_id", "firm_id", F.col("document_name").alias("pattern")
    ).join(per_name, ["firm_id", "pattern"])
    found = F.col("_best.place.text")
    return answered.select(
        "request_id",
        "firm_id",
        F.lit(2).alias("step"),
        F.col("_own").alias("matter_id"),
        F.col("_best.place.id").alias("document_id"),
        found.alias("document_name_found"),
        F.col("_best.is_precedent").alias("is_precedent"),
        "alternatives",
        F.when(found == F.col("pattern"), "exact").otherwise("fuzzy").alias("confidence"),
    )


def _without_document(answers: DataFrame, step: int) -> DataFrame:
    return answers.select(
        "request_id",
        "firm_id",
        F.lit(step).alias("step"),
        F.element_at("_ids", 1).alias("matter_id"),
        F.lit(None).cast("string").alias("document_id"),
        F.lit(None).cast("string").alias("document_name_found"),
        F.lit(False).alias("is_precedent"),
        F.slice("_ids", 2, F.size("_ids")).alias("alternatives"),
        F.lit("fuzzy").alias("confidence"),
    )


def _ids_in_order(found: DataFrame, keys: list[str], order: list[Column], k: int | None) -> DataFrame:
    """The ids of each group in ``order``, which may leave out all after ``k``."""
    if k is not None:
        found = top_per_group(found, keys, order, k).drop("rank")
    place = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], F.col("id"))
    return (
        found.groupBy(*keys)
        .agg(F.array_sort(F.collect_list(place)).alias("_places"))
        .withColumn("_ids", F.transform("_places", lambda p: p["id"]))
        .drop("_places")
    )


def by_matter_name(
    hints: DataFrame,
    matters: DataFrame,
    k: int | None = None,
    hint_chars: int | None = None,
) -> DataFrame:
    """Step 3: matter names that contain the cleaned hint, by (name, id).

    The hint is the file name, or else the whole snippet.  With ``k`` only the
    first ``k`` hits count; with ``hint_chars`` only so much of the snippet.
    """
    snippet = F.col("content_snippet")
    if hint_chars is not None:
        snippet = X.head(snippet, hint_chars)
    named = matters.where(F.col("matter_name").isNotNull()).select(
        "firm_id", F.col("matter_name").alias("text"), "id"
    )
    # A hint longer than all names of its firm is in none; lower case may be
    # a little longer than the name itself.
    longest = named.groupBy("firm_id").agg(F.max(F.length(F.lower("text"))).alias("_longest"))
    cleaned = (
        hints.withColumn("pattern", X.clean_hint(F.coalesce(F.col("document_name"), snippet)))
        .where(F.length("pattern") >= 3)
        .select("request_id", "firm_id", "pattern")
        .join(longest, "firm_id")
        .where(F.length(F.lower("pattern")) <= F.col("_longest"))
        .drop("_longest")
    )
    pairs = containment_pairs(
        cleaned.select("firm_id", "pattern").distinct(),
        named.select("firm_id", "text").distinct(),
        lambda p, t: X.contains_ignoring_case(t, p),
    )
    if k is not None:
        named = top_per_group(named, ["firm_id", "text"], [F.col("id").asc()], k).drop("rank")
        pairs = top_per_group(pairs, ["firm_id", "pattern"], [F.col("text").asc()], k).drop("rank")
    hits = pairs.join(named, ["firm_id", "text"])
    per_hint = _ids_in_order(hits, ["firm_id", "pattern"], [F.col("text"), F.col("id")], k)
    return _without_document(cleaned.join(per_hint, ["firm_id", "pattern"]), 3)


def by_names_in_hint(
    hints: DataFrame,
    matters: DataFrame,
    newest: int | None = None,
    alternatives: int | None = None,
) -> DataFrame:
    """Step 4: matter or client names that occur as words in the hint text.

    A matter name scores 2, a client name 1.  Best score first, then newest.
    ``newest`` limits the search to that many newest matters of a firm,
    ``alternatives`` the list of further matters.
    """
    hay = X.haystack(F.col("document_name"), F.col("content_snippet"))
    texts = hints.select("request_id", "firm_id", hay.alias("text")).where(
        F.length(X.trim_blanks(F.col("text"))) >= 3
    )
    tried = matters.select("id", "firm_id", "matter_name", "client_name", "created_at")
    if newest is not None:
        tried = top_per_group(tried, ["firm_id"], newest_first(), newest).drop("rank")
    scored_names = F.array(
        F.struct(F.col("matter_name").alias("name"), F.lit(2).alias("points")),
        F.struct(F.col("client_name").alias("name"), F.lit(1).alias("points")),
    )
    names = tried.select(
        "firm_id", "id", "created_at", F.explode(scored_names).alias("_n")
    ).select(
        "firm_id",
        "id",
        "created_at",
        X.trim_blanks(F.lower("_n.name")).alias("pattern"),
        "_n.points",
    )
    # Read for the automaton and again for the points.
    names = written(names.where(F.length("pattern") >= 3), "names")
    pairs = word_matches(names.select("firm_id", "pattern").distinct(), texts, "request_id")
    # Texts that hold the same names have the same answer: it is put together once
    # and meets the requests as a whole.
    held = written(
        pairs.groupBy(*REQUEST).agg(F.sort_array(F.collect_set("pattern")).alias("_held")),
        "held",
    )
    # Written: the numbers differ from run to run.
    sets = written(
        held.select("firm_id", "_held").distinct().withColumn(
            "_set", F.monotonically_increasing_id()
        ),
        "sets",
    )
    scores = (
        sets.select("firm_id", "_set", F.explode("_held").alias("pattern"))
        .join(names, ["firm_id", "pattern"])
        .groupBy("_set", "id", "created_at")
        .agg(F.sum("points").alias("score"))
    )
    # Best first in ascending order: missing times count as newest.
    age = -F.unix_micros(F.col("created_at").cast("timestamp"))
    order = [-F.col("score"), age, F.col("id")]
    k = None if alternatives is None else 1 + alternatives
    asked = held.join(sets, ["firm_id", "_held"]).drop("_held")
    return _without_document(asked.join(_ids_in_order(scores, ["_set"], order, k), "_set"), 4)


def resolve_documents(
    hints: DataFrame,
    documents: DataFrame,
    matters: DataFrame,
    literal: bool = False,
    k: int | None = None,
    alternatives: int | None = None,
    hint_chars: int | None = None,
) -> DataFrame:
    """The cascade: one answer per request, ``none`` where no step hits.

    ``k``, ``alternatives`` and ``hint_chars`` are handed to the steps; without
    them nothing is left out.  Each step's answers are written once to the shared folder: the later steps
    and the final union read them, instead of computing the step again.
    """
    answers = written(by_office_id(hints, documents, matters), "step1")
    steps = (
        lambda rest: by_document_name(rest, documents, matters, literal, k, alternatives),
        lambda rest: by_matter_name(rest, matters, k, hint_chars),
        lambda rest: by_names_in_hint(rest, matters, alternatives=alternatives),
    )
    for n, step in enumerate(steps, start=2):
        rest = hints.join(answers.select(*REQUEST), list(REQUEST), "left_anti")
        answers = answers.unionByName(written(step(rest), f"step{n}"))
    asked = hints.select(*REQUEST)
    twice = asked.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    if twice.isEmpty():
        # Answers with long lists are not shuffled once more.
        none = asked.join(answers.select(*REQUEST), list(REQUEST), "left_anti")
        each = answers.unionByName(none, allowMissingColumns=True)
    else:
        each = asked.join(answers, list(REQUEST), "left")
    return each.select(
        "request_id",
        "firm_id",
        F.coalesce("step", F.lit(0)).alias("step"),
        "matter_id",
        "document_id",
        "document_name_found",
        F.coalesce("is_precedent", F.lit(False)).alias("is_precedent"),
        F.coalesce("alternatives", _no_alternatives()).alias("alternatives"),
        F.coalesce("confidence", F.lit("none")).alias("confidence"),
    )


def outcomes(answers: DataFrame) -> DataFrame:
    """Adds ``result``: ``precedent_only``, ``unknown`` or ``matched``."""
    no_matter = F.col("matter_id").isNull()
    return answers.withColumn(
        "result",
        F.when(F.col("is_precedent") & no_matter, "precedent_only")
        .when(no_matter & (F.size("alternatives") == 0), "unknown")
        .otherwise("matched"),
    )
