"""Chunking, embedding and position extraction over whole tables."""

import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.functions import mentions
from matterlake.functions import text as X
from matterlake.functions.chunking import chunk_text
from matterlake.functions.models import EmbedFn, ExtractFn, embed_batch
from matterlake.plans.storage import small_batches

_CHUNKS = "array<struct<text:string,start_offset:int,end_offset:int>>"
_VECTOR = "struct<embedding:array<float>,tokens:int,error:string>"
_POSITION = (
    "struct<clause_type:string,value:string,status:string,counterparty_name:string,"
    "party_role:string,source_chunk_text:string,confidence:string>"
)
_EXTRACT = (
    f"struct<positions:array<{_POSITION}>,input_tokens:int,output_tokens:int,"
    "error:string>"
)
_POSITION_FIELDS = (
    "clause_type",
    "value",
    "status",
    "counterparty_name",
    "party_role",
    "source_chunk_text",
    "confidence",
)
RULES_MODEL = "rules"
_MENTIONS = "array<struct<rule:int,mention:string,excerpt:string>>"
# Characters of an excerpt around the start of its mention.
EXCERPT_BEFORE = 100
EXCERPT_AFTER = 200
# Characters of the texts whose results a worker holds at a time.
PIECE_CHARS = 1 << 19


def pieces(batch: pd.Series, most: int = PIECE_CHARS) -> Iterator[pd.Series]:
    """The batch in runs of rows of about ``most`` characters, a longer text alone.

    Results take many times the room of their texts, so they are handed on run by
    run and not for a whole batch at once.
    """
    start, held = 0, 0
    for at, text in enumerate(batch):
        n = len(text or "")
        if at > start and held + n > most:
            yield batch.iloc[start:at]
            start, held = at, 0
        held += n
    if start < len(batch):
        yield batch.iloc[start:]


def _chunks_of(lossy: bool):
    @F.pandas_udf(_CHUNKS)
    def chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names = ("text", "start_offset", "end_offset")
        for batch in batches:
            for piece in pieces(batch):
                yield pd.Series(
                    [
                        [dict(zip(names, c)) for c in chunk_text(text or "", lossy)]
                        for text in piece
                    ],
                    dtype=object,
                )

    return chunks


def chunk_documents(
    docs: DataFrame, content: str = "content", lossy: bool = False
) -> DataFrame:
    """One row per chunk: other columns, chunk_index, text, offsets.

    Each document is packed by itself, so the work splits by rows; only the
    text column goes through the Python worker.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c != content]
    return docs.select(
        *others, F.posexplode(_chunks_of(lossy)(F.col(content))).alias("chunk_index", "_c")
    ).select(*others, "chunk_index", "_c.*")


def embed(
    df: DataFrame,
    embed_fn: EmbedFn,
    text: str = "text",
    batch: int = S.EMBED_BATCH,
    attempts: int = S.EMBED_ATTEMPTS,
) -> DataFrame:
    """Adds ``embedding``, ``tokens`` and ``embed_error`` to every row."""

    @F.pandas_udf(_VECTOR)
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts = [t or "" for t in series]
            for at in range(0, len(texts), batch):
                rows = embed_batch(texts[at : at + batch], embed_fn, attempts)
                yield pd.DataFrame(rows, columns=["embedding", "tokens", "error"])

    small_batches(df.sparkSession)
    return df.withColumn("_v", vectors(F.col(text))).select(
        *df.columns,
        F.col("_v.embedding").alias("embedding"),
        F.col("_v.tokens").alias("tokens"),
        F.col("_v.error").alias("embed_error"),
    )


def token_usage(embedded: DataFrame, keys: list[str]) -> DataFrame:
    """Texts, tokens and the rounded-up share per text, per key."""
    return embedded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_texts"),
        F.sum("tokens").alias("total_tokens"),
        F.ceil(F.sum("tokens") / F.count(F.lit(1))).cast("long").alias("token_share"),
    )


def default_rules() -> dict[str, str]:
    """One phrase pattern per clause of the vocabulary."""
    return {c: c.replace("_", "[ _-]") for c in S.CLAUSE_TYPES}


def with_rule_positions(
    docs: DataFrame,
    content: str,
    rules: Mapping[str, str],
    first_only: bool = False,
    before: int = EXCERPT_BEFORE,
    after: int = EXCERPT_AFTER,
) -> DataFrame:
    """Adds ``positions``: one per mention of a clause, in the order of places.

    A mention is a match of the clause's pattern as a word; mentions of one
    clause do not overlap, those of different clauses may.  With ``first_only``
    a clause gives its first mention, in the order of the rules.  Null and empty
    texts have none.  All rules are matched in one pass over the text.
    """
    small_batches(docs.sparkSession)
    find = _mention_finder(list(rules.values()), first_only, before, after)
    clauses = F.array(*[F.lit(c) for c in rules])
    positions = F.transform(
        find(F.coalesce(F.col(content), F.lit(""))),
        lambda m: F.struct(
            F.element_at(clauses, m["rule"]).alias("clause_type"),
            F.to_json(F.struct(m["mention"].alias("mention"))).alias("value"),
            F.lit("proposed").alias("status"),
            F.lit(None).cast("string").alias("counterparty_name"),
            F.lit("neutral").alias("party_role"),
            m["excerpt"].alias("source_chunk_text"),
            F.lit("0.5").alias("confidence"),
        ),
    )
    return docs.withColumn("positions", positions.cast(f"array<{_POSITION}>"))


def _mention_finder(patterns: list[str], first_only: bool, before: int, after: int):
    rule = mentions.compiled(patterns)

    @F.pandas_udf(_MENTIONS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            for piece in pieces(batch):
                out = []
                for text in piece:
                    places = rule.first_places(text) if first_only else rule.places(text)
                    out.append(
                        mentions.excerpts(text, places, before, after, apart=not first_only)
                    )
                yield pd.Series(out, dtype=object)

    return find


def _extract_with(extract_fn: ExtractFn):
    def shown(v) -> str | None:
        if v is None or isinstance(v, str):
            return v
        if isinstance(v, (dict, list)):
            return json.dumps(v)
        return str(v)

    def one(text: str) -> tuple:
        try:
            positions, tokens_in, tokens_out = extract_fn(text)
        except Exception as e:  # isolated: the row carries the error
            return None, None, None, str(e) or type(e).__name__
        rows = [{f: shown(p.get(f)) for f in _POSITION_FIELDS} for p in positions]
        return rows, tokens_in, tokens_out, None

    @F.pandas_udf(_EXTRACT)
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = ["positions", "input_tokens", "output_tokens", "error"]
        for batch in batches:
            for piece in pieces(batch):
                yield pd.DataFrame([one(t or "") for t in piece], columns=names)

    return extract


def extract_positions(
    docs: DataFrame,
    extract_fn: ExtractFn | None = None,
    content: str = "content",
    context: Mapping[str, str] | None = None,
    rules: Mapping[str, str] | None = None,
    first_only: bool = False,
) -> DataFrame:
    """One row per document with ``positions``, token usage and ``error``.

    ``extract_fn`` gets the document text after its known context (columns
    named in ``context``: matter, client, side, kind).  Without it the rules
    find every mention, or the first of each clause.  The content itself is not
    carried on.
    """
    others = [F.col(c) for c in docs.columns if c != content]
    if extract_fn is None:
        return with_rule_positions(
            docs, content, rules or default_rules(), first_only
        ).select(
            *others,
            "positions",
            X.approx_tokens(F.col(content)).alias("input_tokens"),
            F.lit(0).alias("output_tokens"),
            F.lit(None).cast("string").alias("error"),
        )
    small_batches(docs.sparkSession)
    named = context or {}
    parts = [
        F.col(named[n]) if n in named else F.lit(None).cast("string")
        for n in ("matter", "client", "side", "kind")
    ]
    prompt = X.context_block(*parts, F.col(content))
    return docs.withColumn("_x", _extract_with(extract_fn)(prompt)).select(
        *others,
        F.col("_x.positions").alias("positions"),
        F.col("_x.input_tokens").alias("input_tokens"),
        F.col("_x.output_tokens").alias("output_tokens"),
        F.col("_x.error").alias("error"),
    )


def exploded_positions(extracted: DataFrame) -> DataFrame:
    """One row per position; ``seq`` is its place in the document's list."""
    others = [
        c
        for c in extracted.columns
        if c not in ("positions", "input_tokens", "output_tokens", "error")
    ]
    # The outer form: for the inner one Catalyst derives a filter on the array's
    # size, which would run the whole extraction a second time under the scan.
    return (
        extracted.select(*others, F.posexplode_outer("positions").alias("seq", "_p"))
        .where(F.col("seq").isNotNull())
        .select(*others, "seq", "_p.*")
    )


def extraction_errors(extracted: DataFrame) -> DataFrame:
    """The documents whose extraction failed, with ``error``.

    What ``exploded_positions`` leaves out: a document without positions is in
    neither, a failed one is here.
    """
    return extracted.where(F.col("error").isNotNull()).drop(
        "positions", "input_tokens", "output_tokens"
    )
