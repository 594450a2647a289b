"""Which texts hold which names as words: one automaton run per text.

The names of a tenant become an Aho-Corasick automaton, and each text is read
once, letter by letter, whatever the number of names and however common their
words are.  Texts are neither cut into words nor shuffled.

Names travel in blocks whose letters are counted first, so an automaton has a
bounded size; blocks follow the tenants, and a block reads its tenants' texts
only.  A tenant with more names than a block holds has its texts read once per
block.
"""

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake.plans.storage import written

# An automaton takes some tens of bytes per letter.
BLOCK_LETTERS = 1_000_000
PUSHED_TENANTS = 500

# Letters of ASCII words; a name begins and ends where one side is a word
# letter and the other is not.
_WORD = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_")


def _is_boundary(text: str, at: int) -> bool:
    before = at > 0 and text[at - 1] in _WORD
    after = at < len(text) and text[at] in _WORD
    return before != after


def _automaton(names: list[str]) -> ahocorasick.Automaton:
    built = ahocorasick.Automaton()
    for name in names:
        built.add_word(name, name)
    built.make_automaton()
    return built


def names_in(automaton: ahocorasick.Automaton, text: str) -> list[str]:
    """The names that occur in ``text`` between word boundaries, sorted."""
    found = set()
    for last, name in automaton.iter(text):
        if name in found:
            continue
        if _is_boundary(text, last + 1) and _is_boundary(text, last + 1 - len(name)):
            found.add(name)
    return sorted(found)


def _name_blocks(names: DataFrame, tenant: str, most: int) -> Iterator[dict[str, list[str]]]:
    """Names per tenant, at most about ``most`` letters at a time."""
    letters = names.agg(F.sum(F.length("pattern"))).first()[0] or 0
    if not letters:
        return
    if letters > most:
        # Written: range bounds are sampled, a second run could cut elsewhere.
        names = written(
            names.repartitionByRange(-(-letters // most), tenant, "pattern").withColumn(
                "_block", F.spark_partition_id()
            ),
            "name-blocks",
        )
        blocks = sorted(r[0] for r in names.select("_block").distinct().collect())
        parts = [names.where(F.col("_block") == b) for b in blocks]
    else:
        parts = [names]
    for part in parts:
        held: dict[str, list[str]] = {}
        for owner, name in part.select(tenant, "pattern").collect():
            held.setdefault(owner, []).append(name)
        yield held


def word_matches(
    names: DataFrame,
    texts: DataFrame,
    text_id: str,
    tenant: str = "firm_id",
    block_letters: int = BLOCK_LETTERS,
) -> DataFrame:
    """(tenant, pattern, text_id) of each name that a text of its tenant holds.

    ``names``: (tenant, pattern), distinct, lower-cased.  ``texts``: (tenant,
    text_id, text); they are lower-cased here.  Null tenants, names and texts
    match nothing.
    """
    spark = texts.sparkSession
    usable = names.where(
        F.col(tenant).isNotNull() & (F.length("pattern") > 0)
    ).select(tenant, "pattern")
    low = texts.where(F.col(tenant).isNotNull() & F.col("text").isNotNull()).select(
        F.col(tenant).alias("tenant"), F.col(text_id).alias("text_id"), F.lower("text").alias("text")
    )
    kind = texts.schema[text_id].dataType.simpleString()
    schema = f"tenant string, pattern string, text_id {kind}"
    hits = spark.createDataFrame([], schema)
    for block in _name_blocks(usable, tenant, block_letters):
        own = low
        if len(block) <= PUSHED_TENANTS:
            # Reaches the scan: other tenants' files are skipped.
            own = own.where(F.col("tenant").isin(sorted(block)))
        held = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            built: dict[str, ahocorasick.Automaton] = {}
            for batch in batches:
                rows = []
                for owner, ident, text in zip(
                    batch["tenant"], batch["text_id"], batch["text"], strict=True
                ):
                    if owner not in held.value:
                        continue
                    if owner not in built:
                        built[owner] = _automaton(held.value[owner])
                    rows += [(owner, n, ident) for n in names_in(built[owner], text)]
                yield pd.DataFrame(rows, columns=["tenant", "pattern", "text_id"])

        # Written block by block, so only one block is held at a time.
        hits = hits.unionByName(written(own.mapInPandas(run, schema), "word-hits"))
    return hits.select(
        F.col("tenant").alias(tenant), "pattern", F.col("text_id").alias(text_id)
    )
