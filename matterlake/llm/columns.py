"""Exact choice of columns from tables with extra or clashing names."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns named in ``wanted``, each cast to the type given there.

    Names are matched exactly first, so ``Text`` beside ``text`` does not make
    the choice ambiguous; of two equal names the first counts.
    """
    have = df.columns
    lower = [c.lower() for c in have]
    places = df.toDF(*[f"_c{i}" for i in range(len(have))])

    def at(name: str) -> int:
        return have.index(name) if name in have else lower.index(name.lower())

    return places.select(
        *[F.col(f"_c{at(name)}").cast(kind).alias(name) for name, kind in wanted.items()]
    )


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))
