"""The registered queries and their equivalent SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from matterlake.workload.standins import frame, table, with_standins

Query = Callable[["Source"], DataFrame]


class Source:
    """Stand-in frames of one data folder, made on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        return frame(self.spark, self.sf_dir, name)

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, uses: str = ""):
    """Register a query; ``uses`` names the stand-ins its SQL needs."""

    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_standins(uses.split(), sql)
        return fn

    return add


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn: Query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(Source(spark, sf_dir))

        return run

    return {name: bind(fn) for name, fn in QUERIES.items()}
