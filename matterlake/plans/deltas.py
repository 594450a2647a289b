"""A keyed table as bucketed layers: written in proportion to a change, merged
on read.

A version adds one layer: a folder with a file set per touched bucket.  The
version's manifest names the layers of every bucket.  Readers merge the layers
of a bucket, the newest row of a key wins; a bucket with one layer is read as it
is.  A touched bucket with ``depth`` layers is merged into a new one instead of
getting another, so a row is rewritten once in ``depth`` touches of its bucket.
An empty marker file names each complete version: the newest is found from a
listing of a few names.  Nothing is changed in place; a version that is written
again gives the same rows.
"""

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matterlake.plans.skew import top_per_group

BUCKETS = 64
DEPTH = 8

_BUCKET = "_bucket"
_VERSION = "_version"
# Version of a bucket's layer, per bucket.
Layers = dict[int, list[int]]


@dataclass(frozen=True)
class Layout:
    """Where a table lies and how it is cut; the same for all its versions.

    ``bucket_by`` must be a function of a row's ``key`` that never changes, or
    part of what a row keeps for good.
    """

    path: str
    schema: T.StructType
    key: tuple[str, ...]
    bucket_by: tuple[str, ...]
    buckets: int = BUCKETS
    depth: int = DEPTH
    # Complete versions whose markers stay; at least the newest and the one before.
    markers: int = field(default=10)

    def bucket(self, columns: Iterable[str] | None = None) -> Column:
        named = tuple(columns or self.bucket_by)
        return F.pmod(F.xxhash64(*named), F.lit(self.buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _marked(spark: SparkSession, layout: Layout) -> list[int]:
    fs, place = _folder(spark, f"{layout.path}/versions")
    if not fs.exists(place):
        return []
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(place))


def _mark(spark: SparkSession, layout: Layout, version: int) -> None:
    fs, place = _folder(spark, f"{layout.path}/versions/{version}")
    fs.create(place, True).close()
    for old in _marked(spark, layout)[: -max(2, layout.markers)]:
        fs.delete(_folder(spark, f"{layout.path}/versions/{old}")[1], False)


def has_version(spark: SparkSession, layout: Layout) -> bool:
    return bool(_marked(spark, layout))


def newest_version(spark: SparkSession, layout: Layout) -> int:
    """The newest complete version."""
    return _marked(spark, layout)[-1]


def layers(spark: SparkSession, layout: Layout, version: int) -> Layers:
    """The manifest: at most ``buckets`` times ``depth`` pairs of numbers."""
    rows = spark.read.schema(f"{_BUCKET} int, {_VERSION} long").parquet(
        f"{layout.path}/manifest/version={version}"
    )
    found: Layers = {}
    for bucket, layer in rows.collect():
        found.setdefault(bucket, []).append(layer)
    return {b: sorted(v) for b, v in found.items()}


def _write_layer(rows: DataFrame, layout: Layout, version: int, mode: str) -> None:
    # Rebalancing cuts a bucket that holds much of the rows over several tasks.
    (
        rows.hint("rebalance", _BUCKET)
        .write.mode(mode)
        .partitionBy(_BUCKET)
        .parquet(f"{layout.path}/data/{_VERSION}={version}")
    )


def _read_layers(
    spark: SparkSession, layout: Layout, chosen: Iterable[tuple[int, int]]
) -> DataFrame:
    """Rows of the (bucket, version) folders given, with both numbers."""
    root = f"{layout.path}/data"
    wide = T.StructType(
        [
            *layout.schema.fields,
            T.StructField(_VERSION, T.LongType()),
            T.StructField(_BUCKET, T.IntegerType()),
        ]
    )
    paths = [f"{root}/{_VERSION}={v}/{_BUCKET}={b}" for b, v in chosen]
    if not paths:
        return spark.createDataFrame([], wide)
    return spark.read.schema(wide).option("basePath", root).parquet(*paths)


def _merged(spark: SparkSession, layout: Layout, held: Layers) -> DataFrame:
    """The newest row of each key in the given layers, with its bucket."""
    single = [(b, v[0]) for b, v in held.items() if len(v) == 1]
    several = [(b, x) for b, v in held.items() if len(v) > 1 for x in v]
    plain = _read_layers(spark, layout, single)
    if not several:
        return plain.drop(_VERSION)
    newest = [F.col(_VERSION).desc()]
    merged = top_per_group(_read_layers(spark, layout, several), layout.key, newest, 1)
    return plain.unionByName(merged.drop("rank")).drop(_VERSION)


def read(
    spark: SparkSession,
    layout: Layout,
    version: int | None = None,
    buckets: Sequence[int] | None = None,
) -> DataFrame:
    """The table at a version (default: the newest), or only some buckets."""
    at = newest_version(spark, layout) if version is None else version
    held = layers(spark, layout, at)
    if buckets is not None:
        held = {b: held[b] for b in buckets if b in held}
    return _merged(spark, layout, held).select(*layout.schema.names)


def _seal(spark: SparkSession, layout: Layout, version: int, held: Layers) -> None:
    pairs = [(b, v) for b, vs in sorted(held.items()) for v in vs]
    spark.createDataFrame(pairs, f"{_BUCKET} int, {_VERSION} long").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{layout.path}/manifest/version={version}")
    _mark(spark, layout, version)


def touched_buckets(rows: DataFrame, layout: Layout) -> list[int]:
    """The buckets that ``rows`` fall in: no more numbers than there are."""
    found = rows.select(layout.bucket().alias(_BUCKET)).distinct().collect()
    return sorted(r[0] for r in found)


def create(rows: DataFrame, layout: Layout) -> None:
    """Version 0 with ``rows``, keys being distinct."""
    spark = rows.sparkSession
    bucketed = rows.select(*layout.schema.names, layout.bucket().alias(_BUCKET))
    _write_layer(bucketed, layout, 0, "overwrite")
    found = touched_buckets(rows, layout)
    _seal(spark, layout, 0, {b: [0] for b in found})


def commit(changed: DataFrame, layout: Layout, version: int, touched: Sequence[int]) -> None:
    """The version after ``version - 1``: each changed row replaces its key's.

    ``changed`` holds a key once; ``touched`` are the buckets it may fall in.
    """
    spark = changed.sparkSession
    held = layers(spark, layout, version - 1)
    full = [b for b in touched if len(held.get(b, ())) >= layout.depth]
    bucketed = changed.select(*layout.schema.names, layout.bucket().alias(_BUCKET))
    _write_layer(bucketed.where(~F.col(_BUCKET).isin(full)), layout, version, "overwrite")
    if full:
        old, new = F.lit(version - 1).cast("long"), F.lit(version).cast("long")
        both = (
            _merged(spark, layout, {b: held[b] for b in full})
            .withColumn(_VERSION, old)
            .unionByName(bucketed.where(F.col(_BUCKET).isin(full)).withColumn(_VERSION, new))
        )
        kept = top_per_group(both, layout.key, [F.col(_VERSION).desc()], 1)
        _write_layer(kept.drop("rank", _VERSION), layout, version, "append")
    # A bucket may be touched and yet get no row; its folder is then missing.
    fs, place = _folder(spark, f"{layout.path}/data/{_VERSION}={version}")
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    got = {int(n.split("=")[1]) for n in names if n.startswith(f"{_BUCKET}=")}
    after = dict(held)
    for b in got:
        after[b] = [version] if b in full else [*held.get(b, ()), version]
    _seal(spark, layout, version, after)


def expire(spark: SparkSession, layout: Layout, keep: int = 2) -> int:
    """Delete layers that none of the newest ``keep`` versions names.

    Returns the number of bucket folders deleted.
    """
    marked = _marked(spark, layout)
    kept = marked[-keep:]
    used = {
        (b, v) for at in kept for b, vs in layers(spark, layout, at).items() for v in vs
    }
    gone = 0
    fs, root = _folder(spark, f"{layout.path}/data")
    for layer in fs.listStatus(root):
        number = layer.getPath().getName()
        if not number.startswith(f"{_VERSION}=") or int(number.split("=")[1]) > kept[-1]:
            continue
        for bucket in fs.listStatus(layer.getPath()):
            name = bucket.getPath().getName()
            if not name.startswith(f"{_BUCKET}="):
                continue
            if (int(name.split("=")[1]), int(number.split("=")[1])) not in used:
                fs.delete(bucket.getPath(), True)
                gone += 1
    return gone
