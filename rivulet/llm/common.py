"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from rivulet.plans.fixpoint import cut, shared_root

#: Code points that the tokenisers' pattern takes as white space. Fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Rows and bytes of one Arrow batch: what a Python worker holds at once.
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker is handed at once, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def text_of(docs: DataFrame, text: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(docs[text].cast("string"), F.lit(""))


def own_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name = f"_{name}"
    return name


def number_within(df: DataFrame, groups: Sequence[str], order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in the given order, nulls first.

    A group is spread over range partitions; each numbers its own rows and adds
    what stands before it. Equal rows are told apart by an arbitrary salt, so a
    key that repeats in a third of all rows is split as well.
    """
    salt, row, part, first, n, before = (own_name(df, x) for x in ("salt__", "row__", "part__", "first__", "n__", "before__"))
    rows = df.withColumn(salt, F.monotonically_increasing_id())
    rows = rows.repartitionByRange(*groups, *order, salt).sortWithinPartitions(*groups, *order, salt)
    rows = cut(rows.withColumn(row, F.monotonically_increasing_id()).drop(salt)).withColumn(part, F.shiftright(row, 33))
    spans = rows.groupBy(*groups, part).agg(F.min(row).alias(first), F.count("*").alias(n))
    earlier = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn(before, F.coalesce(F.sum(n).over(earlier), F.lit(0))).drop(n)
    out = rows.join(spans, [*groups, part])
    return out.withColumn(name, F.col(row) - F.col(first) + F.col(before)).select(*df.columns, name)


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), the component being its smallest node. Only nodes with an edge appear.

    Alternating large and small stars. A round joins edges with one minimum per
    node; the minimum is combined before the shuffle, and dealt out anew for the join. So both sides of
    the join are plain exchanges, which AQE may split: a hub that holds a third of all edges is not one task.
    """
    dealt = F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("u")  # the same number, but not known to be dealt out already
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    pairs, seen = cut(pairs), None
    for _ in range(max_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.select(dealt, "m"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.select(dealt, "m"), "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        pairs = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), compact=True)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        seen = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def hand_back_memory() -> None:
    """Give what a finished task has freed back to the system: workers are reused, and would keep their largest size for good."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def with_columns_by(df: DataFrame, inputs: Sequence[str], make: Callable[[], Callable[..., Sequence[Sequence]]], fields: Sequence[T.StructField]) -> DataFrame:
    """Add columns that plain Python makes from some input columns, batch by batch.

    `make` runs once per task and gives a function from lists (one per input) to lists (one per
    field). The other columns pass as Arrow arrays, untouched; a column named like a new
    one, whatever its case, is replaced.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new]
    extra = [c for c in inputs if c not in keep]
    source = df.select(*keep, *extra)
    types = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            values = fn(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in inputs])
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep] + [pa.array(v, t) for v, t in zip(values, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *[f.name for f in fields]])
        del fn
        hand_back_memory()

    return source.mapInArrow(run, T.StructType([source.schema[c] for c in keep] + list(fields)))
