"""Helpers shared by the corpus operators: reading tables, adding columns from
Arrow batches, written intermediates in the shared folder, plain words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankcast.session import checkpoint_dir, ship_package

#: Rows of one Arrow batch handled at once by the Python side of an operator.
SLICE_ROWS = 1024

# ASCII letters lower-cased; every ASCII byte that is no letter or digit turned
# into a blank; bytes of other characters kept.
WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A
    else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text after lower-casing A-Z."""
    return text.encode().translate(WORD_BYTES).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without the columns called like one of ``names`` (any case)."""
    low = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in low])


def free_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores behind it as make it new to ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def add_columns(df: DataFrame, inputs: Sequence[str], fields: Sequence[T.StructField],
                fn: Callable[..., Sequence[list]]) -> DataFrame:
    """``df`` with columns computed by ``fn(*lists of input values)``, one list
    per field, over Arrow slices.  A column of ``df`` called like a new field
    is replaced, unless it is an input: then the new one replaces it at the end."""
    spark = df.sparkSession
    ship_package(spark)
    names = [f.name for f in fields]
    low_in, low_out = [c.lower() for c in inputs], {n.lower() for n in names}
    base = without(df, [n for n in names if n.lower() not in low_in])
    at = [[c.lower() for c in base.columns].index(c) for c in low_in]
    kept = [i for i, f in enumerate(base.schema.fields) if f.name.lower() not in low_out]
    schema = T.StructType([base.schema.fields[i] for i in kept] + list(fields))
    from pyspark.sql.pandas.types import to_arrow_type
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(lo, SLICE_ROWS)
                out = fn(*(part.column(i).to_pylist() for i in at))
                yield pa.RecordBatch.from_arrays(
                    [part.column(i) for i in kept]
                    + [pa.array(v, type=k) for v, k in zip(out, kinds)],
                    names=schema.names)

    return base.mapInArrow(run, schema)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared checkpoint folder and read
    back: a lineage cut that survives lost executors.  The files stay until the
    owner of that folder clears it."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread_back(df: DataFrame, keys: Sequence[str], salt: str, values: dict) -> DataFrame:
    """Aggregates of each key, repeated for every (key, salt) of ``df``, for a
    join back on both that no frequent key crowds.  ``values`` names pairs of an
    aggregate that combines with itself (min, max, sum) and its column."""
    parts = df.groupBy(*keys, salt).agg(*[fn(c).alias(n) for n, (fn, c) in values.items()])
    whole = parts.groupBy(*keys).agg(*[fn(n).alias(n) for n, (fn, _) in values.items()])
    return parts.select(*keys, salt).join(whole, list(keys))
