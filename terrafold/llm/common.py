"""What the text operators share: ASCII rules, carried rows, Arrow mapping and per-worker caches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Fixed value: the white space that the operators know, [\x20\x09-\x0D].
WHITE = "[\\x20\\x09-\\x0D]"
NOT_WHITE = "[^\\x20\\x09-\\x0D]"
NO_ID = 2**63 - 1
TEXTS_PER_CALL = 256

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def whole_text(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def order_id(col: str = "doc_id") -> Column:
    """The id for comparisons; a null id is the largest of all."""
    return F.coalesce(F.col(col).cast("bigint"), F.lit(NO_ID))


def hash128(*cols: Column) -> list[Column]:
    """Two 64-bit hashes with different seeds: together a 128-bit content hash."""
    return [F.xxhash64(*cols).alias("h1"), F.xxhash64(F.lit(1), *cols).alias("h2")]


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's digits modulo 5; fold 0 is held out. A null id is held out too."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def carried(docs: DataFrame, leave: Iterable[str] = ()) -> Column:
    """All columns as one struct, so that an operator's own names never clash with them."""
    gone = {c.lower() for c in leave}
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in gone]
    return (F.struct(*kept) if kept else F.struct(F.lit(None).cast("int").alias("__none"))).alias("row")


def uncarried(docs: DataFrame, added: dict[str, Column]) -> list[Column]:
    """The columns of ``docs`` out of ``row``; ``added`` replaces columns of the same name and follows."""
    mine = {c.lower(): c for c in added}
    old = [added[mine[c.lower()]].alias(c) if c.lower() in mine else F.col(f"row.`{c}`") for c in docs.columns]
    have = {c.lower() for c in docs.columns}
    return old + [v.alias(k) for k, v in added.items() if k.lower() not in have]


def per_worker(kind: str, key: Any, make: Callable[[], Any]) -> Any:
    """Build once per Python worker; a new key replaces the old value, so one value of a kind is held."""
    name = "__terrafold_worker__"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("held", {})
    if kind not in held or held[kind][0] != key:
        held[kind] = (key, make())
    return held[kind][1]


def map_texts(df: DataFrame, start: Callable[[], Callable[[list], list]], fields: str, drop_text: bool = True) -> DataFrame:
    """Add columns computed from ``text`` in Python: ``start()`` runs once per task and gives the function
    from a list of texts (null stays None) to one list per new column. At most TEXTS_PER_CALL texts are Python
    objects at a time, whatever the Arrow batch size."""
    new = T._parse_datatype_string(fields)
    keep = [f for f in df.schema.fields if not (drop_text and f.name == "text")]
    schema = T.StructType(keep + new.fields)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = start()
        for batch in batches:
            at = batch.schema.names.index("text")
            for lo in range(0, batch.num_rows, TEXTS_PER_CALL):
                part = batch.slice(lo, TEXTS_PER_CALL)
                out = call(part.column(at).to_pylist())
                old = [part.column(i) for i in range(part.num_columns) if not (drop_text and i == at)]
                made = [pa.array(v, type=t) for v, t in zip(out, kinds)]
                yield pa.RecordBatch.from_arrays(old + made, names=schema.names)

    return df.mapInArrow(run, schema)
