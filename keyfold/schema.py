"""Row schemas of the data model and the errors of the API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE, PUT = 0, 1
#: Largest sequence number: 56 bits.
MAX_SEQUENCE = (1 << 56) - 1
LEVELS = 3

_B, _L, _I, _S = T.BinaryType(), T.LongType(), T.IntegerType(), T.StringType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


PAIR = _struct(key=_B, value=_B)
#: A version of a key: ``op`` 1 puts ``value``, 0 deletes.
MUTATION = _struct(region_id=_L, cf=_S, key=_B, seq=_L, op=T.ByteType(), value=_B)
BATCH = _struct(batch_id=_L, pos=_I, op=T.ByteType(), cf=_S, key=_B, value=_B)
TABLE_META = _struct(level=_I, ord=_L, number=_L, file_size=_L, smallest=_B, largest=_B)
REGION = _struct(region_id=_L, start_key=_B, end_key=_B, peers=T.ArrayType(_L), leader=_L)
ENTRY = _struct(region_id=_L, idx=_L, term=_L, data=_B)
HARD_STATE = _struct(region_id=_L, term=_L, vote=_L, commit_index=_L)
PROGRESS = _struct(region_id=_L, peer=_L, match_idx=_L, next_idx=_L)
REGION_SNAPSHOT = _struct(region_id=_L, idx=_L, term=_L, kvs=T.ArrayType(_struct(cf=_S, key=_B, value=_B)))
MESSAGE = _struct(
    msg_type=_S, from_node=_L, to_node=_L, term=_L, log_term=_L, log_index=_L, commit_index=_L, reject=T.BooleanType(),
    read_id=_L, region_id=_L, entries=T.ArrayType(_struct(term=_L, idx=_L, data=_B)),
)


class StoreError(Exception):
    """Base of all errors; ``code`` names the status."""

    code = "unknown"


class NotFound(StoreError):
    code = "not_found"


class AlreadyExists(StoreError):
    code = "already_exists"


class InvalidArgument(StoreError):
    code = "invalid_argument"


class StorageIOError(StoreError):
    code = "io_error"


class Corruption(StoreError):
    code = "corruption"


class Busy(StoreError):
    code = "busy"


class NotSupported(StoreError):
    code = "not_supported"


def checked_u64(df: DataFrame, *columns: str) -> DataFrame:
    """Fail at run time where a column that stands for an unsigned number is negative."""
    for c in columns:
        ok: Column = F.when(F.col(c) >= 0, F.col(c)).when(F.col(c).isNull(), F.col(c))
        df = df.withColumn(c, ok.otherwise(F.raise_error(F.lit(f"{c} is out of the range 0 .. 2^63-1")).cast("bigint")))
    return df
