"""What the byte decoders share: errors as data, a checked reader, and vectorised wrappers.

A decoder is a plain function of bytes. It returns Python values that fit a Spark schema, and raises ``Bad`` with a
kind and a byte offset for input that is not what it should be. ``decoder`` wraps one as an Arrow-batched function
of a binary column that returns struct(value, error): malformed input is data, never a failed task.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 64
ERROR = "error struct<kind:string,offset:bigint>"


class Bad(Exception):
    """Malformed input: kind and byte offset."""

    def __init__(self, kind: str, offset: int):
        super().__init__(f"{kind} at {offset}")
        self.kind, self.offset = kind, offset

    def row(self) -> dict[str, Any]:
        return {"kind": self.kind, "offset": self.offset}


class Reader:
    """A cursor over bytes that never reads past their end."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.data)

    @property
    def left(self) -> int:
        return len(self.data) - self.at

    def take(self, n: int) -> bytes:
        if n < 0 or n > self.left:
            raise Bad("UnexpectedEof", self.at)
        self.at += n
        return self.data[self.at - n : self.at]

    def slice(self, at: int, n: int) -> bytes:
        if at > len(self.data):
            raise Bad("BadOffset", at)
        if n < 0 or at + n > len(self.data):
            raise Bad("UnexpectedEof", at)
        return self.data[at : at + n]

    def number(self, code: str) -> int | float:
        size = struct.calcsize(code)
        return struct.unpack(code, self.take(size))[0]

    def u8(self) -> int:
        return self.take(1)[0]

    def u16(self) -> int:
        return self.number("<H")

    def u32(self) -> int:
        return self.number("<I")

    def i32(self) -> int:
        return self.number("<i")

    def u64(self) -> int:
        return self.number("<Q")

    def count(self, n: int, stride: int) -> None:
        """That so many records of a size can be there at all."""
        if n * stride > self.left:
            raise Bad("UnexpectedEof", self.at)

    def cstr(self) -> bytes:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Bad("UnexpectedEof", self.at)
        out = self.data[self.at : end]
        self.at = end + 1
        return out

    def wide_cstr(self) -> bytes:
        """Bytes up to a 16-bit NUL."""
        for i in range(self.at, len(self.data) - 1, 2):
            if self.data[i] == 0 and self.data[i + 1] == 0:
                out = self.data[self.at : i]
                self.at = i + 2
                return out
        raise Bad("UnexpectedEof", self.at)

    def guid(self) -> bytes:
        return self.take(16)


def guid_text(g: bytes | None) -> str | None:
    if g is None:
        return None
    a, b, c = struct.unpack("<IHH", g[:8])
    return f"{{{a:08X}-{b:04X}-{c:04X}-{g[8:10].hex().upper()}-{g[10:].hex().upper()}}}"


def utf16_lossy(b: bytes) -> str:
    """Up to the first malformed unit, which becomes one U+FFFD: nothing after it is read."""
    try:
        return b.decode("utf-16-le")
    except UnicodeDecodeError as e:
        return b[: e.start].decode("utf-16-le") + "\ufffd"


def utf16_strict(b: bytes, at: int = 0) -> str:
    try:
        return b.decode("utf-16-le")
    except UnicodeDecodeError as e:
        raise Bad("InvalidUtf16", at + e.start) from None


def utf8_strict(b: bytes, at: int = 0) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError as e:
        raise Bad("InvalidUtf8", at + e.start) from None


#: Rows and bytes of a batch that are Python values at once: batches hold thousands of rows, values many times a row's bytes.
PIECE_ROWS, PIECE_BYTES = 256, 1 << 20


def pieces(rows: int, size: int) -> Iterator[tuple[int, int]]:
    """Start and length of the pieces of so many rows of so many bytes in all."""
    step = max(1, min(PIECE_ROWS, PIECE_BYTES * rows // max(size, 1)))
    return ((i, min(step, rows - i)) for i in range(0, rows, step))


def records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict[str, Any]]]:
    """Rows of Arrow batches as dictionaries, a piece at a time."""
    for b in batches:
        for i, n in pieces(b.num_rows, b.nbytes):
            yield b.slice(i, n).to_pylist()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by keys over as many tasks as a shuffle has. A small file is read by one task, however much work
    its rows make; do this to its columns before that work.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_pieces(f: Callable[..., Any], kind: Any, columns: tuple[pa.Array, ...]) -> pa.Array:
    """``f`` of each row of Arrow columns, a piece of the rows at a time. A batch's memory goes back to the system with
    its end: a worker would keep the most that any batch took.
    """
    done = []
    for i, n in pieces(len(columns[0]), sum(c.nbytes for c in columns)):
        values = [c.slice(i, n).to_pylist() for c in columns]
        done.append(pa.array([f(*r) for r in zip(*values, strict=True)], kind))
    whole = pa.concat_arrays(done) if done else pa.array([], kind)
    done.clear()
    pa.default_memory_pool().release_unused()
    return whole


def arrow_function(f: Callable[..., Any], schema: str) -> Callable[..., Column]:
    """``f`` over columns as an Arrow function of rows; made when first used."""
    made: list = []

    def column(*args: Column | str) -> Column:
        if not made:
            made.append(registrable(f, schema))
        return made[0](*[F.col(a) if isinstance(a, str) else a for a in args])

    return column


def registrable(f: Callable[..., Any], schema: str) -> Callable[..., Column]:
    """``f`` of a row as a function that Spark can register."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import DataType

    kind = to_arrow_type(DataType.fromDDL(schema))

    def batch(*columns: pa.Array) -> pa.Array:
        return by_pieces(f, kind, columns)

    return F.arrow_udf(batch, schema)


def decoder(f: Callable[..., Any], value: str) -> Callable[..., Column]:
    """``f`` over the columns given, as struct(value, error). Null input gives a null value and no error."""

    def one(*row: Any) -> dict[str, Any]:
        if row[0] is None:
            return {"value": None, "error": None}
        try:
            return {"value": f(*row), "error": None}
        except Bad as e:
            return {"value": None, "error": e.row()}

    schema = f"value {value}, {ERROR}"
    column = arrow_function(one, schema)
    column.one, column.schema, column.core = one, schema, f  # type: ignore[attr-defined]
    return column


def rows(df: DataFrame, keep: list[str], source: str, f: Callable[[bytes], Iterator[dict[str, Any]]], schema: str) -> DataFrame:
    """One row an element that ``f`` yields from a column, beside the kept columns and the element's position.

    An element's ``Bad`` ends its source's rows with one row of the error alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    inner = _parse_datatype_string(schema)
    kept = StructType([df.schema[c] for c in keep])
    out = StructType([*kept.fields, *_parse_datatype_string("pos int").fields, *inner.fields, *_parse_datatype_string(ERROR).fields])
    arrow = to_arrow_schema(out)
    names = [x.name for x in inner.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in records_of(batches):
            found: list[dict] = []
            for base in part:
                data, at, first = base.pop("_source"), 0, len(found)
                try:
                    for at, x in enumerate(f(data) if data is not None else ()):
                        found.append({**base, "pos": at, **x, "error": None})
                except Bad as e:
                    found.append({**base, "pos": at + 1 if len(found) > first else 0, **dict.fromkeys(names), "error": e.row()})
                if len(found) > 5_000:
                    yield pa.RecordBatch.from_pylist(found, arrow)
                    found = []
            yield pa.RecordBatch.from_pylist(found, arrow)

    return df.select(*keep, F.col(source).alias("_source")).mapInArrow(run, out)
