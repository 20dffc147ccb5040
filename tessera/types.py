"""Type names of the query dialect and their Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import NotSupported

_NAMES = {
    "BOOLEAN": T.BooleanType(),
    "TINYINT": T.ByteType(),
    "SMALLINT": T.ShortType(),
    "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(),
    "HUGEINT": T.DecimalType(38, 0),
    "FLOAT": T.FloatType(),
    "DOUBLE": T.DoubleType(),
    "VARCHAR": T.StringType(),
    "DATE": T.DateType(),
}
_ALIASES = {"BOOL": "BOOLEAN", "INT1": "TINYINT", "INT2": "SMALLINT", "SHORT": "SMALLINT", "INT": "INTEGER", "INT4": "INTEGER", "SIGNED": "INTEGER", "INT8": "BIGINT", "LONG": "BIGINT", "REAL": "FLOAT", "FLOAT4": "FLOAT", "FLOAT8": "DOUBLE", "TEXT": "VARCHAR", "STRING": "VARCHAR", "CHAR": "VARCHAR"}


def spark_type(name: str) -> T.DataType:
    """The Spark type of a type name, e.g. ``DECIMAL(15,2)``."""
    base, _, args = name.strip().upper().partition("(")
    base = base.strip()
    if base in ("DECIMAL", "NUMERIC"):
        width, scale = ([int(x) for x in args.rstrip(") ").split(",")] + [0])[:2] if args else (18, 3)
        return T.DecimalType(width, scale)
    base = _ALIASES.get(base, base)
    if base not in _NAMES:
        raise NotSupported(f"type {name}")
    return _NAMES[base]


def spark_name(name: str) -> str | None:
    """The type's name in Spark SQL, or None for names Spark knows itself."""
    try:
        return spark_type(name).simpleString().upper()
    except NotSupported:
        return None


def type_name(t: T.DataType) -> str:
    """The dialect's name of a Spark type."""
    if isinstance(t, T.DecimalType):
        return f"DECIMAL({t.precision},{t.scale})"
    for name, kind in _NAMES.items():
        if kind == t:
            return name
    return t.simpleString().upper()


def describe(schema: T.StructType) -> list[tuple[str, str, bool]]:
    return [(f.name, type_name(f.dataType), f.nullable) for f in schema]
