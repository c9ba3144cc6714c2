"""JSON of any shape as VARIANT: parsed once, its schema found by aggregation, its values read with their types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parsed(rows: DataFrame, column: str, name: str = "value") -> DataFrame:
    """`rows` with the JSON of `column` as the variant `name`; null where it is null or broken."""
    return rows.withColumn(name, F.try_parse_json(F.col(column)))


def nested_schema(values: DataFrame, name: str = "value") -> T.DataType:
    """The type that all variants of a column have in common: objects as structs, values of several types as variants.  Types
    are merged in the tasks first; one type goes to the driver, as large as the values are different."""
    told = values.agg(F.schema_of_variant_agg(name).alias("s")).first()["s"]
    return T._parse_datatype_string((told or "VOID").replace("OBJECT<", "STRUCT<"))


def step(name: str) -> str:
    """A field name as a step of a path."""
    return "[" + ("'" + name + "'" if '"' in name else '"' + name + '"') + "]"


def leaves(kind: T.DataType, path: str = "$", names: tuple[str, ...] = ()) -> list[tuple[str, str, T.DataType]]:
    """(column, path, type) of what stands below objects; arrays are one leaf, values known as null only are strings."""
    if isinstance(kind, T.StructType):
        return [leaf for f in kind for leaf in leaves(f.dataType, path + step(f.name), (*names, f.name))]
    return [("_".join(names) or "value", path, _readable(kind))]


def _readable(kind: T.DataType) -> T.DataType:
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_readable(kind.elementType))
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _readable(f.dataType)) for f in kind])
    if isinstance(kind, T.DecimalType) and kind.scale > 0:
        return T.DoubleType()  # how many digits a number happens to have is no type of its own
    if isinstance(kind, T.DecimalType):
        return T.LongType() if kind.precision <= 18 else kind
    return T.StringType() if isinstance(kind, T.NullType) else kind


def typed(values: DataFrame, *keep: str, name: str = "value", schema: T.DataType | None = None) -> DataFrame:
    """(*keep, a column for each leaf of the schema) of variants; without `schema` it is found by a scan of its own.  A value
    that is absent, null or of another type is null."""
    found = leaves(schema or nested_schema(values, name))
    return values.select(*keep, *[F.try_variant_get(name, path, kind.simpleString()).alias(column) for column, path, kind in found])


def entries(values: DataFrame, *keep: str, name: str = "value") -> DataFrame:
    """(*keep, key, entry, kind): the entries of objects as variants, with the type of each; others have none."""
    spark, columns = values.sparkSession, ", ".join(f"`{c}`" for c in keep)
    rows = spark.sql(f"SELECT {columns}, key, entry FROM {{rows}}, LATERAL variant_explode({name}) AS e(pos, key, entry) WHERE key IS NOT NULL", rows=values)
    return rows.withColumn("kind", F.schema_of_variant("entry"))
