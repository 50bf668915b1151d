"""Small frames with declared schemas, and rows back as plain tuples."""

from datetime import datetime
from decimal import Decimal

from fleetgauge.sources import schemas


def ts(text):
    return datetime.fromisoformat(text)


def dec(text):
    return None if text is None else Decimal(text)


def table(spark, name, *rows):
    """Rows given as dicts; columns left out are NULL."""
    schema = schemas.TABLES.get(name) or getattr(schemas, name)
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def one(spark, column_builder, values, schema):
    """``column_builder(col)`` over a list of values, in order."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {schema}")
    return [r[1] for r in df.select("i", column_builder(F.col("v"))).orderBy("i").collect()]
