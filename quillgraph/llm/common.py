"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.components import connected_components  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have, whatever its case or extra columns."""
    taken = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name = f"__{base}"
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        names.append(name)
    return names


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def columns(df: DataFrame) -> list[Column]:
    return [col(c) for c in df.columns]


def map_rows(df: DataFrame, run, added: str, dropped: tuple[str, ...] = ()) -> DataFrame:
    """``df.mapInArrow(run, ...)`` for a ``run`` that returns its columns (but ``dropped``) and then those ``added``.

    Columns travel under plain names, since PySpark looks them up by name and
    takes dots for field access.
    """
    plain = [f"c{i}" for i in range(len(df.columns))]
    kept = [(p, f) for p, f in zip(plain, df.schema.fields, strict=True) if f.name not in dropped]
    schema = ", ".join([*[f"{p} {f.dataType.simpleString()}" for p, f in kept], added])
    sent = df.select(*[col(c).alias(p) for c, p in zip(df.columns, plain, strict=True)])
    new = [x.split()[0] for x in added.split(", ")]
    return sent.mapInArrow(run, schema).select(*[F.col(p).alias(f.name) for p, f in kept], *[F.col(n) for n in new])
