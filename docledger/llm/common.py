"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the white space that separates words.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    """Number of those runs, counted without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{SPACE}]+")), F.lit(0)).cast("bigint")


def settled(value: Column) -> Column:
    """``value``, computed in the projection that names it and nowhere else.

    Catalyst moves conditions below a projection by writing its expressions out in them; inside a
    lambda an array would then be built anew for each element. A look at the task's partition number,
    which always passes, marks the projection as one that conditions stay above.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def private(df: DataFrame) -> DataFrame:
    """``df`` with its columns under names that no operator uses; see :func:`public`."""
    return df.toDF(*(own(name) for name in df.columns))


def own(name: str) -> str:
    """What ``name`` is called after :func:`private`."""
    return f"_own_{name}"


def public(df: DataFrame, names: list[str], results: tuple[str, ...] = ()) -> DataFrame:
    """The columns that were ``names`` before :func:`private`, then ``results``, and nothing else."""
    return df.select(*(f"`{own(name)}`" for name in names), *results).toDF(*names, *results)


def keep_columns(df: DataFrame, taken: set[str]) -> list[str]:
    """Columns of ``df`` that do not clash with the names an operator is about to add."""
    return [name for name in df.columns if name not in taken]
