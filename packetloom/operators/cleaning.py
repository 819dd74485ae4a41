"""Cleaning of labelled flow tables and connection tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.lookups import small_side
from packetloom.operators.quantiles import exact_percentiles
from packetloom.vocab import FLOW_TABLE_TYPES

LABEL_NAMES = ["label", "Label", "class", "Class", "attack", "Attack"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def float_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def numeric_text(df: DataFrame, label: str | None = None) -> DataFrame:
    """Text columns whose every value reads as a number become doubles (CSV has no types). One
    pass over the table decides for all columns."""
    text = [c for c, t in df.dtypes if t == "string" and c != label]
    if not text:
        return df
    reads = df.agg(*[F.bool_and(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(c) for c in text]).first()
    return df.withColumns({c: F.col(c).cast("double") for c in text if reads[c]})


def clean_headers(df: DataFrame) -> DataFrame:
    """Column names stripped, spaces as underscores, lower case."""
    return df.toDF(*[c.strip().replace(" ", "_").lower() for c in df.columns])


def find_label_column(columns: list[str], extra: tuple[str, ...] = (), first_as_fallback: bool = False) -> str | None:
    """Exact label names in column order, then names containing ``label`` or ``class``."""
    for c in columns:
        if c in LABEL_NAMES or c.lower() in extra:
            return c
    for c in columns:
        if "label" in c.lower() or "class" in c.lower():
            return c
    return columns[0] if first_as_fallback and columns else None


def infinite_to_null(df: DataFrame) -> DataFrame:
    """Infinite and NaN values of float columns become null."""
    def finite(c: str) -> Column:
        bad = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
        return F.when(~bad, F.col(c)).alias(c)

    floats = set(float_columns(df))
    return df.select(*[finite(c) if c in floats else F.col(c) for c in df.columns])


def clean_flows(df: DataFrame, label: str = "label") -> DataFrame:
    """Infinite values to null, unlabelled rows out, remaining gaps to 0."""
    kept = infinite_to_null(df).dropna(subset=[label])
    return kept.fillna(0).fillna("0")


def median_impute(df: DataFrame) -> DataFrame:
    """Infinite values to null, then numeric gaps to the column's exact global median."""
    finite = infinite_to_null(df)
    numeric = numeric_columns(finite)
    if not numeric:
        return finite
    gaps = finite.agg(*[F.bool_or(F.col(c).isNull()).alias(c) for c in numeric]).first()
    medians = exact_percentiles(finite, [c for c in numeric if gaps[c]], 0.5)
    return finite.fillna({c: m for c, m in medians.items() if m is not None})


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as doubles; what cannot be read, null and NaN become 0."""
    types = dict(df.dtypes)

    def number(c: str) -> Column:
        value = F.col(c).try_cast("double") if types[c] == "string" else F.col(c).cast("double")
        return F.coalesce(F.nanvl(value, F.lit(None).cast("double")), F.lit(0.0)).alias(c)

    return df.select(*[number(c) if c in columns else F.col(c) for c in df.columns])


def missing_counts(df: DataFrame) -> DataFrame:
    """Columns with missing (null or NaN) values and how many, in one pass."""
    floats = set(float_columns(df))
    missing = lambda c: F.col(c).isNull() | F.isnan(c) if c in floats else F.col(c).isNull()
    counts = df.agg(*[F.count_if(missing(c)).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "missing").where("missing > 0")


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier one. Rows meet by a 128-bit digest, not by all columns."""
    digest = F.struct(F.xxhash64(*df.columns).alias("a"), F.md5(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})).alias("b"))
    return df.groupBy(digest.alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def drop_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Drop the named columns where present; by default the two the connection table carries."""
    return df.drop(*(names or ["num_outbound_cmds", "difficulty"]))


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with exactly one distinct non-null value (an all-null column has none).

    A column is constant when its smallest and largest value agree, so no distinct set is built.
    """
    row = df.agg(*[F.min(c).eqNullSafe(F.max(c)).alias(f"same_{i}") for i, c in enumerate(df.columns)],
                 *[F.count(c).alias(f"n_{i}") for i, c in enumerate(df.columns)]).first()
    return [c for i, c in enumerate(df.columns) if row[f"same_{i}"] and row[f"n_{i}"] > 0]


def drop_constant(df: DataFrame) -> DataFrame:
    return df.drop(*constant_columns(df))


def collapse_rare(df: DataFrame, column: str = "service", threshold: int = 1000, rare: str = "rare") -> DataFrame:
    """Values with fewer than ``threshold`` rows become ``rare``."""
    rare_values = df.groupBy(F.col(column).alias("_value")).count().where(F.col("count") < threshold).select("_value")
    joined = df.join(small_side(rare_values), F.col(column) == F.col("_value"), "left")
    return joined.withColumn(column, F.when(F.col("_value").isNotNull(), rare).otherwise(F.col(column))).drop("_value")


def standardise_label(label: Column, binary: bool = False) -> Column:
    """Label stripped and upper-cased; ``binary`` maps BENIGN and NORMAL to BENIGN, the rest to ATTACK."""
    clean = F.upper(F.trim(label))
    if not binary:
        return clean
    return F.when(clean.isin("BENIGN", "NORMAL"), "BENIGN").otherwise("ATTACK")


def standardise_labels(df: DataFrame, label: str | None = None, binary: bool = False) -> DataFrame:
    label = label or find_label_column(df.columns)
    if label is None:
        raise ValueError("no label column")
    return df.withColumn(label, standardise_label(F.col(label), binary)).withColumnRenamed(label, "label")


INTEGER_RANGES = {"tinyint": 7, "smallint": 15, "int": 31}


def _compact(col: Column, source: str, target: str) -> Column:
    """The value in the wanted type, null where it does not fit.

    Integer targets test the range first: a failing ``try_cast`` costs an exception per value.
    """
    if target not in INTEGER_RANGES:
        return col.try_cast(target)
    number = col.try_cast("double") if source == "string" else col
    limit = 2 ** INTEGER_RANGES[target]
    return F.when((number >= -limit) & (number <= limit - 1), number.cast(target))


def typed_load(df: DataFrame, types: dict[str, list[str]] | None = None) -> DataFrame:
    """Known columns in compact types; values that do not fit become null."""
    wanted = {c: t for t, names in (types or FLOW_TABLE_TYPES).items() for c in names}
    sources = dict(df.dtypes)
    return df.select(*[_compact(F.col(c), sources[c], wanted[c]).alias(c) if c in wanted else F.col(c) for c in df.columns])


def column_types(df: DataFrame) -> DataFrame:
    """Smallest type that holds every integer column's observed range; floats become ``float``."""
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    floats = float_columns(df)
    both = [F.min(c).cast("bigint").alias(f"min_{c}") for c in ints] + [F.max(c).cast("bigint").alias(f"max_{c}") for c in ints]
    ranges = df.agg(*both) if ints else df.limit(0).agg(F.lit(1))
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"min_{c}").alias("lo"), F.col(f"max_{c}").alias("hi")) for c in ints],
        *[F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("bigint").alias("lo"), F.lit(None).cast("bigint").alias("hi")) for c in floats])
    lo, hi = F.col("lo"), F.col("hi")
    narrow = (
        F.when(F.col("column_name").isin(floats), "float")
        .when((lo >= 0) & (hi < 256), "smallint").when((lo >= 0) & (hi < 65536), "int").when(lo >= 0, "bigint")
        .when((lo > -128) & (hi < 128), "tinyint").when((lo > -32768) & (hi < 32768), "smallint")
        .when((lo > -2147483648) & (hi < 2147483648), "int").otherwise("bigint"))
    return ranges.select(F.explode(rows).alias("r")).select("r.*").withColumn("narrow_type", narrow)


def rename_columns(df: DataFrame, mapping: dict[str, str], label: str = "label") -> DataFrame:
    """Rename by a mapping that may name columns with or without their ``feature_`` prefix."""
    def target(c: str) -> str:
        return c if c == label else mapping.get(c, mapping.get(c.replace("feature_", ""), c))

    return df.withColumnsRenamed({c: target(c) for c in df.columns})
