"""Table sources: CSV and Parquet files, mixed directories, labelled capture folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.operators.cleaning import clean_headers

# capture filter text -> predicate
CAPTURE_FILTERS = {
    "ip": "ip_version = 4",
    "ip6": "ip_version = 6",
    "ip or ip6": "ip_version IN (4, 6)",
    "not port 22": "sport <> 22 AND dport <> 22",
}


def csv_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode, then latin1."""
    broken = spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1)
    return "ISO-8859-1" if broken.count() else "UTF-8"


def read_csv(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", schema: T.StructType | None = None) -> DataFrame:
    """CSV with header and normalised column names; unreadable files are skipped."""
    reader = spark.read.option("header", True).option("encoding", encoding).option("ignoreCorruptFiles", True)
    if schema is not None:
        reader = reader.schema(schema)
    return clean_headers(reader.csv(path))


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return clean_headers(spark.read.option("ignoreCorruptFiles", True).option("mergeSchema", True).parquet(*([path] if isinstance(path, str) else path)))


def read_named(spark: SparkSession, path: str, names: list[str], types: dict[str, str] | None = None) -> DataFrame:
    """Headerless CSV whose column names come from elsewhere."""
    schema = ", ".join(f"`{n}` {(types or {}).get(n, 'string')}" for n in names)
    return spark.read.schema(schema).csv(path)


def field_names(spark: SparkSession, path: str, extra: tuple[str, ...] = ("label", "difficulty")) -> list[str]:
    """Column names listed in the first field of a small headerless CSV, plus the extra ones."""
    return [r[0] for r in spark.read.csv(path).collect()] + list(extra)


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only the named columns of a CSV or Parquet table."""
    df = read_parquet(spark, path) if path.rstrip("/").endswith(".parquet") else read_csv(spark, path)
    return df.select(*columns)


def _paths(spark: SparkSession, pattern: str) -> list[str]:
    try:
        # only the path column is read, so no file is opened
        return sorted(r.path for r in spark.read.format("binaryFile").load(pattern).select("path").collect())
    except AnalysisException:
        return []


def _wider(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The numeric type that holds both, None where only text does."""
    order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
    if type(a) in order and type(b) in order:
        return max(a, b, key=lambda t: order.index(type(t)))
    small = {T.ByteType, T.ShortType, T.IntegerType, T.FloatType, T.DoubleType}
    return T.DoubleType() if {type(a), type(b)} <= small else None


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Union by name, absent columns null, no value lost.

    Numeric types widen. A column that is text in some parts and typed in others takes the type only
    if every text reads as it (one aggregate per part with such columns); else it becomes text.
    """
    types: dict[str, T.DataType] = {}
    texts: dict[str, T.DataType] = {}  # columns that some part holds as text
    for part in parts:
        for f in part.schema.fields:
            if isinstance(f.dataType, T.StringType):
                texts[f.name] = f.dataType
            elif f.name not in types or types[f.name] == f.dataType:
                types[f.name] = f.dataType
            else:
                types[f.name] = _wider(types[f.name], f.dataType) or T.StringType()
    for name in texts.keys() - types.keys():
        types[name] = T.StringType()
    for part in parts:
        mixed = [f.name for f in part.schema.fields if isinstance(f.dataType, T.StringType) and not isinstance(types[f.name], T.StringType)]
        if mixed:
            misfits = part.agg(*[F.count(F.when(F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").try_cast(types[c]).isNull(), 1)).alias(c) for c in mixed]).first()
            types.update({c: T.StringType() for c in mixed if misfits[c]})
    out = None
    for part in parts:
        cast = part.select(*[
            F.col(f"`{f.name}`").cast(types[f.name]).alias(f.name) if f.dataType != types[f.name] else F.col(f"`{f.name}`") for f in part.schema.fields])
        out = cast if out is None else out.unionByName(cast, allowMissingColumns=True)
    return out


def probe_csv(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, header, encoding) of every CSV file, in one distributed pass over the text.

    The header is the first line of the file's first split; a file with a line that does not decode as
    UTF-8 is latin1. Files of one folder may differ.
    """
    lines = spark.read.text(pattern).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return lines.groupBy("path").agg(
        F.min_by("value", F.when(F.col("block") == 0, F.col("line"))).alias("header"),
        F.when(F.max(~F.is_valid_utf8("value")), "ISO-8859-1").otherwise("UTF-8").alias("encoding"))


def read_directory(spark: SparkSession, folder: str, encoding: str | None = None, same_header: bool = False) -> DataFrame:
    """All ``*.csv`` and ``*.parquet`` of a folder as one table.

    CSV files are grouped by header and encoding, one scan per distinct pair; Parquet files are one
    scan. Telling both spares the probing pass. Files without a line hold no rows.
    """
    parts = []
    if encoding and same_header:
        if _paths(spark, f"{folder}/*.csv"):
            parts.append(read_csv(spark, f"{folder}/*.csv", encoding))
    elif _paths(spark, f"{folder}/*.csv"):
        groups: dict[tuple[str, str], list[str]] = {}
        for r in probe_csv(spark, f"{folder}/*.csv").collect():  # one row per file, as the file listing itself
            groups.setdefault(("" if same_header else r["header"] or "", encoding or r["encoding"]), []).append(r["path"])
        parts += [read_csv(spark, sorted(paths), kind) for (_, kind), paths in sorted(groups.items())]
    if _paths(spark, f"{folder}/*.parquet"):
        parts.append(read_parquet(spark, f"{folder}/*.parquet"))
    if not parts:
        raise ValueError(f"no CSV or Parquet files in {folder}")
    return union_all(parts)


def unreadable_parquet(spark: SparkSession, pattern: str) -> DataFrame:
    """(path) of the files whose first bytes are not Parquet's, which the readers above skip."""
    return spark.read.format("binaryFile").load(pattern).where(F.substring("content", 1, 4) != F.lit(b"PAR1")).select("path")


def capture_filter(packets: DataFrame, *filters: str) -> DataFrame:
    """Packets that pass every capture filter; other texts are taken as SQL predicates."""
    for text in filters:
        packets = packets.where(F.expr(CAPTURE_FILTERS.get(text, text)))
    return packets


def file_name() -> Column:
    return F.col("_metadata.file_name")


def label_by_prefix(spark: SparkSession, folder: str, prefixes: list[str]) -> DataFrame:
    """CSV files of a folder whose name starts with a known prefix, labelled with it."""
    from packetloom.operators.lookups import prefix_labels

    table = spark.createDataFrame([(p, p) for p in prefixes], "prefix string, label string")
    files = spark.read.option("header", True).csv(f"{folder}/*.csv").select("*", file_name().alias("_file"))
    return prefix_labels(files, "_file", table).drop("_file", "prefix")


def label_by_file(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of a folder, labelled with the text before the first underscore of their name."""
    files = spark.read.option("header", True).csv(f"{folder}/*.csv")
    return files.select("*", F.split(file_name(), "_")[0].alias("label"))
