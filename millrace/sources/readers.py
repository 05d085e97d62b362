"""Readers for files, object stores, databases and nested JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.schema import col, nan_to_null
from millrace.sources.dialect import csv_read_options

FORMATS = ("csv", "json", "jsonl", "parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = True,
             **options) -> DataFrame:
    """CSV in the engine's dialect; give a schema to save the pass that infers one.

    `multi_line=False` splits large files among tasks and is for files without line breaks in fields.
    """
    reader = spark.read.options(**csv_read_options(multi_line)).options(**options)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None,
              lines: bool = False) -> DataFrame:
    """An array of records per file, or one record per line.

    A file holding one array cannot be split, so large data should come as lines.
    """
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def format_of(path: str) -> str:
    return path.rstrip("/").rsplit(".", 1)[-1].lower()


def read_table(spark: SparkSession, path: str, fmt: str | None = None,
               schema: str | T.StructType | None = None) -> DataFrame:
    """Reads by extension or given format; an unknown format or an empty table is an error.

    NaN becomes null.
    """
    fmt = (fmt or format_of(path)).lower()
    if fmt == "csv":
        df = read_csv(spark, path, schema)
    elif fmt in ("json", "jsonl"):
        df = read_json(spark, path, schema, lines=fmt == "jsonl")
    elif fmt == "parquet":
        df = read_parquet(spark, path)
    else:
        raise ValueError(f"no reader for {fmt}")
    if df.isEmpty():
        raise ValueError("the table is empty")
    return nan_to_null(df)


def object_store_options(access_key: str | None, secret_key: str | None, region: str) -> dict[str, str]:
    options = {"fs.s3a.endpoint.region": region}
    if access_key and secret_key:
        options.update({"fs.s3a.access.key": access_key, "fs.s3a.secret.key": secret_key})
    return options


def read_object(spark: SparkSession, bucket: str, key: str, access_key: str | None = None,
                secret_key: str | None = None, region: str = "us-east-1", file_format: str = "csv",
                scheme: str = "s3a://", schema: str | T.StructType | None = None) -> DataFrame:
    """An object of a store; `scheme` may also be file:// for a mounted one."""
    if file_format not in ("csv", "json", "parquet"):
        raise ValueError(f"no reader for {file_format}")
    path = f"{scheme}{bucket.rstrip('/')}/{key.lstrip('/')}"
    reader = spark.read.options(**object_store_options(access_key, secret_key, region))
    if schema:
        reader = reader.schema(schema)
    if file_format == "csv":
        return reader.options(**csv_read_options()).option("inferSchema", schema is None).csv(path)
    if file_format == "json":
        return reader.option("multiLine", True).json(path)
    return reader.parquet(path)


# URL patterns and default ports.
DATABASES = {"postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
             "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
             "sqlite": ("jdbc:sqlite:{path}", None)}


def database_options(kind: str, *, table: str | None = None, query: str | None = None, host: str = "localhost",
                     port: int | None = None, database: str = "", username: str | None = None,
                     password: str | None = None, path: str = "", partition_column: str | None = None,
                     lower_bound: int | None = None, upper_bound: int | None = None,
                     num_partitions: int | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """JDBC options for a table or a query; with a partition column the scan runs in parallel."""
    if not table and not query:
        raise ValueError("name a table or give a query")
    if kind not in DATABASES:
        raise ValueError(f"no driver settings for {kind}")
    pattern, default_port = DATABASES[kind]
    options = {"url": pattern.format(host=host, port=port or default_port, database=database, path=path),
               "fetchsize": str(fetch_size)}
    if username:
        options["user"] = username
    if password:
        options["password"] = password
    if partition_column:
        # A query cannot be split by itself, so it becomes a derived table.
        options["dbtable"] = f"({query}) q" if query else table
        options.update({"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                        "upperBound": str(upper_bound), "numPartitions": str(num_partitions)})
    elif query:
        options["query"] = query
    else:
        options["dbtable"] = table
    return options


def read_database(spark: SparkSession, kind: str, **settings) -> DataFrame:
    return spark.read.format("jdbc").options(**database_options(kind, **settings)).load()


def json_rows(df: DataFrame, json_column: str, schema: str, path: str = "") -> DataFrame:
    """Rows of the value at a dotted path: a list gives one row per entry, an object one row.

    Any other value is an error. The other columns pass through.
    """
    at = "$" + "".join(f".{p}" for p in path.split(".") if p)
    value = F.ltrim(F.get_json_object(col(json_column), at))
    kind = F.substring(value, 1, 1)
    entry = f"struct<{schema}>" if ":" in schema else schema
    struct = T._parse_datatype_string(entry)
    entries = (F.when(kind == "[", F.from_json(value, T.ArrayType(struct)))
               .when(kind == "{", F.array(F.from_json(value, struct)))
               .otherwise(F.raise_error(F.lit(f"the value at {at} is neither a list nor an object"))
                          .cast(T.ArrayType(struct))))
    keep = [col(c) for c in df.columns if c != json_column]
    return df.select(*keep, F.explode(entries).alias("__e")).select(
        *keep, *[F.col("__e")[f.name].alias(f.name) for f in struct.fields])


def read_json_path(spark: SparkSession, path: str, schema: str, json_path: str = "") -> DataFrame:
    """Landed API responses, one per file, as rows of the value at a dotted path."""
    return json_rows(spark.read.text(path, wholetext=True), "value", schema, json_path)
