"""Logical tables: schemas, readers and writers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.safe import nan_to_null


def _schema(**columns) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_D, _I, _S, _N, _B, _L = (
    T.DateType(), T.IntegerType(), T.StringType(), T.DoubleType(), T.BooleanType(), T.LongType(),
)

SCHEMAS = {
    "train": _schema(date=_D, store_nbr=_I, family=_S, sales=_N, onpromotion=_I),
    "test": _schema(date=_D, store_nbr=_I, family=_S, onpromotion=_I),
    "stores": _schema(store_nbr=_I, city=_S, state=_S, type=_S, cluster=_I),
    "oil": _schema(date=_D, dcoilwtico=_N),
    "holidays": _schema(date=_D, type=_S, locale=_S, transferred=_B),
    "transactions": _schema(date=_D, store_nbr=_I, transactions=_N),
    "inventory": _schema(item_id=_L, current_inventory=_N, unit_cost=_N, lead_time=_I),
}

# The raw tables of a run, in the order they are loaded.
RAW_TABLES = ("train", "test", "stores", "oil", "holidays", "transactions")

FORMATS = ("csv", "parquet", "json", "orc")


def _format_of(path: str, fmt: str | None) -> str:
    fmt = fmt or path.rstrip("/").rsplit(".", 1)[-1].lower()
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    return fmt


def read_table(spark: SparkSession, path: str, table: str | None = None, schema: T.StructType | None = None,
               fmt: str | None = None) -> DataFrame:
    """Scan a table with an explicit schema; dates are parsed by the scan, NaN becomes null."""
    fmt = _format_of(path, fmt)
    reader = spark.read
    schema = schema or (SCHEMAS[table] if table else None)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", schema is None)
    return nan_to_null(reader.format(fmt).load(path))


def load_train(spark, path, **kw) -> DataFrame:
    """Sales history."""
    return read_table(spark, path, "train", **kw)


def load_test(spark, path, **kw) -> DataFrame:
    """Future rows, without target."""
    return read_table(spark, path, "test", **kw)


def load_stores(spark, path, **kw) -> DataFrame:
    """Store dimension."""
    return read_table(spark, path, "stores", **kw)


def load_oil(spark, path, **kw) -> DataFrame:
    """Macro index by day."""
    return read_table(spark, path, "oil", **kw)


def load_holidays(spark, path, **kw) -> DataFrame:
    """Holiday calendar."""
    return read_table(spark, path, "holidays", **kw)


def load_transactions(spark, path, **kw) -> DataFrame:
    """Transactions by day and store."""
    return read_table(spark, path, "transactions", **kw)


def load_all(spark: SparkSession, folder: str, fmt: str = "csv", register: bool = False) -> dict[str, DataFrame]:
    """All raw tables of a folder by name, optionally registered as views."""
    tables = {t: read_table(spark, f"{folder.rstrip('/')}/{t}.{fmt}", t) for t in RAW_TABLES}
    if register:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
    return tables


def select_present(df: DataFrame, columns) -> DataFrame:
    """The requested columns that exist; the scan reads only these."""
    return df.select(*[c for c in columns if c in df.columns])


def read_columns(spark: SparkSession, path: str, columns, **kw) -> DataFrame:
    """Column-pruned scan that ignores requested columns that are absent."""
    return select_present(read_table(spark, path, **kw), columns)


def write_table(df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite") -> str:
    """Write a table as a folder of files."""
    fmt = _format_of(path, fmt)
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)
    return path


def write_panel(df: DataFrame, path: str, date: str = "date", mode: str = "overwrite") -> str:
    """Write a panel as parquet partitioned by year and month.

    Rows are rebalanced by month: at run time large months are split and small ones are merged, so
    files have an even size whatever the volume of a month.
    """
    dated = df.withColumns({"p_year": F.year(date), "p_month": F.month(date)})
    balanced = dated.hint("rebalance", F.col("p_year"), F.col("p_month"))
    balanced.write.mode(mode).partitionBy("p_year", "p_month").parquet(path)
    return path


def read_panel(spark: SparkSession, path: str, start=None, end=None, date: str = "date") -> DataFrame:
    """Read a partitioned panel; a date range also prunes the month folders."""
    df = spark.read.parquet(path)
    month = F.col("p_year") * 12 + F.col("p_month")
    for bound, keep in ((start, lambda a, b: a >= b), (end, lambda a, b: a <= b)):
        if bound is not None:
            edge = F.lit(str(bound)).cast("date")
            df = df.where(keep(F.col(date), edge)).where(keep(month, F.year(edge) * 12 + F.month(edge)))
    return df.drop("p_year", "p_month")


def write_series(df: DataFrame, path: str, table: str, buckets: int | None = None, keys=("store_nbr", "family"),
                 date: str = "date") -> DataFrame:
    """Write a panel as a table in buckets of whole series, sorted by date, and open it.

    Windows, joins and groupings by series read it without a shuffle; joins by series and date do
    with ``spark.sql.requireAllClusterKeysForCoPartition`` off. Each bucket is one file, written
    by one task, so ``buckets`` (by default the number of shuffle partitions) should keep a bucket
    within the memory of a task; a series has at most one row per day, so none fills a bucket. The
    keys and the number of buckets are kept beside the files, for :func:`open_series`.
    """
    spark, keys = df.sparkSession, list(keys)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys, date)
    writer = dealt.write.mode("overwrite").format("parquet").option("path", path)
    writer.bucketBy(buckets, *keys).sortBy(*keys, date).saveAsTable(table)
    spec = [(df.schema.json(), buckets, keys, date)]
    spark.createDataFrame(spec, SERIES_SPEC).coalesce(1).write.mode("overwrite").json(_spec_path(path))
    return open_series(spark, path, table)


SERIES_SPEC = "columns string, buckets int, keys array<string>, date string"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _spec_path(path: str) -> str:
    return path.rstrip("/") + "_spec"


def open_series(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of :func:`write_series`, registered again if this session's catalog does not know it.

    With ``spark.sql.legacy.bucketedTableScan.outputOrdering`` set, the order inside the files is used
    too and windows need no sort.
    """
    if not spark.catalog.tableExists(table):
        spec = spark.read.schema(SERIES_SPEC).json(_spec_path(path)).first()
        fields = T.StructType.fromJson(json.loads(spec["columns"])).fields
        columns = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
        keys = ", ".join(map(_quoted, spec["keys"]))
        spark.sql(
            f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({keys})"
            f" SORTED BY ({keys}, {_quoted(spec['date'])}) INTO {spec['buckets']} BUCKETS LOCATION '{path}'"
        )
    return spark.table(table)


# Folders of a run's outputs, by name.
OUTPUT_TABLES = ("features", "forecasts", "recommendations", "abc", "backtest")


def write_outputs(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> dict[str, str]:
    """Write a run's results; features are partitioned by month."""
    unknown = set(tables) - set(OUTPUT_TABLES)
    if unknown:
        raise ValueError(f"unknown outputs {sorted(unknown)}")
    folder = folder.rstrip("/")
    return {
        name: write_panel(df, f"{folder}/{name}")
        if name == "features"
        else write_table(df, f"{folder}/{name}", fmt)
        for name, df in tables.items()
    }


def export_page(df: DataFrame, path: str, columns=None) -> str:
    """CSV export of a report page's current selection."""
    return write_table(select_present(df, columns) if columns else df, path, "csv")
