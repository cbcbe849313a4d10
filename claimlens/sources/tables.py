"""Hospital tables as DataFrames, and the readers and writers around them."""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Tables(Mapping[str, DataFrame]):
    """Named DataFrames, each built the first time it is asked for."""

    def __init__(self, spark: SparkSession, makers: Mapping[str, Callable[[], DataFrame] | DataFrame]):
        self.spark = spark
        self._makers = dict(makers)
        self._built: dict[str, DataFrame] = {}
        self.dates: dict = {}
        """Child table to its ``dates.DateRule``."""

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            maker = self._makers[name]
            self._built[name] = maker if isinstance(maker, DataFrame) else maker()
        return self._built[name]

    def __contains__(self, name: object) -> bool:
        return name in self._makers  # without building the table

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def with_tables(self, **changed: DataFrame) -> "Tables":
        """The same tables with some replaced, e.g. by corrected ones."""
        rules = {n: r for n, r in self.dates.items() if n not in changed and r.parent not in changed}
        return Tables(self.spark, {**self._makers, **self._built, **changed}).with_dates(rules)

    def with_dates(self, rules: Mapping) -> "Tables":
        """The same tables with date rules for some."""
        out = Tables(self.spark, {**self._makers, **self._built})
        out.dates = {**self.dates, **rules}
        return out

    def without(self, *names: str) -> "Tables":
        rules = {n: r for n, r in self.dates.items() if n not in names and r.parent not in names}
        return Tables(self.spark, {n: m for n, m in self._makers.items() if n not in names}).with_dates(rules)


def checked(df: DataFrame, schema: T.StructType, name: str) -> DataFrame:
    """``df``, if it has every column of ``schema`` with its type; otherwise an error that names what differs."""
    types = {f.name.lower(): f.dataType for f in df.schema.fields}
    wrong = [
        f"{f.name}: {types[f.name.lower()].simpleString() if f.name.lower() in types else 'absent'}, not {f.dataType.simpleString()}"
        for f in schema.fields
        if types.get(f.name.lower()) != f.dataType
    ]
    if wrong:
        raise TypeError(f"table {name}: {'; '.join(wrong)}")
    return df


def load_parquet(
    spark: SparkSession, root: str, names: list[str], schemas: Mapping[str, T.StructType] | None = None
) -> Tables:
    """Tables stored as ``root/<name>`` or ``root/<name>.parquet`` (pass the suffix in the name).

    A table with a declared schema (by its name without suffix) is checked against it when first used.
    """
    schemas = schemas or {}

    def reader(name: str) -> DataFrame:
        df, table = spark.read.parquet(f"{root}/{name}"), name.removesuffix(".parquet")
        return checked(df, schemas[table], table) if table in schemas else df

    return Tables(spark, {n.removesuffix(".parquet"): (lambda n=n: reader(n)) for n in names})


def jdbc_options(
    name: str,
    split: Mapping[str, tuple[str, object, object, int]],
    small: Collection[str] = (),
    schemas: Mapping[str, T.StructType] | None = None,
) -> dict[str, str]:
    """The reader options of one table: its slices, or the statement that it is small, and its declared types."""
    if name in split:
        column, low, high, slices = split[name]
        options = {
            "partitionColumn": column,
            "lowerBound": str(low),
            "upperBound": str(high),
            "numPartitions": str(slices),
        }
    elif name in small:
        options = {}
    else:
        raise ValueError(f"table {name} has no split; name it in ``small`` if one connection can read it")
    if schemas and name in schemas:
        options["customSchema"] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schemas[name].fields)
    return options


def load_jdbc(
    spark: SparkSession,
    url: str,
    names: list[str],
    properties: Mapping[str, str],
    split: Mapping[str, tuple[str, object, object, int]] | None = None,
    small: Collection[str] = (),
    schemas: Mapping[str, T.StructType] | None = None,
) -> Tables:
    """Tables read over JDBC.

    ``split`` maps a table to (numeric or date column, lowest, highest, slices)
    so that a large table is read by many tasks instead of one connection.  A table
    without a split is refused when used, unless ``small`` names it.  ``schemas``
    declares the types of a table's columns, to which they are read and checked.
    """

    def reader(name: str) -> DataFrame:
        options = jdbc_options(name, split or {}, small, schemas)
        df = spark.read.format("jdbc").options(**properties, url=url, dbtable=name, **options).load()
        return checked(df, schemas[name], name) if schemas and name in schemas else df

    return Tables(spark, {n: (lambda n=n: reader(n)) for n in names})


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", order: Sequence[str] = ()) -> None:
    """Rows as quoted CSV with header, inner quotes doubled, NULL as an empty field.

    With ``order`` the rows are range-partitioned and sorted by these columns, NULL last:
    the files by name, one after another, hold all rows in order, whatever their number.
    In a folder named ``*.csv`` ``read_rows`` finds that order again as ``_pos``.

    Spark writes UTF-8 without a byte-order mark; a spreadsheet has to be told
    the encoding on import.
    """
    if order:
        keys = [F.col(c).asc_nulls_last() for c in order]
        df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quoteAll", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("lineSep", "\r\n")
        .csv(path)
    )


def read_code_list(spark: SparkSession, path: str, column: str = "code") -> DataFrame:
    """Imported codes: a JSON-lines or CSV file with one code column."""
    schema = T.StructType([T.StructField(column, T.StringType())])
    return read_rows(spark, path, schema)


def read_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Imported rows under an explicit schema, with the input position kept in ``_pos``.

    The position decides which row wins when a key is given twice: file by name, then
    block and row within it.  It only has to be ordered, so no pass over the data is
    needed to make it dense.
    """
    if path.rstrip("/").endswith(".csv"):
        rows = spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)
    else:
        rows = spark.read.schema(schema).json(path)
    # rows of a block are read in order by one task, which numbers them in order
    row = F.monotonically_increasing_id().alias("row")
    return rows.withColumn("_pos", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), row))
