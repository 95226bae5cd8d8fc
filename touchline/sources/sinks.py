"""Text, JSON and CSV forms of result tables, and the archives of seasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def escaped(label: Column) -> Column:
    """A label value as the text exposition format wants it."""
    return F.replace(F.replace(F.replace(label.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def metric_lines(rows: DataFrame, name: str, kind: str, labels: list[str], value: str = "value", header: bool = True) -> DataFrame:
    """(line): one sample a row with sorted labels, and the type line once."""
    pairs = [part for n, k in enumerate(sorted(labels)) for part in (F.lit(("," if n else "") + f'{k}="'), escaped(F.col(k)), F.lit('"'))]
    lines = rows.select(F.concat(F.lit(name + ("{" if labels else "")), *pairs, F.lit("} " if labels else " "), F.col(value).cast("string")).alias("line"))
    if not header:
        return lines
    return lines.union(rows.sparkSession.createDataFrame([(f"# TYPE {name} {kind}",)], "line string"))


def finite(c: Column) -> Column:
    """The number, or null where it is NaN or infinite."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def clean(df: DataFrame) -> DataFrame:
    """Every floating column without NaN and infinities, so that JSON stays strict."""
    return df.select(*[finite(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def write_payload(df: DataFrame, path: str, partitions: list[str]) -> None:
    """Compact JSON lines, nulls kept, one folder for each value of the partition columns (season, as_of)."""
    clean(df).write.mode("overwrite").partitionBy(*partitions).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, columns: list[str], places: int = 4) -> None:
    """CSV of the columns that exist, floating ones rounded."""
    kinds = dict(df.dtypes)
    kept = [F.bround(c, places).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns if c in kinds]
    df.select(*kept).write.mode("overwrite").option("header", "true").csv(path)


def archive_season(df: DataFrame, folder: str, season: str) -> bool:
    """Writes a finished season under its own name once; False, and nothing is touched, if it is there."""
    spark: SparkSession = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/season={season}")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return False
    clean(df).write.mode("errorifexists").parquet(f"{folder}/season={season}")
    return True


def append_log(df: DataFrame, path: str) -> None:
    """Appends JSON lines."""
    df.write.mode("append").json(path)


def payload_name(season: str | None, as_of: int | None = None, full: bool = False) -> str:
    """Name of a payload: of all seasons, of one, as of a round, and the full one beside the short."""
    parts = ["all-seasons" if season is None else season, *([f"r{as_of}"] if as_of is not None else []), *(["full"] if full else [])]
    return "payload-" + "-".join(parts)


def client_lines(rows: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """(place, line) of the CSV a client takes home: a byte-order mark and the header, then rows in order, text in quotes where it has to be."""
    def cell(name: str) -> Column:
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))  # a list that one person reads
    lines = placed.select("place", F.concat_ws(",", *map(cell, columns)).alias("line"))
    head = rows.sparkSession.createDataFrame([(0, "\ufeff" + ",".join(columns))], "place long, line string")
    return head.union(lines)


def tail_log(spark: SparkSession, path: str, schema: str, at: str, n: int) -> DataFrame:
    """The last n lines of an appended log by a column."""
    return spark.read.schema(schema).json(path).orderBy(F.col(at).desc()).limit(n)


def sql_text(c: Column) -> Column:
    """A text as an SQL literal."""
    return F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def csv_text(c: Column) -> Column:
    """A text as a CSV cell in quotes."""
    return F.concat(F.lit('"'), F.replace(c.cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
