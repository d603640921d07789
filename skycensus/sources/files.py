"""Files of the catalogs and side tables: text with line order, fixed width, CSV, JSON, snapshots. Inputs are paths of any store Spark reads."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skycensus.sources.text import fixed_width

#: Name, width and type of the fields of each layout, and header lines.
EXTERNAL_1 = ([("name", 15, "string"), ("epoch_mjd", 12, "double"), ("a", 25, "double"), ("e", 25, "double"), ("i", 25, "double"), ("node", 25, "double"), ("peri", 25, "double"), ("m", 25, "double"), ("h", 6, "double"), ("g", 6, "double"), ("rand", 3, "int")], 6)
EXTERNAL_2 = ([("desig", 14, "string"), ("epoch_mjd", 6, "double"), ("a", 12, "double"), ("e", 11, "double"), ("i", 10, "double"), ("peri", 10, "double"), ("node", 10, "double"), ("m", 12, "double"), ("h", 6, "double"), ("g", 5, "double"), ("ref", 10, "string")], 2)
COMET_MAGNITUDES = ([("packed", 8, "string"), ("mag", 5, "double")], 0)
ORBIT_SCHEMA = "Principal_desig string, Number string, Epoch double, M double, Peri double, Node double, i double, e double, a double, n double, H double, G double, Num_obs bigint, Num_opps bigint, Arc_length double, U string, rms double, Ref string, Perihelion_dist double, Aphelion_dist double, Orbital_period double, Tp double"


def lines(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """value, file and line_no (block and row: the order of a file's lines) without each file's first `skip` lines."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("line_no"))
    if not skip:
        return rows
    first = rows.filter("line_no.block = 0").groupBy("file").agg(F.min("line_no.row").alias("_first"))  # a row per file
    head = (F.col("line_no.block") == 0) & (F.col("line_no.row") < F.col("_first") + skip)
    return rows.join(first, "file", "left").filter(~F.coalesce(head, F.lit(False))).drop("_first")


def fixed_width_file(spark: SparkSession, path: str, layout: tuple[list[tuple[str, int, str]], int]) -> DataFrame:
    """The fields of a layout, one after the other; blank or bad fields are null, blank lines go."""
    fields, skip = layout
    at, spec = 1, []
    for name, width, kind in fields:
        spec.append((name, at, width, kind))
        at += width
    rows = lines(spark, path, skip).filter("trim(value) <> ''")
    got = fixed_width(rows, spec)
    return got.select(*[F.nullif(n, F.lit("")).alias(n) if k == "string" else F.col(n) for n, _, k in fields])


def observation_lines(spark: SparkSession, path: str, more: str | None = None) -> DataFrame:
    """line_no and value of the lines of one or two files; a second file that isn't there is none."""
    rows = lines(spark, path).select(F.struct(F.lit(0).alias("file"), "line_no").alias("line_no"), "value")
    if more:
        try:
            rows = rows.unionByName(lines(spark, more).select(F.struct(F.lit(1).alias("file"), "line_no").alias("line_no"), "value"))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return rows


def orbits(spark: SparkSession, path: str) -> DataFrame:
    """The orbit catalog: one JSON array, maybe compressed. U as a number, 10 where it has none."""
    rows = spark.read.schema(ORBIT_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("U", F.coalesce(F.trim("U").try_cast("double"), F.lit(10.0)))


def csv(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """A side table: header, quoted texts over many lines, leading blanks dropped from names and values; columns as in schema, bad values null."""
    rows = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    rows = rows.withColumnsRenamed({n: n.strip() for n in rows.columns})
    return rows.select(*[F.col(f"`{n}`").try_cast(t).alias(n) for n, t in schema.items()])


def csv_or_none(spark: SparkSession, path: str, schema: dict[str, str]) -> DataFrame:
    """csv(), or no rows where the file isn't there."""
    try:
        return csv(spark, path, schema)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in schema.items()))


def json_list(spark: SparkSession, path: str, kind: str = "string") -> DataFrame:
    """A row `item` for each entry of a JSON array."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"array<{kind}>")).alias("item"))


def keyed_json(text: DataFrame, schema: str, key: str, value: str = "value") -> DataFrame:
    """A row for each key of a JSON object of objects: key and the fields of schema."""
    return text.select(F.explode(F.from_json(value, f"map<string, struct<{schema}>>")).alias(key, "_v")).select(key, "_v.*")


def stats_json(spark: SparkSession, path: str, schema: str, key: str = "desig") -> DataFrame:
    return keyed_json(spark.read.text(path, wholetext=True), schema, key)


def write_stats(df: DataFrame, path: str, key: str = "desig") -> None:
    """Statistics as text, a JSON object {key: {statistics}} a line; nulls are left out. Each task writes its rows."""
    rest = F.struct(*[c for c in df.columns if c != key])
    df.select(F.to_json(F.create_map(F.col(key).cast("string"), rest)).alias("value")).write.mode("overwrite").text(path)


def stats_lines(spark: SparkSession, path: str, schema: str, key: str = "desig") -> DataFrame:
    """What write_stats() wrote, read line by line."""
    return keyed_json(spark.read.text(path), schema, key)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """Write df as zstd parquet and read it again."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def scores(df: DataFrame, path: str) -> None:
    """Keep (desig, ext) of a run for the next one's filters."""
    df.select("desig", "ext").write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """desig and ext of an earlier run."""
    return csv(spark, path, {"desig": "string", "ext": "double"})


def kept_lines(rows: DataFrame, value: str = "value") -> DataFrame:
    """Lines of periodic, lost and dual objects: four blanks, then A, P or D."""
    return rows.filter(F.col(value).rlike("^    [APD]"))
