"""Typed readers and writers for the file formats that the queries take and give."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
POWER = "Date string, Time string, Global_active_power double, Global_reactive_power double, Voltage double, Global_intensity double, Sub_metering_1 double, Sub_metering_2 double, Sub_metering_3 double"
NEWS = "IDLink double, Title string, Headline string, Source string, Topic string, PublishDate timestamp, SentimentTitle double, SentimentHeadline double, Facebook double, GooglePlus double, LinkedIn double"
FEEDBACK = "IDLink double, " + ", ".join(f"TS{i} double" for i in range(1, 145))
RATINGS = "UserID long, MovieID long, Rating int, Timestamp long"
MOVIES = "MovieID long, Title string, Genres string"
EDGES = "src long, dst long"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def delimited(spark: SparkSession, paths: str | list[str], schema: str, sep: str = ",", header: bool = True, null: str = "", comment: str | None = None, timestamp_format: str | None = None) -> DataFrame:
    """Delimited text with an explicit schema; separators may have several characters."""
    reader = spark.read.schema(schema).option("sep", sep).option("header", header).option("escape", '"').option("nullValue", null)
    if comment:
        reader = reader.option("comment", comment)
    if timestamp_format:
        reader = reader.option("timestampFormat", timestamp_format)
    return reader.csv(paths)


def power(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, POWER, sep=";", null="?")


def news(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, NEWS, timestamp_format="yyyy-MM-dd HH:mm:ss")


def feedback(spark: SparkSession, folder: str, platform: str, topics: tuple[str, ...] = ("Economy", "Microsoft", "Obama", "Palestine")) -> DataFrame:
    """The files of one platform, one for each topic, as one table."""
    return delimited(spark, [f"{folder}/{platform}_{t}.csv" for t in topics], FEEDBACK)


def ratings(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, RATINGS, sep="::", header=False)


def movies(spark: SparkSession, path: str) -> DataFrame:
    return delimited(spark, path, MOVIES, sep="::", header=False)


def edges(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated edge list with # comments."""
    return delimited(spark, path, EDGES, sep="\t", header=False, comment="#")


def tagged_bodies(spark: SparkSession, path: str, tag: str = "BODY") -> DataFrame:
    """The text inside each ``<tag>`` of whole files: ``file, position, content``."""
    found = F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1))
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(found).alias("position", "content"))


def json_events(df: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Parse a JSON message column once. A value that is a JSON string holding JSON, as some senders encode it, is unwrapped first."""
    value = F.col(column).cast("string")
    plain = F.when(F.ltrim(value).startswith('"'), F.get_json_object(value, "$")).otherwise(value)
    return df.select(F.from_json(plain, schema).alias("event")).select("event.*")


def to_messages(df: DataFrame, key: str) -> DataFrame:
    """``key, value`` messages with the whole row as JSON, as a replayer sends them."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_single_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    """One CSV file, for small reports; all else should be written as partitioned Parquet."""
    df.coalesce(1).write.mode("overwrite").option("sep", sep).option("header", header).csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
