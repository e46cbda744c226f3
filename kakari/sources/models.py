"""Models on disk: as Parquet tables, and as text with parameters, dictionary and instances in three blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kakari.operators.model import PairModel

Tables = tuple[dict[str, str], DataFrame, DataFrame]


def save_model(path: str, params: dict[str, str], dic: DataFrame, sv: DataFrame, mode: str = "error") -> None:
    """params, dic and sv as Parquet below path."""
    spark = dic.sparkSession
    spark.createDataFrame(sorted(params.items()) or [], "key string, value string").write.mode(mode).parquet(f"{path}/params")
    dic.select("feature", "id").write.mode(mode).parquet(f"{path}/dic")
    sv.select("sv_id", "alpha", "x").write.mode(mode).parquet(f"{path}/sv")


def load_model(spark: SparkSession, path: str) -> Tables:
    params = {r.key: r.value for r in spark.read.parquet(f"{path}/params").collect()}
    return params, spark.read.parquet(f"{path}/dic"), spark.read.parquet(f"{path}/sv")


def model_lines(params: dict[str, str], dic: DataFrame, sv: DataFrame) -> DataFrame:
    """(block, at, line) of the text form: `key: value`, an empty line, `id feature`, an empty line, `alpha id id ...`."""
    spark = dic.sparkSession
    head = spark.createDataFrame([(0, i, f"{k}: {v}") for i, (k, v) in enumerate(sorted(params.items()))] + [(0, len(params), "")], "block int, at long, line string")
    names = dic.select(F.lit(1).alias("block"), F.col("id").cast("long").alias("at"), F.concat_ws(" ", F.col("id").cast("string"), "feature").alias("line"))
    gap = spark.createDataFrame([(1, 1 << 40, "")], "block int, at long, line string")
    rows = sv.select(F.lit(2).alias("block"), F.col("sv_id").cast("long").alias("at"), F.concat_ws(" ", F.format_string("%.16f", "alpha"), F.transform("x", lambda i: i.cast("string"))).alias("line"))
    return head.unionByName(names).unionByName(gap).unionByName(rows)


def write_text_model(path: str, params: dict[str, str], dic: DataFrame, sv: DataFrame) -> None:
    """The text form as one file, for exchange; models are small beside corpora."""
    model_lines(params, dic, sv).orderBy("block", "at").select("line").coalesce(1).write.text(path)


def read_text_model(spark: SparkSession, path: str) -> Tables:
    """The tables of a text model; instances are numbered in the order of the file."""
    whole = spark.read.text(path, wholetext=True).agg(F.max("value").alias("value"))
    parts = whole.select(F.split("value", "\n\n", 3).alias("p"))
    params = dict(x.split(": ", 1) for x in (parts.select(F.get("p", F.lit(0))).first()[0] or "").split("\n") if ": " in x)
    names = parts.select(F.explode(F.split(F.get("p", F.lit(1)), "\n")).alias("line")).where("line <> ''")
    dic = names.select(F.substring_index("line", " ", 1).cast("int").alias("id"), F.expr("substring(line, instr(line, ' ') + 1)").alias("feature")).select("feature", "id")
    rows = parts.select(F.posexplode(F.split(F.get("p", F.lit(2)), "\n")).alias("sv_id", "line")).where("line <> ''")
    cells = F.split(F.trim("line"), " +")
    sv = rows.select("sv_id", F.get(cells, F.lit(0)).cast("double").alias("alpha"), F.transform(F.slice(cells, F.lit(2), F.size(cells)), lambda i: i.cast("int")).alias("x"))
    return params, dic, sv


def open_model(spark: SparkSession, path: str, posset: str = "IPA", **options) -> PairModel:
    """The compiled model at path, from tables or else from text; it must have been made for the tag set."""
    try:
        params, dic, sv = load_model(spark, path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        params, dic, sv = read_text_model(spark, path)
    return PairModel.compile(dic, sv, params=params, **options).check(posset=posset)


def save_compiled(path: str, q0: DataFrame, q1: DataFrame, q2: DataFrame, mode: str = "error") -> None:
    """The quantised tables as Parquet."""
    for name, table in (("w0", q0), ("w1", q1), ("w2", q2)):
        table.write.mode(mode).parquet(f"{path}/{name}")


def load_compiled(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(spark.read.parquet(f"{path}/{name}") for name in ("w0", "w1", "w2"))
