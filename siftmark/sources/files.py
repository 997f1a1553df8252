"""Sources and sinks: text files, JSON lines, CSV, lexicons, rules and small JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.functions.text import strip
from siftmark.operators.cleaning import assign_ids, last_wins


#: What the CSV reader takes an unquoted empty field for, and then reads as null; no text holds it.
_NULL = "\ufdd0"


def text_files(spark: SparkSession, folder: str, start: int = 0) -> DataFrame:
    """id, text of all *.txt files of a folder, one record per file, in order of their paths; empty files are left out."""
    rows = spark.read.text(f"{folder}/*.txt", wholetext=True).select(strip(F.col("value")).alias("text"), F.col("_metadata.file_path").alias("path"))
    return assign_ids(rows.filter("text <> ''"), "path", start).select("id", "text")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """Rows of JSON lines; a line that can't be parsed is left out, or fails the query if strict."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def line_count(spark: SparkSession, path: str) -> int:
    """Physical lines, blank ones too."""
    return spark.read.text(path).count()


def predictions(spark: SparkSession, path: str, drop_falsy_id: bool = True) -> DataFrame:
    """Predictions that have pred_probs and uncertainty; of equal ids the last one; pred_label falls back to the arg-max.

    Without an id are those where it is null or absent and, with ``drop_falsy_id``, the empty text, false and the number 0; "0" is one.
    """
    x = json_lines(spark, path, "id variant, coarse_label int, pred_label int, pred_prob double, pred_probs array<double>, uncertainty double")
    as_text = F.try_variant_get("id", "$", "string")
    falsy = (as_text == "") | (F.schema_of_variant("id") != "STRING") & ((as_text == "false") | F.coalesce(as_text.try_cast("double") == 0, F.lit(False)))
    x = x.filter(F.col("pred_probs").isNotNull() & F.col("uncertainty").isNotNull() & as_text.isNotNull() & (~falsy if drop_falsy_id else F.lit(True)))
    x = x.withColumn("id", as_text)
    p = F.col("pred_probs")
    x = x.withColumns({"pred_label": F.coalesce("pred_label", (p[1] > p[0]).cast("int")), "__pos": position()})
    return last_wins(x, "id", "__pos").drop("__pos")


def position():
    """Where a row stands: files by path, blocks by their place, rows as they are read. Row ids alone follow how files were dealt to tasks."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def posteriors(spark: SparkSession, path: str, field: str = "q0") -> DataFrame:
    """id and one posterior; of equal ids the last one."""
    x = json_lines(spark, path, f"id string, {field} array<double>").filter(F.col("id").isNotNull() & F.col(field).isNotNull())
    return last_wins(x.withColumn("__pos", position()), "id", "__pos").drop("__pos")


def csv_table(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """A CSV table with header; an empty field is null, a quoted empty one an empty text.

    Fields that hold line ends need ``multi_line``, which reads each file in one task; without, files are split. A schema
    saves reading everything once more to find the types.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("emptyValue", "").option("nullValue", _NULL)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def lexicon_lines(spark: SparkSession, paths: dict[str, str], distinct: bool = True) -> DataFrame:
    """category, word of text files, a word per line; a missing file is an empty category. Repeats go, unless they are to be counted."""
    hadoop = spark._jsparkSession.sessionState().newHadoopConf()
    out = spark.createDataFrame([], "category string, word string")
    for c, p in paths.items():
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if at.getFileSystem(hadoop).exists(at):
            out = out.union(spark.read.text(p).select(F.lit(c), strip(F.col("value"))))
    out = out.filter("word <> ''")
    return out.distinct() if distinct else out


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """pattern, description of lines "pattern|description", split at the first bar; others are left out."""
    parts = F.split(strip(F.col("value")), r"\|", 2)
    x = spark.read.text(path).filter(F.contains("value", F.lit("|"))).select(strip(parts[0]).alias("pattern"), strip(parts[1]).alias("description"))
    return x.filter("pattern <> ''")


def small_json(spark: SparkSession, path: str) -> dict:
    """A report or lookup table of one JSON object."""
    row = spark.read.option("multiLine", True).json(path).first()
    return row.asDict(recursive=True) if row else {}


def write_json_lines(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of JSON lines; tasks commit whole files, so an interrupted run leaves none that is cut."""
    df.write.mode("append" if append else "overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """A CSV table with header, as :func:`csv_table` reads it back; a null is an empty field, an empty text a quoted one."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    writer = writer.option("emptyValue", '""').option("nullValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_words(words: DataFrame, path: str, backup: bool = True) -> None:
    """One text file at ``path`` of a small table's ``word`` column, in its order; a file that is there is kept as ``<path>.backup``."""
    spark = words.sparkSession
    at = lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    folder = f"{path}.writing"
    words.select("word").coalesce(1).write.mode("overwrite").text(folder)
    part = next((s.getPath() for s in fs.listStatus(at(folder)) if s.getPath().getName().startswith("part-")), None)
    if fs.exists(at(path)):
        if backup:
            fs.delete(at(f"{path}.backup"), False)
            fs.rename(at(path), at(f"{path}.backup"))
        else:
            fs.delete(at(path), False)
    fs.rename(part, at(path)) if part else fs.create(at(path)).close()
    fs.delete(at(folder), True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether an output is there already, for runs that skip what is done."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)
