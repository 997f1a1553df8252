"""Inputs of the queries: stand-ins for predictions, knowledge and answers, made from the tables by fixed formulas.

Each frame has its SQL beside it, as common table expressions of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftmark.config import CATEGORIES, KnowledgeConfig
from siftmark.functions import scores as S
from siftmark.functions.text import word_count
from siftmark.operators.knowledge import with_q0
from siftmark.operators.matching import with_counts
from siftmark.operators.seen import with_known
from siftmark.sources.tables import table

#: Words that occur in the tables.
LEXICON = {"porn": ("disgusting", "pathetic", "worthless"), "politics": ("ungkeit", "mentelle", "thand"), "abuse": ("idiot", "moron", "scum", "stupid")}
RULES = [("lo[sz]er", "loser"), (r"\bclown", "clown"), ("(unclosed", "invalid"), ("TRASH$", "trash at the end")]
CONFIG = KnowledgeConfig()
ALPHAS = (0.0, 0.25, 0.5, 0.75, 1.0)
THRESHOLDS = (0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """id, doc_id, coarse_label, p0, p1, pred_probs, pred_label, pred_prob, uncertainty of labelled documents."""
    y, i = F.col("toxic"), F.col("doc_id")
    p1 = F.lit(0.15) + F.lit(0.35) * y + F.lit(0.45) * (((i * 7919 + 13) % 10007) / F.lit(10007.0))
    x = table(spark, d, "labels").select(i.cast("string").alias("id"), i, y.cast("int").alias("coarse_label"), p1.alias("p1"))
    x = x.withColumn("p0", 1 - F.col("p1")).withColumn("pred_probs", F.array("p0", "p1"))
    return x.withColumns({"pred_label": S.argmax2(F.col("p0"), F.col("p1")), "pred_prob": F.greatest("p0", "p1"), "uncertainty": 1 - F.greatest("p0", "p1")})


PRED = """pred AS (
  SELECT *, CAST(p1 > p0 AS INTEGER) AS pred_label, greatest(p0, p1) AS pred_prob, 1 - greatest(p0, p1) AS uncertainty FROM (
    SELECT *, 1 - p1 AS p0 FROM (
      SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, CAST(toxic AS INTEGER) AS coarse_label,
             0.15e0 + 0.35e0 * toxic + 0.45e0 * (((doc_id * 7919 + 13) % 10007) / 10007e0) AS p1 FROM labels)))"""


def counted(spark: SparkSession, d: str) -> DataFrame:
    """Documents with match counts and words."""
    return with_counts(documents(spark, d).filter(F.length("text") > 0), LEXICON).withColumn("words", word_count(F.col("text")))


def _count(word: str) -> str:
    return f"(length(low) - length(replace(low, '{word}', ''))) // {len(word)}"


COUNTED = (
    "counted AS (SELECT doc_id, text, low, "
    + ", ".join(f"CAST({' + '.join(map(_count, LEXICON[c]))} AS INTEGER) AS n_{c}" for c in CATEGORIES)
    + ", greatest(1, len(regexp_extract_all(text, '\\S+'))) AS words FROM (SELECT doc_id, text, lower(text) AS low FROM documents WHERE length(text) > 0))"
)


def scored(spark: SparkSession, d: str, labelled: bool = False) -> DataFrame:
    """Documents with q0; with ``labelled`` those alone that have labels, which are picked before any text is matched."""
    return with_q0(labelled_documents(spark, d) if labelled else documents(spark, d), LEXICON, CONFIG)


def labelled_documents(spark: SparkSession, d: str) -> DataFrame:
    return with_known(documents(spark, d), table(spark, d, "labels"), "doc_id")


def q_sql(base=CONFIG.base_prob, most=CONFIG.max_prob, least="1", pol=CONFIG.politics_weight, abu=CONFIG.abuse_weight) -> str:
    score = f"(n_porn * 1.0e0 + n_politics * {pol}::DOUBLE + n_abuse * {abu}::DOUBLE) / words"
    return (
        f"CASE WHEN n_porn + n_politics + n_abuse < {least} THEN {base}::DOUBLE "
        f"ELSE {base}::DOUBLE + ({most}::DOUBLE - {base}::DOUBLE) * (tanh({score} * 5) + 1) / 2 END"
    )


SCORED = f"{COUNTED}, scored AS (SELECT *, 1 - q1 AS q0 FROM (SELECT *, {q_sql()} AS q1 FROM counted))"


def joined(spark: SparkSession, d: str) -> DataFrame:
    """Predictions with knowledge: p0, p1, q0, q1."""
    q = scored(spark, d, labelled=True).select(F.col("doc_id").alias("__d"), F.col("q0")[0].alias("q0"), F.col("q0")[1].alias("q1"), *[f"n_{c}" for c in CATEGORIES], "text")
    return predictions(spark, d).join(q, F.col("doc_id") == F.col("__d")).drop("__d")


JOINED = f"{PRED}, {SCORED}, joined AS (SELECT pred.*, q0, q1, n_porn, n_politics, n_abuse, words, text FROM pred JOIN scored USING (doc_id))"


def fuse_sql(alpha: str) -> str:
    """The fused probability of class 1 as SQL; posteriors here sum to 1 already, up to rounding."""
    return f"(({alpha}) * p1 / (p0 + p1) + (1 - ({alpha})) * q1 / (q0 + q1))"


BUCKET_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in S.edges(10)) + "]"


def bucket_sql(x: str) -> str:
    return f"CAST(len(list_filter({BUCKET_EDGES}, lambda e: e <= {x})) AS INTEGER)"


ALL_EDGES = "[" + ", ".join(f"{e!r}::DOUBLE" for e in [0.0, *S.edges(10), 1.0]) + "]"
