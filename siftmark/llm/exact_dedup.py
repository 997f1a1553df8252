"""Exact deduplication: a tree-merge of sorted digest runs, in DataFrame operations only.

Every scan partition makes one run of (digest, smallest identifier, count) rows, sorted by
digest, in which rows of equal digest have become one before anything moves. Runs meet in
binomial rounds: run i is merged into the run whose number has the lowest bits of i cleared,
three bits a round, so runs 1, 2 and 4 places apart meet in the first round, 8, 16 and 32
places in the second, and up to ``FAN_IN`` runs are merged at once until run 0 is left. Where
equal digests meet, in a run or in any round, a second hash and the length are compared too:
the smallest identifier is retained and every mismatch is counted. Digests with mismatches
(none are known of SHA-256) are grouped again by all three.

Runs move twice, however many rounds there are: the first round deals its rows by digest and
group of neighbours, and what it leaves is dealt by digest alone and sorted once by digest and
the places of the run's number, highest first. In that order each further round merges rows
that lie side by side, so it is one pass that keeps the order, without a shuffle or a sort.
Spark sorts what a shuffle brings, as the order of the runs it comes from isn't known to it.

No task ever holds a whole run, and a group that holds a third of all rows is one row a run
before the first shuffle and one row a ``FAN_IN`` runs before the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmark.llm.shared import fresh, saved, scratch, sized

#: Bits of a run's number that one round clears, and so the runs that it merges into one.
BITS = 3
FAN_IN = 1 << BITS
#: The white space that is deleted before texts are compared.
BLANKS = " \t\n\x0b\f\r"


def digest(norm: Column) -> Column:
    return F.sha2(norm, 256)


def digest_runs(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: its identity, digests of the normalised text and the run it belongs to."""
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), F.length(text).alias("chars"), F.translate(text, BLANKS, "").alias("norm")).select(
        "doc_id",
        "chars",
        F.monotonically_increasing_id().alias("row_id"),
        F.spark_partition_id().cast("long").alias("run"),
        digest(F.col("norm")).alias("text_sha256"),
        # what a merge verifies beside the digest: another hash and the length
        F.struct(F.xxhash64("norm").alias("check"), F.length("norm").alias("norm_chars")).alias("proof"),
    )


def best_row() -> Column:
    return F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")


def _round(rows: DataFrame, places: list[str]) -> DataFrame:
    """Rows of equal digest and places become one: the best row, the sum of sizes, and whether the proofs differ."""
    found = rows.groupBy("text_sha256", *places).agg(
        F.min("best").alias("best"),
        F.sum("group_size").alias("group_size"),
        F.min("proof").alias("proof"),
        F.max("proof").alias("other"),
        F.sum("mismatches").alias("mismatches"),
    )
    met = (F.col("mismatches") + (F.col("proof") != F.col("other")).cast("long")).alias("mismatches")
    return found.select("text_sha256", *places, "best", "group_size", "proof", met)


def merge_runs(runs: DataFrame, n_runs: int) -> DataFrame:
    """Merges runs in rounds until run 0 is left: a row per digest with its best row, group size, proof and mismatches met."""
    rounds = max(1, -(-(n_runs - 1).bit_length() // BITS))
    # the number of a run without the bits that the first round clears, place by place
    number = {f"place_{k}": F.shiftright("run", BITS * k) % FAN_IN for k in range(rounds - 1, 0, -1)}
    places = list(number)
    rows = runs.select(
        "text_sha256", *[c.alias(p) for p, c in number.items()], best_row().alias("best"), F.lit(1).cast("long").alias("group_size"), "proof", F.lit(0).cast("long").alias("mismatches")
    )
    out = _round(rows, places)
    if places:
        out = out.repartition("text_sha256")
    while places:
        # the last place goes: what is left is still sorted by digest and the places before it
        places = places[:-1]
        out = _round(out, places)
    return out


def exact_dedup(docs: DataFrame) -> DataFrame:
    """Groups rows whose texts are equal without white space and names the row of each that stays.

    Takes any table with ``doc_id`` and ``text``; other columns are not read. Returns a row
    per row: doc_id, keep_id, group_size, kept, text_sha256, chars, proof, row_id. The row with most
    code points stays, then the one with the smallest doc_id (null ids last), then the first
    row read. A null text counts as empty and all empty texts are one group; of repeated rows
    one is kept. An empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as keep:
        runs = keep(saved(digest_runs(docs), "runs"))
        top = runs.agg(F.max("run")).first()[0]
        merged = keep(saved(merge_runs(runs, 1 + (top or 0)).filter("group_size > 1"), "merged"))
    columns = ["text_sha256", "proof", "best", "group_size"]
    best = merged.filter("mismatches = 0").select(*columns)
    if n := merged.filter("mismatches > 0").count():
        doubt = runs.join(sized(merged.filter("mismatches > 0").select("text_sha256"), n), "text_sha256", "left_semi")
        again = doubt.groupBy("text_sha256", "proof").agg(F.min(best_row()).alias("best"), F.count("*").alias("group_size"))
        best = best.unionByName(again.filter("group_size > 1").select(*columns))
    best = best.select(
        F.col("text_sha256").alias("b_sha"), F.col("proof").alias("b_proof"), F.col("best.doc_id").alias("b_id"), F.col("best.row_id").alias("b_row"), F.col("group_size").alias("b_size")
    )
    alone = F.col("b_sha").isNull()
    return runs.join(best, (F.col("text_sha256") == F.col("b_sha")) & (F.col("proof") == F.col("b_proof")), "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("b_id")).alias("keep_id"),
        F.coalesce("b_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row_id") == F.col("b_row"))).alias("kept"),
        "text_sha256",
        "chars",
        "proof",
        "row_id",
    )


def dedup_filter(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less the rows that :func:`exact_dedup` drops.

    Rows are matched by (doc_id, second hash of the text without white space, its length, length);
    among rows that agree in all four one stays.
    """
    i, p, n = (fresh(docs.columns, c) for c in ("k_id", "k_proof", "k_chars"))
    with scratch(docs.sparkSession) as keep:
        found = saved(exact_dedup(docs).select(F.col("doc_id").alias(i), F.col("proof").alias(p), F.col("chars").alias(n), "kept"), "dedup")
        gone = keep(saved(found.filter(~F.col("kept")).drop("kept").distinct(), "gone"))
        stay = found.filter("kept").drop("kept")
        same = [gone[i].eqNullSafe(stay[i]), gone[p] == stay[p], gone[n] == stay[n]]
        repeats = keep(saved(gone.join(stay, same, "left_semi"), "repeats"))
    text = F.coalesce(docs["text"], F.lit(""))
    norm = F.translate(text, BLANKS, "")
    d_proof, d_chars = fresh(docs.columns, "d_proof"), fresh(docs.columns, "d_chars")
    marked = docs.withColumns({d_proof: F.struct(F.xxhash64(norm).alias("check"), F.length(norm).alias("norm_chars")), d_chars: F.length(text)})

    def among(keys: DataFrame, rows: int, how: str) -> DataFrame:
        on = [marked["doc_id"].eqNullSafe(keys[i]), marked[d_proof] == keys[p], marked[d_chars] == keys[n]]
        return marked.join(sized(keys, rows), on, how)

    out, n_repeats = among(gone, gone.count(), "left_anti"), repeats.count()
    if n_repeats:
        # rows that the table repeats: their key is both dropped and kept, so one row of each key stays
        out = out.unionByName(among(repeats, n_repeats, "left_semi").dropDuplicates(["doc_id", d_proof, d_chars]))
    return out.drop(d_proof, d_chars)


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
