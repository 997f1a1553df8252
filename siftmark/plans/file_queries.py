"""Queries that write rows of the tables as files and read them through the sources, and those of labelling tasks."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftmark.functions import parsing as P
from siftmark.functions.text import strip
from siftmark.operators import credibility, dataset, hardset, knowledge, labeling, lexicon, seen
from siftmark.plans import frames as I
from siftmark.plans.frames import PRED
from siftmark.plans.registry import query
from siftmark.sources import files
from siftmark.sources.scratch import scratch_path, stored
from siftmark.streaming import incremental, labelling

_HASHED = "SELECT doc_id, md5(text) AS hash, lang, source FROM documents"


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.md5("text").alias("hash"), "lang", "source")


def _docs(spark, d) -> DataFrame:
    return I.documents(spark, d).select("doc_id", "text", "lang", "source")


_SCHEMA = "doc_id long, text string, lang string, source string"


@query(_HASHED)
def jsonl_lenient(spark, d):
    """Lines that can't be parsed, among good ones, are left out."""
    path = scratch_path(spark, "lenient")
    bad = spark.createDataFrame([('{"doc_id": 1, "text"',), ("no json",), ("",), ('{"doc_id": "x", "text": "y"}',), ("[1, 2",)], "value string")
    _docs(spark, d).select(F.to_json(F.struct("*")).alias("value")).union(bad).write.text(path)
    return _hashed(files.json_lines(spark, path, _SCHEMA))


@query(_HASHED)
def jsonl_strict(spark, d):
    path = scratch_path(spark, "strict")
    files.write_json_lines(_docs(spark, d), path)
    return _hashed(files.json_lines(spark, path, _SCHEMA, strict=True))


@query(_HASHED)
def jsonl_append(spark, d):
    """English documents are written first, the others appended."""
    path, english = scratch_path(spark, "append"), F.coalesce(F.col("lang") == "en", F.lit(False))
    files.write_json_lines(_docs(spark, d).filter(english), path)
    files.write_json_lines(_docs(spark, d).filter(~english), path, append=True)
    return _hashed(files.json_lines(spark, path, _SCHEMA))


@query("SELECT count(*) + 3 AS lines FROM documents")
def line_count(spark, d):
    path = scratch_path(spark, "lines")
    blank = spark.createDataFrame([("",), (" ",), ("",)], "value string")
    _docs(spark, d).select(F.to_json(F.struct("*")).alias("value")).union(blank).write.text(path)
    return spark.createDataFrame([(files.line_count(spark, path),)], "lines long")


@query("SELECT doc_id, CASE WHEN doc_id % 9 > 0 THEN md5(CASE WHEN doc_id % 7 = 0 THEN '' ELSE text END) END AS hash, lang, source FROM documents")
def csv_round_trip(spark, d):
    """Texts with quotes, commas, line ends and blanks at their ends; some are empty, some null."""
    path = scratch_path(spark, "csv")
    text = F.when(F.col("doc_id") % 9 > 0, F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.col("text")))
    files.write_csv(_docs(spark, d).withColumn("text", text), path)
    return _hashed(files.csv_table(spark, path, _SCHEMA))


@query(
    f"""WITH {PRED} SELECT id, round(CASE WHEN coarse_label = 1 THEN p1 ELSE p0 END, 9) AS p, coarse_label,
    CAST(CASE WHEN coarse_label = 1 THEN p1 > p0 ELSE p0 > p1 END AS INTEGER) AS pred_label FROM pred"""
)
def prediction_file(spark, d):
    """All rows come in a first file, those of class 1 again in a second, turned round; rows without id or uncertainty go."""
    path = scratch_path(spark, "predictions")
    x = I.predictions(spark, d).select("id", "coarse_label", F.array("p1", "p0").alias("pred_probs"), "uncertainty")
    partial = x.limit(1)
    bad = partial.withColumn("id", F.lit("")).union(partial.withColumn("id", F.lit("lost")).withColumn("uncertainty", F.lit(None).cast("double")))
    files.write_json_lines(x.union(bad), f"{path}/1")
    files.write_json_lines(x.filter("coarse_label = 1").withColumn("pred_probs", F.reverse("pred_probs")), f"{path}/2")
    return files.predictions(spark, f"{path}/*").select("id", F.round(F.col("pred_probs")[1], 9).alias("p"), "coarse_label", "pred_label")


@query(f"WITH {PRED} SELECT id, round(CASE WHEN coarse_label = 1 THEN p1 ELSE p0 END, 9) AS p FROM pred")
def posterior_file(spark, d):
    """As predictions, for one posterior: the last of an id wins."""
    path = scratch_path(spark, "posteriors")
    x = I.predictions(spark, d)
    files.write_json_lines(x.select("id", F.array("p1", "p0").alias("q0")), f"{path}/1")
    files.write_json_lines(x.filter("coarse_label = 1").select("id", F.array("p0", "p1").alias("q0")), f"{path}/2")
    return files.posteriors(spark, f"{path}/*").select("id", F.round(F.col("q0")[1], 9).alias("p"))


@query("SELECT CAST(doc_id % 101 AS INTEGER) AS pos, (doc_id % 101) / 100e0 AS u, round(avg(n_chars), 6) AS alpha FROM documents GROUP BY 1, 2")
def lut_file(spark, d):
    """A table of mean sizes by a class of the ids, as two arrays of one JSON object."""
    path = scratch_path(spark, "lut")
    u = F.pmod("doc_id", F.lit(101))
    points = I.documents(spark, d).groupBy(u.alias("pos")).agg(F.round(F.avg("n_chars"), 6).alias("alpha"))
    rows = points.agg(F.sort_array(F.collect_list(F.struct((F.col("pos") / 100.0).alias("u"), "alpha"))).alias("r"))  # 101 at most
    files.write_report(rows.select(F.col("r.u").alias("u"), F.col("r.alpha").alias("alpha")), path)
    got = files.small_json(spark, path)
    return spark.createDataFrame([(round(u * 100), u, a) for u, a in zip(got["u"], got["alpha"], strict=True)], "pos int, u double, alpha double")


_ITEM_WORDS = "(SELECT unnest(regexp_extract_all(text, '[a-z]+')) AS word FROM benchmark)"


def _item_words(spark, d) -> DataFrame:
    return I.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(f"SELECT DISTINCT 'abuse' AS category, word FROM {_ITEM_WORDS} UNION ALL SELECT 'porn', 'one'")
def lexicon_files(spark, d):
    """A word per line with blanks around, repeats and blank lines; one category has no file."""
    path = scratch_path(spark, "lexicons")
    blank = spark.createDataFrame([("",), ("  ",)], "value string")
    _item_words(spark, d).select(F.concat(F.lit(" "), "word", F.lit("\t")).alias("value")).union(blank).write.text(f"{path}/abuse.txt")
    spark.createDataFrame([("one",), ("one ",)], "value string").coalesce(1).write.text(f"{path}/porn.txt")
    return files.lexicon_lines(spark, {c: f"{path}/{c}.txt" for c in ("porn", "politics", "abuse")})


@query("SELECT 'p' || page_id AS pattern, url || '|x' AS description FROM pages")
def rule_file(spark, d):
    """Lines are split at the first bar; those without one, or without a pattern, are left out."""
    path = scratch_path(spark, "rules")
    other = spark.createDataFrame([("# no bar",), ("",), (" | nothing",)], "value string")
    I.table(spark, d, "pages").select(F.concat(F.lit(" p"), "page_id", F.lit(" | "), "url", F.lit("|x ")).alias("value")).union(other).write.text(path)
    return files.rule_lines(spark, path)


def _item_files(spark, d, path: str) -> None:
    """A text file for each item, in a folder of its own."""
    I.table(spark, d, "benchmark").select("item_id", F.concat(F.lit("\n "), "text").alias("text")).write.partitionBy("item_id").text(path)


_STRIPPED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"


@query(f"SELECT 's' || (row_number() OVER (ORDER BY item_id::VARCHAR || '/') + 6) AS id, md5({_STRIPPED}) AS hash FROM benchmark WHERE {_STRIPPED} <> ''")
def text_files(spark, d):
    """Whole files as records, with ids in order of their paths."""
    path = scratch_path(spark, "texts")
    _item_files(spark, d, path)
    return files.text_files(spark, f"{path}/*", 7).select("id", F.md5("text").alias("hash"))


@query(f"SELECT md5({_STRIPPED}) AS hash, count(*) AS n FROM benchmark GROUP BY 1")
def incremental_ingest(spark, d):
    """Files come in through a stream, twice; each is appended once."""
    path = scratch_path(spark, "ingest")
    _item_files(spark, d, f"{path}/in")
    for again in ("a", "b"):  # another checkpoint: all files come again
        incremental.ingest_new(incremental.text_stream(spark, f"{path}/in/*"), f"{path}/out", f"{path}/state-{again}", "path")
    return spark.read.parquet(f"{path}/out").groupBy(F.md5("text").alias("hash")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, round(avg(n_chars), 6) AS avg_chars FROM documents GROUP BY lang")
def report_file(spark, d):
    path = scratch_path(spark, "report")
    files.write_report(I.documents(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("avg_chars")), path)
    return files.json_lines(spark, path, "lang string, n long, avg_chars double", strict=True)


# --- labelling tasks

class Wary(labeling.RuleBackend):
    """Refuses texts with the word "idiot"; can't say for others without any of the words."""

    def answer(self, texts: list[str]) -> list[str]:
        if any("idiot" in t.lower() for t in texts):
            raise labeling.Refused("not safe")
        return [a if a == "1" else "maybe" for a in super().answer(texts)]


def _asked(spark, d, backend, size: int) -> DataFrame:
    rows = I.documents(spark, d).filter("length(text) > 0").select("doc_id", "text")
    return labeling.run_task(rows, backend, labeling.LabelTask("coarse", P.binary_label, size, 1, batch_chars=None), key="doc_id")


_HITS = " OR ".join(f"contains(lower(text), '{w}')" for c in ("porn", "politics", "abuse") for w in I.LEXICON[c])


@query(
    f"""SELECT doc_id, contains(lower(text), 'idiot') AS blocked, CASE WHEN {_HITS} THEN 1 END AS label FROM documents WHERE length(text) > 0"""
)
def refused_and_unread(spark, d):
    """A refusal labels a text as sensitive; an answer that can't be read leaves it without a label."""
    out = _asked(spark, d, Wary(I.LEXICON), 5)
    return out.select("doc_id", F.coalesce(F.col("coarse_response").startswith("[BLOCKED"), F.lit(False)).alias("blocked"), F.col("coarse_label").cast("int").alias("label"))


class Tired(labeling.RuleBackend):
    """Gives up for good after so many calls of a task."""

    def __init__(self, lexicon, calls: int):
        super().__init__(lexicon)
        self.left = calls

    def answer(self, texts: list[str]) -> list[str]:
        self.left -= 1
        if self.left < 0:
            raise labeling.Exhausted("the budget is spent")
        return super().answer(texts)


_LABELS = f"SELECT doc_id, CAST({_HITS} AS INTEGER) AS label FROM documents WHERE length(text) > 0"
_WHOLE = labeling.LabelTask("coarse", P.binary_label, batch_chars=None)


@query(f"SELECT doc_id, label, 1 AS n FROM ({_LABELS})")
def label_resume(spark, d):
    """A first run's backend gives up after seven calls of a task; a second run asks for what is missing. No document is there twice."""
    target = scratch_path(spark, "labelled")
    for backend in (Tired(I.LEXICON, 7), labeling.RuleBackend(I.LEXICON)):
        labelling.label_stream(labelling.table_stream(spark, f"{d}/documents.parquet", "doc_id long, text string", 4), target, backend, _WHOLE, "doc_id")
    return spark.read.parquet(target).groupBy("doc_id", F.col("coarse_label").cast("int").alias("label")).agg(F.count("*").alias("n"))


class Skipping(labeling.RuleBackend):
    """Leaves out an answer where a batch has a text with "idiot"."""

    def answer(self, texts: list[str]) -> list[str]:
        out = super().answer(texts)
        return out[1:] if len(texts) > 1 and any("idiot" in t.lower() for t in texts) else out


@query(_LABELS)
def label_fan_out(spark, d):
    """Five calls of a task in flight; batches that come back short are asked again text by text."""
    task = replace(_WHOLE, batch_size=7, calls_at_once=5, call_limit_s=600.0)
    out = labeling.run_task(I.documents(spark, d).select("doc_id", "text"), Skipping(I.LEXICON), task, key="doc_id")
    return out.select("doc_id", F.col("coarse_label").cast("int").alias("label"))


@query(_LABELS)
def label_rate_limit(spark, d):
    """All tasks share the calls of a minute."""
    task = replace(_WHOLE, calls_per_minute=600_000)
    out = labeling.run_task(I.documents(spark, d).select("doc_id", "text"), labeling.RuleBackend(I.LEXICON), task, key="doc_id")
    return out.select("doc_id", F.col("coarse_label").cast("int").alias("label"))


@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing_sketch(spark, d):
    """As for labels too many to broadcast: their keys are sketched, and only doubtful ones compared."""
    rows = I.documents(spark, d).filter("length(text) > 0").select("doc_id", "text")
    return seen.without_known(rows, I.table(spark, d, "labels"), "doc_id", few=0).select("doc_id")


class Shaky(labeling.RuleBackend):
    """Fails at the first two calls for each batch."""

    def __init__(self, lexicon):
        super().__init__(lexicon)
        self.failed = 0

    def answer(self, texts: list[str]) -> list[str]:
        self.failed = (self.failed + 1) % 3
        if self.failed:
            raise OSError("try again")
        return super().answer(texts)


@query(_LABELS)
def label_retry(spark, d):
    out = labeling.run_task(I.documents(spark, d).select("doc_id", "text"), Shaky(I.LEXICON), replace(_WHOLE, max_retries=3), key="doc_id")
    return out.select("doc_id", F.col("coarse_label").cast("int").alias("label"))


_TEACHER = "CASE WHEN contains(lower(text), 'idiot') THEN 1 WHEN " + _HITS + " THEN 1 END"


@query(
    f"""WITH {PRED}, x AS (SELECT id, doc_id, coarse_label, pred_label, {_TEACHER} AS teacher_label, list_filter([
      CASE WHEN pred_label <> coarse_label AND coarse_label = 1 THEN 'baseline_wrong_teacher_correct' END, CASE WHEN pred_prob >= 0.55e0 AND pred_label <> coarse_label THEN 'high_conf_error' END,
      CASE WHEN pred_label <> 1 THEN 'prediction_mismatch' END], lambda v: v IS NOT NULL) AS kinds FROM pred JOIN documents USING (doc_id) WHERE length(text) > 0)
    SELECT id, pred_label, teacher_label, array_to_string(kinds, ',') AS kinds FROM x WHERE teacher_label IS NOT NULL AND len(kinds) > 0"""
)
def teacher_disagreements(spark, d):
    """A teacher labels the predicted documents; those it refuses are positive, those it can't say anything about don't count."""
    pred = I.predictions(spark, d)
    rows = I.labelled_documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), "text")
    labels = labeling.run_task(rows, Wary(I.LEXICON), replace(_WHOLE, batch_size=5, max_retries=1))
    teacher = labels.select("id", F.col("coarse_label").cast("int").alias("teacher_label"))
    found = hardset.disagreements(pred, teacher, 0.55)
    return found.select("id", "pred_label", "teacher_label", F.concat_ws(",", "disagreement_type").alias("kinds"))


@query(
    """SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS skipped,
    count(*) FILTER (length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS success, 0 AS failed FROM documents"""
)
def task_stats(spark, d):
    rows, done = I.documents(spark, d).select("doc_id", "text"), I.table(spark, d, "labels").filter("toxic = 1").select("doc_id")
    labelled = labeling.run_task(rows, labeling.RuleBackend(I.LEXICON), labeling.LabelTask("coarse", P.binary_label), done, "doc_id")
    out = labeling.task_stats(rows, labelled, done, "coarse", "doc_id")
    return out.select("total", "skipped", "success", F.col("failed").cast("int").alias("failed"))


@query(f"SELECT DISTINCT 'w' || length(word) AS category, word FROM {_ITEM_WORDS} WHERE length(word) > 4")
def lexicon_cleaning(spark, d):
    """A cleaner returns the words of a batch that are to stay; batches of words of up to four letters fail."""
    words = _item_words(spark, d).distinct().select(F.concat(F.lit("w"), F.length("word")).alias("category"), "word")
    answers = words.groupBy("category").agg(F.concat_ws("\n", F.sort_array(F.collect_list("word"))).alias("response"))
    failed = F.when(F.substring("category", 2, 9).cast("int") > 4, F.col("response"))
    return lexicon.keep_returned(words, answers.withColumn("response", failed))


@query(f"WITH {PRED} SELECT id, round(p1, 9) AS p, coarse_label FROM pred")
def label_fallback(spark, d):
    """Posteriors without labels take those of the baseline, by id."""
    base = I.predictions(spark, d)
    q = base.select("id", "p1", F.lit(None).cast("int").alias("coarse_label"))
    out = knowledge.labels_or_fallback(q, base, bool(q.filter("coarse_label IS NOT NULL").head(1)))
    return out.select("id", F.round("p1", 9).alias("p"), "coarse_label")


class Keeper:
    """Returns the lines without an "e", numbered, and a word that wasn't asked for; fails for lines of up to four letters."""

    def answer(self, texts: list[str]) -> list[str]:
        out = []
        for t in texts:
            if any(len(w) <= 4 for w in t.split("\n")):
                raise OSError("no answer")
            out.append("\n".join([f"{k}. {w}" for k, w in enumerate(t.split("\n")) if "e" not in w] + ["unasked"]))
        return out


@query(f"SELECT DISTINCT 'w' || length(word) AS category, word FROM {_ITEM_WORDS} WHERE length(word) > 4 AND NOT contains(word, 'e')")
def lexicon_model_cleaning(spark, d):
    """Words go to a cleaner by batches of a category; failed batches keep none, and nothing comes in that wasn't asked for."""
    words = _item_words(spark, d).select(F.concat(F.lit("w"), F.length("word")).alias("category"), "word")
    task = labeling.LabelTask("cleaning", lambda c: c, max_retries=2, calls_at_once=5, call_limit_s=600.0)
    return lexicon.clean_words(words, Keeper(), 7, task)


@query(f"""SELECT category, word, row_number() OVER (ORDER BY category, length(word), lower(word), word) - 1 AS place
    FROM (SELECT DISTINCT 'w' || (length(word) % 3) AS category, word FROM {_ITEM_WORDS})""")
def lexicon_order(spark, d):
    return lexicon.ordered(_item_words(spark, d).select(F.concat(F.lit("w"), F.length("word") % 3).alias("category"), "word"))


_WIDTHS = "[" + ", ".join(map(str, dataset.ladder())) + "]"


@query(
    f"""SELECT doc_id, coarse_label, n_tokens, list_min(list_filter({_WIDTHS}, lambda w: w >= n_tokens)) AS width, md5(array_to_string(ids, ',')) AS ids FROM (
    SELECT *, CAST(len(ids) AS INTEGER) AS n_tokens FROM (
      SELECT doc_id, CAST(toxic AS INTEGER) AS coarse_label, [1] || list_transform(string_split(left(text, 510), ''), lambda c: unicode(c) + 3) || [2] AS ids
      FROM documents JOIN labels USING (doc_id) WHERE toxic IS NOT NULL AND length(text) > 0))"""
)
def tokenised_batches(spark, d):
    """Labelled documents as padded rows; what the mask leaves is hashed."""
    labels = I.table(spark, d, "labels").select(F.col("doc_id").alias("__d"), F.col("toxic").cast("int").alias("coarse_label"))
    labels = F.broadcast(labels) if labels.count() <= seen.FEW_KEYS else labels
    rows = I.documents(spark, d).filter("length(text) > 0").select("doc_id", "text").join(labels, F.col("doc_id") == F.col("__d")).drop("__d")
    out = dataset.padded(dataset.tokenised(rows, dataset.CodePoints(), label="coarse_label").drop("text"), "doc_id")
    ids = F.transform(F.filter(F.arrays_zip("input_ids", "mask"), lambda x: x["mask"] == 1), lambda x: x["input_ids"].cast("string"))
    return out.select("doc_id", "coarse_label", "n_tokens", F.size("input_ids").alias("width"), F.md5(F.concat_ws(",", ids)).alias("ids"))


@query(f"WITH {PRED} SELECT id, true AS same FROM pred")
def model_file(spark, d):
    """A trained classifier says the same once it is written and read again."""
    from pyspark.ml import PipelineModel

    rows = credibility.with_features(I.joined(spark, d).withColumn("subtype_label", F.array().cast("array<string>"))).withColumn("label", F.col("coarse_label").cast("double"))
    rows = stored(rows.select("id", "label", *credibility.FEATURES), "features")
    path = scratch_path(spark, "model")
    model = credibility.train(rows)
    model.write().overwrite().save(path)
    both = [credibility.predict(m, rows).select(F.col("id").alias(f"id{k}"), F.col("probability").alias(f"p{k}"), F.col("confidence").alias(f"c{k}")) for k, m in enumerate((model, PipelineModel.load(path)))]
    out = both[0].join(both[1], F.col("id0") == F.col("id1"), "left")
    return out.select(F.col("id0").alias("id"), (F.col("p0").eqNullSafe(F.col("p1")) & F.col("c0").eqNullSafe(F.col("c1"))).alias("same"))


@query(f"""SELECT 'now' AS file, word FROM {_ITEM_WORDS} WHERE length(word) > 3 GROUP BY word UNION ALL SELECT 'backup', word FROM {_ITEM_WORDS} GROUP BY word""")
def lexicon_saved(spark, d):
    """A lexicon file is written again with fewer words; what was there before is its backup."""
    path = scratch_path(spark, "saved") + "/abuse.txt"
    words = lexicon.dedup(_item_words(spark, d).withColumn("category", F.lit("abuse")))
    files.write_words(words, path)
    files.write_words(words.filter("length(word) > 3"), path)
    got = [files.lexicon_lines(spark, {name: at}) for name, at in (("now", path), ("backup", f"{path}.backup"))]
    return got[0].union(got[1]).select(F.col("category").alias("file"), "word")


@query("SELECT doc_id, text IS NULL AS none FROM documents WHERE doc_id % 2 = 0")
def skip_existing_output(spark, d):
    """An output that is there is left as it is, and not made again."""
    path = scratch_path(spark, "output")
    for kept in (0, 1):
        if not files.exists(spark, path):
            files.write_json_lines(_docs(spark, d).filter(F.col("doc_id") % 2 == kept), path)
    return files.json_lines(spark, path, _SCHEMA).select("doc_id", F.col("text").isNull().alias("none"))
