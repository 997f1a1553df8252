"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftmark.config import CATEGORIES, CleanConfig
from siftmark.functions import parsing as P
from siftmark.functions import scores as S
from siftmark.functions import text as T
from siftmark.operators import anchors, calibration, cleaning, credibility, fusion, hardset, knowledge, labeling, lexicon, matching, metrics, sampling
from siftmark.plans import file_queries  # noqa: F401  registers its queries
from siftmark.plans import frames as I
from siftmark.plans.frames import ALPHAS, COUNTED, JOINED, PRED, SCORED, THRESHOLDS, bucket_sql, fuse_sql
from siftmark.plans.registry import ORACLES, QUERIES, query

def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


# --- text clean-up

_URL = r"(https?://|www\.)[a-zA-Z0-9\-._~:/?#\[\]@!$&''()*+,;=%]+(\s|$|[^\x00-\x7F])"
#: A web-like post around each document.
POST = "'RT @user' || doc_id || ': see https://ex.org/' || doc_id || ' ' || text"


def _post():
    return F.concat(F.lit("RT @user"), F.col("doc_id").cast("string"), F.lit(": see https://ex.org/"), F.col("doc_id").cast("string"), F.lit(" "), F.col("text"))


def _strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _urls_sql(x: str) -> str:
    return f"regexp_replace({x}, '{_URL}', '[URL]\\2', 'gi')"


def _mentions_sql(x: str) -> str:
    return rf"replace(regexp_replace(replace({x}, '@', chr(1) || '@'), '@[a-zA-Z0-9_]{{1,15}}(\x01|\s|$|[\x{{4e00}}-\x{{9fff}}]|[^\p{{L}}\p{{N}}_])', '[MENTION]\1', 'g'), chr(1), '')"


def _retweets_sql(x: str) -> str:
    for word, gap in (("RT", r"\s+"), ("转发", r"\s*"), ("Retweet", r"\s+")):
        x = rf"regexp_replace({x}, '{word}{gap}@[\p{{L}}\p{{N}}_]+[:：]\s*', '', 'gi')"
    return _strip_sql(x)


def _clean_sql(x: str) -> str:
    y = _strip_sql(_retweets_sql(_mentions_sql(_urls_sql("s"))))
    return f"SELECT doc_id, text, CASE WHEN length(s) >= 5 AND length({y}) >= 5 THEN {y} END AS cleaned FROM (SELECT *, {_strip_sql(x)} AS s FROM documents)"


@query(f"SELECT doc_id, cleaned AS text FROM ({_clean_sql(POST)}) WHERE cleaned IS NOT NULL")
def clean_text(spark, d):
    return cleaning.clean_rows(I.documents(spark, d).select("doc_id", _post().alias("text")))


#: Short texts, some of them too short, beside the documents.
_TEXTS = "(SELECT doc_id, text FROM documents UNION ALL SELECT -i, left('abcdefgh', CAST(i AS INTEGER)) FROM range(9) t(i)) documents"


@query(
    f"""WITH c AS ({_clean_sql('text').replace('FROM documents', f'FROM {_TEXTS}')})
    SELECT count(*) AS total, count(cleaned) AS processed, count(*) - count(cleaned) AS filtered,
           count(cleaned) - count(DISTINCT cleaned) AS deduplicated, count(DISTINCT cleaned) AS output FROM c"""
)
def clean_stats(spark, d):
    short = spark.range(9).select(F.left(F.lit("abcdefgh"), F.col("id").cast("int")).alias("text"))
    return cleaning.clean_stats(I.documents(spark, d).select("text").union(short))


@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_keep_first(spark, d):
    x = cleaning.dedup_keep_first(I.documents(spark, d).filter("text IS NOT NULL").select("doc_id", "text"), ["doc_id"])
    return x.select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(f"SELECT page_id, {_urls_sql('t')} AS masked FROM (SELECT page_id, url || '中文 and ' || url || ' \"quoted ' || url || '\" ' || html AS t FROM pages)")
def url_mask(spark, d):
    t = F.concat("url", F.lit("中文 and "), "url", F.lit(' "quoted '), "url", F.lit('" '), "html")
    return I.table(spark, d, "pages").select("page_id", T.mask_urls(t).alias("masked"))


@query(f"SELECT doc_id, {_mentions_sql('t')} AS masked FROM (SELECT doc_id, '@a@b @user' || doc_id || ', @averyveryverylonghandle @né @x中 ' || text AS t FROM documents)")
def mention_mask(spark, d):
    t = F.concat(F.lit("@a@b @user"), F.col("doc_id").cast("string"), F.lit(", @averyveryverylonghandle @né @x中 "), "text")
    return I.documents(spark, d).select("doc_id", T.mask_mentions(t).alias("masked"))


@query(f"SELECT doc_id, {_retweets_sql('t')} AS stripped FROM (SELECT doc_id, 'rt  @user' || doc_id || '： 转发@näme: ' || text || ' Retweet @x: ' AS t FROM documents)")
def retweet_strip(spark, d):
    t = F.concat(F.lit("rt  @user"), F.col("doc_id").cast("string"), F.lit("： 转发@näme: "), "text", F.lit(" Retweet @x: "))
    return I.documents(spark, d).select("doc_id", T.strip_retweets(t).alias("stripped"))


@query(
    """SELECT page_id, 's' || (row_number() OVER (ORDER BY page_id) + (SELECT max(doc_id) FROM documents)) AS id FROM pages"""
)
def assign_ids(spark, d):
    last = cleaning.max_id(I.documents(spark, d).select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("id"))).first()["max_id"]
    return cleaning.assign_ids(I.table(spark, d, "pages").select("page_id"), "page_id", last + 1)


@query("SELECT CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...[截断]' ELSE text END AS shortened, doc_id FROM documents")
def batch_text_shorten(spark, d):
    return I.documents(spark, d).select("doc_id", T.shorten(F.col("text")).alias("shortened"))


# --- answers

#: Answers that a labeller may give.
BINARY = ("1", "0", "Non-Sensitive", "非敏感", " 敏感 ", "不", '{"is_sensitive": 0}', '{"label": 1, "n": 0}', '{"label": true}', "1，0", "0 or 1", "maybe", '{"x": 2}', "none", "SENSITIVE")
COARSE = ("[1, 0]", '{"labels": [1, "0"]}', '```json\n["non-sensitive", "敏感"]\n```', "[1]", "[1, 2]", "[true, false]", '{"label": [0, 0]}', "[1, null]", "not json", "[1, 0.5]", '{"labels": [1, 0')
SUBTYPE = (
    '[{"id": 0, "labels": ["porn", "x"]}, {"id": 1, "labels": "abuse"}]', '```json\n{"labels": [["politics"], "y"]}\n```', '[{"id": 0, "labels": []}, {"labels": ["porn"]}, {"id": 1}]',
    '[{"id": 0, "labels": ["porn"]}, {"id": 0, "labels": ["abuse"]}, {"id": 1, "labels": ["other"]}]', '[{"id": 0, "labels": ["porn"]}]', "no json", '{"labels": [["porn", "abuse"], []]}',
)
NAMES = ('["porn", "abuse"]', "unknown content", "Politics and ABUSE", "", "other")
LINES = ("1. one\n- two\n\n 3.  three ", "", "a|b\n2.c", "- -")


def _pick(answers: tuple[str, ...]):
    return F.element_at(F.array(*map(F.lit, answers)), (F.pmod("doc_id", F.lit(len(answers))) + 1).cast("int"))


def _pick_sql(answers: tuple[str, ...]) -> str:
    quoted = ", ".join("'" + a.replace("'", "''") + "'" for a in answers)
    return f"([{quoted}])[(doc_id % {len(answers)}) + 1]"


def _binary_sql(r: str) -> str:
    s = f"lower({_strip_sql(r)})"
    neg = " OR ".join(f"contains({s}, '{w}')" for w in P.NEGATED)
    yes, no = f"(contains({s}, '1') OR contains({s}, 'sensitive') OR contains({s}, '敏感'))", f"(contains({s}, '0') OR contains({s}, 'non'))"
    js = f"lower(coalesce({r}->>'$.label', {r}->>'$.sensitive', {r}->>'$.is_sensitive'))"
    return f"""CASE WHEN {r} IS NULL THEN NULL WHEN {neg} OR starts_with({s}, '不') THEN 0 WHEN {yes} AND NOT {no} THEN 1
      WHEN {yes} AND (starts_with({s}, '1') OR starts_with({s}, 'sensitive') OR starts_with({s}, '敏感')) THEN 1
      WHEN {yes} AND (starts_with({s}, '0') OR starts_with({s}, 'non') OR starts_with({s}, '非')) THEN 0 WHEN NOT {yes} AND {no} THEN 0
      WHEN json_valid({r}) THEN CASE {js} WHEN 'true' THEN 1 WHEN 'false' THEN 0 ELSE TRY_CAST(TRY_CAST({js} AS DOUBLE) AS INTEGER) END END"""


@query(f"SELECT doc_id, coalesce(CAST({_binary_sql('r')} AS INTEGER), -1) AS label FROM (SELECT doc_id, {_pick_sql(BINARY)} AS r FROM documents)")
def parse_binary(spark, d):
    return I.documents(spark, d).select("doc_id", F.coalesce(P.binary_label(_pick(BINARY)), F.lit(-1)).alias("label"))


_FENCE = rf"""{_strip_sql("regexp_replace(regexp_replace(regexp_replace(" + _strip_sql('r') + ", '^```json', ''), '^```', ''), '```$', '')")}"""


@query(
    f"""WITH a AS (SELECT doc_id, {_pick_sql(COARSE)} AS r FROM documents), b AS (SELECT doc_id, {_FENCE} AS s FROM a),
    j AS (SELECT doc_id, CASE WHEN json_valid(s) THEN CASE WHEN starts_with(s, '{{') THEN coalesce(s->'$.labels', s->'$.label') ELSE s::JSON END END AS l FROM b),
    i AS (SELECT doc_id, json_array_length(l) AS n, unnest(range(json_array_length(l)::BIGINT)) AS k, l FROM j WHERE l IS NOT NULL AND json_type(l) = 'ARRAY'),
    e AS (SELECT doc_id, n, k, l->CAST(k AS INTEGER) AS v FROM i), f AS (SELECT doc_id, n, k, json_type(v) AS t, v->>'$' AS r FROM e),
    g AS (SELECT doc_id, n, k, CASE WHEN t = 'VARCHAR' THEN {_binary_sql('r')} WHEN t IN ('UBIGINT', 'BIGINT') AND r IN ('0', '1') THEN r::INTEGER
          WHEN t = 'BOOLEAN' THEN CAST(r = 'true' AS INTEGER) END AS v FROM f),
    h AS (SELECT doc_id, string_agg(v::VARCHAR, ',' ORDER BY k) AS labels FROM g GROUP BY doc_id HAVING max(n) = 2 AND count(v) = count(*))
    SELECT documents.doc_id, labels FROM documents LEFT JOIN h USING (doc_id)"""
)
def parse_batch_coarse(spark, d):
    labels = P.batch_labels(_pick(COARSE), 2)
    joined = F.when(labels.isNotNull(), F.concat_ws(",", labels.cast("array<string>")))
    return I.documents(spark, d).select("doc_id", joined.alias("labels"))


def _subtypes_of(value) -> str:
    """What a raw list or name stands for; as the SQL below has it for each answer."""
    good = [x for x in (value if isinstance(value, list) else [value]) if x in P.SUBTYPES]
    return "+".join(good or ["other"])


def _expected(answer: str) -> dict[int, str] | None:
    import json

    s = answer.strip().removeprefix("```json").removeprefix("```").removesuffix("```").strip()
    try:
        data = json.loads(s)
    except ValueError:
        return None
    out = {x["id"]: _subtypes_of(x.get("labels", [])) for x in data if x.get("id") is not None} if isinstance(data, list) else dict(enumerate(map(_subtypes_of, data["labels"])))
    return out if len(out) == 2 else None


def _rows_sql(answers: tuple[str, ...]) -> str:
    rows = [f"({k}, {i}, '{v}')" for k, a in enumerate(answers) for i, v in (_expected(a) or {}).items()]
    return f"(VALUES {', '.join(rows)}) AS v(k, item, labels)"


@query(f"SELECT doc_id, CAST(item AS INTEGER) AS item, labels FROM documents JOIN {_rows_sql(SUBTYPE)} ON doc_id % {len(SUBTYPE)} = k")
def parse_batch_subtype(spark, d):
    found = I.documents(spark, d).select("doc_id", F.explode(P.batch_subtypes(_pick(SUBTYPE), 2)).alias("item", "l"))
    return found.select("doc_id", "item", F.concat_ws("+", "l").alias("labels"))


@query(
    f"""WITH a AS (SELECT doc_id, lower({_pick_sql(NAMES)}) AS r FROM documents)
    SELECT doc_id, coalesce(nullif(array_to_string(list_filter(['porn', 'politics', 'abuse', 'other'], lambda x: contains(r, x)), ','), ''), 'other') AS labels FROM a"""
)
def parse_subtypes(spark, d):
    return I.documents(spark, d).select("doc_id", F.concat_ws(",", P.subtypes(_pick(NAMES))).alias("labels"))


@query(
    f"""WITH a AS (SELECT doc_id, unnest(string_split({_pick_sql(LINES)}, chr(10))) AS x FROM documents)
    SELECT doc_id, regexp_replace({_strip_sql('x')}, '^[0-9. \\t-]+', '') AS word FROM a WHERE regexp_replace({_strip_sql('x')}, '^[0-9. \\t-]+', '') <> ''"""
)
def llm_lines(spark, d):
    return I.documents(spark, d).select("doc_id", F.explode(P.answer_lines(_pick(LINES))).alias("word"))


# --- labelling

@query("SELECT doc_id FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def skip_existing(spark, d):
    return labeling.pending(I.documents(spark, d), I.table(spark, d, "labels"), "doc_id").select("doc_id")


_SENT = "CASE WHEN length(text) > 1000 THEN left(text, 1000) || '...[截断]' ELSE text END"


@query(
    "SELECT doc_id, CAST("
    + " OR ".join(f"contains(lower({_SENT}), '{w}')" for c in CATEGORIES for w in I.LEXICON[c])
    + " AS INTEGER) AS coarse_label FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)"
)
def label_task(spark, d):
    """The task sends at most 1000 characters of a text, as the labeller's interface has it."""
    task = labeling.LabelTask("coarse", P.binary_label)
    out = labeling.run_task(I.documents(spark, d).select("doc_id", "text"), labeling.RuleBackend(I.LEXICON), task, I.table(spark, d, "labels"), "doc_id")
    return out.select("doc_id", "coarse_label")


@query(
    """SELECT id, coarse_label, CASE WHEN coarse_label = 0 THEN '' WHEN doc_id % 3 > 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'abuse' ELSE 'other' END END AS labels,
       CASE WHEN coarse_label = 0 THEN '' WHEN doc_id % 3 > 0 THEN 'said ' || id END AS subtype_response
       FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, CAST(toxic AS INTEGER) AS coarse_label FROM labels)"""
)
def subtype_merge(spark, d):
    rows = I.predictions(spark, d).select("id", "doc_id", "coarse_label")
    named = F.array(F.when(F.col("doc_id") % 2 == 0, "abuse").otherwise("other"))
    answers = labeling.sensitive(rows).filter("doc_id % 3 > 0").select("id", named.alias("subtype_label"), F.concat(F.lit("said "), "id").alias("subtype_response"))
    out = labeling.merge_subtypes(rows, answers)
    return out.select("id", "coarse_label", F.when(F.col("subtype_label").isNotNull(), F.concat_ws(",", "subtype_label")).alias("labels"), "subtype_response")


@query(f"WITH {PRED} SELECT id FROM pred WHERE coarse_label = 1")
def sensitive_filter(spark, d):
    return labeling.sensitive(I.predictions(spark, d)).select("id")


@query(f"WITH {PRED} SELECT id FROM pred WHERE coarse_label = 1 AND doc_id % 2 = 0 ORDER BY md5('42:' || id), id LIMIT 100")
def category_sample(spark, d):
    named = F.array(F.when(F.col("doc_id") % 2 == 0, "abuse").otherwise("other"))
    return sampling.category_sample(I.predictions(spark, d).withColumn("subtype_label", named), "abuse", 100).select("id")


_SPLIT = f"""{PRED}, r AS (SELECT id, coarse_label, row_number() OVER (PARTITION BY coarse_label ORDER BY md5('42:' || id), id) AS k, count(*) OVER (PARTITION BY coarse_label) AS n FROM pred),
  split AS (SELECT id, coarse_label, CASE WHEN k <= round(n * 0.8e0) THEN 'train' WHEN k <= round(n * (0.8e0 + 0.1e0)) THEN 'dev' ELSE 'test' END AS split FROM r)"""


@query(f"WITH {_SPLIT} SELECT id, coarse_label, split FROM split")
def stratified_split(spark, d):
    return sampling.stratified_split(I.predictions(spark, d).select("id", "coarse_label"), "id", "coarse_label")


@query(
    f"""WITH {_SPLIT} SELECT split, count(*) AS n, count(*) FILTER (coarse_label = 1) AS positives, round(count(*) FILTER (coarse_label = 1) / count(*), 6) AS positive_ratio,
    round(count(*) / sum(count(*)) OVER (), 6) AS share FROM split GROUP BY split"""
)
def split_stats(spark, d):
    return sampling.split_stats(stratified_split(spark, d)).select("split", "n", "positives", *r6("positive_ratio", "share"))


@query(f"WITH {PRED} SELECT coarse_label AS label, count(*) AS n FROM pred GROUP BY 1")
def label_distribution(spark, d):
    return sampling.label_distribution(I.predictions(spark, d))


# --- knowledge

@query(f"WITH {COUNTED} SELECT doc_id, n_porn, n_politics, n_abuse FROM counted")
def lexicon_match_occurrence(spark, d):
    return I.counted(spark, d).select("doc_id", *[f"n_{c}" for c in CATEGORIES])


_DISTINCT = ", ".join("CAST(" + " + ".join(f"contains(low, '{w}')::INTEGER" for w in I.LEXICON[c]) + f" AS INTEGER) AS n_{c}" for c in CATEGORIES)


@query(f"SELECT doc_id, {_DISTINCT} FROM (SELECT doc_id, lower(text) AS low FROM documents)")
def lexicon_match_distinct(spark, d):
    return matching.with_counts(I.documents(spark, d), I.LEXICON, mode="distinct").select("doc_id", *[f"n_{c}" for c in CATEGORIES])


@query(f"WITH {COUNTED} SELECT doc_id, n_porn, n_politics, n_abuse FROM counted")
def lexicon_match_automaton(spark, d):
    return matching.automaton_counts(I.documents(spark, d).filter("length(text) > 0").select("doc_id", "text"), I.LEXICON).select("doc_id", *[f"n_{c}" for c in CATEGORIES])


#: Words of the benchmark that don't overlap themselves, so that SQL can count them by deleting them.
_TABLE_WORDS = """SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM benchmark)
  WHERE len(list_filter(range(1, length(word)), lambda k: left(word, k) = right(word, k))) = 0"""


@query(
    f"""WITH w AS ({_TABLE_WORDS}), x AS (SELECT doc_id, word, (length(low) - length(replace(low, word, ''))) // length(word) AS n
    FROM (SELECT doc_id, lower(text) AS low FROM documents) JOIN w ON contains(low, word))
    SELECT word, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n, min(doc_id) AS first_doc FROM x GROUP BY word"""
)
def lexicon_match_table(spark, d):
    """Words that are a table, in texts of any length, by their rarest grams."""
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")
    words = I.table(spark, d, "benchmark").select(word).distinct()
    plain = F.size(F.filter(F.sequence(F.lit(1), F.length("word") - 1), lambda k: F.left("word", k) == F.right("word", k))) == 0
    found = anchors.word_matches(I.documents(spark, d), words.filter(plain).select(F.lit("abuse").alias("category"), "word"), "doc_id")
    return found.groupBy("word").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n"), F.min("doc_id").alias("first_doc"))


@query(
    r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN regexp_matches(text, '(?i)lo[sz]er') THEN 'loser' END, CASE WHEN regexp_matches(text, '(?i)\bclown') THEN 'clown' END,
    CASE WHEN regexp_matches(text, '(?i)TRASH$') THEN 'trash at the end' END], lambda x: x IS NOT NULL), ',') AS rules FROM documents"""
)
def regex_match(spark, d):
    return I.documents(spark, d).select("doc_id", F.concat_ws(",", matching.regex_hits(F.col("text"), I.RULES)).alias("rules"))


@query(f"WITH {SCORED} SELECT doc_id, round(q0, 9) AS p_non, round(q1, 9) AS p_sensitive FROM scored")
def q0_score(spark, d):
    return I.scored(spark, d).select("doc_id", F.round(F.col("q0")[0], 9).alias("p_non"), F.round(F.col("q0")[1], 9).alias("p_sensitive"))


_SCORE = f"(n_porn * 1.0e0 + n_politics * {I.CONFIG.politics_weight}::DOUBLE + n_abuse * {I.CONFIG.abuse_weight}::DOUBLE) / words"


@query(
    f"""WITH {COUNTED} SELECT doc_id, n_porn + n_politics + n_abuse AS total_matches, round(CASE WHEN n_porn + n_politics + n_abuse >= 1 THEN {_SCORE} ELSE 0 END, 9) AS match_score,
    {', '.join(f"array_to_string(flatten([{', '.join(f'''list_transform(range(({I._count(w)})::BIGINT), lambda i: '{w}')''' for w in I.LEXICON[c])}]), ',') AS {c}" for c in CATEGORIES)}
    FROM counted"""
)
def q0_details(spark, d):
    x = knowledge.with_q0(I.documents(spark, d), I.LEXICON, I.CONFIG, details=True)
    return x.select("doc_id", "total_matches", F.round("match_score", 9).alias("match_score"), *[F.concat_ws(",", f"q0_details.{c}_matches").alias(c) for c in CATEGORIES])


@query(
    f"""WITH {SCORED} SELECT count(*) AS processed, round(avg(q1), 6) AS avg_p, count(*) FILTER (q1 > 0.5) AS sensitive, count(*) FILTER (q1 <= 0.5) AS non_sensitive,
    (SELECT count(*) FROM documents) AS total FROM scored"""
)
def q0_stats(spark, d):
    x = knowledge.q0_stats(I.documents(spark, d), I.scored(spark, d))
    return x.select("processed", *r6("avg_p"), "sensitive", "non_sensitive", "total")


def _metrics_sql(y: str, pred: str) -> str:
    tp, fp, fn, tn = (f"count(*) FILTER ({y} = {a} AND {pred} = {b})" for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    return f"""{tp} + {fp} + {fn} + {tn} AS n, round(coalesce(({tp} + {tn}) / nullif({tp} + {fp} + {fn} + {tn}, 0), 0), 6) AS accuracy,
      round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6) AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6) AS recall,
      round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6) AS f1, {tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn"""


@query(
    f"""WITH {JOINED}, m AS (SELECT {_metrics_sql('coarse_label', 'CAST(q1 > 0.5 AS INTEGER)')}, round(avg(q1), 6) AS avg_p FROM joined)
    SELECT *, CASE WHEN precision >= 0.75 THEN 'good' WHEN precision >= 0.70 THEN 'fair' ELSE 'low' END AS precision_verdict,
    CASE WHEN avg_p > 0.8 THEN 'high' WHEN avg_p >= 0.5 THEN 'balanced' ELSE 'low' END AS level_verdict FROM m"""
)
def q0_quality(spark, d):
    x = knowledge.q0_quality(I.joined(spark, d).select("coarse_label", F.array("q0", "q1").alias("q0")))
    return x.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall", "f1", "avg_p")})


_FAST = ", ".join(f"({i}, {m}, {b}::DOUBLE, {t}::DOUBLE, {p}::DOUBLE, {a}::DOUBLE)" for i, (m, b, t, p, a) in enumerate(knowledge.product(*knowledge.GRIDS["fast"])))


@query(
    f"""WITH {JOINED}, g(param_id, min_matches, base_prob, max_prob, politics_weight, abuse_weight) AS (VALUES {_FAST}),
    x AS (SELECT g.*, coarse_label AS y, CAST({I.q_sql('base_prob', 'max_prob', 'min_matches', 'politics_weight', 'abuse_weight')} > 0.5 AS INTEGER) AS pred FROM joined CROSS JOIN g)
    SELECT CAST(param_id AS INTEGER) AS param_id, CAST(min_matches AS INTEGER) AS min_matches, base_prob, max_prob, politics_weight, abuse_weight, precision, recall, f1, tp, fp, fn, tn
    FROM (SELECT param_id, min_matches, base_prob, max_prob, politics_weight, abuse_weight, {_metrics_sql('y', 'pred')} FROM x GROUP BY ALL)"""
)
def q0_grid_search(spark, d):
    rows = I.joined(spark, d).withColumn("words", T.word_count(F.col("text")))
    return knowledge.grid_search(rows, "fast").withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


# --- uncertainty and calibration

@query(
    f"""WITH {PRED} SELECT id, round(1 - greatest(p0, p1), 9) AS u_max, round(-(p0 * ln(p0 + 1e-10) + p1 * ln(p1 + 1e-10)) / ln(2), 9) AS u_entropy,
    round(1 - abs(p0 - p1), 9) AS u_margin, round(greatest(p0, p1), 9) AS max_prob FROM pred"""
)
def uncertainty_metrics(spark, d):
    p = F.col("pred_probs")
    return I.predictions(spark, d).select("id", *[F.round(S.uncertainty(p, m), 9).alias(m) for m in ("u_max", "u_entropy", "u_margin")], F.round(F.array_max(p), 9).alias("max_prob"))


_BUCKETS = f"""{PRED}, b AS (SELECT {bucket_sql('uncertainty')} AS bucket_id, * FROM pred),
  buckets AS (SELECT bucket_id, {I.ALL_EDGES}[bucket_id + 1] AS u_min, {I.ALL_EDGES}[bucket_id + 2] AS u_max, avg(uncertainty) AS u_mean, quantile_cont(uncertainty, 0.5) AS u_median,
    count(*) AS n_samples, count(*) FILTER (pred_label <> coarse_label) AS n_errors, count(*) FILTER (pred_label <> coarse_label) / count(*) AS error_rate, avg(pred_prob) AS avg_confidence
    FROM b WHERE coarse_label IS NOT NULL GROUP BY bucket_id)"""


@query(f"WITH {_BUCKETS} SELECT bucket_id, u_min, u_max, {r6_sql('u_mean', 'u_median', 'error_rate', 'avg_confidence')}, n_samples, n_errors FROM buckets")
def uncertainty_buckets(spark, d):
    x = calibration.uncertainty_buckets(I.predictions(spark, d))
    return x.select("bucket_id", "u_min", "u_max", *r6("u_mean", "u_median", "error_rate", "avg_confidence"), "n_samples", "n_errors")


@query(f"WITH {_BUCKETS} SELECT bucket_id, u_min, u_max, {r6_sql('u_mean')}, n_samples FROM buckets")
def auto_buckets(spark, d):
    return calibration.auto_buckets(I.predictions(spark, d)).select("bucket_id", "u_min", "u_max", *r6("u_mean"), "n_samples")


@query(f"WITH {_BUCKETS} SELECT round(corr(u_mean, error_rate), 6) AS correlation FROM buckets")
def bucket_error_corr(spark, d):
    return calibration.error_correlation(calibration.uncertainty_buckets(I.predictions(spark, d), median=False)).select(*r6("correlation"))


@query(f"WITH {PRED} SELECT {_metrics_sql('coarse_label', 'pred_label')} FROM pred")
def binary_metrics(spark, d):
    return I.predictions(spark, d).agg(*metrics.named(metrics.binary(F.col("coarse_label"), F.col("pred_label")), 6))


@query(
    f"""WITH {PRED}, m AS (SELECT {_metrics_sql('coarse_label', 'pred_label')} FROM pred), z AS (SELECT {_metrics_sql('1 - coarse_label', '1 - pred_label')} FROM pred)
    SELECT 1 AS class, precision, recall, f1, tp + fn AS support FROM m UNION ALL SELECT 0, precision, recall, f1, tp + fn FROM z"""
)
def per_class_metrics(spark, d):
    return metrics.per_class(I.predictions(spark, d), "coarse_label", "pred_label").select("class", *r6("precision", "recall", "f1"), "support")


@query(f"WITH {PRED} SELECT round(avg(-ln(greatest(least(CASE WHEN coarse_label = 1 THEN p1 ELSE 1 - p1 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))), 6) AS nll FROM pred")
def nll(spark, d):
    return I.predictions(spark, d).agg(metrics.nll(F.col("coarse_label"), F.col("p1")).alias("nll")).select(*r6("nll"))


@query(f"WITH {PRED} SELECT id, round(pred_prob, 9) AS pred_prob, pred_label, coarse_label FROM pred WHERE pred_prob >= 0.55e0 AND pred_label <> coarse_label")
def high_conf_errors(spark, d):
    return hardset.high_confidence_errors(I.predictions(spark, d), 0.55).select("id", F.round("pred_prob", 9).alias("pred_prob"), "pred_label", "coarse_label")


_CAL = """c AS (SELECT {by} {b} AS bucket_id, avg(p1) AS prob_mean, count(*) AS n_samples, count(*) FILTER (coarse_label = 1) AS n_correct FROM {t} GROUP BY ALL),
  g AS (SELECT *, n_correct / n_samples AS accuracy, abs(n_correct / n_samples - prob_mean) AS gap, sum(n_samples) OVER ({w}) AS total FROM c)"""


@query(
    f"""WITH {PRED}, {_CAL.format(by='', b=bucket_sql('p1'), t='pred', w='')}
    SELECT bucket_id, {I.ALL_EDGES}[bucket_id + 1] AS prob_min, {I.ALL_EDGES}[bucket_id + 2] AS prob_max, {r6_sql('prob_mean', 'accuracy', 'gap')}, n_samples, n_correct,
    round(n_samples / total * gap, 6) AS ece_contribution FROM g"""
)
def calibration_buckets(spark, d):
    x = calibration.calibration_buckets(I.predictions(spark, d))
    return x.select("bucket_id", "prob_min", "prob_max", *r6("prob_mean", "accuracy", "gap"), "n_samples", "n_correct", *r6("ece_contribution"))


@query(
    f"""WITH {PRED}, {_CAL.format(by='', b=bucket_sql('p1'), t='pred', w='')}
    SELECT round(sum(n_samples * gap) / sum(n_samples), 6) AS ece, round(max(gap), 6) AS mce, (SELECT round(avg((p1 - coarse_label) * (p1 - coarse_label)), 6) FROM pred) AS brier FROM g"""
)
def ece_mce_brier(spark, d):
    return calibration.calibration_errors(I.predictions(spark, d)).select(*r6("ece", "mce", "brier"))


_SETS = f"{_SPLIT}, sets AS (SELECT split AS part, pred.* FROM pred JOIN split USING (id) UNION ALL SELECT 'overall', pred.* FROM pred)"


@query(
    f"""WITH {_SETS}, {_CAL.format(by='part,', b=bucket_sql('p1'), t='sets', w='PARTITION BY part')}, e AS (SELECT part, sum(n_samples * gap) / sum(n_samples) AS ece, max(gap) AS mce FROM g GROUP BY part),
    q AS (SELECT part, avg((p1 - coarse_label) * (p1 - coarse_label)) AS brier FROM sets GROUP BY part)
    SELECT part, {r6_sql('ece', 'mce', 'brier')} FROM e JOIN q USING (part)"""
)
def calibration_overall(spark, d):
    pred = I.predictions(spark, d)
    split = sampling.stratified_split(pred, "id", "coarse_label").withColumnRenamed("split", "part")
    both = split.withColumn("part", F.explode(F.array("part", F.lit("overall"))))
    return calibration.calibration_errors(both, ["part"]).select("part", *r6("ece", "mce", "brier"))


_TEACH = f"{PRED}, teach AS (SELECT id, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN (doc_id * 31) % 7 < 5 THEN CAST(toxic AS INTEGER) ELSE 1 - CAST(toxic AS INTEGER) END AS teacher_label FROM (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, toxic FROM labels))"


def _teacher(spark, d):
    y, i = F.col("coarse_label"), F.col("doc_id")
    return I.predictions(spark, d).select("id", F.when(i % 11 == 0, F.lit(None)).when((i * 31) % 7 < 5, y).otherwise(1 - y).alias("teacher_label"))


@query(
    f"""WITH {_TEACH}, x AS (SELECT pred.*, teacher_label, list_filter([CASE WHEN pred_label <> coarse_label AND teacher_label = coarse_label THEN 'baseline_wrong_teacher_correct' END,
      CASE WHEN pred_prob >= 0.55e0 AND pred_label <> coarse_label THEN 'high_conf_error' END, CASE WHEN pred_label <> teacher_label THEN 'prediction_mismatch' END], lambda v: v IS NOT NULL) AS kinds
      FROM pred JOIN teach USING (id) WHERE teacher_label IS NOT NULL)
    SELECT id, pred_label, teacher_label, coarse_label, round(pred_prob, 9) AS pred_prob, array_to_string(kinds, ',') AS kinds FROM x WHERE len(kinds) > 0 ORDER BY x.pred_prob DESC, id DESC LIMIT 200"""
)
def disagreement_hardset(spark, d):
    x = hardset.hard_set(hardset.disagreements(I.predictions(spark, d), _teacher(spark, d), 0.55), 200)
    return x.select("id", "pred_label", "teacher_label", "coarse_label", F.round("pred_prob", 9).alias("pred_prob"), F.concat_ws(",", "disagreement_type").alias("kinds"))


# --- fusion

@query(f"WITH {_BUCKETS} SELECT id, x.bucket_id AS bucket_id FROM pred JOIN buckets AS x ON uncertainty >= x.u_min AND uncertainty < x.u_max OR uncertainty = 1 AND abs(x.u_max - 1) < 1e-9")
def range_bucket_join(spark, d):
    pred = I.predictions(spark, d)
    return fusion.assign_buckets(pred, calibration.auto_buckets(pred)).select("id", "bucket_id")


@query(f"WITH {JOINED} SELECT id, round({fuse_sql('0.75e0')}, 9) AS f1, CAST({fuse_sql('0.75e0')} > 0.5 AS INTEGER) AS fused_label FROM joined")
def emg_fusion(spark, d):
    x = fusion.fused(I.joined(spark, d), F.lit(0.75))
    return x.select("id", F.round("f1", 9).alias("f1"), "fused_label")


def _eval_sql(methods: dict[str, str], by: str = "", source: str = "joined") -> str:
    part = f"{by}, " if by else ""
    arms = " UNION ALL ".join(f"SELECT {part}'{n}' AS method, coarse_label AS y, {m} AS m1 FROM {source}" for n, m in methods.items())
    return f"""arms AS ({arms}), cells AS (SELECT {part}method, {bucket_sql('m1')} AS b, abs(sum(y) - sum(m1)) AS gap FROM arms GROUP BY ALL),
      ece AS (SELECT {part}method, sum(gap) AS gap FROM cells GROUP BY ALL),
      evaluated AS (SELECT {part}method, n AS n_samples, accuracy, precision, recall, f1, round(nll, 6) AS nll, round(gap / n, 6) AS ece FROM (
        SELECT {part}method, {_metrics_sql('y', 'CAST(m1 > 0.5 AS INTEGER)')}, avg(-ln(greatest(least(CASE WHEN y = 1 THEN m1 ELSE 1 - m1 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS nll
        FROM arms GROUP BY ALL) JOIN ece USING ({part}method))"""


#: The weight falls as uncertainty grows: a lookup table of four points.
LUT = [(0.0, 1.0), (0.1, 0.8), (0.3, 0.6), (0.5, 0.4)]
_ALPHA = "CASE WHEN uncertainty <= 0 THEN 1e0 WHEN uncertainty < 0.1e0 THEN 1e0 + (0.8e0 - 1e0) * uncertainty / 0.1e0 WHEN uncertainty < 0.3e0 THEN 0.8e0 + (0.6e0 - 0.8e0) * (uncertainty - 0.1e0) / (0.3e0 - 0.1e0) WHEN uncertainty < 0.5e0 THEN 0.6e0 + (0.4e0 - 0.6e0) * (uncertainty - 0.3e0) / (0.5e0 - 0.3e0) ELSE 0.4e0 END"


def _alpha():
    return S.lut_alpha(F.col("uncertainty"), LUT)


_ROUND = ("accuracy", "precision", "recall", "f1", "nll", "ece")


def _evaluated(df, *by: str):
    return df.select(*by, "method", "n_samples", *r6(*_ROUND))


@query(f"WITH {JOINED}, {_eval_sql({'baseline': 'p1', 'fixed_alpha': fuse_sql('0.5e0'), 'emg': fuse_sql(_ALPHA)})} SELECT * FROM evaluated")
def fixed_alpha_eval(spark, d):
    return _evaluated(fusion.evaluate(I.joined(spark, d), {"baseline": None, "fixed_alpha": F.lit(0.5), "emg": _alpha()}))


_GRID = f"""{JOINED}, b AS (SELECT *, {bucket_sql('uncertainty')} AS bucket_id FROM joined), grid(pos, alpha) AS (VALUES {', '.join(f'({i}, {a}::DOUBLE)' for i, a in enumerate(ALPHAS))}),
  x AS (SELECT bucket_id, pos, alpha, coarse_label AS y, {fuse_sql('alpha')} AS m1 FROM b CROSS JOIN grid),
  s AS (SELECT bucket_id, pos, alpha, f1, nll FROM (SELECT bucket_id, pos, alpha, {_metrics_sql('y', 'CAST(m1 > 0.5 AS INTEGER)')},
    avg(-ln(greatest(least(CASE WHEN y = 1 THEN m1 ELSE 1 - m1 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS nll FROM x GROUP BY ALL))"""


def _searched(spark, d):
    rows = I.joined(spark, d)
    return fusion.alpha_grid_search(rows.withColumn("bucket_id", S.bucket(F.col("uncertainty"))), ["bucket_id"], ALPHAS)


@query(f"WITH {_GRID} SELECT bucket_id, alpha AS alpha_star, round(f1, 6) AS f1_at_alpha_star, round(nll, 6) AS nll_at_alpha_star FROM s QUALIFY row_number() OVER (PARTITION BY bucket_id ORDER BY f1 DESC, pos) = 1")
def alpha_grid_search(spark, d):
    return fusion.best_alpha(_searched(spark, d), ["bucket_id"]).select("bucket_id", "alpha_star", *r6("f1_at_alpha_star", "nll_at_alpha_star"))


@query(
    f"WITH {_GRID} SELECT bucket_id, "
    + ", ".join(f"round(max(CASE WHEN pos = {i} THEN {m} END), 6) AS alpha_{str(a).replace('.', '_')}_{m}" for i, a in enumerate(ALPHAS) for m in ("f1", "nll"))
    + " FROM s GROUP BY bucket_id"
)
def alpha_grid_pivot(spark, d):
    x = fusion.alpha_pivot(_searched(spark, d), ["bucket_id"], ALPHAS)
    return x.select("bucket_id", *r6(*[c for c in x.columns if c != "bucket_id"]))


#: Points for the monotone fit: mean uncertainty and share of right predictions, as one point per bucket.
_POINTS = f"""{_BUCKETS}, pts AS (SELECT u_mean AS u, 1 - error_rate AS alpha, row_number() OVER (ORDER BY u_mean) AS k FROM buckets)"""
_FIT = f"""{_POINTS}, runs AS (SELECT a.k AS j, b.k AS e, avg(c.alpha) AS m FROM pts a JOIN pts b ON b.k >= a.k JOIN pts c ON c.k BETWEEN a.k AND b.k GROUP BY 1, 2),
  worst AS (SELECT p.k, r.j, max(r.m) AS m FROM pts p JOIN runs r ON r.j <= p.k AND r.e >= p.k GROUP BY 1, 2), fit AS (SELECT k, min(m) AS fitted FROM worst GROUP BY k)"""


def _points(spark, d):
    return calibration.uncertainty_buckets(I.predictions(spark, d), median=False).select(F.col("u_mean").alias("u"), (1 - F.col("error_rate")).alias("alpha"))


@query(f"WITH {_FIT} SELECT {r6_sql('u', 'alpha', 'fitted')} FROM pts JOIN fit USING (k)")
def pav_fit(spark, d):
    return fusion.fit_monotone(_points(spark, d)).select(*r6("u", "alpha", "fitted"))


@query(
    f"""WITH {_FIT}, f AS (SELECT k, u, fitted, lead(u) OVER (ORDER BY k) AS u2, lead(fitted) OVER (ORDER BY k) AS f2 FROM pts JOIN fit USING (k)),
    ends AS (SELECT min(u) AS lo, max(u) AS hi, arg_max(fitted, u) AS last FROM f), grid AS (SELECT CAST(i AS INTEGER) AS pos, CASE WHEN i = 99 THEN hi ELSE lo + i * ((hi - lo) / 99) END AS x, hi, last FROM ends, range(100) t(i))
    SELECT pos, round(x, 6) AS u, round(greatest(0, least(1, coalesce(fitted + (f2 - fitted) * (x - u) / (u2 - u), last))), 6) AS alpha FROM grid LEFT JOIN f ON x >= u AND x < u2"""
)
def alpha_lut(spark, d):
    return fusion.lut(fusion.fit_monotone(_points(spark, d))).select("pos", *r6("u", "alpha"))


@query(f"WITH {PRED} SELECT id, round({_ALPHA}, 9) AS alpha FROM pred")
def lut_lookup(spark, d):
    return I.predictions(spark, d).select("id", F.round(_alpha(), 9).alias("alpha"))


_GATES = {
    "emg": _ALPHA, "threshold": f"CASE WHEN greatest(q0, q1) < 0.6e0 THEN 1e0 ELSE {_ALPHA} END",
    "both": f"CASE WHEN (p1 > p0) <> (q1 > q0) THEN 1e0 WHEN greatest(q0, q1) < 0.6e0 THEN 1e0 ELSE {_ALPHA} END",
}


@query(f"WITH {JOINED}, {_eval_sql({k: fuse_sql(v) for k, v in _GATES.items()})} SELECT * FROM evaluated")
def gated_eval(spark, d):
    rows = I.joined(spark, d)
    a = _alpha()
    return _evaluated(fusion.evaluate(rows, {"emg": a, "threshold": fusion.gated(rows, a, 0.6), "both": fusion.gated(rows, a, 0.6, True)}))


_THRESH = f"""{JOINED}, grid(pos, threshold) AS (VALUES {', '.join(f'({i}, {t}::DOUBLE)' for i, t in enumerate(THRESHOLDS))}),
  x AS (SELECT pos, threshold, coarse_label AS y, {fuse_sql(f'CASE WHEN greatest(q0, q1) < threshold THEN 1e0 ELSE {_ALPHA} END')} AS m1 FROM joined CROSS JOIN grid),
  s AS (SELECT pos, threshold, f1, nll FROM (SELECT pos, threshold, {_metrics_sql('y', 'CAST(m1 > 0.5 AS INTEGER)')},
    avg(-ln(greatest(least(CASE WHEN y = 1 THEN m1 ELSE 1 - m1 END, 1 - 2.220446049250313e-16), 2.220446049250313e-16))) AS nll FROM x GROUP BY ALL))"""


@query(f"WITH {_THRESH} SELECT threshold, round(f1, 6) AS f1, round(nll, 6) AS nll, pos = first_value(pos) OVER (ORDER BY f1 DESC, pos) AS best FROM s")
def knowledge_threshold_search(spark, d):
    x = fusion.threshold_search(I.joined(spark, d), _alpha(), THRESHOLDS)
    best = fusion.best_threshold(x).select("best_threshold")
    return x.crossJoin(F.broadcast(best)).select("threshold", *r6("f1", "nll"), (F.col("threshold") == F.col("best_threshold")).alias("best"))


_SLICE = "CASE WHEN uncertainty < 0.1e0 THEN 'u_<_0.1' WHEN uncertainty < 0.3e0 THEN 'u_0.1_0.3' ELSE 'u_≥_0.3' END"
_SLICED = f"{JOINED}, sliced AS (SELECT *, {_SLICE} AS part FROM joined)"


@query(f"WITH {_SLICED}, {_eval_sql({'baseline': 'p1', 'emg': fuse_sql(_ALPHA)}, 'part', 'sliced')} SELECT * FROM evaluated")
def slice_eval(spark, d):
    rows = I.joined(spark, d).withColumn("part", fusion.u_slice(F.col("uncertainty")))
    return _evaluated(fusion.evaluate(rows, {"baseline": None, "emg": _alpha()}, ["part"]), "part")


@query(
    f"""WITH {JOINED}, {_eval_sql({'baseline': 'p1', 'fixed_alpha': fuse_sql('0.5e0'), 'emg': fuse_sql(_ALPHA)})}, e AS (SELECT * FROM evaluated WHERE method = 'emg')
    SELECT b.method AS versus, round(e.f1 - b.f1, 5) AS f1_improvement, round(b.nll - e.nll, 5) AS nll_reduction, round(b.ece - e.ece, 5) AS ece_reduction,
    round(CASE WHEN b.f1 > 0 THEN (e.f1 - b.f1) / b.f1 * 100 ELSE 0 END, 2) AS f1_improvement_pct, round(CASE WHEN b.nll > 0 THEN (b.nll - e.nll) / b.nll * 100 ELSE 0 END, 2) AS nll_reduction_pct,
    round(CASE WHEN b.ece > 0 THEN (b.ece - e.ece) / b.ece * 100 ELSE 0 END, 2) AS ece_reduction_pct FROM evaluated b, e WHERE b.method <> 'emg'"""
)
def method_comparison(spark, d):
    x = fusion.compare_methods(fixed_alpha_eval(spark, d))
    return x.select("versus", *[F.round(c, 2 if c.endswith("pct") else 5).alias(c) for c in x.columns if c != "versus"])


@query(
    f"""WITH {_SLICED}, every AS (SELECT * REPLACE ('all' AS part) FROM sliced UNION ALL SELECT * FROM sliced),
    {_eval_sql({'baseline': 'p1', 'emg': fuse_sql(_ALPHA)}, 'part', 'every')} SELECT part AS dataset, * EXCLUDE (part) FROM evaluated"""
)
def comparison_table(spark, d):
    rows = I.joined(spark, d).withColumn("dataset", F.explode(F.array(F.lit("all"), fusion.u_slice(F.col("uncertainty")))))
    return _evaluated(fusion.evaluate(rows, {"baseline": None, "emg": _alpha()}, ["dataset"]), "dataset")


# --- credibility

_SUB = "CASE WHEN coarse_label = 0 THEN [] WHEN doc_id % 2 = 0 THEN ['abuse', 'porn'] ELSE ['other'] END"
_MATCHED = "list_filter([CASE WHEN n_porn > 0 THEN 'porn' END, CASE WHEN n_politics > 0 THEN 'politics' END, CASE WHEN n_abuse > 0 THEN 'abuse' END], lambda v: v IS NOT NULL)"
_FEATURES = f"""{JOINED}, f0 AS (SELECT *, {_SUB} AS sub, {_MATCHED} AS cats, n_porn + n_politics + n_abuse AS total, length(text) AS chars FROM joined),
  feats AS (SELECT id, doc_id, coarse_label, {', '.join(f'n_{c}::DOUBLE AS lexicon_match_{c}' for c in CATEGORIES)}, total::DOUBLE AS total_matches, total / words AS match_ratio,
  {', '.join(f'(n_{c} > 0)::INTEGER::DOUBLE AS has_{c}_match' for c in CATEGORIES)}, {', '.join(f"(n_{c} > 0 AND list_contains(sub, '{c}'))::INTEGER::DOUBLE AS subtype_match_{c}" for c in CATEGORIES)},
  CASE WHEN len(sub) = 0 AND len(cats) = 0 THEN 1e0 WHEN len(sub) = 0 OR len(cats) = 0 THEN 0e0 ELSE len(list_intersect(sub, cats)) / len(list_distinct(list_concat(sub, cats))) END AS subtype_match_score,
  coalesce(total / nullif(chars, 0), 0) AS match_density, coalesce(total * 3.0e0 / nullif(chars, 0), 0) AS match_span_ratio,
  (n_porn >= n_politics AND n_porn >= n_abuse)::INTEGER::DOUBLE AS max_match_category_porn, (n_politics > n_porn AND n_politics >= n_abuse)::INTEGER::DOUBLE AS max_match_category_politics,
  (n_abuse > n_porn AND n_abuse > n_politics)::INTEGER::DOUBLE AS max_match_category_abuse, 1.0e0 AS source_confidence_porn, 0.8e0 AS source_confidence_politics, 0.6e0 AS source_confidence_abuse,
  coalesce((n_porn + 0.8e0 * n_politics + 0.6e0 * n_abuse) / nullif(total, 0), 0) AS weighted_source_confidence FROM f0)"""


def _featured(spark, d):
    y, i = F.col("coarse_label"), F.col("doc_id")
    none = F.array().cast("array<string>")
    sub = F.when(y == 0, none).when(i % 2 == 0, F.array(F.lit("abuse"), F.lit("porn"))).otherwise(F.array(F.lit("other")))
    return credibility.with_features(I.joined(spark, d).withColumn("subtype_label", sub))


@query(f"WITH {_FEATURES} SELECT id, {r6_sql(*credibility.FEATURES)} FROM feats")
def pkri_features(spark, d):
    return _featured(spark, d).select("id", *r6(*credibility.FEATURES))


@query()
def pkri_train(spark, d):
    """Fits and applies the classifier; coefficients are the optimiser's, so SQL can't give them."""
    rows = _featured(spark, d).withColumn("label", F.col("coarse_label").cast("double"))
    model = credibility.train(rows)
    return credibility.predict(model, rows).select("id", *r6("probability", "confidence"), "prediction")


@query(
    f"""WITH {PRED} SELECT id, round(p1, 9) AS raw, round(greatest(0, least(1, 0.3e0 + 0.6e0 * tanh((p1 - 0.5e0) * 4))), 9) AS tanh,
    round(greatest(0, least(1, CASE WHEN p1 < 0.6e0 THEN 0.4e0 + (p1 - 0.5e0) * 2 ELSE 0.6e0 + (p1 - 0.6e0) * 0.75e0 END)), 9) AS piecewise FROM pred"""
)
def confidence_maps(spark, d):
    return I.predictions(spark, d).select("id", *[F.round(S.confidence(F.col("p1"), m), 9).alias(m) for m in ("raw", "tanh", "piecewise")])


_CONF = "greatest(0, least(1, 0.3e0 + 0.6e0 * tanh((p1 - 0.5e0) * 4)))"
_S = "(tanh((1.0e0 * n_porn + 0.6e0 * n_politics + 0.5e0 * n_abuse) / greatest(n_porn + n_politics + n_abuse, 1) * 5) + 1) / 2"


def _qpkri_sql(x: str) -> str:
    return f"CASE WHEN n_porn + n_politics + n_abuse = 0 THEN 0.1e0 ELSE greatest(0, least(1, 0.1e0 + (0.75e0 - 0.1e0) * ({x}))) END"


_BUILT = {
    "original": _qpkri_sql(f"{_S} * conf"), "improved_weighted": _qpkri_sql(f"({_S}) * 0.7e0 + conf * 0.3e0"), "shifted": _qpkri_sql(f"({_S}) * (1 + (conf - 0.5e0) * 0.5e0)"),
    "q0_based": "greatest(0.1e0, least(0.9e0, q1 * (0.7e0 + (1 - 0.7e0) * greatest(0.5e0, least(1.3e0, 0.5e0 + (conf - 0.5e0) * (1.3e0 - 0.5e0) / (0.9e0 - 0.5e0))))))",
}
_QPKRI = f"{JOINED}, c AS (SELECT *, {_CONF} AS conf FROM joined), qpkri AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _BUILT.items())} FROM c)"


def _qpkri(spark, d):
    n = {c: F.col(f"n_{c}") for c in CATEGORIES}
    x = I.joined(spark, d).withColumn("conf", S.confidence(F.col("p1")))
    return x.withColumns({m: S.credible(n, F.col("conf"), "offset" if m == "shifted" else m, F.col("q1")) for m in _BUILT})


@query(f"WITH {_QPKRI} SELECT id, {', '.join(f'round({m}, 9) AS {m}' for m in _BUILT)} FROM qpkri")
def qpkri_build(spark, d):
    return _qpkri(spark, d).select("id", *[F.round(m, 9).alias(m) for m in _BUILT])


@query(f"WITH {_QPKRI} SELECT round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, round(min(conf), 6) AS min, round(max(conf), 6) AS max, round(avg(improved_weighted), 6) AS avg_p FROM qpkri")
def qpkri_stats(spark, d):
    x = credibility.confidence_stats(_qpkri(spark, d), "improved_weighted", "conf")
    return x.select(*r6(*x.columns))


def _dist_sql(c: str, hi: float, mid: float, lo: float) -> str:
    return f"""SELECT '{c}' AS name, round(avg({c}), 6) AS mean, round(quantile_cont({c}, 0.5), 6) AS median, round(stddev_pop({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max,
      round(avg(({c} > {hi}::DOUBLE)::INTEGER), 6) AS share_high, round(avg(({c} > {mid}::DOUBLE)::INTEGER), 6) AS share_mid, round(avg(({c} < {lo}::DOUBLE)::INTEGER), 6) AS share_low FROM q"""


_DIST = {"q0_max": (0.9, 0.7, 0.3), "qpkri_max": (0.9, 0.7, 0.3), "conf": (0.8, 0.6, 0.4), "diff": (0.2, 0.1, -0.1)}
_MAXES = f"{_QPKRI}, q AS (SELECT *, greatest(q0, q1) AS q0_max, greatest(improved_weighted, 1 - improved_weighted) AS qpkri_max, greatest(improved_weighted, 1 - improved_weighted) - greatest(q0, q1) AS diff FROM qpkri)"


def _maxes(spark, d):
    x = _qpkri(spark, d)
    p = F.col("improved_weighted")
    x = x.withColumns({"q0_max": F.greatest("q0", "q1"), "qpkri_max": F.greatest(p, 1 - p)})
    return x.withColumn("diff", F.col("qpkri_max") - F.col("q0_max"))


@query(f"WITH {_MAXES} " + " UNION ALL ".join(_dist_sql(c, *v) for c, v in _DIST.items()))
def q_distribution(spark, d):
    x = credibility.distribution(_maxes(spark, d), _DIST)
    return x.select("name", *r6(*[c for c in x.columns if c != "name"]))


@query(f"WITH {_MAXES} SELECT round(corr(q0_max, qpkri_max), 6) AS correlation FROM q")
def q_correlation(spark, d):
    return _maxes(spark, d).agg(F.corr("q0_max", "qpkri_max").alias("correlation")).select(*r6("correlation"))


@query(
    f"""WITH {_MAXES} SELECT CASE WHEN uncertainty < 0.1e0 THEN 'low' WHEN uncertainty < 0.3e0 THEN 'medium' ELSE 'high' END AS slice, count(*) AS n,
    round(avg(q0_max), 6) AS avg_q0_max, round(avg(qpkri_max), 6) AS avg_qpkri_max, round(avg(conf), 6) AS avg_conf FROM q GROUP BY 1"""
)
def q_slices(spark, d):
    x = credibility.slice_means(_maxes(spark, d), "uncertainty", ["q0_max", "qpkri_max", "conf"])
    return x.select("slice", "n", *r6("avg_q0_max", "avg_qpkri_max", "avg_conf"))


def _acc_sql(name: str, pred: str) -> str:
    return f"""SELECT '{name}' AS predictor, round(avg(({pred} = coarse_label)::INTEGER), 6) AS accuracy, round(avg(conf) FILTER ({pred} = coarse_label), 6) AS conf_right,
      round(avg(conf) FILTER ({pred} <> coarse_label), 6) AS conf_wrong FROM q"""


_PREDICTORS = {"q0": "(q1 > q0)::INTEGER", "qpkri": "(improved_weighted > 1 - improved_weighted)::INTEGER", "baseline": "pred_label"}


@query(f"WITH {_MAXES} " + " UNION ALL ".join(_acc_sql(k, v) for k, v in _PREDICTORS.items()))
def q_accuracy(spark, d):
    p = F.col("improved_weighted")
    x = credibility.accuracies(_maxes(spark, d), {"q0": S.argmax2(F.col("q0"), F.col("q1")), "qpkri": S.argmax2(1 - p, p), "baseline": F.col("pred_label")}, "conf")
    return x.select("predictor", *r6("accuracy", "conf_right", "conf_wrong"))


@query(
    f"""WITH {_MAXES} SELECT id, round(diff, 6) AS diff, 'up' AS direction FROM (SELECT * FROM q WHERE diff > 0.1e0 ORDER BY diff DESC, id LIMIT 10)
    UNION ALL SELECT id, round(diff, 6), 'down' FROM (SELECT * FROM q WHERE diff < -0.1e0 ORDER BY diff, id LIMIT 10)"""
)
def extreme_cases(spark, d):
    return credibility.extremes(_maxes(spark, d), "diff").select("id", *r6("diff"), "direction")


@query(
    f"""WITH {PRED}, r AS (SELECT coarse_label AS y, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2 AS k FROM pred)
    SELECT round(coalesce((sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 0), 6) AS auc FROM r"""
)
def auc(spark, d):
    return metrics.auc(I.predictions(spark, d), "coarse_label", "p1").select(*r6("auc"))


@query("SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n_a, (SELECT count(DISTINCT doc_id) FROM labels) AS n_b, (SELECT count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)) AS n_both")
def id_overlap(spark, d):
    return fusion.overlap(I.documents(spark, d), I.table(spark, d, "labels"), "doc_id")


# --- lexicons and sets

_WORDS = "(SELECT source AS category, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)"


def _words(spark, d):
    return I.documents(spark, d).select(F.col("source").alias("category"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))


@query(
    f"""WITH p AS (SELECT category, count(*) AS o, count(DISTINCT word) AS u FROM {_WORDS} GROUP BY 1), t AS (SELECT category, o, u FROM p UNION ALL SELECT 'total', sum(o), sum(u) FROM p)
    SELECT category, o::BIGINT AS original, u::BIGINT AS "unique", (o - u)::BIGINT AS duplicate, round((o - u) / o * 100, 6) AS removed_pct FROM t"""
)
def lexicon_dedup_stats(spark, d):
    return lexicon.stats(_words(spark, d)).select("category", "original", "unique", "duplicate", *r6("removed_pct"))


@query(f"SELECT DISTINCT 'all' AS category, word FROM {_WORDS} WHERE category = 'src1' AND word NOT IN (SELECT word FROM {_WORDS} WHERE category = 'src2')")
def new_words(spark, d):
    w = _words(spark, d)
    old, new = (w.filter(F.col("category") == s).select(F.lit("all").alias("category"), "word") for s in ("src2", "src1"))
    return lexicon.added(old, new)


@query(f"SELECT DISTINCT 'all' AS category, word FROM {_WORDS} WHERE category IN ('src1', 'src2')")
def merge_words(spark, d):
    w = _words(spark, d)
    old, new = (w.filter(F.col("category") == s).select(F.lit("all").alias("category"), "word") for s in ("src2", "src1"))
    return lexicon.merge(old, new)


@query(f"WITH {PRED} SELECT id FROM pred WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def semi_split(spark, d):
    english = I.documents(spark, d).filter("lang = 'en'").select(F.col("doc_id").alias("__d"))
    return I.predictions(spark, d).join(english, F.col("doc_id") == F.col("__d"), "left_semi").select("id")


@query("SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_wins(spark, d):
    x = I.table(spark, d, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("at"))
    return cleaning.last_wins(x, "user_id", "at").select("user_id", "event_type", "event_id")


# --- the flagship: from text to a bucket table in one plan

@query(
    f"""WITH {PRED}, c AS ({_clean_sql(POST)}), k AS (SELECT doc_id, cleaned AS text, lower(cleaned) AS low FROM c WHERE cleaned IS NOT NULL),
    {COUNTED.replace("counted AS", "m AS").replace("SELECT doc_id, text, lower(text) AS low FROM documents WHERE length(text) > 0", "SELECT * FROM k")},
    j AS (SELECT pred.*, {I.q_sql()} AS q1 FROM pred JOIN m USING (doc_id)), f AS (SELECT *, 1 - q1 AS q0 FROM j),
    x AS (SELECT *, {fuse_sql(_ALPHA)} AS m1, {bucket_sql('uncertainty')} AS bucket_id FROM f)
    SELECT bucket_id, round(avg(uncertainty), 6) AS u_mean, count(*) AS n_samples, count(*) FILTER (pred_label <> coarse_label) AS n_errors,
    count(*) FILTER (CAST(m1 > 0.5 AS INTEGER) <> coarse_label) AS n_fused_errors, round(avg(q1), 6) AS avg_q FROM x GROUP BY bucket_id"""
)
def flagship(spark, d):
    """Clean, match, score, join with predictions, fuse, and count errors by bucket of uncertainty."""
    posts = cleaning.clean_rows(I.labelled_documents(spark, d).select("doc_id", _post().alias("text")), CleanConfig())
    q = knowledge.with_q0(posts, I.LEXICON, I.CONFIG).select(F.col("doc_id").alias("__d"), F.col("q0")[0].alias("q0"), F.col("q0")[1].alias("q1"))
    x = I.predictions(spark, d).join(q, F.col("doc_id") == F.col("__d"))
    x = fusion.fused(x, _alpha()).withColumn("bucket_id", S.bucket(F.col("uncertainty")))
    y = F.col("coarse_label")
    return x.groupBy("bucket_id").agg(
        F.round(F.avg("uncertainty"), 6).alias("u_mean"), F.count("*").alias("n_samples"), F.count_if(F.col("pred_label") != y).alias("n_errors"),
        F.count_if(F.col("fused_label") != y).alias("n_fused_errors"), F.round(F.avg("q1"), 6).alias("avg_q"),
    )
