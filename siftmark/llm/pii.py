r"""Personal data: base spans by pattern, and terms that reveal them by corpus co-occurrence; DataFrame operations only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers. Each
distinct value is a protected entity e. Words that stand outside base spans in the texts
of an entity are its terms t, and document frequencies over the whole corpus estimate how
much of the entity's information content a term discloses:

    disclosure(t, e) = PMI(t, e) / IC(e) = ln(N df(t,e) / (df(t) df(e))) / ln(N / df(e))

It is 1 for a term that occurs in no text without the entity. Terms that share ``SUPPORT``
documents or more with an entity are generalised from ``GENERALISE`` on and removed from
``REMOVE`` on, wherever they occur in any text: all occurrences become added spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from siftmark.llm.shared import BROADCAST_ROWS, fresh, saved, scratch, sized

#: Kinds in order, with their patterns. A possessive quantifier stands where giving back can't help; a run is entered
#: only at its start or where the last match ended, so that long runs cost linear time. Matches are the same as without.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": "+"}
ADDED = ("generalised", "removed")
#: Least documents of a pair; disclosure from which terms are generalised and removed; least letters of a term.
SUPPORT, GENERALISE, REMOVE, LETTERS = 3, 0.8, 0.95, 3
#: Words of one text that are looked for by one pattern.
FORMS = 64
#: Code points of the blocks that a text is cut into where spans are replaced.
BLOCK = 1024
PART = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: d.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def text_key(text: Column) -> Column:
    """Two independent hashes, 96 bits, that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"))


def matches(text: Column) -> Column:
    """All pattern matches of a text: array of (kind, nth, value, before), where before is the length of the text since the last match.

    Splitting at a pattern gives the text around its matches, so their places are sums of lengths.
    """
    found = []
    for k, kind in enumerate(KINDS):
        p = F.lit(PATTERNS[kind])
        there = text.contains(NEEDS[kind]) if len(NEEDS[kind]) == 1 else text.rlike(NEEDS[kind])
        gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
        values = F.regexp_extract_all(text, p, F.lit(0))
        rows = F.transform(F.arrays_zip(values.alias("v"), F.slice(gaps, F.lit(1), F.size(values)).alias("b")), _row(k))
        found.append(F.when(there, rows))
    return F.concat(*[F.coalesce(f, F.array().cast(EMPTY)) for f in found])


def _row(kind: int):
    return lambda z, i: F.struct(F.lit(kind).alias("kind"), i.alias("nth"), z["v"].alias("value"), z["b"].alias("before"))


EMPTY = "array<struct<kind:int,nth:int,value:string,before:int>>"


def base_spans(found: DataFrame) -> DataFrame:
    """A row per valid match of ``found`` (row_id, found): row_id, kind, start, end, value, and at, the farthest end of spans before it."""
    rows = found.select("row_id", F.explode("found").alias("m")).select("row_id", "m.*")
    upto = Window.partitionBy("row_id", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    n = F.length("value")
    rows = rows.withColumn("end", F.sum(F.col("before") + n).over(upto)).withColumn("start", F.col("end") - n)
    digits = F.regexp_replace("value", "[^0-9]", "")
    k, d = F.col("kind"), F.length(digits)
    valid = (
        (k == 0)
        | ((k == 1) & F.forall(F.split("value", r"\."), lambda p: p.rlike(PART)))
        | ((k == 2) & d.between(14, 19) & F.when(d.between(14, 19), luhn(digits)).otherwise(F.lit(False)))
        | ((k == 3) & d.between(10, 15))
    )
    before = Window.partitionBy("row_id").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.max("end").over(before), F.lit(0)).alias("at")
    return rows.filter(valid).select("row_id", "kind", "start", "end", "value", at)


def _terms(text: Column) -> Column:
    """Distinct terms of a text: its letter runs, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS), F.lower))


def _between(blocks: Column, lo: Column, hi: Column) -> Column:
    """Code points lo to hi of a text that is cut into ``blocks`` of BLOCK; costs what it gives and two blocks."""
    first = F.floor(lo / BLOCK)
    part = F.array_join(F.slice(blocks, (first + 1).cast("int"), (F.ceil(hi / BLOCK) - first).cast("int")), "")
    return F.when(hi > lo, F.substring(part, (lo - first * BLOCK + 1).cast("int"), (hi - lo).cast("int"))).otherwise(F.lit(""))


def _replaced(text: Column, spans: Column, put) -> Column:
    """``text`` with ``put`` of a span in the place of each of ``spans``, which are in order and have ``at``, the farthest end before them.

    A base span may overlap one of another kind; what starts before ``at`` gives nothing, and the text goes on behind the
    farthest end. Time grows with the text and with the number of spans, not with their product.
    """
    # as the variable of a function the blocks are made once, not for every span
    def joined(blocks: Column) -> Column:
        one = F.transform(spans, lambda s: F.when(s["start"] >= s["at"], F.concat(_between(blocks, s["at"], s["start"]), put(s))).otherwise(F.lit("")))
        last = F.element_at(spans, -1)
        return F.concat(F.concat_ws("", one), _between(blocks, F.greatest(last["at"], last["end"]), F.length(text).cast("bigint")))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))), joined)[0]


def entity() -> Column:
    value = F.when(F.col("kind") == 0, F.lower("value")).when(F.col("kind") == 1, F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    return F.concat(F.col("kind").cast("string"), F.lit(":"), value)


def disclosing(found: DataFrame, spans: DataFrame, texts: DataFrame, n_docs: int, n_spans: int) -> DataFrame | None:
    """(term, kind) of terms that disclose GENERALISE or more of an entity; None if no entity has support. Counts are over all of ``texts``.

    ``found`` has (row_id, text_hash) and ``texts`` (text_hash, text): equal texts are looked at once and weigh as many as they are.
    Entities of the same texts have the same terms, so they are one class.
    """
    placed = spans.join(found, "row_id")
    held = placed.select("row_id", "text_hash", entity().alias("entity")).distinct().groupBy("entity", "text_hash").agg(F.count("*").alias("copies"))
    h = F.col("text_hash")
    of_entity = held.groupBy("entity").agg(F.sum("copies").alias("df_e"), F.bit_xor(F.xxhash64(h)).alias("a"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("b"))
    of_entity = of_entity.filter((F.col("df_e") >= SUPPORT) & (F.col("df_e") < n_docs))
    held = saved(held.join(of_entity, "entity").drop("entity").distinct(), "held")
    most_e = held.agg(F.max("df_e")).first()[0]
    if most_e is None:
        return None
    copies = held.select("text_hash", "copies").distinct()
    base = placed.groupBy("text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "kind", "end", "at"))).alias("base")).join(copies, "text_hash")
    base = saved(base, "held_base")
    source = texts.join(sized(base, n_spans), "text_hash").dropDuplicates(["text_hash"])
    outside = _replaced(F.col("text"), F.col("base"), lambda s: F.lit(" "))
    words = saved(source.select("text_hash", "copies", F.explode(_terms(outside)).alias("term")), "words")
    # a term of enough disclosure is at most so frequent, whatever entity it is of
    most = most_e**GENERALISE * n_docs ** (1 - GENERALISE) * (1 + 1e-9)
    candidates = words.groupBy("term").agg(F.sum("copies").alias("c")).filter(F.col("c").between(SUPPORT, most)).select(F.col("term").alias("candidate"))
    candidates = saved(candidates, "candidates")
    every = texts.select(F.explode(_terms(F.col("text"))).alias("term"))
    kept = every.join(sized(candidates, candidates.count()), F.col("term") == F.col("candidate"), "left_semi")
    of_term = saved(kept.groupBy("term").agg(F.count("*").alias("df_t")).filter(F.col("df_t") <= most), "of_term")
    pairs = words.drop("copies").join(sized(of_term, of_term.count()), "term").join(held, "text_hash")
    pairs = pairs.groupBy("a", "b", "df_e", "term", "df_t").agg(F.sum("copies").alias("df_te")).filter(F.col("df_te") >= SUPPORT)
    n = F.lit(float(n_docs))
    ratio = F.log(n * F.col("df_te") / (F.col("df_t") * F.col("df_e").cast("double"))) / F.log(n / F.col("df_e"))
    action = F.max(F.when(F.col("disclosure") >= REMOVE, len(KINDS) + 1).otherwise(len(KINDS)))
    told = pairs.withColumn("disclosure", ratio).filter(F.col("disclosure") >= GENERALISE).groupBy("term").agg(action.alias("kind"))
    return saved(told, "told")


def occurrences(texts: DataFrame, told: DataFrame) -> DataFrame:
    """(text_hash, kind, start, end): all places of the terms of ``told`` in each distinct text.

    The words of a text that are terms are found first, as distinct ones; then the text is split at these alone. Only for
    texts with over FORMS of them, for which a pattern of all would be slow, every letter run is looked up by itself.
    """
    n = told.count()
    raws = F.array_distinct(F.filter(F.split("text", r"[^\p{L}]+"), lambda w: F.length(w) >= LETTERS))
    every = texts.select("text_hash", F.explode(raws).alias("raw")).withColumn("term", F.lower("raw"))
    hit = saved(every.join(sized(told.select("term"), n), "term", "left_semi").groupBy("text_hash").agg(F.collect_set("raw").alias("raws")), "hit")
    size, most = hit.agg(F.coalesce(F.sum(F.size("raws") + 1), F.lit(0)), F.max(F.size("raws"))).first()

    def of(hit: DataFrame) -> DataFrame:
        return texts.join(sized(hit, size, BROADCAST_ROWS // 4), "text_hash").dropDuplicates(["text_hash"])

    upto = Window.partitionBy("text_hash").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    # longer forms need not come first: what follows a form must not be a letter
    pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.concat_ws("|", "raws"), F.lit(r")(?!\p{L})"))
    rows = of(hit.filter(F.size("raws") <= FORMS)).select("text_hash", "text", pattern.alias("pattern"))
    values = F.regexp_extract_all("text", F.col("pattern"), F.lit(0))
    gaps = F.transform(F.split("text", F.col("pattern"), -1), F.length)
    runs = rows.select("text_hash", F.posexplode(F.arrays_zip(values.alias("w"), F.slice(gaps, F.lit(1), F.size(values)).alias("before"))).alias("i", "z"))
    runs = runs.select("text_hash", F.col("z.w").alias("w"), F.sum(F.col("z.before") + F.length("z.w")).over(upto).alias("end"))
    if (most or 0) > FORMS:
        # letter runs are one code point apart, so their places are sums of lengths
        more = of(hit.filter(F.size("raws") > FORMS)).select("text_hash", F.posexplode(F.split("text", r"[^\p{L}]", -1)).alias("i", "w"))
        more = more.withColumn("end", F.sum(F.length("w")).over(upto) + F.col("i")).filter(F.length("w") >= LETTERS)
        runs = runs.unionByName(more.select("text_hash", "w", "end"))
    runs = runs.select("text_hash", F.lower("w").alias("term"), (F.col("end") - F.length("w")).alias("start"), "end").join(sized(told, n), "term")
    return runs.select("text_hash", "kind", "start", "end")


def _clear(base: DataFrame, more: DataFrame) -> DataFrame:
    """``base`` (text_hash, kind, start, end) and those of ``more`` that overlap none of them, with at; a pass over them in order."""
    both = base.unionByName(more)
    order = Window.partitionBy("text_hash").orderBy("start", "kind")
    is_base = F.col("kind") < len(KINDS)
    reached = F.max(F.when(is_base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    both = both.select("*", F.coalesce(reached, F.lit(0)).alias("reached"), F.expr(NEXT).alias("following"))
    both = both.filter(is_base | ((F.col("reached") <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))))
    at = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return both.select("text_hash", "kind", "start", "end", at.alias("at"))


#: The start of the next base span of the text.
NEXT = f"lead(CASE WHEN kind < {len(KINDS)} THEN start END, 1) IGNORE NULLS OVER (PARTITION BY text_hash ORDER BY start, kind)"
SPANS = "array<struct<start:bigint,kind:int,end:bigint,at:bigint>>"


def find_spans(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, n_email, n_ip, n_card, n_phone, base and spans (arrays of (start, kind, end, at) in order).

    Reads doc_id and text; other columns don't matter. A null text counts as empty; empty
    texts have no spans; rows that repeat have the same spans each and count as documents
    each; a text of any length is searched whole. Kinds 0 to 3 are base kinds as listed, 4 and
    5 terms to generalise and to remove; an added span never overlaps a base one; at is the
    farthest end of the spans before. An empty table gives an empty table.
    """
    with scratch(docs.sparkSession) as keep:
        text = F.coalesce(docs["text"], F.lit(""))
        rows = docs.select(F.monotonically_increasing_id().alias("row_id"), docs["doc_id"].alias("doc_id"), text_key(text).alias("text_hash"), matches(text).alias("found"))
        found = saved(rows, "matches")
        keys = keep(saved(found.select("row_id", "doc_id", "text_hash"), "keys"))
        n_docs, n = found.agg(F.count("*"), F.coalesce(F.sum(F.size("found")), F.lit(0))).first()
        spans = saved(base_spans(found.select("row_id", "found")), "base")
        texts = docs.select(text_key(text).alias("text_hash"), text.alias("text"))
        told = disclosing(keys.select("row_id", "text_hash"), spans, texts, n_docs, n)
        # rows of one text have the same spans
        base = spans.select("row_id", "kind", "start", "end", "at").join(keys.select("row_id", "text_hash"), "row_id").drop("row_id").dropDuplicates(["text_hash", "kind", "start"])
        item = F.struct("start", "kind", "end", "at")
        by_text = base.groupBy("text_hash").agg(
            *[F.count_if(F.col("kind") == k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)], F.sort_array(F.collect_list(item)).alias("base")
        )
        if told is None:
            by_text = by_text.withColumn("spans", F.col("base"))
        else:
            every = _clear(base.drop("at"), occurrences(texts, told)).groupBy("text_hash").agg(F.sort_array(F.collect_list(item)).alias("spans"))
            by_text = every.join(by_text, "text_hash", "left")
        by_text = keep(saved(by_text, "by_text"))
    size = by_text.agg(F.count("*") + F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()[0]  # rows and spans, of a few words each
    out = keys.join(sized(by_text, size, BROADCAST_ROWS // 4), "text_hash", "left")
    none = F.array().cast(SPANS)
    return out.select("doc_id", "text_hash", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS], *[F.coalesce(c, none).alias(c) for c in ("base", "spans")])


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in (*KINDS, *ADDED)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans of every text replaced by the name of their kind in brackets; removed terms leave nothing.

    Texts without spans and null texts stay as they are, and so do all other columns, whatever their names.
    """
    key, spans = fresh(docs.columns, "text_hash"), fresh(docs.columns, "spans")
    with scratch(docs.sparkSession) as keep:
        found = find_spans(docs).filter(F.size("spans") > 0)
        # rows of one text have the same spans
        found = found.select(F.col("text_hash").alias(key), F.col("spans").alias(spans)).dropDuplicates([key])
        found = keep(saved(found, "found"))
    size = found.agg(F.count("*") + F.coalesce(F.sum(F.size(spans)), F.lit(0))).first()[0]
    marked = docs.withColumn(key, text_key(F.coalesce(docs["text"], F.lit(""))))
    out = marked.join(sized(found, size, BROADCAST_ROWS // 4), key, "left")
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, ADDED[0])], F.lit(""))
    step = _replaced(F.col("text"), F.col(spans), lambda s: names[s["kind"]])
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(step)
    return out.select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in docs.columns])


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    out = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
