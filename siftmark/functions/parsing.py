"""Parsers of a labeller's answers as Column expressions: ordered rules, then JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftmark.config import SUBTYPES
from siftmark.functions.text import strip

#: What an answer may say.
NEGATED = ("非敏感", "不敏感", "non-sensitive", "non_sensitive", "nonsensitive")


def binary_label(response: Column) -> Column:
    """1, 0 or null. Negated forms come first; then 1 against 0 by what is said, or said first; then JSON."""
    s = F.lower(strip(response))

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | s.contains(w)
        return out

    def starts(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | s.startswith(w)
        return out

    yes, no = has("1", "sensitive", "敏感"), has("0", "non")
    keys = [F.get_json_object(response, f"$.{k}") for k in ("label", "sensitive", "is_sensitive")]
    value = F.lower(F.coalesce(*keys))
    by_json = F.when(value == "true", 1).when(value == "false", 0).otherwise(F.expr("try_cast(null as int)"))
    number = value.try_cast("double")
    by_json = F.coalesce(by_json, F.when(number.isNotNull(), number.cast("int")))
    return (
        F.when(response.isNull(), F.lit(None).cast("int"))
        .when(has(*NEGATED) | s.startswith("不"), 0)
        .when(yes & ~no, 1)
        .when(yes & starts("1", "sensitive", "敏感"), 1)
        .when(yes & starts("0", "non", "非"), 0)
        .when(~yes & no, 0)
        .otherwise(by_json)
    )


def unfenced(response: Column) -> Column:
    """Without a code fence around it."""
    s = F.regexp_replace(strip(response), r"\A```json", "")
    return strip(F.regexp_replace(F.regexp_replace(s, r"\A```", ""), r"```\z", ""))


_SCALAR = r'"(?:[^"\\]|\\.)*+"|[^\[\],\s"]+'


def batch_labels(response: Column, size: Column | int) -> Column:
    """Array of 0 and 1 for a batch; null if the answer isn't JSON, has another size or any label that isn't valid."""
    s = unfenced(response)
    size = F.lit(size) if isinstance(size, int) else size
    obj = s.startswith("{")
    body = F.when(obj, F.coalesce(F.get_json_object(s, "$.labels"), F.get_json_object(s, "$.label"))).otherwise(s)
    sound = F.when(obj, F.from_json(s, "map<string,string>").isNotNull()).otherwise(True) & F.from_json(body, "array<string>").isNotNull()
    items = F.regexp_extract_all(body, F.lit(_SCALAR), F.lit(0))
    flat = ~F.coalesce(body.rlike(r"\A\s*\[.*[\[{]"), F.lit(True))

    def one(x: Column) -> Column:
        quoted = x.startswith('"')
        text = binary_label(F.get_json_object(F.concat(F.lit('{"x":'), x, F.lit("}")), "$.x"))
        return F.when(quoted, text).when(x.isin("0", "false"), 0).when(x.isin("1", "true"), 1)

    parsed = F.transform(items, one)
    ok = sound & flat & (F.size(items) == size) & F.forall(parsed, lambda v: v.isNotNull())
    return F.when(F.coalesce(ok, F.lit(False)), parsed)


def _valid(labels: Column) -> Column:
    """Valid subtypes of a raw JSON value (a list or one name); ["other"] if none is."""
    names = F.array(*[F.lit(s) for s in SUBTYPES])
    listed = F.filter(F.from_json(labels, "array<string>"), lambda x: F.array_contains(names, x))
    found = F.when(labels.startswith("["), listed).when(F.array_contains(names, labels), F.array(labels))
    return F.when(F.size(F.coalesce(found, F.array().cast("array<string>"))) > 0, found).otherwise(F.array(F.lit("other")))


def batch_subtypes(response: Column, size: Column | int) -> Column:
    """Map of item id to subtypes for a batch; null unless there are ``size`` items.

    Takes a list of {"id", "labels"} (items without id are left out, the last of an id counts)
    or {"labels": [...]}, whose items are numbered.
    """
    s = unfenced(response)
    size = F.lit(size) if isinstance(size, int) else size
    items = F.filter(F.from_json(s, "array<struct<id:int,labels:string>>"), lambda i: i["id"].isNotNull())
    # of equal ids the last one counts
    n = F.size(items)
    kept = F.filter(items, lambda i, k: ~F.exists(F.slice(items, k + 2, F.greatest(n - k - 1, F.lit(0))), lambda j: j["id"] == i["id"]))
    by_id = F.map_from_entries(F.transform(kept, lambda i: F.struct(i["id"].alias("key"), _valid(F.coalesce(i["labels"], F.lit("[]"))).alias("value"))))
    old = F.from_json(F.coalesce(F.get_json_object(s, "$.labels"), F.get_json_object(s, "$.label")), "array<string>")
    by_place = F.map_from_entries(F.transform(old, lambda v, k: F.struct(k.alias("key"), _valid(v).alias("value"))))
    out = F.when(s.startswith("["), by_id).when(s.startswith("{"), by_place)
    return F.when(F.size(F.map_keys(out)) == size, out)


def subtypes(response: Column) -> Column:
    """Subtypes whose names the answer holds, in order; ["other"] if none."""
    low = F.lower(response)
    found = F.filter(F.array(*[F.lit(s) for s in SUBTYPES]), lambda s: F.contains(low, s))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def answer_lines(response: Column) -> Column:
    """Lines of an answer without numbering and bullets, empty ones left out."""
    lines = F.transform(F.split(response, "\n"), lambda x: F.regexp_replace(strip(x), r"\A[0-9. \t-]+", ""))
    return F.filter(lines, lambda x: F.length(x) > 0)
