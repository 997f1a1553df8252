"""Column functions on small fixtures."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from siftmark.config import CleanConfig, KnowledgeConfig, SplitConfig, load
from siftmark.functions import parsing as P
from siftmark.functions import scores as S
from siftmark.functions import text as T


def one(spark, column, **values):
    names = ", ".join(values)
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"], names


@pytest.mark.parametrize(
    "given, want",
    [
        ("访问https://example.com这是中文", "访问[URL]这是中文"),
        ("a http://x.org b www.y.org", "a [URL] b [URL]"),
        ('see "https://x.org" now', 'see "https://x.org" now'),
        ("HTTPS://X.ORG, done", "[URL] done"),
        (None, None),
    ],
)
def test_urls(spark, given, want):
    assert one(spark, T.mask_urls(F.col("t")), t=given)[0] == want


@pytest.mark.parametrize(
    "given, want",
    [("感谢 @user123 的支持", "感谢 [MENTION] 的支持"), ("联系@admin查看", "联系[MENTION]查看"), ("@né @averyveryverylongname", "@né @averyveryverylongname"), ("bob@example.com", "bob[MENTION].com")],
)
def test_mentions(spark, given, want):
    assert one(spark, T.mask_mentions(F.col("t")), t=given)[0] == want


def test_retweets_alone_and_in_the_pipeline(spark):
    assert one(spark, T.strip_retweets(F.col("t")), t="RT @username: 这是转发内容")[0] == "这是转发内容"
    # handles are masked first, so the marker stays
    assert one(spark, T.clean(F.col("t")), t="RT @user: hello there")[0] == "RT [MENTION]: hello there"


@pytest.mark.parametrize("given, want", [("  hello　", "hello"), ("abcd", None), ("", None), (None, None), ("     ", None), ("\x1cabcde\n", "abcde")])
def test_clean_lengths(spark, given, want):
    assert one(spark, T.clean(F.col("t")), t=given)[0] == want


def test_clean_max_length(spark):
    assert one(spark, T.clean(F.col("t"), CleanConfig(max_length=6)), t="seven ch")[0] is None


@pytest.mark.parametrize(
    "given, want",
    [("1", 1), ("0", 0), ("Non-Sensitive", 0), ("非敏感", 0), ('{"is_sensitive": 0}', 0), ("1，这是敏感", 1), ("maybe", None), (None, None), ('{"label": true}', 1), ("0 or 1", 0), ("不", 0)],
)
def test_binary_label(spark, given, want):
    assert one(spark, P.binary_label(F.col("t")), t=given)[0] == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("[1, 0]", [1, 0]), ('```json\n{"labels": ["敏感", 0]}\n```', [1, 0]), ("[1]", None), ("[1, 2]", None), ("[1, null]", None), ("nope", None), ("[true, false]", [1, 0]), ("[[1], 0]", None), (None, None),
    ],
)
def test_batch_labels(spark, given, want):
    assert one(spark, P.batch_labels(F.col("t"), 2), t=given)[0] == want


@pytest.mark.parametrize(
    "given, want",
    [
        ('[{"id": 0, "labels": ["porn", "x"]}, {"id": 1, "labels": "abuse"}]', {0: ["porn"], 1: ["abuse"]}),
        ('{"labels": [["politics"], "y"]}', {0: ["politics"], 1: ["other"]}),
        ('[{"id": 0, "labels": ["porn"]}]', None),
        ("x", None),
    ],
)
def test_batch_subtypes(spark, given, want):
    assert one(spark, P.batch_subtypes(F.col("t"), 2), t=given)[0] == want


def test_subtypes_and_lines(spark):
    assert one(spark, P.subtypes(F.col("t")), t='["porn", "abuse"]')[0] == ["porn", "abuse"]
    assert one(spark, P.subtypes(F.col("t")), t="unknown content")[0] == ["other"]
    assert one(spark, P.answer_lines(F.col("t")), t="1. one\n- two\n\n - ")[0] == ["one", "two"]


@pytest.mark.parametrize("x, want", [(0.0, 0), (0.3, 2), (0.6, 5), (0.7, 6), (0.1, 1), (1.0, 9), (0.95, 9)])
def test_bucket_edges(spark, x, want):
    assert one(spark, S.bucket(F.col("x")), x=x)[0] == want


def test_uncertainty(spark):
    p = F.array(F.lit(0.9), F.lit(0.1))
    assert one(spark, S.uncertainty(p), x=0.0)[0] == pytest.approx(0.1)
    assert one(spark, S.uncertainty(p, "u_margin"), x=0.0)[0] == pytest.approx(0.2)
    h = one(spark, S.uncertainty(F.array(F.lit(0.5), F.lit(0.5)), "u_entropy"), x=0.0)[0]
    assert h == pytest.approx(1.0, abs=1e-6)
    with pytest.raises(ValueError):
        S.uncertainty(p, "u_none")


def test_knowledge_jumps_to_the_middle(spark):
    c = KnowledgeConfig()
    n = {"porn": F.lit(0), "politics": F.lit(0), "abuse": F.lit(1)}
    p, total, score = S.knowledge(n, F.lit(0), F.lit(1000), c)
    assert one(spark, p, x=0.0)[0] == pytest.approx(0.17 + 0.65 * (math.tanh(0.0005 * 5) + 1) / 2)
    none = {k: F.lit(0) for k in n}
    assert one(spark, S.knowledge(none, F.lit(0), F.lit(1), c)[0], x=0.0)[0] == 0.17


def test_lut(spark):
    lut = [(0.0, 1.0), (0.1, 0.8), (0.2, 0.6), (0.3, 0.4)]
    for u, want in ((-1.0, 1.0), (0.0, 1.0), (0.05, 0.9), (0.25, 0.5), (0.9, 0.4)):
        assert one(spark, S.lut_alpha(F.col("u"), lut), u=u)[0] == pytest.approx(want)


def test_confidence_and_config():
    with pytest.raises(ValueError):
        SplitConfig(train=0.5)
    assert load(CleanConfig, None, None, min_length=7).min_length == 7
