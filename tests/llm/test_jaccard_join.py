from __future__ import annotations

import random

import pytest

from siftmark.llm import jaccard_join as J
from tests.llm.helpers import AWKWARD, awkward, links, no_rows


def family_rows():
    rnd = random.Random(5)
    base = [" ".join(rnd.choice("abcdefgh") + str(rnd.randint(0, 9)) for _ in range(60)) for _ in range(20)]
    rows = []
    for k in range(400):
        w = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = "x" + str(rnd.randint(0, 99))
        if rnd.random() < 0.3:
            w = w[: rnd.randint(1, len(w))]
        rows.append((k, " ".join(w)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "a b"), (904, "A  B"), (905, "a b c"), (906, "É b"), (907, "é b")]


@pytest.mark.parametrize("members, gather", [(256, 1_000_000), (16, 2_000)])
def test_against_brute_force(spark, monkeypatch, members, gather):
    monkeypatch.setattr(J, "BLOCK_MEMBERS", members)
    monkeypatch.setattr(J, "GATHER", gather)
    monkeypatch.setattr(J, "CHUNK", members // 4)
    rows = family_rows()
    got = {r[0]: tuple(r[1:]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert got == links(rows)


@pytest.mark.parametrize("copies", [1, 40])
def test_small_sets_against_brute_force(spark, copies):
    rows = []
    for k in range(10):
        w = [f"w{k}x{i}" for i in range(8)]
        rows += [(1000 * k + i, " ".join(v)) for i, v in enumerate([w[:7], w] * copies if k % 2 else [w[1:], w] * copies)]
    for n in (4, 5, 6, 9, 10, 11, 12, 13, 16, 17):  # a text, and less of it from either end
        w = [f"v{n}x{i}" for i in range(n)]
        rows += [(100_000 + 100 * n + i, " ".join(v)) for i, v in enumerate([w, w[:-1], w[1:], w[:-2], w[2:], w[:-3]])]
    got = {r[0]: tuple(r[1:]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == links(rows) and got[1][1:] == (0, 2 * copies - 1)


def test_dealt_hashes_show_enough():
    for n in range(1, 150):
        for a in range(n, n * 4 // 3 + 1):
            for both in range(-(-3 * (a + n) // 7), n + 1):
                da, dn = J.dealt_length(a), J.dealt_length(n)
                # the fewest hashes of both that lie in both dealt parts, whatever their order
                seen = min(both if da == a else da - (a - both), both if dn == n else dn - (n - both), both)
                assert all(seen > min(2 * J.prefix_length(x), x) - J.prefix_length(x) for x in (a, n)), (n, a, both)


def test_templates_are_filtered_as_groups(spark, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 50)
    shared = [f"t{i}" for i in range(160)]
    rows = [(k, " ".join([*shared, *(f"u{k}x{i}" for i in range(40))])) for k in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["n_links"] for r in J.jaccard_join(df).collect()} == {0}
    rows += [(1000 + k, " ".join([*shared[k % 7 :], *(f"v{k}x{i}" for i in range(10 + k % 30))])) for k in range(150)]
    got = {r[0]: tuple(r[1:]) for r in J.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == links(rows)


def test_no_block_pair_passes_for_a_template(spark):
    freq = [[150] * 40]
    rows = [(200, k, k, 1, [*range(40)], freq[0], 160, 500 + k, 1) for k in range(50)]
    groups = spark.createDataFrame(rows, "n long, prefix long, g long, m long, hashes array<long>, frequency array<long>, shared long, blk long, k long")
    # 160 of 200 are shared at most and 172 would have to be
    assert J._block_pairs(groups, J.NUM, J.DEN).count() == 0
    assert J._block_pairs(groups.selectExpr("n", "prefix", "g", "m", "hashes", "frequency", "172L AS shared", "blk", "k"), J.NUM, J.DEN).count() == 50 * 49 // 2


def test_text_ids_are_refused(spark):
    with pytest.raises(ValueError):
        J.jaccard_join(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    got = {r[0]: tuple(r[1:]) for r in J.op2_ngram_jaccard_join(spark, small).collect()}
    assert got == links([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_awkward(spark):
    got = J.jaccard_join(awkward(spark, clash=True)).collect()
    assert len(got) == len(AWKWARD)
    by = {r["doc_id"]: r for r in got}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and by[4]["component_id"] == 4
    assert by[6]["component_id"] == 1 and by[9]["component_id"] == 8 and by[5]["n_links"] == 0
    kept = J.near_duplicate_filter(awkward(spark, clash=True))
    assert kept.columns == awkward(spark, clash=True).columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 4, 5, 7, 8, 10, 11, 12}
    assert J.jaccard_join(no_rows(spark)).count() == 0 and J.near_duplicate_filter(no_rows(spark)).count() == 0
