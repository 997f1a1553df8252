from __future__ import annotations

import hashlib
import os
import zlib

import pytest

from siftmark.llm import media_ts as M
from tests.llm.helpers import AWKWARD, awkward, no_rows


@pytest.mark.parametrize("size", [0, 1, 150, 160, 169, 170, 171, 183, 184, 191, 192, 193, 3000, 3058, 3072, 3073, 6144, 100_000])
def test_round_trip(size):
    raw = os.urandom(size)
    stream = M.mux(raw)
    assert len(stream) % 188 == 0
    got = M.demux(stream)
    assert got["payload"] == raw and got["discontinuities"] == 0
    assert got["pts"] == [i * M.TICKS for i in range(len(got["pts"]))] and got["random"] == [int(i % M.RANDOM_ACCESS == 0) for i in range(len(got["pts"]))]


def test_faults_are_seen():
    stream = bytearray(M.mux(b"x" * 5000))
    lost = bytes(stream[: 188 * 6] + stream[188 * 7 :])
    with pytest.raises(ValueError):
        M.demux(lost)
    bad = bytearray(stream)
    bad[188 * 5 + 3] ^= 1
    with pytest.raises(ValueError):
        M.demux(bytes(bad))
    assert M.demux(bytes(bad), gaps=True)["discontinuities"] == 2
    # whole units lost from the middle leave good PES packets, but a gap
    long = M.mux(b"y" * 200_000)
    a, b = M.demux(long)["entries"][1:3]
    with pytest.raises(ValueError):
        M.demux(long[: 188 * a] + long[188 * b :])
    for at in (6, 188 + 12):
        bad = bytearray(stream)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            M.demux(bytes(bad))
    with pytest.raises(ValueError):
        M.demux(bytes(stream[:-1]))


def test_reading_begins_at_any_entry():
    raw = os.urandom(300_000)
    stream = M.mux(raw)
    got = M.demux(stream)
    marks = [p for p, r in zip(got["place"], got["random"], strict=True) if r]
    assert len(marks) == len(got["entries"]) > 10
    for k, place in zip(got["entries"], marks, strict=True):
        part = M.demux(stream[188 * k :])
        assert part["payload"] == raw[place:] and part["pts"][0] == place // M.UNIT * M.TICKS and part["random"][0] == 1


def test_query_stores_timestamps(spark, small):
    for r in M.op9_media_columns(spark, small).select("payload_bytes", "pts", "random_access").collect():
        n = -(-r["payload_bytes"] // M.UNIT)
        assert r["pts"] == [k * M.TICKS for k in range(n)] and r["random_access"] == [k * M.UNIT for k in range(0, n, M.RANDOM_ACCESS)]


def test_columns(spark):
    got = M.media_columns(awkward(spark, clash=True)).collect()
    assert len(got) == len(AWKWARD)
    want = {r[0]: (r[1] or "").encode() for r in AWKWARD}
    for r in got:
        p = M.padded(want[r["doc_id"]])
        assert len(p) % 192 == 0 and p and M.demux(bytes(r["media"]))["payload"] == p
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:]) and r["n_bytes"] == len(want[r["doc_id"]])
        assert r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest() and r["media_bytes"] == len(r["media"])
    assert len({r["feature"] for r in got if r["doc_id"] == 1}) == 1
    assert M.media_columns(no_rows(spark)).count() == 0
