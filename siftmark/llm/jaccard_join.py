"""N-gram Jaccard join: a grouped prefix join with exact verification.

1. Each text becomes the set of its distinct word shingles, as 64-bit hashes, once. Documents
   with the same set make one class, whose smallest doc_id stands for it from then on.
2. A pair links only if at least 3/4 of either set is shared, so of the ``2p`` lowest hashes
   of a set (p being the prefix length) p+1 must be shared with other classes. Sets deal so
   many of their lowest hashes that a larger linked set can find as many (``dealt_length``).
   Which hashes are shared is found in buckets of packed arrays; classes that fail are linked
   with nothing. The survivors' shingles are counted exactly.
3. Shingles are ordered by that count, rarest first, and the first p of a set are its prefix:
   linked sets have a shingle of their prefixes in common. Classes with identical prefix and
   size collapse into one group.
4. Group pairs that share a prefix shingle are filtered by size and by position: behind a
   shingle at which ``rest`` hashes of a set are left, two linked sets share at most the lesser
   rest. Groups lie in blocks of bounded size by the lowest hash of their prefix, so that near
   copies lie together; what survives is told as pairs of blocks, each once.
5. Surviving pairs are expanded: members of two blocks are verified against each other, the
   overlaps counted with bit sets, and only a row per member (its number of links, its
   smallest linked member) leaves the task. Blocks in no surviving pair are never shipped.
6. Components of these links give the smallest reachable doc_id.

All steps are exact but for hash collisions (64 bits a shingle, a prefix or a set). Hashes are
cut to 32 bits within a bucket only where more candidates do no harm. No list of document
pairs is ever made, hot shingles are aggregated or split before anything is compared, and
tables between the steps lie in the shared folder, as their rows name each other by place.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftmark.llm.components import components
from siftmark.llm.shared import clear, forget, fresh, saved, scratch, ship, sized, trim, trimmed

#: Words of a shingle; links need NUM/DEN of the union or more.
WORDS, NUM, DEN = 5, 75, 100
#: Hashes that a task gathers before it deals them out; hashes that a bucket, rows of postings and shipped hashes that a task should hold.
GATHER, BUCKET, POSTINGS, SHIPPED = 500_000, 1_000_000, 200_000, 2_000_000
#: Members and hashes of a block; postings of one shingle that meet in one task, from which on they are split.
BLOCK_MEMBERS, BLOCK_HASHES, CHUNK = 512, 1_000_000, 16_384
#: Bytes of text that come to one dealt hash, about.
BYTES_A_HASH = 12
#: Stands for the sets of a hash that several have.
SEVERAL = (1 << 32) - 1
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)]


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; A-Z in lower case, words end at ASCII white space."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.empty(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w))], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), np.uint64, len(w))
    m = len(h) - words + 1
    a = h[:m] * _MIX[0]
    for k in range(1, words):
        a ^= a >> np.uint64(29)
        a *= _MIX[k % 5]
        a += h[k : k + m]
    a ^= a >> np.uint64(32)
    a *= _MIX[0]
    a ^= a >> np.uint64(29)
    return np.unique(a)


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """Texts of a batch, a few at a time as Python objects."""
    for k in range(0, batch.num_rows, 128):
        yield from batch.column(1).slice(k, 128).to_pylist()


def set_key(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def prefix_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Shingles of a set of n of which a linked set must have one."""
    return n - -(-n * num // den) + 1


@lru_cache(65_536)
def dealt_length(n: int, num: int = NUM, den: int = DEN) -> int:
    """Lowest hashes of a set of n to deal, so that every linked set finds shared what it must.

    A set of a >= n hashes must find more than min(2p, a) - p. Of the hashes that both have, at most
    n - overlap others of the smaller set come before those that it deals.
    """
    a = np.arange(n, n * den // num + 1)
    p = a + 1 + -a * num // den
    overlap = -(-(a + n) * num // (num + den))
    return min(n, max(2 * prefix_length(n, num, den), int((np.minimum(2 * p, a) - p + 1 + n - overlap).max())))


def _cuts(key: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple]:
    """(k, the rows of each array with key k) of the keys that occur, in order."""
    order = np.argsort(key, kind="stable")
    key, arrays = key[order], [x[order] for x in arrays]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else key
    for i, j in zip(at, np.append(at[1:], len(key)), strict=False):
        yield int(key[i]), *[x[i:j] for x in arrays]


def _buckets(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash; inside it the lower 32 bits tell hashes apart."""
    return ((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)


def _low(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bytes(column: pa.ChunkedArray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a column of packed arrays, and how many each row has."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), kind), np.array([len(r) for r in rows], np.int64) // np.dtype(kind).itemsize


def _table(rows: list[tuple], names: str) -> pa.Table:
    """Rows as a table; ``names`` is a DDL string of long and binary columns."""
    fields = [x.split(" ") for x in names.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


DEALT = "bucket long, g long, a binary, b binary, doc_id long, n long, set long"
MEMBERS, SETS = -2, -1


def _dealt(docs: DataFrame, n_buckets: int, words: int, num: int, den: int) -> DataFrame:
    """Everything later steps need of all texts, in one pass over them; g numbers the gatherings of the tasks.

    bucket MEMBERS: a row of ``docs`` with its doc_id, set size and set key. bucket SETS: the distinct sets of a gathering,
    a their keys, b their sizes and how many of their dealt hashes another set of the gathering has. Other buckets: the
    lowest ``dealt_length`` hashes of these sets, a their lower halves, b the place of the set in the gathering. A hash
    that several sets of the gathering have is dealt once, with the mark SEVERAL, so a hot one comes to its bucket once
    from each gathering.
    """
    names = [x.split(" ")[0] for x in DEALT.split(", ")]

    def out(g: int, rows: list[tuple], held: dict[int, tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        k = len(rows)
        member = [pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((), (), ()))]
        yield pa.RecordBatch.from_arrays([pa.array([MEMBERS] * k, pa.int64()), pa.array([g] * k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), *member], names)
        if not held:
            return
        n, dealt = zip(*held.values(), strict=True)
        h = np.concatenate(dealt)
        place = np.repeat(np.arange(len(n), dtype=np.uint32), [len(x) for x in dealt])
        order = np.argsort(h, kind="stable")
        h, place = h[order], place[order]
        first = np.append(True, h[1:] != h[:-1])
        alone = first & np.append(first[1:], True)
        own = np.bincount(place[~alone], minlength=len(n))
        place, h = np.where(alone, place, np.uint32(SEVERAL))[first], h[first]
        packed = [(SETS, np.fromiter(held, np.int64, len(n)).tobytes(), np.concatenate([n, own]).astype(np.int64).tobytes())]
        packed += [(b, x.tobytes(), y.tobytes()) for b, x, y in _cuts(_buckets(h, n_buckets), _low(h), place)]
        b, x, y = zip(*packed, strict=True)
        none = pa.nulls(len(b), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array([g] * len(b), pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), none, none, none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        g = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        held: dict[int, tuple[int, np.ndarray]] = {}
        n = 0
        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), _texts(batch), strict=True):
                s = shingles(t, words)
                key = set_key(s) if len(s) else 0
                rows.append((doc, len(s), key))
                if len(s) and key not in held:
                    held[key] = len(s), s[: dealt_length(len(s), num, den)].copy()
                    n += len(held[key][1])
                if n > GATHER or len(rows) > GATHER:
                    yield from out(g, rows, held)
                    g, rows, held, n = g + 1, [], {}, 0
        if rows:
            yield from out(g, rows, held)
        trim()

    return docs.mapInArrow(run, DEALT)


def _live(dealt: DataFrame, num: int, den: int) -> DataFrame:
    """(set, n) of the sets of which so many dealt hashes are shared that they may be linked.

    A set that several gatherings hold counts as shared with itself; more is kept then, never less.
    """
    counts = "g long, what long, a binary, b binary"

    def bucket(t: pa.Table) -> pa.Table:
        h, size = _bytes(t["a"], np.uint32)
        place, _ = _bytes(t["b"], np.uint32)
        row = np.repeat(np.arange(len(size)), size)
        order = np.argsort(h, kind="stable")
        h, place, row = h[order], place[order], row[order]
        same = h[1:] == h[:-1]
        shared = (np.append(same, False) | np.append(False, same)) & (place != SEVERAL)
        found, n = np.unique(row[shared] << 32 | place[shared].astype(np.int64), return_counts=True)
        g = t["g"].to_numpy()
        return _table([(int(g[r]), 1, x.astype(np.uint32).tobytes(), y.astype(np.uint32).tobytes()) for r, x, y in _cuts(found >> 32, found & SEVERAL, n)], counts)

    def total(t: pa.Table) -> pa.Table:
        own = t.filter(pa.array(t["what"].to_numpy() == 0))
        more = t.filter(pa.array(t["what"].to_numpy() == 1))
        sets, _ = _bytes(own["a"], np.int64)
        n, shared = _bytes(own["b"], np.int64)[0].reshape(2, -1)
        shared = shared + np.bincount(_bytes(more["a"], np.uint32)[0], _bytes(more["b"], np.uint32)[0], len(n)).astype(np.int64)
        p = n + 1 + -n * num // den
        ok = shared > np.minimum(2 * p, n) - p
        return pa.table([pa.array(sets[ok]), pa.array(n[ok])], ["set", "n"])

    by_g = dealt.filter("bucket >= 0").select("bucket", "g", "a", "b").groupBy("bucket").applyInArrow(trimmed(bucket), counts)
    own = dealt.filter(F.col("bucket") == SETS).select("g", F.lit(0).cast("long").alias("what"), "a", "b")
    return own.unionByName(by_g).groupBy("g").applyInArrow(trimmed(total), "set long, n long").distinct()


def _gathered(texts: DataFrame, n_buckets: int, words: int) -> DataFrame:
    """Whole sets of ``texts`` (doc_id, text, set, cnt), gathered and dealt to be counted.

    bucket SETS: the sets of a gathering, a their hashes, b their doc_ids, sizes and counts of copies. Other buckets: a the
    lower halves of the gathering's distinct hashes, b place and number of those that several of its sets have.
    """
    names = "bucket long, g long, a binary, b binary"

    def out(g: int, held: list[tuple]) -> pa.RecordBatch:
        h = np.concatenate([x[3] for x in held])
        packed = [(SETS, g, h.tobytes(), np.array([x[:3] for x in held], np.int64).T.tobytes())]
        found, n = np.unique(h, return_counts=True)
        for b, x, m in _cuts(_buckets(found, n_buckets), _low(found), n):
            many = np.flatnonzero(m > 1)
            packed.append((b, g, x.tobytes(), np.concatenate([many, m[many]]).astype(np.uint32).tobytes()))
        return _table(packed, names).to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        g = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        seen: set[tuple] = set()
        n = 0
        for batch in batches:
            for doc, t, key, cnt in zip(batch.column(0).to_pylist(), _texts(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                s = shingles(t, words)
                # a doc_id may be on several rows, with other texts too
                if (doc, key) in seen or set_key(s) != key:
                    continue
                seen.add((doc, key))
                held.append((doc, len(s), cnt, s))
                n += len(s)
                if n > GATHER:
                    yield out(g, held)
                    g, held, seen, n = g + 1, [], set(), 0
        if held:
            yield out(g, held)
        trim()

    return texts.mapInArrow(run, names)


def _sets(gathered: DataFrame, n_buckets: int, num: int, den: int) -> DataFrame:
    """A row per set whose prefix has hashes that others have too.

    doc_id, n, cnt, hashes (those that several sets have, rarest first), shared (how many), take (of them, the prefix),
    frequency (of these), prefix (key of these), low (their lowest).
    """
    counts = "g long, bucket long, a binary, b binary"
    kinds = "doc_id long, n long, cnt long, hashes array<long>, shared long, take long, frequency array<long>, prefix long, low long"

    def frequency(t: pa.Table) -> pa.Table:
        h, size = _bytes(t["a"], np.uint32)
        first = np.cumsum(size) - size
        m = np.ones(len(h), np.int64)
        for at, b in zip(first, t["b"].to_pylist(), strict=True):
            many, times = np.frombuffer(b, np.uint32).reshape(2, -1)
            m[at + many] = times
        order = np.argsort(h, kind="stable")
        k = h[order]
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        df = np.empty(len(h), np.int64)
        df[order] = np.repeat(np.add.reduceat(m[order], start), np.diff(np.append(start, len(h))))
        at = np.flatnonzero(df > 1)
        row = np.searchsorted(first, at, "right") - 1
        g, bucket = t["g"].to_numpy(), t["bucket"].to_numpy()
        return _table(
            [(int(g[r]), int(bucket[r]), x.astype(np.uint32).tobytes(), np.minimum(y, SEVERAL).astype(np.uint32).tobytes()) for r, x, y in _cuts(row, at - first[row], df[at])], counts
        )

    def ordered(t: pa.Table) -> pa.Table:
        bucket = t["bucket"].to_numpy()
        own = int(np.flatnonzero(bucket == SETS)[0])
        h = np.frombuffer(t["a"][own].as_py(), np.uint64)
        doc, n, cnt = np.frombuffer(t["b"][own].as_py(), np.int64).reshape(3, -1)
        found, inverse = np.unique(h, return_inverse=True)
        b = _buckets(found, n_buckets)
        place = np.argsort(b, kind="stable")
        b = b[place]
        df = np.ones(len(found), np.int64)
        for r in np.flatnonzero(bucket != SETS):
            df[place[np.searchsorted(b, bucket[r]) + np.frombuffer(t["a"][int(r)].as_py(), np.uint32)]] = np.frombuffer(t["b"][int(r)].as_py(), np.uint32)
        df = df[inverse]
        keep = df > 1
        row, h, df = np.repeat(np.arange(len(n)), n)[keep], h[keep], df[keep]
        order = np.lexsort((h, df, row))
        h, df = h[order].view(np.int64), df[order]
        shared = np.bincount(row, minlength=len(n))
        first = np.cumsum(shared) - shared
        take = n + 1 + -n * num // den - (n - shared)  # less the hashes that no other set has, which come first
        ok = np.flatnonzero(take > 0)
        prefixes = [h[first[i] : first[i] + take[i]] for i in ok]

        def lists(parts: list[np.ndarray]) -> pa.Array:
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))

        columns = [
            doc[ok], n[ok], cnt[ok], lists([h[first[i] : first[i] + shared[i]] for i in ok]), shared[ok], take[ok],
            lists([df[first[i] : first[i] + take[i]] for i in ok]), np.array([set_key(x) for x in prefixes], np.int64), np.array([x.min() for x in prefixes], np.int64),
        ]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], [x.split(" ")[0] for x in kinds.split(", ")])

    counted = gathered.filter("bucket >= 0").groupBy("bucket").applyInArrow(trimmed(frequency), counts)
    own = gathered.filter(F.col("bucket") == SETS).select("g", "bucket", "a", "b")
    return own.unionByName(counted).groupBy("g").applyInArrow(trimmed(ordered), kinds)


def _groups(sets: DataFrame) -> DataFrame:
    """Groups of sets with identical size and prefix, named by their smallest member, and where their members lie.

    blk is the block of all members where k is 1, else the members are dealt into k blocks of their own.
    """
    first = F.min_by(F.struct(F.slice("hashes", F.lit(1), F.col("take").cast("int")).alias("hashes"), "frequency", "shared", "low"), "doc_id")
    groups = sets.groupBy("n", "prefix").agg(F.min("doc_id").alias("g"), first.alias("r"), F.count("*").alias("m"), F.sum("shared").alias("w")).select("n", "prefix", "g", "m", "w", "r.*")
    k = F.greatest(F.ceil(F.col("m") / BLOCK_MEMBERS), F.ceil(F.col("w") / BLOCK_HASHES))
    groups = saved(groups.withColumn("own", F.least("m", k)), "groups")
    lows = groups.filter("own = 1").groupBy(F.col("low").alias("l")).agg(F.sum("m").alias("m"), F.sum("w").alias("w")).filter(k > 1).select("l", k.alias("k_low"))
    lows = saved(lows, "lows")
    groups = groups.join(sized(lows, lows.count()), F.col("low") == F.col("l"), "left").drop("l")
    blk = F.when(F.col("own") > 1, F.xxhash64("g")).otherwise(_block(F.col("low"), F.pmod(F.xxhash64("g"), F.coalesce("k_low", F.lit(1)))))
    return groups.select("n", "prefix", "g", "m", "hashes", "frequency", "shared", blk.alias("blk"), F.col("own").alias("k"))


def _block(key: Column, part: Column) -> Column:
    return F.xxhash64(key, part.cast("long"))


def _block_pairs(groups: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y), x <= y: blocks with members of group pairs that pass the bounds, each pair once."""
    kinds = "a long, ka long, b long, kb long"

    def candidates(t: pa.Table) -> pa.Table:
        h, i, j, side, n, rest, blk, k = (t[c].to_numpy() for c in ("hash", "i", "j", "side", "n", "rest", "blk", "k"))
        order = np.lexsort((n, side, j, i, h))
        h, i, j, side, n, rest, blk, k = (x[order] for x in (h, i, j, side, n, rest, blk, k))
        run = np.cumsum(np.append(False, (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        names, where = np.unique(blk, return_inverse=True)
        often = np.zeros(len(names), np.int64)
        often[where] = k
        held: list[np.ndarray] = []
        size = 0

        def passed(a: np.ndarray, b: np.ndarray) -> None:
            nonlocal held, size
            overlap = -(-(n[a] + n[b]) * num // (num + den))
            ok = (rest[a] >= overlap) & (rest[b] >= overlap)
            u, v = where[a[ok]], where[b[ok]]
            held.append(np.unique(np.minimum(u, v) * len(names) + np.maximum(u, v)))
            size += len(held[-1])
            if size > 4_000_000:
                held = [np.unique(np.concatenate(held))]
                size = len(held[0])

        one = np.flatnonzero(i == j)
        d = 1
        while len(one):  # rows d apart in their run, which is in order of size
            one = one[one + d < len(h)]
            one = one[run[one] == run[one + d]]
            one = one[n[one] * den >= num * n[one + d]]
            passed(one, one + d)
            d += 1
        for r in np.unique(run[i != j]):  # two parts of one run
            lo, hi = np.searchsorted(run, [r, r + 1])
            mid = lo + int(np.searchsorted(side[lo:hi], 1))
            step = max(1, 2_000_000 // max(1, hi - mid))
            for at in range(lo, mid, step):
                rows = np.arange(at, min(mid, at + step))
                c0, c1 = mid + np.searchsorted(n[mid:hi], -(-n[rows[0]] * num // den)), mid + np.searchsorted(n[mid:hi], n[rows[-1]] * den // num, "right")
                a, b = np.repeat(rows, c1 - c0), np.tile(np.arange(c0, c1), len(rows))
                near = (n[a] * den >= num * n[b]) & (n[b] * den >= num * n[a])
                passed(a[near], b[near])
        code = np.unique(np.concatenate([np.empty(0, np.int64), *held]))
        u, v = code // max(1, len(names)), code % max(1, len(names))
        return pa.table([pa.array(x.astype(np.int64)) for x in (names[u], often[u], names[v], often[v])], ["a", "ka", "b", "kb"])

    total = groups.agg(F.sum(F.size("hashes"))).first()[0] or 0
    parts = max(8, -(-total // POSTINGS))
    posts = groups.select("g", "n", "shared", "blk", "k", F.posexplode(F.arrays_zip("hashes", "frequency")).alias("pos", "x"))
    posts = posts.select(F.col("x.hashes").alias("hash"), "n", (F.col("shared") - F.col("pos")).alias("rest"), "blk", "k", F.ceil(F.col("x.frequency") / CHUNK).alias("c"), "g")
    mine = F.pmod(F.xxhash64("g"), F.col("c")).cast("int")
    meets = F.transform(F.sequence(F.lit(0), (F.col("c") - 1).cast("int")), lambda o: F.struct(F.least(mine, o).alias("i"), F.greatest(mine, o).alias("j"), (mine > o).cast("int").alias("side")))
    posts = posts.withColumn("t", F.explode(meets)).select("hash", "t.*", "n", "rest", "blk", "k")
    posts = posts.withColumn("part", F.pmod(F.xxhash64("hash", "i", "j"), F.lit(parts)))
    found = posts.groupBy("part").applyInArrow(trimmed(candidates), kinds)
    alike = groups.filter("m > 1").select(F.col("blk").alias("a"), F.col("k").alias("ka"), F.col("blk").alias("b"), F.col("k").alias("kb"))

    def blocks(b: str, k: str) -> Column:
        many = F.transform(F.sequence(F.lit(0).cast("long"), F.col(k) - 1), lambda s: _block(F.col(b), s))
        return F.explode(F.when(F.col(k) == 1, F.array(b)).otherwise(many))

    pairs = found.unionByName(alike).distinct().select(blocks("a", "ka").alias("x"), "b", "kb").select("x", blocks("b", "kb").alias("y"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _overlaps(doc: np.ndarray, n: np.ndarray, cnt: np.ndarray, side: np.ndarray, flat: np.ndarray, size: np.ndarray, num: int, den: int) -> tuple:
    """(doc, links, least) of linked members of one block, or of two by side."""
    row = np.repeat(np.arange(len(doc)), size)
    _, col, times = np.unique(flat, return_inverse=True, return_counts=True)
    many = times > 1  # hashes of one member can't be in an overlap
    place = np.cumsum(many) - 1
    keep = many[col]
    row, col = row[keep], place[col[keep]]
    bits = np.zeros((len(doc), -(-max(1, int(many.sum())) // 64)), np.uint64)
    np.bitwise_or.at(bits, (row, col >> 6), np.uint64(1) << (col & 63).astype(np.uint64))
    links = np.zeros(len(doc), np.int64)
    parent = list(range(len(doc)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    two = side.any()
    other = np.flatnonzero(side)
    for i in np.flatnonzero(side == 0) if two else range(len(doc) - 1):
        others = other if two else np.arange(i + 1, len(doc))
        near = others[(n[others] * den >= num * n[i]) & (n[i] * den >= num * n[others])]
        if not len(near):
            continue
        both = np.bitwise_count(bits[near] & bits[i]).sum(axis=1, dtype=np.int64)
        hit = near[den * both >= num * (n[i] + n[near] - both)]
        links[i] += cnt[hit].sum()
        links[hit] += cnt[i]
        for j in hit.tolist():
            a, b = root(int(i)), root(j)
            if a != b:
                lo, hi = (a, b) if doc[a] < doc[b] else (b, a)
                parent[hi] = lo
    some = np.flatnonzero(links)
    return doc[some], links[some], np.array([doc[root(int(i))] for i in some], np.int64)


def _links(placed: DataFrame, pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(doc_id, links, least): how many documents a member is linked with in a pair of blocks, and the smallest it reaches there."""

    def verify(t: pa.Table) -> pa.Table:
        t = t.sort_by([("x", "ascending"), ("y", "ascending")]).combine_chunks()
        x, y, doc, n, cnt, side = (t[c].to_numpy() for c in ("x", "y", "doc_id", "n", "cnt", "side"))
        lists = pa.concat_arrays(t["hashes"].chunks)
        flat, end = lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.offsets.to_numpy(), np.int64)
        end = end - end[0]
        at = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])))
        found = [
            _overlaps(doc[i:j], n[i:j], cnt[i:j], side[i:j], flat[end[i] : end[j]], np.diff(end[i : j + 1]), num, den) for i, j in zip(at, np.append(at[1:], len(x)), strict=True)
        ]
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*found, strict=True)], ["doc_id", "links", "least"])

    legs = pairs.select(F.col("x").alias("b"), "x", "y", F.lit(0).alias("side")).unionByName(
        pairs.filter("x <> y").select(F.col("y").alias("b"), "x", "y", F.lit(1).alias("side"))
    )
    weight = placed.groupBy(F.col("block").alias("v")).agg(F.sum("shared").alias("w"))
    total, n_legs = legs.join(weight, F.col("b") == F.col("v")).agg(F.sum("w"), F.count("*")).first()
    parts = max(8, -(-(total or 0) // SHIPPED))
    legs = legs.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.lit(parts)))
    shipped = placed.join(sized(legs, n_legs, 500_000), F.col("block") == F.col("b")).select("part", "x", "y", "side", "doc_id", "n", "cnt", "hashes")
    return shipped.groupBy("part").applyInArrow(trimmed(verify), "doc_id long, links long, least long")


def jaccard_join(docs: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, n_links.

    Takes doc_id (an integer, not null; it identifies a document) and text; other columns are not
    read. A doc_id of another type is a ValueError. A null text, or one without words, has an empty
    set, which is linked with nothing; with fewer words than a shingle takes, the whole sequence is
    the set. Documents of the same non-empty set are linked. n_links counts the documents that a
    document links with, rows of a repeated doc_id among them. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id must be an integer")
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    with scratch(spark) as keep:
        dealt = saved(_dealt(docs, max(8, size // BYTES_A_HASH // BUCKET), words, num, den), "dealt")
        members = keep(saved(dealt.filter(F.col("bucket") == MEMBERS).select("doc_id", "n", "set"), "members"))
        classes = saved(members.filter("n > 0").groupBy("set", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("cnt")), "classes")
        live = _live(dealt, num, den).withColumnsRenamed({"set": "s", "n": "m"})
        live = saved(classes.join(live, (F.col("set") == F.col("s")) & (F.col("n") == F.col("m"))).select("set", "n", "rep", "cnt"), "live")
        n_live, n_hashes = live.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        forget(dealt)

        texts = docs.join(sized(live.select("rep", "set", "cnt"), n_live), F.col("doc_id") == F.col("rep")).select("doc_id", "text", "set", "cnt")
        n_buckets = max(8, n_hashes // BUCKET)
        gathered = saved(_gathered(texts, n_buckets, words), "gathered")
        sets = _sets(gathered, n_buckets, num, den)
        if members.groupBy("doc_id").count().filter("count > 1").limit(1).count():
            sets = sets.dropDuplicates(["doc_id", "n", "prefix", "shared"])
        sets = saved(sets, "sets")
        forget(gathered)

        groups = saved(_groups(sets), "placed_groups")
        pairs = saved(_block_pairs(groups, num, den), "pairs")
        of = groups.select(F.col("n").alias("gn"), F.col("prefix").alias("gp"), "blk", "k")
        block = F.when(F.col("k") == 1, F.col("blk")).otherwise(_block(F.col("blk"), F.pmod(F.xxhash64("doc_id"), F.col("k"))))
        placed = sets.join(sized(of, groups.count()), (F.col("n") == F.col("gn")) & (F.col("prefix") == F.col("gp"))).withColumn("block", block)
        checked = saved(_links(placed, pairs, num, den), "links")
        roots = components(checked.select(F.col("doc_id").alias("a"), F.col("least").alias("b")))
        degree = checked.groupBy("doc_id").agg(F.sum("links").alias("more")).withColumnRenamed("doc_id", "d")
        found = classes.join(degree, F.col("rep") == F.col("d"), "left").join(roots, F.col("rep") == F.col("node"), "left")
        found = found.select(
            F.col("set").alias("s"), F.col("n").alias("m"), F.coalesce("root", "rep").alias("root"), (F.col("cnt") - 1 + F.coalesce("more", F.lit(0))).alias("links")
        )
        found = keep(saved(found.filter("links > 0"), "found"))
    out = members.join(found, (F.col("set") == F.col("s")) & (F.col("n") == F.col("m")), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicate_filter(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns, less all documents but the smallest doc_id of each component of linked ones."""
    with scratch(docs.sparkSession) as keep:
        lost = jaccard_join(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(fresh(docs.columns, "lost"))).distinct()
        lost = keep(saved(lost, "lost"))
    return docs.join(sized(lost, lost.count()), docs["doc_id"] == lost[lost.columns[0]], "left_anti")


def op2_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All of ``documents``, one row per document."""
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
