"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

* A shingle's weight is (1 + ln tf) * idf, and idf = ln((N + 1) / (df + 1)), at least 0.5; shingles in fewer than one of RARE texts count
  as being in one of RARE. So a table of document counts in 2^22 hashed slots tells the idf of nearly every shingle exactly at
  any corpus size: a slot's other shingles add some RARE / 2^22 of the texts times their mean length, far below one in RARE.
  The table has a fixed size and comes together as compressed blocks of slots. Weights are rounded to steps of 2^(1/8) for sampling.
* A sample is the shingle of least ln a = ln c - r (floor(ln w / r + b) + 1 - b), r, c ~ Gamma(2, 1), b ~ U(0, 1): two texts
  share it with the probability of their weighted Jaccard similarity. The variables come from a fixed pool, indexed by a
  hash of shingle and sample number, with ln a tabulated per pool entry and weight step.
* Texts that share all samples of a band are candidates. Copies of a text are one content from the start on, so a group of
  copies of any size is one row here. A band with many contents is split by salt on its way and compared in parts of a bounded
  number of contents; where groups are asked, its contents are linked to one of them, and only those that aren't similar to it are
  compared with the others.
* Candidates are verified on their texts by weighted Jaccard similarity, with the exact document frequencies of their shingles: a
  slot's count bounds them, and where the bounds settle a pair against a threshold no frequency is asked.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.words import hash_words, shingle_hashes, words_of
from folioforge.runtime import bounded_broadcast, stage_table

IDF_SLOTS = 1 << 22
_BLOCK = 1 << 16  # slots of a block
#: Shingles of fewer than one text in so many weigh as if they were in one of so many.
RARE = 2_000
#: Contents of a part of a large band; a task compares two parts.
PART_ROWS = 512
#: Salts of a band that one task alone holds more than so many contents of.
_SALTS, _LOCAL_ROWS, _COUNTERS = 256, 64, 1 << 20
#: Bits of the filter that keeps the shingles whose document frequency is asked.
ASKED_BITS = 1 << 27
_POOL_BITS = 14
_STEPS = 48
_SEEN_ROWS = 1_000_000
_STEP_BASE = -1.0  # log2 of the least weight


@cache
def _pool() -> np.ndarray:
    """ln a as order-preserving integers in the high halves of int64, by weight step and pool entry."""
    rng = np.random.default_rng(20_240_601)
    n = 1 << _POOL_BITS
    r, c, b = rng.gamma(2.0, 1.0, n), rng.gamma(2.0, 1.0, n), rng.random(n)
    ln_w = ((_STEP_BASE + np.arange(_STEPS) / 8) * np.log(2))[:, None]
    ln_a = np.log(c) - r * (np.floor(ln_w / r + b) + 1 - b)
    bits = ln_a.astype(np.float32).view(np.int32).astype(np.int64)
    ordered = np.where(bits < 0, ~bits & 0x7FFFFFFF, bits | 0x80000000) - 0x80000000
    return np.ascontiguousarray(ordered << 32).reshape(-1)


@cache
def _multipliers(samples: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 2**63, samples, np.uint64) | np.uint64(1)


def weights(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(tf)) * idf


def weighted_samples(shingles: np.ndarray, weight: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """(texts, samples) int64 samples of texts whose distinct shingles lie behind one another, beginning at ``starts``."""
    step = np.clip(np.rint((np.log2(np.maximum(weight, 1e-6)) - _STEP_BASE) * 8), 0, _STEPS - 1).astype(np.int64) << _POOL_BITS
    low = (shingles & np.uint64(0xFFFFFFFF)).astype(np.int64)
    pool, out = _pool(), np.empty((samples, len(starts)), np.int64)
    shift, hashed, value = np.uint64(64 - _POOL_BITS), np.empty(len(shingles), np.uint64), np.empty(len(shingles), np.int64)
    at = hashed.view(np.int64)
    for k, m in enumerate(_multipliers(samples)):
        np.multiply(shingles, m, out=hashed)
        np.right_shift(hashed, shift, out=hashed)
        np.add(at, step, out=at)
        np.take(pool, at, out=value, mode="clip")
        np.bitwise_or(value, low, out=value)
        np.minimum.reduceat(value, starts, out=out[k])
    return out.T


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """(texts, bands) uint64 hashes of the samples of each band, band number included."""
    n, k = samples.shape
    parts = samples.view(np.uint64).reshape(n, bands, k // bands)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (n, bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(k // bands):
            out = (out ^ parts[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
    return out


def content_id(hashes: np.ndarray) -> int:
    """64-bit id of a sequence of words, as signed integer."""
    v = xxhash.xxh3_64_intdigest(hashes.tobytes())
    return v - (1 << 64) if v >> 63 else v


def _profile(batches: Iterator[pa.RecordBatch], n: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, content) per text, then rows (block, counts) with this task's document counts of the slots of a block, compressed."""
    counts = np.zeros(IDF_SLOTS, np.int32)
    names = ["key", "content", "block", "counts"]
    for batch in batches:
        keys, contents = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            h = hash_words(words_of(text))
            if len(h) < max(least_words, n):
                continue
            keys.append(key)
            contents.append(content_id(h))
            counts[np.unique(shingle_hashes(h, n) & np.uint64(IDF_SLOTS - 1)).view(np.int64)] += 1
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(contents, pa.int64()), pa.nulls(len(keys), pa.int32()), pa.nulls(len(keys), pa.binary())], names=names)
    for block in range(IDF_SLOTS // _BLOCK):
        part = counts[block * _BLOCK : (block + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([block], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=names)


def _counts_of(blobs: list[bytes]) -> np.ndarray:
    total = np.zeros(_BLOCK, np.int64)
    for blob in blobs:
        total += np.frombuffer(zlib.decompress(blob), np.int32)
    return np.minimum(total, 2**31 - 1).astype(np.int32)


def _summed(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_BLOCK, np.int64)
    for batch in parts:
        total += _counts_of(batch.column("counts").to_pylist())
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)], pa.binary())], names=["block", "counts"])


def _summed_plain(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same, not compressed."""
    for batch in _summed(key, parts):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([zlib.decompress(batch.column(1)[0].as_py())], pa.binary())], names=["block", "counts"])


def slot_counts(profile: DataFrame) -> np.ndarray:
    """Document counts of all slots. The blocks of all tasks are summed first in salted groups, so each group holds few of them."""
    blocks = profile.where("block is not null").select("block", "counts", F.pmod(F.xxhash64("counts"), F.lit(16)).alias("salt"))
    partial = blocks.groupBy("block", "salt").applyInArrow(_summed, "block int, counts binary")
    whole = np.zeros(IDF_SLOTS, np.int32)
    total = partial.groupBy("block").applyInArrow(_summed_plain, "block int, counts binary")
    for batch in total.toArrow().to_batches():  # one row per block, 16 MB in all
        for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            whole[block * _BLOCK : (block + 1) * _BLOCK] = np.frombuffer(blob, np.int32)
    return whole


def exact_idf(counts: np.ndarray | int, texts: int) -> np.ndarray:
    """idf by document frequency; with a slot's count instead, the least that it can be."""
    return np.log((texts + 1) / (np.maximum(np.asarray(counts, np.float64), texts / RARE) + 1)).clip(0.5)


_table: dict[str, np.ndarray] = {}


def _idf_of(slots, texts: int) -> np.ndarray:
    """The worker's table of idf by slot, made once per broadcast."""
    name = slots.value[2]
    if name not in _table:
        _table.clear()
        _table[name] = exact_idf(slots.value[1], texts).astype(np.float32)
    return _table[name]


def _bands(batches: Iterator[pa.RecordBatch], slots, n: int, least_words: int, bands: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (band, salt, content). Bands that this task holds much of are spread over salts; then a row with salt 0 says that there are more."""
    table = _idf_of(slots, slots.value[0])
    seen: set[int] = set()  # contents of this task, so that copies don't meet in the shuffle
    held = np.zeros(_COUNTERS, np.uint32)  # contents by slot of the band's hash, in this task
    for batch in batches:
        contents, parts, sizes, tfs = [], [], [], []
        if len(seen) > _SEEN_ROWS:
            seen.clear()
        for text in batch.column(0).to_pylist():
            h = hash_words(words_of(text))
            if len(h) < max(least_words, n):
                continue
            content = content_id(h)
            if content in seen:
                continue
            seen.add(content)
            values, tf = np.unique(shingle_hashes(h, n), return_counts=True)
            contents.append(content)
            parts.append(values)
            tfs.append(tf)
            sizes.append(len(values))
        if not contents:
            continue
        ends, lo = np.cumsum(sizes), 0
        while lo < len(contents):  # at most some 50,000 shingles at a time, so the arrays stay in the cache and small
            first = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, first + 50_000)))
            shingles, tf = np.concatenate(parts[lo:hi]), np.concatenate(tfs[lo:hi])
            starts = np.concatenate([[0], np.cumsum(sizes[lo:hi])[:-1]]).astype(np.int64)
            w = weights(tf, table[(shingles & np.uint64(IDF_SLOTS - 1)).view(np.int64)])
            keys = band_keys(weighted_samples(shingles, w, starts, bands * rows), bands)
            flat, owner = keys.reshape(-1), np.repeat(np.array(contents[lo:hi], np.int64), bands)
            slot = (flat & np.uint64(_COUNTERS - 1)).view(np.int64)
            np.add.at(held, slot, 1)
            at = np.flatnonzero(held[slot] > max(_LOCAL_ROWS, 16 * len(seen) * bands // _COUNTERS))
            salt = np.zeros(len(flat), np.int32)
            if len(at):
                salt[at] = 1 + (owner[at].view(np.uint64) % np.uint64(_SALTS)).astype(np.int32)
                _, first = np.unique(flat[at], return_index=True)
                flat, owner, salt = np.concatenate([flat, flat[at][first]]), np.concatenate([owner, owner[at][first]]), np.concatenate([salt, np.zeros(len(first), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(flat.view(np.int64)), pa.array(salt)], names=["content", "band", "salt"])
            lo = hi


def _shingles(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(shingle_hashes(hash_words(words_of(text)), n), return_counts=True)


def _measure(batches: Iterator[pa.RecordBatch], slots, texts: int, n: int) -> Iterator[pa.RecordBatch]:
    """Plain similarity, and what the weighted one is at least and at most: a shingle is in its slot's count of texts at most, a
    shared one in two at least, and what is rare by its slot is rare."""
    one, two = exact_idf(1, texts), exact_idf(2, texts)
    for batch in batches:
        a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
        memo: dict[str, tuple] = {}
        plain, low, high = [], [], []
        for x, y in zip(ta, tb):
            sides = []
            for text in (x, y):
                got = memo.get(text)
                if got is None:
                    values, tf = _shingles(text, n)
                    count = slots.value[1][(values & np.uint64(IDF_SLOTS - 1)).view(np.int64)]
                    got = memo[text] = (values, 1 + np.log(tf), exact_idf(count, texts), np.where(count <= texts / RARE, exact_idf(count, texts), one))
                sides.append(got)
            (va, fa, la, ha), (vb, fb, lb, hb) = sides
            both, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
            plain.append(len(both) / max(1, len(va) + len(vb) - len(both)))
            least, more = np.minimum(fa[ia], fb[ib]), np.abs(fa[ia] - fb[ib])
            alone_a, alone_b = np.ones(len(va), bool), np.ones(len(vb), bool)
            alone_a[ia] = alone_b[ib] = False
            rest_low = (fa * la)[alone_a].sum() + (fb * lb)[alone_b].sum()
            rest_high = (fa * ha)[alone_a].sum() + (fb * hb)[alone_b].sum()
            few, many = np.minimum(la[ia], two), np.minimum(ha[ia], two)
            low.append(float((least * few).sum() / max(1e-9, (least * few).sum() + (more * many).sum() + rest_high)))
            high.append(float((least * many).sum() / max(1e-9, (least * many).sum() + (more * few).sum() + rest_low)))
        columns = [pa.array(a, pa.int64()), pa.array(b, pa.int64()), *(pa.array(c, pa.float64()) for c in (plain, low, high))]
        yield pa.RecordBatch.from_arrays(columns, names=["content_a", "content_b", "jaccard", "low", "high"])


def _slots_asked(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        asked = [_shingles(text, n)[0] & np.uint64(ASKED_BITS - 1) for text in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(asked or [np.empty(0, np.uint64)])).astype(np.int64))], names=["slot"])


def _occurrences(batches: Iterator[pa.RecordBatch], asked, n: int, least_words: int) -> Iterator[pa.RecordBatch]:
    """Rows (shingle, content, tf) of the shingles that pass the filter, once per content of this task."""
    words, seen = asked.value, set()
    for batch in batches:
        if len(seen) > _SEEN_ROWS:
            seen.clear()
        shingles, contents, tfs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for text in batch.column(0).to_pylist():
            h = hash_words(words_of(text))
            if len(h) < max(least_words, n) or (content := content_id(h)) in seen:
                continue
            seen.add(content)
            values, tf = np.unique(shingle_hashes(h, n), return_counts=True)
            slot = values & np.uint64(ASKED_BITS - 1)
            at = np.flatnonzero(words[(slot >> np.uint64(6)).view(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
            shingles.append(values[at])
            contents.append(np.full(len(at), content, np.int64))
            tfs.append(tf[at])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).view(np.int64)), pa.array(np.concatenate(contents)), pa.array(np.concatenate(tfs).astype(np.int32))], names=["shingle", "content", "tf"])


def _weigh(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        memo: dict[int, tuple] = {}
        heavy = []
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for i, pair in enumerate(zip(a, b)):
            sides = []
            for content, column in zip(pair, (2, 3)):
                if content not in memo:
                    shingle, tf, count = (x.to_numpy() for x in batch.column(column)[i].values.flatten())
                    order = np.argsort(shingle)
                    memo[content] = (shingle[order], weights(tf[order], exact_idf(count[order], texts)))
                sides.append(memo[content])
            (va, wa), (vb, wb) = sides
            _, ia, ib = np.intersect1d(va, vb, assume_unique=True, return_indices=True)
            low = np.minimum(wa[ia], wb[ib]).sum()
            heavy.append(float(low / max(1e-9, wa.sum() + wb.sum() - low)))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(heavy, pa.float64())], names=["content_a", "content_b", "exact"])


def _exact_weights(slim: DataFrame, members: DataFrame, found: DataFrame, pairs: DataFrame, texts: int, n: int, least_words: int) -> DataFrame:
    """(content_a, content_b, exact): weighted similarity of the pairs by the number of members that hold each shingle."""
    context = slim.sparkSession.sparkContext
    wanted = stage_table(pairs.select(F.explode(F.array("content_a", "content_b")).alias("content")).distinct(), "weighed")
    slots = found.join(bounded_broadcast(wanted), "content", "left_semi").select("text").mapInArrow(lambda it: _slots_asked(it, n), "slot bigint")
    bits = slots.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS int))")).alias("bits"))
    words = np.zeros(ASKED_BITS >> 6, np.uint64)
    for row in bits.toArrow().to_batches():  # ASKED_BITS / 64 rows at most
        words[row.column(0).to_numpy()] = row.column(1).to_numpy().view(np.uint64)
    asked = context.broadcast(words)
    held = slim.select("text").mapInArrow(lambda it: _occurrences(it, asked, n, least_words), "shingle bigint, content bigint, tf int")
    held = stage_table(held.distinct(), "occurrences")
    copies = members.groupBy("content").agg(F.count("*").alias("copies")).where("copies > 1")
    counts = held.join(bounded_broadcast(stage_table(copies, "copies")), "content", "left").groupBy("shingle").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("texts"))
    own = held.join(bounded_broadcast(wanted), "content", "left_semi").join(counts, "shingle")
    sides = stage_table(own.groupBy("content").agg(F.collect_list(F.struct("shingle", "tf", "texts")).alias("side")), "sides")
    both = pairs.select("content_a", "content_b")
    for x in ("a", "b"):
        both = both.join(sides.select(F.col("content").alias(f"content_{x}"), F.col("side").alias(f"side_{x}")), f"content_{x}")
    both = both.select("content_a", "content_b", "side_a", "side_b")
    return both.mapInArrow(lambda it: _weigh(it, texts), "content_a bigint, content_b bigint, exact double")


def band_pairs(shared: DataFrame) -> DataFrame:
    """(content_a, content_b): every pair of contents that share a band, of (band, content) rows.

    Bands of up to PART_ROWS contents are joined with themselves. Larger ones are cut into parts of about as many; each content goes
    to every part once, so a task holds a part and the contents that ask it, whatever the band's size.
    """
    sizes = shared.groupBy("band").agg(F.count("*").alias("n"))
    sized = shared.join(sizes.where(f"n > {PART_ROWS}"), "band", "left")
    parts = F.coalesce(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).cast("int")
    placed = sized.select("band", "content", parts.alias("parts"), F.when(parts > 1, F.pmod(F.xxhash64("content"), parts)).otherwise(0).cast("int").alias("part"))
    right = placed.select("band", "part", F.col("content").alias("content_b"))
    left = placed.select("band", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("content").alias("content_a"))
    return left.join(right, ["band", "part"]).where("content_a < content_b").select("content_a", "content_b").distinct()


def similar_contents(texts: DataFrame, key_col: str, text_col: str, n: int = 5, least_words: int = 0, bands: int = 40, rows: int = 3, weigh: bool = True, least: float | None = None, grouped: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of the texts with at least ``least_words`` words and one shingle of n words.

    members(key, content): one row per key; keys with the same words have the same content id. Null texts, empty texts
    and shorter ones have no row. pairs(content_a, content_b, jaccard, weighted): candidate pairs of different contents with
    their similarities over sets and over TF-IDF weights; redelivered rows count once, also in document frequencies. With
    ``least``, only pairs of that weighted similarity are given; ``weighted`` is then a lower bound of at least ``least`` where
    that was enough to tell. Without ``weigh``, ``weighted`` is the bound from above that the slots give, and pairs whose bound is
    below ``least`` are left out. With ``grouped`` (and ``least``), pairs that can't change the groups may be missing: of a
    large band the pairs of contents that are both similar to its first one.
    """
    spark = texts.sparkSession
    slim = texts.select(F.col(key_col).cast("bigint").alias("key"), F.col(text_col).alias("text")).where("key is not null and text is not null")
    profile = stage_table(slim.mapInArrow(lambda it: _profile(it, n, least_words), "key bigint, content bigint, block int, counts binary"), "profile")
    members = profile.where("block is null").select("key", "content").distinct()
    documents = members.count()
    slots = spark.sparkContext.broadcast((documents, slot_counts(profile), uuid.uuid4().hex))

    banded = slim.select("text").mapInArrow(lambda it: _bands(it, slots, n, least_words, bands, rows), "content bigint, band bigint, salt int")
    along = Window.partitionBy("band", "salt")
    shared = banded.withColumn("lo", F.min("content").over(along)).withColumn("hi", F.max("content").over(along)).where("lo < hi or salt > 0")
    shared = stage_table(shared.select("band", "content").distinct(), "bands")
    firsts = members.groupBy("content").agg(F.min("key").alias("key"))

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("content_a", "content_b")).alias("content")).distinct()
        known = stage_table(firsts.join(wanted, "content", "left_semi"), "wanted")
        return stage_table(slim.join(bounded_broadcast(known), "key").groupBy("content").agg(F.first("text").alias("text")), "texts")

    def measured(pairs: DataFrame, found: DataFrame) -> DataFrame:
        a = found.select(F.col("content").alias("content_a"), F.col("text").alias("text_a"))
        b = found.select(F.col("content").alias("content_b"), F.col("text").alias("text_b"))
        both = pairs.join(a, "content_a").join(b, "content_b").select("content_a", "content_b", "text_a", "text_b")
        return both.mapInArrow(lambda it: _measure(it, slots, documents, n), "content_a bigint, content_b bigint, jaccard double, low double, high double")

    def weighed(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """(content_a, content_b, jaccard, weighted)."""
        table = stage_table(measured(pairs, found), "measured")
        exact_already = F.col("high") - F.col("low") < 1e-9
        settled = exact_already if least is None else exact_already | (F.col("low") >= least + 1e-6) | (F.col("high") < least - 1e-6)
        open_ = stage_table(table.where(~settled), "unsettled")
        by_bounds = table.where(settled).select("content_a", "content_b", "jaccard", F.col("low").alias("weighted"))
        if not open_.isEmpty():
            exact = _exact_weights(slim, members, found, open_, documents, n, least_words)
            by_bounds = by_bounds.unionByName(open_.join(exact, ["content_a", "content_b"]).select("content_a", "content_b", "jaccard", F.col("exact").alias("weighted")))
        return by_bounds if least is None else by_bounds.where(F.col("weighted") >= least - 1e-9)

    if grouped and least is not None:
        return members, _grouped_pairs(shared, weighed, texts_of)
    pairs = stage_table(band_pairs(shared), "pairs")
    found = texts_of(pairs)
    if not weigh:
        known = measured(pairs, found).withColumnRenamed("high", "weighted").drop("low")
        return members, known if least is None else known.where(F.col("weighted") >= least)
    return members, weighed(pairs, found)


def _grouped_pairs(shared: DataFrame, weighed, texts_of) -> DataFrame:
    """Similar pairs enough for the groups.

    The contents of a large band are first compared with its least one. Those similar to it are one group by that; the others
    are compared with all contents of the band, in parts.
    """
    sizes = stage_table(shared.groupBy("band").agg(F.count("*").alias("n"), F.min("content").alias("head")).where(f"n > {PART_ROWS}"), "large")
    small = band_pairs(shared.join(bounded_broadcast(sizes.select("band")), "band", "left_anti"))
    large = stage_table(shared.join(bounded_broadcast(sizes), "band").where("content > head"), "large")
    heads = stage_table(small.unionByName(large.select(F.col("head").alias("content_a"), F.col("content").alias("content_b")).distinct()).distinct(), "pairs")
    near = stage_table(weighed(heads, texts_of(heads)), "near")
    linked = near.select(F.col("content_a").alias("head"), F.col("content_b").alias("content"))
    rest = stage_table(large.join(linked, ["head", "content"], "left_anti").select("band", "content", "n"), "rest")
    if rest.isEmpty():
        return near
    parts = F.ceil(F.col("n") / PART_ROWS).cast("int")
    asking = rest.select("band", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("content").alias("x"))
    asked = large.select("band", F.pmod(F.xxhash64("content"), parts).cast("int").alias("part"), F.col("content").alias("y"))
    more = asking.join(asked, ["band", "part"]).where("x <> y").select(F.least("x", "y").alias("content_a"), F.greatest("x", "y").alias("content_b")).distinct()
    more = stage_table(more.join(heads, ["content_a", "content_b"], "left_anti"), "pairs")
    return near.unionByName(stage_table(weighed(more, texts_of(more)), "near"))


def spread_pairs(members: DataFrame, pairs: DataFrame, near: int = 8) -> DataFrame:
    """(key_a, key_b), smaller first: pairs of contents carried over to their members.

    The members of a content are numbered by key. Pairs of members are given if either is its content's first or their
    numbers differ by at most ``near``; inside one content likewise. So classes of up to near + 1 copies come out in full, and
    a class of any size adds rows in proportion to its members: each is linked to the other class's first, and to its own.
    """
    salted = members.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(32)))
    inner = Window.partitionBy("content", "salt").orderBy("key")
    numbered = salted.withColumn("n", F.row_number().over(inner) - 1)
    sizes = salted.groupBy("content", "salt").agg(F.count("*").alias("c"), F.min("key").alias("least"))
    before = sizes.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("content").orderBy("least", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = stage_table(numbered.join(before.select("content", "salt", "base"), ["content", "salt"]).select("content", "key", (F.col("n") + F.col("base")).alias("rank")), "ranked")
    firsts = ranked.where("rank = 0").select("content", F.col("key").alias("first"))
    several = stage_table(ranked.where("rank > 0").select("content").distinct().join(firsts, "content"), "classes")
    links = pairs.select("content_a", "content_b")
    for side in ("a", "b"):
        links = links.join(firsts.select(F.col("content").alias(f"content_{side}"), F.col("first").alias(f"first_{side}")), f"content_{side}")
    links = stage_table(links.select("content_a", "content_b", "first_a", "first_b"), "links")
    # members to the other class's first: the links are the small side, so a class of any size stays where it is
    few = bounded_broadcast(links)
    to_first = ranked.join(few.withColumnRenamed("content_a", "content"), "content").select(F.col("key").alias("key_a"), F.col("first_b").alias("key_b"))
    from_first = ranked.where("rank > 0").join(few.withColumnRenamed("content_b", "content"), "content").select(F.col("first_a").alias("key_a"), F.col("key").alias("key_b"))
    own_first = ranked.where("rank > 0").join(bounded_broadcast(several), "content").select(F.col("first").alias("key_a"), F.col("key").alias("key_b"))
    # members of near numbers: equi-joins on (content, rank), where no key repeats on the other side
    later = ranked.where("rank > 0")
    other = later.select(F.col("content").alias("content_b"), F.col("rank").alias("rank_b"), F.col("key").alias("key_b"))
    mine = later.select(F.col("content").alias("content_a"), F.col("rank").alias("rank_a"), F.col("key").alias("key_a"))
    reach = mine.join(bounded_broadcast(links.select("content_a", "content_b")), "content_a").withColumn("rank_b", F.explode(F.sequence(F.greatest(F.col("rank_a") - near, F.lit(1)), F.col("rank_a") + near)))
    across = reach.join(other, ["content_b", "rank_b"]).select("key_a", "key_b")
    back = mine.where("rank_a > 1").withColumn("content_b", F.col("content_a")).withColumn("rank_b", F.explode(F.sequence(F.greatest(F.col("rank_a") - near, F.lit(1)), F.col("rank_a") - 1)))
    inside = back.join(other, ["content_b", "rank_b"]).select("key_a", "key_b")
    every = to_first.unionByName(from_first).unionByName(own_first).unionByName(across).unionByName(inside)
    return every.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def duplicate_groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(key, content, group_id, n_links): one row per key; group_id is the least content id linked to it, over any number of links.

    Connected components by alternating large-star and small-star rounds over contents. The joins that bring a node's least
    neighbour to its links are salted, so the links of a head with many are spread. n_links counts the pairs given with the content.
    """
    links = stage_table(pairs.select(F.col("content_a").alias("u"), F.col("content_b").alias("v")).distinct(), "links")
    degree = links.select(F.explode(F.array("u", "v")).alias("content")).groupBy("content").agg(F.count("*").alias("n_links"))
    edges, before = links, None
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(16)).cast("int").alias("salt")
    every_salt = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select("u", "m", every_salt)
        large = both.select("u", "v", salt("v")).join(low, ["u", "salt"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m")).select("u", "m", every_salt)
        small = large.select("u", "v", salt("v")).join(least, ["u", "salt"]).select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("e")).select(F.col("e.a").alias("u"), F.col("e.b").alias("v")).where("u <> v").distinct()
        edges = stage_table(small, "stars")
        state = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == before:
            break
        before = state
    heads = edges.groupBy(F.col("u").alias("content")).agg(F.min("v").alias("group_id"))
    return members.join(heads, "content", "left").join(degree, "content", "left").select("key", "content", F.coalesce("group_id", "content").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
