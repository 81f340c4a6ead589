"""Evaluation texts inside a corpus: a broadcast hash set of word n-grams, token windows, verification and removal."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.lookalikes import Twins, seen_places, unicode_twins, without_invisible
from folioforge.llm.words import WORD
from folioforge.runtime import bounded_broadcast, stage_table

#: Most item words in one broadcast, some 20 bytes each; more items are scanned for in further passes over the corpus, one after another.
SLICE_WORDS = 2_000_000
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _lower(text: str) -> str:
    """Lower case; letter by letter where that makes more letters of one."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() for c in text)


def words_and_places(text: str, twins: Twins | None = None) -> tuple[list[str], list[tuple[int, int]]]:
    """(words, places): lower-case words after invisible characters are removed, with the places in ``text`` where each begins and
    ends. With ``twins``, words are those of the text's consistent form."""
    if text.isascii():
        found = list(WORD.finditer(text))
        return [m.group().lower() for m in found], [m.span() for m in found]
    seen, at = twins.aligned(text) if twins else seen_places(text)
    low = _lower(seen)
    if len(low) != len(seen):
        at = [place for c, place in zip(seen, at) for _ in c.lower()]
    found = list(WORD.finditer(low))
    return [m.group() for m in found], [(at[m.start()], at[m.end() - 1] + 1) for m in found]


def plain_words(text: str, twins: Twins | None = None) -> list[str]:
    """The words alone."""
    if text.isascii():
        return WORD.findall(text.lower())
    return WORD.findall(_lower(twins.aligned(text)[0] if twins else without_invisible(text)))


def _hash_windows(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n ids that begin at ``starts``."""
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ ids[starts + k].astype(np.uint64)) * _MULT
            out ^= out >> np.uint64(29)
    return out


class GramSet:
    """The n-grams of the items by length: sorted hashes for the scan, and where each gram begins in the items' words for the check.

    An item of n words or more gives all its n-grams; a shorter one gives itself whole. Items without a word give nothing.
    """

    def __init__(self, items: list[tuple[int, str]], n: int, twins: Twins | None = None) -> None:
        self.twins = twins
        self.vocabulary: dict[str, int] = {}
        flat: list[int] = []
        owners, starts, sizes = [], [], []
        for item, text in items:
            words = plain_words(text, twins)
            size = min(n, len(words))
            if size:
                grams = len(words) - size + 1
                starts.append(np.arange(len(flat), len(flat) + grams, dtype=np.int64))
                owners.append(np.full(grams, item, np.int64))
                sizes.append(np.full(grams, size, np.int64))
                flat.extend([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        self.words = np.array(flat, np.int32)
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        if flat:
            owner, start, size = np.concatenate(owners), np.concatenate(starts), np.concatenate(sizes)
            for k in np.unique(size).tolist():
                at = np.flatnonzero(size == k)
                value = _hash_windows(self.words, start[at], k)
                order = np.argsort(value, kind="stable")
                self.grams[k] = value[order], start[at][order].astype(np.int32), owner[at][order]

    def scan(self, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(text index, item, first word, word after the last) of every window of the texts that is an n-gram of an item."""
        get = self.vocabulary.get
        flat: list[int] = []
        starts = []
        for words in texts:
            starts.append(len(flat))
            flat.extend([get(w, 0) for w in words])
            flat.append(0)
        ids = np.array(flat, np.int32)
        bad = np.concatenate([[0], np.cumsum(ids == 0)])
        found: list[tuple[int, int, int, int]] = []
        for size, (known, begins, owner) in self.grams.items():
            if len(ids) < size:
                continue
            whole = np.flatnonzero(bad[size:] == bad[:-size])  # windows of item words only
            if not len(whole):
                continue
            value = _hash_windows(ids, whole, size)
            lo, hi = np.searchsorted(known, value), np.searchsorted(known, value, side="right")
            times = hi - lo
            window = np.repeat(whole, times)
            gram = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            same = np.ones(len(window), bool)
            for k in range(size):  # every hash hit is checked on the words
                same &= ids[window + k] == self.words[begins[gram] + k]
            window, items = window[same], owner[gram[same]]
            text = np.searchsorted(starts, window, side="right") - 1
            first = window - np.array(starts)[text]
            found += zip(text.tolist(), items.tolist(), first.tolist(), (first + size).tolist())
        return found


def _slices(items: DataFrame, id_col: str, text_col: str) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(items, whether they are the last) in lists of at most SLICE_WORDS words; the driver holds two lists at a time."""
    table = items.select(F.col(id_col).cast("bigint").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    held, words, before = [], 0, None
    for row in table.orderBy("item_id", "text").toLocalIterator():
        size = len(row["text"].split()) + 1
        if words + size > SLICE_WORDS and held:
            if before is not None:
                yield before, False
            before, held, words = held, [], 0
        held.append((row["item_id"], row["text"]))
        words += size
    if before is not None:
        yield before, False
    yield held, True


def find_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, lookalikes: bool = False) -> DataFrame:
    """(doc_id, item_id, first_word, last_word, n_windows): the documents that hold n consecutive words of an item.

    Items shorter than n words must occur whole. The words compared are runs of letters or numerals, lower case, after
    invisible characters are removed; with ``lookalikes``, of the texts' consistent forms. Every hash hit is checked on the words.
    Null and empty texts hold nothing; rows without an id are left out; repeated rows count once. first_word and last_word give
    the range that the windows found span. Items beyond SLICE_WORDS words are scanned for slice by slice, each slice's findings
    being written before the next is broadcast.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text <> ''")
    twins = unicode_twins(spark) if lookalikes else None
    parts = []
    for items_, last in _slices(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(GramSet(items_, n, twins))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keys = b.column(0).to_pylist()
                spans: dict[tuple[int, int], list[int]] = {}
                texts = [plain_words(t, shared.value.twins) for t in b.column(1).to_pylist()]
                for at, item, lo, hi in shared.value.scan(texts):
                    s = spans.setdefault((keys[at], item), [lo, hi, 0])
                    s[0], s[1], s[2] = min(s[0], lo), max(s[1], hi), s[2] + 1
                rows = [(k, i, *s) for (k, i), s in spans.items()]
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "item_id", "first_word", "last_word", "n_windows"])

        found = slim.mapInArrow(run, "doc_id bigint, item_id bigint, first_word int, last_word int, n_windows int")
        if not last or parts:
            found = stage_table(found, "leaks")
            shared.destroy()
        parts.append(found)
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("doc_id", "item_id").agg(F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"), F.max("n_windows").alias("n_windows"))


def leaked_spans(texts: list[str | None], grams: GramSet) -> dict[int, list[tuple[int, int]]]:
    """By the number of a text that leaks: its places from the first letter to behind the last of each window found; overlapping and
    touching ones as one."""
    hits: dict[int, list[tuple[int, int]]] = {}
    for at, _, lo, hi in grams.scan([plain_words(t, grams.twins) if t else [] for t in texts]):
        hits.setdefault(at, []).append((lo, hi))
    out = {}
    for at, windows in hits.items():
        _, places = words_and_places(texts[at], grams.twins)
        out[at] = joined_spans([(places[lo][0], places[hi - 1][1]) for lo, hi in windows])
    return out


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans."""
    parts, at = [], 0
    for a, b in joined_spans(spans):
        parts.append(text[at:a])
        at = b
    return "".join(parts) + text[at:]


_SPANS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def remove_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 13, drop_documents: bool = False, lookalikes: bool = False) -> DataFrame:
    """The documents with leaked spans removed from ``text``; with ``drop_documents``, without the documents that leak.

    Spans are looked for in the stored text only, whatever the number of slices, and cut once all are known. Documents without a
    leak, null and empty texts come out as they are, repeated rows and rows without an id too.
    """
    spark = docs.sparkSession
    if drop_documents:
        leaking = find_leaks(docs, items, doc_id, text, item_id, item_text, n, lookalikes).select(F.col("doc_id").alias(doc_id)).distinct()
        return docs.join(leaking, doc_id, "left_anti").select(*docs.columns)
    twins = unicode_twins(spark) if lookalikes else None
    parts = []
    for items_, last in _slices(items, item_id, item_text):
        shared = spark.sparkContext.broadcast(GramSet(items_, n, twins))
        if last and not parts:  # all items at once: no need to bring spans and texts together
            return docs.withColumn(text, _remover(shared)(F.col(text)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                digests = b.column(0).to_pylist()
                rows = [(digests[at], s) for at, s in leaked_spans(b.column(1).to_pylist(), shared.value).items()]
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.string()), pa.array([[{"a": a, "b": b_} for a, b_ in s] for _, s in rows], _SPANS)], names=["_digest", "_spans"])

        texts = docs.where(F.col(text) != "").select(F.sha2(text, 256).alias("_digest"), F.col(text).alias("text"))
        parts.append(stage_table(texts.mapInArrow(run, "_digest string, _spans array<struct<a:int,b:int>>"), "spans"))
        shared.destroy()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # copies of a text find the same spans; spans of other slices are added
    spans = stage_table(every.distinct().groupBy("_digest").agg(F.flatten(F.collect_list("_spans")).alias("_spans")), "spans")
    cut = F.arrow_udf(lambda t, s: pa.array([cut_spans(x, [(y["a"], y["b"]) for y in z]) for x, z in zip(t.to_pylist(), s.to_pylist())], pa.string()), "string")
    joined = docs.withColumn("_digest", F.sha2(text, 256)).join(bounded_broadcast(spans), "_digest", "left")
    known = F.col("_spans").isNotNull()
    return joined.withColumn(text, F.when(known, cut(F.when(known, F.col(text)).otherwise(F.lit("")), F.coalesce("_spans", F.array().cast("array<struct<a:int,b:int>>")))).otherwise(F.col(text))).select(*docs.columns)


def _remover(shared):
    def run(texts: pa.Array) -> pa.Array:
        stored = texts.to_pylist()
        for at, spans in leaked_spans(stored, shared.value).items():
            stored[at] = cut_spans(stored[at], spans)
        return pa.array(stored, pa.string())

    return F.arrow_udf(run, "string")


def leak_report(docs: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """(suite, item_id, n_documents): for every item, in how many documents it leaked, 0 included."""
    found = stage_table(find_leaks(docs, items, n=n), "leaks")
    per = found.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "suite").distinct().join(per, "item_id", "left").select("suite", "item_id", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))
