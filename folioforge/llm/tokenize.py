"""Encoding of a corpus with a byte-level BPE vocabulary, on Spark higher-order functions.

1. An Arrow stage cuts the texts into the tokenizer's words, and these into fragments that no piece of the vocabulary can
   span, and keeps each worker's distinct ones.
2. Distinct words are merged in the JVM: a fold over the word's byte pieces takes the best-ranked pair until none is left.
   The ranks are a literal of the plan, hashed into small groups, so that a lookup reads a handful of keys.
3. Each word's ids go only to those groups of documents that hold the word; an Arrow stage lays the ids of a group's
   documents down in order.

No step keeps a table of all words in one place. What is shuffled: each text once, and each distinct word once per group of
documents that holds it.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: The word pattern that the vocabulary was made with.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

HUMP_PATTERN = r"(?<=\p{Ll})(?=\p{Lu})"

_MARKS = tuple(",.;:!?)")
_GROUPS = 16_384
_NO_RANK = 2**31 - 1
_BUCKET_BYTES = 8 << 20
_FLUSH_WORDS = 300_000


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def _rank_json(path: str) -> str:
    keys: list[list[str]] = [[] for _ in range(_GROUPS)]
    ids: list[list[int]] = [[] for _ in range(_GROUPS)]
    for piece, rank in load_ranks(path).items():
        group = xxhash.xxh64_intdigest(piece, 42) % _GROUPS
        keys[group].append(base64.b64encode(piece).decode())
        ids[group].append(rank)
    return json.dumps({"keys": keys, "ids": ids})


def rank_literal(path: str) -> Column:
    """The vocabulary as struct<keys array<array<binary>>, ids array<array<int>>>; constant folding makes it a literal."""
    return F.from_json(F.lit(_rank_json(path)), "keys array<array<binary>>, ids array<array<int>>")


def _rank(piece: Column, table: Column) -> Column:
    """Rank of a piece, or a number above all ranks."""
    group = F.shiftrightunsigned(F.xxhash64(piece), 0).bitwiseAND(_GROUPS - 1).cast("int")
    slot = (F.array_position(F.get(table["keys"], group), piece) - 1).cast("int")
    return F.coalesce(F.get(F.get(table["ids"], group), slot), F.lit(_NO_RANK))


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def merge_word(word: Column, table: Column) -> Column:
    """Token ids (array<int>) of one word given as binary.

    The fold's state holds the pieces and the ranks of neighbouring pairs. A step joins the leftmost pair of least rank and
    looks up its two new neighbours only; once no pair has a rank, the state stays as it is.
    """
    size = F.octet_length(word)
    pieces = F.transform(F.sequence(F.lit(1), size), lambda i: F.substring(word, i, F.lit(1)))
    ranks = F.transform(F.sequence(F.lit(1), size - 1), lambda i: _rank(F.substring(word, i, F.lit(2)), table))

    def step(state: Column, _: Column) -> Column:
        p, r = state["p"], state["r"]

        def join(best: Column) -> Column:
            def at(i: Column) -> Column:
                def merged(m: Column) -> Column:
                    n = F.size(p)
                    left = F.when(i > 1, F.array(_rank(F.concat(F.get(p, i - 2), m), table))).otherwise(F.array().cast("array<int>"))
                    right = F.when(i < n - 1, F.array(_rank(F.concat(m, F.get(p, i + 1)), table))).otherwise(F.array().cast("array<int>"))
                    return F.struct(
                        F.concat(F.slice(p, 1, i - 1), F.array(m), F.slice(p, i + 2, n)).alias("p"),
                        F.concat(F.slice(r, 1, F.greatest(i - 2, F.lit(0))), left, right, F.slice(r, i + 2, n)).alias("r"),
                    )

                return _let(F.concat(F.get(p, i - 1), F.get(p, i)), merged)

            return F.when(best == _NO_RANK, state).otherwise(_let(F.array_position(r, best).cast("int"), at))

        return F.when(F.size(r) == 0, state).otherwise(_let(F.array_min(r), join))

    start = F.struct(pieces.alias("p"), ranks.alias("r"))
    folded = F.aggregate(F.sequence(F.lit(2), size), start, step, lambda s: F.transform(s["p"], lambda x: _rank(x, table)))
    whole = _rank(word, table)
    return F.when(whole != _NO_RANK, F.array(whole)).otherwise(folded)


class Cutter:
    """Cuts texts into the tokenizer's words, and words into fragments that the merges can't join again.

    Texts are cut at single spaces first, as a word of the pattern never runs on into a space; each distinct unit is then cut
    by the pattern once. Where white space meets a space, the runs matter, and the pattern is applied to the whole text.
    A word is further cut between a small and a capital letter if no piece of the vocabulary fits across that place: no
    merge can then cross it either. So names put together from many words share their fragments.
    """

    def __init__(self, across: dict[str, list[tuple[str, str]]]) -> None:
        """``across``: by the two letters at such a place, the halves of the pieces that span it."""
        import regex

        self.cut = regex.compile(WORD_PATTERN).findall
        self.runs = regex.compile(r"\s ").search
        self.humps = regex.compile(HUMP_PATTERN).finditer
        self.across = across

    def units(self, text: str) -> list[str]:
        """Strings that are cut on their own. All but the first come without the space before them."""
        return text.split(" ") if self.runs(text) is None else []

    def words(self, unit: str) -> list[str]:
        """The words of a unit with the space before it; plain words, alone or before one mark, need no pattern."""
        if unit.isalpha():
            return [" " + unit]
        if unit[-1:] in _MARKS and unit[:-1].isalpha():
            return [" " + unit[:-1], unit[-1]]
        return self.cut(" " + unit)

    def fragments(self, words: list[str]) -> list[str]:
        out = []
        for w in words:
            if w.islower() or w.isupper() or len(w) < 4 or (w[2:] if w[0] == " " else w[1:]).islower():
                out.append(w)
                continue
            lo = 0
            for m in self.humps(w):
                i = m.start()
                if not any(w.endswith(left, 0, i) and w.startswith(right, i) for left, right in self.across.get(w[i - 1 : i + 1], ())):
                    out.append(w[lo:i])
                    lo = i
            out.append(w[lo:])
        return out


@cache
def spanning_pieces(path: str) -> dict[str, list[tuple[str, str]]]:
    """The pieces of the vocabulary with a small letter before a capital one, cut there, by the two letters."""
    import regex

    across: dict[str, list[tuple[str, str]]] = {}
    for raw in load_ranks(path):
        try:
            piece = raw.decode()
        except UnicodeDecodeError:
            continue
        for m in regex.finditer(HUMP_PATTERN, piece):
            i = m.start()
            across.setdefault(piece[i - 1 : i + 1], []).append((piece[:i], piece[i:]))
    return across


def _distinct_words(batches: Iterator[pa.RecordBatch], across: dict) -> Iterator[pa.RecordBatch]:
    own = Cutter(across)
    found: dict[int, set[str]] = {}
    whole: dict[int, set[str]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        by_wide: dict[int, dict[str, int]] = {}
        for spaced, groups in ((True, found), (False, whole)):
            masks: dict[int, dict[str, int]] = {}
            for bucket, units in groups.items():
                of, bit = masks.setdefault(bucket >> 6, {}), 1 << (bucket & 63)
                for u in units:
                    of[u] = of.get(u, 0) | bit
            for wide, of in masks.items():
                out = by_wide.setdefault(wide, {})
                for u, mask in of.items():
                    for w in own.fragments(own.words(u) if spaced else [u]):
                        out[w] = out.get(w, 0) | mask
        for wide, of in by_wide.items():
            words, bits = list(of), np.fromiter((m - (1 << 64) if m >> 63 else m for m in of.values()), np.int64, len(of))
            for k in range(0, len(words), 20_000):
                part = words[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([wide] * len(part), pa.int32()), pa.array(bits[k : k + 20_000])], names=["word", "wide", "mask"])
        found.clear()
        whole.clear()

    for batch in batches:
        for bucket, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            units = own.units(text)
            if units:
                words = found.setdefault(bucket, set())
                held -= len(words)
                words.update(units[1:])
                held += len(words)
            other = whole.setdefault(bucket, set())
            held -= len(other)
            other.update(own.cut(units[0] if units else text))
            held += len(other)
        if held > _FLUSH_WORDS:
            yield from flush()
            held = 0
    yield from flush()


class _Ids(dict):
    """Token ids by unit, put together from those of the fragments when a unit is first met.

    The ids of a unit are the same everywhere, so a worker keeps them from group to group, up to a fixed number of units.
    """

    LIMIT = 200_000

    def __init__(self, own: Cutter) -> None:
        self.own, self.of_fragment = own, {}

    def enter(self, of_fragment: dict[str, list[int]]) -> None:
        """Begin a group of documents with the ids of its fragments."""
        self.of_fragment = of_fragment
        if len(self) > self.LIMIT:
            self.clear()

    def of(self, words: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.of_fragment.__getitem__, self.own.fragments(words))))

    def __missing__(self, unit: str) -> list[int]:
        ids = self[unit] = self.of(self.own.words(unit))
        return ids


_ids_of_vocabulary: dict[str, _Ids] = {}


def _lay_down(docs: pa.Table, words: pa.Table, across: dict, vocabulary: str) -> pa.Table:
    ids_of = _ids_of_vocabulary.get(vocabulary) or _ids_of_vocabulary.setdefault(vocabulary, _Ids(Cutter(across)))
    own = ids_of.own
    lists = words.column("ids").combine_chunks()
    flat, ends = lists.flatten().to_numpy().tolist(), lists.offsets.to_numpy().tolist()
    first = ends[0] if ends else 0
    ids_of.enter({w: flat[a - first : b - first] for w, a, b in zip(words.column("word").to_pylist(), ends, ends[1:])})
    keys, offsets, parts, total, seen = [], [0], [], 0, set()
    for key, text in zip(docs.column("doc_id").to_pylist(), docs.column("text").to_pylist()):
        if key is not None:
            if key in seen:
                continue
            seen.add(key)
        units = own.units(text)
        ids = ids_of.of(own.cut(units[0] if units else text)) if text else []
        if units:
            ids.extend(chain.from_iterable(map(ids_of.__getitem__, units[1:])))
        keys.append(key)
        parts.append(np.array(ids, np.int32))
        total += len(ids)
        offsets.append(total)
    values = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.table({"doc_id": pa.array(keys, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))})


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """(doc_id, ids): one row per document with the token ids of its text, without special tokens.

    Null and empty texts get an empty list. Redelivered rows (same id) count once; rows whose id is null are kept each.
    The strings of special tokens inside a text are ordinary text. ``buckets`` is the number of document groups; by default
    one per 8 MB of text, so a group's texts fit a worker at any corpus size. Rows without an id are spread by their text.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if buckets is None:
        size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-size // _BUCKET_BYTES))
    across = spanning_pieces(vocabulary)  # goes to the workers with the functions, so only the driver reads the file
    grouped = slim.withColumn("bucket", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(buckets)).cast("int"))
    seen = grouped.where("text <> ''").select("bucket", "text").mapInArrow(lambda it: _distinct_words(it, across), "word string, wide int, mask bigint")
    words = seen.groupBy("word", "wide").agg(F.bit_or("mask").alias("mask"))
    encoded = words.withColumn("ids", merge_word(F.encode("word", "UTF-8"), rank_literal(vocabulary)))
    bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit("mask", b) == 1)
    per_bucket = encoded.select("word", "ids", F.explode(F.transform(bits, lambda b: F.col("wide") * 64 + b)).alias("bucket"))
    # a task per group, without hashing the groups' numbers once more; tasks are of one size at any corpus size
    texts, lookup = grouped.repartitionById(buckets, F.col("bucket")), per_bucket.repartitionById(buckets, F.col("bucket"))
    return texts.groupBy("bucket").cogroup(lookup.groupBy("bucket")).applyInArrow(lambda d, w: _lay_down(d, w, across, vocabulary), "doc_id bigint, ids array<int>")


def decode_ids(tokens: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Add the text of a list of ids: the binary pieces of the ids, concatenated. Unknown ids and nulls add nothing."""
    ranks = load_ranks(vocabulary)
    pieces = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        pieces[rank] = piece
    table = F.from_json(F.lit(json.dumps({"p": [base64.b64encode(p).decode() for p in pieces]})), "p array<binary>")["p"]
    hexes = F.transform(F.col(ids_col), lambda i: F.coalesce(F.hex(F.get(table, i)), F.lit("")))
    return tokens.withColumn(out_col, F.decode(F.unhex(F.array_join(hexes, "")), "UTF-8"))
