"""The k most similar vectors of every vector by additive quantisation.

* Codebooks are fitted on bounded samples; all of them are full-dimensional and act on residuals. A beam search encodes each
  vector; the norm of the decoded vector is stored with the code.
* Cells are found in two levels. The first is fitted in the driver, on FIRST centroids, more of them (the square root of the number of
  vectors) in large tables. Where cells of the first would hold more than CELL_GOAL vectors, each is divided by a fit on a sample of its
  own, in the tasks, so the number of cells follows the number of vectors, up to GROWTH * FIRST * SECOND.
* No step holds all cells near all vectors of a batch: scores are taken in slices, and of each vector only the best cells are kept.
* A vector asks its own cell and those whose centroid is nearly as close.
* Inside a cell, lookup tables (query times codebook) give approximate cosines of all its vectors; the best of them are
  ranked again by exact cosine, and so is every other one that its quantisation error leaves in question. The lists of the
  cells asked are merged.
* Vectors with more near cells than they asked, or with too short a list, ask on: all cells but those that centroid distance
  and cell radius rule out against the last cosine of the list. Those cells are compared exactly, in blocks of cells. In exact mode all
  vectors do.
* Equal vectors count once in the index: their ids travel with the first of them, so no group of copies is compared with
  itself. Cells above a fixed number of rows are cut into parts, and so are the vectors that ask them; a task meets one part of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import bounded_broadcast, stage_table

#: Vectors that the driver fits the first level and the residual codebooks on, and those that a first-level cell is divided by at most.
SAMPLE_ROWS, CELL_SAMPLE = 16_384, 8_192
#: Cells of the first level while that is enough, of the second in one of them at most, and vectors that a cell should hold.
FIRST, SECOND, CELL_GOAL = 512, 128, 64
#: How many times FIRST and SAMPLE_ROWS large tables take at most.
GROWTH = 8
CELL_ROWS = 4_096
#: Scores, pairs or rows to send that a worker holds at a time.
HELD_SCORES, HELD_PAIRS, HELD_ROWS = 2_000_000, 2_000_000, 20_000
#: Vectors per task of the search.
TASK_ROWS = 8_192
#: Vectors of a block of cells, and about as many askers it meets at once.
BLOCK_ROWS = 8_192
#: How much lower than the best a first-level cell may score for the cells under it to be looked at.
_FIRST_MARGIN = 0.12
#: More than the rounding of cosines and distances in single precision.
_ROUNDING = 1e-5


class _Kept:
    """(row, cell, score) so far: those within ``margin`` of the row's best, the best ``most`` of each row."""

    def __init__(self, n: int, margin: float, most: int | None) -> None:
        self.best, self.margin, self.most = np.full(n, -np.inf, np.float32), np.float32(margin), most
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        self.held, self.room = 0, HELD_PAIRS

    def add(self, rows: np.ndarray, cells: np.ndarray, scores: np.ndarray) -> None:
        np.maximum.at(self.best, rows, scores)
        self.parts.append((rows, cells, scores))
        self.held += len(rows)
        if self.held > self.room:
            self.held = len(self.listed()[0])
            self.room = max(HELD_PAIRS, 2 * self.held)

    def listed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, cells, scores = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        keep = np.flatnonzero(scores >= self.best[rows] - self.margin)
        keep = keep[np.lexsort((cells[keep], -scores[keep], rows[keep]))]
        if self.most is not None:
            keep = keep[np.arange(len(keep)) - np.searchsorted(rows[keep], rows[keep]) < self.most]
        self.parts = [(rows[keep].astype(np.int64), cells[keep].astype(np.int64), scores[keep])]
        return self.parts[0]


@dataclass
class Codebooks:
    """first: centroids of the first level of cells; cells: (C, dim) centroids of unit vectors, those of first-level cell f being
    starts[f] to starts[f + 1]; residual: (M, 256, dim) codebooks of what is left."""

    first: np.ndarray
    cells: np.ndarray
    starts: np.ndarray
    residual: np.ndarray

    @cached_property
    def half(self) -> np.ndarray:
        return 0.5 * np.einsum("nd,nd->n", self.cells, self.cells)

    def near(self, x: np.ndarray, margin: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows, cells, scores) of the cells whose score is within ``margin`` of the row's best, the best first, at most ``most`` of
        each row. Scores order as distances do. Of two levels only the cells under near first-level cells are looked at."""
        kept = _Kept(len(x), margin, most)
        flat, half_first = len(self.first) == len(self.cells), 0.5 * (self.first * self.first).sum(1)
        who, under, held = [], [], 0
        step = max(1, HELD_SCORES // max(1, len(self.first)))
        for lo in range(0, len(x), step):
            top = x[lo : lo + step] @ self.first.T
            top -= half_first
            best = top.max(1, initial=-np.inf)
            if flat:
                r, c = np.nonzero(top >= (best - margin)[:, None])
                kept.add(r + lo, c, top[r, c])
                continue
            # the cells under the best first-level cell set a floor, so that few of the others are listed
            r, f = np.nonzero(top >= (best - _FIRST_MARGIN)[:, None])
            who.append((r + lo).astype(np.int32))
            under.append(f.astype(np.int32))
            held += len(r)
            self._under(x, np.arange(lo, lo + len(top)), top.argmax(1), kept, floors_only=True)
            if held > HELD_PAIRS or lo + step >= len(x):
                self._under(x, np.concatenate(who), np.concatenate(under), kept)
                who, under, held = [], [], 0
        return kept.listed()

    def _under(self, x: np.ndarray, who: np.ndarray, under: np.ndarray, kept: _Kept, floors_only: bool = False) -> None:
        """Scores of the cells under the first-level cells of (row, first-level cell)."""
        order = np.argsort(under, kind="stable")
        who, (firsts, begins) = who[order], np.unique(under[order], return_index=True)
        for f, at in zip(firsts.tolist(), np.split(who, begins[1:])):
            lo, hi = self.starts[f], self.starts[f + 1]
            step = max(1, HELD_SCORES // max(1, hi - lo))
            for part in (at[i : i + step] for i in range(0, len(at), step)):
                score = x[part] @ self.cells[lo:hi].T
                score -= self.half[lo:hi]
                if floors_only:  # the same score may be rounded otherwise when it is taken again
                    kept.best[part] = np.maximum(kept.best[part], score.max(1, initial=-np.inf) - _ROUNDING)
                else:
                    r, c = np.divmod(np.flatnonzero(score >= (kept.best[part] - kept.margin)[:, None]), hi - lo)
                    kept.add(part[r], c + lo, score[r, c])

    def own(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        rows, cells, _ = self.near(x, 0.0, 1)
        _, at = np.unique(rows, return_index=True)
        return cells[at]


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(1)
    some = max(1, HELD_SCORES // len(centres))
    return np.concatenate([np.argmax(x[lo : lo + some] @ centres.T - half, axis=1) for lo in range(0, max(1, len(x)), some)])


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        order = np.argsort(near, kind="stable")
        used, starts, counts = np.unique(near[order], return_index=True, return_counts=True)
        centres[used] = np.add.reduceat(x[order], starts, axis=0) / counts[:, None]
        empty = np.setdiff1d(np.arange(k), used)
        centres[empty] = x[rng.choice(len(x), len(empty))]
    return centres


def fit(sample: np.ndarray, books: int = 4, seed: int = 5) -> Codebooks:
    """Codebooks of unit vectors: one cell per 32 sample rows, then ``books`` residual codebooks of 256 entries, fitted on SAMPLE_ROWS."""
    cells = _kmeans(sample, min(max(FIRST, FIRST * len(sample) // SAMPLE_ROWS), max(1, len(sample) // 32)), 5, seed).astype(np.float32)
    sample = sample[:SAMPLE_ROWS]
    part = sample - cells[_nearest(sample, cells)]
    residual = []
    for m in range(books):
        book = _kmeans(part, 256, 6, seed + m + 1)
        part = part - book[_nearest(part, book)]
        residual.append(book)
    return Codebooks(cells, cells, np.arange(len(cells) + 1), np.stack(residual).astype(np.float32))


def divide(books: Codebooks, rows: DataFrame, count: int, dim: int) -> Codebooks:
    """The codebooks with a second level of cells, so that a cell holds about CELL_GOAL of ``count`` rows.

    A hash of the id draws the sample, 32 rows for each centroid to be made; of one cell the CELL_SAMPLE of least hash are used, and no
    task meets more. What comes to the driver is at most GROWTH * FIRST * SECOND centroids.
    """
    wide = min(SECOND, -(-count // (len(books.first) * CELL_GOAL)))
    if wide <= 1:
        return books
    rate = min(1.0, 32 * wide * len(books.first) / count)
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, unit, at = _usable(batch, dim)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.own(unit).astype(np.int32)), batch.column(2).take(pa.array(at)), pa.array([u.tobytes() for u in unit], pa.binary())], names=["cell", "lot", "unit"])

    def split(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("lot")
        x = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        centres = _kmeans(x, min(wide, max(1, len(x) // 16)), 5, 17).astype(np.float32)
        return pa.table({"cell": pa.array([key[0].as_py()] * len(centres), pa.int32()), "centre": pa.array([c.tobytes() for c in centres], pa.binary())})

    drawn = rows.withColumn("lot", F.xxhash64("vec_id", F.lit(9))).where(F.pmod("lot", F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    spread = drawn.mapInArrow(place, "cell int, lot bigint, unit binary")
    least = spread.withColumn("n", F.row_number().over(Window.partitionBy("cell").orderBy("lot"))).where(F.col("n") <= CELL_SAMPLE).drop("n")
    found = least.groupBy("cell").applyInArrow(split, "cell int, centre binary").toArrow()  # at most GROWTH * FIRST * SECOND centroids
    own = found.column("cell").to_numpy()
    centres = np.frombuffer(b"".join(found.column("centre").to_pylist()), np.float32).reshape(-1, dim)
    missing = np.setdiff1d(np.arange(len(books.first)), own)
    own, centres = np.concatenate([own, missing]), np.concatenate([centres, books.first[missing]])
    order = np.argsort(own, kind="stable")
    return Codebooks(books.first, np.ascontiguousarray(centres[order]), np.searchsorted(own[order], np.arange(len(books.first) + 1)), books.residual)


def encode(x: np.ndarray, cell: np.ndarray, books: Codebooks, beam: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(codes uint8, norms of the decoded vectors), by a beam search over the residual codebooks."""
    n, dim = x.shape
    left = (x - books.cells[cell])[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for book in books.residual:
        width = left.shape[1]
        err = (book * book).sum(1)[None, None, :] - 2 * (left.reshape(-1, dim) @ book.T).reshape(n, width, 256) + (left * left).sum(2)[:, :, None]
        err = err.reshape(n, width * 256)
        keep = min(beam, err.shape[1])
        best = np.argpartition(err, keep - 1, axis=1)[:, :keep]
        parent, entry = best // 256, (best % 256).astype(np.uint8)
        left = np.take_along_axis(left, parent[:, :, None], axis=1) - book[entry]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], axis=1), entry[:, :, None]], axis=2)
    least = (left * left).sum(2).argmin(1)
    rows = np.arange(n)
    return codes[rows, least], np.linalg.norm(x - left[rows, least], axis=1).astype(np.float32)


def _usable(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, unit vectors as float32, positions in the batch) of the rows with finite components that aren't all zero."""
    column = batch.column(1)
    raw = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    wide = raw.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((wide * wide).sum(1))
    at = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return batch.column(0).to_numpy()[at], (wide[at] / norm[at, None]).astype(np.float32), at


def _above(q: np.ndarray, base: np.ndarray, floor: np.ndarray, heads: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of base, exact cosine) of the pairs not below the row's floor: per row of q the best k, by cosine and head."""
    at, to = np.nonzero(q @ base.T >= (floor - _ROUNDING)[:, None])
    cos = np.concatenate([np.round(np.einsum("nd,nd->n", q[a].astype(np.float64), base[b].astype(np.float64)), 9) for a, b in ((at[i : i + 65_536], to[i : i + 65_536]) for i in range(0, max(1, len(at)), 65_536))])
    order = np.lexsort((heads[to], -cos, at))
    at, to, cos = at[order], to[order], cos[order]
    best = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[best], to[best], cos[best]


def _listed(ids: list[int], found: list[np.ndarray], cosines: list[np.ndarray]) -> pa.Table:
    ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
    found_, cos_ = (np.concatenate(x) if x else np.empty(0) for x in (found, cosines))
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "found": pa.ListArray.from_arrays(ends, pa.array(found_.astype(np.int64))), "cosine": pa.ListArray.from_arrays(ends, pa.array(cos_.astype(np.float64)))})


def _members(near: np.ndarray, cos: np.ndarray, groups: list[list[int]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of the members of the groups found."""
    flat = sorted((-c, g) for c, n in zip(cos, near) for g in groups[n])[:k]
    return np.array([g for _, g in flat], np.int64), np.array([-c for c, _ in flat])


def _blocks(cells: np.ndarray, counts: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, int]:
    """(first block of each cell, number of blocks): neighbouring small cells share a block, a split cell has one per part."""
    order = np.argsort(_nearest(cells, _kmeans(cells, max(1, int(counts.sum()) // BLOCK_ROWS), 5, 11)), kind="stable")
    first, block, held = np.zeros(len(cells), np.int64), -1, BLOCK_ROWS
    for c in order:
        if parts[c] > 1 or held + counts[c] > BLOCK_ROWS:
            block, held = block + 1, 0
        first[c] = block
        held += counts[c]
        if parts[c] > 1:
            block, held = block + int(parts[c]) - 1, BLOCK_ROWS
    return first, block + 1


def _rows(frame: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return frame.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("v")).where((F.size("v") == dim) & F.col("vec_id").isNotNull())


def all_neighbours(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "dense", k: int = 10, dim: int = 64, margin: float = 0.08, most_cells: int = 6, shortlist: int = 64, exact: bool = False) -> DataFrame:
    """(vec_id, neighbor_id, cosine, rank): for every usable vector its k nearest by cosine, itself excluded.

    Usable are vectors with exactly ``dim`` finite components that aren't all zero; others, nulls and rows without id are
    neither asked nor found. Redelivered rows count once; equal cosines go by smaller id. A vector asks the cells whose
    centroid's cosine is within ``margin`` of the nearest one's, the nearest ``most_cells`` first; if there are more, or the
    list stays short, it asks every further cell that may hold a vector of the list. Recall is measured in the tests. With
    ``exact`` all vectors ask on, and nothing rests on the quantisation.
    """
    spark = frame.sparkSession
    rows = _rows(frame, id_col, vector_col, dim)
    count = rows.count()
    # a hash of the id draws the sample, so that each task sends its share only
    wanted_rows = int(SAMPLE_ROWS * min(GROWTH, max(1.0, count**0.5 / FIRST)))
    drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) < int(min(1.0, 1.2 * wanted_rows / max(1, count)) * (1 << 20)) + 1)
    lot = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted_rows).toArrow().combine_chunks()
    units = [_usable(b, dim)[1] for b in lot.to_batches()]
    sample = np.concatenate(units) if units else np.empty((0, dim), np.float32)
    if not len(sample):  # all drawn are unusable, or there are none
        units = [_usable(b, dim)[1] for b in rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)).limit(SAMPLE_ROWS).toArrow().to_batches()]
        sample = np.concatenate(units) if units else np.empty((0, dim), np.float32)
    if not len(sample):
        return spark.createDataFrame([], "vec_id bigint, neighbor_id bigint, cosine double, rank int")
    books = spark.sparkContext.broadcast(divide(fit(sample), rows, count, dim))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit, at = _usable(batch, dim)
            raw = np.ascontiguousarray(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)[at])
            pair = np.frombuffer(b"".join(xxhash.xxh3_128_digest(v) for v in raw), np.int64).reshape(-1, 2)
            at_row, cells, _ = books.value.near(unit, margin, most_cells + 1)
            first = np.searchsorted(at_row, np.arange(len(unit)))
            cell = cells[first] if len(cells) else np.empty(0, np.int64)
            many = (np.bincount(at_row, minlength=len(unit)) > most_cells) | exact
            away = np.linalg.norm(unit - books.value.cells[cell], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.array(cell.astype(np.int32)), pa.array(away.astype(np.float32)), pa.array(many)], names=["vec_id", "h1", "h2", "cell", "away", "many"])

    half = books.value.half
    known = stage_table(rows.mapInArrow(survey, "vec_id bigint, h1 bigint, h2 bigint, cell int, away float, many boolean"), "survey")
    counts = known.groupBy("cell").agg(F.count("*").alias("count"), F.max("away").alias("radius")).toArrow()  # at most one row per centroid
    sizes, radius = np.zeros(len(books.value.cells), np.int64), np.full(len(books.value.cells), -np.inf)
    sizes[counts.column("cell").to_numpy()], radius[counts.column("cell").to_numpy()] = counts.column("count").to_numpy(), counts.column("radius").to_numpy()
    parts = np.maximum(1, -(-sizes // CELL_ROWS)).astype(np.int32)
    split = spark.sparkContext.broadcast(parts)

    # groups of equal vectors: the first member stands for all, with the k + 1 smallest ids
    copies = known.groupBy("h1", "h2").agg(F.min("vec_id").alias("first"), F.max("vec_id").alias("last")).where("first < last").select("h1", "h2", "first")
    members = stage_table(known.join(copies, ["h1", "h2"]).select("first", "vec_id").distinct(), "copies")
    leading = members.withColumn("n", F.row_number().over(Window.partitionBy("first").orderBy("vec_id"))).where(F.col("n") <= k + 1)
    heads = leading.groupBy("first").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    marks = stage_table(members.join(heads, "first", "left").select("vec_id", F.when(F.col("vec_id") == F.col("first"), F.col("ids")).alias("ids"), F.lit(True).alias("copy")), "marks")
    indexed = rows.join(bounded_broadcast(marks), "vec_id", "left").where("copy is null or ids is not null").select("vec_id", "v", F.coalesce("ids", F.array("vec_id")).alias("ids"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for batch in batches:
            _, unit, at = _usable(batch, dim)
            if not len(at):
                continue
            all_rows, all_cells, _ = own.near(unit, margin, most_cells)
            bounds = np.searchsorted(all_rows, np.arange(len(unit) + 1))
            cell = all_cells[bounds[:-1]]
            codes, norms = (np.concatenate(c) for c in zip(*(encode(unit[lo : lo + 2_048], cell[lo : lo + 2_048], own) for lo in range(0, len(unit), 2_048))))
            ids = batch.column(0).to_numpy()[at]
            # of a split cell, a part of the vectors meets a part of those that ask: each goes to all parts of the others
            mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            blob, code = [u.tobytes() for u in unit], [c.tobytes() for c in codes]
            key_of = lambda c, home, part: c.astype(np.int64) << 40 | home << 20 | part
            sent = np.cumsum(np.add.reduceat(split.value[all_cells].astype(np.int64), bounds[:-1]) + split.value[cell])
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(sent // HELD_ROWS)) + 1, [len(unit)]])
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                rows_, cells_ = all_rows[bounds[lo] : bounds[hi]], all_cells[bounds[lo] : bounds[hi]]
                times = split.value[cells_]
                ask_rows, ask_cells = np.repeat(rows_, times), np.repeat(cells_, times)
                ask_home = np.arange(len(ask_rows)) - np.repeat(np.cumsum(times) - times, times)
                ask_part = (mixed[ask_rows] >> 11) % split.value[ask_cells]
                whole = split.value[cell[lo:hi]]
                home_rows = np.repeat(np.arange(lo, hi), whole)
                home_part = np.arange(len(home_rows)) - np.repeat(np.cumsum(whole) - whole, whole)
                home_home = mixed[home_rows] % split.value[cell[home_rows]]
                ask_key, home_key = key_of(ask_cells, ask_home, ask_part), key_of(cell[home_rows], home_home, home_part)
                # a vector that asks where it lives is sent once
                rows_, key = np.concatenate([ask_rows, home_rows]), np.concatenate([ask_key, home_key])
                role = np.concatenate([np.ones(len(ask_rows), np.int8), np.full(len(home_rows), 2, np.int8)])
                order = np.lexsort((key, rows_))
                rows_, key = rows_[order], key[order]
                begins = np.flatnonzero(np.concatenate([[True], (rows_[1:] != rows_[:-1]) | (key[1:] != key[:-1])]))
                role = np.bitwise_or.reduceat(role[order], begins)
                rows_, key, ask_flag, home_flag = rows_[begins], key[begins], role & 1 > 0, role & 2 > 0
                yield pa.RecordBatch.from_arrays([
                    pa.array(key), pa.array(ids[rows_]), pa.array([blob[i] for i in rows_], pa.binary()), pa.array([code[i] if h else None for i, h in zip(rows_, home_flag)], pa.binary()),
                    pa.array(np.where(home_flag, norms[rows_], 0).astype(np.float32)), batch.column(2).take(pa.array(at[rows_], mask=~home_flag)), pa.array(ask_flag),
                ], names=["key", "vec_id", "unit", "code", "norm", "ids", "asks"])

    def search(key: tuple, table: pa.Table) -> pa.Table:
        own = books.value
        ids = table.column("vec_id").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        code = table.column("code").to_pylist()
        here = np.array([i for i, c in enumerate(code) if c is not None], np.int64)
        _, once = np.unique(ids[here], return_index=True)
        here = here[once]
        ask = np.flatnonzero(table.column("asks").to_numpy(zero_copy_only=False))
        ask = ask[np.unique(ids[ask], return_index=True)[1]]
        if not len(here) or not len(ask):
            return _listed([], [], [])
        codes = np.frombuffer(b"".join(code[i] for i in here), np.uint8).reshape(len(here), -1)
        norm, base = table.column("norm").to_numpy()[here], unit[here]
        groups = table.column("ids").combine_chunks().take(pa.array(here)).to_pylist()
        wide, single = base.astype(np.float64), all(len(g) == 1 for g in groups)
        heads = np.array([g[0] for g in groups], np.int64)
        centre = own.cells[key[0].as_py() >> 40]
        out_ids, out_found, out_cos = [], [], []
        decoded = centre + sum(book[codes[:, m]] for m, book in enumerate(own.residual))
        error = np.linalg.norm(base - decoded, axis=1) + _ROUNDING
        for lo in range(0, len(ask), 512):
            who = ask[lo : lo + 512]
            q = unit[who]
            take = min(len(here), shortlist)
            if take < len(here):
                approx = np.repeat((q @ centre)[:, None], len(here), axis=1)
                for m, book in enumerate(own.residual):
                    approx += (q @ book.T)[:, codes[:, m]]
                short = np.argpartition(-approx / norm, take - 1, axis=1)[:, :take]
            else:
                short = np.broadcast_to(np.arange(take), (len(who), take))
            exact = np.round(np.einsum("qd,qsd->qs", q.astype(np.float64), wide[short]), 9)
            rest = {}
            if take < len(here):
                # the shortlist's last cosine against what quantisation error allows for the others
                least = np.sort(exact, axis=1)[:, -(k + 1)] if take > k else np.full(len(who), -2.0)
                may = approx + error >= least[:, None]
                np.put_along_axis(may, short, False, axis=1)
                left = np.flatnonzero(may.any(1))
                at, to, cos = _above(q[left], base, least[left], heads, k + 1)
                cut = np.searchsorted(at, np.arange(len(left) + 1))
                rest = {int(i): (to[cut[n] : cut[n + 1]], cos[cut[n] : cut[n + 1]]) for n, i in enumerate(left)}
            for i, w in enumerate(who):
                if i in rest:
                    near, cos = rest[i]
                else:
                    order = np.lexsort((heads[short[i]], -exact[i]))[: k + 1]
                    near, cos = short[i][order], exact[i][order]
                near, cos = (heads[near], cos) if single else _members(near, cos, groups, k + 1)
                out_ids.append(ids[w])
                out_found.append(near)
                out_cos.append(cos)
        return _listed(out_ids, out_found, out_cos)

    placed = indexed.mapInArrow(place, "key bigint, vec_id bigint, unit binary, code binary, norm float, ids array<bigint>, asks boolean")
    tasks = max(8, sum(counts.column("count").to_pylist()) // TASK_ROWS)
    lists = placed.repartition(tasks, "key").groupBy("key").applyInArrow(search, "vec_id bigint, found array<bigint>, cosine array<double>")

    def best_of(found: DataFrame) -> DataFrame:
        merged = found.groupBy("vec_id").agg(F.flatten(F.collect_list(F.zip_with("cosine", "found", lambda c, i: F.struct((-c).alias("far"), i.alias("id"))))).alias("all"))
        return merged.select("vec_id", F.slice(F.array_sort(F.array_distinct("all")), 1, k + 1).alias("best"))

    best = stage_table(best_of(lists), "best")
    many = known.where("many").select("vec_id", "many").distinct()
    short = F.size("best") <= k
    floors = stage_table(best.join(many, "vec_id", "left").where(F.col("many") | short).select("vec_id", F.when(short, -2.0).otherwise(-F.element_at("best", -1)["far"]).alias("floor")), "floors")
    askers = stage_table(rows.join(bounded_broadcast(floors), "vec_id").dropDuplicates(["vec_id"]), "askers")
    n_askers = askers.count()
    if not n_askers:
        return _ranked(best, members, k)
    first, n_blocks = _blocks(books.value.cells, sizes, parts)
    salts = -(-n_askers // BLOCK_ROWS)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = books.value
        for batch in batches:
            ids, unit, at = _usable(batch, dim)
            if not len(at):
                continue
            floor = batch.column(2).to_numpy()[at]
            some = max(1, HELD_SCORES // 8 // len(half))  # rows at a time, so that the distances to all cells stay small
            few, held, reach = [], 0, radius.astype(np.float32)
            for lo in range(0, len(unit), some):
                far = np.sqrt(np.maximum(0, 1 + 2 * half - 2 * (unit[lo : lo + some] @ own.cells.T)))
                gap = np.maximum(0, far - reach - 1e-3)
                who, cell = np.nonzero(np.isfinite(reach) & (1 - 0.5 * gap * gap >= floor[lo : lo + some, None] - _ROUNDING))
                times = split.value[cell]
                who, block = np.repeat(who, times), np.repeat(first[cell], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                few.append(np.unique((who + lo) * n_blocks + block))
                held += len(few[-1])
                if held > HELD_PAIRS // 8 or lo + some >= len(unit):
                    who, block = np.divmod(np.concatenate(few), n_blocks)
                    begin, end = lo + some - some * len(few), min(lo + some, len(unit))
                    blocks = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(begin, end + 1)), pa.int32()), pa.array(block))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[begin:end]), pa.array([u.tobytes() for u in unit[begin:end]], pa.binary()), pa.array(floor[begin:end]), blocks], names=["vec_id", "unit", "floor", "blocks"])
                    few, held = [], 0

    asked = stage_table(askers.mapInArrow(ask, "vec_id bigint, unit binary, floor double, blocks array<bigint>"), "asked")
    wanted = np.zeros(n_blocks, bool)
    wanted[[r[0] for r in asked.select(F.explode("blocks")).distinct().collect()]] = True  # at most one row per block

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, unit, at = _usable(batch, dim)
            if not len(at):
                continue
            cell = books.value.own(unit)
            block = first[cell] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % split.value[cell]
            here = np.flatnonzero(wanted[block])
            yield pa.RecordBatch.from_arrays([pa.array(block[here]), pa.array(ids[here]), pa.array([unit[i].tobytes() for i in here], pa.binary()), batch.column(2).take(pa.array(at[here]))], names=["block", "vec_id", "unit", "ids"])

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids = table.column("vec_id").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float32).reshape(-1, dim)
        lists_ = table.column("ids").combine_chunks()
        held, who = lists_.is_valid().to_numpy(zero_copy_only=False), table.column("floor").to_numpy()
        here, asks = np.flatnonzero(held), np.flatnonzero(~held)
        here = here[np.unique(ids[here], return_index=True)[1]]
        if not len(here) or not len(asks):
            return _listed([], [], [])
        groups, base = lists_.take(pa.array(here)).to_pylist(), np.ascontiguousarray(unit[here])
        heads, single = np.array([g[0] for g in groups], np.int64), all(len(g) == 1 for g in groups)
        out_ids, out_found, out_cos = [], [], []
        some = min(512, max(1, HELD_SCORES // len(here)))
        for lo in range(0, len(asks), some):
            part = asks[lo : lo + some]
            at, to, cos = _above(unit[part], base, who[part], heads, k + 1)
            cut = np.searchsorted(at, np.arange(len(part) + 1))
            for n in np.flatnonzero(np.diff(cut)):
                near, c = to[cut[n] : cut[n + 1]], cos[cut[n] : cut[n + 1]]
                near, c = (heads[near], c) if single else _members(near, c, groups, k + 1)
                out_ids.append(ids[part[n]])
                out_found.append(near)
                out_cos.append(c)
        return _listed(out_ids, out_found, out_cos)

    salt = F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")
    asking = asked.select(F.explode("blocks").alias("block"), salt.alias("salt"), "vec_id", "unit", "floor", F.lit(None).cast("array<bigint>").alias("ids"))
    held = indexed.mapInArrow(answer, "block bigint, vec_id bigint, unit binary, ids array<bigint>")
    held = held.select("block", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "vec_id", "unit", F.lit(None).cast("double").alias("floor"), "ids")
    more = asking.unionByName(held).repartition(max(8, int(wanted.sum()) * salts), "block", "salt").groupBy("block", "salt").applyInArrow(compare, "vec_id bigint, found array<bigint>, cosine array<double>")
    old = best.select("vec_id", F.transform("best", lambda x: x["id"]).alias("found"), F.transform("best", lambda x: -x["far"]).alias("cosine"))
    return _ranked(best_of(old.unionByName(more)), members, k)


def _ranked(best: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """The lists of the first members as rows of all members."""
    owners = best.join(bounded_broadcast(members.withColumnRenamed("vec_id", "member").withColumnRenamed("first", "vec_id")), "vec_id", "left").withColumn("vec_id", F.coalesce("member", "vec_id"))
    ranked = owners.select("vec_id", F.posexplode(F.slice(F.filter("best", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("rank", "x"))
    return ranked.select("vec_id", F.col("x.id").alias("neighbor_id"), (-F.col("x.far")).alias("cosine"), (F.col("rank") + 1).alias("rank"))
