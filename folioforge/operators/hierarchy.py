"""Parent-child rows to full hierarchies: peeling, Euler tours and parallel list ranking.

Pointers are contracted first: rows are cut into stretches of keys of bounded size, and inside a stretch every pointer is followed
until it leaves it. Only what other stretches point at is ranked by shuffles, in rounds that double the distance, so their number
is the logarithm of the stretches that a chain passes, and their size that of the crossings. Neither a deep chain nor a huge
family ends up in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.runtime import drop_staged, stage_table

#: Rows of a stretch, and steps of an interval that are unrolled in one go.
STRETCH, SPAN = 200_000, 4_096


def section_links(sections: DataFrame) -> DataFrame:
    """(key, parent): one row per section_key with the valid parent's key or null.

    The row with the latest updated_at counts (ties: the greatest row). parent_id counts only if it names a section of the
    same doc_id; null, empty and dangling ids make a root. Rows without section_key are dropped. Should two keys share
    a section_id inside one document, the smaller key is the parent.
    """
    rows = sections.where("section_key is not null").groupBy("section_key").agg(F.max(F.struct("updated_at", "doc_id", "section_id", "parent_id")).alias("r"))
    rows = rows.select(F.col("section_key").alias("key"), "r.doc_id", "r.section_id", "r.parent_id")
    named = rows.where("doc_id is not null and section_id is not null").groupBy("doc_id", F.col("section_id").alias("parent_id")).agg(F.min("key").alias("parent"))
    return rows.join(named, ["doc_id", "parent_id"], "left").select("key", "parent")


def _follow(at: np.ndarray, to: np.ndarray, known: np.ndarray, sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(stop, sums, ends) of the pointers of a stretch: the row where following ends, as what it points at lies outside or nowhere, the
    sums over the rows passed, that one included, and whether it ends at all."""
    order = np.argsort(at)
    place = np.minimum(np.searchsorted(at, to, sorter=order), len(at) - 1)
    inside = known & (at[order[place]] == to)
    jump = np.where(inside, order[place], np.arange(len(at)))
    passed = [np.where(inside, x, 0) for x in sums]
    for _ in range(len(at).bit_length() + 1):
        far = jump[jump]
        if (far == jump).all():
            break
        passed = [x + x[jump] for x in passed]
        jump = far
    return jump, [x + own[jump] for x, own in zip(passed, sums)], ~inside[jump]


def contract(lists: DataFrame, sums: list[str], end: str = "at") -> DataFrame:
    """(at, next, *sums, last, turns) of linked lists (at, next, *sums), ``at`` being unique: every pointer followed inside its stretch.

    last is the value of ``end`` in the row where following ended, next what that points at (null at a list's end), and the sums those of
    all rows from ``at`` to that one. Pointers that turn in a circle inside the stretch are marked by ``turns``, with themselves as next.
    """
    stretches = max(1, -(-lists.count() // STRETCH))
    cut = lists.select("at", "next", *sums, F.col(end).alias("last"))
    cut = cut.coalesce(1) if stretches == 1 else cut.repartitionByRange(stretches, "at")
    names = ["at", "next", *sums, "last", "turns"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        at, pointer = table.column(0).to_numpy(), table.column(1).combine_chunks()
        known = pointer.is_valid().to_numpy(zero_copy_only=False)
        to = pointer.fill_null(0).to_numpy()
        stop, totals, ends = _follow(at, to, known, [table.column(2 + k).to_numpy() for k in range(len(sums))])
        beyond = np.where(ends, to[stop], at)
        columns = [pa.array(at), pa.array(beyond, mask=ends & ~known[stop]), *map(pa.array, totals), pa.array(table.column(2 + len(sums)).to_numpy()[stop]), pa.array(~ends)]
        yield from pa.Table.from_arrays(columns, names=names).to_batches(65_536)

    kinds = ", ".join(["at bigint", "next bigint", *[f"{c} bigint" for c in sums], "last bigint", "turns boolean"])
    return cut.mapInArrow(run, kinds)


def endless(links: DataFrame) -> DataFrame:
    """(key) of the nodes that reach no root: those on loops and those that lead into one."""
    short = stage_table(contract(links.select(F.col("key").alias("at"), F.col("parent").alias("next")), []), "contracted")
    going = short.where("next is not null")
    asked = going.select(F.col("next").alias("at")).distinct()
    crossing = stage_table(short.join(asked, "at", "left_semi").where("next is not null").select("at", "next"), "crossings")
    jump = stage_table(contract(crossing, []).where("next is not null").select("at", "next"), "crossings")  # if few, this ends them all
    left = jump.count()
    while left:
        after = stage_table(jump.join(jump.select(F.col("at").alias("next"), F.col("next").alias("far")), "next").select("at", F.col("far").alias("next")), "crossings")
        count = after.count()
        drop_staged(links.sparkSession, jump)
        jump = after
        if count == left:  # as nodes of every smaller depth exist, a round that removes nothing has removed all that end
            break
        left = count
    held = going.select(F.col("at").alias("key"), "next", "turns").join(jump.select(F.col("at").alias("next"), F.lit(True).alias("lost")), "next", "left")
    return held.where("turns or lost").select("key")


def peel(links: DataFrame) -> DataFrame:
    """(key) of the nodes on loops, by peeling leaves until only loops are left.

    Nodes that reach a root are on none and are left out first. Of the rest, round k removes the 2^k lowest layers of leaves at
    once: the images of the 2^k-fold parent step are just the nodes with a descendant chain that long. As every such node has
    descendants of each smaller height, a round that removes nothing ends the peeling; loops map onto themselves.
    """
    spark = links.sparkSession
    jump = stage_table(links.join(endless(links), "key", "left_semi").select("key", F.col("parent").alias("to")), "peel")
    live = jump.select(F.col("to").alias("key")).distinct().count()
    while live:
        far = jump.select(F.col("key").alias("to"), F.col("to").alias("far"))
        after = stage_table(jump.join(far, "to").select("key", F.col("far").alias("to")), "peel")
        left = after.select("to").distinct().count()
        drop_staged(spark, jump)
        jump = after
        if left == live:
            break
        live = left
    return stage_table(jump.select(F.col("to").alias("key")).distinct(), "loops")


def loop_heads(links: DataFrame, loops: DataFrame) -> DataFrame:
    """(key, head) for the nodes on loops: head is the loop's smallest key, found by doubling steps with running minima."""
    spark = links.sparkSession
    state = stage_table(links.join(loops, "key", "left_semi").select("key", F.col("parent").alias("to"), F.least("key", "parent").alias("head")), "heads")
    if state.isEmpty():
        return state.select("key", "head")
    while True:
        far = state.select(F.col("key").alias("to"), F.col("to").alias("far"), F.col("head").alias("far_head"))
        after = stage_table(state.join(far, "to").select("key", F.col("far").alias("to"), F.least("head", "far_head").alias("head"), (F.col("far_head") < F.col("head")).alias("moved")), "heads")
        moved = not after.where("moved").isEmpty()
        drop_staged(spark, state)
        state = after.select("key", "to", "head")
        if not moved:
            return state.select("key", "head")


def euler_tour(forest: DataFrame) -> DataFrame:
    """(at, next, enters, step): the tours of all trees as linked lists.

    Each node has an entry (at = 2 * n) and an exit (2 * n + 1), where n is its key. An entry leads to the first child's entry
    or the own exit; an exit leads to the next sibling's entry or the parent's exit. Siblings are chained inside salted
    groups whose ends are chained in turn, so that no family is sorted in one task.
    """
    salted = forest.where("parent is not null").withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(64)))
    inside = salted.withColumn("sibling", F.lead("key").over(Window.partitionBy("parent", "salt").orderBy("key")))
    ends = salted.groupBy("parent", "salt").agg(F.min("key").alias("first"))
    ends = ends.withColumn("after", F.lead("first").over(Window.partitionBy("parent").orderBy("salt"))).withColumn("eldest", F.first("first").over(Window.partitionBy("parent").orderBy("salt")))
    chained = inside.join(ends.select("parent", "salt", "after"), ["parent", "salt"]).select("key", "parent", F.coalesce("sibling", "after").alias("sibling"))
    first = ends.select(F.col("parent").alias("key"), "eldest").distinct()
    entries = forest.join(first, "key", "left").select((F.col("key") * 2).alias("at"), F.coalesce(F.col("eldest") * 2, F.col("key") * 2 + 1).alias("next"), F.lit(1).cast("bigint").alias("enters"), F.lit(1).cast("bigint").alias("step"))
    exits = chained.select((F.col("key") * 2 + 1).alias("at"), F.coalesce(F.col("sibling") * 2, F.col("parent") * 2 + 1).alias("next"), F.lit(0).cast("bigint").alias("enters"), F.lit(-1).cast("bigint").alias("step"))
    roots = forest.where("parent is null").select((F.col("key") * 2 + 1).alias("at"), F.lit(None).cast("bigint").alias("next"), F.lit(0).cast("bigint").alias("enters"), F.lit(-1).cast("bigint").alias("step"))
    return entries.unionByName(exits).unionByName(roots)


def rank_lists(tour: DataFrame) -> DataFrame:
    """(at, last, enters, step): sums from each element to the end of its list, and the list's last element.

    Parallel list ranking: lists are contracted inside stretches, the elements that other stretches point at are ranked by pointer
    jumping, and their ranks are added to those that point at them.
    """
    spark = tour.sparkSession
    short = stage_table(contract(tour, ["enters", "step"]).drop("turns"), "contracted")
    going = short.where("next is not null")
    done = short.where("next is null").select("at", "last", "enters", "step")
    if going.isEmpty():
        return done
    crossing = stage_table(short.join(going.select(F.col("next").alias("at")).distinct(), "at", "left_semi"), "crossings")
    work = stage_table(contract(crossing, ["enters", "step"], "last").drop("turns"), "ranks")  # if few, this ranks them all
    while not work.where("next is not null").isEmpty():
        ahead = work.select(F.col("at").alias("next"), F.col("next").alias("next2"), F.col("enters").alias("enters2"), F.col("step").alias("step2"), F.col("last").alias("last2"))
        moved = work.where("next is not null").join(ahead, "next").select("at", F.col("next2").alias("next"), (F.col("enters") + F.col("enters2")).alias("enters"), (F.col("step") + F.col("step2")).alias("step"), F.col("last2").alias("last"))
        after = stage_table(work.where("next is null").select("at", "next", "enters", "step", "last").unionByName(moved), "ranks")
        drop_staged(spark, work)
        work = after
    ahead = work.select(F.col("at").alias("next"), F.col("enters").alias("enters2"), F.col("step").alias("step2"), F.col("last").alias("last2"))
    joined = going.join(ahead, "next").select("at", F.col("last2").alias("last"), (F.col("enters") + F.col("enters2")).alias("enters"), (F.col("step") + F.col("step2")).alias("step"))
    return done.unionByName(joined)


def loops(links: DataFrame) -> DataFrame:
    """(key, head) for the nodes on loops: head is the loop's smallest key.

    What reaches no root is peeled and its loops are walked round, in one task if that is at most a stretch, else by shuffled rounds.
    """
    left = stage_table(links.join(endless(links), "key", "left_semi").select("key", "parent"), "endless")
    if left.count() > STRETCH:
        return loop_heads(links, peel(links))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        table = pa.Table.from_batches(batches)
        key, parent = table.column(0).to_numpy(), table.column(1).to_numpy()
        order = np.argsort(key)
        up = order[np.searchsorted(key, parent, sorter=order)]  # parents of such nodes are such nodes
        far, least, jump = up, np.minimum(key, key[up]), up
        for _ in range(len(key).bit_length() + 1):
            least = np.minimum(least, least[jump])
            far, jump = far[far], jump[jump]
        on = np.unique(far)  # all leaves are peeled when the step is longer than any chain
        yield pa.RecordBatch.from_arrays([pa.array(key[on]), pa.array(least[on])], names=["key", "head"])

    return left.coalesce(1).mapInArrow(run, "key bigint, head bigint")


def hierarchy_labels(links: DataFrame) -> DataFrame:
    """(key, root, depth, pre, size, on_loop) for every node of (key, parent) links.

    Nodes of one tree have consecutive pre-order numbers from 0; the descendants of a node are pre+1 .. pre+size-1. A loop is
    cut above its smallest key, which becomes the root of everything that leads into the loop; on_loop marks the nodes of
    the loop itself.
    """
    links = stage_table(links, "links")
    heads = stage_table(loops(links), "loop-heads")
    forest = links.join(heads, "key", "left").select("key", F.when(F.col("head") == F.col("key"), None).otherwise(F.col("parent")).alias("parent"))
    ranked = rank_lists(stage_table(euler_tour(forest), "tour"))
    ends = ranked.groupBy(F.shiftright("at", 1).alias("key")).agg(F.max("last").alias("last"), F.max("enters").alias("enters"), F.min("enters").alias("below"), F.max(F.when(F.col("at").bitwiseAND(1) == 0, F.col("step"))).alias("step"))
    total = ends.where("key = shiftright(last, 1)").select("last", F.col("enters").alias("total"))
    labels = ends.join(total, "last").select("key", F.shiftright("last", 1).alias("root"), (-F.col("step")).cast("int").alias("depth"), (F.col("total") - F.col("enters")).alias("pre"), (F.col("enters") - F.col("below")).alias("size"))
    labels = labels.join(heads.select("key", F.lit(True).alias("on_loop")), "key", "left").withColumn("on_loop", F.coalesce("on_loop", F.lit(False)))
    return stage_table(labels, "labels")


def closure(labels: DataFrame) -> DataFrame:
    """(ancestor, key): every node reached from an ancestor by one or more links.

    The intervals are unrolled and looked up by (root, pre), so the work follows the result's size. A node on a loop reaches
    the whole of what hangs on the loop, itself included.
    """
    loop_size = labels.where("on_loop and key = root").select("root", F.col("size").alias("loop_size"))
    spans = labels.join(loop_size, "root", "left").select(
        F.col("key").alias("ancestor"), "root",
        F.when(F.col("on_loop"), F.lit(0)).otherwise(F.col("pre") + 1).alias("lo"),
        F.when(F.col("on_loop"), F.col("loop_size") - 1).otherwise(F.col("pre") + F.col("size") - 1).alias("hi"),
    ).where("lo <= hi")
    # long intervals are cut into bounded ones and spread, so that no row or task unrolls a whole tree
    ranges = spans.select("ancestor", "root", "hi", F.explode(F.when(F.col("hi") - F.col("lo") < SPAN, F.array("lo")).otherwise(F.sequence("lo", "hi", F.lit(SPAN).cast("bigint")))).alias("lo"))
    steps = ranges.select("ancestor", "root", F.explode(F.sequence("lo", F.least("hi", F.col("lo") + SPAN - 1))).alias("pre"))
    return steps.join(labels.select("root", "pre", "key"), ["root", "pre"]).select("ancestor", "key")


def hierarchy(sections: DataFrame) -> DataFrame:
    """(section_key, root_key, depth, path, n_descendants, on_loop) for every section.

    path lists the keys from the root to the section. depth is 0 for roots. Below a loop, path and depth start at the loop's
    smallest key.
    """
    labels = hierarchy_labels(section_links(sections))
    tree = labels.withColumn("on_loop", F.lit(False))
    above = closure(tree).join(labels.select(F.col("key").alias("ancestor"), F.col("depth").alias("d")), "ancestor")
    paths = above.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "ancestor"))), lambda x: x["ancestor"]).alias("above"))
    return labels.join(paths, "key", "left").select(
        F.col("key").alias("section_key"), F.col("root").alias("root_key"), "depth",
        F.concat(F.coalesce("above", F.array().cast("array<bigint>")), F.array("key")).alias("path"), (F.col("size") - 1).alias("n_descendants"), "on_loop",
    )
