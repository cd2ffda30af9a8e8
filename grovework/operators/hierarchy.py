"""Problem 4: parent-child links to full hierarchies.

1. Components. Every node has at most one parent, so a component is a tree with one root or a loop with trees on it.
   Pointer jumping (each round a join of the unfinished nodes with the pointers) finds every node's root in
   log2(depth) rounds. The nodes left over when a round finishes nobody have no root: they lie on or below a loop.
   The rounds also sum up depths.
2. Co-location. Rows are grouped by component; an iterative depth-first traversal with node colouring gives paths,
   depths, descendants and the back edges that close loops. What a task gathers is bounded by the rows and the path
   elements of a component, not by rows alone.
3. The paths of a component beyond ``max_component_cells`` rows and path elements are composed by pointer doubling over
   relations instead, in log2(depth) rounds; descendants are summed up along the same pointers. Every column has the
   same values either way.

Defined results
* a null parent, or a parent that names no row, makes the node a root;
* a node that is its own parent is a loop of one;
* exact duplicates and older rows of a node do not matter (current rows only), rows with a null key are dropped;
* for nodes on or below a loop: ``root`` is null, ``path`` starts at the loop's smallest id, and ``depth`` counts from it;
* a loop is entered at its smallest id, so ``back_edge`` marks that node: its parent link leads back into the traversal;
* an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grovework.runtime import current_rows, cut, release

MAX_COMPONENT_CELLS = 4_000_000  # rows and path elements of a component that one task gathers

RESULT = T.StructType(
    [
        T.StructField("project", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("depth", T.IntegerType()),
        T.StructField("n_descendants", T.LongType()),
        T.StructField("cycle_id", T.StringType()),
        T.StructField("on_cycle", T.BooleanType()),
        T.StructField("back_edge", T.BooleanType()),
    ]
)


def parent_links(nodes: DataFrame) -> DataFrame:
    """``project, id, parent_id`` of current rows; ``parent_id`` is null where it names no row."""
    now = current_rows(nodes, ["project", "id"], ["parent_id"])
    ids = now.select("project", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    return now.join(ids, ["project", "parent_id"], "left").select(
        "project", "id", F.when(F.col("_there"), F.col("parent_id")).alias("parent_id")
    )


def _jump_to_roots(links: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(``project, id, root, depth`` of nodes in trees, links of the nodes on or below loops or None)."""
    top = F.col("parent_id").isNull()
    state = cut(
        links.select("project", "id", F.coalesce("parent_id", "id").alias("anc"), F.when(top, 0).otherwise(1).cast("long").alias("depth"), top.alias("done")),
        "jump",
    )
    left = state.where(~F.col("done")).count()
    while left:
        ptr = state.select("project", F.col("id").alias("anc"), F.col("anc").alias("_next"), F.col("depth").alias("_depth"), F.col("done").alias("_done"))
        moved = (
            state.where(~F.col("done"))
            .join(ptr, ["project", "anc"])
            .select("project", "id", F.col("_next").alias("anc"), (F.col("depth") + F.col("_depth")).alias("depth"), F.col("_done").alias("done"))
        )
        new = cut(state.where("done").unionByName(moved), "jump")
        release(state)
        state, before = new, left
        left = state.where(~F.col("done")).count()
        if left == before:
            break
    roots = state.where("done").select("project", "id", F.col("anc").alias("root"), "depth")
    if not left:
        return roots, None
    looped = cut(links.join(state.where(~F.col("done")).select("project", "id"), ["project", "id"], "left_semi"), "loops")
    return roots, looped


def _loop_ids(looped: DataFrame) -> DataFrame:
    """``project, id, cycle_id, on_cycle`` for links none of whose chains ends, by pointer jumping.

    Once the image of all nodes under 2^k steps stops shrinking it is the set of nodes on loops; the smallest id
    within 2^k steps, grown until it stops changing there, names the loop.
    """
    state = cut(looped.select("project", "id", F.col("parent_id").alias("land"), F.col("id").alias("low")), "land")
    size, settled = -1, False
    while not settled:
        image = state.select("project", F.col("land").alias("id")).distinct()
        ptr = state.select("project", F.col("id").alias("land"), F.col("land").alias("_land"), F.col("low").alias("_low"))
        new = cut(
            state.join(ptr, ["project", "land"]).select(
                "project", "id", F.col("_land").alias("land"), F.least("low", "_low").alias("low"), (F.col("_low") < F.col("low")).alias("_lower")
            ),
            "land",
        )
        n = image.count()
        if n == size:
            settled = new.where("_lower").join(image, ["project", "id"], "left_semi").isEmpty()
        size = n
        release(state)
        state = new.drop("_lower")
        state._grovework_path = new._grovework_path
    image = state.select("project", F.col("land").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    low = state.select("project", F.col("id").alias("land"), F.col("low").alias("cycle_id"))
    return (
        state.select("project", "id", "land")
        .join(low, ["project", "land"])
        .join(image, ["project", "id"], "left")
        .select("project", "id", "cycle_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))
    )


def traverse(pdf: pd.DataFrame) -> pd.DataFrame:
    """Depth-first traversal of one component (columns project, id, parent_id) with an explicit stack.

    White nodes have not been met, grey ones are on the stack, black ones are finished. The climb from a node through
    its parents that meets a grey node has found a back edge; the nodes between close a loop.
    """
    ids, parents = pdf["id"].tolist(), pdf["parent_id"].tolist()
    parent = {i: (None if p is None or p != p else p) for i, p in zip(ids, parents)}
    colour = dict.fromkeys(ids, 0)
    loop: dict[str, str] = {}
    back: set[str] = set()
    for start in sorted(ids):
        trail, at = [], start
        while at is not None and colour[at] == 0:
            colour[at] = 1
            trail.append(at)
            at = parent[at]
        if at is not None and colour[at] == 1:
            ring = trail[trail.index(at) :]
            low = min(ring)
            loop.update(dict.fromkeys(ring, low))
            back.add(low)
        for node in trail:
            colour[node] = 2
    children: dict[str, list[str]] = {}
    tops = sorted(set(loop.values()))
    for i in ids:
        p = parent[i]
        if p is None:
            tops.append(i)
        elif not (i in loop and loop[i] == i):
            children.setdefault(p, []).append(i)
    out: dict[str, tuple] = {}
    size = dict.fromkeys(ids, 1)
    for top in tops:
        cycle = loop.get(top)
        stack = [(top, [top])]
        order = []
        while stack:
            node, path = stack.pop()
            out[node] = (None if cycle else top, path, len(path) - 1, cycle)
            order.append(node)
            for child in children.get(node, ()):
                stack.append((child, path + [child]))
        for node in reversed(order):
            p = parent[node]
            if p is not None and node != top:
                size[p] += size[node]
    return pd.DataFrame(
        {
            "project": pdf["project"].tolist(),
            "id": ids,
            "parent_id": [parent[i] for i in ids],
            "root": [out[i][0] for i in ids],
            "path": [out[i][1] for i in ids],
            "depth": [out[i][2] for i in ids],
            "n_descendants": [size[i] - 1 for i in ids],
            "cycle_id": [out[i][3] for i in ids],
            "on_cycle": [i in loop for i in ids],
            "back_edge": [i in back for i in ids],
        },
        columns=[f.name for f in RESULT],
    )


def _doubled(links: DataFrame, members: DataFrame) -> DataFrame:
    """The result of ``traverse`` for components too large to gather: paths composed by pointer doubling.

    ``members``: project, id, root, cycle_id, on_cycle. The loop's smallest node is taken for its component's top. After
    k rounds ``up`` is 2^k steps up and ``n`` counts the nodes less than 2^k steps below (and the node itself), so a
    round adds to each node the counts of those exactly 2^k steps below it.
    """
    base = links.join(members, ["project", "id"])
    top = F.col("parent_id").isNull() | (F.col("on_cycle") & (F.col("cycle_id") == F.col("id")))
    state = cut(
        base.select("*", F.when(~top, F.col("parent_id")).alias("up"), F.array("id").alias("path"), F.lit(1).cast("long").alias("n")), "double"
    )
    while not state.where(F.col("up").isNotNull()).isEmpty():
        ptr = state.select("project", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        below = state.where(F.col("up").isNotNull()).groupBy("project", F.col("up").alias("id")).agg(F.sum("n").alias("_n"))
        moved = state.join(ptr, ["project", "up"], "left").join(below, ["project", "id"], "left")
        new = cut(
            moved.select(
                *[c for c in state.columns if c not in ("up", "path", "n")],
                F.col("_up").alias("up"),
                F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("_path", "path")).alias("path"),
                (F.col("n") + F.coalesce("_n", F.lit(0))).alias("n"),
            ).select(*state.columns),
            "double",
        )
        release(state)
        state = new
    return state.select(
        "project",
        "id",
        "parent_id",
        "root",
        "path",
        (F.size("path") - 1).alias("depth"),
        (F.col("n") - 1).alias("n_descendants"),
        "cycle_id",
        "on_cycle",
        (F.col("on_cycle") & (F.col("cycle_id") == F.col("id"))).alias("back_edge"),
    )


def _resolve(links: DataFrame, members: DataFrame, max_component_cells: int) -> DataFrame:
    """``members``: project, id, comp, root, depth, cycle_id, on_cycle. Splits components by size and resolves both kinds.

    A node of unknown depth (on or below a loop) is taken to be as deep as its component has nodes.
    """
    known = F.sum(F.coalesce(F.col("depth") + 2, F.lit(2)))
    unknown = F.sum(F.when(F.col("depth").isNull(), 1).otherwise(0))
    sizes = members.groupBy("project", "comp").agg((known + unknown * unknown).alias("_n"))
    members = members.drop("depth")
    large = cut(sizes.where(F.col("_n") > max_component_cells).select("project", "comp"), "large")
    if large.isEmpty():
        small, big = members, None
    else:
        small = members.join(large, ["project", "comp"], "left_anti")
        big = members.join(large, ["project", "comp"], "left_semi")
    rows = links.join(small.select("project", "id", "comp"), ["project", "id"])
    out = rows.groupBy("project", "comp").applyInPandas(lambda pdf: traverse(pdf), RESULT)
    if big is not None:
        out = out.unionByName(_doubled(links, big.drop("comp")))
    return out


def hierarchy(nodes: DataFrame, max_component_cells: int = MAX_COMPONENT_CELLS) -> DataFrame:
    """Of each node: parent, root, path (ids from the top), depth, number of descendants, loop (``RESULT``).

    ``back_edge`` marks one node of each loop, the one whose parent link closes it.
    """
    links = cut(parent_links(nodes), "links")
    roots, looped = _jump_to_roots(links)
    none = F.lit(None).cast("string")
    members = roots.select("project", "id", F.col("root").alias("comp"), "root", "depth", none.alias("cycle_id"), F.lit(False).alias("on_cycle"))
    if looped is not None:
        loops = _loop_ids(looped)
        members = members.unionByName(
            loops.select("project", "id", F.col("cycle_id").alias("comp"), none.alias("root"), F.lit(None).cast("long").alias("depth"), "cycle_id", "on_cycle")
        )
    return _resolve(links, members, max_component_cells)


def loops(nodes: DataFrame, max_component_cells: int = MAX_COMPONENT_CELLS) -> DataFrame:
    """``hierarchy`` of the components that have a loop only (nodes on and below it)."""
    links = cut(parent_links(nodes), "links")
    _, looped = _jump_to_roots(links)
    if looped is None:
        return nodes.sparkSession.createDataFrame([], RESULT)
    found = _loop_ids(looped)
    members = found.select("project", "id", F.col("cycle_id").alias("comp"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), "cycle_id", "on_cycle")
    return _resolve(looped, members, max_component_cells)


def descendants(resolved: DataFrame) -> DataFrame:
    """``project, ancestor, descendant, distance`` of every pair, from the paths of ``hierarchy``; no shuffle."""
    pairs = F.posexplode(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))).alias("_at", "ancestor")
    return resolved.select("project", F.col("id").alias("descendant"), "depth", pairs).select(
        "project", "ancestor", "descendant", (F.col("depth") - F.col("_at")).alias("distance")
    )
