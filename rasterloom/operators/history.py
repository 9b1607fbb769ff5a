"""Edit histories: many trees of states at once, each with a current state and an active branch.

A history is three tables: ``nodes`` (tree, id, parent_id, ts, branch_id, step_index, and any columns of the states themselves),
``branches`` (tree, branch_id, root_id, leaf_id) and ``cursors`` (tree, current_id, active_branch, next_branch). Every operation takes
all trees and is made of joins. Walks use jump tables by pointer doubling: table j leads 2**j states on, so a walk of n states
takes log(n) joins for any number of trees, and the tables are as large as the nodes.

A state's children are ordered by (ts, id). The first child goes on with the active branch; each further one begins a branch, which gets
the tree's next number. Ids are unique in a tree. Rows whose tree or id is null take no part; a parent that isn't there counts as none.
"""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.sources.staging import cut

#: States that a tree keeps (fixed value).
MOST_NODES = 100
CORE = ("tree", "id", "parent_id", "ts", "branch_id", "step_index")
_TYPES = {"branches": "tree long, branch_id int, root_id long, leaf_id long", "cursors": "tree long, current_id long, active_branch int, next_branch int"}


@dataclasses.dataclass(frozen=True)
class History:
    nodes: DataFrame
    branches: DataFrame
    cursors: DataFrame


# ---- trees


def children(nodes: DataFrame) -> DataFrame:
    """(id, child_id)."""
    return nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("id"), F.col("id").alias("child_id"))


def forks(nodes: DataFrame, keys: tuple[str, ...] = ("tree",)) -> DataFrame:
    """H1: ordinal of each node among its parent's children (from 1) and whether it began a branch (every child but the first)."""
    rank = F.row_number().over(W.partitionBy(*keys, "parent_id").orderBy("ts", "id"))
    return nodes.withColumn("child", F.when(F.col("parent_id").isNotNull(), rank)).withColumn("is_fork", F.coalesce(F.col("child") > 1, F.lit(False)))


def jumps(step: DataFrame) -> list[DataFrame]:
    """Tables (tree, id, to) that lead 1, 2, 4 ... steps on, until no walk is that long. step: (tree, id, to), one row for each id."""
    tables, now = [], cut(step.select("tree", "id", "to"))
    while not now.isEmpty():
        tables.append(now)
        on = now.select("tree", F.col("id").alias("to"), F.col("to").alias("_next"))
        now = cut(now.join(on, ["tree", "to"]).select("tree", "id", F.col("_next").alias("to")))
    return tables


def parents(nodes: DataFrame) -> DataFrame:
    """(tree, id, to): the parents that are there."""
    there = nodes.select("tree", F.col("id").alias("to"))
    return nodes.where("parent_id IS NOT NULL").select("tree", "id", F.col("parent_id").alias("to")).join(there, ["tree", "to"], "left_semi").select("tree", "id", "to")


def next_states(nodes: DataFrame, active: DataFrame) -> DataFrame:
    """(tree, id, to): the child on the branch wanted for each node of active (tree, id, branch), else the first child."""
    child = nodes.where("parent_id IS NOT NULL").select("tree", F.col("parent_id").alias("id"), F.col("id").alias("to"), "ts", F.col("branch_id").alias("_on"))
    best = F.min_by("to", F.struct(F.coalesce(F.col("_on") != F.col("branch"), F.lit(True)), "ts", "to"))
    return child.join(active, ["tree", "id"]).groupBy("tree", "id").agg(best.alias("to"))


def walk(start: DataFrame, tables: list[DataFrame]) -> DataFrame:
    """start (tree, id, n) with id led n steps on, or as far as it goes; ``went`` counts the steps."""
    now = start.withColumn("went", F.lit(0))
    for j in reversed(range(len(tables))):
        led = now.join(tables[j], ["tree", "id"], "left")
        goes = (F.col("n") - F.col("went") >= 1 << j) & F.col("to").isNotNull()
        now = led.select("tree", F.when(goes, F.col("to")).otherwise(F.col("id")).alias("id"), *[c for c in start.columns if c not in ("tree", "id")], F.when(goes, F.col("went") + (1 << j)).otherwise(F.col("went")).alias("went"))
    return now


def path(start: DataFrame, tables: list[DataFrame], sign: int = 1) -> DataFrame:
    """(tree, id, at): every state on the walks from start (tree, id), which is at 0; the next one is at sign, and so on."""
    now = start.select("tree", "id", F.lit(0).alias("at"))
    for j, table in enumerate(tables):
        now = now.unionByName(now.join(table, ["tree", "id"]).select("tree", F.col("to").alias("id"), (F.col("at") + sign * (1 << j)).alias("at")))
    return now


# ---- H1: recording states


def opened(states: DataFrame) -> History:
    """A history of trees that nothing was recorded in; states: a table whose columns its states are to have."""
    spark, own = states.sparkSession, [c for c in states.columns if c not in CORE]
    nodes = states.limit(0).select(F.col("tree").cast("long"), F.col("id").cast("long"), F.lit(None).cast("long").alias("parent_id"), "ts", F.lit(0).alias("branch_id"), F.lit(0).alias("step_index"), *own)
    return History(nodes, *(spark.createDataFrame([], t) for t in _TYPES.values()))


def append(history: History, states: DataFrame, most: int | None = MOST_NODES) -> History:
    """Record states (tree, id, ts, their own columns, and parent_id if given) in the order of (ts, id).

    Without a parent a state follows the one recorded before it: the batch's previous one, or the tree's current one.
    The last state becomes current, and trees over ``most`` states lose their oldest ones.
    """
    own = [c for c in history.nodes.columns if c not in CORE]
    order = W.partitionBy("tree").orderBy("ts", "id")
    given = F.col("parent_id").cast("long") if "parent_id" in states.columns else F.lit(None).cast("long")
    new = states.where("tree IS NOT NULL AND id IS NOT NULL").withColumn("parent_id", given).join(history.cursors, "tree", "left")
    follows = F.coalesce(F.lag("id").over(order), F.col("current_id"))
    new = new.withColumn("at_cursor", F.col("parent_id").isNull() & (F.row_number().over(order) == 1)).withColumn("parent_id", F.coalesce("parent_id", follows))
    new = cut(new.select("tree", "id", "parent_id", "ts", "at_cursor", "active_branch", F.coalesce("next_branch", F.lit(1)).alias("next_branch"), *own))

    # each further child of a parent forks; forks are numbered by time
    before = children_count(history.nodes)
    ordinal = F.row_number().over(W.partitionBy("tree", "parent_id").orderBy("ts", "id")) + F.coalesce("n_children", F.lit(0))
    new = new.join(before, ["tree", "parent_id"], "left").withColumn("is_fork", F.col("parent_id").isNotNull() & (ordinal > 1)).drop("n_children")
    number = F.col("next_branch") - 1 + F.sum(F.col("is_fork").cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    known = F.when(F.col("is_fork"), number).when(F.col("parent_id").isNull(), 0).when(F.col("at_cursor"), F.col("active_branch")).cast("int")
    placed = place(new.withColumn("branch_id", known), history.nodes)
    nodes = history.nodes.unionByName(placed.select(*CORE, *own))

    last = lambda c: F.max_by(c, F.struct("ts", "id"))
    leaves = placed.groupBy("tree", "branch_id").agg(last("id").alias("_leaf"), F.min_by(F.when(F.col("is_fork"), F.col("parent_id")).otherwise(F.col("id")), F.struct("ts", "id")).alias("_root"))
    branches = history.branches.join(leaves, ["tree", "branch_id"], "full").select("tree", "branch_id", F.coalesce("root_id", "_root").alias("root_id"), F.coalesce("_leaf", "leaf_id").alias("leaf_id"))
    moved = placed.groupBy("tree").agg(last("id").alias("_id"), last("branch_id").alias("_branch"), (F.max("next_branch") + F.sum(F.col("is_fork").cast("int"))).cast("int").alias("_next"))
    cursors = history.cursors.join(moved, "tree", "full").select("tree", F.coalesce("_id", "current_id").alias("current_id"), F.coalesce("_branch", "active_branch").alias("active_branch"), F.coalesce("_next", "next_branch").alias("next_branch"))
    out = History(nodes, cut(branches), cut(cursors))
    return evicted(out, most) if most is not None else History(cut(nodes), out.branches, out.cursors)


def children_count(nodes: DataFrame) -> DataFrame:
    return nodes.where("parent_id IS NOT NULL").groupBy("tree", "parent_id").agg(F.count("*").alias("n_children"))


def place(new: DataFrame, old: DataFrame) -> DataFrame:
    """new with branch_id, where it is null, of the nearest state above that has one, and with step_index.

    Each state points to one above it; in a round it takes over what that one knows and then points where that one points,
    so the number of rounds is the logarithm of the longest chain of new states.
    """
    above = old.select("tree", F.col("id").alias("parent_id"), F.col("branch_id").alias("_branch"), F.col("step_index").alias("_step"))
    inside = new.select("tree", F.col("id").alias("parent_id"), F.lit(True).alias("_inside"))
    start = new.join(above, ["tree", "parent_id"], "left").join(inside, ["tree", "parent_id"], "left")
    steps = F.when(F.col("_inside"), 1).otherwise(F.coalesce(F.col("_step") + 1, F.lit(0)))
    branch = F.when(F.col("_inside"), F.col("branch_id")).otherwise(F.coalesce("branch_id", "_branch", F.lit(0)))
    now = cut(start.select("tree", "id", F.when(F.col("_inside"), F.col("parent_id")).alias("to"), branch.alias("branch"), steps.alias("steps")))
    while not now.where("to IS NOT NULL").isEmpty():
        on = now.select("tree", F.col("id").alias("to"), F.col("to").alias("_to"), F.col("branch").alias("_branch"), F.col("steps").alias("_steps"))
        led = now.join(on, ["tree", "to"], "left")
        now = cut(led.select("tree", "id", F.col("_to").alias("to"), F.coalesce("branch", "_branch").alias("branch"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    found = now.select("tree", "id", F.col("branch").cast("int").alias("branch_id"), F.col("steps").cast("int").alias("step_index"))
    return cut(new.drop("branch_id").join(found, ["tree", "id"]))


# ---- H2: moving


def _moved(history: History, to: DataFrame) -> History:
    """to: (tree, id, branch); a null branch leaves the active one."""
    cursors = history.cursors.join(to.select("tree", F.col("id").alias("_id"), F.col("branch").alias("_branch")), "tree", "left")
    # a move reads the cursors more than once, so each move's are written down
    return History(history.nodes, history.branches, cut(cursors.select("tree", F.coalesce("_id", "current_id").alias("current_id"), F.coalesce("_branch", "active_branch").cast("int").alias("active_branch"), "next_branch")))


def back(history: History, moves: DataFrame) -> History:
    """Undo: each tree of moves (tree, n) goes n states up, or to its first state; the active branch stays."""
    start = history.cursors.join(moves, "tree").select("tree", F.col("current_id").alias("id"), "n")
    return _moved(history, walk(start, jumps(parents(history.nodes))).withColumn("branch", F.lit(None).cast("int")))


def ahead(history: History, moves: DataFrame) -> History:
    """Redo: each tree of moves (tree, n) goes n states down, to the child on the active branch, else to the first child, whose branch becomes active."""
    start = cut(history.cursors.join(moves, "tree").select("tree", F.col("current_id").alias("id"), F.col("active_branch").alias("branch"), "n").where("n > 0"))
    first = next_states(history.nodes, start.select("tree", "id", "branch"))
    start = start.join(first, ["tree", "id"]).select("tree", F.col("to").alias("id"), (F.col("n") - 1).alias("n"))
    # behind the first child the active branch is always the state's own
    of_own = next_states(history.nodes, history.nodes.select("tree", "id", F.col("branch_id").alias("branch")))
    led = walk(start, jumps(of_own))
    return _moved(history, led.join(history.nodes.select("tree", "id", F.col("branch_id").alias("branch")), ["tree", "id"]))


def jump_to(history: History, targets: DataFrame) -> History:
    """Each tree of targets (tree, id) goes to that state and its branch; unknown states change nothing."""
    return _moved(history, targets.select("tree", "id").join(history.nodes.select("tree", "id", F.col("branch_id").alias("branch")), ["tree", "id"]))


def switch(history: History, wanted: DataFrame) -> History:
    """switchBranch: each tree of wanted (tree, branch_id) makes that branch active and goes to its leaf; it stays where it is if the leaf went."""
    found = wanted.select("tree", "branch_id").join(history.branches, ["tree", "branch_id"]).select("tree", F.col("branch_id").alias("branch"), F.col("leaf_id").alias("id"))
    there = history.nodes.select("tree", "id", F.lit(True).alias("_there"))
    return _moved(history, found.join(there, ["tree", "id"], "left").select("tree", F.when(F.col("_there"), F.col("id")).alias("id"), "branch"))


def can_move(history: History) -> DataFrame:
    """(tree, can_undo, can_redo)."""
    up, down = parents(history.nodes).select("tree", "id", F.lit(True).alias("_up")), children_count(history.nodes).select("tree", F.col("parent_id").alias("id"), F.lit(True).alias("_down"))
    at = history.cursors.select("tree", F.col("current_id").alias("id"))
    return at.join(up, ["tree", "id"], "left").join(down, ["tree", "id"], "left").select("tree", F.coalesce("_up", F.lit(False)).alias("can_undo"), F.coalesce("_down", F.lit(False)).alias("can_redo"))


# ---- H3, H4


def timeline(history: History) -> DataFrame:
    """H3: (tree, id, at): from the first state (smallest) over the current one (0) down the active branch to its leaf."""
    at = history.cursors.select("tree", F.col("current_id").alias("id"))
    active = history.nodes.select("tree", "id").join(history.cursors.select("tree", F.col("active_branch").alias("branch")), "tree")
    up, down = jumps(parents(history.nodes)), jumps(next_states(history.nodes, active))
    return path(at, up, -1).unionByName(path(at, down).where("at > 0"))


def evict(nodes: DataFrame, cursors: DataFrame | None = None, most: int = MOST_NODES) -> DataFrame:
    """H4, T5: each tree's newest states up to ``most``, the current one among them; children of states that went lose their parent.

    A tree's window is bounded by ``most`` and what was added since.
    """
    now = nodes if cursors is None else nodes.join(cursors.select("tree", "current_id"), "tree", "left")
    current = F.lit(False) if cursors is None else F.coalesce(F.col("current_id") == F.col("id"), F.lit(False))
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("_current"), F.desc("ts"), F.desc("id")))
    kept = now.withColumn("_current", current).withColumn("_rank", rank).where(F.col("_rank") <= most).select(*nodes.columns)
    there = kept.select("tree", F.col("id").alias("parent_id"), F.lit(True).alias("_there"))
    return kept.join(there, ["tree", "parent_id"], "left").select(*[F.when(F.col("_there"), F.col(c)).alias(c) if c == "parent_id" else F.col(c) for c in nodes.columns])


def evicted(history: History, most: int = MOST_NODES) -> History:
    """H4: evict, and branches of which neither the leaf nor the state where they began is left go too."""
    nodes = cut(evict(history.nodes, history.cursors, most))
    left = [nodes.select("tree", F.col("id").alias(c), F.lit(True).alias(f"_{c}")) for c in ("leaf_id", "root_id")]
    kept = reduce(lambda b, n: b.join(n, ["tree", [c for c in n.columns if c in ("leaf_id", "root_id")][0]], "left"), left, history.branches)
    return History(nodes, cut(kept.where("_leaf_id OR _root_id").select(*history.branches.columns)), history.cursors)
