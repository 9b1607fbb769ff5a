"""Edit histories of all trees: conversations stand for them, each turn a recorded state.

The SQL walks state by state with recursive queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.operators import history
from rasterloom.plans.registry import register
from rasterloom.sources.views import table

NODES = "(SELECT conv_id AS tree, conv_id * 1000 + turn AS id, CASE WHEN turn > 0 THEN conv_id * 1000 + CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END END AS parent_id, turn AS ts FROM conversations)"
#: Steps that a tree goes back, and ahead again.
UNDO, REDO = "tree % 4", "tree % 3"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").selectExpr("conv_id AS tree", "conv_id * 1000 + turn AS id", "CASE WHEN turn > 0 THEN conv_id * 1000 + CASE WHEN turn % 4 = 3 THEN turn - 2 ELSE turn - 1 END END AS parent_id", "turn AS ts")


def recorded(spark: SparkSession, d: str) -> history.History:
    states = nodes(spark, d)
    return history.append(history.opened(states), states, most=None)


def moves(h: history.History, n: str) -> DataFrame:
    return h.cursors.selectExpr("tree", f"{n} AS n")


def placed(rows: str) -> str:
    """placed: each state's branch and step, from the first states down; forks count up in a tree."""
    return f"""n AS (SELECT * FROM {rows}),
  o AS (SELECT *, parent_id IS NOT NULL AND row_number() OVER (PARTITION BY tree, parent_id ORDER BY ts, id) > 1 AS fork FROM n),
  f AS (SELECT *, sum(CAST(fork AS INTEGER)) OVER (PARTITION BY tree ORDER BY ts, id) AS number FROM o),
  placed AS (SELECT tree, id, parent_id, ts, fork, 0 AS branch_id, 0 AS step_index FROM f WHERE parent_id IS NULL
    UNION ALL SELECT f.tree, f.id, f.parent_id, f.ts, f.fork, CAST(CASE WHEN f.fork THEN f.number ELSE p.branch_id END AS INTEGER), p.step_index + 1 FROM placed p JOIN f ON f.tree = p.tree AND f.parent_id = p.id)"""


ALL = placed(NODES)
#: The last state recorded, its branch, and where going back leads.
LAST = "last_ AS (SELECT tree, arg_max(id, (ts, id)) AS id, arg_max(branch_id, (ts, id)) AS active FROM placed GROUP BY tree)"
BACK = f"""up AS (SELECT tree, id, active, 0 AS k FROM last_ UNION ALL SELECT u.tree, p.parent_id, u.active, k + 1 FROM up u JOIN placed p ON p.tree = u.tree AND p.id = u.id WHERE p.parent_id IS NOT NULL AND k < {UNDO.replace('tree', 'u.tree')}),
  at_ AS (SELECT tree, arg_max(id, k) AS id, any_value(active) AS active FROM up GROUP BY tree)"""
#: For each state and each branch of its tree the child to which going ahead leads.
PICK = "pick AS (SELECT p.tree, p.parent_id, b.branch_id AS active, arg_min(p.id, (p.branch_id <> b.branch_id, p.ts, p.id)) AS id, arg_min(p.branch_id, (p.branch_id <> b.branch_id, p.ts, p.id)) AS branch_id FROM placed p JOIN (SELECT DISTINCT tree, branch_id FROM placed) b USING (tree) WHERE p.parent_id IS NOT NULL GROUP BY ALL)"


@register("h01_forks", f"SELECT id, parent_id IS NOT NULL AND row_number() OVER (PARTITION BY tree, parent_id ORDER BY ts, id) > 1 AS is_fork FROM {NODES}")
def h01_forks(spark: SparkSession, d: str) -> DataFrame:
    return history.forks(nodes(spark, d)).select("id", "is_fork")


@register("h01_branches", f"WITH RECURSIVE {ALL} SELECT tree, id, parent_id, branch_id, step_index FROM placed")
def h01_branches(spark: SparkSession, d: str) -> DataFrame:
    """All states recorded under their parents: branch numbers and steps."""
    return recorded(spark, d).nodes.select("tree", "id", "parent_id", "branch_id", "step_index")


#: States 0 to 3 of each tree are recorded, the tree goes back, and the others are recorded from there.
FIRST = placed(f"(SELECT * FROM {NODES} WHERE ts < 4)")
LATER = f"""later AS (SELECT n.tree, n.id, n.ts, a.id AS at_id, a.active, s.step_index, row_number() OVER (PARTITION BY n.tree ORDER BY n.ts, n.id) AS p, lag(n.id) OVER (PARTITION BY n.tree ORDER BY n.ts, n.id) AS before_,
    EXISTS (SELECT 1 FROM placed c WHERE c.tree = n.tree AND c.parent_id = a.id) AS fork, (SELECT count(*) FROM placed c WHERE c.tree = n.tree AND c.fork) AS n_forks
  FROM {NODES} n JOIN at_ a USING (tree) JOIN placed s ON s.tree = n.tree AND s.id = a.id WHERE n.ts >= 4),
  both_ AS (SELECT tree, id, parent_id, ts, branch_id, step_index FROM placed
    UNION ALL SELECT tree, id, coalesce(before_, at_id), ts, CAST(CASE WHEN fork THEN n_forks + 1 ELSE active END AS INTEGER), step_index + p FROM later)"""


def continued(spark: SparkSession, d: str, most: int | None) -> history.History:
    states = nodes(spark, d)
    h = history.append(history.opened(states), states.where("ts < 4"), most=None)
    return history.append(history.back(h, moves(h, UNDO)), states.where("ts >= 4").drop("parent_id"), most=most)


@register("h01_append", f"WITH RECURSIVE {FIRST}, {LAST}, {BACK}, {LATER} SELECT tree, id, parent_id, branch_id, CAST(step_index AS INTEGER) AS step_index FROM both_")
def h01_append(spark: SparkSession, d: str) -> DataFrame:
    """States recorded after going back begin branches."""
    return continued(spark, d, None).nodes.select("tree", "id", "parent_id", "branch_id", "step_index")


@register("h02_undo", f"WITH RECURSIVE {ALL}, {LAST}, {BACK} SELECT tree, id AS current_id, active AS active_branch FROM at_")
def h02_undo(spark: SparkSession, d: str) -> DataFrame:
    h = recorded(spark, d)
    return history.back(h, moves(h, UNDO)).cursors.select("tree", "current_id", "active_branch")


@register("h02_redo", f"WITH RECURSIVE {ALL}, {LAST}, {BACK}, {PICK}, down AS (SELECT tree, id, active, 0 AS k FROM at_ UNION ALL SELECT d.tree, p.id, p.branch_id, k + 1 FROM down d JOIN pick p ON p.tree = d.tree AND p.parent_id = d.id AND p.active = d.active WHERE k < {REDO.replace('tree', 'd.tree')}) SELECT tree, arg_max(id, k) AS current_id, arg_max(active, k) AS active_branch FROM down GROUP BY tree")
def h02_redo(spark: SparkSession, d: str) -> DataFrame:
    """Back and ahead again: the child on the active branch, else the first one, whose branch becomes active."""
    h = recorded(spark, d)
    h = history.back(h, moves(h, UNDO))
    return history.ahead(h, moves(h, REDO)).cursors.select("tree", "current_id", "active_branch")


@register("h02_switch", f"WITH RECURSIVE {ALL}, {LAST}, leaf AS (SELECT tree, branch_id, arg_max(id, (ts, id)) AS id FROM placed GROUP BY tree, branch_id) SELECT l.tree, coalesce(leaf.id, l.id) AS current_id, coalesce(leaf.branch_id, l.active) AS active_branch FROM last_ l LEFT JOIN leaf ON leaf.tree = l.tree AND leaf.branch_id = l.tree % 3")
def h02_switch(spark: SparkSession, d: str) -> DataFrame:
    h = recorded(spark, d)
    return history.switch(h, h.cursors.selectExpr("tree", "CAST(tree % 3 AS INT) AS branch_id")).cursors.select("tree", "current_id", "active_branch")


@register("h02_can_move", f"WITH RECURSIVE {ALL}, {LAST}, {BACK} SELECT a.tree, p.parent_id IS NOT NULL AS can_undo, EXISTS (SELECT 1 FROM placed c WHERE c.tree = a.tree AND c.parent_id = a.id) AS can_redo FROM at_ a JOIN placed p ON p.tree = a.tree AND p.id = a.id")
def h02_can_move(spark: SparkSession, d: str) -> DataFrame:
    h = recorded(spark, d)
    return history.can_move(history.back(h, moves(h, UNDO)))


@register("h02_ancestors", f"WITH RECURSIVE {ALL}, {LAST}, anc AS (SELECT tree, id, 0 AS back FROM last_ UNION ALL SELECT a.tree, p.parent_id, back + 1 FROM anc a JOIN placed p ON p.tree = a.tree AND p.id = a.id WHERE p.parent_id IS NOT NULL) SELECT * FROM anc")
def h02_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """All states that going back from the last one of each tree passes."""
    n = nodes(spark, d)
    last = n.groupBy("tree").agg(F.max_by("id", F.struct("ts", "id")).alias("id"))
    return history.path(last, history.jumps(history.parents(n))).withColumnRenamed("at", "back")


@register("h03_timeline", f"""WITH RECURSIVE {ALL}, {LAST}, {BACK}, {PICK},
  anc AS (SELECT tree, id, 0 AS at FROM at_ UNION ALL SELECT a.tree, p.parent_id, a.at - 1 FROM anc a JOIN placed p ON p.tree = a.tree AND p.id = a.id WHERE p.parent_id IS NOT NULL),
  down AS (SELECT tree, id, active, 0 AS at FROM at_ UNION ALL SELECT d.tree, p.id, d.active, d.at + 1 FROM down d JOIN pick p ON p.tree = d.tree AND p.parent_id = d.id AND p.active = d.active)
  SELECT * FROM anc UNION ALL SELECT tree, id, down.at FROM down WHERE down.at > 0""")
def h03_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Every tree's line of states from the first over the current one to the active branch's leaf."""
    h = recorded(spark, d)
    return history.timeline(history.back(h, moves(h, UNDO)))


@register("h04_evict", f"WITH k AS (SELECT * FROM {NODES} QUALIFY row_number() OVER (PARTITION BY tree ORDER BY ts DESC, id DESC) <= 4) SELECT k.id, p.id AS parent_id FROM k LEFT JOIN k p ON p.tree = k.tree AND p.id = k.parent_id")
def h04_evict(spark: SparkSession, d: str) -> DataFrame:
    return history.evict(nodes(spark, d), most=4).select("id", "parent_id")


_CONTINUED = f"WITH RECURSIVE {FIRST}, {LAST}, {BACK}, {LATER}, now_ AS (SELECT tree, coalesce((SELECT max(l.id) FROM later l WHERE l.tree = a.tree), a.id) AS now_id FROM at_ a), kept AS (SELECT * FROM both_ JOIN now_ USING (tree) QUALIFY row_number() OVER (PARTITION BY tree ORDER BY id = now_id DESC, ts DESC, id DESC) <= 3)"


@register("h04_branches", f"""{_CONTINUED}, born AS (SELECT b.*, b.parent_id IS NOT NULL AND b.branch_id <> coalesce(p.branch_id, -1) AS began FROM both_ b LEFT JOIN both_ p ON p.tree = b.tree AND p.id = b.parent_id),
  branch AS (SELECT tree, branch_id, arg_max(id, (ts, id)) AS leaf_id, arg_min(CASE WHEN began THEN parent_id ELSE id END, (ts, id)) AS root_id FROM born GROUP BY tree, branch_id)
  SELECT tree, branch_id, root_id, leaf_id FROM branch b WHERE EXISTS (SELECT 1 FROM kept k WHERE k.tree = b.tree AND k.id IN (b.leaf_id, b.root_id))""")
def h04_branches(spark: SparkSession, d: str) -> DataFrame:
    """Branches that are left when only three states of each tree are kept while it is recorded."""
    return continued(spark, d, 3).branches


@register("h04_append_evict", f"{_CONTINUED} SELECT k.tree, k.id, p.id AS parent_id, k.branch_id FROM kept k LEFT JOIN kept p ON p.tree = k.tree AND p.id = k.parent_id")
def h04_append_evict(spark: SparkSession, d: str) -> DataFrame:
    return continued(spark, d, 3).nodes.select("tree", "id", "parent_id", "branch_id")


@register("j13_children", f"SELECT parent_id AS id, id AS child_id FROM {NODES} WHERE parent_id IS NOT NULL")
def j13_children(spark: SparkSession, d: str) -> DataFrame:
    return history.children(nodes(spark, d))
