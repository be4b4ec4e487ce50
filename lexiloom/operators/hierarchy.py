"""Parent-child links turned into full hierarchies by tree contraction.

Forward, each round takes off two kinds of nodes, until nothing but roots and rings is left:

* *rake*: every node without children is taken off and recorded with its link;
* *compress*: on unary chains an independent set of nodes (a hash's coin shows 1 for the
  node and 0 for its parent) is spliced out; the child's link then leads past them and
  remembers them.

A round takes off a constant share of what is left, so the number of rounds is
logarithmic in the nodes, also for one long chain.  A ring never ends by raking; its
chain compresses to one node that is its own parent: the core that exposes the cycle.
At most ``FINISH`` nodes that are left are finished in one pass of one task.
Backward, the records are replayed: each node's base (root or ring entry), depth and
path follow from those of the node its recorded link leads to.

Each round is one written table, so plans stay small and survive lost executors.

Defined results: ids and parents are compared trimmed and in lower case; null or
blank ids are left out; per id only the row loaded last holds (ties: the greater
``tie`` column); a parent that is null, blank or unknown ends the path; a node on a
ring has no root and no depth.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.unicode import trim_blank
from lexiloom.session import Scratch

#: Nodes that still have a parent from which on one task finishes.
FINISH = 4_096
#: Members of a ring, and nodes that hang on it, that one task pairs.
RING_CELL = 1_000

_LINK = "v string, p string, w int, via array<string>"


def latest_rows(df: DataFrame, id_col: str, parent_col: str, order_col: str, tie_col: str, label_col: str | None = None) -> DataFrame:
    """(v, p, label): cleaned ids with the parent and label of the row loaded last."""
    clean: Column = F.lower(trim_blank(F.col(id_col)))
    parent: Column = F.lower(trim_blank(F.col(parent_col)))
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    order = F.struct(F.col(order_col).isNotNull(), F.col(order_col), F.col(tie_col))
    return (
        df.select(clean.alias("v"), F.struct(F.nullif(parent, F.lit("")).alias("p"), label.alias("label")).alias("row"), order.alias("at"))
        .where(F.col("v").isNotNull() & (F.col("v") != ""))
        .groupBy("v")
        .agg(F.max_by("row", "at").alias("row"))
        .select("v", "row.p", "row.label")
    )


def contract(links: DataFrame, scratch: Scratch) -> dict:
    """Contract the forest of ``links`` (v, p); returns the written parts for ``expand``."""
    known = links.select(F.col("v").alias("_known"))
    more = "kept and p is not null and p <> v"
    start = links.join(known, F.col("p") == F.col("_known"), "left").select(
        "v", F.col("_known").alias("p"), F.lit(1).alias("w"), F.expr("cast(array() as array<string>)").alias("via"), F.lit(True).alias("kept")
    )
    out, left = scratch.write_counted(start, "active0", more)
    records: list[str] = []
    while left:
        active = out.where("kept").drop("kept")
        step = _finish(active) if left <= FINISH else _round(active, len(records))
        records.append(f"round{len(records) + 1}")
        out, left = scratch.write_counted(step, records[-1], more)
    return {"core": out.where("kept").drop("kept"), "records": records}


def _coin(v: str, turn: int) -> Column:
    return F.xxhash64(F.col(v), F.lit(turn)) % 2 != 0


def _round(active: DataFrame, turn: int) -> DataFrame:
    """One rake and one compression; what is taken off has ``kept`` false and keeps its link to a node that stays."""
    kids = active.where("p is not null").groupBy(F.col("p").alias("_v")).agg(F.count("*").alias("n"))
    has_parent = F.col("p").isNotNull() & (F.col("p") != F.col("v"))
    state = active.join(kids, F.col("v") == F.col("_v"), "left").select(
        "v", "p", "w", "via",
        (F.col("n").isNull() & has_parent).alias("leaf"),
        F.coalesce((F.col("n") == 1) & has_parent & _coin("v", turn) & ~_coin("p", turn), F.lit(False)).alias("gone"),
    )
    past = state.where("gone").select(F.col("v").alias("s"), F.col("p").alias("s_p"), F.col("w").alias("s_w"), F.col("via").alias("s_via"))
    # a node is never spliced together with its parent, so links lead past one node at most
    led = F.col("s").isNotNull()
    return state.join(past, F.col("p") == F.col("s"), "left").select(
        "v",
        F.coalesce("s_p", "p").alias("p"),
        F.when(led, F.col("w") + F.col("s_w")).otherwise(F.col("w")).alias("w"),
        F.when(led, F.concat("via", F.array("s"), "s_via")).otherwise(F.col("via")).alias("via"),
        (~F.col("leaf") & ~F.col("gone")).alias("kept"),
    )


def _finish(active: DataFrame) -> DataFrame:
    """The last nodes in one task: every link leads to a node that has none, or around its ring.

    A ring gives one core, its own parent, and drops its other members, as contraction does.
    """
    rest = active.where("p is null or p = v").withColumn("kept", F.lit(True))
    few = active.where("p is not null and p <> v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        link = {r["v"]: (r["p"], r["w"], r["via"]) for r in rows}
        done: dict[str, tuple[str, int, list[str]]] = {}  # node: where its way ends, how far, what lies between
        cores: list[dict] = []
        for first in link:
            way, seen, at = [], set(), first
            while at in link and at not in done and at not in seen:
                seen.add(at)
                way.append(at)
                at = link[at][0]
            if at in seen:  # a ring, entered at ``at``
                ring = way[way.index(at) :]
                between = [x for m in ring for x in (m, *link[m][2])]
                cores.append({"v": at, "p": at, "w": sum(link[m][1] for m in ring), "via": between[1:], "kept": True})
                done.update({m: (m, 0, []) for m in ring})
                way = way[: len(way) - len(ring)]
            for v in reversed(way):
                p, w, via = link[v]
                if p in done and done[p][1]:
                    end, far, between = done[p]
                    done[v] = (end, w + far, [*via, p, *between])
                else:
                    done[v] = (p, w, list(via))
        out = cores + [{"v": v, "p": p, "w": w, "via": via, "kept": False} for v, (p, w, via) in done.items() if w]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("v", pa.string()), ("p", pa.string()), ("w", pa.int32()), ("via", pa.list_(pa.string())), ("kept", pa.bool_())]))

    return few.coalesce(1).mapInArrow(run, _LINK + ", kept boolean").unionByName(rest)


def expand(parts: dict, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Replay the contractions.  Returns nodes (v, base, on_ring, depth, path) and rings (ring, pos, v, n).

    ``path`` leads from the base to the node; ``depth`` counts its steps.  A ring's n members
    stand in such order that each one's parent is the next, the last one's the first.
    """
    core = parts["core"]
    members = core.where("p = v").select(F.col("v").alias("ring"), F.concat(F.array("v"), "via").alias("members"))
    rings = scratch.write(members.select("ring", F.size("members").alias("n"), F.posexplode("members").alias("pos", "v")), "rings")
    start = core.where("p is null").select("v", F.lit(False).alias("on_ring")).unionByName(rings.select("v", F.lit(True).alias("on_ring")))
    scratch.write(start.select("v", F.col("v").alias("base"), "on_ring", F.lit(0).alias("depth"), F.array("v").alias("path")), "info0")
    done = ["info0"]
    for k, name in enumerate(reversed(parts["records"]), 1):
        taken = scratch.read([name]).where("not kept").select("v", "p", "w", "via")
        taken = taken.join(rings.select(F.col("v").alias("_r")), F.col("v") == F.col("_r"), "left_anti")
        info = scratch.read(done).select(F.col("v").alias("_p"), "base", "on_ring", "depth", "path")
        more = taken.join(info, F.col("p") == F.col("_p")).select(
            "v",
            "base",
            "on_ring",
            (F.col("depth") + F.col("w")).alias("depth"),
            F.concat("path", F.reverse("via"), F.array("v")).alias("path"),
        )
        scratch.write(more, f"info{k}")
        done.append(f"info{k}")
        scratch.drop(name)
    return scratch.read(done), rings


def hierarchy(df: DataFrame, id_col: str = "id", parent_col: str = "parent", order_col: str = "loaded_at", tie_col: str = "row_id", label_col: str | None = "dialect_group") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Latest links, and the nodes and rings of their hierarchy."""
    scratch = Scratch(df.sparkSession, "hierarchy")
    links = scratch.write(latest_rows(df, id_col, parent_col, order_col, tie_col, label_col), "links")
    nodes, rings = expand(contract(links, scratch), scratch)
    return links, nodes, rings


def ancestor_pairs(nodes: DataFrame, rings: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, steps): each ancestor reached, with the fewest steps."""
    tree = nodes.where("depth > 0").select(F.col("v"), "depth", F.posexplode(F.slice("path", F.lit(1), F.col("depth"))))
    up = tree.select(F.col("col").alias("ancestor_id"), F.col("v").alias("descendant_id"), (F.col("depth") - F.col("pos")).cast("int").alias("steps"))
    # a node's entry into its ring is its base
    entry = rings.select(F.col("v").alias("base"), "ring", "n", F.col("pos").alias("entry"))
    hung = nodes.where("on_ring").select("v", "base", "depth").join(entry, "base")
    # members and hung nodes meet in cells of bounded size
    cells = hung.groupBy("ring").agg(F.ceil(F.count("*") / RING_CELL).cast("int").alias("rows"), F.ceil(F.max("n") / RING_CELL).cast("int").alias("columns"))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    a = hung.join(cells, "ring").select("ring", "v", "depth", "n", "entry", F.pmod(F.xxhash64("v"), F.col("rows")).cast("int").alias("i"), every("columns").alias("j"))
    b = rings.join(cells, "ring").select("ring", F.col("v").alias("m"), "pos", (F.col("pos") % F.col("columns")).alias("j"), every("rows").alias("i"))
    # the entry itself is its own ancestor only for nodes on the ring; others have it in their path
    on = F.col("depth") == 0
    ahead = F.pmod(F.col("pos") - F.col("entry"), F.col("n"))
    around = a.join(b, ["ring", "i", "j"]).where(on | (F.col("pos") != F.col("entry")))
    around = around.select(
        F.col("m").alias("ancestor_id"),
        F.col("v").alias("descendant_id"),
        F.when(on & (ahead == 0), F.col("n")).otherwise(F.col("depth") + ahead).cast("int").alias("steps"),
    )
    return up.unionByName(around)


def described(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row per node: root, depth, path as text, the ring it hangs on, its label and its root's."""
    label = links.select(F.col("v").alias("_l"), "label")
    root_label = links.select(F.col("v").alias("_b"), F.col("label").alias("root_label"))
    out = nodes.join(label, F.col("v") == F.col("_l"), "left").join(root_label, F.col("base") == F.col("_b"), "left")
    on_ring = F.col("on_ring") & (F.col("depth") == 0)
    return out.select(
        F.col("v").alias("id"),
        F.when(~F.col("on_ring"), F.col("base")).alias("root"),
        F.when(~F.col("on_ring"), F.col("depth")).alias("depth"),
        F.array_join("path", "/").alias("path"),
        on_ring.alias("on_cycle"),
        F.when(F.col("on_ring"), F.col("base")).alias("cycle_entry"),
        "label",
        F.when(~F.col("on_ring"), F.col("root_label")).alias("root_label"),
    )
