"""Splits that keep related records together (p5).

Files and the papyri their records name form a bipartite graph.  Its distinct edges are
far fewer than the records and are built with map-side combining, so a file or papyrus
with a third of all records is one node with few edges.  Minimum labels are propagated
from files to papyri and back, with one pointer jump a round and the old label's own file
hooked to the new one, so that long chains need few rounds; each round's labels are one written table, earlier ones are dropped.

Whole components are then assigned to splits, stratified by label: components above a
size threshold one by one, the rest in hashed buckets per leading label, always to the
split where the labels' distribution comes closest to its share.  The number of such
units is bounded by parameters, whatever the data's size; on small data each component
is a unit of its own.

Defined results: files are the same if their paths agree in letters and digits, case
ignored; every whole number above zero in a papyrus text names one; a record without
papyri is tied by its file alone; records with a null file and no papyrus form one
component each.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions.unicode import letters_digits_key
from lexiloom.session import Scratch

#: A component is assigned by itself from this share of all records on.
BIG_SHARE = 1 / 1000
#: Units of the other components, over all labels.
UNITS = 1 << 16
#: Labels beyond this many most frequent ones are balanced in as many groups as RARE, by a hash.
MAX_LABELS, RARE = 1_000, 24
#: Rows of one split of one component that one task pairs with as many of another.
PAIRED_ROWS = 1_000


def papyri(text: Column) -> Column:
    """The whole numbers above zero in a text, without leading zeros."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: F.regexp_replace(x, "^0+", ""))
    return F.array_distinct(F.filter(numbers, lambda x: x != ""))


def file_key(file_col: str, entity_col: str | None = None) -> Column:
    """Canonical file; without a file, records with the same entity text stand together in its place."""
    key = letters_digits_key(file_col)
    return F.coalesce(key, F.concat(F.lit("\x01"), F.col(entity_col))) if entity_col else key


def edges(records: DataFrame, file_col: str = "source_file", entity_col: str = "tm_id") -> DataFrame:
    """Distinct (f, e): canonical file and an entity it is tied to; files without any are left out."""
    pairs = records.select(F.col(file_col).alias("_f"), F.col(entity_col).alias("_e")).distinct()
    return pairs.select(file_key("_f", "_e").alias("f"), F.explode(papyri(F.col("_e"))).alias("e")).where("f is not null").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(f, label): minimum-label propagation over the bipartite links (f, e).

    In a round each file takes the least label of its label and of its neighbours' labels,
    and so does the file its old label names: whole groups move at once, and the number of
    rounds stays logarithmic also for long chains in any order.
    """
    links = scratch.write(links, "links")
    # an entity of one file ties nothing
    shared = links.groupBy("e").agg(F.count("*").alias("n")).where("n > 1").select("e")
    ties = scratch.write(links.join(shared, "e", "left_semi"), "ties")
    files = ties.select("f").distinct().select("f", F.monotonically_increasing_id().alias("id"))
    files = scratch.write(files, "files")
    ties = scratch.write(ties.join(files, "f").select("id", "e"), "numbered")
    name, turn = "labels0", 0
    labels, moved = scratch.write_counted(files.select("id", F.col("id").alias("label"), F.lit(True).alias("moved")), name, "moved")
    while moved:
        turn += 1
        # a label is a file's id, so its own label leads further
        jump = labels.select(F.col("id").alias("_j"), F.col("label").alias("far"))
        far = labels.select("id", "label").join(jump, F.col("label") == F.col("_j")).select("id", "label", "far")
        up = ties.join(far.select("id", "far"), "id").groupBy("e").agg(F.min("far").alias("far"))
        low = ties.join(up, "e").groupBy("id").agg(F.min("far").alias("low"))
        # every file has a tie, so none is lost
        state = far.join(low, "id")
        hooks = state.groupBy(F.col("label").alias("_h")).agg(F.min("low").alias("hook"))
        best = F.least("far", "low", F.coalesce("hook", "low"))
        new = state.join(hooks, F.col("id") == F.col("_h"), "left").select("id", best.alias("label"), (best < F.col("label")).alias("moved"))
        labels, moved = scratch.write_counted(new, f"labels{turn}", "moved")
        scratch.drop(name)
        name = f"labels{turn}"
    return files.join(labels.select("id", "label"), "id").select("f", "label")


def component_of(rows: DataFrame, comps: DataFrame, file_col: str, entity_col: str | None = None) -> DataFrame:
    """``rows`` with ``component``; a file without shared entities is a component of its own, no file and entity give null."""
    keyed = rows.withColumn("_f", file_key(file_col, entity_col))
    joined = keyed.join(comps.select(F.col("f").alias("_c"), F.col("label").alias("_low")), F.col("_f") == F.col("_c"), "left")
    own = F.coalesce(F.concat(F.lit("c"), F.col("_low").cast("string")), F.concat(F.lit("f"), F.col("_f")))
    return joined.withColumn("component", own).drop("_c", "_f", "_low")


def split_rows(results: DataFrame, comps: DataFrame, id_col: str, file_col: str, split_col: str) -> DataFrame:
    """(id, split, component) of the rows whose component has more than one split."""
    split = F.lower(F.trim(split_col))
    rows = component_of(results.select(F.col(id_col).alias("id"), F.col(file_col).alias("_file"), split.alias("split")).where("split is not null"), comps, "_file")
    rows = rows.where("component is not null").select("id", "split", "component")
    mixed = rows.groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("component")
    return rows.join(mixed, "component", "left_semi")


def conflicts(rows: DataFrame) -> DataFrame:
    """The linear form of the ties: per component of ``split_rows``, named by its smallest id, and split the rows."""
    by_split = rows.groupBy("component", "split").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    names = by_split.groupBy("component").agg(F.min("low").alias("first_id"))
    return by_split.join(names, "component").select("first_id", "split", "n")


def tied_pairs(rows: DataFrame) -> DataFrame:
    """(a, b): pairs of ``split_rows`` of one component with unlike splits, the smaller id first.

    Only unlike splits meet, in cells of at most ``PAIRED_ROWS`` rows of each.
    """
    parts = rows.groupBy("component", "split").agg(F.ceil(F.count("*") / PAIRED_ROWS).cast("int").alias("n"))
    left = parts.select("component", F.col("split").alias("split_a"), F.col("n").alias("n_a"))
    right = parts.select("component", F.col("split").alias("split_b"), F.col("n").alias("n_b"))
    cells = left.join(right, "component").where("split_a < split_b")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    key = ["component", "split_a", "split_b"]
    a = rows.withColumnRenamed("split", "split_a").join(cells, ["component", "split_a"]).select(*key, F.col("id").alias("a"), own("n_a").alias("i"), every("n_b").alias("j"))
    b = rows.withColumnRenamed("split", "split_b").join(cells, ["component", "split_b"]).select(*key, F.col("id").alias("b"), own("n_b").alias("j"), every("n_a").alias("i"))
    return a.join(b, [*key, "i", "j"]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def tied_across_splits(results: DataFrame, comps: DataFrame, id_col: str, file_col: str, split_col: str, scratch: Scratch) -> DataFrame:
    """Pairs of rows of one component with different splits, the smaller id first."""
    return tied_pairs(scratch.write(split_rows(results, comps, id_col, file_col, split_col), "mixed"))


def _assign(units: list, targets: dict[str, float]) -> dict:
    """Greedy: larger units first, each to the split where the squared deviation grows least."""
    names = list(targets)
    share = np.array([targets[n] for n in names])
    labels = sorted({x for _, hist in units for x in hist})
    place = {x: i for i, x in enumerate(labels)}
    # the whole size counts as one more label
    cells = [(np.array([*(place[x] for x in hist), len(labels)]), np.array([*hist.values(), sum(hist.values())], float)) for _, hist in units]
    whole = np.zeros(len(labels) + 1)
    for at, n in cells:
        whole[at] += n
    want = share[:, None] * whole
    have = np.zeros_like(want)
    scale = 1 / np.maximum(want, 1)
    out = {}
    for i in sorted(range(len(units)), key=lambda i: (-cells[i][1][-1], str(units[i][0]))):
        at, n = cells[i]
        off = have[:, at] - want[:, at]
        k = int(np.argmin((((off + n) ** 2 - off**2) * scale[:, at]).sum(1)))
        have[k, at] += n
        out[units[i][0]] = names[k]
    return out


def assign_splits(sized: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(component, split) from (component, label, n): shares of ``targets`` kept overall and by label.

    What reaches the driver is bounded: at most 1 / BIG_SHARE big components and UNITS
    of others, with the labels they hold.
    """
    spark = sized.sparkSession
    tops = [r["label"] for r in sized.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()]
    buckets = max(1, UNITS // (min(len(tops), MAX_LABELS) + RARE))
    rare = F.concat(F.lit("rare#"), F.pmod(F.xxhash64("label"), F.lit(RARE)).cast("string"))
    label = F.when(F.col("label").isNull(), "").when(F.col("label").isin(tops), F.concat(F.lit("="), "label")).otherwise(rare)
    sized = sized.withColumn("label", label).groupBy("component", "label").agg(F.sum("n").alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    whole = sized.groupBy("component").agg(F.sum("n").alias("size"), F.max_by("label", F.struct("n", "label")).alias("lead"))
    bucket = F.concat_ws("#", "lead", F.pmod(F.xxhash64("component"), F.lit(buckets)).cast("string"))
    unit = F.when(F.col("size") >= max(1, total * BIG_SHARE), F.concat(F.lit("big#"), "component")).otherwise(bucket)
    placed = whole.select("component", unit.alias("unit"))
    hist: dict[str, dict] = {}
    for r in placed.join(sized, "component").groupBy("unit", "label").agg(F.sum("n").alias("n")).collect():
        hist.setdefault(r["unit"], {})[r["label"]] = r["n"]
    chosen = _assign(list(hist.items()), targets)
    table = spark.createDataFrame(list(chosen.items()), "unit string, split string")
    return placed.join(F.broadcast(table), "unit").select("component", "split")
