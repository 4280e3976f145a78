"""Merkle manifest of a dataset: a subtree for each source, a tree over their roots, and a proof for each row.

A leaf is the digest of a row's columns. Leaves are sorted by (source, doc_id) into range partitions and written with their partition's
number. A small table of counts by (partition, source) then gives each partition the place of its first leaf in its source, so each
builds all complete aligned subtrees of its own leaves. What is left over at its borders, a few nodes a level, goes on by coordinate
(source, level, index) to a table where ``FAN`` partitions make one, and the same step is repeated there until each source has its root.
The roots are the leaves of the upper tree, which is made the same way. Proofs come down again through the same tables: a task gets the
proofs of its uppermost nodes, rebuilds what lies below and hands them on. No task holds more than the leaves of one partition.

Rows without doc_id come first in their source, rows of one doc_id stand by their leaf's digest, and equal rows are leaves of their own.
A null source is a source of its own and comes first. An empty table has no root and no rows. Columns besides those hashed are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evigraph.plans.scratch import drop, materialize

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY = 3
#: Leaves of a partition, about.
SPAN = 1 << 16
#: Partitions that become one from one table of border nodes to the next.
FAN = 64
#: A table of counts up to this many rows is broadcast (about 40 bytes each).
MAX_BROADCAST_RUNS = 1 << 19

Levels = dict[int, dict[int, str]]
_STEPS = "array<struct<before:string,after:string>>"
_NODE = "part long, grp string, level int, idx long, total long, digest string, below long, done boolean"


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def leaf_digest(text: Column | None = None) -> Column:
    """SHA-256 of a row: each column as ``-`` if null, else its number of bytes, ``:`` and its value; ``text`` takes the text's place."""

    def field(name: str) -> Column:
        c = (F.col("text") if text is None else text) if name == "text" else F.col(name)
        c = c.cast("string")
        return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))

    return F.sha2(F.concat(*map(field, COLUMNS)), 256)


def group_key(source: Column) -> Column:
    """A key without nulls in the order of sources: null first, then by bytes."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string")))


def grow(levels: Levels, total: int) -> list[tuple[int, int]]:
    """Add all nodes to ``levels`` whose children are there; (level, index) of the nodes that have no parent there, the root included."""
    tops, n, level = [], total, 0
    while n > 1:
        own, above = levels.get(level, {}), levels.setdefault(level + 1, {})
        for j in {i // ARITY for i in own}:
            run = range(ARITY * j, min(ARITY * j + ARITY, n))
            if all(k in own for k in run):
                above[j] = joined([own[k] for k in run])
            else:
                tops += [(level, k) for k in run if k in own]
        n, level = -(-n // ARITY), level + 1
    return tops + [(level, i) for i in levels.get(level, {})]


def depth(total: int) -> int:
    level = 0
    while total > 1:
        total, level = -(-total // ARITY), level + 1
    return level


def step(levels: Levels, level: int, i: int) -> tuple[str, str]:
    """The digests before and behind a node among its parent's children."""
    own, first = levels[level], i // ARITY * ARITY
    return "".join(own[k] for k in range(first, i)), "".join(own[k] for k in range(i + 1, first + ARITY) if k in own)


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    for before, after in steps:
        leaf = joined([before, leaf, after])
    return leaf


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """The rows of each (part, grp), which come one behind another."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if (row["part"], row["grp"]) != key:
                if rows:
                    yield key, rows
                key, rows = (row["part"], row["grp"]), []
            rows.append(row)
    if rows:
        yield key, rows


def _by_part(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(max(1, parts), "part").sortWithinPartitions("part", "grp")


def _table(rows: list[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 10_000):
        yield pa.RecordBatch.from_pylist(rows[at : at + 10_000], schema)


_NODE_ARROW = pa.schema([("part", pa.int64()), ("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("total", pa.int64()), ("digest", pa.string()), ("below", pa.int64()), ("done", pa.bool_())])


def _climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a part in, those without a parent there out; ``done`` marks a group's root."""
    for (part, grp), rows in _runs(batches):
        levels: Levels = {}
        for r in rows:
            levels.setdefault(r["level"], {})[r["idx"]] = r["digest"]
        total = rows[0]["total"]
        end = depth(total)
        yield from _table([{"part": part // FAN, "grp": grp, "level": level, "idx": i, "total": total, "digest": levels[level][i], "below": part, "done": level == end} for level, i in grow(levels, total)], _NODE_ARROW)


def _local(rows: list[dict]) -> tuple[Levels, dict[tuple[int, int], tuple[list, str]], list[dict]]:
    """All nodes of a part's group, proofs and subroot of its uppermost ones, and the rows that ask for a proof."""
    levels: Levels = {}
    tops, asking = {}, []
    for r in rows:
        if r["steps"] is not None:
            tops[r["level"], r["idx"]] = [(s["before"], s["after"]) for s in r["steps"]], r["subroot"]
        else:
            levels.setdefault(r["level"], {})[r["idx"]] = r["digest"]
            asking.append(r)
    if asking:
        grow(levels, asking[0]["total"])
    return levels, tops, asking


def _path(levels: Levels, tops: dict, level: int, i: int) -> tuple[list[tuple[str, str]], str]:
    steps = []
    while (level, i) not in tops:
        steps.append(step(levels, level, i))
        level, i = level + 1, i // ARITY
    above, subroot = tops[level, i]
    return steps + above, subroot


_PATH = f"part long, grp string, level int, idx long, steps {_STEPS}, subroot string"
_STEPS_ARROW = pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())]))
_PATH_ARROW = pa.schema([("part", pa.int64()), ("grp", pa.string()), ("level", pa.int32()), ("idx", pa.int64()), ("steps", _STEPS_ARROW), ("subroot", pa.string())])


def _descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proofs of the nodes of one table, each for the part it came from."""
    for (_, grp), rows in _runs(batches):
        levels, tops, asking = _local(rows)
        out = []
        for r in asking:
            steps, subroot = _path(levels, tops, r["level"], r["idx"])
            out.append({"part": r["below"], "grp": grp, "level": r["level"], "idx": r["idx"], "steps": [{"before": a, "after": b} for a, b in steps], "subroot": subroot})
        yield from _table(out, _PATH_ARROW)


def ranked(leaves: DataFrame) -> tuple[DataFrame, int]:
    """(part, grp, level, idx, total, digest and all further columns) of each leaf, and the number of parts.

    ``leaves`` has grp, sort_key, digest, tie; a group's leaves stand by sort_key (null first), digest, tie.
    """
    spark = leaves.sparkSession
    kept = materialize(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-kept.count() // SPAN))
    order = ["grp", F.col("sort_key").asc_nulls_first(), "digest", "tie"]
    placed = kept.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("row")).drop("tie")
    placed = materialize(placed, "placed")
    drop(kept)
    runs = placed.groupBy("part", "grp").agg(F.count("*").alias("n"), F.min("row").alias("first_row"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = materialize(runs.select("part", "grp", (before - F.col("first_row")).alias("shift"), F.sum("n").over(group).alias("total")), "runs")
    few = F.broadcast(runs) if runs.count() <= MAX_BROADCAST_RUNS else runs
    out = placed.join(few, ["part", "grp"]).withColumn("idx", F.col("row") + F.col("shift")).withColumn("level", F.lit(0)).drop("row", "shift")
    most = placed.agg(F.max("part")).first()[0]
    return out, 0 if most is None else most + 1


def climb(leaves: DataFrame, parts: int) -> tuple[list[DataFrame], DataFrame | None]:
    """The tables of border nodes, from the leaves up to the last, and the roots (grp, digest, ...)."""
    tables, roots, nodes = [], None, leaves.select("part", "grp", "level", "idx", "total", "digest")
    while parts:
        made = materialize(_by_part(nodes, parts).mapInArrow(_climb, _NODE), "nodes")
        tables.append(made)
        ends = made.where("done")
        roots = ends if roots is None else roots.unionByName(ends)
        nodes = made.where(~F.col("done"))
        parts = 0 if nodes.isEmpty() else -(-parts // FAN)
    return tables, roots


def descend(tables: list[DataFrame], parts: int, above: DataFrame) -> DataFrame:
    """Proofs (part, grp, level, idx, steps, subroot) of the uppermost nodes of the leaves' parts; ``above`` has (grp, steps, subroot)."""
    down = None
    for k in range(len(tables) - 1, -1, -1):
        own = tables[k].where("done").select("grp", F.col("below").alias("part"), "level", "idx").join(above, "grp")
        tops = own.select("part", "grp", "level", "idx", "steps", "subroot")
        tops = tops if down is None else tops.unionByName(down)
        if k == 0:
            return tops
        asking = tables[k - 1].where(~F.col("done"))
        down = materialize(_by_part(_asking_and_tops(asking, tops), -(-parts // FAN**k)).mapInArrow(_descend, _PATH), "paths")
    raise ValueError("no tables")


def _asking_and_tops(asking: DataFrame, tops: DataFrame) -> DataFrame:
    asking = asking.withColumn("steps", F.lit(None).cast(_STEPS)).withColumn("subroot", F.lit(None).cast("string"))
    return asking.unionByName(tops, allowMissingColumns=True)


def _proofs(leaves: DataFrame, parts: int, tops: DataFrame, root: str, keep_steps: bool) -> DataFrame:
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"] + ["steps"] * keep_steps
    kind = leaves.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                id_type[:] = [batch.schema.field("doc_id").type]
                yield batch

        for _, rows in _runs(noted()):
            levels, tops, asking = _local(rows)
            out = []
            for r in asking:
                steps, subroot = _path(levels, tops, 0, r["idx"])
                folded = fold(r["other"], steps)
                out.append({"doc_id": r["doc_id"], "leaf": r["digest"], "subroot": subroot, "root": root, "proof_sha256": joined([x for s in steps for x in s]), "folded_root": folded, "verified": folded == root})
                if keep_steps:
                    out[-1]["steps"] = [{"before": a, "after": b} for a, b in steps]
            kinds = [id_type[0], *[pa.string()] * 5, pa.bool_(), _STEPS_ARROW]
            yield from _table(out, pa.schema(list(zip(names, kinds))))

    schema = f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + f", steps {_STEPS}" * keep_steps
    return _by_part(_asking_and_tops(leaves, tops), parts).mapInArrow(run, schema)


def manifest(docs: DataFrame, received: Column | None = None, keep_steps: bool = False) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``received`` is the text that came back, to be held against the manifest; unset, it is the text itself. folded_root is what the
    received row's leaf and the proof give, verified whether that is the root. ``keep_steps`` adds the proof: of each level the digests
    before and behind the node, from the leaf to the root.
    """
    own = docs.select(group_key(F.col("source")).alias("grp"), F.col("doc_id").alias("sort_key"), "doc_id", leaf_digest().alias("digest"), (leaf_digest() if received is None else leaf_digest(received)).alias("other"))
    leaves, parts = ranked(own)
    tables, roots = climb(leaves, parts)
    if roots is None:
        return _proofs(leaves, 1, docs.sparkSession.createDataFrame([], _PATH), "", keep_steps)
    sources = roots.select(F.lit("").alias("grp"), F.col("grp").alias("sort_key"), "digest")
    upper, upper_parts = ranked(sources)
    upper_tables, upper_roots = climb(upper, upper_parts)
    root = upper_roots.first().digest
    ends = docs.sparkSession.createDataFrame([("", [], "")], f"grp string, steps {_STEPS}, subroot string")
    tops = descend(upper_tables, upper_parts, ends)
    above = _by_part(_asking_and_tops(upper.withColumn("below", F.lit(0).cast("long")), tops), upper_parts).mapInArrow(_source_paths, f"grp string, steps {_STEPS}, subroot string")
    return _proofs(leaves, parts, descend(tables, parts, materialize(above, "above")), root, keep_steps)


def _source_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("grp", pa.string()), ("steps", _STEPS_ARROW), ("subroot", pa.string())])
    for _, rows in _runs(batches):
        levels, tops, asking = _local(rows)
        yield from _table([{"grp": r["sort_key"], "steps": [{"before": a, "after": b} for a, b in _path(levels, tops, 0, r["idx"])[0]], "subroot": r["digest"]} for r in asking], schema)
