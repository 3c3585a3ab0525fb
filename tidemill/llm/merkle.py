"""A Merkle manifest of a table: leaves, the roots of groups and of all, and a proof for every row.

A leaf is the digest of a row's fields, each with its byte count.  Rows are ordered within their group; while several
nodes of a group remain, every ``WAYS`` consecutive ones (of the last run, what there is) become the digest of their
hex texts.  The roots of the groups, in order of the groups, become the root of the table in the same way.

Only digests are ordered, never texts: leaves are formed in the JVM, written, dealt out by ranges of (group, order,
leaf, row) and numbered within their range, so neither a group that holds most rows nor a row that repeats puts all
into one task; the driver adds up one line for each range.  A block of ``WAYS ** h`` consecutive leaves is reduced by one task to one node, with h
such that about ``TOP`` blocks remain at most (and no more than ``MOST`` levels at once: further rounds reduce the
nodes again, and the roots of more than ``TOP`` groups are reduced by blocks too).  The driver builds the small tree on
top and broadcasts, for each block, the siblings from there to the root; the tasks of the blocks put them after the siblings inside the block.

Nulls, ties and repeats: a null field is ``-``; null groups and null order values come first; rows of one order
value go by their leaf, and rows that are the same throughout hold neighbouring places.  An empty table gives an empty
result.  Columns of the table may have any name.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.scratch import materialise

#: Nodes of a run.
WAYS = 3
#: Nodes that the driver takes at most: some 20 MB; beyond them the executors reduce further.
TOP = 100_000
#: Levels that one block spans, at least and at most (729 to 531,441 nodes).
LEAST, MOST = 6, 12

STEP = "array<struct<left: string, right: string>>"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row's fields: for each its bytes in UTF-8, a colon and itself, or a dash for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


def siblings(proof: Column) -> Column:
    """All siblings of a proof, level by level, left to right, as one text."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["left"], step["right"])), "")


def height(n: int) -> int:
    """Levels from ``n`` nodes to one."""
    levels = 0
    while n > 1:
        n, levels = -(-n // WAYS), levels + 1
    return levels


def climb(nodes: list[str], levels: int) -> list[list[str]]:
    """``nodes`` and the levels above them."""
    out = [nodes]
    for _ in range(levels):
        nodes = [digest("".join(nodes[i : i + WAYS])) for i in range(0, len(nodes), WAYS)]
        out.append(nodes)
    return out


def steps(tree: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each node of the lowest level, its siblings on either side, level by level up to the last."""
    beside = []
    for nodes in tree[:-1]:
        runs = [nodes[i // WAYS * WAYS : i // WAYS * WAYS + WAYS] for i in range(len(nodes))]
        beside.append([("".join(run[: i % WAYS]), "".join(run[i % WAYS + 1 :])) for i, run in enumerate(runs)])
    return [[level[i // WAYS**k] for k, level in enumerate(beside)] for i in range(len(tree[0]))]


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` (at, leaf, row and the two named) with grp, the group's place, pos, the row's place in it, and n, the group's rows."""
    kind = {c: rows.schema[c].dataType.simpleString() for c in (group, order, "row")}

    def number(batches):
        from pyspark import TaskContext

        part, source, last, n = TaskContext.get().partitionId(), -1, None, 0
        for batch in batches:
            own, place = [], []
            for value in batch.column(group).to_pylist():
                if source < 0 or value != last:
                    source, last, n = source + 1, value, 0
                own.append(source)
                place.append(n)
                n += 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64()), pa.array(place, pa.int64())], [*batch.schema.names, "part", "src", "idx"])

    by = [group, order, "leaf", "at"]
    table = rows.select(*by, "row").repartitionByRange(*by).sortWithinPartitions(*by)
    table = materialise(table.mapInArrow(number, f"`{group}` {kind[group]}, `{order}` {kind[order]}, leaf string, at long, row {kind['row']}, part int, src long, idx long"), "numbered")
    held = table.groupBy("part", "src").agg(F.count("*").alias("held"), F.first(group).alias("named"))
    ends = held.groupBy("part").agg(F.max("src").alias("last"), *[f(c, "src").alias(n) for f, c, n in ((F.min_by, "held", "first_n"), (F.max_by, "held", "last_n"), (F.min_by, F.struct("named"), "first"), (F.max_by, F.struct("named"), "name"))]).orderBy("part").collect()
    # one line a range: which group it opens with, how much of that group lies before it, and how large the groups at its ends are
    lines, grp, before, open_group, spans = [], -1, 0, None, {}
    for e in ends:
        if open_group is None or e["first"] != open_group:
            grp, before = grp + 1, 0
        lines.append([e["part"], grp, before, grp + e["last"], e["last"]])
        spans[grp] = before + e["first_n"]
        if e["last"]:
            grp, before = grp + e["last"], e["last_n"]
        else:
            before += e["first_n"]
        open_group, spans[grp] = e["name"], before
    lines = [(part, first, before, spans[first], spans[last_grp], last) for part, first, before, last_grp, last in lines]
    sent = rows.sparkSession.createDataFrame(lines, "part int, grp0 long, before long, first_n long, last_n long, last long")
    sizes = held.join(F.broadcast(sent), "part").select(
        "part", "src", (F.col("grp0") + F.col("src")).alias("grp"), F.when(F.col("src") == 0, F.col("before")).otherwise(0).alias("before"),
        F.when(F.col("src") == 0, F.col("first_n")).when(F.col("src") == F.col("last"), F.col("last_n")).otherwise(F.col("held")).alias("n"),
    )
    return table.join(sizes, ["part", "src"]).select("grp", (F.col("before") + F.col("idx")).alias("pos"), "n", F.col("leaf").alias("node"), "row")


def _levels(n: int, h: int) -> int:
    return min(h, height(n))


def _reduced(nodes: DataFrame, h: int) -> DataFrame:
    """One node for each block of ``nodes``, with its place in the group and the group's blocks."""

    def reduce(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by("pos")
        n = t["n"][0].as_py()
        top = climb(t["node"].to_pylist(), _levels(n, h))[-1]
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // WAYS**h)], "node": top}, pa.schema([("grp", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("node", pa.string())]))

    return nodes.select("grp", F.expr(f"pos div {WAYS**h}").alias("block"), "pos", "n", "node").groupBy("grp", "block").applyInArrow(reduce, "grp long, pos long, n long, node string")


def _finished(nodes: DataFrame, h: int, above, kind: str) -> DataFrame:
    """``nodes`` with the root of their group and their proof; ``above`` is the same of the blocks, as a broadcast or a table."""
    out = f"grp long, pos long, node string, row {kind}, subroot string, proof {STEP}"

    def finish(t: pa.Table, subroot: str, path: list) -> pa.Table:
        t = t.sort_by("pos")
        paths = steps(climb(t["node"].to_pylist(), _levels(t["n"][0].as_py(), h))) if len(t) else []
        proof = pa.array([[{"left": a, "right": b} for a, b in [*own, *path]] for own in paths], pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table([t["grp"], t["pos"], t["node"], t["row"], pa.array([subroot] * len(t), pa.string()), proof], ["grp", "pos", "node", "row", "subroot", "proof"])

    blocks = nodes.select("grp", F.expr(f"pos div {WAYS**h}").alias("block"), "pos", "n", "node", "row").groupBy("grp", "block")
    if isinstance(above, DataFrame):
        ends = above.select("grp", F.col("pos").alias("block"), "subroot", "proof").groupBy("grp", "block")
        return blocks.cogroup(ends).applyInArrow(lambda t, up: finish(t, up["subroot"][0].as_py(), [(s["left"], s["right"]) for s in up["proof"][0].as_py()]), out)
    return blocks.applyInArrow(lambda key, t: finish(t, *above.value[key[0].as_py(), key[1].as_py()]), out)


def _top(nodes: list) -> tuple[str, dict]:
    """The root of the table, and of each node (grp, pos, node) the root of its group with the siblings up to the table's root."""
    groups: dict[int, list[str]] = {}
    for grp, _, node in sorted(nodes):
        groups.setdefault(grp, []).append(node)
    trees = {g: climb(n, height(len(n))) for g, n in groups.items()}
    roots = climb([trees[g][-1][0] for g in sorted(trees)], height(len(trees)))
    upper = dict(zip(sorted(trees), steps(roots)))
    return roots[-1][0], {(g, i): (tree[-1][0], [*own, *upper[g]]) for g, tree in trees.items() for i, own in enumerate(steps(tree))}


def manifest(rows: DataFrame, leaf_column: str, group: str, order: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of each row with leaf, subroot, root and proof: for each level up to the root the siblings on the left and on the right."""
    spark = rows.sparkSession
    first = rows.select(F.col(group).alias("_g"), F.col(order).alias("_o"), F.col(leaf_column).alias("leaf"), F.struct(*keep).alias("row"), F.monotonically_increasing_id().alias("at"))
    first = materialise(first, "leaves")  # the ranges are drawn from digests, not from texts read once more
    count = first.count()
    kind = first.schema["row"].dataType.simpleString()
    empty = f"row {kind}, leaf string, subroot string, root string, proof {STEP}"
    if not count:
        return spark.createDataFrame([], empty).select("row.*", "leaf", "subroot", "root", "proof")
    nodes = materialise(numbered(first, "_g", "_o"), "nodes")
    rounds, turned = [], None
    while True:
        h = min(MOST, max(LEAST, height(-(-count // TOP))))
        rounds.append((nodes, h))
        nodes = materialise(_reduced(nodes, h), "blocks")
        count = nodes.count()
        if count <= TOP:
            break
        if turned is None and nodes.where("n > 1").isEmpty():
            # every group has come to its root: the roots are now one group
            nodes, turned = nodes.select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(count).cast("long").alias("n"), "node"), len(rounds)
        nodes = nodes.withColumn("row", F.lit(None).cast("string"))
    root, paths = _top([tuple(r) for r in nodes.select("grp", "pos", "node").collect()])
    above = spark.sparkContext.broadcast(paths)
    for k in range(len(rounds) - 1, -1, -1):
        nodes, h = rounds[k]
        above = _finished(nodes, h, above, kind if k == 0 else "string")
        if k:
            if turned == k:
                above = above.select(F.col("pos").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("node").alias("subroot"), "proof")
            above = materialise(above, "paths")
    return above.select("row.*", F.col("node").alias("leaf"), "subroot", F.lit(root).alias("root"), "proof")
