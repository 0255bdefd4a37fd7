"""Near copies among embedding vectors by NN-descent: a neighbour graph refined by its own neighbours.

Equal vectors are one node with a count. A first graph comes from sorting the nodes by the
signs of random projections, several times, and taking neighbours in that order. In each
round the neighbours of a node, on from it and back to it, are compared with each other,
and whoever is nearer than the worst of a node's list enters it; pairs that were compared
before are left out. A list whose every entry is near enough to link is saturated and gets
twice the room. Rounds end when hardly an edge is new. Then recall is audited: a bounded
sample of nodes is held against all nodes by brute force, and more rounds follow if too
many of their links lead out of their component.

Edges at the threshold stay; their connected components are the groups. Links of a node
lie within its component, so they are counted there, whole: nodes within half the threshold
angle of the component's mean direction all link with each other, by the triangle
inequality, and are counted without a comparison, however many there are; the others are
compared with their component in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut, join_splittable, remove, table, turn_to
from provenia.llm.components import connected_components

#: Cosine from which vectors link.
LEAST = 0.95
#: Room of a neighbour list, at first and at most; sorted orders of the first graph, signs of each, places looked at on either side, and how many of them are taken.
ROOM, MOST, ORDERS, SIGNS, REACH, TAKEN = 8, 32, 6, 31, 6, 3
#: Rounds at most; share of linking edges that are new at which they end.
ROUNDS, STILL = 8, 0.001
#: Nodes of the audit; share of their links that must lie within their component; further tries.
AUDITED, RECALL, TRIES = 256, 0.99, 3
#: What half-precision unit vectors may be wrong by in a product; slack of an angle.
HALF, SLACK = 0.003, 1e-6
#: Rows of neighbour lists compared at a time; nodes of a block where components are counted.
HELD, BLOCK = 1 << 13, 1 << 11
SEED = 12


def _units(rows: list) -> np.ndarray:
    """Vectors of one length as unit vectors."""
    x = np.array(rows, float)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(lengths: np.ndarray) -> Iterator[np.ndarray]:
    for n in np.unique(lengths):
        yield np.flatnonzero(lengths == n)


def _halves(column: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    rows = column.to_pylist()
    return np.fromiter(map(len, rows), np.int64, len(rows)), rows


def _matrix(rows: list[bytes], on: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join([rows[k] for k in on.tolist()]), np.float16).reshape(len(on), -1).astype(np.float32)


def vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, DataFrame]:
    """((id, key) of each row, key null where it has no direction; the nodes: (node, key, copies, low, unit, half)).

    A key has 128 bits of hashes of the vector.
    """
    vec = F.col(f"`{vec_col}`").cast("array<double>")
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    good = F.coalesce(~odd & F.exists(vec, lambda x: x != 0), F.lit(False))
    key = F.when(good, F.concat(F.hex(F.xxhash64(vec)), F.lit("-"), F.hex(F.xxhash64(F.lit(SEED), vec))))
    marked = rows.select(F.col(f"`{id_col}`").alias("id"), key.alias("key"), vec.alias("vec"))
    merged = marked.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("id").alias("low"), F.first("vec").alias("vec"))
    named = merged.select(F.monotonically_increasing_id().alias("node"), "key", "copies", "low", "vec")
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in (b.slice(k, HELD) for b in batches for k in range(0, b.num_rows, HELD)):
            x = batch.column("vec")
            lengths = np.diff(x.offsets.to_numpy())
            for on in _by_length(lengths):
                part = batch.take(pa.array(on))
                unit = _units(part.column("vec").to_pylist())
                half = [r.tobytes() for r in unit.astype(np.float16)]
                out = [*(part.column(c) for c in ("node", "key", "copies", "low")), pa.array(list(unit), pa.list_(pa.float64())), pa.array(half, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=["node", "key", "copies", "low", "unit", "half"])

    # Written before they are numbered, so that a number stays with its vector.
    return marked.select("id", "key"), cut(cut(named).mapInArrow(run, f"node long, key string, copies long, low {kind}, unit array<double>, half binary"))


def first_graph(nodes: DataFrame) -> DataFrame:
    """(u, v, s): nodes beside each other in ORDERS orders by signs of random projections, and their products."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            lengths, rows = _halves(batch.column("half"))
            for on in _by_length(lengths):
                x = _matrix(rows, on)
                turns = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], ORDERS * SIGNS)).astype(np.float32)
                signs = (x @ turns > 0).reshape(len(on), ORDERS, SIGNS)
                codes = signs @ (1 << np.arange(SIGNS - 1, -1, -1))
                part = batch.take(pa.array(on))
                size = pa.array(np.full(len(on), x.shape[1], np.int32))
                for t in range(ORDERS):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), t, np.int32)), size, pa.array(codes[:, t].astype(np.int64)), part.column("node"), part.column("half")], names=["t", "dim", "code", "node", "half"])

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        kept = None
        for batch in (b.slice(k, HELD) for b in batches for k in range(0, b.num_rows, HELD)):
            now = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            kept = now.slice(max(0, now.num_rows - REACH))
            node, run = now["node"].to_numpy(), now["t"].to_numpy().astype(np.int64) << 32 | now["dim"].to_numpy()
            lengths, rows = _halves(now["half"].combine_chunks())
            for on in _by_length(lengths):
                x, own, r = _matrix(rows, on), node[on], run[on]
                near = np.full((len(on), 2 * REACH), -2, np.float32)
                who = np.zeros(near.shape, np.int64)
                for d in range(1, min(REACH, len(on) - 1) + 1):
                    s = np.where((r[:-d] == r[d:]) & (own[:-d] != own[d:]), (x[:-d] * x[d:]).sum(1), -2)
                    near[:-d, d - 1], who[:-d, d - 1] = s, own[d:]
                    near[d:, REACH + d - 1], who[d:, REACH + d - 1] = s, own[:-d]
                best = np.argpartition(-near, TAKEN, axis=1)[:, :TAKEN]
                u, v, s = np.repeat(own, TAKEN), np.take_along_axis(who, best, 1).ravel(), np.take_along_axis(near, best, 1).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(c[s > -2]) for c in (u, v, s)], names=["u", "v", "s"])

    order = ["t", "dim", "code", "node"]
    spreaded = nodes.select("node", "half").mapInArrow(spread, "t int, dim int, code long, node long, half binary")
    return spreaded.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(beside, "u long, v long, s float")


def _lists(pairs: DataFrame, least: float) -> DataFrame:
    """(u, v, s, fresh, room): the best of pairs (u, v, s, fresh, room) that each u has room for; saturated lists get more for the next round."""
    each = pairs.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("fresh").alias("fresh"), F.max("room").alias("room"))
    own = Window.partitionBy("u")
    ranked = each.withColumn("room", F.max("room").over(own)).withColumn("at", F.row_number().over(own.orderBy(F.desc("s"), "v")))
    room = F.coalesce("room", F.lit(ROOM))
    kept = ranked.withColumn("room", room).where(F.col("at") <= F.col("room"))
    full = (F.count("*").over(own) >= F.col("room")) & (F.min("s").over(own) >= least - HALF)
    return kept.select("u", "v", "s", "fresh", F.when(full, F.least(F.col("room") * 2, F.lit(MOST))).otherwise(F.col("room")).alias("room"), (F.col("room") <= F.count("*").over(own)).alias("filled"))


def _round(nodes: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """The graph after each node's neighbours have been compared with each other."""
    worst = graph.groupBy("u").agg(F.when(F.bool_and("filled") & (F.max("room") == F.count("*")), F.min("s")).otherwise(-2.0).cast("float").alias("worst"))
    state = nodes.join(worst, nodes.node == worst.u).select(F.col("node").alias("m"), "half", "worst")
    back = graph.withColumn("at", F.row_number().over(Window.partitionBy("v").orderBy(F.desc("s"), "u"))).where(F.col("at") <= ROOM)
    members = graph.select(F.col("u").alias("c"), F.col("v").alias("m"), "fresh").unionByName(back.select(F.col("v").alias("c"), F.col("u").alias("m"), "fresh"))
    met = join_splittable(members, state, "m", "inner").select("c", "m", "fresh", "half", "worst")

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        c, m, fresh, worst = (t[k].to_numpy() for k in ("c", "m", "fresh", "worst"))
        lengths, rows = _halves(t["half"].combine_chunks())
        for on in _by_length(lengths):
            x, own, who, new, bar = _matrix(rows, on), c[on], m[on], fresh[on], worst[on]
            begin = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            size = np.diff(np.r_[begin, len(on)])
            at = begin[:, None] + np.arange(size.max())
            there = np.arange(size.max()) < size[:, None]
            at = np.where(there, at, 0)
            s = x[at] @ x[at].transpose(0, 2, 1)
            ok = there[:, :, None] & there[:, None, :] & (who[at][:, :, None] != who[at][:, None, :]) & (new[at][:, :, None] | new[at][:, None, :]) & (s > bar[at][:, :, None])
            g, i, j = np.nonzero(ok)
            u, v, s = who[at[g, i]], who[at[g, j]], s[g, i, j]
            order = np.lexsort((v, u))
            u, v, s = u[order], v[order], s[order]
            once = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])] if len(u) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(k[once]) for k in (u, v, s)], names=["u", "v", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        yield from _whole_groups(batches, "c", compare)

    found = met.repartition("c").sortWithinPartitions("c").mapInArrow(run, "u long, v long, s float")
    old = graph.select("u", "v", "s", F.lit(False).alias("fresh"), "room")
    return _lists(found.select("u", "v", "s", F.lit(True).alias("fresh"), F.lit(None).cast("int").alias("room")).unionByName(old), least)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """solve() over some HELD sorted rows at a time, whole groups of bounded size each."""
    held: pa.Table | None = None
    for batch in (b.slice(k, HELD) for b in batches for k in range(0, b.num_rows, HELD)):
        one = pa.Table.from_batches([batch])
        held = one if held is None else pa.concat_tables([held, one])
        if held.num_rows >= HELD:
            k = held[key].to_numpy()
            cut_at = np.flatnonzero(k != k[-1])
            if len(cut_at):
                yield from solve(held.slice(0, cut_at[-1] + 1))
                held = held.slice(cut_at[-1] + 1)
    if held is not None and held.num_rows:
        yield from solve(held)


def neighbours(nodes: DataFrame, least: float, rounds: int = ROUNDS, graph: DataFrame | None = None) -> DataFrame:
    """The refined neighbour graph (u, v, s, fresh, room, filled), as a table; s is a product of half-precision unit vectors."""
    if graph is None:
        start = first_graph(nodes).withColumns({"fresh": F.lit(True), "room": F.lit(ROOM)})
        graph = cut(_lists(start.unionByName(start.select(F.col("v").alias("u"), F.col("u").alias("v"), "s", "fresh", "room")), least), narrow=True)
    for _ in range(rounds):
        old, graph = graph, cut(_round(nodes, graph, least), narrow=True)
        remove(old)
        linking, new = graph.where(F.col("s") >= least - HALF).agg(F.count("*"), F.count_if("fresh")).first()
        if new <= STILL * linking:
            break
    return graph


def links(nodes: DataFrame, graph: DataFrame, least: float) -> DataFrame:
    """(u, v) of the graph's edges whose cosine, in double precision, is `least` or more."""
    edges = graph.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), "s").where(F.col("s") >= least - HALF).dropDuplicates(["u", "v"])
    sure = edges.where(F.col("s") >= least + HALF).select("u", "v")
    close = edges.where(F.col("s") < least + HALF).select("u", "v")
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("unit").alias(f"x{k}"))
    product = F.aggregate(F.zip_with("xu", "xv", lambda a, b: a * b), F.lit(0.0), lambda t, p: t + p)
    return sure.unionByName(close.join(side("u"), "u").join(side("v"), "v").where(product >= least).select("u", "v"))


def audit(nodes: DataFrame, roots: DataFrame, least: float, sample: int = AUDITED) -> tuple[int, int]:
    """(links found, links) of at most `sample` nodes, those of smallest hash, against all nodes by brute force.

    roots: (node, root) of linked nodes. A link is found if both ends are in one component.
    """
    tied = join_splittable(nodes.select("node", "unit", "half"), roots, "node").select("node", "unit", "half", F.coalesce("root", "node").alias("root"))
    chosen = tied.select("node", "unit", "root").orderBy(F.xxhash64("node"), "node").limit(sample).collect()
    groups = {}
    for r in chosen:
        groups.setdefault(len(r.unit), []).append((r.node, r.root, r.unit))
    against = {d: (np.array([g[0] for g in rows]), np.array([g[1] for g in rows]), np.array([g[2] for g in rows])) for d, rows in groups.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            found = total = 0
            node, root = batch.column("node").to_numpy(), batch.column("root").to_numpy()
            lengths, rows = _halves(batch.column("half"))
            for on in _by_length(lengths):
                if lengths[on[0]] // 2 not in against:
                    continue
                names, theirs, x = against[lengths[on[0]] // 2]
                s = _matrix(rows, on).astype(float) @ x.T
                near = (s >= least + HALF) & (node[on][:, None] != names[None, :])
                total += int(near.sum())
                found += int((near & (root[on][:, None] == theirs[None, :])).sum())
            yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([total])], names=["found", "total"])

    found, total = tied.select("node", "root", "half").mapInArrow(run, "found long, total long").agg(F.sum("found"), F.sum("total")).first()
    return found or 0, total or 0


def counted(nodes: DataFrame, roots: DataFrame, least: float) -> DataFrame:
    """(node, root, n_links): how many rows each linked node links to in its component, copies of its own included."""
    tied = cut(join_splittable(roots, nodes.select("node", "copies", "unit"), "node", "inner"))
    mean = tied.select("root", "copies", F.posexplode("unit").alias("pos", "x")).groupBy("root", "pos").agg(F.sum(F.col("x")).alias("x"))
    mean = mean.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("mean"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, p: t + p)
    cosine = dot("unit", "mean") / F.greatest(F.sqrt(dot("mean", "mean")), F.lit(1e-300))
    away = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))
    core = F.coalesce(away <= math.acos(least) / 2 - SLACK, F.lit(False))
    placed = cut(join_splittable(tied, mean, "root", "inner").select("node", "root", "copies", "unit", core.alias("core")))
    sizes = placed.groupBy("root").agg(F.sum(F.when(F.col("core"), F.col("copies")).otherwise(0)).alias("inside"), F.count_if(~F.col("core")).alias("outer"), F.count("*").alias("all"))
    rows = join_splittable(placed.select("node", "root", "core"), sizes, "root", "inner")
    base = rows.select("node", "root", F.when(F.col("core"), F.col("inside")).otherwise(0).alias("n"))
    # Nodes further out against their whole component, block by block.
    broad = join_splittable(placed, sizes.where("outer > 0"), "root", "inner")
    high, wide = F.ceil(F.col("outer") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    left = broad.where("not core").select("root", F.pmod(F.hash("node"), high).alias("i"), F.explode(F.sequence(F.lit(0), wide - 1)).alias("j"), F.lit(0).alias("side"), "node", "copies", "core", "unit")
    right = broad.select("root", F.explode(F.sequence(F.lit(0), high - 1)).alias("i"), F.pmod(F.hash("node", F.lit(1)), wide).alias("j"), F.lit(1).alias("side"), "node", "copies", "core", "unit")
    cells = left.unionByName(right).withColumn("cell", F.xxhash64("root", "i", "j"))

    def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, side, node, copies, core = (t[k].to_numpy() for k in ("cell", "side", "node", "copies", "core"))
        unit = t["unit"]
        for c in np.unique(cell):
            a, b = np.flatnonzero((cell == c) & (side == 0)), np.flatnonzero((cell == c) & (side == 1))
            if not len(a) or not len(b):
                continue
            near = np.array(unit.take(pa.array(a)).to_pylist()) @ np.array(unit.take(pa.array(b)).to_pylist()).T >= least
            b_core = core[b].astype(bool)
            out = [(node[a], near @ copies[b]), (node[b[b_core]], copies[a] @ near[:, b_core])]
            for who, n in out:
                yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], names=["node", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        yield from _whole_groups(batches, "cell", compare)

    extra = cells.select("cell", "side", "node", "copies", "core", "unit").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "node long, n long")
    total = base.select("node", "n").unionByName(extra).groupBy("node").agg((F.sum("n") - 1).alias("n_links"))
    return total.join(roots, "node").select("node", "root", "n_links")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: how many other rows it links to directly, and the smallest id reachable.

    Rows link whose vectors have a cosine of `least` (above 0) or more, in double precision; kept
    rows are those that have the smallest id of their group. Null, empty and zero vectors and such with
    null or not finite components link with nothing, nor do vectors of unequal lengths.
    Equal vectors link, repeated rows are rows. A null id is never a component_id unless
    all of a group are null. An empty table gives no rows; other columns play no part.
    """
    marked, nodes = vectors(rows.select(id_col, vec_col), id_col, vec_col)
    graph, tries = neighbours(nodes, least), 0
    while True:
        roots = cut(connected_components(links(nodes, graph, least)), narrow=True)
        found, total = audit(nodes, roots, least)
        tries += 1
        if found >= RECALL * total or tries > TRIES:
            break
        graph = neighbours(nodes, least, 2, graph.withColumn("fresh", F.lit(True)))
    counts = counted(nodes, roots, least)
    own = join_splittable(nodes.select("node", "key", "copies", "low"), cut(counts, narrow=True), "node").withColumn("root", F.coalesce("root", "node"))
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = join_splittable(own, low, "root").select("key", F.coalesce("n_links", F.col("copies") - 1).alias("n_links"), "component_id")
    placed = join_splittable(marked.where("key is not null"), cut(named, narrow=True), "key").select("id", "n_links", "component_id")
    alone = marked.where("key is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return placed.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_nn_descent(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of embeddings."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (
  SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE list_dot_product(a.q, b.q) / sqrt(list_dot_product(a.q, a.q) * list_dot_product(b.q, b.q)) >= 0.95),
r AS (SELECT vec_id AS u, vec_id AS w FROM embeddings UNION SELECT r.u, e.w FROM r JOIN e ON r.w = e.u)
SELECT vec_id, CAST((SELECT count(*) FROM e WHERE e.u = vec_id) AS BIGINT) AS n_links, c.component_id, vec_id = c.component_id AS kept
FROM embeddings JOIN (SELECT u, min(w) AS component_id FROM r GROUP BY u) c ON c.u = vec_id
"""
