"""Hard negatives of embedding vectors by integer inner products, computed bit-plane by bit-plane.

A vector's components are integers in two's complement. Its product with an anchor is the
sum, over the planes of its components' bits, of the plane's weight times the anchor's sum
over the components that have the bit. Planes are taken from the most significant down:
after each, what the others can still add lies between two bounds that the anchor alone
gives, so every candidate's score is in an interval that halves with each plane. Candidates
whose interval has left the scores asked for, or lies below what enough others surely
reach, are dropped; what is left after the last plane has its exact score.

Anchors are a set of queries that is held against all rows in blocks. Blocks of anchors and
blocks of rows meet in a grid, each pair in one task, which gives its best few for each
anchor; these are ranked once more. No label's rows are gathered, and nothing is broadcast
but what Spark finds small itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut, table, turn_to

#: Positives of an anchor; negatives of a positive; least and greatest score of a negative in percent of the positive's.
POSITIVES, NEGATIVES, PERCENT = 5, 5, (80, 100)
#: Components become floor(SCALE * x).
SCALE = 256
#: Rows and anchors of a block at most; rows and anchors whose scores are held at a time.
ROWS, ANCHORS, ROWS_HELD, ANCHORS_HELD = 1 << 14, 1 << 12, 1 << 12, 1 << 8
#: Share of candidates left below which they are followed one by one.
FEW = 1 / 16
#: Stands for a null id inside; it comes last among ties, as null does.
NO_ID = (1 << 63) - 1
_BLOCK = "part int, dim int, kind string, ids binary, labels binary, x binary"


def planes(x: np.ndarray) -> int:
    """Bits that the integers x need below their sign."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return max((-low - 1).bit_length() if low < 0 else 0, high.bit_length() if high > 0 else 0)


def _bits(x: np.ndarray, b: int, kind) -> np.ndarray:
    return ((x >> b) & 1).astype(kind)


def sliced_best(a: np.ndarray, x: np.ndarray, alive: np.ndarray, low: np.ndarray, high: np.ndarray, floor: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """(anchor, window, row, score) of the best `most` rows of each anchor and window of scores, ties by smaller id.

    a, x: integers, a row for each anchor and candidate; alive: which pairs count; low,
    high: (anchor, window), scores between which a row qualifies; floor: scores that `most`
    rows elsewhere reach, below which nothing is wanted.
    """
    top = planes(x)
    big = len(a) and x.shape[1] * max(1, int(np.abs(a).max())) << (top + 1) >= 1 << 53
    kind = object if big or a.dtype == object or x.dtype == object else np.float64
    a, least = a.astype(kind), np.maximum(low, floor)
    if kind is not object:  # scores are exact, and bounds beyond them are rounded to what is beyond too
        low, high, least = (v.astype(kind) for v in (low, high, least))
    up, down = np.maximum(a, 0).sum(1), np.minimum(a, 0).sum(1)  # what one unit in every component can add or take
    score = (a @ _bits(x, top, kind).T) * -(1 << top)
    rest = (1 << top) - 1
    b = top
    while b and alive.mean() > FEW:
        b -= 1
        score = score + (a @ _bits(x, b, kind).T) * (1 << b)
        rest = (1 << b) - 1
        under, over = score + (rest * down)[:, None], score + (rest * up)[:, None]
        if not np.isfinite(low.astype(float)).any() and x.shape[0] > most:  # only the best count: what `most` surely reach
            sure = np.where(alive, under, -np.inf)
            reached = np.sort(sure, axis=1)[:, -most] if kind is object else np.partition(sure, -most, axis=1)[:, -most]
            least = np.maximum(least, reached[:, None])
        alive = alive & (over >= least.min(1)[:, None]) & (under <= high.max(1)[:, None])
    i, j = np.nonzero(alive)
    s = score[i, j]
    while b:
        b -= 1
        s = s + (a[i] * _bits(x, b, kind)[j]).sum(1) * (1 << b)
        rest = (1 << b) - 1
        under, over = s + rest * down[i], s + rest * up[i]
        keep = np.zeros(len(i), bool)
        for w in range(low.shape[1]):
            sure = np.flatnonzero((under >= low[i, w]) & (over <= high[i, w]))
            _raise(least[:, w], i[sure], under[sure], most)
            keep |= (over >= least[i, w]) & (under <= high[i, w])
        i, j, s = i[keep], j[keep], s[keep]
    found = [(np.zeros(0, np.int64),) * 3 + (s[:0],)]
    for w in range(low.shape[1]):
        on = np.flatnonzero((s >= least[i, w]) & (s <= high[i, w]) & (s >= low[i, w]))
        ranked = np.unique(s[on], return_inverse=True)[1]
        order = np.lexsort((ids[j[on]], -ranked, i[on]))
        on = on[order][_first(i[on][order], most)]
        found.append((i[on], np.full(len(on), w), j[on], s[on]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _first(group: np.ndarray, most: int) -> np.ndarray:
    """Which of rows sorted by group are among the first `most` of theirs."""
    at = np.arange(len(group))
    begin = np.r_[True, group[1:] != group[:-1]] if len(group) else np.zeros(0, bool)
    return at - np.maximum.accumulate(np.where(begin, at, 0)) < most


def _raise(least: np.ndarray, group: np.ndarray, value: np.ndarray, most: int) -> None:
    """Put least[g] up to the `most`-th greatest value of group g, where it has as many."""
    if not len(group):
        return
    order = np.lexsort((-np.unique(value, return_inverse=True)[1], group))
    g, v = group[order], value[order]
    kth = np.flatnonzero(_first(g, most) & ~_first(g, most - 1)) if most > 1 else np.flatnonzero(_first(g, 1))
    least[g[kth]] = np.maximum(least[g[kth]], v[kth])


def _pack(x: np.ndarray) -> tuple[str, bytes]:
    """Integers, held as doubles, in the narrowest kind."""
    size = max(abs(float(x.min())), abs(float(x.max()))) if x.size else 0
    kind = "<i2" if size < 1 << 15 else "<i4" if size < 1 << 31 else "<f8"
    return kind, x.astype(kind).tobytes()


def _unpack(kind: str, data: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(data, kind)
    x = np.array([int(v) for v in x], object) if kind == "<f8" else x.astype(np.int64)
    return x.reshape(-1, dim) if dim else x.reshape(0, 0)


def _blocks(rows: DataFrame, number: int, most: int, windows: int = 0) -> DataFrame:
    """rows (id, label, x doubles[, name, low, high]) in blocks of at most `most` rows of one dimension, dealt evenly to `number` parts."""
    extra = ", names binary, low binary, high binary" if windows else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in (b.slice(k, most) for b in batches for k in range(0, b.num_rows, most)):
            x = batch.column("x")
            dims = np.diff(x.offsets.to_numpy())
            flat, starts = x.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(dims)]
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "label", *(("name",) if windows else ()))}
            for dim in np.unique(dims).tolist():
                on = np.flatnonzero(dims == dim)
                kind, data = _pack(flat[(starts[on][:, None] + np.arange(dim)).ravel()])
                row = [batch.column("part")[0].as_py(), dim, kind, column["id"][on].astype("<i8").tobytes(), column["label"][on].astype("<i8").tobytes(), data]
                if windows:
                    ends = [np.array(batch.column(c).take(pa.array(on)).to_pylist(), "<i8").tobytes() for c in ("low", "high")]
                    row += [column["name"][on].astype("<i8").tobytes(), *ends]
                names = [f.split()[0] for f in (_BLOCK + extra).split(", ")]
                kinds = [pa.int32(), pa.int32(), pa.string()] + [pa.binary()] * (len(names) - 3)
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    dealt = rows.repartition(number).withColumn("part", F.spark_partition_id())
    return dealt.mapInArrow(run, _BLOCK + extra)


def _grid(anchors: DataFrame, rows: DataFrame, n_anchors: int, n_rows: int, same: bool, windows: int, most: int) -> DataFrame:
    """(name, window, id, score): for each anchor and window the best few rows of each block, of its own label or of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                a, x = _unpack(r["kind"], r["x"], r["dim"]), _unpack(r["r_kind"], r["r_x"], r["dim"])
                ids, labels, row_ids, row_labels, names = (np.frombuffer(r[c], "<i8") for c in ("ids", "labels", "r_ids", "r_labels", "names"))
                if same:
                    low, high = np.full((len(ids), 1), -np.inf), np.full((len(ids), 1), np.inf)
                else:
                    low, high = (np.frombuffer(r[c], "<i8").reshape(len(ids), windows).astype(object) for c in ("low", "high"))
                    high[high == NO_ID] = np.inf
                for i, w, j, s in _block_best(a, x, ids, labels, row_ids, row_labels, low, high, same, most):
                    s = np.array([min(max(int(v), -(1 << 63)), NO_ID) for v in s], np.int64) if s.dtype == object else s.astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(w.astype(np.int32)), pa.array(row_ids[j]), pa.array(s)], names=["name", "window", "id", "score"])

    left = anchors.withColumnRenamed("part", "ap").withColumn("rp", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))))
    right = rows.select(F.col("part").alias("rp"), "dim", *[F.col(c).alias(f"r_{c}") for c in ("kind", "ids", "labels", "x")])
    right = right.withColumn("ap", F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))))
    return left.join(right, ["ap", "rp", "dim"]).mapInArrow(run, "name long, window int, id long, score long")


def _block_best(a, x, ids, labels, row_ids, row_labels, low, high, same, most) -> Iterator[tuple[np.ndarray, ...]]:
    """sliced_best() over chunks of two blocks; what earlier chunks reach is the floor of later ones."""
    for label in np.unique(labels):
        mine, theirs = np.flatnonzero(labels == label), np.flatnonzero((row_labels == label) == same)
        for p in range(0, len(mine), ANCHORS_HELD):
            m = mine[p : p + ANCHORS_HELD]
            floor = np.full(low[m].shape, -np.inf, object)
            held = None
            for q in range(0, len(theirs), ROWS_HELD):
                t = theirs[q : q + ROWS_HELD]
                alive = ids[m][:, None] != row_ids[t][None, :] if same else np.ones((len(m), len(t)), bool)
                i, w, j, s = sliced_best(a[m], x[t], alive, low[m], high[m], floor, row_ids[t], most)
                got = (i, w, t[j], s)
                held = got if held is None else tuple(np.concatenate(c) for c in zip(held, got, strict=True))
                ranked = np.unique(held[3], return_inverse=True)[1]
                order = np.lexsort((row_ids[held[2]], -ranked, held[1], held[0]))
                pair = held[0][order] * low.shape[1] + held[1][order]
                held = tuple(c[order][_first(pair, most)] for c in held)
                for v in range(low.shape[1]):
                    on = held[1] == v
                    _raise(floor[:, v], held[0][on], held[3][on], most)
            if held is not None and len(held[0]):
                yield m[held[0]], held[1], held[2], held[3]


def hard_negatives(
    rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, percent: tuple[int, int] = PERCENT, scale: int = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its positives, the best negatives.

    anchors, a condition on rows, says which are anchors; ids and labels are whole numbers.
    Scores are inner products of floor(scale * x). An anchor's positives are its best rows
    of the same label and another id; a positive's negatives the best rows of other labels
    whose score is between percent[0] and percent[1] hundredths of the positive's. Ties go
    to the smaller id; a null id comes last. Rows with a null label, a null vector or a
    component that is null or not finite take no part, nor do vectors without components;
    vectors of other lengths than the anchor's are not compared with it. A repeated row counts as often as it is there,
    but as one anchor. A score beyond 64 bits counts as
    the nearest 64-bit number. No anchors, or an empty table, give no rows; other columns play no part.
    """
    vec = F.col(f"`{vec_col}`")
    good = F.coalesce(~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))), F.lit(False)) & (F.size(vec) > 0)
    kept = rows.where(good & F.col(f"`{label_col}`").isNotNull())
    row = [F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vec.cast("array<double>").alias("vec")]
    spark = rows.sparkSession
    # The product is a whole number as soon as it is floored; SQL's floor() would cut it to 64 bits.
    x = F.transform("vec", lambda v: F.rint(v * scale) - F.when(F.rint(v * scale) > v * scale, 1.0).otherwise(0.0)).alias("x")
    chosen = cut(kept.where(anchors).select(*row).distinct().select(F.monotonically_increasing_id().alias("name"), "id", "label", x), narrow=True)
    n, count = kept.count(), chosen.count()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count:
        return spark.createDataFrame([], shape)
    parts = max(-(-n // ROWS), min(-(-n // 1024), 2 * spark.sparkContext.defaultParallelism))
    groups = -(-count // ANCHORS)
    blocks = cut(_blocks(kept.select(*row).select("id", "label", x), parts, ROWS))
    none = F.array(F.lit(0).cast("long"))
    first = _grid(_blocks(chosen.select("id", "label", "x", "name", none.alias("low"), none.alias("high")), groups, ANCHORS, 1), blocks, groups, parts, True, 1, positives)
    best = Window.partitionBy("name").orderBy(F.desc("score"), "id")
    found = cut(first.withColumn("at", F.row_number().over(best)).where(F.col("at") <= positives).select("name", "at", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), narrow=True)
    score, bound = F.col("positive_score").cast("decimal(38,0)"), lambda p, up: (F.ceil if up else F.floor)(score * p / 100).cast("decimal(38,0)").cast("long")
    ends = found.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("at", bound(percent[0], True).alias("low"), bound(percent[1], False).alias("high")))).alias("w"))
    # Anchors with fewer positives than others have windows that hold no score.
    pad = lambda c, v: F.concat(F.col("w")[c], F.array_repeat(F.lit(v).cast("long"), positives - F.size("w")))
    asked = chosen.join(ends, "name").select("id", "label", "x", "name", pad("low", 1).alias("low"), pad("high", 0).alias("high"))
    second = _grid(_blocks(asked, groups, ANCHORS, positives), blocks, groups, parts, False, positives, negatives)
    rank = F.row_number().over(Window.partitionBy("name", "window").orderBy(F.desc("score"), "id"))
    ranked = second.withColumn("rank", rank).where(F.col("rank") <= negatives)
    shown = lambda c: F.nullif(F.col(c), F.lit(NO_ID))
    out = ranked.withColumn("at", F.col("window") + 1).join(found, ["name", "at"]).join(chosen.select("name", F.col("id").alias("anchor_id")), "name")
    return out.select("anchor_id", shown("positive_id").alias("positive_id"), "rank", shown("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of the rows of embeddings whose id is divisible by 100, with the labels of every seventh id moved on by one."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
         CAST(list_sum(list_transform(list_zip(a.q, r.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a, v r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.q) = len(r.q)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
"""
