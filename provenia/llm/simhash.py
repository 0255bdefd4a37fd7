"""Near-duplicate documents by SimHash fingerprints and a self-join of their binary trie.

Within a trie, pairs of nodes are walked together from the root; a pair carries the number
of bits in which its two paths differ and is dropped when that exceeds the budget. Pairs of
subtrees known to lie in one component are dropped too, so that a dense ball of fingerprints
costs about its size and leaves a spanning forest of links rather than all its pairs.

A trie holds the fingerprints that can be near each other. For a budget of few bits
(near_links) these are the ones with an equal block of bits: of `bits + 1` blocks, two
fingerprints within the budget have one in common. For near copies (wide_links), whose
budget is a fifth of all bits, no block is both wide enough to tell texts apart and likely
to be equal; there, the texts of a trie share one of six min-wise shingles. Tries of many
rows are compared in blocks instead, each row with each other one, so that a link does not
depend on how many rows share its trie.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, join_splittable, text_pass, turn_to
from provenia.llm.components import connected_components
from provenia.llm.rows import keep_one_of_each, text_hash

#: Words of a shingle, bits by which linked fingerprints may differ, seed of the hash.
WORDS, BITS, SEED = 3, 3, 42
#: Near copies: words of a shingle, bits of a fingerprint, least similarity (cosine), min-wise shingles by which texts meet.
SHINGLE, WIDE, LEAST, ANCHORS = 5, 1024, 0.8, 6
#: Case and ASCII punctuation play no part in near copies.
_PLAIN = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in bytes(range(256)).lower())
#: Rows from which a trie is split; rows from which one of near copies is compared in blocks; share of pairs at the budget that meet under masks; bits of a mask at most.
HOT, SPLIT_HOT, COVERED, MASK_BITS = 20_000, 1000, 0.99, 14
#: Fingerprints whose copies leave a large trie before it is compared whole; rows of a block beside a drawn fingerprint, and of one of a whole trie; rows compared with a block at a time.
STARS, PACKED, GRID, TILE = 2, 500, 2000, 128
#: Bytes of a text split into words at a time; shingles counted at a time; bits of the fingerprints of tries and node pairs walked at a time.
BLOCK, COUNTED, TRIE_BITS, FRONTIER = 1 << 20, 4096, 4_000_000, 1 << 16
_SPREAD, _LANES = np.uint64(0x9E3779B97F4A7C15), WIDE // 64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _blocks(data: bytes, carry: int) -> Iterator[list[bytes]]:
    """Words of data, a block at a time; each block begins with the last `carry` words before it."""
    at, kept = 0, []
    while at < len(data):
        end = len(data)
        if end - at > BLOCK:
            gap = _SPACE.search(data, at + BLOCK)
            end = gap.start() if gap else end
        words = kept + data[at:end].split()
        yield words
        kept, at = words[-carry:] if carry else [], end


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a UTF-8 text: bit i is set if it is in over half the shingles' hashes.

    Letters A-Z count as a-z; white space is ASCII's. A text of fewer words is one
    shingle; a text without words has fingerprint 0.
    """
    ones, n, first = np.zeros(64, np.int64), 0, None
    for block in _blocks(data.lower(), words - 1):
        first = block
        if len(block) < words:
            continue
        joined = b" ".join(block)
        sizes = np.fromiter(map(len, block), np.int64, len(block))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(block) - words + 1].tolist()
        digest = xxhash.xxh64_intdigest
        got = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        ones += np.unpackbits(got.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(starts)
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(first), seed) if first else 0
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def _hook(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after linking i with j, and which of these pairs made a forest; a label is the smallest index linked."""
    used = [np.zeros(0, np.int64)]
    while True:
        a, b = labels[i], labels[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        differ = np.flatnonzero(low != high)
        if not len(differ):
            return labels, np.concatenate(used)
        order = differ[np.lexsort((low[differ], high[differ]))]
        first = order[np.r_[True, high[order[1:]] != high[order[:-1]]]]
        labels[high[first]] = low[first]
        used.append(first)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def trie_links(bucket: np.ndarray, fp: np.ndarray, bits: int = BITS) -> np.ndarray:
    """For each row, the index of its component's first row; arguments as for trie_walk()."""
    return trie_walk(bucket, fp, bits)[0]


def trie_walk(bucket: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(labels, i, j, node pairs walked): a row's label is its component's first row; the links i, j span the components.

    Rows are sorted by (bucket, fp) and distinct within a bucket; fp holds 64 bits a row,
    or several 64-bit words, the first the most significant.
    """
    fp = fp.reshape(len(fp), -1)
    n, width = len(fp), 64 * fp.shape[1]
    labels = np.arange(n)
    edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    many = hi - lo > 1
    root = (lo[many], hi[many], lo[many], hi[many], np.zeros(many.sum(), np.int16))
    changes = None  # running count of label changes: a range is of one label if it does not grow
    ones = [None] * width
    stack = [(0, root)]
    links, walked = [(np.zeros(0, np.int64),) * 2], 0
    while stack:
        depth, (al, ah, bl, bh, diff) = stack.pop()
        if changes is not None and len(al):
            one = (changes[ah - 1] == changes[al]) & (changes[bh - 1] == changes[bl]) & (labels[al] == labels[bl])
            al, ah, bl, bh, diff = (x[~one] for x in (al, ah, bl, bh, diff))
        if not len(al):
            continue
        if len(al) > FRONTIER:
            half = len(al) // 2
            stack += [(depth, tuple(x[half:] for x in (al, ah, bl, bh, diff))), (depth, tuple(x[:half] for x in (al, ah, bl, bh, diff)))]
            continue
        walked += len(al)
        leaf = (ah - al == 1) & (bh - bl == 1)
        if leaf.any():
            i, j = al[leaf], bl[leaf]
            near = (i != j) & (np.bitwise_count(fp[i] ^ fp[j]).sum(1, dtype=np.int64) <= bits)
            if near.any():
                i, j = i[near], j[near]
                labels, used = _hook(labels, i, j)
                links.append((i[used], j[used]))
                changes = np.cumsum(np.r_[False, labels[1:] != labels[:-1]])
            al, ah, bl, bh, diff = (x[~leaf] for x in (al, ah, bl, bh, diff))
        if not len(al) or depth == width:
            continue
        if ones[depth] is None:
            ones[depth] = np.r_[0, np.cumsum((fp[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1))].astype(np.int32)
        c = ones[depth]
        am, bm = ah - (c[ah] - c[al]), bh - (c[bh] - c[bl])
        own = al == bl  # a node with itself: its two children, and the pair of them
        cross = ~own
        parts = [(al, am, bl, bm, diff), (al, am, bm, bh, diff + 1), (am, ah, bm, bh, diff), tuple(x[cross] for x in (am, ah, bl, bm, diff + 1))]
        nl, nh, ml, mh, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        keep = (nl < nh) & (ml < mh) & (d <= bits) & ~((nl == ml) & (nh - nl == 1))
        stack.append((depth + 1, (nl[keep], nh[keep], ml[keep], mh[keep], d[keep])))
    return labels, *(np.concatenate(x) for x in zip(*links, strict=True)), walked


def _by_bucket(batches: Iterator[pa.RecordBatch], solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], most: int) -> Iterator[pa.RecordBatch]:
    """solve() over whole tries (bucket), by which the batches are sorted, some `most` rows at a time."""
    held, rows = [], 0
    for batch in (b.slice(k, most) for b in batches for k in range(0, b.num_rows, most)):
        held.append(batch)
        rows += batch.num_rows
        if rows >= most:  # all tries but the last are whole
            b = batch.column("bucket").to_numpy()
            last = np.flatnonzero(b != b[-1])
            if len(last):
                yield from solve(pa.Table.from_batches([*held[:-1], batch.slice(0, last[-1] + 1)]))
                held = [batch.slice(last[-1] + 1)]
                rows = held[0].num_rows
    if rows:
        yield from solve(pa.Table.from_batches(held))


def _linked_pairs(u: np.ndarray, v: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(u):
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def _linked(names: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[pa.RecordBatch]:
    yield from _linked_pairs(names[i], names[j])


def _joined(keyed: DataFrame, solve: Callable[[pa.Table], Iterator[pa.RecordBatch]], width: int, *order: str) -> DataFrame:
    """(u, v) of the tries of keyed, whose rows are dealt by bucket and sorted; width: bits of a fingerprint."""
    most = max(1, TRIE_BITS // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        yield from _by_bucket(batches, solve, most)

    return keyed.repartition("bucket").sortWithinPartitions("bucket", *order).mapInArrow(run, "u long, v long").distinct()


def _hot(keyed: DataFrame, least: int) -> DataFrame | None:
    """(bucket) of more than `least` rows, as a table; None if there is none."""
    hot = cut(keyed.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > least).select("bucket", F.lit(True).alias("hot")), few=True)
    return None if hot.isEmpty() else hot


def near_links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links that span the components of distinct fingerprints (fp long) at most `bits` bits apart.

    A trie of more than HOT rows is split in the same way again: what is left of the
    fingerprints beside its block has `bits + 1` blocks, of which near ones share one.
    """
    width = 64 // (bits + 1)
    rest = 64 - width
    inner = rest // (bits + 1)
    block = F.explode(F.sequence(F.lit(0), F.lit(bits)))

    def value(of: str, at: str, wide: int) -> Column:
        return F.expr(f"shiftrightunsigned({of}, {at} * {wide})").bitwiseAND(F.lit((1 << wide) - 1))

    keyed = fps.select("fp", block.alias("block")).select("fp", "block", F.xxhash64("block", value("fp", "block", width)).alias("bucket"))
    hot = _hot(keyed, HOT)
    if hot is not None:
        marked = join_splittable(keyed, hot, "bucket")
        low = F.expr(f"fp & (shiftleft(1L, block * {width}) - 1)")
        above = F.expr(f"if(block = {bits}, 0L, shiftleft(shiftrightunsigned(fp, least(63, (block + 1) * {width})), block * {width}))")
        split = marked.where("hot").select("fp", "bucket", low.bitwiseOR(above).alias("rest"), block.alias("inner"))
        split = split.select("fp", F.lit(0).alias("block"), F.xxhash64("bucket", "inner", value("rest", "inner", inner)).alias("bucket"))
        keyed = marked.where("hot is null").select("fp", "block", "bucket").unionByName(split)

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        fp, bucket = t["fp"].to_numpy().astype(np.int64).view(np.uint64), t["bucket"].to_numpy()
        order = np.lexsort((fp, bucket))
        fp, bucket = fp[order], bucket[order]
        _, i, j, _ = trie_walk(bucket, fp, bits)
        yield from _linked(fp.view(np.int64), i, j)

    return _joined(keyed.select("fp", "bucket"), solve, 64)


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int, bits: int) -> DataFrame:
    """(id, h64, fp, root, component_id) for each row; root is the smallest fingerprint linked."""
    keyed = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h64"), F.col(text_col).alias("text"))

    def make():
        return lambda texts: [{"fp": (fingerprint(t, words) ^ (1 << 63)) - (1 << 63)} for t in texts]

    marked = cut(text_pass(keyed, make, "fp long", "text", ["id", "h64"]), few=True)
    fps = cut(marked.groupBy("fp").agg(F.min("id").alias("low")))
    roots = connected_components(near_links(fps, bits))
    tied = roots.join(fps, roots.node == fps.fp).select("fp", "root", "low")
    ids = tied.groupBy("root").agg(F.min("low").alias("component_id"))
    named = fps.join(tied.join(ids, "root").select("fp", "root", "component_id"), "fp", "left")
    named = named.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("component_id", "low").alias("component_id"))
    return join_splittable(marked, named, "fp")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bits: int = BITS) -> DataFrame:
    """(id, fp, component_id) for each row: component_id is the smallest id reachable by links.

    Rows link if their fingerprints differ in at most `bits` bits, equal ones included.
    A null id takes part with its text but is never a component_id unless all are null.
    Null texts count as empty, which have fingerprint 0 and link like any other; long texts
    are read whole, a block at a time. Repeated rows stay repeated. An empty table gives no
    rows, other columns play no part.
    """
    return _classes(docs, id_col, text_col, words, bits).select(F.col("id").alias(id_col), "fp", "component_id")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, _LANES + 1, dtype=np.uint64) * _SPREAD)


def shingle_set(data: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct 64-bit hashes of a UTF-8 text's shingles, ascending.

    Letters A-Z count as a-z; white space and punctuation are ASCII's, the latter a word
    only in texts of nothing else. A text of fewer words is one shingle, one without any has none.
    """
    found, first = [], None
    plain = data.translate(_PLAIN)
    for block in _blocks(plain if plain.strip() else data, words - 1):
        first = block
        h = np.fromiter(map(xxhash.xxh64_intdigest, block), np.uint64, len(block))
        n = len(h) - words + 1
        if n > 0:
            total = h[:n].copy()
            for k in range(1, words):
                total = _mix(total * _SPREAD + h[k : k + n])
            found.append(np.unique(total))
    if not found:
        return np.array([xxhash.xxh64_intdigest(b" ".join(first), SEED)] if first else [], np.uint64)
    return np.unique(np.concatenate(found)) if len(found) > 1 else found[0]


def wide_fingerprint(shingles: np.ndarray) -> tuple[bytes, list[int]]:
    """The SimHash of a set of shingles in WIDE bits, and the ANCHORS min-wise hashes of the set."""
    ones, least = np.zeros(WIDE, np.int64), np.full(ANCHORS, ~np.uint64(0))
    for at in range(0, len(shingles), COUNTED):
        lanes = _mix(shingles[at : at + COUNTED, None] ^ _SEEDS)
        ones += np.unpackbits(lanes.view(np.uint8), axis=1).sum(0, dtype=np.uint32)
        least = np.minimum(least, lanes[:, :ANCHORS].min(0))
    return np.packbits(ones * 2 > len(shingles)).tobytes(), least.view(np.int64).tolist() if len(shingles) else []


def covering(differ: int, width: int, wide: int = WIDE, sure: float = COVERED) -> int:
    """Masks of `width` bits drawn at random of `wide` that fingerprints `differ` bits apart need to agree on one with a chance of `sure`."""
    agree = math.prod((wide - differ - k) / (wide - k) for k in range(width))
    return math.ceil(math.log(1 - sure) / math.log1p(-agree)) if agree < 1 else 1


def mask_width(n: int) -> int:
    """Bits of a mask for a trie of n rows: as many as part unrelated rows into tries of at most half of SPLIT_HOT."""
    return min(MASK_BITS, max(1, math.ceil(math.log2(2 * n / SPLIT_HOT))))


def mask_codes(fp: np.ndarray, width: int, masks: int, turn: int = 0) -> Iterator[np.ndarray]:
    """For each mask, a number of the bits of each fingerprint (rows of bytes) under it."""
    rng = np.random.default_rng([SEED, turn, width])
    bits = np.unpackbits(fp, axis=1)
    for _ in range(masks):
        at = rng.choice(bits.shape[1], width, replace=False)
        yield bits[:, at].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def _sized(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (bucket, f, fp, ...) of tries of 2 to SPLIT_HOT rows; those of larger ones with their size n, as a table, or None."""
    rows = cut(rows, few=True)
    sizes = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    met = join_splittable(rows, sizes, "bucket", "inner")
    large = not sizes.where(F.col("n") > SPLIT_HOT).isEmpty()
    return met.where(F.col("n") <= SPLIT_HOT), met.where(F.col("n") > SPLIT_HOT) if large else None


def _star(rows: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(links, rest) of tries (bucket, f, fp): those near one fingerprint of a trie, drawn by hash, link to it and leave; the rest goes on.

    No link is lost: what stays is near one that leaves only if it is within twice the
    budget of the drawn one, and these are compared with all that leave, block by block.
    No trie is gathered.
    """
    drawn = rows.groupBy("bucket").agg(F.min_by(F.struct("f", "fp"), F.xxhash64("bucket", "f")).alias("first")).select("bucket", F.col("first.f").alias("v"), F.col("first.fp").alias("vp"))
    met = join_splittable(rows, drawn, "bucket", "inner").select("bucket", "f", "fp", "v", "vp")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for b in batches:
            fp, vp = (np.frombuffer(b"".join(b.column(k).to_pylist()), ">u8").reshape(-1, _LANES) for k in (2, 4))
            apart = np.bitwise_count(fp ^ vp).sum(1, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(apart)], names=["bucket", "f", "fp", "v", "apart"])

    marked = cut(met.mapInArrow(measure, "bucket long, f long, fp binary, v long, apart int"), few=True)
    side = F.when(F.col("apart") <= bits, 0).when(F.col("apart") <= 2 * bits, 1)
    sides = marked.select("bucket", side.alias("side"), "f", "fp").where("side is not null")
    sizes = sides.groupBy("bucket").agg(*[F.ceil(F.count_if(F.col("side") == k) / PACKED).cast("int").alias(f"n{k}") for k in (0, 1)]).where("n1 > 0")
    placed = join_splittable(sides, sizes, "bucket", "inner").withColumn("chunk", F.pmod(F.hash("f"), F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1"))))
    packs = cut(placed.groupBy("bucket", "side", "chunk").agg(F.collect_list("f").alias("fs"), F.collect_list("fp").alias("fps")), few=True)
    pair = join_splittable(packs.where("side = 0").select("bucket", "fs", "fps"), packs.where("side = 1").groupBy("bucket").agg(F.collect_set("chunk").alias("chunks")), "bucket", "inner")
    pair = pair.withColumn("chunk", F.explode("chunks")).join(packs.where("side = 1").select("bucket", "chunk", F.col("fs").alias("gs"), F.col("fps").alias("gps")), ["bucket", "chunk"]).select("fs", "fps", "gs", "gps")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for b in batches:
            for k in range(b.num_rows):
                inner, outer = (np.frombuffer(b"".join(b.column(c)[k].as_py()), np.uint64).reshape(-1, _LANES) for c in (1, 3))
                f, g = (np.array(b.column(c)[k].as_py(), np.int64) for c in (0, 2))
                near = np.stack([np.bitwise_count(inner ^ o).sum(1, dtype=np.int32) <= bits for o in outer])
                some = np.flatnonzero(near.any(1))  # one link into what leaves is enough, for that is linked
                yield from _linked_pairs(g[some], f[near[some].argmax(1)])

    links = marked.where(F.col("apart") <= bits).select(F.col("f").alias("u"), "v").unionByName(pair.mapInArrow(compare, "u long, v long"))
    return links, marked.where(F.col("apart") > bits).select("bucket", "f", "fp")


def near_pairs(a: np.ndarray, b: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j): all rows a[i] and b[j] of 64-bit words at most `bits` bits apart, some rows of a at a time.

    The first half of the words is compared alone: what differs there in more bits differs.
    """
    half = a.shape[1] // 2
    first = np.ascontiguousarray(b[:, :half].T)
    for at in range(0, len(a), TILE):
        x = a[at : at + TILE]
        apart = np.zeros((len(x), len(b)), np.uint16)
        for k in range(half):
            apart += np.bitwise_count(x[:, k, None] ^ first[k])
        i, j = np.nonzero(apart <= bits)
        near = apart[i, j] + np.bitwise_count(x[i, half:] ^ b[j, half:]).sum(1, dtype=np.int32) <= bits
        yield at + i[near], j[near]


def _compared(rows: DataFrame, bits: int) -> DataFrame:
    """(u, v): links that span the components of tries (bucket, f, fp), each row compared with each other one of its trie.

    A trie is dealt into blocks by hash, and each pair of blocks is one row: no trie is
    gathered, and none is too large. The work is the square of a trie's rows.
    """
    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / GRID).cast("int").alias("m"))
    placed = join_splittable(rows, sizes, "bucket", "inner").withColumn("chunk", F.pmod(F.hash("f"), "m"))
    packs = cut(placed.groupBy("bucket", "m", "chunk").agg(F.collect_list("f").alias("fs"), F.collect_list("fp").alias("fps")), few=True)
    # Block c meets c, c + 1, ... c + m / 2 round a circle of m: each pair of blocks once, each block as often as any other.
    step = F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 2).cast("int"))).alias("step")
    left = packs.select("*", step).where("2 * step < m or chunk < step").withColumn("other", F.expr("pmod(chunk + step, m)"))
    right = packs.select("bucket", F.col("chunk").alias("other"), F.col("fs").alias("gs"), F.col("fps").alias("gps"))
    pair = left.join(right, ["bucket", "other"]).select("fs", "fps", "gs", "gps", (F.col("step") == 0).alias("own"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for b in batches:
            for k in range(b.num_rows):
                one, two = (np.frombuffer(b"".join(b.column(c)[k].as_py()), np.uint64).reshape(-1, _LANES) for c in (1, 3))
                f, g = (np.array(b.column(c)[k].as_py(), np.int64) for c in (0, 2))
                own = b.column(4)[k].as_py()
                names = f if own else np.r_[f, g]
                labels = np.arange(len(names))
                for i, j in near_pairs(one, two, bits):
                    i, j = (i[i < j], j[i < j]) if own else (i, j + len(f))
                    labels, used = _hook(labels, i, j)
                    yield from _linked(names, i[used], j[used])

    return pair.mapInArrow(compare, "u long, v long")


def _split(rows: DataFrame, bits: int) -> tuple[DataFrame, list[DataFrame]]:
    """(bucket, f, fp) of the tries of rows (bucket, f, fp, n) that are small, and the links of those of more than SPLIT_HOT rows.

    The size of a trie decides how it is walked, never which links are found. Of a large
    trie first the copies of one text leave, see _star(), a few times; what is still large
    is compared pair by pair in blocks, see _compared().
    """
    links: list[DataFrame] = []
    out = rows.where(F.col("n") <= SPLIT_HOT).select("bucket", "f", "fp")
    large = cut(rows.where(F.col("n") > SPLIT_HOT).select("bucket", "f", "fp"), few=True)
    for _ in range(STARS):
        found, rest = _star(large, bits)
        links.append(found)
        fine, large = _sized(rest)
        out = out.unionByName(fine.select("bucket", "f", "fp"))
        if large is None:
            return out, links
    return out, [*links, _compared(large.select("bucket", "f", "fp"), bits)]


def budget(least: float = LEAST) -> int:
    """Bits of WIDE in which fingerprints of cosine `least` may differ: each does with a chance of angle / pi.

    One standard deviation is added, so that of pairs just at the threshold five in six are found.
    """
    share = math.acos(least) / math.pi
    return round(WIDE * share + math.sqrt(WIDE * share * (1 - share)))


def wide_links(marked: DataFrame, least: float = LEAST) -> DataFrame:
    """(u, v): links between fingerprints (f, fp, anchors) whose bits tell a cosine of `least` or more; they span the components.

    f names a fingerprint, anchors are the min-wise shingles of its text. Fingerprints
    that share an anchor are in one trie. Two sets of Jaccard j share none with a chance
    of (1 - j) ** ANCHORS; at a cosine of 0.8 j is two thirds, the chance 0.0014.
    """
    bits = budget(least)
    keys = cut(marked.select("f", F.explode("anchors").alias("bucket")).distinct(), few=True)
    met = cut(keys.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), few=True)
    rows = cut(join_splittable(keys, met, "bucket", "inner"), few=True)
    fps = marked.select("f", "fp").join(rows.select("f").distinct(), "f", "left_semi").dropDuplicates(["f"])
    rows = rows.join(fps, "f")
    stars: list[DataFrame] = []
    if not met.where(F.col("n") > SPLIT_HOT).isEmpty():
        rows, stars = _split(rows, bits)

    def solve(t: pa.Table) -> Iterator[pa.RecordBatch]:
        fp = np.frombuffer(b"".join(t["fp"].to_pylist()), ">u8").astype(np.uint64).reshape(-1, _LANES)
        bucket, names = t["bucket"].to_numpy(), t["f"].to_numpy()
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (fp[1:] != fp[:-1]).any(1)]  # equal ones link as one row
        at = np.flatnonzero(new)
        row = np.cumsum(new) - 1
        same = np.flatnonzero(~new)
        yield from _linked(names, same, at[row[same]])
        _, i, j, _ = trie_walk(bucket[at], fp[at], bits)
        yield from _linked(names, at[i], at[j])

    return reduce(DataFrame.unionByName, stars, _joined(rows.select("bucket", "f", "fp"), solve, WIDE, "fp")).where("u <> v")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """docs, all columns, with one row of each group of near copies: that of the smallest id.

    Rows link if SimHash fingerprints of the sets of their five-word shingles, WIDE bits,
    tell a similarity of `least` or more: their cosine, which is what SimHash estimates, to
    about 0.02, with which the budget of bits reckons. Equal sets always link. Links are transitive.
    Null texts count as empty, and all texts without words are one group; texts of fewer
    than five words are one shingle. Repeated rows are copies; an empty table stays empty.
    """
    keyed = docs.select(F.col(id_col).alias("id"), text_hash(text_col).alias("h64"), F.col(text_col).alias("text"))

    def one(text: bytes) -> dict:
        found = shingle_set(text)
        fp, anchors = wide_fingerprint(found)
        return {"f": xxhash.xxh3_64_intdigest(found.tobytes(), SEED) - (1 << 63), "fp": fp, "anchors": anchors}

    marked = cut(text_pass(keyed, lambda: lambda texts: [one(t) for t in texts], "f long, fp binary, anchors array<long>", "text", ["id", "h64"]), few=True)
    roots = connected_components(wide_links(marked, least)).select(F.col("node").alias("f"), "root")
    rows = join_splittable(marked.select("id", "h64", "f"), roots, "f").select("id", "h64", F.coalesce("root", "f").alias("class"))
    return keep_one_of_each(docs, cut(rows, few=True), id_col, text_col)


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
