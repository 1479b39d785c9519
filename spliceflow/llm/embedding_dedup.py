"""Near-duplicate embeddings: tiles in the order of the leading principal component, compared with early stops.

Vectors are scaled to length one and turned to their principal axes. Blocks of neighbours on the first axis are paired unless their ranges
there are too far apart for the threshold, and so are the tiles within two blocks. A pair of tiles accumulates the products of the leading
axes first; after each further stretch of axes the product of what is left of both lengths (Cauchy-Schwarz) bounds the cosine, and pairs
that can't reach the threshold any more are dropped. What remains at the end is computed in full, in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceflow.llm.common import components, cut, frame

THRESHOLD = 0.93
#: Bytes of the vectors of a block. A block is shuffled once for each block it may have links to, so larger blocks move less.
BLOCK_BYTES = 8 << 20
#: Vectors of a tile: products of tile pairs are made at once.
TILE = 512
#: Rows, those with the smallest hashes, from which the axes are taken. The axes only order the work; results don't depend on them.
AXES_ROWS = 4096
#: Axes of the first stretch; each further one is as long as all before it.
LEAD = 16
#: Share of a tile pair's products below which the pairs left are followed one by one.
SPARSE = 0.05
#: What a bound may lie below the threshold and still count as reaching it.
SLACK = 1e-4
_CELLS = 200


def _axes(vectors: DataFrame) -> np.ndarray | None:
    """Principal axes of the vectors of the commonest length in the sample, as columns by falling spread."""
    rows = vectors.select("v").orderBy("key", "other").limit(AXES_ROWS).collect()
    if not rows:
        return None
    lengths = [len(r["v"]) for r in rows]
    width = max(sorted(set(lengths)), key=lengths.count)
    x = np.array([r["v"] for r in rows if len(r["v"]) == width], dtype=float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    _, turned = np.linalg.eigh(x.T @ x)
    return turned[:, ::-1]


def _stretches(width: int) -> list[tuple[int, int]]:
    """From and to of the stretches of axes."""
    out, at = [], 0
    while at < width:
        out.append((at, min(width, max(LEAD, 2 * at))))
        at = out[-1][1]
    return out


class _Turned:
    """A block's unit vectors on the axes (on their own if they have another length), and the lengths of what each stretch leaves."""

    def __init__(self, vectors: np.ndarray, axes: np.ndarray):
        self.vectors, self.norms = vectors, np.linalg.norm(vectors, axis=1)
        unit = vectors / self.norms[:, None]
        at = unit @ axes if vectors.shape[1] == axes.shape[0] else unit
        squares = np.cumsum(at[:, ::-1] ** 2, axis=1)[:, ::-1]
        # Bounds in single precision: their error is far below the slack that is left to them.
        self.at, self.left = at.astype(np.float32), np.sqrt(np.column_stack([squares, np.zeros(len(vectors))])).astype(np.float32)

    def tiles(self) -> list[slice]:
        return [slice(k, k + TILE) for k in range(0, len(self.vectors), TILE)]


def _tile_links(p: _Turned, q: _Turned, s: slice, t: slice, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in the tiles s of p and t of q of the pairs that may reach the threshold."""
    a, b, ra, rb = p.at[s], q.at[t], p.left[s], q.left[t]
    low, i, j, held = np.float32(threshold - SLACK), None, None, None
    products = np.zeros((len(a), len(b)), dtype=np.float32)
    for begin, end in _stretches(a.shape[1]):
        if i is None:
            products += a[:, begin:end] @ b[:, begin:end].T
            alive = products + ra[:, end, None] * rb[None, :, end] >= low
            if end == a.shape[1] or alive.mean() < SPARSE:
                i, j = np.nonzero(alive)
                held = products[i, j]
        else:
            held = held + np.einsum("ij,ij->i", a[i, begin:end], b[j, begin:end])
            alive = held + ra[i, end] * rb[j, end] >= low
            i, j, held = i[alive], j[alive], held[alive]
        if i is not None and not len(i):
            break
    return i, j


def _links(p: _Turned, q: _Turned, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places in p and q of the pairs with a cosine of at least the threshold; for a block with itself (p is q) each pair once."""
    gap, found = _gap(threshold), [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))]
    for s in p.tiles():
        for t in q.tiles():
            if p is q and t.start < s.start:
                continue
            x, y = p.at[s, 0], q.at[t, 0]
            if x.min() > y.max() + gap or y.min() > x.max() + gap:
                continue
            i, j = _tile_links(p, q, s, t, threshold)
            i, j = i + s.start, j + t.start
            if p is q and s == t:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), 65_536):
                m, n = i[k : k + 65_536], j[k : k + 65_536]
                good = np.einsum("ij,ij->i", p.vectors[m], q.vectors[n]) / (p.norms[m] * q.norms[n]) >= threshold
                found.append((m[good], n[good]))
    return np.concatenate([m for m, _ in found]), np.concatenate([n for _, n in found])


def _gap(threshold: float) -> float:
    """How far apart two unit vectors that link can be, a little more for rounding."""
    return float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK


def _forest(i: np.ndarray, j: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same vectors as all links (i, j) do: each to the smallest of its group."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for x, y in zip(ids_a[i].tolist(), ids_b[j].tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, root(x)) for x in up if root(x) != x]


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors.

    Two rows link if their labels are equal and not null and their cosine is at least the threshold; vectors of different lengths
    never do. Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing, nor do those
    with a null label. Rows that repeat an id or a vector are vectors of their own (equal vectors link). component_id is the
    smallest id reachable, the row's own included; kept is vec_id = component_id. Null ids give null for both. An empty table gives
    an empty one; other columns aren't read. Components may have any finite size: vectors are scaled by a power of two first.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), v.alias("v"))
    finite = F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    # Equal vectors of a label are one representative with its number of rows, found by a digest of 128 bits of both.
    own = rows.select("vec_id", F.when(finite, F.struct("label", "v")).alias("own"))
    # A power of two to scale by, which changes no cosine: squares then neither overflow nor vanish.
    power = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.array_max(F.transform("own.v", lambda x: F.abs(x))))), F.lit(-1022)))
    keyed = cut(own.select("vec_id", "own", F.when(F.col("own").isNotNull(), F.xxhash64("own.label", "own.v")).alias("key"), F.when(F.col("own").isNotNull(), F.xxhash64(F.lit(1), "own.v", "own.label")).alias("other"), power.alias("power")))
    reps = cut(keyed.where("own is not null").groupBy("key", "other").agg(F.first("own").alias("own"), F.first("power").alias("power"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"), F.min("own").alias("lo"), F.max("own").alias("hi")))
    if reps.where("lo != hi").limit(1).count():
        raise ValueError("two different vectors share a digest of 128 bits")
    reps = cut(reps.select(F.monotonically_increasing_id().alias("rep"), "key", "other", F.col("own.label").alias("label"), F.transform("own.v", lambda x: x / F.col("power")).alias("v"), "copies", "least"))
    axes = _axes(reps)
    if axes is None:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), (F.col("vec_id") == F.col("vec_id")).alias("kept"))
    first = [float(x) for x in axes[:, 0]]
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    on_axis = F.aggregate(F.zip_with("v", F.array(*map(F.lit, first)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    on_first = F.when(F.size("v") == len(first), on_axis).otherwise(F.col("v")[0]) / norm
    # Cells of the first axis; small neighbours share a block and large ones are split by hash, so no block holds far more than its bytes.
    placed = reps.withColumns({"x": on_first, "width": F.size("v")}).withColumn("cell", F.floor(F.col("x") * _CELLS))
    cells = placed.groupBy("label", "width", "cell").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("label", "width").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    most = F.greatest(F.floor(F.lit(block_bytes) / (8 * F.col("width"))), F.lit(1))
    cells = cut(cells.select("label", "width", "cell", F.ceil(F.col("n") / most).alias("split"), F.floor((F.col("before") + F.col("n") / 2) / most).alias("part")))
    dealt = placed.join(cells, ["label", "width", "cell"]).withColumn("block", F.xxhash64("label", "width", "part", F.when(F.col("split") > 1, F.struct("cell", F.pmod("key", "split")))))

    schema = "block long, label string, width int, low double, high double, reps binary, copies binary, vectors binary"

    def bundle(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("x")
        vs = np.stack([np.asarray(x, dtype="<f8") for x in rows["v"]])
        out = (int(rows["block"].iloc[0]), rows["label"].iloc[0], vs.shape[1], rows["x"].min(), rows["x"].max(), rows["rep"].to_numpy("<i8").tobytes(), rows["copies"].to_numpy("<i8").tobytes(), vs.tobytes())
        return pd.DataFrame([out], columns=[c.split()[0] for c in schema.split(", ")])

    blocks = cut(dealt.select("block", "label", "x", "rep", "copies", "v").groupBy("block").applyInPandas(bundle, schema))
    gap = _gap(threshold)
    meta = cut(blocks.select("block", "label", "low", "high", "width"))
    pairs = meta.alias("a").join(meta.alias("b"), F.expr(f"a.label = b.label and a.width = b.width and a.block <= b.block and a.low <= b.high + {gap!r} and b.low <= a.high + {gap!r}")).select(F.col("a.block").alias("ta"), F.col("b.block").alias("tb"))
    # Each pair of blocks is a group of two rows (one for a block with itself).
    sides = cut(pairs).select("ta", "tb", F.explode(F.array_distinct(F.array("ta", "tb"))).alias("block")).join(blocks.select("block", "width", "reps", "copies", "vectors"), "block")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows.iloc[0], rows.iloc[-1]
        (ids_a, ca), (ids_b, cb) = ((np.frombuffer(x.reps, dtype="<i8"), np.frombuffer(x.copies, dtype="<i8")) for x in (p, q))
        a = _Turned(np.frombuffer(p.vectors, dtype="<f8").reshape(len(ids_a), -1), axes)
        b = a if len(rows) == 1 else _Turned(np.frombuffer(q.vectors, dtype="<f8").reshape(len(ids_b), -1), axes)
        i, j = _links(a, b, threshold)
        out: list[tuple] = []
        for ids, n in ((ids_a, np.bincount(i, weights=cb[j], minlength=len(ids_a))), (ids_b, np.bincount(j, weights=ca[i], minlength=len(ids_b)))):
            out += [(x, int(k), None) for x, k in zip(ids.tolist(), n, strict=True) if k]
        out += [(x, 0, y) for x, y in _forest(i, j, ids_a, ids_b)]
        return frame(out, "rep long, n long, root long")

    found = cut(sides.groupBy("ta", "tb").applyInPandas(compare, "rep long, n long, root long"))
    roots = cut(components(found.where("root is not null").select(F.col("rep").alias("u"), F.col("root").alias("v"))))
    direct = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.select("rep", "key", "other", "copies", "least").join(direct, "rep", "left").join(roots, F.col("rep") == F.col("node"), "left").select("key", "other", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("root"))
    known = cut(known)
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    told = cut(known.join(least, "root").select("key", "other", F.lit(True).alias("told"), "n_links", "component_id"))
    out = keyed.select("vec_id", "key", "other").join(told, ["key", "other"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("told"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
