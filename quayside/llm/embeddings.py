"""Near-duplicate embeddings: int8 tile products with rigorous error bounds, full precision where they cannot decide.

Equal vectors of a label are one class first. Classes go to the nearest of their label's centres, which are classes
picked by a hash. A vector y whose nearest centre is b can reach across the plane between b and another centre a only if
it stands within the threshold's angle of it, y (b - a) / |b - a| <= sin(angle), so it is sent to the cells of those
centres alone, and of two cells the one that comes first compares their vectors: no link is lost, none is found twice.
Cells are cut into tiles by a hash, and every pair of tiles is multiplied in one task. A unit vector u is s q + e, with q
of int8 and the norm of e known, so that the product of s q and t r is off by at most |e| (1 + |f|) + |f|; pairs above
the threshold by more than that are links, pairs below it by more are none, and only the pairs between are recomputed in
full precision. A task returns, for each vector with a link, the number of links and one edge to the smallest vector it
reaches inside the task: never the pairs themselves.

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, or has no label, links
with nothing, and vectors of different lengths do not link; very large and very small components are scaled first; an
empty table gives an empty result; repeated rows are copies; a vector without an id links and is counted like any other,
and names a group only where nothing in it has an id (then null); an id that stands for several vectors is judged vector by
vector; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.components import components
from quayside.plans.runtime import materialize

#: Classes to a tile on average, centres of all labels together at most (they go to every task), pairs recomputed at once.
TILE, CENTRES, RECOMPUTE = 1024, 8192, 50_000
#: Products of vectors and centres that a task holds, and copies of vectors that it passes on at once.
PRODUCTS, VISITORS = 2_000_000, 20_000


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Each row by a power of two, its largest component then between 1/2 and 1."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


class Quantised:
    """Vectors as int8 with a scale each, and the norm of what that leaves."""

    def __init__(self, vectors: np.ndarray):
        vectors = scaled(vectors)
        self.full, self.norm = vectors, np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
        unit = vectors / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.codes = np.rint(unit / self.scale[:, None]).astype("int8")
        self.error = np.linalg.norm(unit - self.codes * self.scale[:, None], axis=1) + 1e-12

    def links(self, other: Quantised, threshold: float) -> np.ndarray:
        """Boolean matrix: cosine of at least threshold."""
        # sums of products of int8 are whole numbers, which floating point holds exactly up to 2^24 or 2^53
        kind = "float32" if self.codes.shape[1] * 127 * 127 < 1 << 24 else "float64"
        near = (self.codes.astype(kind) @ other.codes.astype(kind).T).astype("float64") * self.scale[:, None] * other.scale
        bound = self.error[:, None] * (1 + other.error) + other.error + 1e-9
        sure = near - bound >= threshold
        a, b = np.nonzero((near + bound >= threshold) & ~sure)
        for k in range(0, len(a), RECOMPUTE):
            i, j = a[k : k + RECOMPUTE], b[k : k + RECOMPUTE]
            sure[i, j] = np.einsum("ij,ij->i", self.full[i], other.full[j]) / (self.norm[i] * other.norm[j]) >= threshold
        return sure


def smallest_reached(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each vector the smallest id it reaches, by passing minima along links and jumping to what the minimum knows."""
    order = np.argsort(ids, kind="stable")
    links = links[np.ix_(order, order)]
    low = np.arange(len(ids))
    while True:
        neighbour = np.where(links, low[None, :], len(ids)).min(axis=1, initial=len(ids))
        new = np.minimum(low, neighbour)
        new = new[new]
        if (new == low).all():
            break
        low = new
    out = np.empty(len(ids), ids.dtype)
    out[order] = ids[order][low]
    return out


def tile_pair(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rep")
        one = key[3] == key[4]
        left = rows[rows["tile"] == key[3]]
        right = left if one else rows[rows["tile"] == key[4]]
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": [], "links": [], "root": []})
        part = lambda df: Quantised(np.stack(df["embedding"].to_numpy()).astype("float64"))
        u = part(left)
        linked = u.links(u if one else part(right), threshold)
        ids, copies = left["rep"].to_numpy(), left["copies"].to_numpy()
        if one:
            np.fill_diagonal(linked, False)
            matrix, counts = linked | linked.T, linked @ copies
        else:
            n, m = linked.shape
            matrix = np.zeros((n + m, n + m), bool)
            matrix[:n, n:], matrix[n:, :n] = linked, linked.T
            counts = np.concatenate([linked @ right["copies"].to_numpy(), linked.T @ copies])
            ids = np.concatenate([ids, right["rep"].to_numpy()])
        some = counts > 0
        ids, counts, matrix = ids[some], counts[some], matrix[np.ix_(some, some)]
        return pd.DataFrame({"rep": ids, "links": counts, "root": smallest_reached(matrix, ids)})

    return run


def chosen_centres(classes: DataFrame, sizes: DataFrame) -> dict[tuple, np.ndarray]:
    """Unit vectors, one for about TILE classes of a label, by label and length; none for labels that a tile holds."""
    total = sizes.agg(F.sum("n")).first()[0] or 0
    share = F.least(F.lit(1 << 30), F.lit(1 << 30) / F.lit(max(TILE, total / CENTRES))).cast("long")
    large = classes.join(sizes.where(F.col("n") > TILE).select("label", "size").hint("merge"), ["label", "size"], "left_semi")
    picked = large.where(F.pmod(F.xxhash64(F.lit(11), "rep"), F.lit(1 << 30)) < share).select("label", "size", "rep", "embedding")
    found: dict[tuple, list] = {}
    for r in picked.orderBy("rep").limit(2 * CENTRES).collect():  # about CENTRES rows; fewer centres only prune less
        found.setdefault((r.label, r.size), []).append(r.embedding)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return {k: unit(scaled(np.array(v, "float64"))) for k, v in found.items()}


def cells_of(unit: np.ndarray, centres: np.ndarray, sine: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's own cell, and the pairs of a vector and an earlier cell that it may have links in."""
    dots = unit @ centres.T
    home = dots.argmax(axis=1)
    near = np.arange(len(centres)) < home[:, None]
    if sine is not None:
        apart = np.sqrt(np.maximum(2 - 2 * centres @ centres.T, 0))
        near &= dots[np.arange(len(unit)), home][:, None] - dots <= sine * apart[home] + 1e-9
    return home, *np.nonzero(near)


def in_cells(classes: DataFrame, centres: dict[tuple, np.ndarray], threshold: float) -> DataFrame:
    """A row of each class for its own cell, and one for every other cell it may have links in."""
    sine = math.sqrt(1 - threshold * threshold) if 0 < threshold <= 1 else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, group in rows.groupby(["label", "size"], sort=False):
                step = max(1, PRODUCTS // len(centres[key]))
                for k in range(0, len(group), step):
                    part = group.iloc[k : k + step]
                    unit = scaled(np.stack(part["embedding"].to_numpy()).astype("float64"))
                    home, row, cell = cells_of(unit / np.linalg.norm(unit, axis=1, keepdims=True), centres[key], sine)
                    yield part.assign(cell=home.astype("int32"), own=True)
                    for a in range(0, len(row), VISITORS):
                        yield part.iloc[row[a : a + VISITORS]].assign(cell=cell[a : a + VISITORS].astype("int32"), own=False)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in classes.schema) + ", cell int, own boolean"
    return classes.mapInPandas(run, schema)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors."""
    read = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    classes = read.where(usable).groupBy("label", "embedding").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"))
    # a class has a number of its own: ids may be missing, or stand for several vectors
    classes = materialize(classes.withColumns({"size": F.size("embedding"), "rep": F.monotonically_increasing_id()}), "vector-classes")

    sizes = classes.groupBy("label", "size").agg(F.count("*").alias("n"))
    centres = chosen_centres(classes, sizes)
    one_cell = lambda df: df.withColumns({"cell": F.lit(0), "own": F.lit(True)})
    if centres:
        several = classes.sparkSession.createDataFrame(list(centres), classes.select("label", "size").schema)
        known = F.broadcast(several)  # at most a row per centre
        placed = one_cell(classes.join(known, ["label", "size"], "left_anti")).unionByName(in_cells(classes.join(known, ["label", "size"], "left_semi"), centres, threshold))
    else:
        placed = one_cell(classes)
    placed = materialize(placed, "vector-cells")
    key = ["label", "size", "cell"]
    # own vectors are in tiles 0 to own_tiles - 1, visitors in those after; visitors are not held against each other
    tiles = placed.groupBy(*key).agg(F.ceil(F.count_if("own") / TILE).cast("int").alias("own_tiles"), F.ceil(F.count_if(~F.col("own")) / TILE).cast("int").alias("visiting"))
    deal = F.xxhash64(F.lit(5), "rep")
    tile = F.when(F.col("own"), F.pmod(deal, F.col("own_tiles"))).otherwise(F.col("own_tiles") + F.pmod(deal, F.col("visiting")))
    dealt = placed.join(tiles.where("own_tiles > 0").hint("merge"), key).withColumn("tile", tile.cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("own"), F.col("own_tiles") + F.col("visiting")).otherwise(F.col("own_tiles")) - 1))
    paired = dealt.select(*key, "rep", "copies", "embedding", "tile", other.alias("other")).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    # dealt anew by tile pair: the join's partitioning by cell would satisfy the grouping and leave a cell in one task
    paired = paired.repartition(*key, "low", "high")
    found = materialize(paired.groupBy(*key, "low", "high").applyInPandas(tile_pair(threshold), "rep long, links long, root long"), "vector-links")

    linked = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = classes.join(counts.hint("merge"), "rep", "left").join(linked.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left")
    named = materialize(named.select("label", "embedding", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("group")), "named")
    lowest = named.groupBy("group").agg(F.min("low").alias("component"))
    named = named.join(lowest.hint("merge"), "group").select("label", "embedding", "n_links", "component", F.lit(True).alias("met"))
    # an unusable vector meets no class: its key is null
    keyed = read.select("vec_id", F.when(usable, F.col("label")).alias("label"), "embedding")
    out = keyed.join(named.hint("merge"), ["label", "embedding"], "left")
    component = F.when(F.col("met"), F.col("component")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
