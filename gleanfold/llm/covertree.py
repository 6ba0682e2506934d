"""Embedding near-duplicates by cover trees and dual traversal: exact threshold pairs of equal label.

Vectors are compared on the unit sphere, where cosine c is the distance sqrt(2 - 2c). Equal vectors of
a label are one class and are compared once. Spark holds the top of the tree: a label with more than ``node_rows``
classes is dealt to pivots (from a bounded sample, farthest first). A vector belongs to the cell of its nearest pivot, and visits
an earlier cell only if neither that cell's covering radius nor the plane between the two pivots rules out a partner there. So what
is shipped depends on each vector's own distances, not on pairs of cells. In a cell, blocks of at most about ``node_rows`` of its
own vectors meet each other and chunks of its visitors; in such a group two cover trees (nested levels,
radii halved from level to level) are traversed together, dropping child pairs by their covering radii.
A group returns link counts and a local spanning forest, never its pairs, so dense clusters stay linear.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize, release

#: Distances come from 1 less a dot product near 1, whose rounding is about 3e-8 after the root.
_EPS = 1e-6


def units(m):
    """Rows scaled to length 1; by their largest component first, so that no square over- or underflows."""
    import numpy as np

    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class CoverTree:
    """Nested cover tree over unit vectors; node 0 is the root, leaves hold their points."""

    def __init__(self, x, leaf_scale: float = 0.1, leaf_rows: int = 8):
        import numpy as np

        self.x = x
        self.center, self.radius, self.children, self.points = [], [], [], []
        todo = [(np.arange(len(x)), 0, 2.0, -1)]
        while todo:
            rows, center, scale, parent = todo.pop()
            me = len(self.center)
            gap = np.sqrt(np.maximum(0, 2 - 2 * (x[rows] @ x[center])))
            self.center.append(center)
            self.radius.append(float(gap.max()))
            self.children.append([])
            self.points.append(None)
            if parent >= 0:
                self.children[parent].append(me)
            if len(rows) <= leaf_rows or scale <= leaf_scale:
                self.points[me] = rows
                continue
            scale /= 2
            at = int(gap.argmin())  # a node's centre is a child's centre too
            while len(rows):
                c = int(rows[at])
                near = x[rows] @ x[c] >= 1 - scale * scale / 2
                near[at] = True
                todo.append((rows[near], c, scale, me))
                rows, at = rows[~near], 0
        self.center, self.radius = np.array(self.center), np.array(self.radius)


def traverse(a: CoverTree, b: CoverTree, limit: float):
    """Yield (rows of a, rows of b) of leaf pairs that may hold points within ``limit``; for a tree with itself, each pair once."""
    import numpy as np

    same = a is b
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        leaf_i, leaf_j = a.points[i] is not None, b.points[j] is not None
        if leaf_i and leaf_j:
            yield a.points[i], b.points[j], same and i == j
            continue
        left = [i] if leaf_i else a.children[i]
        right = [j] if leaf_j else b.children[j]
        gap = np.sqrt(np.maximum(0, 2 - 2 * (a.x[a.center[left]] @ b.x[b.center[right]].T)))
        keep = gap <= limit + _EPS + a.radius[left][:, None] + b.radius[right][None, :]
        if same and i == j:
            keep = np.triu(keep)
        for p, q in zip(*np.nonzero(keep)):
            todo.append((left[p], right[q]))


def link_group(x, y, n_x, n_y, threshold: float):
    """Links between rows of x and of y (or within x, if y is None): counts for both sides and a root for each row of both."""
    import numpy as np

    within = y is None
    ux = units(x)
    uy = ux if within else units(y)
    ta = CoverTree(ux)
    tb = ta if within else CoverTree(uy)
    shift = 0 if within else len(x)
    links = np.zeros(len(x) + (0 if within else len(y)), np.int64)
    root = list(range(len(links)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for p, q, self_pair in traverse(ta, tb, float(np.sqrt(max(0.0, 2 - 2 * threshold)))):
        hit = ux[p] @ uy[q].T >= threshold
        if self_pair:
            hit = np.triu(hit, 1)
        for i, j in zip(*np.nonzero(hit)):
            i, j = int(p[i]), int(q[j])
            links[i] += (n_x if within else n_y)[j]
            links[shift + j] += n_x[i]
            a, b = find(i), find(shift + j)
            if a != b:
                root[max(a, b)] = min(a, b)
    return links, [find(i) for i in range(len(root))]


def _farthest_first(sample, k: int):
    """k rows of the sample, each the farthest from those before it."""
    import numpy as np

    s = units(sample)
    picked, best = [0], s @ s[0]
    while len(picked) < min(k, len(s)):
        i = int(best.argmin())
        if best[i] > 1 - 1e-9:
            break
        picked.append(i)
        best = np.maximum(best, s @ s[i])
    return s[picked]


def embedding_components(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", node_rows: int = 2048, sample_rows: int = 4096) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only equal, non-null labels are compared, and only vectors of equal length. A vector that is null, empty or zero, or holds
    a null or non-finite component, links with nothing, as does one without an identifier. Copies link with
    each other. Rows that share an identifier are one vertex of the component graph. An empty table gives no rows. Other columns
    are ignored, whatever their names. Vectors are scaled by their largest component first, so tiny and huge ones compare rightly.
    """
    import numpy as np

    spark = vectors.sparkSession
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    valid = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & v.isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.withColumn("k1", F.when(valid, F.xxhash64("label", "v"))).withColumn("k2", F.when(valid, F.xxhash64("v", "label", F.lit(1))))
    keyed = rows.where("k1 IS NOT NULL")
    classes = materialize(keyed.groupBy("k1", "k2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("v").alias("v")).withColumn("dim", F.size("v")), "classes")

    crowded = {(r["label"], r["dim"]): r["count"] for r in classes.groupBy("label", "dim").count().where(F.col("count") > node_rows).collect()}  # at most 1/node_rows of the rows
    pivots = {}
    if crowded:
        sample = classes.select("label", "dim", "v").orderBy(F.xxhash64("rep")).limit(sample_rows).toPandas()
        for key, part in sample.groupby(["label", "dim"]):
            if key in crowded:
                pivots[key] = _farthest_first(np.array(part.v.tolist(), float), -(-crowded[key] // node_rows))
    kinds = dict(classes.dtypes)
    shape = f"rep long, n long, label {kinds['label']}, dim int, v {kinds['v']}, cell int"
    limit = float(np.sqrt(max(0.0, 2 - 2 * threshold)))

    def deal(batches):
        """Each vector's cell, that of its nearest pivot, and its distance to it."""
        for pdf in batches:
            cell, gap = np.zeros(len(pdf), np.int32), np.full(len(pdf), 2.0)
            for key, part in pdf.groupby(["label", "dim"]):
                if key in pivots:
                    dots = units(np.array(part.v.tolist(), float)) @ pivots[key].T
                    at = pdf.index.get_indexer(part.index)
                    cell[at], gap[at] = dots.argmax(axis=1), np.sqrt(np.maximum(0, 2 - 2 * dots.max(axis=1)))
            yield pdf.assign(cell=cell, gap=gap)[["rep", "n", "label", "dim", "v", "cell", "gap"]]

    cells = materialize(classes.select("rep", "n", "label", "dim", "v").mapInPandas(deal, shape + ", gap double"), "cells")
    reach = {}  # a cell's covering radius; at most sample_rows of them
    if pivots:
        for r in cells.where("cell > 0 OR gap < 2").groupBy("label", "dim", "cell").agg(F.max("gap").alias("radius")).collect():
            if (r["label"], r["dim"]) in pivots:
                reach[r["label"], r["dim"], r["cell"]] = r["radius"]

    def visits(batches):
        """The earlier cells in which a vector may have a partner: those that neither the covering radius nor the plane between the pivots rules out."""
        for pdf in batches:
            out = [()] * len(pdf)
            for key, part in pdf.groupby(["label", "dim"]):
                if key not in pivots:
                    continue
                p = pivots[key]
                dots = units(np.array(part.v.tolist(), float)) @ p.T
                home = part.cell.to_numpy()
                radius = np.array([reach.get((*key, c), -9.0) for c in range(len(p))])
                apart = np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T)))[home]
                ok = np.sqrt(np.maximum(0, 2 - 2 * dots)) <= radius + limit + _EPS
                ok &= dots[np.arange(len(home)), home][:, None] - dots <= limit * apart + _EPS
                ok &= np.arange(len(p))[None, :] < home[:, None]
                for i, row in zip(pdf.index.get_indexer(part.index), ok):
                    out[i] = np.flatnonzero(row).tolist()
            yield pdf.assign(visited=out)[["rep", "n", "label", "dim", "v", "cell", "visited"]]

    dealt = materialize(cells.drop("gap").mapInPandas(visits, shape + ", visited array<int>"), "dealt")
    release(cells)
    key = ["label", "dim", "cell"]
    guests = dealt.select("rep", "n", "label", "dim", "v", F.explode("visited").alias("cell"))
    sizes = dealt.select(*key, F.lit(1).alias("home")).unionByName(dealt.select("label", "dim", F.explode("visited").alias("cell"), F.lit(0).alias("home")))
    sizes = sizes.groupBy(*key).agg(F.sum("home").alias("homes"), F.count("*").alias("all")).where("homes > 0 AND all > 1")
    sizes = materialize(sizes.select(*key, F.ceil(F.col("homes") / node_rows).alias("kh"), F.ceil((F.col("all") - F.col("homes")) / node_rows).alias("kg")), "sizes")
    part = lambda a, b, kind, side: F.struct(a.alias("a"), b.alias("b"), F.lit(kind).alias("kind"), side.alias("side"))
    steps = lambda n: F.slice(F.sequence(F.lit(0).cast("long"), n), 1, n.cast("int"))
    own = F.pmod(F.xxhash64("rep", F.lit(3)), F.col("kh"))
    blocks = F.concat(F.transform(steps(F.col("kh")), lambda j: part(F.least(own, j), F.greatest(own, j), 0, (own > j).cast("int"))), F.transform(steps(F.col("kg")), lambda c: part(own, c, 1, F.lit(0))))
    chunk = F.pmod(F.xxhash64("rep", F.lit(5)), F.col("kg"))
    blocks2 = F.transform(steps(F.col("kh")), lambda j: part(j, chunk, 1, F.lit(1)))
    cols = [*key, "rep", "n", "v"]
    met = dealt.join(sizes, key).select(*cols, F.explode(blocks).alias("p")).unionByName(guests.join(sizes, key).select(*cols, F.explode(blocks2).alias("p")))
    met = met.select(F.xxhash64(*key, "p.a", "p.b", "p.kind").alias("pair"), (F.col("p.kind") == 0) .alias("homes"), (F.col("p.a") == F.col("p.b")).alias("same"), "p.side", "rep", "n", "v")

    def link(pdf):
        import pandas as pd

        first, second = pdf[pdf.side == 0], pdf[pdf.side == 1]
        alone = bool(pdf.homes.iloc[0] and pdf.same.iloc[0])
        none = pd.DataFrame({"rep": [], "links": [], "root": []}, dtype="int64")
        if not len(first) or not alone and not len(second):
            return none
        both = first if alone else pd.concat([first, second])
        y = None if alone else np.array(second.v.tolist(), float)
        links, root = link_group(np.array(first.v.tolist(), float), y, first.n.to_numpy(), second.n.to_numpy(), threshold)
        reps = both.rep.to_numpy()
        linked = links > 0
        return pd.DataFrame({"rep": reps[linked], "links": links[linked], "root": reps[np.array(root)][linked]})

    found = materialize(met.groupBy("pair").applyInPandas(link, "rep long, links long, root long"), "links")
    release(dealt, sizes)
    stars = connected_components(found.select(F.col("rep").alias("src"), F.col("root").alias("dst")))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links")).join(stars, F.col("rep") == F.col("node"), "left").select("rep", "links", "root")
    named = classes.select("k1", "k2", "rep", "n").join(linked, "rep", "left")
    return (
        rows.select("vec_id", "k1", "k2").join(named, ["k1", "k2"], "left")
        .select("vec_id", F.coalesce(F.col("links") + F.col("n") - 1, F.col("n") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "rep", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
