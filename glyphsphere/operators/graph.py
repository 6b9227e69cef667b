"""Graph and DAG operators as bounded loops of joins."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glyphsphere.sources.storage import cut


def descendants(children: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, node, depth, ordinal) of everything below ``roots`` (root); one row a path, the root itself at depth 0."""
    level = roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(0).cast("bigint").alias("ordinal"))
    out = level
    edges = children.select(F.col("parent").alias("node"), F.col("child"), F.col("ordinal").cast("bigint").alias("o"))
    for d in range(1, max_depth + 1):
        level = cut(level.join(edges, "node").select("root", F.col("child").alias("node"), F.lit(d).alias("depth"), F.col("o").alias("ordinal")))
        if not level.limit(1).count():
            break
        out = out.unionByName(level)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) in both directions. Edges are read once, and of both directions one is shuffled."""
    once = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    way = lambda src, dst: F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"))
    ways = F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))
    return once.select(F.explode(ways).alias("e")).select("e.*")


def shortest_paths(edges: DataFrame, start, most: int) -> DataFrame:
    """(node, hops, parent): breadth-first tree from ``start`` over directed (src, dst); of several parents the smallest."""
    seen = edges.sparkSession.createDataFrame([(start, 0, None)], edges.select(F.col("src").alias("node")).schema.simpleString()[7:-1].replace("node:", "node ") + ", hops int, parent " + edges.schema["src"].dataType.simpleString())
    frontier = seen
    for d in range(1, most + 1):
        step = frontier.select(F.col("node").alias("src")).join(edges.select("src", "dst"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
        frontier = cut(step.join(seen, "node", "left_anti").select("node", F.lit(d).alias("hops"), "parent"))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def expanded(edges: DataFrame, seeds: DataFrame, hops: int, k: int) -> DataFrame:
    """(node, hop): from ``seeds`` (node), each hop the ``k`` heaviest new neighbours of each frontier node."""
    seen = seeds.select("node", F.lit(0).alias("hop"))
    frontier = seen
    for h in range(1, hops + 1):
        w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
        near = edges.join(frontier.select(F.col("node").alias("src")), "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        near = near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k)
        frontier = cut(near.select(F.col("dst").alias("node")).distinct().withColumn("hop", F.lit(h)))
        if not frontier.limit(1).count():
            break
        seen = cut(seen.unionByName(frontier))
    return seen


def walks(edges: DataFrame, starts: DataFrame, steps: int) -> DataFrame:
    """(start, step, node): self-avoiding weighted walks, all at once. The next node has the largest
    ``u ** (1 / weight)``, where u in (0, 1) is a hash of start, step and node: a weighted draw that repeats exactly."""
    now = starts.select("start", F.col("start").alias("node"), F.array("start").alias("path"))
    for s in range(1, steps + 1):
        u = (F.pmod(F.xxhash64("start", F.lit(s), "dst"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        options = now.join(edges.select(F.col("src").alias("node"), "dst", "weight").filter("weight > 0"), "node").filter(~F.array_contains("path", F.col("dst")))
        best = options.withColumn("key", F.pow(u, 1.0 / F.col("weight"))).groupBy("start").agg(F.max(F.struct("key", "dst")).alias("b"))
        now = cut(now.join(best, "start", "left").select("start", F.coalesce("b.dst", "node").alias("node"), F.when(F.col("b.dst").isNull(), F.col("path")).otherwise(F.concat("path", F.array("b.dst"))).alias("path")))
    return now.select("start", F.posexplode("path").alias("step", "node"))


def components(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component): the smallest node that each node is connected with."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    for _ in range(most):
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        new = label.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = new.join(new.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.least("component", "next").alias("component"))
        jump = cut(jump)
        if not jump.join(label.withColumnRenamed("component", "old"), "node").filter("component <> old").limit(1).count():
            return jump
        label = jump
    raise RuntimeError(f"components need more than {most} steps")


def laplacian(edges: DataFrame) -> DataFrame:
    """(i, j, value): degree on the diagonal, minus the weight beside it; edges undirected, each once."""
    both = edges.select("src", "dst", "weight").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    degree = both.groupBy(F.col("src").alias("i")).agg(F.sum("weight").alias("value")).select("i", F.col("i").alias("j"), "value")
    return degree.unionByName(both.select(F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("weight")).alias("value")))


#: Nodes up to which the dense eigenproblem goes to the driver; beyond it the same eigenvectors come from Lanczos steps.
DENSE = 5000
#: Edges up to which the Laplacian goes to the driver as a sparse matrix, and bytes of the basis there; beyond it the steps are joins.
SPARSE, BASIS_BYTES = 4_000_000, 256 << 20


def _signed(v: np.ndarray) -> np.ndarray:
    """Columns whose largest entry is positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def spectral_coordinates(edges: DataFrame, dims: int = 4, dense: int = DENSE, sparse: int = SPARSE) -> DataFrame:
    """(node, c0..c3): the eigenvectors of the smallest non-trivial eigenvalues, signs fixed, orthonormal."""
    edges = cut(edges.select("src", "dst", "weight"))
    entries = laplacian(edges)
    nodes = [r[0] for r in entries.select("i").distinct().orderBy("i").limit(dense + 1).collect()]
    if len(nodes) > dense:
        return sparse_coordinates(edges, dims) if edges.count() <= sparse else lanczos_coordinates(edges, dims)
    at = {n: k for k, n in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for r in entries.collect():
        a[at[r["i"]], at[r["j"]]] += r["value"]
    values, vectors = np.linalg.eigh(a)
    v = _signed(vectors[:, [k for k in range(len(values)) if values[k] > 1e-9][:dims]])
    names = [f"c{k}" for k in range(v.shape[1])]
    return edges.sparkSession.createDataFrame([(n, *map(float, v[k])) for k, n in enumerate(nodes)], ["node", *names])


def sparse_coordinates(edges: DataFrame, dims: int = 4, most: int = 200, tolerance: float = 1e-6) -> DataFrame:
    """As ``lanczos_coordinates``, with the matrix and a basis of bounded bytes on the driver: when the basis is full, the best of its Ritz
    vectors begin the next one. It raises after ``most`` full bases."""
    table = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).toArrow()
    src, dst, weight = (table[c].to_numpy() for c in ("src", "dst", "weight"))
    nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
    n, rows, cols, both = len(nodes), at, np.concatenate([at[len(src) :], at[: len(src)]]), np.concatenate([weight, weight])
    order = np.argsort(rows, kind="stable")
    rows, cols, both = rows[order], cols[order], both[order]
    degree = np.bincount(rows, both, n)
    product = lambda v: degree * v - np.bincount(rows, both * v[cols], n)
    size = int(max(8 * dims, min(n - 1, 600, BASIS_BYTES // (8 * n))))
    q, t = np.zeros((size + 1, n)), np.zeros((size, size))

    def orthogonal(w: np.ndarray, j: int) -> np.ndarray:
        for _ in range(2):
            w = w - w.mean()
            w = w - q[:j].T @ (q[:j] @ w)
        return w

    first = orthogonal(np.random.default_rng(1).uniform(-0.5, 0.5, n), 0)
    q[0], j, scale = first / np.linalg.norm(first), 0, 2 * degree.max()
    for _ in range(most):
        while True:
            w = product(q[j])
            t[j, j] = q[j] @ w
            w = orthogonal(w, j + 1)
            beta, j = np.linalg.norm(w), j + 1
            spent = j >= n - 1 or beta <= 1e-12 * scale
            if not spent:
                q[j] = w / beta
            if spent or j == size or j % 25 == 0:
                values, y = np.linalg.eigh(t[:j, :j])
                wanted = np.nonzero(values > 1e-9 * scale)[0][:dims]
                if spent or (len(wanted) == dims and (beta * np.abs(y[-1, wanted]) < tolerance * values[-1]).all()):
                    c = _signed((y[:, wanted].T @ q[:j]).T)
                    return edges.sparkSession.createDataFrame(pa.table([pa.array(nodes), *(pa.array(np.ascontiguousarray(x)) for x in c.T)], ["node", *(f"c{k}" for k in range(c.shape[1]))]))
            if j == size:
                break
            t[j, j - 1] = t[j - 1, j] = beta
        kept = min(size // 2, int(np.sum(values <= 1e-9 * scale)) + 4 * dims)
        q[:kept], q[kept] = y[:, :kept].T @ q[:size], q[size].copy()
        t[:] = 0
        t[range(kept), range(kept)] = values[:kept]
        t[kept, :kept] = t[:kept, kept] = beta * y[-1, :kept]
        j = kept
    raise RuntimeError(f"the eigenvectors need more than {most} bases of {size} vectors")


def lanczos_coordinates(edges: DataFrame, dims: int = 4, most: int = 300, tolerance: float = 1e-6) -> DataFrame:
    """As ``spectral_coordinates``, for any number of nodes: Lanczos steps with full orthogonalisation.

    The basis is one array a node, so a step is one join with the edges and two passes of sums; only these sums and the
    tridiagonal matrix, whose size is the number of steps, reach the driver. It ends when the residuals of the wanted
    vectors fall under ``tolerance`` times the largest eigenvalue, or when the basis spans all that the start can reach,
    and raises after ``most`` steps. Of equal eigenvalues one vector is found.
    """
    entries = cut(laplacian(edges).groupBy("i", "j").agg(F.sum("value").alias("value")))
    start = (F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) + 0.5) / float(1 << 40) - 0.5
    basis = entries.select(F.col("i").alias("node")).distinct().withColumn("q", F.array(start))
    n = entries.select("i").distinct().count()

    def norm(df: DataFrame, c) -> float:
        return float(df.agg(F.sqrt(F.sum(c * c))).first()[0])

    def orthogonal(df: DataFrame, j: int) -> DataFrame:
        """``w`` without its parts along the constant vector and the first j of the basis."""
        c = df.agg(F.sum("w"), *(F.sum(F.col("w") * F.col("q")[k]) for k in range(j))).first()
        along = F.zip_with("q", F.array(*(F.lit(float(x)) for x in c[1:])), lambda a, b: a * b) if j else F.array(F.lit(0.0))
        return df.withColumn("w", F.col("w") - c[0] / n - F.aggregate(along, F.lit(0.0), lambda a, x: a + x))

    first = orthogonal(basis.select("node", F.col("q")[0].alias("w"), F.array().cast("array<double>").alias("q")), 0)
    size = norm(first, F.col("w"))
    basis = cut(first.select("node", F.array(F.col("w") / size).alias("q")))
    diagonal, beside = [], []
    for j in range(1, most + 1):
        now = basis.select(F.col("node").alias("j"), F.col("q")[j - 1].alias("v"))
        product = entries.join(now, "j").groupBy(F.col("i").alias("node")).agg(F.sum(F.col("value") * F.col("v")).alias("w"))
        step = cut(basis.join(product, "node"))
        diagonal.append(float(step.agg(F.sum(F.col("w") * F.col("q")[j - 1])).first()[0]))
        step = cut(orthogonal(orthogonal(step, j), j))
        beta = norm(step, F.col("w"))
        values, y = np.linalg.eigh(np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1))
        scale = max(abs(values[-1]), 1e-300)
        wanted = np.nonzero(values > 1e-9 * scale)[0][:dims]
        spent = j >= n - 1 or beta <= 1e-12 * scale
        if spent or (len(wanted) == dims and j >= 4 * dims and (abs(beta * y[-1, wanted]) < tolerance * scale).all()):
            out = step.select("node", *(F.aggregate(F.zip_with("q", F.array(*map(F.lit, map(float, y[:, k]))), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x).alias(f"c{i}") for i, k in enumerate(wanted)))
            names = out.columns[1:]
            signs = out.agg(*(F.max_by(F.signum(c), F.struct(F.round(F.abs(c), 9), -F.hash("node"))).alias(c) for c in names)).first()
            return out.select("node", *((F.col(c) * signs[c]).alias(c) for c in names))
        beside.append(beta)
        basis = step.select("node", F.array_append("q", F.col("w") / beta).alias("q"))
    raise RuntimeError(f"the eigenvectors need more than {most} steps")


def bridges(edges: DataFrame) -> DataFrame:
    """(src, dst): edges that connect a graph's components, from the largest component's representative to every other's. A
    representative is its component's node of highest degree, the smallest of equals."""
    found = components(edges)
    degree = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    top = found.join(degree, "node").groupBy("component").agg(F.count("*").alias("size"), F.min(F.struct(-F.col("degree"), "node")).alias("best"))
    top = cut(top.select("component", "size", F.col("best.node").alias("node")))
    hub = top.agg(F.min(F.struct(-F.col("size"), "component", "node")).alias("h")).select(F.col("h.node").alias("src"), F.col("h.component").alias("of"))
    return top.crossJoin(F.broadcast(hub)).filter("component <> of").select("src", F.col("node").alias("dst"))  # the hub is one row
