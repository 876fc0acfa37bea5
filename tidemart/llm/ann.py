"""Approximate nearest neighbours (largest inner product) on a hierarchical
k-means tree.

Vectors get one more component that gives all of them the same length, so the
largest inner product is the least distance. The tree is fitted on a bounded
sample; every vector is then assigned to a leaf. A query walks the tree best
bin first: a priority queue of nodes by their centre's distance yields leaves
in the order to visit. How many leaves to visit is calibrated: a bounded set
of calibration queries is answered exactly, and the visits are widened until
the wanted recall of those answers is reached.

Equal vectors are searched once: on the candidate side the ``k + 1`` least
ids of each distinct vector are enough for an exact answer, on the query side
equal queries share an answer. Leaves are packed in blocks of bounded size,
queries likewise, and leaves with many blocks are salted, so no key's size
matters. A task merges what its blocks find before anything is shuffled.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, prepare, stage

SAMPLE, MAX_LEAVES, LEAF, BRANCH, CALIBRATION, BLOCK, SALT_BLOCKS = 20_000, 2048, 256, 8, 200, 1024, 16
HELD, PAIRS = 50_000, 16_384


class Tree:
    """Centres, children (empty: a leaf) and leaf numbers of the nodes."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7):
        self.rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [sample.mean(0)], [[]], [-1]
        self.leaves = 0
        todo = [(0, sample, leaves)]
        while todo:
            node, points, want = todo.pop()
            parts = _kmeans(points, min(BRANCH, want), self.rng) if want > 1 and len(points) > 1 else []
            if len(parts) < 2:
                self.leaf[node] = self.leaves
                self.leaves += 1
                continue
            for centre, own in parts:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), own, max(1, round(want * len(own) / len(points)))))
                self.centres.append(centre)
                self.children.append([])
                self.leaf.append(-1)
        self.centres = np.array(self.centres)
        self.leaf_nodes = np.flatnonzero(np.array(self.leaf) >= 0)[np.argsort([x for x in self.leaf if x >= 0])]
        del self.rng

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, from the root down."""
        out = np.empty(len(x), np.int64)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            kids = self.children[node]
            if not kids:
                out[at] = self.leaf[node]
                continue
            c = self.centres[kids]
            near = np.argmin((c * c).sum(1) - 2 * (x[at] @ c.T), axis=1)
            todo += [(kid, at[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[int]:
        """Leaves in best-bin-first order, at most so many."""
        d = ((self.centres - q) ** 2).sum(1)
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (d[kid], kid))
            else:
                out.append(self.leaf[node])
        return out


def _kmeans(x: np.ndarray, k: int, rng, rounds: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
        centres = np.array([x[near == j].mean(0) for j in range(len(centres)) if (near == j).any()])
    near = np.argmin((centres * centres).sum(1) - 2 * (x @ centres.T), axis=1)
    return [(x[near == j].mean(0), x[near == j]) for j in range(len(centres)) if (near == j).any()]


def _lift(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes them all ``longest`` long."""
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1), 0))[:, None]], 1)


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.Array) else column.combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, vec_id: str, vector: str, dim: int | None = None) -> DataFrame:
    """(id, v) of the vectors that take part: not null, not zero, all
    components finite, and of dimension ``dim``, by default the commonest one
    (the least, if two are as common); a null id takes no part."""
    v = vectors.select(col(vec_id).cast("long").alias("id"), col(vector).alias("v")).filter("id is not null and v is not null and size(v) > 0")
    double = "cast(x as double)"
    v = v.filter(f"forall(v, x -> x is not null and not isnan({double}) and abs({double}) < double('infinity')) and exists(v, x -> x != 0)")
    if dim is None:
        dims = v.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim = dims.d if dims else -1
    return v.filter(F.size("v") == dim)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           recall: float = 0.97, sample: int = SAMPLE, leaf_rows: int = LEAF, max_leaves: int = MAX_LEAVES,
           calibration: int = CALIBRATION) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows of ``vectors``
    found for each row of ``queries`` (same columns), its own id left out.
    Nearest first, ties to the smaller id; all candidates if fewer than k.
    Scores are inner products in double precision. Unusable vectors (see
    `usable`) take no part on either side, nor do queries of another dimension
    than the candidates' commonest; no usable vector gives no rows. Rows of one
    id are vectors of their own, but a query's own id is never its answer."""
    spark = vectors.sparkSession
    prepare(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    base = stage(usable(vectors, vec_id, vector), "ann-vectors")
    first = base.first()
    if first is None:
        return spark.createDataFrame([], schema)
    dim = len(first.v)
    asked = stage(usable(queries, vec_id, vector, dim), "ann-queries")
    stats = base.agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (a, x) -> a + cast(x as double) * x)")).alias("m")).first()
    longest = float(np.sqrt(stats.m))

    # a vector's class: its k + 1 least ids; and each query's
    kept = (base.withColumn("r", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
            .groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("class", F.expr("ids[0]")))
    kept = stage(kept, "ann-classes")
    heads = stage(asked.groupBy("v").agg(F.min("id").alias("qid")).select("qid", "v"), "ann-heads")
    members = stage(asked.select("id", "v").join(heads, "v").select("id", "qid"), "ann-members")
    n = kept.count()

    leaves = int(min(max_leaves, max(1, n // leaf_rows)))
    picked = kept.filter(F.pmod(F.xxhash64("class"), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30))).select("v").limit(sample).toArrow()["v"]
    fitted = _matrix(picked, dim) if len(picked) else np.array([first.v], np.float64)
    tree = Tree(_lift(fitted, longest), leaves)
    del picked, fitted
    held = spark.sparkContext.broadcast(tree.__dict__)

    def loaded() -> Tree:
        t = Tree.__new__(Tree)
        t.__dict__.update(held.value)
        return t

    # calibration: exact answers of some queries, and the leaves that they are in
    rows = heads.filter(F.pmod(F.xxhash64("qid"), F.lit(1 << 30)) < int(min(1.0, 2 * calibration * 20 / max(20, stats.n)) * (1 << 30))).limit(calibration).collect() or heads.limit(calibration).collect()
    visits = tree.leaves
    if rows:
        exact = _exact(kept, np.array([r.v for r in rows], np.float64), [r.qid for r in rows], k, dim, longest, loaded)
        visits = _calibrated(exact, rows, tree, recall, k)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded()
        for b in batches:
            if b.num_rows:
                leaf = t.assign(_lift(_matrix(b.column(0), dim), longest))
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *b.columns], names=["leaf", "v", "ids", "class"])

    out = T.StructType([T.StructField("leaf", T.LongType()), *[kept.schema[c] for c in ("v", "ids", "class")]])
    placed = stage(kept.select("v", "ids", "class").mapInArrow(assign, out), "ann-placed")
    # blocks and salts of each leaf: at most max_leaves rows, which stay in Spark
    blocks = F.greatest(F.lit(1), F.ceil(F.col("count") / BLOCK)).cast("long")
    sizes = placed.groupBy("leaf").count().select("leaf", blocks.alias("blocks"), F.greatest(F.lit(1), F.ceil(blocks / SALT_BLOCKS)).cast("long").alias("salts"))
    sizes = F.broadcast(stage(sizes, "ann-sizes"))
    packed = (placed.join(sizes, "leaf").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")))
              .groupBy("leaf", "block", "salts").agg(F.collect_list(F.struct("v", "ids")).alias("held")).withColumn("salt", F.pmod(F.col("block"), F.col("salts"))))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The queries of each leaf, of BLOCK queries at a time."""
        t = loaded()
        for whole in batches:
            for b in (whole.slice(s, BLOCK) for s in range(0, whole.num_rows, BLOCK)):
                q = np.concatenate([_matrix(b.column(1), dim), np.zeros((b.num_rows, 1))], 1)
                order = [t.visits(x, visits) for x in q]
                leaf = np.concatenate(order)
                by = np.argsort(leaf, kind="stable")
                leaf, at = leaf[by], np.repeat(np.arange(len(q)), [len(x) for x in order])[by]
                starts = np.append(np.flatnonzero(np.diff(leaf, prepend=-1)), len(leaf))
                cut = np.searchsorted(starts, np.arange(0, len(leaf), PAIRS))   # leaves of about as many pairs
                for lo, hi in zip(cut, [*cut[1:], len(starts) - 1], strict=True):
                    if lo < hi:
                        part = pa.array(at[starts[lo]:starts[hi]])
                        asked_ = pa.StructArray.from_arrays([b.column(0).take(part), b.column(1).take(part)], names=["qid", "v"])
                        lists = pa.ListArray.from_arrays(pa.array((starts[lo:hi + 1] - starts[lo]).astype(np.int32)), asked_)
                        yield pa.RecordBatch.from_arrays([pa.array(leaf[starts[lo:hi]]), lists], names=["leaf", "asked"])

    of_leaf = T.StructType([T.StructField("qid", T.LongType()), heads.schema["v"]])
    out = T.StructType([T.StructField("leaf", T.LongType()), T.StructField("asked", T.ArrayType(of_leaf))])
    groups = max(1, -(-max(1, members.count()) // BLOCK))
    walks = (heads.select("qid", "v").repartition(groups, "qid").mapInArrow(walk, out).join(sizes.select("leaf", "salts"), "leaf")
             .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts"))
    cells = walks.join(packed.drop("block", "salts"), ["leaf", "salt"]).select("asked", "held")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                asked_, held_ = b.column(0)[i].values, b.column(1)[i].values
                _merge(best, asked_.field("qid").to_numpy(), _matrix(asked_.field("v"), dim), _matrix(held_.field("v"), dim), held_.field("ids").to_pylist(), k)
                if len(best) >= HELD:
                    yield _found(best)
                    best = {}
        if best:
            yield _found(best)

    found = cells.mapInArrow(score, "qid long, vec_id long, score double")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    each = members.select(F.col("id").alias("query_id"), "qid").distinct().join(top, "qid").filter("vec_id != query_id")
    return (each.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _dots(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of one query, summed in the same way wherever they are computed."""
    return (x * q).sum(1)


def _merge(best: dict, qids: np.ndarray, q: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> None:
    rough = q @ x.T
    # below the (k + 1)-th score found so far nothing enters
    floor = np.array([-best[i][k][0] if len(best.get(i, ())) > k else -np.inf for i in qids.tolist()])
    floor -= 1e-9 * np.where(np.isfinite(floor), np.maximum(1.0, np.abs(floor)), 0.0)
    for j in np.flatnonzero((rough >= floor[:, None]).any(1)).tolist():
        qid, least = int(qids[j]), floor[j]
        if len(x) > k + 1:
            cut = np.partition(rough[j], len(x) - k - 1)[len(x) - k - 1]
            least = max(least, cut - 1e-9 * max(1.0, abs(cut)))
        near = np.flatnonzero(rough[j] >= least)
        s = _dots(q[j], x[near])
        rows = [(-d, i) for d, at in zip(s.tolist(), near.tolist(), strict=True) for i in ids[at]]
        best[qid] = heapq.nsmallest(k + 1, best.get(qid, []) + rows)


def _found(best: dict) -> pa.RecordBatch:
    rows = [(q, i, -d) for q, xs in best.items() for d, i in xs]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["qid", "vec_id", "score"])


def _exact(kept: DataFrame, q: np.ndarray, qids: list[int], k: int, dim: int, longest: float, loaded) -> list:
    """Exact answers of the calibration queries, (qid, vec_id, score, leaf)."""
    def run(batches):
        t, best, leaf_of = loaded(), {}, {}
        for b in batches:
            if b.num_rows:
                x, ids = _matrix(b.column(0), dim), b.column(1).to_pylist()
                leaf = t.assign(_lift(x, longest))
                _merge(best, np.array(qids), q, x, ids, k)
                wanted = {i for xs in best.values() for _, i in xs}
                leaf_of = {i: leaf_of[i] for i in wanted if i in leaf_of}
                for at, many in enumerate(ids):
                    leaf_of.update({i: int(leaf[at]) for i in many if i in wanted})
        if best:
            out = _found(best)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array([leaf_of[i] for i in out.column(1).to_pylist()], pa.int64())], names=["qid", "vec_id", "score", "leaf"])

    rows = kept.select("v", "ids").mapInArrow(run, "qid long, vec_id long, score double, leaf long").filter("qid != vec_id")
    return rows.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k).collect()


def _calibrated(exact: list, rows: list, tree: Tree, recall: float, k: int) -> int:
    """The fewest leaf visits, widened from one, that find the wanted part."""
    held_in: dict[int, list[int]] = {}
    for r in exact:
        held_in.setdefault(r.qid, []).append(r.leaf)
    depth: list[int] = []
    for qid, v in {r.qid: r.v for r in rows}.items():   # one query's order at a time
        place = np.empty(tree.leaves, np.int64)
        place[tree.visits(np.append(np.array(v, float), 0.0), tree.leaves)] = np.arange(tree.leaves)
        depth += place[held_in.get(qid, [])].tolist()
    depth.sort()
    if not len(depth):
        return tree.leaves
    visits = 1
    while visits < tree.leaves and np.searchsorted(depth, visits) < recall * len(depth):
        visits += max(1, visits // 16)
    return min(visits, tree.leaves)
