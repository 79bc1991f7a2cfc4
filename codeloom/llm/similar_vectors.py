"""Most similar vectors for every vector.

A forest of random-projection trees is fitted on a bounded sample. Its leaves are groves, as
many rows as a task can hold; every vector lives in one grove of each tree and travels to
the groves that a priority queue shared by all trees reaches within a margin, so that what
is lost at the planes stays the same however many rows there are. In a grove the trees go
on, fitted on all rows there: a vector searches the leaves that the queue over these trees
reaches first, then the neighbours of its neighbours. Similarities of the candidates are
exact, and a vector counts for each one it finds as well. Vectors of one direction are
searched once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.rp_forest import BITS, Forest
from codeloom.session import materialize

SAMPLE_ROWS = 20_000
TREES, LEAVES, LEAF_ROWS = 3, 24, 200
GROVE_TREES, GROVE_ROWS, LEAST_GROVE = 2, 98_304, 8_192  # a task holds one grove at a time; small tables have smaller ones, for all cores
REACH = 0.7  # margin within which a grove is visited, over sqrt(dim), the usual length of a unit vector along a direction
FIXED = 2**23 - 1  # components travel as whole parts of this, three bytes each
GUESTS = 8_192  # rows that a grove searches for at a time
GRID = 2.0**-22  # directions closer than this in every component are one
TASK_KEYS = 1_000_000  # keys a task remembers to send a class once; what it forgets is dropped where the class arrives


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _pack(x: np.ndarray) -> pa.Array:
    """Unit vectors in fixed point, a quarter shorter; similarities keep some seven digits."""
    whole = np.round(x.astype(np.float64) * FIXED).astype("<i4").view(np.uint8).reshape(len(x), x.shape[1], 4)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(3 * x.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(whole[:, :, :3]).tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    whole = np.zeros((len(column), dim, 4), dtype=np.uint8)
    whole[:, :, 1:] = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, dim, 3)
    return (whole.view("<i4").reshape(-1, dim) >> 8).astype(np.float32) / np.float32(FIXED)


def _normalize(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Unit vectors, and a key of each direction: components rounded to GRID, so that multiples of a vector share it."""
    for b in batches:
        x = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cells = (np.round(x / GRID) + 0.0).astype(np.int32)
        keys = np.fromiter((xxhash.xxh3_64_intdigest(r.tobytes()) for r in cells), np.uint64, len(x)).view(np.int64)
        v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(x), [None, pa.py_buffer(x.astype(np.float32).tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), pa.array(keys), v], ["id", "at", "key", "v"])


def _once(b: pa.RecordBatch, seen: set) -> pa.RecordBatch:
    """The rows of keys that the task has not met yet, so that a large class leaves it as one row."""
    new = []
    for i, k in enumerate(b.column("key").to_pylist()):
        if k not in seen:
            if len(seen) < TASK_KEYS:
                seen.add(k)
            new.append(i)
    return b.take(pa.array(new, pa.int64()))


def _sizes(batches: Iterator[pa.RecordBatch], forest: Forest, dim: int) -> Iterator[pa.RecordBatch]:
    seen: set = set()
    for b in batches:
        b = _once(b, seen)
        leaf, n = np.unique(forest.own_keys(_matrix(b.column("v"), dim)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(leaf >> BITS), pa.array(leaf), pa.array(n)], ["leaf", "part", "n"])


def _visit(batches: Iterator[pa.RecordBatch], forest: Forest, dim: int, groves: int, reach: float) -> Iterator[pa.RecordBatch]:
    """Each vector once per grove that it visits: as a guest, or where it lives."""
    seen: set = set()
    for whole in batches:
        whole = _once(whole, seen)
        for c in range(0, whole.num_rows, 2048):
            part = whole.slice(c, 2048)
            x = _matrix(part.column("v"), dim)
            row, grove, own = forest.visits(x, groves, reach)
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(grove), pa.array(~own), part.column("key").take(at), _pack(x).take(at)], ["grove", "guest", "key", "v"])


class _Grove:
    """The vectors that live in a grove, in a forest of their own, and the most similar ones of each."""

    def __init__(self, x: np.ndarray, keys: np.ndarray, trees: int, leaves: int, leaf_rows: int, k: int, least: float):
        self.x, self.keys, self.k, self.least, self.leaves = x, keys, k, least - 1e-5, leaves
        self.wide = 2 * k  # neighbours to go on from
        self.forest = Forest(x, trees if len(x) > leaf_rows else 1, leaf_rows)
        self.near = np.concatenate([self._in_leaves(x[c : c + GUESTS], c) for c in range(0, len(x), GUESTS)])
        self.near = self._beyond(x, 0)
        self.floor = np.full(len(x), -np.inf)  # the similarity that a vector needs to be among the k first ones of a resident

    def _top(self, q: np.ndarray, o: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """The most similar members of each of n query rows, -1 where there are no more, from distinct (row, member)."""
        order = np.lexsort((-s, q))
        q, o = q[order], o[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        keep = place < self.wide
        out = np.full((n, self.wide), -1, dtype=np.int32)
        out[q[keep], place[keep]] = o[keep]
        return out

    def _in_leaves(self, x: np.ndarray, me: int = -1) -> np.ndarray:
        """The members found in the leaves that the rows reach first; ``me`` is the number of the first row, if they live here."""
        leaf = self.forest.nearest(x, self.leaves)
        order = np.argsort(leaf, axis=None, kind="stable")
        row = order // leaf.shape[1]
        names, begin = np.unique(leaf.ravel()[order], return_index=True)
        out, least = [], np.full(len(x), self.least, dtype=np.float32)  # rises with what one leaf alone has shown
        for name, r in zip(names.tolist(), np.split(row, begin[1:])):
            m = self.forest.rows[name]
            for c in range(0, len(r), 2048):
                s = x[r[c : c + 2048]] @ self.x[m].T
                over = s >= least[r[c : c + 2048], None]
                many = np.flatnonzero(np.count_nonzero(over, axis=1) > self.wide + 1)  # one may be the row itself
                if len(many):
                    least[r[c + many]] = np.partition(s[many], -self.wide - 1, axis=1)[:, -self.wide - 1]
                    over[many] = s[many] >= least[r[c + many], None]
                i, j = np.nonzero(over)
                out.append((r[c + i], m[j], s[i, j]))
        q, o, s = (np.concatenate(z) for z in zip(*out))
        if me >= 0:
            other = o != q + me
            q, o, s = q[other], o[other], s[other]
        _, at = np.unique(q * len(self.x) + o, return_index=True)
        return self._top(q[at], o[at], s[at], len(x))

    def _beyond(self, x: np.ndarray, me: int = -1, near: np.ndarray | None = None) -> np.ndarray:
        """What is found with the neighbours of the neighbours."""
        near, out = self.near if near is None else near, []
        for c in range(0, len(x), 512):
            a, q = near[c : c + 512], x[c : c + 512]
            far = np.where(a[:, :, None] >= 0, self.near[a], -1)
            both = np.sort(np.concatenate([a, far.reshape(len(a), -1)], axis=1), axis=1)
            new = both >= 0
            new[:, 1:] &= both[:, 1:] != both[:, :-1]
            if me >= 0:
                new &= both != np.arange(me + c, me + c + len(a))[:, None]
            i, j = np.nonzero(new)
            o = both[i, j]
            s = np.einsum("ij,ij->i", q[i], self.x[o])
            good = s >= self.least
            out.append(self._top(i[good], o[good], s[good], len(a)))
        return np.concatenate(out)

    def _ranked(self, x: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, member, exact similarity, place) of the members found for each row."""
        q, j = np.nonzero(near >= 0)
        o = near[q, j]
        s = np.concatenate([np.einsum("ij,ij->i", x[q[c : c + GUESTS]].astype(np.float64), self.x[o[c : c + GUESTS]].astype(np.float64)) for c in range(0, max(1, len(q)), GUESTS)])
        order = np.lexsort((self.keys[o], -s, q))
        q, o, s = q[order], o[order], s[order]
        return q, o, s, np.arange(len(q)) - np.searchsorted(q, q)

    def _found(self, x: np.ndarray, keys: np.ndarray, near: np.ndarray, me: int = -1) -> pa.RecordBatch:
        """The k most similar members of each row, and the row for members that it may be among the k first ones of."""
        q, o, s, place = self._ranked(x, near)
        first, back = place < self.k, s >= self.floor[o]
        if me >= 0:
            back &= ~(self.near[o] == (q + me)[:, None]).any(axis=1)
        key, other = np.r_[keys[q[first]], self.keys[o[back]]], np.r_[self.keys[o[first]], keys[q[back]]]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(other), pa.array(np.r_[s[first], s[back]])], ["key", "other", "similarity"])

    def residents(self) -> Iterator[pa.RecordBatch]:
        parts = [slice(c, c + GUESTS) for c in range(0, len(self.x), GUESTS)]
        for p in parts:
            q, _, s, place = self._ranked(self.x[p], self.near[p])
            kth = place == self.k - 1
            self.floor[q[kth] + p.start] = s[kth]
        for p in parts:
            yield self._found(self.x[p], self.keys[p], self.near[p], p.start)

    def guests(self, x: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return self._found(x, keys, self._beyond(x, near=self._in_leaves(x)))


def _grove_search(batches: Iterator[pa.RecordBatch], dim: int, trees: int, leaves: int, leaf_rows: int, k: int, least: float) -> Iterator[pa.RecordBatch]:
    """Searches grove by grove over rows sorted by (grove, guest, key): those that live there are held, guests stream past."""
    grove, ready, last, waiting = None, None, None, []

    def settle(guest: bool) -> Iterator[pa.RecordBatch]:
        """Search for those that wait: residents first, as they make the grove; a grove without residents has nothing to find."""
        nonlocal ready, waiting
        if waiting:
            x, keys = (np.concatenate(z) for z in zip(*waiting))
            waiting = []
            if not guest:
                ready = _Grove(x, keys, trees, leaves, leaf_rows, k, least)
                yield from ready.residents()
            elif ready:
                yield ready.guests(x, keys)

    was = False
    for b in batches:
        g, guest, ks = b.column("grove").to_numpy(), b.column("guest").to_numpy(zero_copy_only=False), b.column("key").to_numpy()
        x = _unpack(b.column("v"), dim)
        cuts = np.flatnonzero((g[1:] != g[:-1]) | (guest[1:] != guest[:-1])) + 1
        for s, e in zip(np.r_[0, cuts], np.r_[cuts, len(g)]):
            if s == e:
                continue
            if g[s] != grove or guest[s] != was:
                yield from settle(was)
                if g[s] != grove:
                    ready = None
                grove, was, last = g[s], guest[s], None
            new = np.flatnonzero(np.r_[ks[s] != last, ks[s + 1 : e] != ks[s : e - 1]]) + s  # classes that several tasks sent
            last = ks[e - 1]
            waiting.append((x[new], ks[new]))
            if was and sum(len(w) for _, w in waiting) >= GUESTS:
                yield from settle(was)
    yield from settle(was)


def fit_forest(classes: DataFrame, dim: int, trees: int, leaf_rows: int, grove_rows: int, sample_rows: int, seed: int) -> Forest:
    """A forest over a sample of ``key, v``, its leaves split until none holds more than two leaves' worth of all directions.

    Up to ``grove_rows`` rows are one leaf of one tree.
    """
    n = classes.count()
    chosen = classes.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1)))).dropDuplicates(["key"]).limit(2 * sample_rows)
    sample = _matrix(chosen.orderBy("key").select("v").toArrow().column("v").combine_chunks(), dim) if n > grove_rows else np.zeros((0, dim), dtype=np.float32)
    forest = Forest(sample, trees if n > grove_rows else 1, max(8, int(leaf_rows * len(sample) / max(n, 1))), seed)
    forest.rows = []
    while n > grove_rows:
        parts = classes.mapInArrow(partial(_sizes, forest=forest, dim=dim), "leaf long, part long, n long").groupBy("leaf", "part").agg(F.sum("n").alias("n"))
        largest = parts.where(F.col("n") > 2 * leaf_rows).groupBy("leaf").agg(F.max("n").alias("n")).collect()  # at most a row per leaf of the fitted forest
        if not forest.deepen({r.leaf: r.n for r in largest}, leaf_rows):
            break
    return forest


def similar_vectors(
    vectors: DataFrame, id_col: str, vector_col: str, dim: int, *, k: int = 5, least: float = 0.0, at: str | None = None,
    trees: int = TREES, leaves: int = LEAVES, leaf_rows: int = LEAF_ROWS, grove_rows: int = GROVE_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 42,
) -> DataFrame:
    """``id, other, similarity``: for each id the ``k`` most similar other ids by cosine, if at least ``least``.

    Rows whose vector is null, not of ``dim`` numbers, holds a null or a non-finite number, or
    is all zero are left out. Of rows with the same id the one with the latest ``at`` counts.
    Ties go to the smaller id. The search is approximate: of true neighbours of which none
    visits a grove of the other, or that no leaf and no third vector there leads to, a pair is
    missed (recall on the test data: README). The forest of the groves is fitted on
    ``sample_rows`` vectors at most; every vector is indexed and searched for, and groves are
    split further as the rows demand. A vector visits ``leaves`` groves at most, and in each
    ``leaves`` leaves of ``trees`` trees. Vectors of one direction (components equal to within
    GRID after normalization) form one class of similarity 1, so a group of copies or of
    multiples of a vector costs one search whatever its size.
    """
    good = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), (F.col(at) if at else F.lit(None).cast("timestamp_ntz")).alias("at")).where(
        (F.col("id").isNotNull())
        & (F.size("v") == dim)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    kinds = dict(good.dtypes)
    unit = good.mapInArrow(partial(_normalize, dim=dim), f"id {kinds['id']}, at {kinds['at']}, key long, v binary")
    latest = unit.groupBy("id").agg(F.max_by(F.struct("key", "v"), F.struct("at", "key")).alias("l")).select("id", "l.*")
    latest = materialize(latest, "vectors")
    classes = latest.select("key", "v")  # several rows of a class at most once per task, and once per grove
    each = min(grove_rows, max(LEAST_GROVE, classes.count() // 8))
    forest = fit_forest(classes, dim, GROVE_TREES, each, each, sample_rows, seed)
    visits = classes.mapInArrow(partial(_visit, forest=forest, dim=dim, groves=leaves, reach=REACH / dim**0.5), "grove long, guest boolean, key long, v binary")
    search = partial(_grove_search, dim=dim, trees=trees, leaves=leaves, leaf_rows=leaf_rows, k=k, least=least)
    met = visits.repartition("grove").sortWithinPartitions("grove", "guest", "key").mapInArrow(search, "key long, other long, similarity double")
    ranked = Window.partitionBy("key").orderBy(F.desc("similarity"), "other")
    near = met.repartition("key").groupBy("key", "other").agg(F.max("similarity").alias("similarity")).withColumn("_n", F.row_number().over(ranked)).where(F.col("_n") <= k)

    # The k + 1 smallest ids of a class are all that can be anyone's k first ones under the tie rule.
    first = latest.select("key", "id").withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("_n") <= k + 1)
    first = materialize(first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")), "firsts")
    offers = near.select("key", F.col("similarity"), F.col("other")).join(first.select(F.col("key").alias("other"), "ids"), "other").select("key", "similarity", "ids")
    offers = offers.unionByName(first.select("key", F.lit(1.0).alias("similarity"), "ids"))
    offered = offers.select("key", F.explode("ids").alias("id"), (-F.col("similarity")).alias("far")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("far", "id"))).alias("all"))
    own = latest.select("id", "key").join(offered, "key")
    found = own.select("id", F.explode(F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k)).alias("x"))
    return found.select("id", F.col("x.id").alias("other"), (-F.col("x.far")).alias("similarity")).where(F.col("similarity") >= least)
