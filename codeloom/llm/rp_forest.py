"""Forest of random-projection trees over unit vectors, searched through one priority queue."""

from __future__ import annotations

import heapq

import numpy as np

BITS = 38  # of a leaf key, for deeper splits
PLANE_ROWS = 2048  # of a node, that its plane is fitted on


class Forest:
    """Trees fitted on a bounded sample; small enough to travel to every task.

    Inner nodes hold a hyperplane between two groups of sampled vectors. A leaf that holds
    too many of all rows is split further by random directions through its centre
    (``deepen``), so that leaves stay small however many rows there are. ``rows`` holds the
    sampled rows of each leaf.
    """

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 42):
        self.rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.normals: list[np.ndarray] = []
        self.offsets: list[float] = []
        self.children: list[list[int]] = []  # an inner node, or -1 - leaf
        self.centres: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.roots = [self._grow(sample, np.arange(len(sample)), leaf) for _ in range(trees)]
        self.w = np.array(self.normals, dtype=np.float32).reshape(-1, self.dim)
        self.b = np.array(self.offsets, dtype=np.float32)
        self.c = np.array(self.centres, dtype=np.float32).reshape(-1, self.dim)
        self.extra: dict[int, int] = {}
        self.most: dict[int, int] = {}
        self.g = np.zeros((0, self.dim), dtype=np.float32)
        del self.normals, self.offsets, self.centres

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, float]:
        a, b = x[self.rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            near = x @ (a - b) > 0
            if near.all() or not near.any():
                break
            a, b = x[near].mean(0), x[~near].mean(0)
            a, b = a / max(np.linalg.norm(a), 1e-9), b / max(np.linalg.norm(b), 1e-9)
        normal = a - b
        length = np.linalg.norm(normal)
        if length > 1e-6:
            normal = normal / length
            share = (x @ normal > 0).mean()
            if 0.05 < share < 0.95:
                return normal, 0.0
        normal = self.rng.normal(size=self.dim)
        normal /= np.linalg.norm(normal)
        return normal, float(np.median(x @ normal))

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, depth: int = 0) -> int:
        if len(rows) > leaf and depth < 40:
            normal, offset = self._split(x[rows if len(rows) <= PLANE_ROWS else self.rng.choice(rows, PLANE_ROWS, replace=False)])
            right = x[rows] @ normal > offset
            if right.any() and not right.all():
                node = len(self.normals)
                self.normals.append(normal)
                self.offsets.append(offset)
                self.children.append([0, 0])
                self.children[node] = [self._grow(x, rows[~right], leaf, depth + 1), self._grow(x, rows[right], leaf, depth + 1)]
                return node
        self.centres.append(x[rows].mean(0) if len(rows) else np.zeros(self.dim))
        self.rows.append(rows)
        return -1 - (len(self.centres) - 1)

    def own_leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree, before any deeper split (rows by trees)."""
        right = x @ self.w.T > self.b
        children = np.array(self.children, dtype=np.int64).reshape(-1, 2)
        out = np.empty((len(x), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(x), root, dtype=np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                node[inner] = children[node[inner], right[inner, node[inner]].astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def own_keys(self, x: np.ndarray) -> np.ndarray:
        """The keys of each row's own leaves, deeper splits included (rows by trees)."""
        leaf = self.own_leaves(x)
        bits, levels = np.zeros_like(leaf), np.zeros(len(self.c), dtype=np.int64)
        for k, n in self.extra.items():
            levels[k] = n
        if self.extra:
            deep, centre = x @ self.g.T, self.c @ self.g.T
            for level in range(len(self.g)):
                on = levels[leaf] > level
                bits = np.where(on, bits * 2 + (deep[:, level, None] > centre[leaf, level]), bits)
        return leaf * (1 << BITS) + bits

    def deepen(self, largest: dict[int, int], leaf: int) -> bool:
        """Split leaves further, given how many rows the largest part of each holds; whether there was anything to split.

        A part of more than two leaves' worth of rows is split into as many as it needs. A leaf whose
        last splits took nothing off its largest part holds rows of one direction and is left alone.
        """
        more = {k: n for k, n in largest.items() if n > 2 * leaf and n < self.most.get(k, n + 1) and self.extra.get(k, 0) < BITS - 8}
        self.most |= largest
        for k, n in more.items():
            self.extra[k] = min(BITS - 8, self.extra.get(k, 0) + max(1, int(np.ceil(np.log2(n / leaf)))))
        levels = max(self.extra.values(), default=0)
        if levels > len(self.g):
            g = self.rng.normal(size=(levels - len(self.g), self.dim))
            self.g = np.concatenate([self.g, (g / np.linalg.norm(g, axis=1, keepdims=True)).astype(np.float32)])
        return bool(more)

    def nearest(self, x: np.ndarray, leaves: int) -> np.ndarray:
        """The leaves a priority queue over all trees reaches first (rows by leaves, in no order), before any deeper split.

        The queue of ``visits`` reaches leaves by the worst margin on their way; here these are
        worked out for all leaves and many rows at once.
        """
        leaves, out = min(leaves, len(self.c)), []
        for c in range(0, len(x), 1024):
            margin = self.w @ x[c : c + 1024].T - self.b[:, None]
            worst = np.empty((len(self.c), margin.shape[1]), dtype=np.float32)
            stack = [(r, np.full(margin.shape[1], -np.inf, dtype=np.float32)) for r in self.roots]
            while stack:
                node, bad = stack.pop()
                if node < 0:
                    worst[-1 - node] = bad
                else:
                    stack.append((self.children[node][0], np.maximum(bad, margin[node])))
                    stack.append((self.children[node][1], np.maximum(bad, -margin[node])))
            out.append(np.argpartition(np.ascontiguousarray(worst.T), leaves - 1, axis=1)[:, :leaves])
        return np.concatenate(out)

    def visits(self, x: np.ndarray, leaves: int, reach: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own): the leaves each row visits, best first over all trees; its own ones come first.

        The queue holds branches of every tree, ordered by the worst margin on the way to
        them, and is left at ``leaves`` or where all margins left exceed ``reach``. Leaf keys are leaf number * 2^BITS + the bits of the deeper splits.
        """
        margin = x @ self.w.T - self.b
        deep = x @ self.g.T
        centre = self.c @ self.g.T
        out_row, out_leaf, out_own = [], [], []
        children, extra, roots = self.children, self.extra, self.roots
        need = max(leaves, len(roots))
        for i in range(len(x)):
            m, d = margin[i].tolist(), deep[i].tolist()
            queue = [(-1e9, r, 0, 0, True) for r in roots]
            heapq.heapify(queue)
            done = 0
            while queue and done < need:
                bad, node, level, bits, own = heapq.heappop(queue)
                if bad > reach:
                    break
                while True:
                    if node >= 0:
                        v = m[node]
                        near, far = (children[node][1], children[node][0]) if v > 0 else (children[node][0], children[node][1])
                        nxt, other = (near, 0, 0), (far, 0, 0)
                    elif level < extra.get(-1 - node, 0):
                        v = d[level] - float(centre[-1 - node, level])
                        s = int(v > 0)
                        nxt, other = (node, level + 1, bits * 2 + s), (node, level + 1, bits * 2 + 1 - s)
                    else:
                        out_row.append(i)
                        out_leaf.append((-1 - node) * (1 << BITS) + bits)
                        out_own.append(own)
                        done += 1
                        break
                    v = max(abs(v), 1e-12)
                    heapq.heappush(queue, (max(bad, v), *other, False))
                    bad = max(bad, -v)
                    if queue[0][0] < bad:
                        heapq.heappush(queue, (bad, *nxt, own))
                        break
                    node, level, bits = nxt
        return np.array(out_row, dtype=np.int64), np.array(out_leaf, dtype=np.int64), np.array(out_own, dtype=bool)
