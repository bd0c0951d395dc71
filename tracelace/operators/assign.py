"""Optimal assignment inside frames: the combinatorial part, in numpy over one small group at a time.

A group is one frame's candidates; it falls into the connected pieces of its graph, and each piece is solved by itself, so
the cubic step sees a piece and not a frame. Costs are minimised; as many allowed pairs as possible are made first.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelace.operators.groups import spread

#: The price of a pair that isn't allowed: more than any set of allowed ones.
FORBIDDEN = 1e9


def solve(cost: np.ndarray) -> np.ndarray:
    """For each row of a matrix with no more rows than columns its column in an assignment of least total cost.

    Shortest augmenting paths with potentials, one row at a time; the scan over columns is vectorised.
    """
    n, m = cost.shape
    if n > m:
        raise ValueError("more rows than columns")
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    row_of, way = np.zeros(m + 1, int), np.zeros(m + 1, int)
    # rows whose least column is free take it at once; only the others are searched for
    if n:
        u[1:] = cost.min(axis=1)
        columns, rows = np.unique(cost.argmin(axis=1), return_index=True)
        row_of[columns + 1] = rows + 1
    placed = set(row_of[1:].tolist())
    for i in range(1, n + 1):
        if i in placed:
            continue
        row_of[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            reduced = cost[row_of[j0] - 1] - u[row_of[j0]] - v[1:]
            free = ~used[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.full(n, -1)
    out[row_of[1:][row_of[1:] > 0] - 1] = np.flatnonzero(row_of[1:] > 0)
    return out


def rectangle(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of least cost of a matrix of any shape, all of the smaller side assigned."""
    if cost.shape[0] == 1:
        return [(0, int(np.argmin(cost[0])))]
    if cost.shape[1] == 1:
        return [(int(np.argmin(cost[:, 0])), 0)]
    if cost.shape[0] <= cost.shape[1]:
        return [(i, int(j)) for i, j in enumerate(solve(cost))]
    return [(int(j), i) for i, j in enumerate(solve(cost.T))]


def cheapest_columns(rows: list[list[tuple[int, float]]], n_columns: int) -> list[int]:
    """For each row its column, or -1 for none, at least total cost; ``rows`` has a row's (column, cost), and none costs 0.

    Rows take their cheapest free column, then bid for columns against their second choice, and what is left is placed along
    shortest paths that end at the first free column, so a search sees a row's surroundings and not the whole table.
    """
    price: list[float] = [0] * n_columns
    owner = [-1] * n_columns
    column = [-1] * len(rows)
    cost: list[float] = [0] * len(rows)
    waiting = [i for i in range(len(rows)) if rows[i]]
    for _ in range(3):
        again: list[int] = []
        bids = 4 * len(waiting)
        while waiting:
            i = waiting.pop()
            first = second = 0  # none is always there
            at = -1
            at_cost = 0
            for j, c in rows[i]:
                d = c - price[j]
                if d < first:
                    first, second, at, at_cost = d, first, j, c
                elif d < second:
                    second = d
            column[i], cost[i] = at, at_cost
            if at < 0:
                continue
            price[at] += first - second
            displaced = owner[at]
            owner[at] = i
            if displaced >= 0:
                column[displaced] = -1
                bids -= 1
                (waiting if first < second and bids > 0 else again).append(displaced)
        waiting = again
    for r in waiting:
        # distances are to columns; a row beyond the first is reached through the column that it holds
        best: dict[int, float] = {}
        via: dict[int, tuple[int, float]] = {}
        done: list[tuple[float, int]] = []
        heap: list[tuple[float, int]] = []
        scanned: set[int] = set()
        i, base = r, 0
        stop, stop_row, stop_column = 0, r, -1
        while True:
            for j, c in rows[i]:
                if j in scanned:
                    continue
                d = base + c - price[j]
                if d < stop and d < best.get(j, d + 1):
                    best[j] = d
                    via[j] = (i, c)
                    if owner[j] < 0:
                        stop, stop_column = d, j
                    else:
                        heapq.heappush(heap, (d, j))
            while heap and (heap[0][1] in scanned or heap[0][0] > best[heap[0][1]]):
                heapq.heappop(heap)
            if not heap or heap[0][0] >= stop:
                break
            d, j = heapq.heappop(heap)
            scanned.add(j)
            done.append((d, j))
            i = owner[j]
            base = d - (cost[i] - price[j])
            if base < stop:  # this row goes without a column
                stop, stop_row, stop_column = base, i, -1
        for d, j in done:
            if d < stop:
                price[j] += d - stop
        if stop_column >= 0:
            j = stop_column
        else:
            j = column[stop_row]
            column[stop_row] = -1
            if stop_row == r:
                continue
        while True:
            i, c = via[j]
            owner[j] = i
            j, column[i], cost[i] = column[i], j, c
            if i == r:
                break
    return column


Piece = dict[str, np.ndarray]


def pieces(part: Piece) -> list[Piece]:
    """The connected pieces of a frame's candidate graph; sources and targets are told apart."""
    _, i = np.unique(part["source_id"], return_inverse=True)
    _, j = np.unique(part["target_id"], return_inverse=True)
    j = j + i.max() + 1
    label = np.arange(j.max() + 1)
    while True:
        least = label.copy()
        np.minimum.at(least, i, label[j])
        np.minimum.at(least, j, label[i])
        least = least[least]
        if (least == label).all():
            break
        label = least
    of = label[i]
    order = np.argsort(of, kind="stable")
    cuts = np.flatnonzero(np.diff(of[order])) + 1
    return [{c: v[at] for c, v in part.items()} for at in np.split(order, cuts)]


def _matrix(part: Piece, cost: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, i = np.unique(part["source_id"], return_inverse=True)
    t, j = np.unique(part["target_id"], return_inverse=True)
    c = np.full((len(s), len(t)), np.nan)
    c[i, j] = part[cost].astype(float)
    return c, s, t


def _per_piece(pairs: DataFrame, choose, keys: tuple[str, ...] = ("dataset", "t")) -> DataFrame:
    kinds = dict(pairs.dtypes)
    columns = list(dict.fromkeys([*keys, "source_id", "target_id", *[c for c in ("d", "cost") if c in pairs.columns]]))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = {c: pdf[c].to_numpy() for c in columns if c not in keys}
        got = [pair for part in pieces(whole) for pair in choose(part)]
        out = pd.DataFrame({"source_id": [a for a, _ in got], "target_id": [b for _, b in got]}, dtype="int64")
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "source_id", "target_id"]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", source_id long, target_id long"
    return pairs.select(*columns).transform(spread(*keys)).groupBy(*keys).applyInPandas(run, schema)


def gated_hungarian(pairs: DataFrame, cost: str = "d", keys: tuple[str, ...] = ("dataset", "t")) -> DataFrame:
    """One-to-one links: as many allowed pairs as possible, then the least total cost."""

    def choose(part: Piece) -> list[tuple[int, int]]:
        c, s, t = _matrix(part, cost)
        allowed = ~np.isnan(c)
        return [(s[i], t[j]) for i, j in rectangle(np.where(allowed, c, FORBIDDEN)) if allowed[i, j]]

    return _per_piece(pairs, choose, keys)


def with_skips(pairs: DataFrame, cost: str, disappearance: float, keys: tuple[str, ...] = ("dataset", "t")) -> DataFrame:
    """One-to-one links of least total cost where a source may stay alone for ``disappearance`` and a target for nothing.

    A pair that costs as much as its source alone or more is never needed, so only the others are searched, as lists and
    not as a matrix.
    """
    kinds = dict(pairs.dtypes)
    own = pairs.select(*keys, F.col("source_id").cast("long"), F.col("target_id").cast("long"), (F.col(cost).cast("double") - float(disappearance)).alias("_c")).filter("_c < 0")

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("source_id", "ascending"), ("target_id", "ascending")])
        s, i = np.unique(group.column("source_id").to_numpy(), return_inverse=True)
        t, j = np.unique(group.column("target_id").to_numpy(), return_inverse=True)
        rows: list[list[tuple[int, float]]] = [[] for _ in s]
        for a, b, c in zip(i.tolist(), j.tolist(), group.column("_c").to_pylist(), strict=True):
            rows[a].append((b, c))
        column = np.array(cheapest_columns(rows, len(t)))
        linked = np.flatnonzero(column >= 0)
        out = group.slice(0, 1).select(list(keys)).take(pa.array(np.zeros(len(linked), np.int64)))
        return out.append_column("source_id", pa.array(s[linked])).append_column("target_id", pa.array(t[column[linked]]))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", source_id long, target_id long"
    return own.transform(spread(*keys)).groupBy(*keys).applyInArrow(run, schema)


def with_divisions(pairs: DataFrame, cost: str, reward: float, keys: tuple[str, ...] = ("dataset", "t")) -> DataFrame:
    """Links with one parent and two children at most: each source stands twice; a link is made if its cost is under ``reward``."""

    def choose(part: Piece) -> list[tuple[int, int]]:
        c, s, t = _matrix(part, cost)
        n, m = c.shape
        twice = np.vstack([c, c])
        whole = np.full((2 * n, m + 2 * n), FORBIDDEN)
        whole[:, :m] = np.where(np.isnan(twice), FORBIDDEN, twice - reward)
        whole[np.arange(2 * n), m + np.arange(2 * n)] = 0.0
        return [(s[i % n], t[j]) for i, j in enumerate(solve(whole)) if j < m and not np.isnan(twice[i, j])]

    return _per_piece(pairs, choose, keys)


def _exactly(w: np.ndarray, k: int) -> list[tuple[int, int]] | None:
    """The heaviest ``k`` pairs of a piece (rows, columns; nan isn't allowed), or None if it has no so many.

    Rows that stay alone take one of so many dummies, so ``k`` of them take real columns.
    """
    n, m = w.shape
    if k > min(n, m):
        return None
    table = np.hstack([np.where(np.isnan(w), FORBIDDEN, -w), np.zeros((n, n - k))])
    got = [(i, j) for i, j in rectangle(table) if j < m]
    return got if all(not np.isnan(w[i, j]) for i, j in got) and len(got) == k else None


def matched_frame(tables: list[np.ndarray], alone: int, alone_other: int) -> list[list[tuple[int, int]]]:
    """The pairs of each connected piece of a frame; ``tables`` have the smaller side's nodes as rows and nan where a pair isn't allowed.

    ``alone`` and ``alone_other``: nodes of the smaller and the larger side without any candidate. If every node of the
    smaller side can have a pair, the heaviest such matching is taken. Else a node without one costs 1; and while those
    that have candidates but no pair outnumber the larger side's lone nodes, pairs are added where they cost least, if that
    brings them down to that number at all.
    """
    if not alone:
        full = [_exactly(w, len(w)) for w in tables]
        if all(x is not None for x in full):
            return [x for x in full if x is not None]
    loose = [[(i, j) for i, j in rectangle(np.where(np.isnan(w), 1.0, -w)) if not np.isnan(w[i, j])] for w in tables]
    excess = sum(len(w) - len(x) for w, x in zip(tables, loose, strict=True)) - alone_other
    if excess <= 0:
        return loose
    # the heaviest k pairs of a piece weigh concavely in k, so the cheapest next pairs are the cheapest in all
    now, steps = list(loose), []
    value = lambda p, x: sum(tables[p][i, j] + 1 for i, j in x)
    for p, x in enumerate(loose):
        k, last = len(x), value(p, x)
        while (more := _exactly(tables[p], k + 1)) is not None:
            steps.append((last - value(p, more), p, k + 1, more))
            last, k = value(p, more), k + 1
    steps.sort(key=lambda s: s[:3])
    if len(steps) < excess:
        return loose
    for _, p, _, more in steps[:excess]:
        if len(more) > len(now[p]):
            now[p] = more
    return now


def match_nodes(pairs: DataFrame, keys: tuple[str, ...] = ("dataset", "t"), sizes: DataFrame | None = None) -> DataFrame:
    """(keys, pred_id, gt_id): one-to-one matching of detections (source_id) and truth (target_id) within the ruler.

    The weight of a pair is 1 / (1 + d), rounded to 32 bits. ``matched_frame`` says which matching of a frame is taken; what
    it asks of the whole frame are numbers of nodes, so the pieces are solved each by itself. ``sizes`` (keys, n_pred, n_gt):
    all nodes of a frame; without it a frame has the nodes of its pairs alone.
    """
    kinds = dict(pairs.dtypes)
    own = pairs.select(*keys, "source_id", "target_id", "d")
    if sizes is None:
        own = own.withColumns({"n_pred": F.lit(0).cast("long"), "n_gt": F.lit(0).cast("long")})
    else:
        own = own.join(sizes.select(*keys, F.col("n_pred").cast("long"), F.col("n_gt").cast("long")), list(keys))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = {c: pdf[c].to_numpy() for c in ("source_id", "target_id", "d")}
        parts = [_matrix(part, "d") for part in pieces(whole)]
        met = sum(len(s) for _, s, _ in parts), sum(len(t) for _, _, t in parts)
        n_pred, n_gt = max(met[0], int(pdf["n_pred"].iloc[0])), max(met[1], int(pdf["n_gt"].iloc[0]))
        weights = [(1.0 / (1.0 + c)).astype(np.float32).astype(float) for c, _, _ in parts]
        if n_gt <= n_pred:
            found = matched_frame([w.T for w in weights], n_gt - met[1], n_pred - met[0])
            got = [(parts[p][1][j], parts[p][2][i]) for p, x in enumerate(found) for i, j in x]
        else:
            found = matched_frame(weights, n_pred - met[0], n_gt - met[1])
            got = [(parts[p][1][i], parts[p][2][j]) for p, x in enumerate(found) for i, j in x]
        out = pd.DataFrame({"pred_id": [a for a, _ in got], "gt_id": [b for _, b in got]}, dtype="int64")
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "pred_id", "gt_id"]]

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", pred_id long, gt_id long"
    return own.transform(spread(*keys)).groupBy(*keys).applyInPandas(run, schema)


def frame_sizes(pred: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("dataset", "t")) -> DataFrame:
    """(keys, n_pred, n_gt): how many nodes either side has in each frame that both have."""
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    return count(pred, "n_pred").join(count(truth, "n_gt"), list(keys))


def most_pairs(edges: list[tuple[int, int]]) -> dict[int, int]:
    """A matching of the most pairs in a bipartite graph, right to left, by augmenting paths."""
    out: dict[int, int] = {}
    near: dict[int, list[int]] = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)

    def reach(a: int, seen: set[int]) -> bool:
        for b in near[a]:
            if b not in seen:
                seen.add(b)
                if b not in out or reach(out[b], seen):
                    out[b] = a
                    return True
        return False

    for a in near:
        reach(a, set())
    return out
