"""Groups of candidates and connected components, without pairs of a group and without hot tasks.

`linked` gives links that connect the members of each group as all their links do, by a spanning forest, so rows grow
with the members, not with their pairs. A group of over `most` members is cut into blocks; each holds the group's
least member as well, and only what that member does not reach within a block meets the other blocks. `join_one` joins
hot keys by broadcast, which their share of the rows bounds; `components` joins links over all groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Workspace, give_back

#: So many rows of a few numbers each may be broadcast: a few megabytes.
BROADCAST_ROWS = 100_000


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a hint to broadcast it where its counted rows are few; else Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_one(many: DataFrame, one: DataFrame, key: str | list[str], total: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """many with the columns of its key's one row in `one`, which also has n, the key's rows in many; total is at least
    their sum. Keys with more than the most-th part of the rows are fewer than `most`, so these are broadcast; of the
    rest, joined by shuffle, none is hot."""
    if total <= most:
        return many.join(F.broadcast(one.drop("n")), key)
    hot = one.where(F.col("n") > total / most)
    cold = one.where(F.col("n") <= total / most)
    by_hot = many.join(F.broadcast(hot.drop("n")), key)
    by_cold = many.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(cold.drop("n").hint("merge"), key)
    return by_hot.unionByName(by_cold)


Near = Callable[[int, np.ndarray], np.ndarray]


def linked(ws: Workspace, rows: DataFrame, near_of: Callable[[pa.Table], Near], most: int, name: str) -> DataFrame:
    """a, b: links that connect the members of each group as all its links do.

    rows: key, node (long; a node stands once in a group) and what near_of needs. That gets a group's rows and gives
    near(x, others): which of the others are linked to x, by their places in the group.
    """
    hot = ws.store(rows.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where(F.col("n") > most), f"{name}-hot")
    n_hot = hot.count()

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key"]):
            yield _edges(group, forest(group.num_rows, near_of(group)))
        give_back()

    if not n_hot:
        return by_group(rows, "key").mapInArrow(whole, "a long, b long")
    keys = small(hot.select("key"), n_hot)
    cold = by_group(rows.join(keys, "key", "left_anti"), "key").mapInArrow(whole, "a long, b long")

    n_blocks = F.ceil(F.col("n") * 2 / most).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = rows.join(small(hot.select("key", "pivot", n_blocks.alias("blocks")), n_hot), "key")
    members = placed.where("node <> pivot").withColumn("block", own)
    pivots = placed.where("node = pivot").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

    def by_pivot(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "block"]):
            edges = forest(group.num_rows, near_of(group))
            up = _stars(edges)
            nodes = group["node"].to_numpy()
            least = int(nodes.argmin())
            root = up.get(least, least)
            rest = [k for k in range(len(nodes)) if up.get(k, k) != root]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(nodes[x]) for x, _ in edges] + [int(nodes[k]) for k in rest], pa.int64()), pa.array([int(nodes[y]) for _, y in edges] + [group["key"][0].as_py()] * len(rest), pa.int64()), pa.array([False] * len(edges) + [True] * len(rest))],
                names=["a", "b", "rest"],
            )
        give_back()

    columns = [*rows.columns, "block"]
    first = ws.store(by_group(members.select(*columns).unionByName(pivots.select(*columns)), "key", "block").mapInArrow(by_pivot, "a long, b long, rest boolean"), f"{name}-pivots")
    found = cold.unionByName(first.where("not rest").select("a", "b"))
    left = first.where("rest").select(F.col("a").alias("node"), F.col("b").alias("key"))
    portions = ws.store(left.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("portions")), f"{name}-rest")
    n_rest = portions.count()
    if not n_rest:
        return found
    in_rest = members.join(small(portions, n_rest), "key")
    mine = in_rest.join(left, ["key", "node"], "left_semi").withColumn("portion", F.pmod(F.xxhash64("node", F.lit(7)), F.col("portions")).cast("int"))
    mine = mine.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    others = in_rest.withColumn("portion", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)))
    meeting = [*columns, "portion"]
    both = mine.select(*meeting, F.lit(True).alias("asks")).unionByName(others.select(*meeting, F.lit(False).alias("asks")))

    def by_rest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["key", "block", "portion"]):
            near, every = near_of(group), np.arange(group.num_rows)
            edges: list[tuple[int, int]] = []
            tree: dict[int, int] = {}
            for x in np.flatnonzero(group["asks"].to_numpy(zero_copy_only=False)).tolist():
                for y in every[near(x, every)].tolist():
                    a, b = _root(tree, x), _root(tree, y)
                    if a != b:
                        tree[max(a, b)] = min(a, b)
                        edges.append((x, y))
            yield _edges(group, edges)
        give_back()

    return found.unionByName(by_group(both, "key", "block", "portion").mapInArrow(by_rest, "a long, b long"))


def _edges(group: pa.Table, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    nodes = group["node"].to_numpy()
    ends = np.array(edges, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(nodes[ends[:, 0]]), pa.array(nodes[ends[:, 1]])], names=["a", "b"])


def by_group(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartition(*keys).sortWithinPartitions(*keys)


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of two or more rows with equal integer keys, from batches that are sorted by them."""
    held: list[pa.Table] = []
    held_key: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table[k].to_numpy() for k in keys]
        change = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        edge = [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]
        if held and tuple(c[0] for c in columns) != held_key:
            yield from _long(held)
            held = []
        last = len(edge) - 2
        for n in np.flatnonzero(np.diff(edge) > 1).tolist() if not held else sorted({0, *np.flatnonzero(np.diff(edge) > 1).tolist()}):
            if n == last:
                continue
            part = table.slice(edge[n], edge[n + 1] - edge[n])
            if n == 0 and held:
                yield from _long([*held, part])
                held = []
            else:
                yield part
        tail = table.slice(edge[last], edge[last + 1] - edge[last])
        held = [*held, tail] if last == 0 else [tail]
        held_key = tuple(c[-1] for c in columns)
    yield from _long(held)


def _long(parts: list[pa.Table]) -> Iterator[pa.Table]:
    if sum(p.num_rows for p in parts) > 1:
        yield pa.concat_tables(parts).combine_chunks()


def forest(n: int, near: Near) -> list[tuple[int, int]]:
    """Tree edges that connect 0..n-1 as all links do. near(x, others): which of the others are linked to x."""
    edges: list[tuple[int, int]] = []
    rest = np.arange(n)
    while len(rest):
        reached, rest = [int(rest[0])], rest[1:]
        while reached and len(rest):
            x = reached.pop()
            hit = near(x, rest)
            if hit.any():
                found = rest[hit].tolist()
                edges += [(x, y) for y in found]
                reached += found
                rest = rest[~hit]
    return edges


def _root(up: dict[int, int], x: int) -> int:
    top = x
    while (y := up.get(top, top)) != top:
        top = y
    while up.get(x, x) != top:
        up[x], x = top, up[x]
    return top


def _stars(edges: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Union-find: each node's smallest reachable node."""
    up: dict[int, int] = {}
    for a, b in edges:
        a, b = _root(up, a), _root(up, b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: _root(up, x) for x in list(up)}


def components(ws: Workspace, edges: DataFrame, name: str) -> DataFrame:
    """node, component (the smallest node reachable) for each node of the edges (a, b), both long.

    Distributed union-find: each partition first shrinks its edges to stars by union-find in memory; then large-star
    and small-star steps hang all neighbours of a node from the smallest, until a round changes nothing. Rounds grow
    with the logarithm of the nodes. Each round's edges are a table in the shared folder. A hub's edges are joined
    where they lie, by join_one.
    """

    def shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}
        pending: list[tuple[int, int]] = []
        for batch in batches:
            pending += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            if len(pending) > 200_000:
                up = _stars([*up.items(), *pending])
                pending = []
                if len(up) > 1_000_000:
                    yield _pairs(up)
                    up = {}
        if up or pending:
            yield _pairs(_stars([*up.items(), *pending]))
        del up, pending
        give_back()

    def _pairs(up: dict[int, int]) -> pa.RecordBatch:
        rows = [(a, b) for a, b in up.items() if a != b]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], names=["u", "v"])

    def stored(df: DataFrame, k: int) -> tuple[DataFrame, tuple]:
        df = ws.store(df, f"{name}-{k}")
        return df, tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    # links are stored first: where Python makes them, a task would else hold two workers at once
    edges = ws.store(edges.where("a <> b"), f"{name}-links")
    now, mark = stored(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).mapInArrow(shrink, "u long, v long").distinct(), 0)
    k = 0
    while mark[0]:
        total = 2 * mark[0]
        # what hot and other keys are taken from is made once
        held = (lambda df, _: df) if total <= BROADCAST_ROWS else (lambda df, part: ws.store(df, f"{name}-{part}"))
        both = now.union(now.select("v", "u"))
        least = held(both.groupBy("u").agg(F.least("u", F.min("v")).alias("lo"), F.count("*").alias("n")), "least")
        large = held(join_one(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("lo").alias("v")).where("u <> v").distinct(), "large")
        low = held(large.groupBy("u").agg(F.min("v").alias("lo"), F.count("*").alias("n")), "low")
        star = join_one(large, low, "u", total).select(F.col("v").alias("u"), F.col("lo").alias("v")).where("u <> v").union(low.select("u", "lo")).distinct()
        k += 1
        nxt, new_mark = stored(star, k)
        ws.drop(f"{name}-{k - 1}")
        now, same = nxt, new_mark == mark
        mark = new_mark
        if same:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
