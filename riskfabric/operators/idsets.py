"""Sets of ids below the nodes of a graph, counted without a row or a bitmap per (node, id) leaving a task.

Ids are dealt by ranges of 32,768 into PARTS parts. A part gets the pairs of its ids and a copy of the edges, packed into a few bytes a pair, and
passes its sets from node to node hop by hop in numpy, as many ids at once as MATRIX bytes hold for the nodes concerned. Only counts leave it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskfabric.session import cut

PARTS = 64
RANGE_BITS = 15
#: Bytes of one of the bit matrices of a task; it holds two of them and pieces of PIECE bytes.
MATRIX = 32 << 20
PIECE = 16 << 20
#: Pairs that are packed together, and expanded together.
TOGETHER = 1_000_000
EDGES, OWNED, USED, WEIGHTS, COUNTS = range(5)
ROWS = "part int, kind int, a binary, b binary, root long, n long, weight long"


def _squeezed(values: np.ndarray) -> bytes:
    """Whole numbers as their least one and what each has above it, in 1, 2, 4 or 8 bytes."""
    low = values.min()
    over = values.view(np.uint64) - low.view(np.uint64)
    size = next(s for s in (1, 2, 4, 8) if s == 8 or over.max() < 1 << 8 * s)
    return np.int64(low).tobytes() + bytes([size]) + over.astype(f"<u{size}").tobytes()


def _restored(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, f"<u{blob[8]}", offset=9).astype(np.uint64).view(np.int64) + np.frombuffer(blob, "<i8", 1)


def _part(ids: Column) -> Column:
    return F.pmod(F.shiftright(ids, RANGE_BITS), F.lit(PARTS)).cast("int")


def _blobs(part: np.ndarray, a: np.ndarray, b: np.ndarray, kind: int) -> pa.RecordBatch:
    """The pairs of each part in one row, in order of `a`."""
    order = np.lexsort((b, a, part))
    part, a, b = part[order], a[order], b[order]
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else [0]
    spans = list(zip(cuts, cuts[1:], strict=False))
    nothing = pa.nulls(len(spans), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array([int(part[i]) for i, _ in spans], pa.int32()), pa.array([kind] * len(spans), pa.int32()), pa.array([_squeezed(a[i:j]) for i, j in spans], pa.binary()),
         pa.array([_squeezed(b[i:j]) for i, j in spans], pa.binary()), nothing, nothing, nothing], names=["part", "kind", "a", "b", "root", "n", "weight"])


def _packed(pairs: DataFrame, a: str, b: str, part: Column, kind: int) -> DataFrame:
    """The pairs as rows of ROWS. Pairs with a null are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            rows += batch.num_rows
            if rows >= TOGETHER:
                yield _blobs(*(np.concatenate(c) for c in zip(*held, strict=True)), kind)
                held, rows = [], 0
        if rows:
            yield _blobs(*(np.concatenate(c) for c in zip(*held, strict=True)), kind)

    both = pairs.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).filter("a is not null and b is not null")
    return both.select(part.alias("part"), "a", "b").mapInArrow(run, ROWS)


def _read(batches: Iterator[pa.RecordBatch]) -> dict[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """By part and kind, the pairs of a partition."""
    found: dict[int, dict[int, list]] = {}
    for batch in batches:
        for part, kind, a, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found.setdefault(part, {}).setdefault(kind, []).append((_restored(a), _restored(b)))
    nothing = [(np.zeros(0, np.int64),) * 2]
    return {part: {kind: tuple(np.concatenate(c) for c in zip(*kinds.get(kind, nothing), strict=True)) for kind in range(COUNTS)} for part, kinds in found.items()}


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one run after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Below:
    """Sets of items owned through groups, for the nodes of a graph and what lies up to `hops` edges below them."""

    def __init__(self, owned: tuple[np.ndarray, np.ndarray], edges: tuple[np.ndarray, np.ndarray], groups: np.ndarray, hops: int) -> None:
        """owned: (node, group); edges: (from, to); groups: the ids of all groups, in order."""
        self.names = np.unique(np.concatenate([owned[0], *edges]))
        node = np.searchsorted(self.names, owned[0])
        order = np.argsort(node, kind="stable")
        self.node, self.group = node[order], np.searchsorted(groups, owned[1])[order]
        src, dst = (np.searchsorted(self.names, e) for e in edges)
        order = np.argsort(src, kind="stable")
        self.src, self.dst, self.hops, self.groups = src[order], dst[order], hops, len(groups)

    def slices(self, group: np.ndarray, item: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
        """(node ids, bit rows, first item, items) for slices of the items, which are (group number, whole number from 0 on) pairs."""
        low, high = (int(item.min()), int(item.max()) + 1) if len(item) else (0, 0)
        while low < high:
            owning = np.zeros(self.groups, bool)
            owning[group[item >= low]] = True
            active = np.zeros(len(self.names), bool)
            active[self.node[owning[self.group]]] = True
            for _ in range(self.hops):
                grown = active.copy()
                grown[self.src[active[self.dst]]] = True
                if (grown == active).all():
                    break
                active = grown
            nodes = np.flatnonzero(active)
            words = int(np.clip(MATRIX // (8 * max(len(nodes), 1)), 1, 1 << RANGE_BITS - 6))
            here = (item >= low) & (item < low + 64 * words)
            if here.any():
                yield self.names[nodes], self._spread(nodes, group[here], item[here] - low, words), low, 64 * words
            low += 64 * words

    def _spread(self, nodes: np.ndarray, group: np.ndarray, bit: np.ndarray, words: int) -> np.ndarray:
        order = np.argsort(group, kind="stable")
        group, bit = group[order], bit[order]
        size = np.bincount(group, minlength=self.groups)
        start = np.cumsum(size) - size
        at = np.full(len(self.names), -1)
        at[nodes] = np.arange(len(nodes))
        some = size[self.group] > 0
        owner, of = at[self.node[some]], self.group[some]
        rows = np.zeros((len(nodes), words), np.uint64)
        total, most, i = np.cumsum(size[of]), max(1, PIECE // (64 * words)), 0
        while i < len(owner):  # a piece of few nodes and few items, at least one group of one node
            j = min(np.searchsorted(total, total[i] + TOGETHER), np.searchsorted(owner, owner[i] + most))
            j = max(int(j), i + 1)
            first, n = owner[i], owner[j - 1] - owner[i] + 1
            flags = np.zeros((n, 64 * words), bool)
            flags[np.repeat(owner[i:j] - first, size[of[i:j]]), bit[_ragged(start[of[i:j]], size[of[i:j]])]] = True
            rows[first:first + n] |= np.packbits(flags, axis=1, bitorder="little").view("<u8")
            i = j
        inside = (at[self.src] >= 0) & (at[self.dst] >= 0)
        src, dst = at[self.src[inside]], at[self.dst[inside]]
        step = max(1, PIECE // (8 * words))
        for _ in range(self.hops):
            carried = rows.any(axis=1)[dst]
            s, d = src[carried], dst[carried]
            grown = rows.copy()
            for k in range(0, len(s), step):
                to = s[k:k + step]
                firsts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1))
                grown[to[firsts]] |= np.bitwise_or.reduceat(rows[d[k:k + step]], firsts, axis=0)
            rows = grown
        return rows


def _counts(roots: list[np.ndarray], counts: list[np.ndarray], weights: list[np.ndarray]) -> pa.RecordBatch:
    """A row per root with what its slices have in sum."""
    if not roots:
        roots = counts = weights = [np.zeros(0, np.int64)]
    root, at = np.unique(np.concatenate(roots), return_inverse=True)
    sums = [np.zeros(len(root), np.int64) for _ in range(2)]
    for into, values in zip(sums, (counts, weights), strict=True):
        np.add.at(into, at, np.concatenate(values))
    nothing = pa.nulls(len(root), pa.binary())
    return pa.RecordBatch.from_arrays([pa.nulls(len(root), pa.int32()), pa.array(np.full(len(root), COUNTS, np.int32)), nothing, nothing, pa.array(root), *map(pa.array, sums)],
                                      names=["part", "kind", "a", "b", "root", "n", "weight"])


def _ranges(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first id, rows) of each range of ids."""
    of = ids >> RANGE_BITS
    for number in np.unique(of):
        yield int(number) << RANGE_BITS, np.flatnonzero(of == number)


def _components(hops: int):
    """Counts of the part's components by root; developers and users of its components, dealt to the parts of the devices."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            (vendor, comp), edges, (user, device), (known, weight) = kinds[OWNED], kinds[EDGES], kinds[USED], kinds[WEIGHTS]
            if not len(comp):
                continue
            roots, counts, weights = [], [], []
            for first, rows in _ranges(comp):
                groups = np.unique(comp[rows])
                mine = np.isin(known, groups)
                weight_of = np.zeros(2 << RANGE_BITS, np.int64)  # a slice may end behind the range
                weight_of[known[mine] - first] = weight[mine]
                sets = _Below((vendor[rows], comp[rows]), edges, groups, hops)
                for names, bits, low, n in sets.slices(np.arange(len(groups)), groups - first):
                    sized = weight_of[low:low + n]
                    total = np.zeros(len(names), np.int64)
                    for place in range(int(sized.max()).bit_length()):  # a weight is the sum of its binary places
                        plane = np.packbits((sized >> place & 1).astype(bool), bitorder="little").view("<u8")
                        total += np.bitwise_count(bits & plane).sum(axis=1, dtype=np.int64) << place
                    roots.append(names)
                    counts.append(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
                    weights.append(total)
            yield _counts(roots, counts, weights)
            groups = np.unique(comp)
            kept = np.isin(user, groups)
            user, device = user[kept], device[kept]
            to = (device >> RANGE_BITS) % PARTS
            own, used = np.searchsorted(groups, comp), np.searchsorted(groups, user)
            for part in np.unique(to):
                mine = to == part
                wanted = np.zeros(len(groups), bool)
                wanted[used[mine]] = True
                pairs = wanted[own]
                yield _blobs(np.full(mine.sum(), part, np.int32), user[mine], device[mine], USED)
                yield _blobs(np.full(pairs.sum(), part, np.int32), vendor[pairs], comp[pairs], OWNED)

    return run


def _devices(hops: int):
    """Counts of the part's devices by root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kinds in _read(batches).values():
            (vendor, comp), edges, (user, device) = kinds[OWNED], kinds[EDGES], kinds[USED]
            roots, counts = [], []
            for first, rows in _ranges(device):
                groups = np.unique(user[rows])
                pairs = np.isin(comp, groups)
                sets = _Below((vendor[pairs], comp[pairs]), edges, groups, hops)
                for names, bits, _, _ in sets.slices(np.searchsorted(groups, user[rows]), device[rows] - first):
                    roots.append(names)
                    counts.append(np.bitwise_count(bits).sum(axis=1, dtype=np.int64))
            yield _counts(roots, counts, [np.zeros(len(c), np.int64) for c in counts])

    return run


def counts_below(edges: DataFrame, developed: DataFrame, runs: DataFrame, weights: DataFrame, hops: int) -> DataFrame:
    """(root, component_count, active_cves, device_count) of what a vendor and those up to `hops` edges below it develop, each id once.

    edges(src, dst), developed(vendor_id, comp_id), runs(device_id, comp_id), weights(comp_id, _cves), a component's number of CVEs. All ids are whole numbers.
    """
    whole = F.lit(0)
    everywhere = cut(_packed(edges, "src", "dst", whole, EDGES)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def dealt(frames: list[DataFrame], run) -> DataFrame:
        return reduce(DataFrame.unionByName, frames).repartitionById(PARTS, F.col("part")).mapInArrow(run, ROWS)

    first = cut(dealt([everywhere, _packed(developed, "vendor_id", "comp_id", _part(F.col("b")), OWNED), _packed(runs, "comp_id", "device_id", _part(F.col("a")), USED),
                       _packed(weights, "comp_id", "_cves", _part(F.col("a")), WEIGHTS)], _components(hops)))
    last = dealt([everywhere, first.filter(F.col("kind") != COUNTS)], _devices(hops))
    by_root = [F.col("root"), F.col("n"), F.col("weight")]
    rows = first.filter(F.col("kind") == COUNTS).select(*by_root, F.lit(0).cast("long").alias("devices")).unionByName(
        last.select("root", F.lit(0).cast("long").alias("n"), "weight", F.col("n").alias("devices")))
    return rows.groupBy("root").agg(F.sum("n").alias("component_count"), F.sum("weight").alias("active_cves"), F.sum("devices").alias("device_count"))
