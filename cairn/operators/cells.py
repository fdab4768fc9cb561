"""Pivot cells: exact vector joins that skip what the triangle inequality on angles rules out.

A bounded sample of the vectors serves as pivots; every vector belongs to the cell of its nearest
pivot. If x lies in cell i and y in cell j, and their angle is at most r, then

    angle(x, p_j) <= radius_j + r                       (y is within the radius of its cell)
    angle(x, p_j) <= angle(x, p_i) + 2 r                (y is nearer to p_j than to p_i)

so x has to visit cell j only if both hold. Neighbouring cells are packed into groups of about
``block_rows`` rows, a larger cell is dealt to several groups by hash, and one group with a bounded chunk of
its visitors is one task's work: the group is held, its visitors stream past it. Where vectors have no structure
every group is visited, which is the cost of blocks without pivots; where they have, most groups are not. Groups are
made larger (``widened``) where a vector would otherwise be copied to many of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .util import materialize

MAX_PIVOTS = 1024      # of a dimension that the caller bounds: the only vectors that the driver sees
MARGIN = 1e-6          # radians, for the rounding of cosines
PIECE = 1024           # rows of a batch that are compared with all pivots at once
SLICE = 8192           # copies of rows in a frame that leaves a task
COPIES = 12            # of a vector, on average, before groups are made larger
GROUP_BYTES = 1 << 26  # of a group's vectors
PRODUCT = 1 << 22      # cells of a product that is looked through at once


def stacked(vectors) -> np.ndarray:
    """Rows of doubles from arrays of numbers or from what ``packed`` made of them."""
    vectors = list(vectors)
    if not isinstance(vectors[0], (bytes, bytearray)):
        return np.vstack([np.asarray(v, np.float64) for v in vectors])
    sparse = [len(v) % 8 > 0 for v in vectors]
    if not any(sparse):
        return np.frombuffer(b"".join(vectors), np.float64).reshape(len(vectors), -1)
    k = sparse.index(True)
    out = np.zeros((len(vectors), int(np.frombuffer(vectors[k], np.int32, 1)[0])))
    for row, v, few in zip(out, vectors, sparse):
        if few:
            n = len(v) // 12
            row[np.frombuffer(v, np.int32, n, 4)] = np.frombuffer(v, np.float64, n, 4 + 4 * n)
        else:
            row[:] = np.frombuffer(v, np.float64)
    return out


def packed(x: np.ndarray) -> list[bytes]:
    """The rows of ``x`` as the bytes of doubles, or, if shorter, as the width, the places of other values than 0 and these."""
    x, dim = np.ascontiguousarray(x, np.float64), x.shape[1]
    out = []
    for row in x:
        at = np.flatnonzero(row)
        if len(at) % 2:            # an odd number of doubles would look like a whole row
            at = np.append(at, np.flatnonzero(row == 0)[:1])
        short = len(at) % 2 == 0 and 4 + 12 * len(at) < 8 * dim
        out.append(b"".join((np.int32(dim).tobytes(), at.astype(np.int32).tobytes(), row[at].tobytes())) if short else row.tobytes())
    return out


def directions(x: np.ndarray) -> np.ndarray:
    """Unit rows; a zero row stays zero."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1.0)


@dataclass
class Layout:
    pivots: np.ndarray     # [cells, dim] unit rows
    radius: np.ndarray     # [cells] largest angle of a row to its pivot
    longest: np.ndarray    # [cells] largest norm of a row
    first: np.ndarray      # [cells] first group of a cell
    parts: np.ndarray      # [cells] groups that a cell is dealt to (more than one if it is large)
    size: np.ndarray       # [cells] rows

    @property
    def groups(self) -> int:
        return int((self.first + self.parts).max())

    def angles(self, x: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(directions(x) @ self.pivots.T, -1.0, 1.0))

    def group_of(self, cell: np.ndarray, salt: np.ndarray) -> np.ndarray:
        return self.first[cell] + salt % self.parts[cell]

    def spread(self, allowed: np.ndarray) -> np.ndarray:
        """[rows, groups] from [rows, cells]."""
        out = np.zeros((len(allowed), self.groups), bool)
        for c in range(len(self.first)):
            out[:, self.first[c]:self.first[c] + self.parts[c]] |= allowed[:, c:c + 1]
        return out

    def packed(self, block_rows: int) -> Layout:
        """The same cells in groups of another size."""
        return Layout(self.pivots, self.radius, self.longest, *_groups(self.size, block_rows), self.size)

    def near(self, angle: np.ndarray, cell: np.ndarray, reach: float) -> np.ndarray:
        """[rows, cells]: which cells may hold a row within ``reach`` of each row."""
        own = angle[np.arange(len(angle)), cell][:, None]
        return (self.size > 0) & (angle <= self.radius + reach + MARGIN) & (angle <= own + 2 * reach + MARGIN)

    def bound(self, angle: np.ndarray) -> np.ndarray:
        """[rows, cells]: what the dot product of a unit row with a row of each cell cannot exceed."""
        cosine = np.cos(np.maximum(angle - self.radius - MARGIN, 0.0))
        return np.where(self.size > 0, np.where(cosine > 0, cosine * self.longest, 0.0) + 1e-9 * self.longest, -np.inf)


def lay_out(vecs: DataFrame, n: int, block_rows: int, seed: int = 0) -> tuple[DataFrame, Layout]:
    """(id, vec, salt, cell, angle) of ``vecs(id, vec)``, all of one width, and the cells they make."""
    few = 1 if n <= block_rows else max(1, min(MAX_PIVOTS, n, 2 * math.ceil(math.sqrt(n))))
    picked = vecs.orderBy(F.xxhash64("id", F.lit(seed)), "id").select("vec").limit(few).collect()
    pivots = directions(stacked([r.vec for r in picked]) if picked else np.zeros((1, 1)))
    pivots = pivots[_chain(pivots)]

    def assign(frames):
        for f in _pieces(frames):
            x = stacked(f["vec"])
            angle = np.arccos(np.clip(directions(x) @ pivots.T, -1.0, 1.0))
            cell = angle.argmin(axis=1)
            yield f.assign(cell=cell.astype("int32"), angle=angle[np.arange(len(x)), cell], norm=np.linalg.norm(x, axis=1))

    kind = dict(vecs.dtypes)["vec"]
    salted = vecs.select("id", "vec", F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(1 << 30)).alias("salt"))
    rows = materialize(salted.mapInPandas(assign, f"id long, vec {kind}, salt long, cell int, angle double, norm double"), "cells")
    size, radius, longest = (np.zeros(len(pivots)) for _ in range(3))
    for r in rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("a"), F.max("norm").alias("m")).collect():
        size[r.cell], radius[r.cell], longest[r.cell] = r.n, r.a, r.m
    # pivots are in an order in which neighbours follow each other
    return rows, Layout(pivots, radius, longest, *_groups(size, block_rows), size)


def _groups(size: np.ndarray, block_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First group and number of groups of each cell."""
    first, parts = np.zeros(len(size), np.int64), np.ones(len(size), np.int64)
    group, held = 0, 0
    for c, k in enumerate(size):
        if held and held + k > block_rows:
            group, held = group + 1, 0
        first[c], parts[c] = group, max(1, math.ceil(k / block_rows))
        held += k
        if parts[c] > 1:
            group, held = group + parts[c], 0
    return first, parts


def _pieces(frames):
    for f in frames:
        for at in range(0, len(f), PIECE):
            yield f.iloc[at:at + PIECE]


def _copied(f: pd.DataFrame, at: np.ndarray, **columns):
    """The rows ``at`` of ``f`` (a row as often as it is named) with ``columns`` beside them, some at a time."""
    for k in range(0, len(at), SLICE):
        yield f.iloc[at[k:k + SLICE]][["id", "vec"]].assign(**{c: v if np.isscalar(v) else v[k:k + SLICE] for c, v in columns.items()})


def _chain(pivots: np.ndarray) -> list[int]:
    """An order in which each pivot is followed by the nearest one left."""
    left = np.ones(len(pivots), bool)
    out = [0]
    left[0] = False
    for _ in range(len(pivots) - 1):
        near = np.where(left, pivots @ pivots[out[-1]], -2.0)
        out.append(int(near.argmax()))
        left[out[-1]] = False
    return out


def visit_counts(visitors: DataFrame, layout: Layout, choose) -> np.ndarray:
    """How many rows of ``visitors`` each group receives; ``choose(frame)`` gives [rows, groups]."""
    def count(frames):
        total = np.zeros(layout.groups, np.int64)
        for f in _pieces(frames):
            total += choose(f).sum(axis=0)
        yield pd.DataFrame({"grp": np.flatnonzero(total), "n": total[total > 0]}).astype({"grp": "int64", "n": "int64"})

    out = np.zeros(layout.groups, np.int64)
    for r in visitors.mapInPandas(count, "grp long, n long").groupBy("grp").agg(F.sum("n").alias("n")).collect():
        out[r.grp] = r.n
    return out


def widened(visitors: DataFrame, n: int, layout: Layout, block_rows: int, choose_of,
            group_bytes: int = GROUP_BYTES) -> tuple[Layout, int, np.ndarray]:
    """(layout, block_rows, counts): the groups made so large that each of the ``n`` visitors goes to ``COPIES`` of them
    on average, or until a group holds ``group_bytes``. ``choose_of(layout)`` gives the choice of groups."""
    most = max(block_rows, group_bytes // (8 * layout.pivots.shape[1]))
    while True:
        counts = visit_counts(visitors, layout, choose_of(layout)) if layout.groups > 1 else np.zeros(layout.groups, np.int64)
        if counts.sum() <= COPIES * n or block_rows >= most:
            return layout, block_rows, counts
        block_rows = min(most, block_rows * max(2, math.ceil(counts.sum() / (COPIES * n))))
        layout = layout.packed(block_rows)


def dealt(homes: DataFrame, visitors: DataFrame, layout: Layout, choose, counts: np.ndarray, chunk_rows: int,
          alone: bool = False) -> DataFrame:
    """(id, vec, home, grp, part): every group's homes with each chunk of its visitors, a chunk in one partition and its
    homes before its visitors. With ``alone`` the homes of a group also come by themselves, as part -1."""
    chunks = np.maximum(1, -(-counts // chunk_rows)) * (counts > 0)

    def home(frames):
        for f in _pieces(frames):
            group = layout.group_of(f["cell"].to_numpy(), f["salt"].to_numpy()).astype("int64")
            times = chunks[group] + alone
            at = np.repeat(np.arange(len(f)), times)
            part = np.concatenate([np.arange(t, dtype=np.int64) - alone for t in times])
            yield from _copied(f, at, home=True, grp=group[at], part=part)

    def visit(frames):
        for f in _pieces(frames):
            at, group = np.nonzero(choose(f))
            part = f["salt"].to_numpy()[at] // 7 % np.maximum(chunks[group], 1)
            yield from _copied(f, at, home=False, grp=group.astype("int64"), part=part.astype("int64"))

    kind = f"id long, vec {dict(homes.dtypes)['vec']}, home boolean, grp long, part long"
    both = homes.mapInPandas(home, kind)
    if counts.any():
        both = both.unionByName(visitors.mapInPandas(visit, kind))
    return gathered(both)


def gathered(rows: DataFrame) -> DataFrame:
    """``rows`` with (home, grp, part): a chunk in one partition, a group's homes before its visitors."""
    return rows.repartition("grp", "part").sortWithinPartitions("grp", "part", F.col("home").desc())


def meet(homes: DataFrame, visitors: DataFrame, layout: Layout, choose, counts: np.ndarray, chunk_rows: int, run, schema: str,
         alone: bool = False) -> DataFrame:
    """Every group's homes with each chunk of its visitors: ``run(homes, visitors)`` yields frames from two (id, vec),
    the second of which is a batch of the chunk. With ``alone`` the homes of a group also come by themselves, with None for
    visitors."""
    def work(frames):
        place, held, some = None, [], None

        def by_themselves():
            if place is not None and place[1] < 0 and held:
                yield from run(pd.concat(held), None)

        for f in frames:
            if not len(f):
                continue
            grp, part = f["grp"].to_numpy(), f["part"].to_numpy()
            cut = np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1])) + 1
            for a, b in zip([0, *cut], [*cut, len(f)]):
                if (grp[a], part[a]) != place:
                    yield from by_themselves()
                    place, held, some = (grp[a], part[a]), [], None
                is_home = f["home"].to_numpy()[a:b]
                if is_home.any():
                    held.append(f.iloc[a:b][is_home])
                if held and not is_home.all():
                    some = pd.concat(held) if some is None else some
                    yield from run(some, f.iloc[a:b][~is_home])
        yield from by_themselves()

    return dealt(homes, visitors, layout, choose, counts, chunk_rows, alone).mapInPandas(work, schema)


def inner_visits(layout: Layout, reach: float):
    """For a self-join: a row visits the groups after its own that may hold a partner."""
    def choose(f: pd.DataFrame) -> np.ndarray:
        cell = f["cell"].to_numpy()
        own = layout.group_of(cell, f["salt"].to_numpy())
        allowed = layout.spread(layout.near(layout.angles(stacked(f["vec"])), cell, reach))
        return allowed & (np.arange(layout.groups) > own[:, None])

    return choose
