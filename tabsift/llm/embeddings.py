"""Near-duplicate vectors by a pigeonhole over low-dimensional subspaces.

Unit vectors with a cosine of c lie at a squared distance of 2 - 2c. Rotated and cut into blocks of
coordinates, two such vectors cannot be farther apart than a block's share of that in every block.
Each block is a range join of its own, on a grid of cells; the union of what the blocks find is
verified on the whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsift.llm.blocks import block_rows, gathered, summed
from tabsift.llm.common import written
from tabsift.llm.components import components
from tabsift.operators.joins import keyed_join

COSINE = 0.95
WIDTH = 8
#: Vectors per cell that the grid aims at, and vectors of a cell that meet in one task.
CELL_ROWS = 200
TILE_ROWS = 8192
#: Allowance for 32-bit coordinates; it only lets more candidates through.
SLACK = 2e-5

_CHUNKS = "dim int, block int, cell long, homes long, visits long, data binary"


def matrix(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of a column: row numbers and a matrix of doubles, one per length.

    Null, empty and zero vectors and those with a null, NaN or infinite component are left out.
    """
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        vectors = values[offsets[rows][:, None] + np.arange(d)]
        good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
        if good.any():
            yield rows[good], vectors[good] + 0.0


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors with length 1; the largest component is taken out first, so squares stay finite."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks(dim: int, width: int = WIDTH) -> list[np.ndarray]:
    return np.array_split(np.arange(dim), max(1, round(dim / width)))


def classes(vectors: DataFrame, id: str, column: str) -> DataFrame:
    """``row, vec, first, copies``: the distinct usable vectors, numbered, as bytes of doubles."""
    equal = _bytes(vectors, id, column).filter("vec is not null").groupBy("vec").agg(
        F.min("_id").alias("first"), F.count("*").alias("copies"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids = np.arange(row, row + batch.num_rows)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(ids), *batch.columns], ["row", "vec", "first", "copies"])

    return written(equal.mapInArrow(number, "row long, vec binary, first long, copies long"), "vectors")


def _bytes(vectors: DataFrame, id: str, column: str) -> DataFrame:
    rows = vectors.select(F.col(id).cast("long").alias("_id"), F.col(column).cast("array<double>").alias("_v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec: list[bytes | None] = [None] * batch.num_rows
            for rows, found in matrix(batch.column(1)):
                for i, v in zip(rows.tolist(), found):
                    vec[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vec, pa.binary())], ["_id", "vec"])

    return rows.mapInArrow(run, "_id long, vec binary")


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and rotated unit vectors, one length at a time."""
    vecs = batch.column("vec").to_pylist()
    rows = batch.column("row").to_numpy()
    sizes = np.array([len(v) // 8 for v in vecs])
    for d in np.unique(sizes).tolist():
        own = np.flatnonzero(sizes == d)
        x = np.frombuffer(b"".join(vecs[i] for i in own), np.float64).reshape(-1, d)
        yield rows[own], unit(x) @ rotation(d)


def spread(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Mean and standard deviation of each rotated coordinate, by length of vector."""
    dims = [r[0] for r in vectors.select((F.octet_length("vec") / 8).cast("int")).distinct().collect()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_dim(batch):
                d = x.shape[1]
                part = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
                sums[str(d)] = sums.get(str(d), 0) + part
        for pdf in block_rows(sums):
            yield pa.RecordBatch.from_pandas(pdf, preserve_index=False)

    rows = vectors.select("row", "vec").mapInArrow(add, "name string, block long, task long, data binary")
    total = summed(rows, "float64")
    out = {}
    for d, flat in gathered(total, "float64", 2 * max(dims, default=0) + 1).items():
        d, n = int(d), max(flat[0], 1)
        mean = flat[1:d + 1] / n
        out[d] = mean, np.sqrt(np.maximum(flat[d + 1:2 * d + 1] / n - mean * mean, 1e-12))
    return out


def cells(x: np.ndarray, edges: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cell each point lies in, and the later cells within the budget: ``home, point, cell``.

    ``edges`` has the inner borders of each coordinate. Coordinates are taken one after the other
    and a choice is given up as soon as its squared distance exceeds the budget. Of two points in
    reach of each other the one in the earlier cell visits the other's, so later cells are enough.
    """
    n, k = x.shape
    per = edges.shape[1] + 1
    home = np.zeros(n, np.int64)
    point, code, used = np.arange(n), np.zeros(n, np.int64), np.zeros(n)
    for j in range(k):
        lower = np.concatenate([[-np.inf], edges[j]])
        upper = np.concatenate([edges[j], [np.inf]])
        home = home * per + np.searchsorted(edges[j], x[:, j], side="right")
        value = x[point, j][:, None]
        gap = np.maximum(np.maximum(lower - value, value - upper), 0.0)
        total = used[:, None] + gap * gap
        at, choice = np.nonzero(total <= budget)
        point, code, used = point[at], code[at] * per + choice, total[at, choice]
    later = code > home[point]
    return home, point[later], code[later]


def per_axis(vectors: int, width: int, cell_rows: int = CELL_ROWS) -> int:
    """Intervals per coordinate: as many as keep about ``cell_rows`` vectors in a cell, two at least."""
    return max(2, int((max(vectors, 1) / cell_rows) ** (1 / width)))


def chunks(
    vectors: DataFrame, count: int, spreads: dict[int, tuple[np.ndarray, np.ndarray]], cosine: float,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """What each task has for each cell: its vectors (``homes``) and its visitors, as one binary.

    A vector goes as its number and the coordinates of the block and the one after it.
    """
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = {c.split(" ")[0]: [] for c in _CHUNKS.split(", ")}
        for ids, x in _joined(batches):
            d = x.shape[1]
            parts = blocks(d)
            mean, deviation = spreads[d]
            for b, own in enumerate(parts):
                per = per_axis(count, len(own), cell_rows)
                cuts = np.array([NormalDist().inv_cdf(i / per) for i in range(1, per)])
                edges = mean[own][:, None] + deviation[own][:, None] * cuts
                budget = (2 - 2 * cosine) * len(own) / d + SLACK
                home, point, code = cells(x[:, own], edges, budget)
                after = parts[(b + 1) % len(parts)]
                both = np.concatenate([own, after]) if len(parts) > 1 else own
                coords = x[:, both].astype(np.float32)
                _group(out, d, b, home, point, code, ids, coords)
                if len(out["cell"]) >= 4096:
                    yield _chunk_batch(out)
                    out = {c: [] for c in out}
        if out["cell"]:
            yield _chunk_batch(out)

    return vectors.select("row", "vec").mapInArrow(send, _CHUNKS)


def _joined(batches: Iterator[pa.RecordBatch], rows: int = 50_000):
    """Vectors of one length from several batches together, so that cells fill up."""
    held: dict[int, list] = {}
    for batch in batches:
        for ids, x in _by_dim(batch):
            own = held.setdefault(x.shape[1], [])
            own.append((ids, x))
            if sum(len(i) for i, _ in own) >= rows:
                yield np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])
                held[x.shape[1]] = []
    for own in held.values():
        if own:
            yield np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own])


def _group(out, d, b, home, point, code, ids, coords) -> None:
    n = len(home)
    cell = np.concatenate([home, code])
    who = np.concatenate([np.arange(n), point])
    order = np.argsort(cell, kind="stable")  # the homes of a cell stay before its visitors
    cell, who, is_home = cell[order], who[order], order < n
    stops = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell))
    first = 0
    for stop in stops.tolist():
        w = who[first:stop]
        homes = int(is_home[first:stop].sum())
        out["dim"].append(d)
        out["block"].append(b)
        out["cell"].append(int(cell[first]))
        out["homes"].append(homes)
        out["visits"].append(stop - first - homes)
        out["data"].append(ids[w].tobytes() + coords[w].tobytes())
        first = stop


def _chunk_batch(out) -> pa.RecordBatch:
    types = {"dim": pa.int32(), "block": pa.int32(), "data": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(v, types.get(c, pa.int64())) for c, v in out.items()], list(out))


def tiled(sent: DataFrame, tile: int = TILE_ROWS) -> DataFrame:
    """Chunks with the tile of their cell, ``left`` and ``right``, they take part in.

    A cell with more vectors than a task should hold is cut into tiles by a hash of the vectors'
    numbers. Each pair of tiles is a task: home tiles with each other, visitor tiles with home tiles.
    """
    sizes = sent.groupBy(F.col("dim").alias("_d"), F.col("block").alias("_b"), F.col("cell").alias("_c")).agg(
        F.ceil(F.sum("homes") / tile).cast("int").alias("h"),
        F.ceil(F.sum("visits") / tile).cast("int").alias("v"))
    sizes = sizes.filter("h > 0 and (h > 1 or v > 1)")
    joined = keyed_join(sent, sizes, {"dim": "_d", "block": "_b", "cell": "_c"}, "left").drop("_d", "_b", "_c")
    plain = joined.filter("h is null").select(
        "dim", "block", "cell", F.lit(0).alias("left"), F.lit(0).alias("right"), "homes", "visits", "data")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, coords = _unpacked(r["data"], r["homes"] + r["visits"])
                out = {c: [] for c in ("dim", "block", "cell", "left", "right", "homes", "visits", "data")}
                own, guests = slice(0, r["homes"]), slice(r["homes"], None)
                homes, visits = ids[own] % r["h"], ids[guests] % max(r["v"], 1)
                # Tiles of homes are numbered from 0, tiles of visitors from h.
                for i in range(r["h"]):
                    part = np.flatnonzero(homes == i)
                    pairs = [(min(i, k), max(i, k)) for k in range(r["h"])] + [(i, r["h"] + k) for k in range(r["v"])]
                    if len(part):
                        for pair in pairs:
                            _add(out, r, pair, ids[own][part], coords[own][part], i == pair[0], len(part))
                for k in range(r["v"]):
                    part = np.flatnonzero(visits == k)
                    if len(part):
                        for i in range(r["h"]):
                            _add(out, r, (i, r["h"] + k), ids[guests][part], coords[guests][part], False, len(part))
                types = {"data": pa.binary(), "cell": pa.int64(), "homes": pa.int64(), "visits": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, types.get(c, pa.int32())) for c, v in out.items()], list(out))

    cut = joined.filter("h is not null").mapInArrow(
        split, "dim int, block int, cell long, left int, right int, homes long, visits long, data binary")
    return plain.unionByName(cut)


def _add(out, row, pair, ids, coords, is_home: bool, n: int) -> None:
    for c in ("dim", "block", "cell"):
        out[c].append(row[c])
    out["left"].append(pair[0])
    out["right"].append(pair[1])
    out["homes"].append(n if is_home else 0)
    out["visits"].append(0 if is_home else n)
    out["data"].append(ids.tobytes() + coords.tobytes())


def _unpacked(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(data, np.int64, n), np.frombuffer(data, np.float32, offset=8 * n).reshape(n, -1)


def candidates(tiles: DataFrame, cosine: float) -> DataFrame:
    """``a, b``, numbers of vectors that lie within the budget of some block and of it and the next.

    Some block of a similar pair has its own sum of squares and the sum over the next block within
    their shares: sums of surplus around the ring of blocks cannot exceed 0 from every start.
    """
    def compare(table: pa.Table) -> pa.Table:
        d, b = table.column("dim")[0].as_py(), table.column("block")[0].as_py()
        parts = blocks(d)
        width, after = len(parts[b]), len(parts[(b + 1) % len(parts)])
        share = (2 - 2 * cosine) / d
        own, guests = [], []
        for r in table.select(["homes", "visits", "data"]).to_pylist():
            ids, coords = _unpacked(r["data"], r["homes"] + r["visits"])
            own.append((ids[:r["homes"]], coords[:r["homes"]]))
            guests.append((ids[r["homes"]:], coords[r["homes"]:]))
        hid, hx = (np.concatenate([p[i] for p in own]) for i in (0, 1))
        vid, vx = (np.concatenate([p[i] for p in guests]) for i in (0, 1))
        found = []
        within = table.column("left")[0] == table.column("right")[0]
        for start in range(0, len(hid), 1024):
            ids, x = hid[start:start + 1024], hx[start:start + 1024]
            if within:
                found += _near(ids, x, hid[start:], hx[start:], width, after, share, len(parts) > 1)
            found += _near(ids, x, vid, vx, width, after, share, len(parts) > 1)
        a = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        c = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        kept = a != c
        a, c = a[kept], c[kept]
        return pa.table({"a": np.minimum(a, c), "b": np.maximum(a, c)})

    met = tiles.groupBy("dim", "block", "cell", "left", "right").applyInArrow(compare, "a long, b long")
    return met.distinct()


def _near(ids, x, others, y, width, after, share, ring):
    out = []
    for start in range(0, len(others), 4096):
        z = y[start:start + 4096]
        gaps = _squares(x[:, :width], z[:, :width])
        i, j = np.nonzero(gaps <= share * width + SLACK)
        if ring and len(i):
            total = ((x[i] - z[j]) ** 2).sum(1)
            good = total <= share * (width + after) + SLACK
            i, j = i[good], j[good]
        out.append((ids[i], others[start:start + 4096][j]))
    return out


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)


def links(pairs: DataFrame, vectors: DataFrame, cosine: float) -> DataFrame:
    """The pairs whose cosine, in doubles, is at least ``cosine``."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.float64), np.frombuffer(y.as_buffer(), np.float64)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                keep.append(bool(x @ y >= cosine * np.sqrt((x @ x) * (y @ y))))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    one = keyed_join(pairs, vectors.select(F.col("row").alias("_x"), F.col("vec").alias("x")), {"a": "_x"})
    two = keyed_join(one.select("a", "b", "x"),
                     vectors.select(F.col("row").alias("_y"), F.col("vec").alias("y")), {"b": "_y"})
    return two.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, id: str = "vec_id", column: str = "embedding",
    cell_rows: int = CELL_ROWS, tile: int = TILE_ROWS,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors of one length link when their cosine is ``cosine`` or more. ``n_links`` counts the
    other rows a row links with, ``component_id`` is the smallest id that links reach and ``kept``
    marks the row that has it. Equal vectors are one on the way and are counted, not paired.

    Vectors that are null, empty or zero, or hold a null, NaN or infinite component, link with
    nothing; so do vectors of different lengths. Repeated rows count as rows of their own; null ids
    are disregarded for the smallest. An empty table gives an empty table; other columns are not
    read. Memory is bounded by tiles, whatever number of vectors lies in one cell.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must lie above 0 and be at most 1")
    distinct = classes(vectors, id, column)
    count = distinct.count()
    sent = chunks(distinct, count, spread(distinct), cosine, cell_rows)
    tiles = tiled(written(sent, "chunks"), tile)
    found = written(links(candidates(tiles, cosine), distinct, cosine), "near")

    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    copies = distinct.select(F.col("row").alias("_row"), "copies")
    others = keyed_join(both, copies, {"b": "_row"}).groupBy(F.col("a").alias("_a")).agg(
        F.sum("copies").alias("_others"))
    roots = components(found).select(F.col("node").alias("_node"), F.col("component").alias("_root"))
    rooted = keyed_join(distinct, others, {"row": "_a"}, "left")
    rooted = keyed_join(rooted, roots, {"row": "_node"}, "left").select(
        "vec", "first", F.coalesce("_root", "row").alias("root"),
        (F.coalesce("_others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    smallest = rooted.groupBy(F.col("root").alias("_r")).agg(F.min("first").alias("component_id"))
    named = keyed_join(rooted, smallest, {"root": "_r"}).select(
        F.col("vec").alias("_vec"), "n_links", "component_id")
    rows = keyed_join(_bytes(vectors, id, column), written(named, "named"), {"vec": "_vec"}, "left")
    component = F.when(F.col("vec").isNull(), F.col("_id")).otherwise(F.col("component_id"))
    return rows.select(
        F.col("_id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("_id").eqNullSafe(component).alias("kept"))
