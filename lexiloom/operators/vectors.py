"""Vector store: rows (ext_id, embedding), exact cosine top-k."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..storage import step

#: Most numbers in a block of vectors (8 bytes each): what a broadcast or one side of a pair of blocks may hold.
BLOCK_NUMBERS = 4_000_000
#: Rows and queries of one matrix product.
TILE = 1024
#: Most cells of vectors of one length, and the rows of the store for each.
CELLS, CELL_ROWS = 256, 4096
#: Angles within this of a bound count as within it.
SLACK = 1e-6
#: Below every likeness, above the mark of pairs that are none.
LEAST = np.float32(-2)
#: Pairs of blocks for each core at least, so that cores end together.
PAIRS_A_CORE = 4


def add(store: DataFrame, more: DataFrame) -> DataFrame:
    return store.unionByName(more)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows in double of vectors of one length, and which of them have a norm."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    n = np.linalg.norm(x, axis=1)
    return x / np.where(n > 0, n, 1)[:, None], n > 0


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Each length of the vectors and the places of those that have it."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths):
        yield int(d), np.flatnonzero(lengths == d)


class _Best:
    """The k best of a block of queries of one length, fed with rows of the store.

    Products are made in single precision and compared with each query's k-th best so far, less what single precision may be off
    by; only pairs that reach it are computed in double. They are held until they are half as many as the best themselves.
    """

    def __init__(self, ids: pa.Array, unit: np.ndarray, has: np.ndarray, k: int, exclude_self: bool):
        self.ids, self.unit, self.has, self.k = ids, unit, has, k
        self.quick = unit.astype(np.float32)
        self.slack = np.float32((unit.shape[1] + 16) * 2.0**-22)
        self.least = np.full(len(ids), -np.inf)  # the k-th best so far
        self.best: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []  # queries, similarities, ids: the best, then what came since
        self.merged = self.held = 0
        self.known = ids.unique() if exclude_self else None
        self.places: dict[int, list[int]] = {}
        for i, c in enumerate(pc.index_in(ids, self.known).to_pylist() if exclude_self else []):
            self.places.setdefault(c, []).append(i)

    def _selves(self, own: pa.Array) -> list[tuple[int, int]]:
        """Places of queries and of rows with the same id."""
        if self.known is None:
            return []
        known = self.known
        if own.type != known.type:
            if not (pa.types.is_integer(own.type) and pa.types.is_integer(known.type)):
                return []
            own, known = own.cast(pa.int64()), known.cast(pa.int64())
        at = pc.index_in(own, known)
        rows = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        return [(i, int(j)) for j, c in zip(rows, at.drop_null().to_pylist(), strict=True) for i in self.places[c]]

    def feed(self, own: pa.Array, x: np.ndarray, length: np.ndarray) -> None:
        """Rows of the store: their ids, unit rows, and which of them have a norm."""
        for start in range(0, len(own), TILE):
            unit, has, names = x[start : start + TILE], length[start : start + TILE], own.slice(start, TILE)
            quick, selves = unit.astype(np.float32).T, self._selves(names)
            for first in range(0, len(self.ids), TILE):
                part = slice(first, first + TILE)
                like = self.quick[part] @ quick
                like[:, ~has] = -np.inf
                like[~self.has[part]] = -np.inf
                for i, j in selves:
                    if first <= i < first + TILE:
                        like[i - first, j] = -np.inf
                edge = self.least[part].astype(np.float32)
                new = np.flatnonzero(np.isneginf(edge))
                if len(new):
                    m = min(self.k, like.shape[1])
                    edge[new] = -np.partition(-like[new], m - 1, axis=1)[:, m - 1] - self.slack
                hits = np.flatnonzero(like >= np.maximum(edge - self.slack, LEAST)[:, None])
                for begin in range(0, len(hits), max(1, BLOCK_NUMBERS // unit.shape[1])):
                    i, j = np.divmod(hits[begin : begin + max(1, BLOCK_NUMBERS // unit.shape[1])], like.shape[1])
                    s = np.round(np.einsum("ij,ij->i", self.unit[first + i], unit[j]), 12)
                    reach = s >= self.least[first + i]
                    if reach.any():
                        self.best.append((first + i[reach], s[reach], names.take(pa.array(j[reach]))))
                        self.held += int(reach.sum())
                if self.held > TILE * TILE:
                    self.merge()
            if self.held * 2 > self.merged:
                self.merge()

    def merge(self) -> None:
        q, s = (np.concatenate([b[c] for b in self.best]) for c in (0, 1))
        ids = pa.concat_arrays([b[2] for b in self.best])
        table = pa.table([pa.array(q), pa.array(s), ids], names=["q", "s", "id"])
        order = pc.sort_indices(table, [("q", "ascending"), ("s", "descending"), ("id", "ascending")], null_placement="at_start")
        at = order.to_numpy()
        q, s = q[at], s[at]
        begins = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
        nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
        kept = nth < self.k
        full = nth == self.k - 1
        self.least[q[full]] = s[full]
        self.best = [(q[kept], s[kept], ids.take(pa.array(at[kept])))]
        self.merged, self.held = int(kept.sum()), 0

    def rows(self, out: pa.Schema) -> Iterator[pa.RecordBatch]:
        if self.best:
            self.merge()
            q, s, ids = self.best[0]
            columns = [self.ids.take(pa.array(q)), ids, pa.array(s)]
            yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, out, strict=True)], schema=out).to_batches(100_000)


def top_k(queries: DataFrame, store: DataFrame, k: int = 5, exclude_self: bool = False) -> DataFrame:
    """query_id, ext_id, similarity, nth: the k rows of the store most like each query; ties by ext_id.

    queries: query_id, embedding; store: ext_id, embedding. Vectors that are null, hold a null or have no norm are like nothing,
    vectors of two lengths are not like one another. Queries of at most ``BLOCK_NUMBERS`` numbers (counted first) are
    broadcast, and the store is read once; more of them meet the store in pairs of blocks (``_blocks``). Both ways
    keep the k best of a block for each query by matrix products, and only those meet in the final order.
    """
    spark = store.sparkSession
    whole = "embedding IS NOT NULL AND size(embedding) > 0 AND NOT exists(embedding, x -> x IS NULL)"
    queries, store = (t.select(i, "embedding").where(whole) for t, i in ((queries, "query_id"), (store, "ext_id")))
    out = T.StructType([queries.schema["query_id"], store.schema["ext_id"], T.StructField("similarity", T.DoubleType())])
    size = queries.agg(F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("numbers")).first()
    if not size["numbers"]:
        return spark.createDataFrame([], T.StructType([*out, T.StructField("nth", T.IntegerType())]))
    if size["numbers"] <= BLOCK_NUMBERS:
        rows = queries.toArrow().combine_chunks()
        ids, column = rows.column(0).chunk(0), rows.column(1).chunk(0)
        blocks = {d: (ids.take(pa.array(at)), *_matrix(column.take(pa.array(at)))) for d, at in _by_length(column)}
        if size["numbers"] > BLOCK_NUMBERS // 16:  # a file of few splits would leave cores idle
            store = store.repartition(spark.sparkContext.defaultParallelism)
        found = store.mapInArrow(_of_broadcast(spark.sparkContext.broadcast(blocks), k, exclude_self, to_arrow_schema(out)), out)
    else:
        found = _blocks(queries, store, k, exclude_self, out)
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "ext_id"))
    return found.withColumn("nth", nth).where(F.col("nth") <= k)


def _gathered(batches: Iterator[pa.RecordBatch], columns: list[str] = ()) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of several batches that follow one another with the same values of ``columns``: up to a few tiles, whatever the batches' sizes."""
    held: list[pa.RecordBatch] = []
    now: tuple = ()

    def whole() -> tuple[tuple, pa.Table]:
        return now, pa.Table.from_batches(held).combine_chunks()

    for batch in batches:
        if not batch.num_rows:
            continue
        cuts = np.zeros(batch.num_rows, bool)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
        for v in values:
            cuts[1:] |= v[1:] != v[:-1]
        begins = [0, *np.flatnonzero(cuts).tolist(), batch.num_rows]
        for begin, end in zip(begins, begins[1:], strict=False):
            key = tuple(v[begin].item() for v in values)
            if held and (key != now or sum(h.num_rows for h in held) >= 4 * TILE or sum(h.nbytes for h in held) > 8 * BLOCK_NUMBERS):
                yield whole()
                held = []
            now = key
            held.append(batch.slice(begin, end - begin))
    if held:
        yield whole()


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _of_broadcast(queries, k: int, exclude_self: bool, out: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {d: _Best(*block, k, exclude_self) for d, block in queries.value.items()}
        for _, rows in _gathered(batches):
            own, column = _chunk(rows.column(0)), _chunk(rows.column(1))
            for d, at in _by_length(column):
                if d in best:
                    best[d].feed(own.take(pa.array(at)), *_matrix(column.take(pa.array(at))))
        for b in best.values():
            yield from b.rows(out)

    return work


def _blocks(queries: DataFrame, store: DataFrame, k: int, exclude_self: bool, out: T.StructType) -> DataFrame:
    """The k best of each pair of blocks that may hold one of a query's k best.

    A bounded number of the store's own vectors are centres; each vector goes to the cell of its nearest. Cells are packed, neighbours
    side by side, into blocks of ``BLOCK_NUMBERS`` numbers at most, those of more rows dealt into several. The cells' counts and radii
    say which cells cannot hold a hit (``meeting``): pairs of blocks without cells that may are left out, and within a pair only
    cells that may are multiplied. Both sides are copied to the pairs that are left and meet there by a shuffle: a task holds a
    block of queries, the store's rows stream past. The driver holds centres, cells and the numbers of pairs only.
    Each length of vectors has its own cells; lengths are taken to be few.
    """
    spark = store.sparkSession
    kinds = store.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    most = {r["d"]: max(1, min(CELLS, r["n"] // CELL_ROWS, BLOCK_NUMBERS // r["d"])) for r in kinds}
    centres = {}
    for d, cells in most.items():
        rows = store.where(F.size("embedding") == d).select("embedding").orderBy(F.xxhash64("embedding")).limit(cells).toArrow().combine_chunks()
        unit, has = _matrix(rows.column(0).chunk(0))
        centres[d] = unit[has]
    centres = {d: unit for d, unit in centres.items() if len(unit)}
    shared = spark.sparkContext.broadcast(centres)
    sides = []
    for side, name, id_name in ((queries, "queries", "query_id"), (store, "store", "ext_id")):
        kind = T.StructType([side.schema[id_name], side.schema["embedding"], *(T.StructField(n, t) for n, t in (("d", T.IntegerType()), ("cell", T.IntegerType()), ("deal", T.LongType()), ("angle", T.DoubleType())))])
        sides.append(step(side.mapInArrow(_in_cells(shared), kind), name))
    stats = [{(r["d"], r["cell"]): (r["n"], r["radius"]) for r in s.groupBy("d", "cell").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("radius")).collect()} for s in sides]
    doubles = any(s.schema["embedding"].dataType.elementType != T.FloatType() for s in (queries, store))
    more = 0
    if exclude_self:  # so many of the best may be a query itself
        more = sides[1].groupBy("ext_id").count().agg(F.max("count")).first()[0] or 0
    cores = spark.sparkContext.defaultParallelism
    met: dict[tuple[int, int], list[int]] = {}  # length and cell of the store: cells of queries
    pairs: dict[tuple, int] = {}  # blocks of both sides: products to make
    blocks_of: tuple[dict, dict] = ({}, {})  # length and cell: its blocks
    for d, unit in centres.items():
        own = [{c: v for (e, c), v in s.items() if e == d} for s in stats]
        if own[0] and own[1]:
            for side, s in enumerate(own):
                rows_of = max(1, min(BLOCK_NUMBERS // d, -(-sum(n for n, _ in s.values()) // (math.isqrt(PAIRS_A_CORE * cores) + 1))))
                blocks_of[side].update({(d, c): blocks for c, blocks in packed(unit, {c: n for c, (n, _) in s.items()}, rows_of).items()})
            for a, b in meeting(unit, own[0], own[1], k + more):
                met.setdefault((d, b), []).append(a)
                both = blocks_of[0][d, a], blocks_of[1][d, b]
                for x, y in itertools.product(*both):
                    pairs[d, x, y] = pairs.get((d, x, y), 0) + own[0][a][0] * own[1][b][0] // (len(both[0]) * len(both[1]))
    # the pairs of most products come first, dealt to the tasks in turn
    numbers = {pair: i for i, pair in enumerate(sorted(pairs, key=lambda p: (-pairs[p], p)))}
    if not numbers:
        return spark.createDataFrame([], out)
    tasks = min(len(numbers), 4 * PAIRS_A_CORE * cores)
    of_block: tuple[dict, dict] = ({}, {})
    for (d, x, y), i in numbers.items():
        of_block[0].setdefault((d, x), []).append(i)
        of_block[1].setdefault((d, y), []).append(i)
    placed = []
    for side, rows in enumerate(sides):
        table = [(d, c, [of_block[side].get((d, x), []) for x in blocks]) for (d, c), blocks in blocks_of[side].items()]
        cells = spark.createDataFrame(table, "d int, cell int, pairs array<array<int>>")
        both = rows.join(F.broadcast(cells), ["d", "cell"])  # at most CELLS rows a length
        spread = both.withColumn("pair", F.explode(F.get("pairs", F.pmod("deal", F.size("pairs")).cast("int"))))
        ids = [F.col(n) if i == side else F.lit(None).cast(side_of.schema[n].dataType).alias(n) for i, (n, side_of) in enumerate(zip(("query_id", "ext_id"), sides, strict=True))]
        placed.append(spread.select("pair", F.lit(side).alias("side"), "cell", "d", *ids, F.col("embedding").cast("array<double>" if doubles else "array<float>").alias("embedding")))
    dealt = placed[0].unionByName(placed[1]).repartitionById(tasks, F.col("pair") % tasks).sortWithinPartitions("pair", "side", "cell")
    return dealt.mapInArrow(_of_pairs(spark.sparkContext.broadcast(met), k, exclude_self, to_arrow_schema(out)), out)


def packed(unit: np.ndarray, cells: dict[int, int], rows: int) -> dict[int, list[int]]:
    """Cell to its blocks: cells are taken each after its nearest of those before, and share a block of so many rows at most."""
    rest, order, at = set(cells), [], min(cells)
    while rest:
        rest.discard(at)
        order.append(at)
        left = sorted(rest)
        at = left[int((unit[left] @ unit[at]).argmax())] if left else at
    out, block, held = {}, -1, rows
    for c in order:
        n = cells[c]
        if n > rows:
            parts = -(-n // rows)
            out[c] = list(range(block + 1, block + 1 + parts))
            block, held = block + parts, rows
            continue
        if held + n > rows:
            block, held = block + 1, 0
        out[c] = [block]
        held += n
    return out


def _of_pairs(met, k: int, exclude_self: bool, out: pa.Schema):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, best = None, {}, {}
        for (pair, side, cell, d), rows in _gathered(batches, ["pair", "side", "cell", "d"]):
            if pair != now:
                for b in best.values():
                    yield from b.rows(out)
                now, asked, best = pair, {}, {}
            if side == 0:
                asked.setdefault(cell, []).append(rows)
                continue
            for c in list(asked):  # a pair's queries come before its rows of the store
                table = pa.concat_tables(asked.pop(c))
                best[c] = _Best(_chunk(table.column("query_id")), *_matrix(_chunk(table.column("embedding"))), k, exclude_self)
            fed = _chunk(rows.column("ext_id")), *_matrix(_chunk(rows.column("embedding")))
            for c in met.value.get((d, cell), ()):
                if c in best:
                    best[c].feed(*fed)
        for b in best.values():
            yield from b.rows(out)

    return work


def _in_cells(centres):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = 0
        for batch in batches:
            for d, at in _by_length(batch.column(1)):
                if d not in centres.value:
                    continue
                rows = batch.take(pa.array(at))
                x, has = _matrix(rows.column(1))
                like = x @ centres.value[d].T
                cell = like.argmax(axis=1)
                angle = np.arccos(np.clip(like[np.arange(len(x)), cell], -1, 1))
                deals = np.arange(deal, deal + len(x))  # rows of a cell are dealt in turn, copies too
                deal += len(x)
                columns = [*rows.columns, pa.array(np.full(len(x), d), pa.int32()), pa.array(cell, pa.int32()), pa.array((deals * 2654435761 % (1 << 32)) >> 8, pa.int64()), pa.array(angle)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "d", "cell", "deal", "angle"]).filter(pa.array(has))

    return work


def meeting(unit: np.ndarray, queries: dict[int, tuple[int, float]], store: dict[int, tuple[int, float]], k: int) -> list[tuple[int, int]]:
    """Pairs (cell of queries, cell of the store) that may hold a hit; cells: number to (rows, radius as an angle).

    Every row of a cell lies within its radius of its centre, so angles to another cell lie between the centres' angle less and plus
    both radii. The nearest cells by the upper bound that hold k rows give an angle within which each query has k rows; a cell
    whose lower bound lies beyond it holds none of the k best.
    """
    there = sorted(store)
    n, radius = (np.array([store[b][i] for b in there]) for i in (0, 1))
    out = []
    for a, (_, own) in queries.items():
        between = np.arccos(np.clip(unit[there] @ unit[a], -1, 1))
        far, near = between + radius + own, between - radius - own
        order = np.argsort(far)
        enough = np.searchsorted(np.cumsum(n[order]), k)
        limit = far[order[enough]] if enough < len(order) else np.inf
        out += [(a, b) for b, lower in zip(there, near, strict=True) if lower <= limit + SLACK]
    return out
