"""Approximate nearest neighbours by largest inner product: NN-descent and greedy graph search.

Equal vectors are one node of the graph, named by its smallest vec_id. Each node starts with its best
neighbours in windows of rows that are sorted by random-projection codes. Then NN-descent: in each round a node
introduces to each other its neighbours and the nodes it is a neighbour of (new ones with all, at most SAMPLE of
either kind that hashes choose), by a join that brings the members' vectors to the node; pairs better than what
either has become its neighbours. Rounds end when few pairs are new. A query starts from its own node's
neighbours and expands the best nodes not expanded yet, EXPAND in each of SEARCH_ROUNDS joins with the
graph; the best POOL found stay. All this works on unit vectors in half floats with their norms beside them, so that
vectors of any norms are told apart. All of the pool get their exact inner product, in double precision on the
original vectors, and their nodes' members are ranked. The work grows in proportion to the rows: blocks of
nodes and windows have fixed sizes, and so have a node's neighbours, a round's members and a query's pool. A hub,
which is a neighbour of very many nodes, gives SAMPLE of them to its round (chosen before they are moved), is a key that
adaptive execution splits where its vector is joined to them, and in the search has its block's requests
dealt over parts of REQUEST_BYTES. The parameters bound the work of an approximate search, whose recall is measured
(README, tests); more rows need no more of anything but, for the same recall, a larger EXPAND or POOL.

Vectors that are null, zero or hold null or non-finite components take no part, nor do those of another
dimension than the most frequent one, nor null vec_ids. Of rows with one vec_id the smallest vector counts.
With fewer candidates than k all are found as far as the graph joins them. Ties go to the smaller vec_id;
an empty table gives no rows; other columns, whatever their names, take no part.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few, written

K, SAMPLE, ROUNDS, TREES, WINDOW, STOP = 24, 12, 6, 6, 256, 0.005
EXPAND, SEARCH_ROUNDS, POOL, BLOCK, REQUEST_BYTES = 150, 6, 600, 1024, 64 << 20


def _release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of finished rounds now instead of at its next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) ^ np.uint64(salt * 0x165667B19E3779F9 & (1 << 64) - 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _packed(x: np.ndarray, norm: np.ndarray) -> list[bytes]:
    """Rows of a norm (double) and the unit vector (half floats)."""
    return [n.tobytes() + v.tobytes() for n, v in zip(norm, (x / norm[:, None]).astype(np.float16), strict=True)]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as float32, and norms, of packed rows."""
    if not len(column):
        return np.zeros((0, 0), np.float32), np.zeros(0)
    data = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8).reshape(len(column), -1)
    return data[:, 8:].copy().view(np.float16).astype(np.float32), data[:, :8].copy().view(np.float64).ravel()


def _sim(cosine: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product's 16th root with its sign: in the same order, and within a float's range whatever the norms."""
    s = cosine * a * b
    root = np.abs(s)
    for _ in range(4):
        np.sqrt(root, out=root)
    return np.copysign(root, s).astype(np.float32)


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _flat(column) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column; null lists are empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = pa.compute.fill_null(pa.compute.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return n.astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by key."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if carry is not None and carry.num_rows:
            table = pa.concat_tables([carry, table])
        if not table.num_rows:
            continue
        keys = table.column(key).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1]))
        if cut:
            yield table.slice(0, cut).combine_chunks()
        carry = table.slice(cut)
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks()


def _best(u: np.ndarray, v: np.ndarray, s: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Each u's k best distinct v, best first; what is known already (fresh 0) stays known."""
    o = np.lexsort((fresh, v, u))
    u, v, s, fresh = u[o], v[o], s[o], fresh[o]
    once = np.concatenate(([True], (u[1:] != u[:-1]) | (v[1:] != v[:-1]))) if len(u) else np.zeros(0, bool)
    u, v, s, fresh = u[once], v[once], s[once], fresh[once]
    o = np.lexsort((v, -s, u))
    u, v, s, fresh = u[o], v[o], s[o], fresh[o]
    near = np.arange(len(u)) - np.searchsorted(u, u) < k
    return u[near], v[near], s[near], fresh[near]


def _update_rows(u: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    """Rows (id, nb, sim) out of flat ones that are sorted by u."""
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.zeros(0, np.int64)
    offsets = np.append(first, len(u))
    return pa.RecordBatch.from_arrays([pa.array(u[first]), _lists(offsets, pa.array(v)), _lists(offsets, pa.array(s.astype(np.float32)))], ["id", "nb", "sim"])


UPDATES = "id long, nb array<long>, sim array<float>"
GRAPH = "id long, v binary, nb array<long>, sim array<float>, fresh array<int>"


def _start(nodes: DataFrame, dim: int, tree: int, parts: int) -> DataFrame:
    """Updates from windows over the nodes in the order of one random-projection code."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(1000 + tree).standard_normal((dim, 24)).astype(np.float32)
        for batch in batches:
            x, _ = _vectors(batch.column(1))
            sign = (x @ planes > 0) if len(x) else np.zeros((0, 24), bool)
            yield pa.RecordBatch.from_arrays([pa.array(sign @ (1 << np.arange(23, -1, -1)).astype(np.int64)), batch.column(0), batch.column(1)], ["code", "id", "v"])

    def window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for batch in [*batches, None]:
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if carry is not None:
                table = pa.concat_tables([carry, table]) if table is not None else carry
            if table is None:
                continue
            whole = table.num_rows if batch is None else table.num_rows // WINDOW * WINDOW
            carry = table.slice(whole)
            out = []
            for at in range(0, whole, WINDOW):
                part = table.slice(at, min(WINDOW, whole - at)).combine_chunks()
                ids, (x, norm) = part.column("id").to_numpy(), _vectors(part.column("v"))
                m = _sim(x @ x.T, norm[:, None], norm[None])
                np.fill_diagonal(m, -np.inf)
                k = min(K, len(ids) - 1)
                if k > 0:
                    top = np.argpartition(-m, k - 1, axis=1)[:, :k]
                    out.append((np.repeat(ids, k), ids[top].ravel(), np.take_along_axis(m, top, 1).ravel()))
            if out:
                u, v, s = (np.concatenate(c) for c in zip(*out, strict=True))
                o = np.argsort(u, kind="stable")
                yield _update_rows(u[o], v[o], s[o])

    coded = nodes.mapInArrow(code, "code long, id long, v binary")
    return coded.repartitionByRange(parts, "code", "id").sortWithinPartitions("code", "id").mapInArrow(window, UPDATES)


def _sampled(id_: np.ndarray, nb: np.ndarray, fresh: np.ndarray, turn: int) -> np.ndarray:
    """Which fresh neighbours take part in a round: the SAMPLE with the smallest hashes of each node."""
    where = np.flatnonzero(fresh > 0)
    o = np.lexsort((_mix(id_[where], nb[where], turn), id_[where]))
    u = id_[where][o]
    mine = np.arange(len(u)) - np.searchsorted(u, u) < SAMPLE
    out = np.zeros(len(id_), bool)
    out[where[o[mine]]] = True
    return out


def _merged(graph: DataFrame, updates: DataFrame, turn: int, parts: int) -> DataFrame:
    """The graph with the updates of a round; neighbours that took part in it are no longer fresh."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "id"):
            ids, own = t.column("id").to_numpy(), t.column("own").to_numpy() == 1
            n, nb = _flat(t.column("nb"))
            _, sim = _flat(t.column("sim"))
            own_n, age = _flat(t.column("fresh"))
            u, from_own = np.repeat(ids, n), np.repeat(own, n)
            fresh = np.ones(len(u), np.int64)
            fresh[from_own] = age
            known = np.flatnonzero(from_own)
            fresh[known[_sampled(u[known], nb[known], fresh[known], turn)]] = 0
            keep = u != nb
            u, v, s, fresh = _best(u[keep], nb[keep], sim[keep], fresh[keep], K)
            nodes = ids[own]
            vectors = t.column("v").filter(pa.array(own))
            offsets = np.concatenate((np.searchsorted(u, nodes), [len(u)]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) and vectors.num_chunks == 1 else pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors, _lists(offsets, pa.array(v)), _lists(offsets, pa.array(s.astype(np.float32))), _lists(offsets, pa.array(fresh.astype(np.int32)))], ["id", "v", "nb", "sim", "fresh"])

    rows = graph.withColumn("own", F.lit(1)).unionByName(updates.withColumn("own", F.lit(0)), allowMissingColumns=True)
    return rows.repartition(parts, "id").sortWithinPartitions("id", "own").mapInArrow(run, GRAPH)


def _introduced(graph: DataFrame, turn: int, parts: int) -> DataFrame:
    """Updates from one round: each node's neighbours and reverse neighbours are compared with each other."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, nb = _flat(b.column(1))
            _, fresh = _flat(b.column(2))
            u = np.repeat(b.column(0).to_numpy(), n)
            new = _sampled(u, nb, fresh, turn)
            use = new | (fresh == 0)
            yield pa.RecordBatch.from_arrays([pa.array(u[use]), pa.array(nb[use]), pa.array(new[use].astype(np.int32)), pa.array(_mix(nb[use], u[use], turn + 99).view(np.int64))], ["u", "w", "new", "h"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "center"):
            center, ids, new, least = (t.column(c).to_numpy() for c in ("center", "id", "new", "least"))
            x, norm = _vectors(t.column("v").combine_chunks() if not isinstance(t.column("v"), pa.ChunkedArray) else pa.concat_arrays(t.column("v").chunks))
            first = np.flatnonzero(np.concatenate(([True], center[1:] != center[:-1])))
            out = []
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(center)], strict=True):
                fresh = a + int(np.searchsorted(-new[a:b], 0))  # new ones come first
                if fresh == a or b - a < 2:
                    continue
                m = _sim(x[a:fresh] @ x[a:b].T, norm[a:fresh, None], norm[None, a:b])
                p, q = np.nonzero((m > least[a:fresh, None]) | (m > least[None, a:b]))
                s, p, q = m[p, q], p + a, q + a
                out += [(ids[p], ids[q], s, least[p]), (ids[q], ids[p], s, least[q])]
            if out:
                u, v, s, floor = (np.concatenate(c) for c in zip(*out, strict=True))
                good = (s > floor) & (u != v)
                u, v, s, _ = _best(u[good], v[good], s[good], np.ones(int(good.sum()), np.int8), K)
                yield _update_rows(u, v, s)

    found = graph.select("id", "nb", "fresh").mapInArrow(edges, "u long, w long, new int, h long")
    found = written(found, "ann-edges")
    order = Window.partitionBy("w", "new").orderBy("h", "u")
    back = found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= SAMPLE).select(F.col("w").alias("center"), F.col("u").alias("id"), "new")
    members = found.select(F.col("u").alias("center"), F.col("w").alias("id"), "new").unionByName(back).groupBy("center", "id").agg(F.max("new").alias("new"))
    least = F.when(F.size("sim") >= K, F.array_min("sim")).otherwise(F.lit(float("-inf")).cast("float"))
    members = members.join(graph.select("id", "v", least.alias("least")), "id")
    return members.repartition(parts, "center").sortWithinPartitions("center", F.desc("new")).select("center", "id", "new", "v", "least").mapInArrow(join, UPDATES)


def build_graph(nodes: DataFrame, dim: int, count: int, parts: int, rounds: int = ROUNDS) -> DataFrame:
    """id, v, nb, sim, fresh: each node's K best neighbours found."""
    updates = None
    for tree in range(TREES):
        one = _start(nodes, dim, tree, max(1, min(parts, count // (8 * WINDOW))))
        updates = one if updates is None else updates.unionByName(one)
    none = {"nb": F.array().cast("array<long>"), "sim": F.array().cast("array<float>"), "fresh": F.array().cast("array<int>")}
    graph = written(_merged(nodes.withColumns(none), updates, 0, parts), "ann-graph")
    for turn in range(1, rounds + 1):
        graph = written(_merged(graph, _introduced(graph, turn, parts), turn, parts), "ann-graph", instead_of=graph)
        _release(nodes.sparkSession)
        new = graph.agg(F.sum(F.aggregate("fresh", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).first()["n"] or 0
        if new < STOP * K * count:
            break
    return graph


def _dealt(near: DataFrame, todo: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Both with part: blocks that more than `most` requests ask for are copied for parts of them."""
    many = todo.groupBy("block").count().filter(F.col("count") > most).select("block", F.ceil(F.col("count") / most).cast("int").alias("parts"))
    many = few(written(many, "ann-asked-often"))
    todo = todo.join(many, "block", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("q"), F.col("parts")).cast("int"), F.lit(0))).drop("parts")
    near = near.join(many, "block", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts") - 1, F.lit(0))))).drop("parts")
    return near, todo


def _search(graph: DataFrame, asked: DataFrame, count: int, dim: int) -> DataFrame:
    """asked: q (a node). Gives q, ids, sims: its pool."""
    back = graph.select(F.col("id").alias("w"), F.posexplode("nb").alias("pos", "u")).select(F.col("u").alias("id"), F.col("w").alias("u"), "pos")
    nearest = Window.partitionBy("id").orderBy("pos", "u")
    back = back.withColumn("nth", F.row_number().over(nearest)).filter(F.col("nth") <= SAMPLE).select("id", "u")
    ahead = graph.select("id", F.explode("nb").alias("u"))
    pairs = ahead.unionByName(back).distinct().join(graph.select(F.col("id").alias("u"), "v"), "u")
    near = pairs.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("u", "v"))).alias("p"))  # K + SAMPLE at most
    blocks = max(1, -(-count // BLOCK))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")
    near = written(near.select(block, "id", F.col("p.u").alias("nb"), F.col("p.v").alias("vs")), "ann-adjacent")
    state = graph.join(asked.select(F.col("q").alias("id")), "id", "left_semi").select(F.col("id").alias("q"), "v", F.concat(F.array("id"), "nb").alias("ids"), F.concat(F.array(F.lit(float("inf")).cast("float")), "sim").alias("sims"))
    state = written(state.withColumn("done", F.transform("ids", lambda x: F.when(x == F.col("q"), 1).otherwise(0))), "ann-pools")

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ids = _flat(b.column(2))
            _, sims = _flat(b.column(3))
            _, done = _flat(b.column(4))
            row = np.repeat(np.arange(len(n)), n)
            open_ = np.flatnonzero(done == 0)
            ends = np.cumsum(n) - 1
            floor = np.where(n >= POOL, sims[ends], -np.inf).astype(np.float32)
            o = open_[np.arange(len(open_)) - np.searchsorted(row[open_], row[open_]) < EXPAND]
            yield pa.RecordBatch.from_arrays([pa.array(ids[o]), b.column(0).take(pa.array(row[o])), pa.array(floor[row[o]]), b.column(1).take(pa.array(row[o]))], ["id", "q", "floor", "v"])

    def expand(graph_part: pa.Table, asked_part: pa.Table) -> pa.Table:
        if not asked_part.num_rows or not graph_part.num_rows:
            return pa.Table.from_batches([_update_rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))])
        ids = graph_part.column("id").to_numpy()
        o = np.argsort(ids)
        n, nb = _flat(graph_part.column("nb"))
        starts = np.cumsum(n) - n
        vs = graph_part.column("vs").combine_chunks()
        x, norm = _vectors((pa.concat_arrays(vs.chunks) if isinstance(vs, pa.ChunkedArray) else vs).flatten())
        want, q, floor = (asked_part.column(c).to_numpy() for c in ("id", "q", "floor"))
        v = asked_part.column("v").combine_chunks()
        qv, qnorm = _vectors(pa.concat_arrays(v.chunks) if isinstance(v, pa.ChunkedArray) else v)
        place = o[np.minimum(np.searchsorted(ids[o], want), len(o) - 1)]
        found = ids[place] == want
        out = []
        for a in range(0, len(want), 1024):
            rows = np.arange(a, min(a + 1024, len(want)))
            rows = rows[found[rows]]
            m = n[place[rows]]
            at = np.repeat(starts[place[rows]] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            r = np.repeat(rows, m)
            s = _sim(np.einsum("ij,ij->i", x[at], qv[r]), norm[at], qnorm[r])
            good = (s > floor[r]) & (nb[at] != q[r])
            out.append((q[r][good], nb[at][good], s[good]))
        u, w, s = (np.concatenate(c) for c in zip(*out, strict=True))
        u, w, s, _ = _best(u, w, s, np.zeros(len(u), np.int8), POOL)
        return pa.Table.from_batches([_update_rows(u, w, s)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "q"):
            q, own = t.column("q").to_numpy(), t.column("own").to_numpy() == 1
            n, ids = _flat(t.column("ids"))
            _, sims = _flat(t.column("sims"))
            _, done = _flat(t.column("done"))
            row, u = np.repeat(np.arange(len(n)), n), np.repeat(q, n)
            mine = np.flatnonzero(np.repeat(own, n))
            flag = np.zeros(len(u), np.int64)
            open_ = np.flatnonzero(done == 0)
            done = done.copy()
            done[open_[np.arange(len(open_)) - np.searchsorted(row[mine][open_], row[mine][open_]) < EXPAND]] = 1
            flag[mine] = done
            u, w, s, flag = _best(u, ids, sims, 1 - flag, POOL)  # what is expanded stays expanded
            nodes = q[own]
            vectors = t.column("v").filter(pa.array(own))
            vectors = pa.concat_arrays(vectors.chunks) if isinstance(vectors, pa.ChunkedArray) else vectors
            offsets = np.concatenate((np.searchsorted(u, nodes), [len(u)]))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), vectors, _lists(offsets, pa.array(w)), _lists(offsets, pa.array(s.astype(np.float32))), _lists(offsets, pa.array((1 - flag).astype(np.int32)))], ["q", "v", "ids", "sims", "done"])

    schema = "q long, v binary, ids array<long>, sims array<float>, done array<int>"
    most = max(1, REQUEST_BYTES // (2 * dim + 64))
    all_at_once = state.count() * EXPAND <= most
    for _ in range(SEARCH_ROUNDS):
        todo = state.mapInArrow(requests, "id long, q long, floor float, v binary")
        blocks_of, todo = near.withColumn("part", F.lit(0)), todo.select(block, "id", "q", "floor", "v").withColumn("part", F.lit(0))
        if not all_at_once:
            blocks_of, todo = _dealt(near, todo.drop("part"), most)
        found = blocks_of.groupBy("block", "part").cogroup(todo.groupBy("block", "part")).applyInArrow(expand, UPDATES)
        rows = state.withColumn("own", F.lit(1)).unionByName(found.select(F.col("id").alias("q"), F.col("nb").alias("ids"), F.col("sim").alias("sims"), F.lit(0).alias("own")), allowMissingColumns=True)
        parts = max(1, int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        state = written(rows.repartition(parts, "q").sortWithinPartitions("q", "own").mapInArrow(gather, schema), "ann-pools", instead_of=state)
        _release(graph.sparkSession)
    return state.select("q", "ids", "sims")


def nearest(vectors: DataFrame, is_query=None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a column) holds."""
    spark = vectors.sparkSession
    is_query = F.col("vec_id") % 20 == 0 if is_query is None else is_query
    e = F.col("embedding")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<float>").alias("embedding"))
    rows = rows.filter(F.col("vec_id").isNotNull() & e.isNotNull() & (F.size(e) > 0) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = written(rows.select("vec_id", "embedding", F.size("embedding").alias("dim"), F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(1), "embedding").alias("h2")), "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if dims is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims["dim"]
    rows = rows.filter(F.col("dim") == dim)
    classes = written(rows.groupBy("h1", "h2").agg(F.min_by("embedding", "vec_id").alias("embedding"), F.min("vec_id").alias("id")), "vector-classes")
    count = classes.count()
    largest = classes.agg(F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()[0]

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _flat(b.column(1))[1].astype(np.float64).reshape(-1, dim) / largest
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_packed(x, np.linalg.norm(x, axis=1)), pa.binary())], ["id", "v"])

    nodes = written(classes.select("id", "embedding").mapInArrow(half, "id long, v binary"), "ann-nodes")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 32768))
    graph = build_graph(nodes, dim, count, parts)

    queries = written(rows.filter(is_query).select("vec_id", "h1", "h2").join(classes.select("h1", "h2", "id"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), F.col("id").alias("q")), "ann-queries")
    pools = _search(graph, queries.select("q").distinct(), count, dim)
    firsts = Window.partitionBy("h1", "h2").orderBy("vec_id")
    members = rows.select("h1", "h2", "vec_id").withColumn("nth", F.row_number().over(firsts)).filter(F.col("nth") <= k + 1)
    members = members.join(classes.select("h1", "h2", "id"), ["h1", "h2"]).groupBy("id").agg(F.collect_list("vec_id").alias("members"))  # k + 1 at most
    pairs = pools.select("q", F.explode("ids").alias("id"))
    exact = pairs.join(classes.select("id", F.col("embedding").alias("b")), "id").join(classes.select(F.col("id").alias("q"), F.col("embedding").alias("a")), "q")
    score = F.aggregate(F.zip_with("a", "b", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("q", "id", score.alias("score")).join(members, "id").select("q", "score", F.explode("members").alias("vec_id"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    exact = exact.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
    exact = exact.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("best"))  # k + 1 at most
    best = queries.join(exact, "q")
    best = best.select("query_id", F.posexplode(F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return best.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def brute_force_sql(k: int = 20) -> str:
    return f"""
SELECT q.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id
WHERE q.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, b.vec_id) <= {k}"""
