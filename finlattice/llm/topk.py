"""Exact top-k by inner product: score histograms, refined until each query's kth value is found."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .work import Scratch, frugal

#: Rows of a block of queries and of a block of candidates; bins of a histogram.
QUERY_BLOCK, ROW_BLOCK, BINS = 2048, 4096, 256
#: Of a cell of the grid: blocks of queries, whose histograms a task holds at once, and blocks of candidates at most.
CELL_QUERIES, CELL_ROWS = 16, 256
#: Scores from here on, of either sign, go by places and texts.
WIDE = 1 << 61


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """id and whole components floor(scale * x), as doubles, of the rows that take part; from 2 ** 52 on every double is whole."""
    v = F.transform(F.col("embedding"), lambda x: x.cast("double") * scale)
    fine = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding")).where(fine)
    return rows.select("vec_id", F.transform(v, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)).alias("v"))


def blocks(rows: DataFrame, size: int, number: str) -> DataFrame:
    """Rows of one length of vector, `size` to a block: number, dims, ids, matrix of whole doubles."""

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            v = b.column(1)
            n = np.diff(v.offsets.to_numpy())
            flat, ids, at = v.flatten().to_numpy(), b.column(0).to_numpy(), np.append(0, np.cumsum(n))
            for d in np.unique(n).tolist():
                own = np.flatnonzero(n == d)
                m = flat[at[own][:, None] + np.arange(d)] if d else np.zeros((len(own), 0))
                old_ids, old = held.get(d, (np.zeros(0, np.int64), np.zeros((0, d))))
                i, m = np.append(old_ids, ids[own]), np.concatenate([old, m])
                while len(i) >= size:
                    yield _block(d, i[:size], m[:size], number)
                    i, m = i[size:], m[size:]
                held[d] = i, m
        for d, (i, m) in held.items():
            if len(i):
                yield _block(d, i, m, number)

    return rows.mapInArrow(frugal(run), f"dims int, {number}_ids binary, {number}_rows binary, {number}_block long")


def _block(d, ids, m, number):
    return pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([m.astype(np.float64).tobytes()], pa.binary()), pa.array([int(ids[0])])], ["dims", f"{number}_ids", f"{number}_rows", f"{number}_block"])


class Scores(np.ndarray):
    """Places of scores: a score below WIDE is its own; beyond, `exact` has the scores, whose places are in the same order."""

    exact: np.ndarray | None = None


def place_of(score: int) -> int:
    """A 64-bit number that never falls as the score grows: itself, or from WIDE on its size and leading bits."""
    size = abs(score)
    if size < WIDE:
        return score
    bits = size.bit_length()
    lead = size >> (bits - 49) if bits > 49 else size << (49 - bits)
    out = WIDE + (bits << 48 | lead & (1 << 48) - 1)
    return out if score > 0 else -out


def written(score: int) -> str:
    """Text that sorts as the scores beyond WIDE do; small ones have none."""
    if abs(score) < WIDE:
        return ""
    digits = str(abs(score))
    return f"1{len(digits):05d}{digits}" if score > 0 else "0" + f"{len(digits):05d}{digits}".translate(str.maketrans("0123456789", "9876543210"))


def _scores(q: np.ndarray, c: np.ndarray) -> Scores:
    """Whole inner products; floats carry them exactly while they stay below 2 ** 53, Python's numbers at any size."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1])
    if top < 2**24:
        return (q.astype(np.float32) @ c.astype(np.float32).T).astype(np.int64).view(Scores)
    if top < 2**53:
        return (q @ c.T).astype(np.int64).view(Scores)
    if top < WIDE:
        return (q.astype(np.int64) @ c.astype(np.int64).T).view(Scores)
    whole = lambda m: np.asarray([[int(x) for x in r] for r in m.tolist()], object).reshape(m.shape)
    exact = whole(q) @ whole(c).T if q.shape[1] else np.zeros((len(q), len(c)), object)
    out = np.asarray([[place_of(int(x)) for x in r] for r in exact], np.int64).reshape(exact.shape).view(Scores)
    out.exact = exact
    return out


def _pairs(batches):
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n)[i].as_py() for n in b.schema.names}
            d = row["dims"]
            qi, ci = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["c_ids"], np.int64)
            s = _scores(np.frombuffer(row["q_rows"], np.float64).reshape(len(qi), d), np.frombuffer(row["c_rows"], np.float64).reshape(len(ci), d))
            yield row, qi, ci, s


class Gathered:
    """What a task has found for each block of queries, handed on when it has met enough blocks, or all rows."""

    def __init__(self, add, out):
        self.add, self.out, self.held = add, out, {}

    def __call__(self, batches):
        for row, qi, ci, s in _pairs(batches):
            block = row["q_block"]
            if block not in self.held and len(self.held) >= CELL_QUERIES:
                yield from self.flush()
            self.held[block] = qi, self.add(self.held[block][1] if block in self.held else None, row, qi, ci, s)
        yield from self.flush()

    def flush(self):
        for block, (qi, found) in self.held.items():
            got = self.out(block, qi, found)
            if got.num_rows:
                yield got
        self.held = {}


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row whose id is divisible by `every`.

    Components count as floor(scale * x). Blocks of queries meet blocks of all rows in the cells of a grid: a cell
    has CELL_QUERIES blocks of queries and a group of blocks of rows, each block of queries lies in the cells of all
    groups, each block of rows in those of all queries. Every score is computed in each round and only counts
    leave a task: a histogram of BINS bins over the interval that holds a query's kth score, one for a query and a cell,
    from its highest bin down to the one that holds the cell's own kth row, until an interval is one score wide. Then rows at or above the kth score are ranked, of equal scores the
    smaller ids first; each cell hands on k rows of a query at most, so one vector in a third of all rows stays
    small. Scores are whole numbers of any size and ranked as such: those from WIDE on are found by a place that keeps their
    order, then told apart exactly; `score` stops at the ends of a long. Vectors that are null or hold null, NaN or infinite components (or such that scaling makes infinite) take no part, nor do null ids; vectors of
    other lengths meet only their like. Repeated ids are candidates of their own and one query (the smallest vector),
    which never meets its own id. Fewer than k others: all of them. Empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    rows = scratch.keep(quantised(vectors, scale))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    q = scratch.keep(blocks(queries, QUERY_BLOCK, "q"))
    c = scratch.keep(blocks(rows, ROW_BLOCK, "c"))
    n_q, n_c = q.count(), c.count()
    bands = max(1, -(-n_q // CELL_QUERIES))
    groups = max(1, min(n_c, max(-(-n_c // CELL_ROWS), -(-4 * spark.sparkContext.defaultParallelism // bands))))
    cells = bands * groups
    # round robin deals the blocks of rows evenly to their groups
    c = scratch.keep(c.drop("c_block").repartition(groups).withColumn("group", F.spark_partition_id()))
    c = c.withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))))
    goals = q.withColumn("band", F.pmod(F.xxhash64("q_block"), F.lit(bands)).cast("int"))
    goals = goals.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def met(extra: DataFrame | None) -> DataFrame:
        left = goals if extra is None else goals.join(extra, "q_block")
        cell = ["band", "group", "dims"]
        return c.repartition(cells, *cell).join(left.repartition(cells, *cell), cell)

    def add_range(found, row, qi, ci, s):
        own = qi[:, None] == ci[None, :]
        n = (~own).sum(1)
        lo, hi = np.where(own, np.iinfo(np.int64).max, s).min(1), np.where(own, np.iinfo(np.int64).min, s).max(1)
        return (lo, hi, n) if found is None else (np.minimum(found[0], lo), np.maximum(found[1], hi), found[2] + n)

    def ranges(block, qi, found):
        some = found[2] > 0
        return pa.RecordBatch.from_arrays([pa.array(np.full(int(some.sum()), block, np.int64)), pa.array(qi[some]), *(pa.array(x[some].astype(np.int64)) for x in found)], ["q_block", "query_id", "lo", "hi", "n"])

    first = met(None).mapInArrow(frugal(lambda b: Gathered(add_range, ranges)(b)), "q_block long, query_id long, lo long, hi long, n long")
    state = first.groupBy("q_block", "query_id").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    # the kth best score lies in [lo, hi]; `above` rows lie over hi
    state = scratch.keep(state.select("q_block", "query_id", "lo", "hi", F.lit(0).cast("long").alias("above"), F.least(F.lit(k).cast("long"), "n").alias("want")))

    def packed(state: DataFrame) -> DataFrame:
        """One row of arrays per block of queries (QUERY_BLOCK queries at most)."""
        return state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("query_id", "lo", "hi"))).alias("s")).select("q_block", F.col("s.query_id").alias("s_ids"), F.col("s.lo").alias("s_lo"), F.col("s.hi").alias("s_hi"))

    def limits(row, qi):
        ids, lo, hi = (np.asarray(row[x], np.int64) for x in ("s_ids", "s_lo", "s_hi"))
        at = np.minimum(np.searchsorted(ids, qi), len(ids) - 1)
        known = ids[at] == qi
        return np.where(known, lo[at], 1), np.where(known, hi[at], 0)

    def add_histogram(found, row, qi, ci, s):
        lo, hi = limits(row, qi)
        width = (hi - lo) // BINS + 1
        inside = (s >= lo[:, None]) & (s <= hi[:, None]) & (qi[:, None] != ci[None, :]) & (hi > lo)[:, None]
        at, col = np.nonzero(inside)
        n = np.bincount(at * BINS + (s[at, col] - lo[at]) // width[at], minlength=len(qi) * BINS)
        return n if found is None else found + n

    def histogram(block, qi, found):
        # in each bin below, k rows of this cell alone lie above: it can't hold the kth
        n = found.reshape(-1, BINS)
        above = np.cumsum(n[:, ::-1], 1)[:, ::-1] - n
        key = np.flatnonzero((n > 0) & (above < k))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block, np.int64)), pa.array(qi[key // BINS]), pa.array((key % BINS).astype(np.int32)), pa.array(found[key].astype(np.int64))], ["q_block", "query_id", "bin", "n"])

    while state.where("hi > lo").limit(1).count():
        counts = met(packed(state)).mapInArrow(frugal(lambda b: Gathered(add_histogram, histogram)(b)), "q_block long, query_id long, bin int, n long").groupBy("q_block", "query_id", "bin").agg(F.sum("n").alias("n"))
        bins = counts.groupBy("q_block", "query_id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
        step = state.join(bins, ["q_block", "query_id"], "left")
        # from the highest bin down, until `want` rows lie at or above
        found = F.expr("""aggregate(coalesce(bins, array()), named_struct('above', above, 'bin', -1),
            (a, b) -> if(a.bin >= 0, a, if(a.above + b.n >= want, named_struct('above', a.above, 'bin', b.bin), named_struct('above', a.above + b.n, 'bin', -1))))""")
        width = F.expr("(hi - lo) div %d + 1" % BINS)
        step = step.withColumn("f", found).withColumn("w", width)
        step = step.select("q_block", "query_id", F.expr("if(f.bin >= 0, lo + f.bin * w, lo)").alias("lo2"), F.expr("if(f.bin >= 0, least(hi, lo + (f.bin + 1) * w - 1), hi)").alias("hi2"), F.expr("if(f.bin >= 0, f.above, above)").alias("above"), "want")
        state = scratch.keep(step.select("q_block", "query_id", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "above", "want"))

    def add_best(found, row, qi, ci, s):
        lo, hi = limits(row, qi)
        at, col = np.nonzero((np.asarray(s) >= lo[:, None]) & (lo <= hi)[:, None] & (qi[:, None] != ci[None, :]))
        place, ids = np.asarray(s)[at, col], ci[col]
        exact = place.astype(object) if s.exact is None else s.exact[at, col]
        if found is not None:
            at, place, ids, exact = np.append(found[0], at), np.append(found[1], place), np.append(found[2], ids), np.append(found[3], exact)
        wide = np.abs(place) >= WIDE
        rank = np.zeros(len(at), np.int64)
        if wide.any():
            rank[wide] = np.unique(np.asarray([written(x) for x in exact[wide]]), return_inverse=True)[1]
        by = np.lexsort((ids, -rank, -place, at))
        at, place, ids, exact = at[by], place[by], ids[by], exact[by]
        keep = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[keep], place[keep], ids[keep], exact[keep]

    def best(block, qi, found):
        at, place, ids, exact = found
        score = [min(max(int(x), -(1 << 63)), (1 << 63) - 1) for x in exact]
        return pa.RecordBatch.from_arrays([pa.array(qi[at]), pa.array(ids), pa.array(place), pa.array([written(int(x)) for x in exact], pa.string()), pa.array(score, pa.int64())], ["query_id", "vec_id", "place", "fine", "score"])

    near = met(packed(state)).mapInArrow(frugal(lambda b: Gathered(add_best, best)(b)), "query_id long, vec_id long, place long, fine string, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("place"), F.desc("fine"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
