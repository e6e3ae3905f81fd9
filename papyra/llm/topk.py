"""Exact top-k inner-product search by pivot-table elimination.

Vectors are lifted by one coordinate to equal length, so that the largest inner product is the least distance. Each row
keeps its distances to `pivots` reference points. For a query, the largest |d(query, pivot) - d(row, pivot)| bounds the
row's distance from below; rows are evaluated in the order of this bound and the search of a batch stops at the first bound
beyond the k-th best distance so far. Bounds carry a slack for rounding and scores are exact integers, so results are
exact, ties included. The few rows with components beyond LARGEST, whose products doubles can't hold, are kept beside the
table as decimal text and scored in whole numbers of any size, each against all.

Queries go to the tasks in blocks of about `query_block` rows, each a broadcast of bounded size, some blocks at a time;
every task scans its own rows and returns k rows a query. All rows are indexed; the pivots alone come from a sample, of
`pivot_sample` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.llm.common import Scratch

#: Components beyond this are wide: held as text, scored in whole numbers of any size.
LARGEST = 2**28
VECTORS = "vec_id long, v binary, n2 double, wide string"


def whole(x: float) -> int:
    """floor(256 * x), exact for any finite x."""
    return int(x) * 256 if abs(x) >= 2.0**53 else math.floor(256.0 * x)


def numbers(v: bytes, wide: str | None) -> list[int]:
    return [int(x) for x in wide.split(",")] if wide is not None else np.frombuffer(v, dtype="<i4").tolist()


def product(a: list[int], b: list[int]) -> int:
    return sum(x * y for x, y in zip(a, b))  # noqa: B905  the shorter vector is filled up with 0


def quantized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, vector) to VECTORS: int32 components as bytes and the squared length, or wide; rows that take no part go."""
    for batch in batches:
        ids, vecs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        out_id, out_v, out_n, out_w = [], [], [], []
        for i, vec in zip(ids, vecs, strict=True):
            if i is None or vec is None or None in vec:
                continue
            x = np.asarray(vec, dtype=np.float64)
            if not np.isfinite(x).all():
                continue
            out_id.append(i)
            if len(x) and np.abs(x).max() * 256.0 > LARGEST - 1:
                out_v.append(b"")
                out_n.append(0.0)
                out_w.append(",".join(str(whole(y)) for y in x.tolist()))
                continue
            x = np.floor(256.0 * x)
            out_v.append(x.astype("<i4").tobytes())
            out_n.append(float((x * x).sum()))
            out_w.append(None)
        yield pa.RecordBatch.from_arrays([pa.array(out_id, pa.int64()), pa.array(out_v, pa.binary()), pa.array(out_n, pa.float64()), pa.array(out_w, pa.string())], ["vec_id", "v", "n2", "wide"])


def matrix(blobs: list[bytes], width: int) -> np.ndarray:
    """Rows of float64, shorter vectors filled up with 0."""
    if all(len(b) == 4 * width for b in blobs):
        return np.frombuffer(b"".join(blobs), dtype="<i4").reshape(len(blobs), width).astype(np.float64)
    out = np.zeros((len(blobs), width))
    for row, b in zip(out, blobs, strict=True):
        row[: len(b) // 4] = np.frombuffer(b, dtype="<i4")
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first traversal of the lifted sample."""
    chosen = [0]
    near = np.linalg.norm(sample - sample[0], axis=1)
    while len(chosen) < min(pivots, len(sample)):
        j = int(near.argmax())
        if near[j] == 0:
            break
        chosen.append(j)
        near = np.minimum(near, np.linalg.norm(sample - sample[j], axis=1))
    return sample[chosen]


def lifted(v: np.ndarray, n2: np.ndarray, longest: float) -> np.ndarray:
    return np.c_[v, np.sqrt(np.maximum(0.0, longest - n2))]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)))


class Search:
    """Searches one partition's rows for a broadcast block of queries."""

    def __init__(self, queries, k: int, width: int, longest: float, chunk: int = 512):
        self.queries, self.k, self.width, self.longest, self.chunk = queries, k, width, longest, chunk

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q_ids, q_blobs, q_n2, q_wide, pivots = self.queries.value
        q = matrix(q_blobs, self.width)
        narrow = [j for j, w in enumerate(q_wide) if w is None]
        far_queries = {j: numbers(b"", w) for j, w in enumerate(q_wide) if w is not None}
        shown: list[list[int]] = []  # whole numbers of the queries, if a wide row comes
        # sums of products below 2**24 and 2**53 are exact in these types; beyond, integers
        peak = max(1.0, float(np.abs(q).max(initial=0)))
        to_pivot = distances(np.c_[q, np.zeros(len(q))], pivots).astype(np.float32)
        best = [[] for _ in q_ids]
        slack = 1e-3 * math.sqrt(self.longest + 1) + 1e-3
        for batch in batches:
            if far_queries or batch.column(3).null_count < len(batch):
                shown = shown or [numbers(b, w) for b, w in zip(q_blobs, q_wide, strict=True)]
                for i, b, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    row = numbers(b, w) if far_queries or w is not None else []
                    for j in far_queries if w is None else range(len(q_ids)):
                        if q_ids[j] != i:
                            best[j] = sorted([*best[j], (-product(shown[j], row), i)])[: self.k]
                batch = batch.filter(pa.compute.is_null(batch.column(3)))
            if not len(batch):
                continue
            ids = np.asarray(batch.column(0))
            v = matrix(batch.column(1).to_pylist(), self.width)
            table = np.stack([np.frombuffer(b, dtype="<f4") for b in batch.column(2).to_pylist()])
            bound = peak * max(1.0, float(np.abs(v).max())) * self.width
            kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
            v, qk = v.astype(kind), q.astype(kind)
            for j in narrow:
                self._one(best[j], ids, v, table, qk[j], q_ids[j], q_n2[j], to_pivot[j], slack)
        most = 2**63 - 1
        rows = [(q_ids[j], i, max(-most, min(most, -s)), abs(s) <= most) for j, found in enumerate(best) for s, i in found]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.bool_() if n == 3 else pa.int64()) for n, c in enumerate(columns)], ["query_id", "vec_id", "score", "fits"])

    def _one(self, found, ids, v, table, q, own, q_n2, to_pivot, slack) -> None:
        """found: at most k pairs (-score, id), least first; it gets this batch's better rows."""
        low = np.abs(table - to_pivot).max(axis=1)
        order = np.argsort(low, kind="stable")
        start, step = 0, self.chunk
        while start < len(order):
            if len(found) == self.k:
                reach = math.sqrt(max(0.0, q_n2 + self.longest + 2.0 * float(found[-1][0]))) + slack
                if low[order[start]] > reach:
                    return
            take = order[start : start + step]
            start, step = start + step, 4 * step
            scores = v[take] @ q
            other = ids[take] != own
            take, scores = take[other], scores[other]
            if len(found) == self.k:
                good = scores >= -found[-1][0]
                take, scores = take[good], scores[good]
            if len(take) > self.k:
                cut = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                take, scores = take[scores >= cut], scores[scores >= cut]
            pairs = [(-int(s), int(i)) for s, i in zip(scores, ids[take], strict=True)]
            found[:] = sorted([*found, *pairs])[: self.k]


def top_k(vectors: DataFrame, id_col: str, vector_col: str, k: int = 5, every: int = 50, pivots: int = 32, pivot_sample: int = 1024, query_block: int = 8192, at_once: int = 4) -> DataFrame:
    """The k rows of largest inner product for each row whose id is divisible by `every`, among all other rows.

    Components count as floor(256 * x). Rows (query_id, rank, vec_id, score), rank from 1; ties go to the smaller id.
    Vectors that are null or hold null or non-finite components, and rows without id take no part; a score among the k that
    does not fit a long raises. Vectors of unequal length compare as if filled up with 0; an empty one scores 0. Rows with
    the query's id are its own. Rows that repeat count each: as candidates they fill several ranks, and queries of one id
    share its k ranks. A query without other rows, as in an empty table, gives no rows. id_col and vector_col alone are read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "top-k")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows = scratch.write(rows.mapInArrow(quantized, VECTORS), "vectors")
    longest, width, n_queries = rows.agg(F.max("n2"), F.max(F.octet_length("v")), F.count_if(F.col("vec_id") % every == 0)).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n_queries:
        return spark.createDataFrame([], schema)
    width = (width or 0) // 4
    sample = rows.where(F.col("wide").isNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivot_sample).collect()
    points = np.zeros((1, width + 1))
    if sample:
        points = choose_pivots(lifted(matrix([r.v for r in sample], width), np.array([r.n2 for r in sample]), longest), pivots)

    def with_distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = lifted(matrix(batch.column(1).to_pylist(), width), np.asarray(batch.column(2)), longest)
            far = distances(at, points).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in far], pa.binary()), batch.column(3)], ["vec_id", "v", "far", "wide"])

    index = scratch.write(rows.mapInArrow(with_distances, "vec_id long, v binary, far binary, wide string"), "index")
    blocks = -(-n_queries // query_block)
    asked = rows.where(F.col("vec_id") % every == 0)

    def search(b: int) -> None:
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select(*names).toArrow().to_pydict()
        if not own["vec_id"]:
            return
        sent = spark.sparkContext.broadcast((*(own[c] for c in names), points))
        found = index.mapInArrow(Search(sent, k, width, longest), "query_id long, vec_id long, score long, fits boolean")
        best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        score = F.when(F.col("fits"), F.col("score")).otherwise(F.raise_error(F.lit("a score among the best does not fit a long")))
        found = found.withColumn("rank", best).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
        scratch.write(found, f"found/block={b}")
        sent.destroy()

    names = ["vec_id", "v", "n2", "wide"]
    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(search, range(blocks)))
    return spark.read.schema(schema).parquet(f"{scratch.path}/found/block=*")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")


OP9_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored
) WHERE rank <= 5
"""
