"""Approximate nearest neighbours by additive quantisation.

Index: M full-dimensional codebooks are trained on a bounded sample, first as residual k-means, then refitted together by least
squares; every vector is encoded by beam search and stored in blocks with its codes, the norm of its
reconstruction and the norm of what is left. Search: queries come in bounded chunks, each
broadcast; tasks look the inner products of query and codewords up in tables, take the candidates whose estimate, widened by a
margin times the norm of what is left, may reach the twentieth best, and rank those exactly on the original vectors.
Equal vectors of a block are looked up once. The margin is statistical, so recall is not proven; no candidate is cut by rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import batch_rows, materialize

CODEBOOKS, WORDS, BEAM = 16, 256, 4
#: Bounds: vectors that train the codebooks, vectors in a block, queries broadcast at once.
SAMPLE, BLOCK, QUERIES = 8192, 4096, 2048
#: Standard deviations of an estimate's error, which is taken as spread evenly over the dimensions.
MARGIN = 4.5
TOP = 20


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part: not null, no null or non-finite component, not all zero."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).filter(~bad & F.exists("v", lambda x: x != 0))


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(axis=1)[None, :] - 2 * x @ c.T, axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes of the rows of x: after each codebook the beam partial sums nearest to the row go on."""
    n, (m, k, d) = len(x), books.shape
    x, books = x.astype(np.float32), books.astype(np.float32)
    codes, left = np.zeros((n, 1, 0), np.uint8), x[:, None, :]
    rows = np.arange(n)[:, None]
    for j in range(m):
        c = books[j]
        # |left - c|^2 without |left|^2 per beam would not compare beams, so it stays
        cost = (left * left).sum(axis=2)[:, :, None] - 2 * (left.reshape(-1, d) @ c.T).reshape(n, left.shape[1], k) + (c * c).sum(axis=1)
        flat = cost.reshape(n, -1)
        keep = min(beam, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
        parent, word = best // k, best % k
        codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        left = left[rows, parent] - c[word]
    return codes[np.arange(n), (left * left).sum(axis=2).argmin(axis=1)]


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum(books[j][codes[:, j]] for j in range(len(books)))


def train(x: np.ndarray, m: int = CODEBOOKS, k: int = WORDS, rounds: int = 1) -> np.ndarray:
    """Codebooks [m, k, d] from a sample."""
    rng, k = np.random.default_rng(11), min(k, len(x))
    left, books = x.copy(), []
    for _ in range(m):
        c = _kmeans(left, k, rng)
        books.append(c)
        left = left - c[_nearest(left, c)]
    out = np.stack(books)
    for _ in range(rounds):
        codes = np.concatenate([beam_encode(x[i : i + 512], out) for i in range(0, len(x), 512)])
        at = codes.astype(np.int64) + np.arange(m) * k
        gram, right = np.zeros((m * k, m * k)), np.zeros((m * k, x.shape[1]))
        for a in range(m):
            np.add.at(right, at[:, a], x)
            for b in range(m):
                np.add.at(gram, (at[:, a], at[:, b]), 1.0)
        # a ridge of one towards the old codewords, added in place
        gram.flat[:: m * k + 1] += 1.0
        right += out.reshape(m * k, -1)
        out = np.linalg.solve(gram, right).reshape(out.shape)
        del gram
    return out


def build_index(vectors: DataFrame, *, sample: int = SAMPLE) -> tuple[DataFrame, np.ndarray, tuple[np.ndarray, np.ndarray], int]:
    """(blocks, codebooks, ids and vectors of the sample, dimensions). vectors: (vec_id, v) as usable() gives; those of another dimension than most take no part."""
    ship(vectors)
    batch_rows(vectors, 10_000)  # narrow rows; blocks are cut from batches
    sizes = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.col("count").desc(), "d").first()
    if sizes is None:
        return vectors.limit(0), np.zeros((0, 0, 0)), (np.zeros(0, np.int64), np.zeros((0, 0))), 0
    d = sizes["d"]
    vectors = vectors.filter(F.size("v") == d)
    local = vectors.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    some = np.stack(local["v"].to_numpy()).astype(np.float64)
    books = train(some)
    shared = vectors.sparkSession.sparkContext.broadcast(books)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            out = []
            for i in range(0, len(ids), BLOCK):
                part = x[i : i + BLOCK]
                codes = np.concatenate([beam_encode(part[j : j + 512], c) for j in range(0, len(part), 512)])
                back = decode(codes, c)
                left = np.sqrt(((part - back) ** 2).sum(axis=1))
                out.append((ids[i : i + BLOCK].astype(np.int64).tobytes(), np.ascontiguousarray(part).tobytes(), codes.tobytes(), np.sqrt((back * back).sum(axis=1)).tobytes(), left.tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in columns], ["ids", "vectors", "codes", "norms", "left"])

    blocks = vectors.mapInArrow(encode, "ids binary, vectors binary, codes binary, norms binary, left binary")
    return materialize(blocks, "blocks"), books, (local["vec_id"].to_numpy(np.int64), some), d


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components, so equal rows give equal sums."""
    out = a[:, 0] * b[:, 0]
    for k in range(1, a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _prepare(ids: np.ndarray, x: np.ndarray, codes: np.ndarray, left: np.ndarray, top: int) -> tuple[np.ndarray, ...]:
    """(x, codes, left, ids, first, count) of a block with equal vectors once: ids[first[k]:first[k] + count[k]] are vector k's.

    Of equal vectors top rows of each id are kept, and of these the 2 * top with the smallest ids: even if top of them are the query's own,
    later ones cannot be among its nearest.
    """
    order = np.argsort(ids, kind="stable")
    ids, x, codes, left = ids[order], x[order], codes[order], left[order]
    _, at, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(same.ravel(), kind="stable")
    count = np.bincount(same.ravel())
    # rows are in the order of vectors, then ids; run is the start of each row's own vector and id
    of, ids = same.ravel()[by], ids[by]
    new = np.ones(len(by), bool)
    new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
    run = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
    few = np.arange(len(by)) - run < top
    of, ids = of[few], ids[few]
    count = np.bincount(of, minlength=len(at))
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    ids, count = ids[place < 2 * top], np.minimum(count, 2 * top)
    return x[at], np.ascontiguousarray(codes[at].T).astype(np.intp), left[at], ids, np.cumsum(count) - count, count


def _scan(qid: np.ndarray, q: np.ndarray, tables: np.ndarray, block: tuple[np.ndarray, ...], floor: np.ndarray, top: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of a block's candidates that reach floor, the scores each query has in hand. tables: [codebook, query, word]."""
    x, codes, left, ids, first, count = block
    rough = np.take(tables[0], codes[0], axis=1)
    for j in range(1, len(codes)):
        rough += np.take(tables[j], codes[j], axis=1)
    # scores surely in hand: the best by estimate, ranked exactly
    few = min(top + 1, len(x))
    best = np.argpartition(rough, len(x) - few, axis=1)[:, len(x) - few :]
    exact = _dots(np.repeat(q, few, axis=0), x[best.ravel()]).reshape(len(q), few)
    if few > top:
        # vectors that only the query's own rows have are not in hand; ids of a vector are in order
        own = (ids[first[best]] == qid[:, None]) & (ids[first[best] + count[best] - 1] == qid[:, None])
        floor = np.maximum(floor, np.partition(np.where(own, -np.inf, exact), few - top, axis=1)[:, few - top])
    size = np.sqrt((q * q).sum(axis=1))
    rough += ((margin / np.sqrt(q.shape[1])) * size[:, None] * left[None, :]).astype(np.float32)
    hit = rough >= (floor[:, None] - 1e-5).astype(np.float32)
    np.put_along_axis(hit, best, True, axis=1)
    qi, xi = np.nonzero(hit)
    near = np.concatenate([np.einsum("ij,ij->i", q[qi[i : i + 16384]], x[xi[i : i + 16384]]) for i in range(0, len(qi), 16384)]) if len(qi) else np.zeros(0)
    good = near >= floor[qi] - 1e-9 * size[qi]
    qi, xi = qi[good], xi[good]
    scores = _dots(q[qi], x[xi])
    good = scores >= floor[qi]
    qi, xi, scores = qi[good], xi[good], scores[good]
    n = count[xi]
    found = ids[np.repeat(first[xi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    qi, scores = np.repeat(qi, n), np.repeat(scores, n)
    own = found == qid[qi]
    return qi[~own], found[~own], scores[~own]


def search(blocks: DataFrame, books: np.ndarray, sampled: tuple[np.ndarray, np.ndarray], d: int, queries: DataFrame, *, top: int = TOP, margin: float = MARGIN, chunk: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) for each query(vec_id, v): its top nearest by inner product, ties to smaller vec_id, itself left out."""
    ship(blocks)
    spark = blocks.sparkSession
    some_ids, some = sampled
    queries = queries.filter(F.size("v") == d)
    n = queries.count()
    parts = max(1, -(-n // chunk))
    results = None
    for k in range(parts):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k) if parts > 1 else queries
        local = mine.toPandas()
        if not len(local):
            continue
        local = local.sort_values("vec_id")
        asked = np.stack(local["v"].to_numpy()).astype(np.float64)
        # no query's last place can fall under what it reaches on the sample, rows of its own id aside
        reach = np.full(len(asked), -np.inf)
        own_ids = local["vec_id"].to_numpy(np.int64)
        if len(some) >= top:
            for i in range(0, len(asked), 256):
                scores = asked[i : i + 256] @ some.T
                scores[own_ids[i : i + 256, None] == some_ids] = -np.inf
                reach[i : i + 256] = np.partition(scores, len(some) - top, axis=1)[:, len(some) - top] - 1e-9
        shared = spark.sparkContext.broadcast((own_ids, asked, books, reach))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            qid, q, c, reach = shared.value
            tables = np.einsum("qd,mkd->mqk", q, c, optimize=True).astype(np.float32)
            floor, longest = reach.copy(), np.sqrt((q * q).sum(axis=1).max())
            have = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
            for batch in batches:
                for r in batch.to_pylist():
                    ids, x = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, d)
                    codes, left = np.frombuffer(r["codes"], np.uint8).reshape(len(ids), -1), np.frombuffer(r["left"])
                    # no inner product is above |q| (|reconstruction| + |rest|); rows under every query's floor are not looked up
                    alive = longest * (np.frombuffer(r["norms"]) + left) >= floor.min() - 1e-6
                    if not alive.all():
                        ids, x, codes, left = ids[alive], x[alive], codes[alive], left[alive]
                        if not len(ids):
                            continue
                    block = _prepare(ids, x, codes, left, top)
                    for i in range(0, len(q), 256):
                        part = slice(i, i + 256)
                        qi, v, s = _scan(qid[part], q[part], tables[:, part], block, floor[part], top, margin)
                        have = tuple(np.concatenate(z) for z in zip(have, (qi + i, v, s), strict=True))
                    order = np.lexsort((have[1], -have[2], have[0]))
                    have = tuple(z[order] for z in have)
                    start = np.searchsorted(have[0], np.arange(len(q)))
                    keep = np.arange(len(order)) - start[have[0]] < top
                    have = tuple(z[keep] for z in have)
                    start = np.searchsorted(have[0], np.arange(len(q) + 1))
                    full = np.flatnonzero(np.diff(start) == top)
                    floor[full] = np.maximum(floor[full], have[2][start[full + 1] - 1])
            start = np.searchsorted(have[0], np.arange(len(q) + 1)).astype(np.int32)
            some = np.flatnonzero(np.diff(start))
            if len(some):
                pairs = pa.StructArray.from_arrays([pa.array(-have[2]), pa.array(have[1])], ["minus", "vec_id"])
                yield pa.RecordBatch.from_arrays([pa.array(qid[some]), pa.ListArray.from_arrays(pa.array(np.concatenate((start[some], [len(have[0])])).astype(np.int32)), pairs)], ["query_id", "near"])

        part_result = blocks.mapInArrow(scan, "query_id long, near array<struct<minus: double, vec_id: bigint>>")
        if parts > 1:
            part_result = materialize(part_result, f"near{k}")
        results = part_result if results is None else results.unionByName(part_result)
    if results is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # a list of top for each task that scanned: one number of tasks, however large the index
    best = results.groupBy("query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, top).alias("near"))
    return best.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).alias("rank"), "x.vec_id", (-F.col("x.minus")).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, *, top: int = TOP, margin: float = MARGIN, sample: int = SAMPLE) -> DataFrame:
    """Each query's top nearest of vectors(vec_id, embedding). queries: the same columns; every 20th id if left out.

    Vectors null, zero, with null or non-finite components or of another dimension than most, and rows without a vec_id, take no part. Repeated rows:
    each is a candidate; a query's own vec_id is none. Of several vectors under one query's vec_id the least is asked. Other columns are not read. No vectors:
    empty result.
    """
    ready = usable(vectors)
    asked = ready.filter(F.pmod(F.col("vec_id"), F.lit(20)) == 0) if queries is None else usable(queries)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks, books, sampled, d = build_index(ready, sample=sample)
    if d == 0:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(blocks, books, sampled, d, asked, top=top, margin=margin)


SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding::DOUBLE[], lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) AS score FROM e q JOIN e ON q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
