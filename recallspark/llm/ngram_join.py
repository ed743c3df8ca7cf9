"""N-gram Jaccard join by MinHash banding.

1. Every text becomes its set of hashed word 5-grams, a 128-bit hash of that set, and its band hashes.
2. Texts with equal sets are one class of copies, which has a number of its own; one row's text stands for it.
3. Classes meet in a shuffle on band hashes. Each is tied to the least of its bucket, so
   the ties' components hold every pair that shares a band.
4. Within a component the pairs that share a band are verified on the full n-gram sets, by blocks of bounded size:
   a component beyond one block is split, and every two blocks of it meet in one task.
   Pairs are counted there, each once, never emitted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..shipping import ship
from .common import batch_rows, materialize, small
from .components import components
from .shingles import N_WORDS, mix64, shingle_sets

THRESHOLD = 0.8
RECALL = 0.9999
#: Bounds of a block: n-grams and texts. A text beyond the bound is a block of its own.
BLOCK_GRAMS, BLOCK_TEXTS = 1 << 20, 256


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, loose: float = 0.4, most_loose: float = 0.5) -> tuple[int, int]:
    """(bands, rows): the fewest hashes with which a pair at the threshold shares a band with probability recall and one at loose does with most_loose at most."""
    best = None
    for rows in range(1, 16):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))
        if 1 - (1 - loose**rows) ** bands <= most_loose and (best is None or bands * rows < best[0] * best[1]):
            best = bands, rows
    assert best is not None
    return best


def _signature(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = None
    for i in range(0, len(grams), 16384):
        part = ((grams[i : i + 16384, None] ^ b) * a).min(axis=0)
        out = part if out is None else np.minimum(out, part)
    return out


def text_keys(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, width: int = N_WORDS) -> DataFrame:
    """(doc_id, r, n, k1, k2, bands): hash of id and text, n-grams, 128-bit hash of the n-gram set, band hashes. No words: n = 0 and nulls."""
    ship(docs)
    batch_rows(docs)
    n_bands, rows = bands_for(threshold, recall)
    rng = np.random.default_rng(7)
    a = rng.integers(0, 2**63, n_bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n_bands * rows, dtype=np.uint64)
    salt = rng.integers(0, 2**63, n_bands, dtype=np.uint64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k1, k2, bands = [], [], [], []
            with np.errstate(over="ignore"):
                for grams in shingle_sets(batch.column(2), width):
                    n.append(len(grams))
                    if not len(grams):
                        k1.append(None), k2.append(None), bands.append(None)
                        continue
                    digest = np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64)
                    k1.append(int(digest[0])), k2.append(int(digest[1]))
                    sig = _signature(grams, a, b).reshape(n_bands, rows)
                    h = salt.copy()
                    for r in range(rows):
                        h = mix64(h ^ sig[:, r])
                    bands.append(h.view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "r", "n", "k1", "k2", "bands"])

    schema = docs.select("doc_id").schema.add("r", "long").add("n", "long").add("k1", "long").add("k2", "long").add("bands", ArrayType(LongType()))
    return docs.select("doc_id", _row_hash().alias("r"), "text").mapInArrow(keys, schema)


def _row_hash() -> Column:
    """Tells the rows of a table apart by id and text, in 64 bits; equal rows are equal in it."""
    return F.xxhash64("doc_id", "text")


def _verify(reps: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, across: bool, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(root, documents linked) for each class of a cell, from the pairs that share a band; across: only pairs of different sides."""
    n = len(reps)
    met = np.zeros((n, n), bool)
    for j in range(bands.shape[1]):
        met |= bands[:, j, None] == bands[None, :, j]
    if across:
        met &= side[:, None] != side[None, :]
    np.fill_diagonal(met, False)
    size = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    edge = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    df = np.diff(np.concatenate((edge, [len(flat)])))
    shared = np.repeat(df > 1, df)
    column = np.repeat(np.cumsum(df > 1) - 1, df)[shared]
    owner = owner[shared]
    width = int((df > 1).sum())
    common = np.zeros((n, n), np.float32)
    step = max(1, (1 << 22) // n)
    cuts = np.searchsorted(column, np.arange(0, width + step, step))
    for k in range(len(cuts) - 1):
        x = np.zeros((n, step), np.float32)
        x[owner[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * step] = 1
        common += x @ x.T
    # common / (a + b - common) >= num / den, in whole numbers
    linked = met & (common.astype(np.int64) * (num + den) >= num * (size[:, None] + size[None, :]))
    links = linked @ copies
    root, seen = reps.copy(), np.zeros(n, bool)
    for i in np.argsort(reps, kind="stable"):
        if seen[i]:
            continue
        seen[i], todo = True, [i]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & ~seen)
            seen[new], root[new] = True, reps[i]
            todo += new.tolist()
    return root, links


def ngram_classes(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, width: int = N_WORDS) -> DataFrame:
    """(doc_id, r, root, class_id, n_links) for each row of docs(doc_id, text): root numbers the class within this run; null without words."""
    ship(docs)
    batch_rows(docs)
    num, den = round(threshold * 1000), 1000
    keys = materialize(text_keys(docs, threshold, recall, width), "keys")
    classes = keys.filter("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("least_id"), F.min("r").alias("r"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    # numbered where they are written, so that the numbers stay
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    met = classes.select("node", F.explode("bands").alias("band"))
    bucket = met.groupBy("band").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("band", "least")
    ties = met.join(materialize(bucket, "buckets"), "band").filter("node <> least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    near = components(ties, "candidates")
    near = materialize(near.select(F.col("u").alias("node"), F.col("m").alias("comp")).unionByName(near.select(F.col("m").alias("node"), F.col("m").alias("comp")).distinct()), "near")
    cells = materialize(classes.select("node", "r", "k1", "k2", "copies", "n", "bands").join(near, "node"), "members")
    weight = cells.groupBy("comp").agg(F.greatest(F.least(F.ceil(F.sum("n") / BLOCK_GRAMS), F.count("*")), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int").alias("nb"))
    weight = materialize(weight, "weights")
    split = weight.filter("nb > 1").limit(1).count() > 0
    # small components, all but few, are one cell; what is left is dealt to pairs of blocks
    placed = cells.join(small(weight), "comp").withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    texts = docs.select(_row_hash().alias("r"), "text").join(placed, "r")
    texts = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    texts = texts.withColumn("bi", F.least("b", "other")).withColumn("bj", F.greatest("b", "other"))
    parts = texts.select("comp", "bi", "bj", "b", "node", "k1", "k2", "copies", "bands", "text").repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, nodes, copies, bands, side, sets, got = None, [], [], [], [], [], set()
        out: list[tuple] = []

        def close() -> None:
            if len(nodes) > 1:
                r = np.array(nodes, np.int64)
                out.extend(zip(nodes, *(x.tolist() for x in _verify(r, np.array(copies, np.int64), sets, np.array(bands, np.int64), np.array(side), cell[1] != cell[2], num, den)), strict=True))

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 3
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "root", "links"])

        for batch in batches:
            comp, bi, bj, b, node, k1, k2, n_copies = (batch.column(i).to_pylist() for i in range(8))
            of = batch.column(8).to_pylist()
            for i, grams in enumerate(shingle_sets(batch.column(9), width)):
                if (comp[i], bi[i], bj[i]) != cell:
                    close()
                    cell, nodes, copies, bands, side, sets, got = (comp[i], bi[i], bj[i]), [], [], [], [], [], set()
                # a repeated row, or a row whose hash is another's
                if node[i] in got or np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64).tolist() != [k1[i], k2[i]]:
                    continue
                got.add(node[i])
                nodes.append(node[i]), copies.append(n_copies[i]), bands.append(of[i]), side.append(b[i]), sets.append(grams)
            if len(out) > 5000:
                yield batch_of()
        close()
        yield batch_of()

    found = materialize(parts.mapInArrow(verified, "node long, root long, links long"), "verified")
    links = found.groupBy("node").agg(F.sum("links").alias("links"), F.min("root").alias("root"))
    if split:
        whole = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), "links")
        links = links.drop("root").join(whole.select(F.col("u").alias("node"), F.col("m").alias("root")), "node", "left")
    by_class = materialize(classes.select("k1", "k2", "node", "least_id", "copies").join(links, "node", "left").select("k1", "k2", "least_id", F.coalesce("root", "node").alias("root"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "linked")
    ids = materialize(by_class.groupBy("root").agg(F.min("least_id").alias("class_id")), "ids")
    by_class = materialize(by_class.join(ids, "root").select("k1", "k2", "root", "class_id", "n_links"), "classed")
    full = keys.filter("n > 0").select("doc_id", "r", "k1", "k2").join(by_class, ["k1", "k2"]).select("doc_id", "r", "root", "class_id", "n_links")
    empty = keys.filter("n = 0").select("doc_id", "r", F.lit(None).cast("long").alias("root"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    return full.unionByName(empty)


def ngram_join(docs: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, width: int = N_WORDS) -> DataFrame:
    """(doc_id, class_id, n_links) for each row of docs(doc_id, text); other columns are not read.

    A row's class is the component of texts linked by Jaccard similarity of threshold or more, and class_id the least doc_id in it
    (nulls aside; null if it has no other); n_links counts the other rows linked to the row, copies included. Texts of fewer
    words than width have one n-gram of all their words. Null and empty texts take no part: class
    of their own, no links. Repeated rows are copies of each other; different texts of one doc_id, or of none, are different rows. An
    empty table gives an empty result. doc_id is of any type that has an order.
    """
    return ngram_classes(docs, threshold=threshold, recall=recall, width=width).select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, **options: object) -> DataFrame:
    """One row of docs for each class, with all its columns: of the least doc_id, then of the least hash of id and text.

    Rows without words all stay. Of repeated rows one stays. An empty table gives an empty result.
    """
    rows = materialize(ngram_classes(docs, **options), "joined")  # type: ignore[arg-type]
    rows = rows.filter("root is not null")
    # of the least doc_id, nulls last, the least hash
    least = rows.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min("r").alias("stays"))
    gone = rows.join(materialize(least, "stay"), "root").filter("r <> stays").select(F.col("r").alias("gone_r")).distinct()
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("of"), _row_hash().alias("own_r"))
    kept = own.join(materialize(gone, "gone"), F.col("own_r") == F.col("gone_r"), "left_anti")
    twice = materialize(rows.groupBy(F.col("r").alias("twice_r")).count().filter("count > 1").select("twice_r"), "repeated")
    if twice.limit(1).count() > 0:
        again = F.col("own_r") == F.col("twice_r")
        once = kept.join(twice, again, "left_semi").dropDuplicates(["own_r"])
        kept = kept.join(twice, again, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"of.`{c}`").alias(c) for c in docs.columns])
