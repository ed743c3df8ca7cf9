"""Line dedup: repeated line runs found on a suffix array over line ids, built by distributed prefix doubling.

The lines with words of all documents, in the order of doc_id and place, form one sequence with a separator of its own after
each document. Prefix doubling sorts its suffixes: round k knows for each suffix the rank of its
first 2^k lines, and sorting by (rank, rank of the suffix 2^k lines on) gives the ranks of twice as many. A rank is the
lower bound of an interval of the suffix array whose suffixes have a common prefix of 2^k
lines at least. A suffix alone in its interval shares no such run with any other; its place is settled
and it leaves, so the rounds soon work on few lines. Ranks come from a distributed sort of the intervals, one row each,
counted before the shuffle; equal suffixes are never gathered.

A run of m lines is repeated if its suffix lies in an interval of longest common prefix m or more: the
interval of the rank of its first 2^k lines met with that of its last 2^k lines, 2^k <= m < 2^(k+1).
Runs count from LEAST_WORDS words. Every maximal repeated run is the union of the shortest runs of that
many words that end or begin within it, so only these are looked up, one forward and
one backward for each line. Lines of runs with an earlier copy are deleted; a run that overlaps the first one of its interval
is no copy of it, so that of a text that repeats one line the first copy stays whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import batch_rows, materialize

LEAST_WORDS = 50

_LINES = "doc_id long, text_key long, i int, line int, h1 long, h2 long, fwd int, bwd int"
#: Stands for a null doc_id, behind all others.
_NO_ID = 2**63 - 1


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def line_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each line with words: its number i among them, its number among all lines, its 128-bit id, and
    the lengths in lines of the shortest runs of least_words words from it on (fwd) and up to it (bwd); 0 if there is none.

    Lines are equal if they are after trimming white space. text_key, a hash, tells texts of one doc_id apart; a null doc_id is _NO_ID here.
    """
    ship(docs)
    batch_rows(docs)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list] = [[] for _ in range(8)]
            for doc_id, key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                text = (value.as_py() or "").encode()
                full = [(k, t, len(t.split())) for k, t in ((k, t.strip()) for k, t in enumerate(text.split(b"\n"))) if t]
                if not full:
                    continue
                n = len(full)
                sums = np.concatenate(([0], np.cumsum([w for _, _, w in full])))
                if sums[-1] < least_words:
                    continue
                stop = np.searchsorted(sums, sums[:-1] + least_words, side="left")
                begin = np.searchsorted(sums, sums[1:] - least_words, side="right") - 1
                at = np.arange(n)
                ids128 = np.frombuffer(b"".join(xxhash.xxh3_128_digest(t) for _, t, _ in full), np.int64)
                for part, x in zip(parts, (np.full(n, doc_id), np.full(n, key), at, np.array([k for k, _, _ in full]), ids128[0::2], ids128[1::2], np.where(stop <= n, stop - at, 0), np.where(begin >= 0, at + 1 - begin, 0)), strict=True):
                    part.append(x)
            kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64, np.int32, np.int32]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(k) if p else np.zeros(0, k)) for p, k in zip(parts, kinds, strict=True)], ["doc_id", "text_key", "i", "line", "h1", "h2", "fwd", "bwd"])

    return docs.select(_id().alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(lines, _LINES)


def _ranked(pairs: DataFrame, name: str) -> DataFrame:
    """(a, b, rank): the intervals of two suffixes or more, with ranks in the order of (a, b)."""
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("n")).filter("n > 1").select("a", "b")
    return materialize(shared.orderBy("a", "b").withColumn("rank", F.monotonically_increasing_id()), name)


def suffix_ranks(lines: DataFrame, most_lines: int) -> list[DataFrame]:
    """For k = 0, 1, ...: (doc_id, text_key, i, rank) of the suffixes that share their first 2^k lines with another one, to 2^k <= most_lines."""
    key = ["doc_id", "text_key", "i"]
    pairs = lines.select(*key, F.col("h1").alias("a"), F.col("h2").alias("b"))
    levels: list[DataFrame] = []
    k = 0
    while True:
        shared = _ranked(pairs, f"intervals{k}")
        now = materialize(pairs.join(shared, ["a", "b"]).select(*key, "rank").dropDuplicates(key), f"ranks{k}")
        levels.append(now)
        if 2 ** (k + 1) > most_lines or now.limit(1).count() == 0:
            return levels
        on = now.select("doc_id", "text_key", (F.col("i") - 2**k).alias("i"), F.col("rank").alias("b"))
        pairs = now.withColumnRenamed("rank", "a").join(on, key)
        k += 1


def repeated_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text_key, lines): numbers of the lines of each text that belong to a later copy of a repeated run."""
    key = ["doc_id", "text_key", "i"]
    lines = materialize(line_table(docs, least_words), "lines")
    # the longest of the shortest runs: every line has a word, so at most least_words lines
    levels = suffix_ranks(lines, least_words)
    first = levels[0].select(*key)
    runs = lines.join(first, key, "left_semi").select("doc_id", "text_key", F.explode(F.array(F.struct("i", F.col("fwd").alias("m")), F.struct((F.col("i") + 1 - F.col("bwd")).alias("i"), F.col("bwd").alias("m")))).alias("r"))
    runs = runs.filter("r.m > 0").select("doc_id", "text_key", "r.i", "r.m").distinct()
    runs = materialize(runs, "runs")
    ranked = None
    for k, level in enumerate(levels):
        mine = runs.filter((F.col("m") >= 2**k) & (F.col("m") < 2 ** (k + 1)))
        head = level.select(*key, F.col("rank").alias("head"))
        part = mine.join(head, key)
        if k:
            tail = level.select("doc_id", "text_key", F.col("i").alias("at"), F.col("rank").alias("tail"))
            part = part.withColumn("at", F.col("i") + F.col("m") - 2**k).join(tail, ["doc_id", "text_key", "at"]).drop("at")
        else:
            part = part.withColumn("tail", F.col("head"))
        part = part.select(*key, "m", "head", "tail")
        ranked = part if ranked is None else ranked.unionByName(part)
    assert ranked is not None
    # sequence place as one number, so that the least of an interval is found by hash aggregation: id, 24 bits of the text's hash, line
    number = lambda c: c.cast("decimal(20,0)")
    place = number(F.col("doc_id")) * F.lit(2**56).cast("decimal(17,0)") + number(F.shiftrightunsigned("text_key", 40)) * F.lit(2**32).cast("decimal(10,0)") + number(F.col("i"))
    ranked = materialize(ranked.withColumn("place", place.cast("decimal(38,0)")), "ranked")
    interval = ranked.groupBy("m", "head", "tail").agg(F.min("place").alias("first"), F.max("place").alias("last")).filter("last - first >= m")
    # written first, so that the join deals its rows anew and a hot interval can be split
    interval = materialize(interval.select("m", "head", "tail", "first"), "first")
    later = ranked.join(interval, ["m", "head", "tail"]).filter("place - first >= m")
    gone = later.select("doc_id", "text_key", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("m") - 1)).alias("i")).distinct()
    return gone.join(lines.select(*key, "line").distinct(), key).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def dedup_lines(docs: DataFrame, *, least_words: int = LEAST_WORDS, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines of later copies deleted from text, n_chars (if there is one) set anew, and n_deleted (replaced, if there is one).

    Null, empty and short texts (under least_words words) stay as they are. Lines without words take no part and stay.
    Copies are later by doc_id, a whole number, nulls last, then by a hash of the text, then by place; repeated rows of one id and text count once
    and get the same result. drop_emptied leaves out texts that lost all their words. An empty table gives an empty result.
    """
    ship(docs)
    batch_rows(docs)
    gone = materialize(repeated_lines(docs, least_words=least_words), "deleted").select(F.col("doc_id").alias("gone_id"), F.col("text_key").alias("gone_key"), F.col("lines").alias("gone_lines"))
    columns = [c for c in docs.columns if c != "n_deleted"]
    at = {c: k for k, c in enumerate(columns)}
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), _id().alias("own_id"), F.xxhash64("text").alias("own_key"))
    joined = row.join(gone.hint("shuffle_hash"), (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left").select(F.col("row.text").alias("text"), F.col("gone_lines").alias("marks"), "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            counts = [0] * len(texts)
            blank = [False] * len(texts)
            for k, marks in enumerate(batch.column(1)):
                if marks.is_valid and texts[k] is not None:
                    out = set(marks.as_py())
                    texts[k] = "\n".join(t for j, t in enumerate(texts[k].split("\n")) if j not in out)
                    counts[k], blank[k] = len(out), not texts[k].strip(" \t\n\x0b\x0c\r")
            rows = batch.column(2)
            new = [rows.field(c) if c not in (at["text"], at.get("n_chars")) else None for c in range(len(at))]
            new[at["text"]] = pa.array(texts, rows.type.field(at["text"]).type)
            if "n_chars" in at:
                old = rows.field(at["n_chars"]).to_pylist()
                new[at["n_chars"]] = pa.array([len(t) if n else o for t, n, o in zip(texts, counts, old, strict=True)], rows.type.field(at["n_chars"]).type)
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(new, fields=list(rows.type)), pa.array(counts, pa.int64()), pa.array(blank, pa.bool_())], ["row", "n_deleted", "emptied"])

    schema = joined.select("row").schema.add("n_deleted", "long").add("emptied", "boolean")
    done = joined.mapInArrow(cut, schema)
    if drop_emptied:
        done = done.filter("not emptied")
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "n_deleted")
