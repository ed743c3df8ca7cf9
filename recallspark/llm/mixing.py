"""Mixing sources to target weights by Efraimidis-Spirakis sampling (DataFrame functions only).

Every document gets an exponential key -ln(u) / w, with u from a hash of its id and w its
quality weight. A source's target is met by complete epochs over all its documents, and then by
its documents in key order until their summed sizes reach the rest.

The order within a source is never established in one task: keys fall in bins, about equally full whatever the weights, sums by (source, bin)
find the one bin in which the rest is reached, and only that bin's documents are sorted and summed. Bins come from SPLITS quantiles of
the source's keys, found by mergeable sketches, and equal parts between them; where they lie decides nothing but the work.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, n_words, small

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
#: Quantiles of a source's keys, and bins between two of them.
SPLITS, PARTS = 64, 64
SEED = "mix-1"


def uniform(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number above 0 and below 1 from a hash of the id, or of the text where there is no id."""
    digits = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(2**48))


def quality_weight(text: Column) -> Column:
    """Between 0.1 and 1, from statistics of the quality rules: falls with the share of symbols among a text's characters and with that of lines equal to earlier ones."""
    n = F.greatest(F.length(text), F.lit(1))
    plain = text
    for c in "#*$%&|<>":
        plain = F.replace(plain, F.lit(c), F.lit(""))
    symbols = F.length(text) - F.length(plain)
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    fresh = let(lines, lambda x: F.size(F.array_distinct(x)) / F.greatest(F.size(x), F.lit(1)))
    # a text of one line repeats none
    fresh = F.when(F.locate("\n", text) > 0, fresh).otherwise(F.lit(1.0))
    return F.coalesce(F.greatest(F.lit(0.1), (F.lit(1.0) - F.lit(10.0) * symbols / n) * fresh), F.lit(0.1))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) for each source.

    The weights repeat over the sources in order, null last. A target stops at most times its
    source's size and the excess is shared out again by weight. With x the words a unit of weight
    gets, a source is full from x = most * size / weight on; sources sorted by that value fill one
    after the other, so x follows from running sums and needs no rounds. The order is taken over one row
    for each source, not over documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    t = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("weight"))
    t = t.withColumn("goal", F.least(F.lit(share), F.lit(most)) * F.sum("source_size").over(total))
    fill = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    t = t.withColumn("open_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the level if the sources before this one are full and this one and the later ones are not;
    # it falls from the first source on for which that holds
    t = t.withColumn("level", (F.col("goal") - F.col("filled")) / F.col("open_weight"))
    t = t.withColumn("level", F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(total))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return t.select("source", "source_size", target.cast("double").alias("target"))


def binned(keyed: DataFrame, splits: int = SPLITS, parts: int = PARTS) -> DataFrame:
    """keyed with bin, which never falls with the key within a source and holds about one of splits * parts of its rows.

    Between two quantiles bins are equally wide; beyond the last they follow the exponential tail.
    """
    at = [(k + 1) / splits for k in range(splits - 1)]
    marks = keyed.groupBy("source").agg(F.percentile_approx("key", F.array(*[F.lit(x) for x in at]), F.lit(20_000)).alias("marks"))
    marks = small(materialize(marks.select(F.col("source").alias("marks_of"), F.concat(F.array(F.lit(0.0)), "marks").alias("marks")), "marks"))
    rows = keyed.join(marks, F.col("source").eqNullSafe(F.col("marks_of")))
    j = F.size(F.filter("marks", lambda m: m <= F.col("key")))
    rows = rows.withColumn("j", F.greatest(j, F.lit(1)))
    low, high = F.element_at("marks", F.col("j")), F.try_element_at(F.col("marks"), F.col("j") + 1)
    mean = F.greatest(F.element_at("marks", -1) / F.lit(math.log(splits)), F.lit(1e-9))
    part = F.when(high.isNull(), 1.0 - F.exp(-(F.col("key") - low) / mean)).when(high > low, (F.col("key") - low) / (high - low)).otherwise(0.0)
    return rows.withColumn("bin", (F.col("j") * parts + F.least(F.floor(part * parts), F.lit(parts - 1))).cast("int")).drop("marks", "marks_of", "j")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of docs(doc_id, text, source).

    Null and empty texts have size 0 and are taken with 0 words. The document in which the rest is
    reached is taken if that brings the sum nearer to the target. Repeated rows are rows of
    their own with equal keys, put in order by their size and a hash of their text. An empty table gives an empty result; columns
    other than the three are not read.
    """
    return _plan(docs, weights, share, most, seed, quality).drop("tie")


def _plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_EPOCHS, seed: str = SEED, quality: Column | None = None) -> DataFrame:
    """mix() with tie, the hash of the text."""
    weight = quality if quality is not None else quality_weight(F.col("text"))
    base = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), (-F.log(uniform(F.col("doc_id"), F.col("text"), seed)) / weight).alias("key"), F.xxhash64("text").alias("tie"))
    base = materialize(base, "sized")
    base = materialize(binned(base), "binned")
    by_bin = materialize(base.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    targets = source_targets(by_bin.groupBy("source").agg(F.sum("bin_size").alias("source_size")), weights, share, most)
    targets = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    targets = targets.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = materialize(targets, "targets")
    # the bin in which the rest is reached: one row for each (source, bin), at most bins a source
    running = Window.partitionBy("source").orderBy("bin")
    t2 = targets.select(F.col("source").alias("s2"), "source_size", "target", "epochs", "rest")
    cut = by_bin.withColumn("before", F.sum("bin_size").over(running) - F.col("bin_size")).join(t2, F.col("source").eqNullSafe(F.col("s2")))
    cut = cut.filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("bin_size")) & (F.col("rest") > 0))
    cut = materialize(cut.select("s2", F.col("bin").alias("cut_bin"), "before"), "cuts")
    plan = t2.join(cut.withColumnRenamed("s2", "s3"), F.col("s2").eqNullSafe(F.col("s3")), "left").drop("s3")
    rows = base.join(small(plan), F.col("source").eqNullSafe(F.col("s2")))
    whole = rows.filter(F.col("cut_bin").isNull() | (F.col("bin") != F.col("cut_bin")))
    whole = whole.withColumn("extra", (F.coalesce(F.col("bin") < F.col("cut_bin"), F.lit(False)) & (F.col("rest") > 0)).cast("long"))
    within = Window.partitionBy("s2").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    part = rows.filter(F.col("bin") == F.col("cut_bin"))
    so_far = F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0))
    part = part.withColumn("so_far", so_far).withColumn("extra", (F.col("so_far") + F.col("size") / 2 <= F.col("rest")).cast("long"))
    out = whole.unionByName(part.drop("so_far"))
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), F.round("target", 6).alias("target"), (F.col("size") * (F.col("epochs") + F.col("extra"))).cast("long").alias("taken"), "tie")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The documents as often as the mix takes them: rows and columns of docs, repeats as repeated rows. Those it does not take, and those without words, go.

    Repeated rows of one id and text are each taken as often as the one taken most. An empty table gives an empty result.
    """
    plan = _plan(docs, **options).filter("taken > 0")  # type: ignore[arg-type]
    times = plan.groupBy(F.col("doc_id").alias("mix_id"), F.col("tie").alias("mix_tie")).agg(F.max(F.col("taken") / F.col("size")).cast("int").alias("mix_n"))
    columns = [F.col(f"mix_row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.xxhash64("text").alias("own_tie"))
    rows = rows.join(times, F.col("mix_row.doc_id").eqNullSafe(F.col("mix_id")) & (F.col("own_tie") == F.col("mix_tie")))
    return rows.withColumn("mix_i", F.explode(F.sequence(F.lit(1), F.col("mix_n")))).select(*columns)


SQL = """
WITH s AS (
  SELECT doc_id, source, text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
    length(coalesce(text, '')) AS n, coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0) AS sym, text IS NULL AS no_text,
    list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines,
    (('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (CASE WHEN no_text THEN 0.1 ELSE greatest(0.1, (1.0 - 10.0 * sym / greatest(n, 1)) * (CASE WHEN contains(s.text, chr(10)) THEN len(list_distinct(lines))::DOUBLE / greatest(len(lines), 1) ELSE 1.0 END)) END) AS key FROM s),
z AS (SELECT source, sum(size)::DOUBLE AS source_size FROM k GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source COLLATE "C" ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END AS weight, 1.5 * sum(source_size) OVER () AS goal FROM z),
f AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS full_at FROM w),
g AS (SELECT *, coalesce(sum(cap) OVER o, 0) AS filled, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS open_weight FROM f
  WINDOW o AS (ORDER BY full_at, source COLLATE "C" ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN (goal - filled) / open_weight <= full_at THEN (goal - filled) / open_weight END) OVER () AS level FROM g),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, weight * level) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
  coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS so_far
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id::BIGINT AS doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, round(target, 6)::DOUBLE AS target,
  (size * (epochs + CASE WHEN so_far + size / 2.0 <= rest AND rest > 0 THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
