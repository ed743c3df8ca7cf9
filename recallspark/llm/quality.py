"""Quality rules: robust multivariate outliers by minimum covariance determinant (DataFrame functions only).

Word statistics of every text become a vector of five transformed features. For every pair of
language and source (and for every language and the whole corpus, as fall-backs for small groups) location and
scatter are estimated from the three quarters of the rows whose scatter has the smallest determinant: concentration steps from two
starts, at the medians with the median absolute deviations and at the medians with fixed deviations, and of the two results of a group
the one of lower determinant. Rows far from the estimate of their own group are rejected. LEAST_SD keeps features that hardly vary from
giving a determinant of zero; its square is added to the variances.

Each step is two aggregations over a narrow table of the features; features and distances are
rounded to a grid, so the medians and quantiles aggregate counts of a bounded number of values
and sums are exact integers, the same in any order of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chi2_cdf, chi2_quantile, let, materialize, small, words

FEATURES = 5
GRID = 1024
COVERED = 0.75
STEPS = 5
LEAST_ROWS = 100
CUTOFF_P = 1 - 1e-11
#: Least standard deviation of each feature: log words, log mean word length, log symbols, shares of repeated lines and words.
LEAST_SD = (0.3, 0.08, 0.25, 0.06, 0.06)
DIST_GRID = 256


def _pair(a: Column, shift: int) -> Column:
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - shift, F.lit(0))), F.slice(a, F.lit(shift + 1), F.greatest(F.size(a) - shift, F.lit(0))), lambda x, y: F.xxhash64(x, y))


def _covered(h8: Column) -> Column:
    """How many words lie in windows, given by their hashes, that occur twice or more."""

    def from_sorted(s: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])

        at = F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"]))
        return let(at, lambda p: F.aggregate(F.zip_with(p, F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0))), lambda x, y: F.least(F.lit(8), F.coalesce(y - x, F.lit(8)))), F.lit(0), lambda acc, x: acc + x))

    order = F.sort_array(F.transform(h8, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(h8)) == F.size(h8), F.lit(0)).otherwise(let(order, from_sorted))


def _repeat_words(w: Column) -> Column:
    by_8 = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: let(_pair(h, 1), lambda h2: let(_pair(h2, 2), lambda h4: let(_pair(h4, 4), _covered))))
    return F.when(F.size(w) < 9, F.lit(0)).otherwise(by_8)


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines); null texts count as empty.

    Windows of eight words are compared by 64-bit hashes within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def without(chars: str, t: Column) -> Column:
        return reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), chars, t)

    out = docs.select("doc_id", "lang", "source", text.alias("text"))
    full = F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0)
    out = out.select(
        "doc_id", "lang", "source",
        let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).cast("long").alias("n_repeat_words"))).alias("a"),
        F.length(without(" \t\n\x0b\x0c\r", F.col("text"))).cast("long").alias("word_chars"),
        (F.length("text") - F.length(without("#*$%&|<>", F.col("text")))).cast("long").alias("n_symbols"),
        let(full, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("b"),
    )
    return out.select("doc_id", "lang", "source", "a.n_words", "word_chars", "n_symbols", "b.n_dup_lines", "a.n_repeat_words", "b.n_lines")


def features(stats: DataFrame) -> DataFrame:
    """stats with base_failed and the features q0..q4 as integers on the grid."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    raw = (
        F.log1p("n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        F.col("n_repeat_words") / n,
    )
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumns({f"q{i}": F.round(x * GRID).cast("int") for i, x in enumerate(raw)})


def group_keys(lang: Column, source: Column) -> Column:
    """The row's groups from the finest: language and source, language, all."""
    part = lambda c: F.coalesce(F.hex(c), F.lit("~"))
    return F.array(F.concat(F.lit("2:"), part(lang), F.lit(":"), part(source)), F.concat(F.lit("1:"), part(lang)), F.lit("0"))


def _with_d2(rows: DataFrame, p: int = FEATURES) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance of q0.. from m0.. by forward substitution with the factor c00, c10, ...

    One column for each step, so no term is written out twice.
    """
    for i in range(p):
        x = F.col(f"q{i}") - F.col(f"m{i}")
        for j in range(i):
            x = x - F.col(f"c{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", x / F.col(f"c{i}{i}"))
    return rows.withColumn("d2", reduce(lambda a, b: a + b, [F.col(f"z{i}") * F.col(f"z{i}") for i in range(p)]))


def _cholesky(t: DataFrame, p: int = FEATURES) -> DataFrame:
    """c_ij of the factor of v_ij (lower triangles); the least deviations are on the diagonal already."""
    for j in range(p):
        s = F.col(f"v{j}{j}")
        for k in range(j):
            s = s - F.col(f"c{j}{k}") * F.col(f"c{j}{k}")
        t = t.withColumn(f"c{j}{j}", F.sqrt(F.greatest(s, F.lit((LEAST_SD[j] * GRID) ** 2 / 16))))
        for i in range(j + 1, p):
            x = F.col(f"v{i}{j}")
            for k in range(j):
                x = x - F.col(f"c{i}{k}") * F.col(f"c{j}{k}")
            t = t.withColumn(f"c{i}{j}", x / F.col(f"c{j}{j}"))
    return t


def _params(t: DataFrame, *more: str, p: int = FEATURES) -> DataFrame:
    return _cholesky(t).select("key", *more, "n", *[f"m{i}" for i in range(p)], *[f"c{i}{j}" for i in range(p) for j in range(i + 1)])


def fit_mcd(rows: DataFrame, *, covered: float = COVERED, steps: int = STEPS) -> DataFrame:
    """(key, n, m0.., c00..): location and Cholesky factor of the scatter of each key of rows(key, q0..)."""
    p = range(FEATURES)
    med = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.percentile(f"q{i}", F.lit(0.5)).alias(f"m{i}") for i in p])
    # rows meet the few group estimates by broadcast where these are few, so that a hot group is not dealt to one task
    med = small(materialize(med, "medians"))
    mad = rows.join(med, "key").groupBy("key", "n", *[f"m{i}" for i in p]).agg(*[F.percentile(F.abs(F.col(f"q{i}") - F.col(f"m{i}")).cast("int"), F.lit(0.5)).alias(f"a{i}") for i in p])
    spread = materialize(mad.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))), "spread")
    deviation = lambda i: F.when(F.col("start") == 0, F.greatest(1.4826 * F.col(f"a{i}"), F.lit(LEAST_SD[i] * GRID))).otherwise(F.lit(LEAST_SD[i] * GRID))
    start = spread.select("key", "start", "n", *[f"m{i}" for i in p], *[(F.pow(deviation(i), 2) if i == j else F.lit(0.0)).alias(f"v{i}{j}") for i in p for j in range(i + 1)])
    params = small(materialize(_params(start, "start"), "start"))
    factor = covered / chi2_cdf(chi2_quantile(covered, FEATURES), FEATURES + 2)
    whole = lambda c: c.cast("decimal(20,0)")
    for step in range(steps):
        # a row meets both starts of its key
        at = _with_d2(rows.join(params, "key")).select("key", "start", "n", *[f"q{i}" for i in p], F.floor(F.log1p(F.least(F.col("d2"), F.lit(1e9))) * DIST_GRID).cast("int").alias("bin"))
        cut = small(materialize(at.groupBy("key", "start").agg(F.percentile("bin", F.lit(covered)).alias("most")), f"cut{step}"))
        near = at.join(cut, ["key", "start"]).filter("bin <= most")
        sums = near.groupBy("key", "start", "n").agg(F.count("*").alias("h"), *[F.sum(F.col(f"q{i}").cast("long")).alias(f"s{i}") for i in p], *[F.sum(whole(F.col(f"q{i}").cast("long") * F.col(f"q{j}"))).alias(f"s{i}{j}") for i in p for j in range(i + 1)])
        mean = [(F.col(f"s{i}") / F.col("h")).alias(f"m{i}") for i in p]
        # exact integer numerator n * sum(xy) - sum(x) sum(y), so no digits are lost
        cov = [(factor * ((F.col("h").cast("decimal(18,0)") * F.col(f"s{i}{j}").cast("decimal(30,0)")).cast("double") - F.col(f"s{i}").cast("double") * F.col(f"s{j}").cast("double")) / (F.col("h").cast("double") * F.col("h"))) for i in p for j in range(i + 1)]
        pairs = [(i, j) for i in p for j in range(i + 1)]
        cov = [(c + F.lit((LEAST_SD[i] * GRID) ** 2) if i == j else c).alias(f"v{i}{j}") for (i, j), c in zip(pairs, cov, strict=True)]
        params = small(materialize(_params(sums.select("key", "start", "n", *mean, *cov), "start"), f"params{step}"))
    # the logarithm of the determinant's root, rounded so that results that are the same tie
    det = F.round(reduce(lambda x, y: x + y, [F.log(f"c{i}{i}") for i in p]), 9)
    rest = [c for c in params.columns if c not in ("key", "start")]
    best = params.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(det, "start")).alias("best"))
    return best.select("key", *[f"best.{c}" for c in rest])


def quality_verdicts(docs: DataFrame, *, covered: float = COVERED, steps: int = STEPS, least_rows: int = LEAST_ROWS, cutoff_p: float = CUTOFF_P) -> DataFrame:
    """The statistics of each row of docs with base_failed, distance2 (null where no group is large enough) and kept.

    Groups are estimated from rows that pass the base rules. A group of fewer than least_rows rows takes the
    estimate of its language, or of the whole corpus; if that is too small too, nothing more
    is rejected. Null language or source: a group of its own. Repeated rows: each counts. Empty
    table: empty result.
    """
    stats = materialize(features(text_stats(docs)), "stats")
    q = [f"q{i}" for i in range(FEATURES)]
    good = stats.filter(~F.col("base_failed")).select(F.explode(group_keys(F.col("lang"), F.col("source"))).alias("key"), *q)
    params = fit_mcd(good, covered=covered, steps=steps).filter(F.col("n") >= least_rows)
    # the finest level with an estimate; the group table has one row for each language and source
    keys = stats.select("lang", "source").distinct().withColumn("keys", group_keys(F.col("lang"), F.col("source")))
    own = keys.select("lang", "source", F.posexplode("keys").alias("level", "key")).join(params, "key")
    fit = [c for c in params.columns if c not in ("key", "n")]
    best = own.groupBy("lang", "source").agg(F.min_by(F.struct(*fit), "level").alias("fit"))
    best = small(materialize(best.select(F.concat_ws(":", F.coalesce(F.hex("lang"), F.lit("~")), F.coalesce(F.hex("source"), F.lit("~"))).alias("key"), *[f"fit.{c}" for c in fit]), "fits"))
    rows = stats.withColumn("key", F.concat_ws(":", F.coalesce(F.hex("lang"), F.lit("~")), F.coalesce(F.hex("source"), F.lit("~"))))
    known = _with_d2(rows.join(best, "key", "left"))
    far = F.coalesce(F.col("d2") > chi2_quantile(cutoff_p, FEATURES), F.lit(False))
    return known.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), F.col("d2").alias("distance2"))
