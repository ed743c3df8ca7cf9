"""Evaluation analytics: retrieval metrics, failure stages, comparisons, answer scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ConflictError
from ..functions.text import gold_text, is_abstention, normalize_answer
from ..storage import small

CUTOFFS = (1, 3, 5, 10)
STAGES = ("SUCCESS", "RANKING_MISS", "RETRIEVAL_MISS", "NO_GOLD_MEMORY")
STAGE_K = 5


def question_metrics(hits: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """(qid, n_gold, first_rank, hit_k..., recall_k..., reciprocal) from hits(qid, rank, evidence) and gold(qid, evidence).

    evidence null in gold: a question without evidence, n_gold 0. Recall is distinct gold found up to k over distinct gold.
    """
    goal = gold.distinct()
    found = goal.join(hits, ["qid", "evidence"]).groupBy("qid", "evidence").agg(F.min("rank").alias("rank"))
    n = goal.groupBy("qid").agg(F.count("evidence").alias("n_gold"))
    by = found.groupBy("qid").agg(F.min("rank").alias("first_rank"), *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in cutoffs])
    out = n.join(by, "qid", "left")
    hit = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double").alias(f"hit_{k}") for k in cutoffs]
    recall = [F.coalesce(F.col(f"found_{k}") / F.nullif(F.col("n_gold"), F.lit(0)), F.lit(0.0)).alias(f"recall_{k}") for k in cutoffs]
    return out.select("qid", "n_gold", F.col("first_rank").cast("long").alias("first_rank"), *hit, *recall, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"))


def summarize(metrics: DataFrame, *by: str, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Means over questions with evidence, 0 if there are none; questions without it are counted. With by: overall and by group, in one pass."""
    some = F.col("n_gold") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(some, F.col(c))), F.lit(0.0)), 6)
    aggs = [F.count_if(some).alias("n_questions"), F.count_if(~some).alias("n_no_evidence"), *[mean(f"{m}_{k}").alias(f"{m}_{k}") for m in ("hit", "recall") for k in cutoffs], mean("reciprocal").alias("mrr")]
    return (metrics.rollup(*by) if by else metrics.groupBy()).agg(*aggs)


def stage(metrics: DataFrame, covered: DataFrame, gold: DataFrame, k: int = STAGE_K) -> DataFrame:
    """(qid, first_rank, stage). covered(evidence): what active memories hold. No evidence: null."""
    held = gold.join(covered.distinct(), "evidence").select("qid").distinct().withColumn("held", F.lit(True))
    rows = metrics.select("qid", "n_gold", "first_rank").join(held, "qid", "left")
    name = F.when(F.col("n_gold") == 0, None).when(F.col("held").isNull(), "NO_GOLD_MEMORY").when(F.col("first_rank").isNull(), "RETRIEVAL_MISS").when(F.col("first_rank") <= k, "SUCCESS").otherwise("RANKING_MISS")
    return rows.select("qid", "first_rank", name.alias("stage"))


def stage_counts(stages: DataFrame) -> DataFrame:
    """(stage, n) with all stages, absent ones with 0."""
    names = stages.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    return names.join(stages.groupBy("stage").count(), "stage", "left").select("stage", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(qid, stage_before, stage_after, rank_before, rank_after)."""
    a = before.select("qid", F.col("stage").alias("stage_before"), F.col("first_rank").alias("rank_before"))
    return a.join(after.select("qid", F.col("stage").alias("stage_after"), F.col("first_rank").alias("rank_after")), "qid")


def transitions(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("stage_before", "stage_after").agg(F.count("*").alias("n"))


def net_impact(pairs: DataFrame) -> DataFrame:
    """One row of counts over the questions with a stage on both sides."""
    rows = pairs.filter("stage_before is not null and stage_after is not null")
    b, a = F.col("rank_before"), F.col("rank_after")
    better = a.isNotNull() & (b.isNull() | (a < b))
    worse = b.isNotNull() & (a.isNull() | (a > b))
    fixed, lost = F.count_if(F.col("stage_before").isin("RETRIEVAL_MISS", "RANKING_MISS") & (F.col("stage_after") == "SUCCESS")), F.count_if((F.col("stage_before") == "SUCCESS") & (F.col("stage_after") != "SUCCESS"))
    return rows.agg(fixed.alias("failures_fixed"), lost.alias("successes_lost"), (fixed - lost).alias("net_success_gain"), F.count_if(better).alias("rank_improved"), F.count_if(worse).alias("rank_worsened"), F.count_if(~F.coalesce(better, F.lit(False)) & ~F.coalesce(worse, F.lit(False))).alias("rank_unchanged"))


def lexical_effect(fts_rank: Column, bm25_rank: Column, vector_rank: Column, fts_final: Column, bm25_final: Column) -> Column:
    """Why a BM25 branch brought a question's gold further up than a full-text branch did."""
    improved = bm25_final.isNotNull() & (fts_final.isNull() | (bm25_final < fts_final))
    known = fts_rank.isNotNull() | vector_rank.isNotNull()
    return F.when(~improved | bm25_rank.isNull(), "UNCLEAR").when(known, "RRF_BOOST").otherwise("CANDIDATE_RECOVERY")


def single_branch_gold(first: DataFrame) -> DataFrame:
    """first(qid, bm25_rank, vector_rank): questions whose gold exactly one branch holds, with its kind."""
    kind = F.when(F.col("bm25_rank").isNull() & F.col("vector_rank").isNotNull(), "vector_only").when(F.col("bm25_rank").isNotNull() & F.col("vector_rank").isNull(), "bm25_only")
    return first.withColumn("kind", kind).filter("kind is not null")


def token_f1(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys..., f1) for pairs(keys..., predicted, gold): multiset overlap of the normalised tokens. An empty side: 0."""
    tokens = lambda c: F.filter(F.split(normalize_answer(F.col(c)), " "), lambda t: t != "")
    rows = pairs.select(*keys, tokens("predicted").alias("p"), tokens("gold").alias("g"))
    # the counts of one answer's tokens: both sides sorted and read off together within the row
    same = F.aggregate(F.array_distinct(F.array_intersect("p", "g")), F.lit(0), lambda acc, t: acc + F.least(F.size(F.filter("p", lambda x: x == t)), F.size(F.filter("g", lambda x: x == t))))
    rows = rows.select(*keys, F.size("p").alias("np"), F.size("g").alias("ng"), same.alias("same"))
    return rows.select(*keys, F.when(F.col("same") > 0, 2.0 * (F.col("same") / F.col("np")) * (F.col("same") / F.col("ng")) / (F.col("same") / F.col("np") + F.col("same") / F.col("ng"))).otherwise(0.0).alias("f1"))


def multi_hop_f1(pairs: DataFrame, key: str) -> DataFrame:
    """(key, f1): both sides split at commas; the mean over gold parts of the best predicted part."""
    parts = lambda c: F.when(F.size(F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), lambda x: x != "")) > 0, F.filter(F.transform(F.split(F.col(c), ","), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array(F.trim(F.col(c))))
    golds = pairs.select(key, F.posexplode(parts("gold")).alias("gi", "gold"), parts("predicted").alias("ps"))
    cells = golds.select(key, "gi", "gold", F.explode("ps").alias("predicted"))
    best = token_f1(cells, key, "gi").groupBy(key, "gi").agg(F.max("f1").alias("f1"))
    return best.groupBy(key).agg(F.avg("f1").alias("f1"))


def score_answers(pairs: DataFrame) -> DataFrame:
    """(qid, category, score, abstained_right) for pairs(qid, category, predicted, gold, abstained).

    1: multi-hop; 2, 4: F1; 3: F1 on the gold's first part before a semicolon; 5: whether the answer abstains.
    """
    f = token_f1(pairs.filter(F.col("category").isin(2, 3, 4)).withColumn("gold", F.when(F.col("category") == 3, F.trim(F.substring_index("gold", ";", 1))).otherwise(F.col("gold"))), "qid", "category")
    hop = multi_hop_f1(pairs.filter("category = 1"), "qid").withColumn("category", F.lit(1))
    five = pairs.filter("category = 5").select("qid", "category", (F.col("abstained") | is_abstention(F.col("predicted"))).alias("abstained_right"))
    scored = f.unionByName(hop.select("qid", "category", "f1")).select("qid", "category", F.col("f1").alias("score"), F.lit(None).cast("boolean").alias("abstained_right"))
    return scored.unionByName(five.select("qid", "category", F.col("abstained_right").cast("double").alias("score"), "abstained_right"))


# questions and stages ---------------------------------------------------------------------------------------------

FAILURES = ("RETRIEVAL_MISS", "RANKING_MISS")


def answer_summary(scored: DataFrame) -> DataFrame:
    """(n_f1, f1, n_abstention, abstention_accuracy) of score_answers(): categories 1 to 4 and 5 are never mixed; a mean of nothing is 0."""
    five = F.col("category") == 5
    mean = lambda some: F.round(F.coalesce(F.avg(F.when(some, F.col("score"))), F.lit(0.0)), 6)
    return scored.agg(F.count_if(~five).alias("n_f1"), mean(~five).alias("f1"), F.count_if(five).alias("n_abstention"), mean(five).alias("abstention_accuracy"))


def stage_counts_by(stages: DataFrame, category: str) -> DataFrame:
    """(category, stage, n) overall (category null) and by category, every stage of each, absent ones with 0."""
    names = stages.sparkSession.createDataFrame([(s,) for s in STAGES], "stage string")
    groups = stages.rollup(category).agg(F.count("*").alias("all")).select(category)
    found = stages.filter("stage is not null").cube(category, "stage").agg(F.count("*").alias("n"), F.grouping_id().alias("g")).filter("g in (0, 2)").drop("g")
    grid = groups.join(F.broadcast(names))
    return grid.join(found, grid[category].eqNullSafe(found[category]) & (grid["stage"] == found["stage"]), "left").select(grid[category], grid["stage"], F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def missed_outcomes(pairs: DataFrame) -> DataFrame:
    """(outcome, n) of the questions that were a retrieval miss before: fixed, improved, unchanged or other; absent ones with 0."""
    after = F.col("stage_after")
    name = F.when(after == "SUCCESS", "fixed").when(after == "RANKING_MISS", "improved").when(after == "RETRIEVAL_MISS", "unchanged").otherwise("other")
    names = pairs.sparkSession.createDataFrame([(x,) for x in ("fixed", "improved", "unchanged", "other")], "outcome string")
    found = pairs.filter("stage_before = 'RETRIEVAL_MISS'").groupBy(name.alias("outcome")).agg(F.count("*").alias("n"))
    return names.join(found, "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).alias("n"))


def interesting(pairs: DataFrame) -> DataFrame:
    """(qid): missed before, or of another stage after."""
    return pairs.filter((F.col("stage_before") == "RETRIEVAL_MISS") | ~F.col("stage_before").eqNullSafe(F.col("stage_after"))).select("qid").distinct()


def reclassified(ranks: DataFrame, baseline: str, k: int = STAGE_K) -> DataFrame:
    """(variant, qid, class) of ranks(variant, qid, first_rank, stage) for the questions at which the baseline fails: success for the baseline itself, fixed,
    improved_not_fixed, worsened or still_failing."""
    old = ranks.filter((F.col("variant") == baseline) & F.col("stage").isin(*FAILURES)).select("qid", F.col("first_rank").alias("old_rank"))
    rows = ranks.select("variant", "qid", F.col("first_rank").alias("new_rank")).join(old, "qid")
    done = F.col("new_rank") <= k
    name = F.when(done, F.when(F.col("variant") == baseline, "success").otherwise("fixed")).when(F.col("new_rank") < F.col("old_rank"), "improved_not_fixed").when(F.col("new_rank") > F.col("old_rank"), "worsened").otherwise("still_failing")
    return rows.select("variant", "qid", name.alias("class"))


def reclassified_counts(ranks: DataFrame, baseline: str, k: int = STAGE_K) -> DataFrame:
    return reclassified(ranks, baseline, k).groupBy("variant", "class").agg(F.count("*").alias("n"))


def same_everywhere(stages: DataFrame, stage_name: str = "NO_GOLD_MEMORY") -> DataFrame:
    """(n_variants, least, most, same) of the questions of a stage over the variants of stages(variant, qid, stage); a comparison is only fair if they are the same."""
    by = stages.groupBy("variant").agg(F.count_if(F.coalesce(F.col("stage") == stage_name, F.lit(False))).alias("n"))
    return by.agg(F.count("*").alias("n_variants"), F.min("n").alias("least"), F.max("n").alias("most"), (F.min("n") == F.max("n")).alias("same"))


def variant_order(summaries: DataFrame) -> DataFrame:
    """summaries(variant, recall_5, hit_5, mrr, net_gain, ranking_misses) with place: the order in which variants are preferred; single branches take no part."""
    rows = summaries.filter(~F.col("variant").isin("bm25_only", "vector_only"))
    # one row for each variant
    w = Window.partitionBy(F.lit(1)).orderBy(F.col("recall_5").desc(), F.col("hit_5").desc(), F.col("mrr").desc(), (F.col("net_gain") > 0).desc(), "ranking_misses", "variant")
    return rows.withColumn("place", F.row_number().over(w).cast("long"))


def branch_ranks(candidates: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, branch, rank): the first rank of a gold memory of gold(qid, id) in each branch of candidates(qid, branch, rank, id)."""
    return candidates.join(gold.distinct(), ["qid", "id"]).groupBy("qid", "branch").agg(F.min("rank").alias("rank"))


def single_branch_behaviour(cases: DataFrame, before: DataFrame, after: DataFrame, k: int = STAGE_K) -> DataFrame:
    """(kind, n, within_before, within_after, lost, improved) of cases(qid, kind) by the first ranks of before(qid, first_rank) and after(qid, first_rank)."""
    b, a = before.select("qid", F.col("first_rank").alias("b")), after.select("qid", F.col("first_rank").alias("a"))
    good = lambda c: F.coalesce(F.col(c) <= k, F.lit(False))
    better = F.coalesce(F.col("a").isNotNull() & (F.col("b").isNull() | (F.col("a") < F.col("b"))), F.lit(False))
    rows = cases.select("qid", "kind").join(b, "qid", "left").join(a, "qid", "left")
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.count_if(good("b")).alias("within_before"), F.count_if(good("a")).alias("within_after"), F.count_if(good("b") & ~good("a")).alias("lost"), F.count_if(better).alias("improved"))


def compare_summaries(before: DataFrame, after: DataFrame, category: str = "category") -> DataFrame:
    """(category, hit_5_delta, recall_5_delta, mrr_delta) of two results of summarize(), for the categories both have, in their order."""
    a, b = before.alias("a"), after.alias("b")
    delta = lambda c: F.round(F.col(f"b.{c}") - F.col(f"a.{c}"), 6).alias(f"{c}_delta")
    return a.join(b, F.col(f"a.{category}").eqNullSafe(F.col(f"b.{category}"))).select(F.col(f"a.{category}").alias(category), delta("hit_5"), delta("recall_5"), delta("mrr")).orderBy(F.col(category).asc_nulls_first())


def worked_examples(branches: DataFrame, gold: DataFrame, cases: DataFrame, n: int = 5) -> DataFrame:
    """(qid, kind, branch, rank, id, is_gold): what the branches(qid, branch, rank, id) gave for the first n of cases(qid, kind) of each kind."""
    first = cases.withColumn("i", F.row_number().over(Window.partitionBy("kind").orderBy("qid"))).filter(F.col("i") <= n).select("qid", "kind")
    mark = gold.distinct().withColumn("is_gold", F.lit(True))
    return branches.join(small(first), "qid").join(mark, ["qid", "id"], "left").select("qid", "kind", "branch", "rank", "id", F.coalesce("is_gold", F.lit(False)).alias("is_gold"))


# intents ----------------------------------------------------------------------------------------------------------

def activation(rows: DataFrame) -> DataFrame:
    """One row of counts over rows(qid, attempted, ok, predicate, value, temporal_scope, n_structured, structured_right)."""
    scope = lambda x: F.count_if(F.col("temporal_scope") == x)
    active = F.count_if(F.col("n_structured") >= 1)
    return rows.agg(
        F.count("*").alias("n_questions"), F.count_if("attempted").alias("attempted"), F.count_if("ok").alias("ok"), F.count_if(F.col("attempted") & ~F.col("ok")).alias("fallbacks"),
        F.count_if(F.coalesce(F.col("predicate") != "", F.lit(False))).alias("with_predicate"), F.count_if(F.coalesce(F.col("value") != "", F.lit(False))).alias("with_value"),
        *[scope(x).alias(f"scope_{x}") for x in ("current", "historical", "any")], active.alias("active"), F.count_if("structured_right").alias("structured_right"),
        F.round(F.coalesce(active / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 6).alias("activation_rate"),
    )


# cases with required terms ----------------------------------------------------------------------------------------

def term_matches(hits: DataFrame, expected: DataFrame) -> DataFrame:
    """(case_id, n, rank) for each expected(case_id, n, terms) that some of hits(case_id, rank, text) matches: every term is part of the text, case and white space
    aside; rank is the first such hit's."""
    texts = hits.select("case_id", "rank", gold_text(F.col("text")).alias("t"))
    terms = expected.select("case_id", "n", F.posexplode("terms").alias("i", "term")).select("case_id", "n", gold_text(F.col("term")).alias("term"))
    wanted = terms.groupBy("case_id", "n").agg(F.collect_list("term").alias("terms"))
    both = texts.join(wanted, "case_id").filter(F.forall("terms", lambda x: F.contains(F.col("t"), x)))
    return both.groupBy("case_id", "n").agg(F.min("rank").alias("rank"))


def case_metrics(cases: DataFrame, hits: DataFrame, expected: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """(case_id, first_rank, hit_k..., recall_k..., reciprocal, isolation_failures, superseded_returned) of cases(case_id, user_id) from hits(case_id, rank, text, owner,
    is_active): hits that are another user's, or no longer in force, are counted."""
    found = term_matches(hits, expected)
    by = found.groupBy("case_id").agg(F.min("rank").alias("first_rank"), *[F.count_if(F.col("rank") <= k).alias(f"found_{k}") for k in cutoffs])
    n = expected.groupBy("case_id").agg(F.count("*").alias("n"))
    wrong = hits.join(cases, "case_id").groupBy("case_id").agg(F.count_if(~F.col("owner").eqNullSafe(F.col("user_id"))).alias("isolation_failures"), F.count_if(~F.col("is_active")).alias("superseded_returned"))
    out = cases.select("case_id").join(n, "case_id", "left").join(by, "case_id", "left").join(wrong, "case_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    hit = [F.coalesce(F.col("first_rank") <= k, F.lit(False)).cast("double").alias(f"hit_{k}") for k in cutoffs]
    recall = [F.coalesce(F.col(f"found_{k}") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0)).alias(f"recall_{k}") for k in cutoffs]
    return out.select("case_id", F.col("first_rank").cast("long").alias("first_rank"), *hit, *recall, F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal"), zero(F.col("isolation_failures")).alias("isolation_failures"), zero(F.col("superseded_returned")).alias("superseded_returned"))


def case_summary(metrics: DataFrame, cutoffs: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """Means over the cases, 0 of none, and the sums of what must not happen."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return metrics.agg(F.count("*").alias("cases"), *[mean(f"{m}_{k}").alias(f"{m}_{k}") for m in ("hit", "recall") for k in cutoffs], mean("reciprocal").alias("mrr"), total("isolation_failures"), total("superseded_returned"))


# recovery ---------------------------------------------------------------------------------------------------------

def session_slices(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, session, id): the session of each stored message, from the sessions' numbers of turns(conv_id, session, n_turns) summed up in order."""
    w = Window.partitionBy("conv_id").orderBy("session")
    ends = turns.withColumn("last", F.sum("n_turns").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("first", F.col("last") - F.col("n_turns") + 1)
    pos = messages.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at", "id"))).select("conv_id", "id", "pos")
    return pos.join(ends, "conv_id").filter(F.col("pos").between(F.col("first"), F.col("last"))).select("conv_id", "session", "id")


def unequal_counts(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """(conv_id, stored, expected) where the stored messages are not as many as the sessions say: nothing can be sliced or resumed there safely."""
    a = messages.groupBy("conv_id").agg(F.count("*").alias("stored"))
    b = turns.groupBy("conv_id").agg(F.sum("n_turns").alias("expected"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return a.join(b, "conv_id", "full").select("conv_id", zero("stored"), zero("expected")).filter("stored <> expected")


def covered(interactions: DataFrame, memories: DataFrame) -> DataFrame:
    """interactions(conv_id, interaction, ids) with done: some memory of memories(memory_id, sources) names all their messages.

    Found by counting the shared ids of each interaction and memory, so only pairs that share one meet.
    """
    flat = interactions.select("conv_id", "interaction", F.explode(F.array_distinct("ids")).alias("id"))
    src = memories.select("memory_id", F.explode(F.array_distinct("sources")).alias("id"))
    shared = flat.join(src, "id").groupBy("conv_id", "interaction", "memory_id").agg(F.count("*").alias("n")).groupBy("conv_id", "interaction").agg(F.max("n").alias("n"))
    return interactions.join(shared, ["conv_id", "interaction"], "left").withColumn("done", F.coalesce(F.col("n") == F.size(F.array_distinct("ids")), F.lit(False))).drop("n")


def cache_misses(requested: DataFrame, cached: DataFrame) -> DataFrame:
    """(text) once each of the requested texts that the cache lacks."""
    return requested.select("text").distinct().join(cached.select("text"), "text", "left_anti")


def gold_lookup(memories: DataFrame, dialogue: DataFrame) -> DataFrame:
    """(memory_id, dia_ids): the dialogue ids of dialogue(id, dia_id) that a memory of memories(memory_id, sources) comes from, sorted, once each."""
    flat = memories.select("memory_id", F.explode("sources").alias("id")).join(dialogue, "id")
    return flat.groupBy("memory_id").agg(F.array_sort(F.collect_set("dia_id")).alias("dia_ids"))


def dump(memories: DataFrame, dialogue: DataFrame) -> DataFrame:
    """All of memories(memory_id, sources, ...) with dia_ids, empty where none is known."""
    return memories.join(gold_lookup(memories, dialogue), "memory_id", "left").withColumn("dia_ids", F.coalesce("dia_ids", F.expr("cast(array() as array<string>)")))


def stable_ids(ids: Column) -> Column:
    """Ids as text, once each, in the order first seen."""
    return F.array_distinct(F.transform(ids, lambda x: x.cast("string")))


def report(summary: DataFrame, **settings: object) -> DataFrame:
    """summary with the run's settings as columns, so that a stored result says what it is of."""
    return summary.withColumns({n: F.lit(v) for n, v in sorted(settings.items())})


def fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """(n, checksum): rows, and a hash of the sums of the eight parts of their SHA-256; the same in any order of the rows, another if one of them changes."""
    one = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x1e")) for c in columns]), 256)
    parts = [F.sum(F.conv(F.substring(one, 8 * i + 1, 8), 16, 10).cast("long")) for i in range(8)]
    total = F.concat_ws(":", *[F.coalesce(p, F.lit(0)).cast("string") for p in parts])
    return rows.agg(F.count("*").alias("n"), F.sha2(total, 256).alias("checksum"))


def unchanged(before: DataFrame, after: DataFrame) -> None:
    """Stops a comparison that was to read only, if the fingerprint of its state is another than before."""
    if before.collect() != after.collect():
        raise ConflictError("the state has changed during a run that only reads")
