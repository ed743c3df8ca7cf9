"""Lexical branches: BM25, full-text match with phrases, alternatives and exclusions, literal fall-back."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import like_literal, tokenize
from ..shipping import ship
from ..storage import scratch, small
from . import asked

K1, B = 1.5, 0.75


@dataclass(frozen=True)
class Index:
    """A corpus docs(scope, id, text) with its tokens written once, so that no query tokenises it again."""

    docs: DataFrame
    rows: DataFrame


def prepare(docs: DataFrame | Index, path: str | None = None) -> Index:
    """The index of a corpus, written to path or to a new place; one that is prepared already stays."""
    if isinstance(docs, Index):
        return docs
    path = path or scratch(docs.sparkSession, "tokens")
    _tokens(docs).write.mode("overwrite").parquet(path)
    return Index(docs, docs.sparkSession.read.parquet(path))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("scope", "id", tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))


def _rows(docs: DataFrame | Index) -> DataFrame:
    return docs.rows if isinstance(docs, Index) else _tokens(docs)


def _plain(docs: DataFrame | Index) -> DataFrame:
    return docs.rows if isinstance(docs, Index) else docs.select("scope", "id", "text")


def _once(docs: DataFrame | Index) -> bool:
    """Whether no two rows share scope and id: a task then sees all of a document. Rows that share them are added up by joins."""
    return not _plain(docs).groupBy("scope", "id").count().filter("count > 1").limit(1).count()


def corpus_stats(docs: DataFrame | Index) -> DataFrame:
    """(scope, n_docs, avgdl) of docs(scope, id, text): n counts all, the average only texts with tokens."""
    n = F.size("tokens")
    return _rows(docs).select("scope", n.alias("len")).groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg(F.when(F.col("len") > 0, F.col("len"))).alias("avgdl"))


def _flat(docs: DataFrame | Index) -> DataFrame:
    return _rows(docs).select("scope", "id", F.size("tokens").cast("long").alias("len"), F.explode("tokens").alias("term"))


def postings(docs: DataFrame | Index) -> DataFrame:
    """(scope, id, term, tf, len); counted before the shuffle, so frequent terms are no hot keys."""
    return _flat(docs).groupBy("scope", "id", "len", "term").agg(F.count("*").alias("tf"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("scope", "term").agg(F.count("*").alias("df"))


def _asked_frequency(docs: Index, terms: DataFrame) -> DataFrame:
    """(scope, term, df) of the terms(scope, term), counted from each row's distinct tokens before the shuffle."""
    return _rows(docs).select("scope", F.explode(F.array_distinct("tokens")).alias("term")).join(terms, ["scope", "term"], "left_semi").groupBy("scope", "term").agg(F.count("*").alias("df"))


def query_postings(queries: DataFrame) -> DataFrame:
    """(scope, qid, term): distinct terms of each of queries(scope, qid, text)."""
    return queries.select("scope", "qid", F.explode(F.array_distinct(tokenize(F.col("text")))).alias("term"))


def _by_document(docs: DataFrame | Index, terms: DataFrame) -> DataFrame:
    """postings of the terms(scope, term) alone, dealt by document, so that what is added up by document needs no second shuffle."""
    return _flat(docs).join(terms, ["scope", "term"], "left_semi").repartition("scope", "id").groupBy("scope", "id", "len", "term").agg(F.count("*").alias("tf"))


def bm25_scores(docs: DataFrame | Index, queries: DataFrame, *, k1: float = K1, b: float = B) -> DataFrame:
    """(scope, qid, id, score) for documents that share a term with a query of their scope: every score, by joins.

    Only postings of terms some query asks for are kept and scored; statistics are of the whole corpus given. The asked terms, with
    their weights, meet the postings by broadcast where they are few, so a frequent term is no hot key.
    """
    index, wanted = prepare(docs), query_postings(queries).distinct()
    terms = small(wanted.select("scope", "term").distinct())
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = _asked_frequency(index, terms).join(F.broadcast(corpus_stats(index)), "scope").select("scope", "term", idf.alias("idf"), "avgdl")
    weights = small(wanted.join(weights, ["scope", "term"]))
    gain = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avgdl")))
    return _by_document(index, terms).join(weights, ["scope", "term"]).groupBy("scope", "id", "qid").agg(F.round(F.sum(F.col("idf") * gain), 6).alias("score")).select("scope", "qid", "id", "score")


def top(scored: DataFrame, k: int, *order: object, by: tuple[str, ...] = ("scope", "qid")) -> DataFrame:
    """The first k rows of each group in the given order, with their rank; the engine cuts groups before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank").cast("long"))


def bm25_topk(docs: DataFrame | Index, queries: DataFrame, k: int, **options: float) -> DataFrame:
    """(scope, qid, rank, id, score), ties to the smaller id.

    Where not too much is asked, documents are scored where they are read and each task keeps its k best; else all scores are formed by joins.
    """
    scored = asked.bm25(_plain(docs), query_postings(queries), k, options.get("k1", K1), options.get("b", B)) if _once(docs) else None
    if scored is None:
        scored = bm25_scores(docs, queries, **options)
    return top(scored, k, F.col("score").desc(), "id").select("scope", "qid", "rank", "id", "score")


_ITEM = re.compile(r'(-?)"([^"]*)"|(\S+)')
_TERM = re.compile(r"[a-z0-9]+")


def parse_web(text: str | None) -> list[list[tuple[bool, list[str]]]]:
    """The alternatives of a query; each is a list of (excluded, terms in a row) of which all must hold.

    Terms side by side must all occur, "quoted" ones in a row, or separates alternatives, a minus excludes what follows it.
    A word that punctuation divides is a row of its parts.
    """
    out: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, quoted, word in _ITEM.findall(text or ""):
        if word.lower() == "or":
            out.append([])
            continue
        excluded = minus == "-" or (word[:1] == "-" and len(word) > 1)
        terms = _TERM.findall((quoted or word).lower().replace("ß", "ss"))
        if terms:
            out[-1].append((excluded, terms))
    return [x for x in out if x]


_PARSED = "array<array<struct<excluded: boolean, terms: array<string>>>>"


def web_items(queries: DataFrame) -> DataFrame:
    """(scope, qid, alt, item, excluded, terms): the items of each alternative of each of queries(scope, qid, text)."""
    ship(queries)

    @F.pandas_udf(_PARSED)
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [[{"excluded": e, "terms": w} for e, w in alt] for alt in parse_web(t)])

    alts = queries.select("scope", "qid", F.posexplode(parsed(F.col("text"))).alias("alt", "items"))
    return alts.select("scope", "qid", "alt", F.posexplode("items").alias("item", "x")).select("scope", "qid", "alt", "item", "x.excluded", "x.terms")


def plain_items(queries: DataFrame) -> DataFrame:
    """Items of queries without any syntax: every distinct term must occur."""
    return query_postings(queries).select("scope", "qid", F.lit(0).alias("alt"), F.xxhash64("term").alias("item"), F.lit(False).alias("excluded"), F.array("term").alias("terms"))


def item_match(docs: DataFrame | Index, items: DataFrame) -> DataFrame:
    """(scope, qid, id, total): documents for which some alternative of a query holds; total counts the occurrences of its items, of the best alternative.

    Rows of terms are found by the place their first term would have. An alternative of nothing but exclusions holds for every other
    document of the scope, with total 0. Cover density has no counterpart here; the order by total, then recency, stands in for it.
    """
    found = asked.matches(_plain(docs), items) if _once(docs) else None
    if found is not None:
        return found
    index = prepare(docs)
    key = ["scope", "qid", "alt"]
    single = items.filter(F.size("terms") == 1).select(*key, "item", "excluded", F.col("terms")[0].alias("term"))
    single = small(single)
    hits = _by_document(index, small(single.select("scope", "term").distinct())).join(single, ["scope", "term"]).select(*key, "item", "excluded", "id", "tf")
    rows = items.filter(F.size("terms") > 1)
    if rows.limit(1).count():
        slots = small(rows.select(*key, "item", "excluded", F.size("terms").alias("n"), F.posexplode("terms").alias("slot", "term")))
        at = _rows(index).select("scope", "id", F.posexplode("tokens").alias("pos", "term")).join(slots, ["scope", "term"])
        runs = at.withColumn("begin", F.col("pos") - F.col("slot")).groupBy(*key, "item", "excluded", "id", "begin", "n").agg(F.count("*").alias("got")).filter("got = n")
        hits = hits.unionByName(runs.groupBy(*key, "item", "excluded", "id").agg(F.count("*").alias("tf")))
    # rows of one document count once for an item
    hits = hits.groupBy(*key, "item", "excluded", "id").agg(F.sum("tf").alias("tf"))
    need = items.groupBy(*key).agg(F.count_if(~F.col("excluded")).alias("need"))
    need = small(need)
    by = hits.groupBy("scope", "id", "qid", "alt").agg(F.count_if(~F.col("excluded")).alias("got"), F.count_if("excluded").alias("bad"), F.coalesce(F.sum(F.when(~F.col("excluded"), F.col("tf"))), F.lit(0)).alias("total"))
    good = by.join(need, key).filter("got = need and need > 0 and bad = 0").select("scope", "qid", "id", "total")
    free = need.filter("need = 0")
    if free.limit(1).count():
        bad = by.filter("bad > 0").select(*key, "id")
        rest = index.rows.select("scope", "id").join(free, "scope").join(bad, [*key, "id"], "left_anti").select("scope", "qid", "id", F.lit(0).cast("long").alias("total"))
        good = good.unionByName(rest)
    return good.groupBy("scope", "id", "qid").agg(F.max("total").alias("total")).select("scope", "qid", "id", "total")


def and_match(docs: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(scope, qid, id, total): documents with every term of the query; total is the sum of term frequencies."""
    return item_match(docs, plain_items(queries))


def web_match(docs: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(scope, qid, id, total) with the syntax of parse_web."""
    return item_match(docs, web_items(queries))


def literal_match(docs: DataFrame | Index, queries: DataFrame) -> DataFrame:
    """(scope, qid, id): documents that hold the query literally, ignoring case.

    The inner tokens of a literal must be tokens of the text, its first one the end and its last one the beginning of one (a single
    token: a part of one). These are looked up among the distinct terms, then in the postings, and only documents that have them all are
    read in full. Literals without any token are compared with every document of their scope.
    """
    plain = docs.docs if isinstance(docs, Index) else docs
    t = queries.select("scope", "qid", F.col("text").alias("needle"), tokenize(F.coalesce("text", F.lit(""))).alias("tokens"))
    n = F.size("tokens")
    found = asked.literal_candidates(plain, t.filter(n > 0).select("scope", "qid", "tokens"))
    if found is not None:
        needles = small(t.select("scope", "qid", "needle", n.alias("n")))
        both = found.select("scope", "id", "text", F.explode("qids").alias("qid")).join(needles.filter("n > 0"), ["scope", "qid"])
        bare = needles.filter("n = 0")
        if bare.limit(1).count():
            both = both.select("scope", "qid", "id", "needle", "text").unionByName(plain.join(bare, "scope").select("scope", "qid", "id", "needle", "text"))
        return both.filter(like_literal(F.col("text"), F.col("needle"))).select("scope", "qid", "id")
    index = prepare(docs)

    def slot(kind: str, term: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), term.alias("term"))

    inner = F.transform(F.array_distinct(F.slice("tokens", F.lit(2), F.greatest(n - 2, F.lit(0)))), lambda x: slot("is", x))
    ends = F.when(n == 1, F.array(slot("in", F.col("tokens")[0]))).when(n == 2, F.array(slot("ends", F.col("tokens")[0]), slot("starts", F.element_at("tokens", -1))))
    slots = t.filter(n > 0).select("scope", "qid", F.posexplode(F.coalesce(ends, inner)).alias("slot", "x")).select("scope", "qid", "slot", "x.kind", F.col("x.term").alias("part"))
    exact = slots.filter("kind = 'is'").select("scope", "qid", "slot", F.col("part").alias("term"))
    parts = slots.filter("kind <> 'is'")
    if parts.limit(1).count():
        fits = F.when(F.col("kind") == "in", F.contains("term", "part")).when(F.col("kind") == "ends", F.endswith("term", "part")).otherwise(F.startswith("term", "part"))
        terms = index.rows.select("scope", F.explode("tokens").alias("term")).distinct()
        exact = exact.unionByName(terms.join(small(parts), "scope").filter(fits).select("scope", "qid", "slot", "term"))
    need = small(slots.groupBy("scope", "qid").agg(F.count("*").alias("need")))
    exact = small(exact)
    got = _by_document(index, small(exact.select("scope", "term").distinct())).join(exact, ["scope", "term"]).groupBy("scope", "id", "qid").agg(F.count_distinct("slot").alias("got"))
    near = got.join(need, ["scope", "qid"]).filter("got = need").select("scope", "qid", "id")
    texts = index.docs.select("scope", "id", "text")
    both = near.join(small(t.select("scope", "qid", "needle")), ["scope", "qid"]).join(texts, ["scope", "id"]).select("scope", "qid", "id", "needle", "text")
    bare = t.filter(n == 0)
    if bare.limit(1).count():
        both = both.unionByName(texts.join(small(bare.select("scope", "qid", "needle")), "scope").select("scope", "qid", "id", "needle", "text"))
    return both.filter(like_literal(F.col("text"), F.col("needle"))).select("scope", "qid", "id")


def fts_topk(docs: DataFrame | Index, queries: DataFrame, k: int, *, web: bool = True) -> DataFrame:
    """(scope, qid, rank, id): full-text matches by total, then recency (larger id); queries without one fall back to literal matches by recency."""
    path = scratch(queries.sparkSession, "matches")
    (web_match if web else and_match)(docs, queries).write.parquet(path)
    exact = queries.sparkSession.read.parquet(path)
    missed = queries.join(exact.select("scope", "qid").distinct(), ["scope", "qid"], "left_anti")
    both = exact.unionByName(literal_match(docs, missed).withColumn("total", F.lit(0).cast("long")))
    return top(both, k, F.col("total").desc(), F.col("id").desc()).select("scope", "qid", "rank", "id")
