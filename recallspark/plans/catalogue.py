"""One query for each operator over the driver's tables, with the same query in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import providers
from ..functions import identity, text
from ..operators import context, evaluation, fusion, indexes, lexical, lifecycle, scopes, structured, summaries, vector
from ..sources import tables
from ..storage import scratch, small, written
from ..streaming import ingest
from . import search

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# SQL parts --------------------------------------------------------------------------------------------------------

def _tok(x: str) -> str:
    return f"regexp_extract_all(replace(lower({x}), 'ß', 'ss'), '[a-z0-9]+')"


def _norm(x: str) -> str:
    return f"trim(regexp_replace(replace(lower({x}), 'ß', 'ss'), '\\s+', ' ', 'g'))"


_MEM = """mem AS (SELECT d.doc_id AS id, d.lang AS scope, d.text, d.n_chars::DOUBLE AS importance, coalesce(l.quality, 1) = 1 AS is_active,
  CASE WHEN coalesce(l.toxic, 0) = 1 THEN 'episodic' ELSE 'semantic' END AS memory_type, d.source AS conversation_id FROM documents d LEFT JOIN labels l USING (doc_id))"""
_ASK = "ask AS (SELECT s.scope, b.item_id AS qid, b.text FROM benchmark b, (SELECT DISTINCT lang AS scope FROM documents) s)"


def _bm25(docs: str, asks: str = "ask", name: str = "bm", k: int = 50, k1: float = 1.5, b: float = 0.75) -> str:
    """CTEs that end in name(scope, qid, id, score, rank)."""
    p = name
    return f"""{p}_tok AS (SELECT scope, id, {_tok("text")} AS toks FROM {docs}),
{p}_st AS (SELECT scope, count(*) AS n_docs, avg(len(toks)) FILTER (len(toks) > 0) AS avgdl FROM {p}_tok GROUP BY scope),
{p}_po AS (SELECT scope, id, dl, term, count(*) AS tf FROM (SELECT scope, id, len(toks) AS dl, unnest(toks) AS term FROM {p}_tok) GROUP BY ALL),
{p}_df AS (SELECT scope, term, count(*) AS df FROM {p}_po GROUP BY ALL),
{p}_q AS (SELECT DISTINCT scope, qid, term FROM (SELECT scope, qid, unnest({_tok("text")}) AS term FROM {asks})),
{p}_sc AS (SELECT q.scope, q.qid, p.id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / avgdl))), 6) AS score
  FROM {p}_q q JOIN {p}_po p USING (scope, term) JOIN {p}_df USING (scope, term) JOIN {p}_st USING (scope) GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, id) AS rank FROM {p}_sc) WHERE rank <= {k})"""


def _fts(docs: str, asks: str = "ask", name: str = "ft", k: int = 50) -> str:
    p = name
    return f"""{p}_po AS (SELECT scope, id, term, count(*) AS tf FROM (SELECT scope, id, unnest({_tok("text")}) AS term FROM {docs}) GROUP BY ALL),
{p}_q AS (SELECT scope, qid, list_distinct({_tok("text")}) AS terms, text FROM {asks}),
{p}_and AS (SELECT q.scope, q.qid, p.id, sum(tf) AS total FROM (SELECT scope, qid, len(terms) AS need, unnest(terms) AS term FROM {p}_q) q JOIN {p}_po p USING (scope, term) GROUP BY q.scope, q.qid, p.id, need HAVING count(*) = need),
{p}_lit AS (SELECT q.scope, q.qid, d.id, 0 AS total FROM {p}_q q JOIN {docs} d ON d.scope = q.scope AND contains(lower(d.text), lower(q.text)) WHERE NOT EXISTS (SELECT 1 FROM {p}_and a WHERE a.scope = q.scope AND a.qid = q.qid)),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scope, qid ORDER BY total DESC, id DESC) AS rank FROM (SELECT * FROM {p}_and UNION ALL SELECT * FROM {p}_lit)) WHERE rank <= {k})"""


_VEC = """vec AS (SELECT m.scope, m.id, m.is_active, m.memory_type, e.embedding::DOUBLE[] AS v FROM mem m JOIN embeddings e ON e.vec_id = m.id),
qv AS (SELECT s.scope, b.item_id AS qid, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id, (SELECT DISTINCT lang AS scope FROM documents) s),
near AS (SELECT * FROM (SELECT v.scope, q.qid, v.id, v.is_active, v.memory_type, round(list_dot_product(v.v, q.v), 6) AS score,
  row_number() OVER (PARTITION BY v.scope, q.qid ORDER BY round(list_dot_product(v.v, q.v), 6) DESC, v.id) AS pos FROM vec v JOIN qv q USING (scope)) WHERE pos <= 50),
vn AS (SELECT scope, qid, id, score, row_number() OVER (PARTITION BY scope, qid ORDER BY pos) AS rank FROM near WHERE is_active AND memory_type = 'semantic')"""
_PASS = "pass AS (SELECT * FROM mem WHERE is_active AND memory_type = 'semantic')"
_STR = """fixed AS (SELECT * FROM (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY id DESC) AS rank FROM pass) WHERE rank <= 50),
st AS (SELECT a.scope, a.qid, f.id, f.rank FROM ask a JOIN fixed f USING (scope))"""
_BRANCHES = "br AS (SELECT scope, qid, 'bm25' AS branch, rank, id FROM bm UNION ALL SELECT scope, qid, 'vector', rank, id FROM vn UNION ALL SELECT scope, qid, 'structured', rank, id FROM st)"
_HYBRID = f"{_MEM}, {_ASK}, {_PASS}, {_bm25('pass')}, {_VEC}, {_STR}, {_BRANCHES}"
_FINAL = """SELECT f.*, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, m.importance DESC, m.is_active DESC, m.id DESC) AS rank FROM {fused} f JOIN mem m ON m.id = f.id"""


def _fuse_sql(score: str) -> str:
    return f"""WITH {_HYBRID}, fu AS (SELECT scope, qid, id, round({score}, 12) AS score FROM br GROUP BY scope, qid, id),
fi AS ({_FINAL.format(by="f.scope, f.qid", fused="fu")}) SELECT scope, qid, rank, id, score FROM fi WHERE rank <= 10"""


_RR = "1.0 / (60 + rank)"
_DISCOUNTED = f"max({_RR}) + CASE WHEN count(*) > 1 THEN 0.1 * min({_RR}) ELSE 0 END"

_CAND = """cand AS (SELECT event_id, ts, user_id::VARCHAR AS user_id, CASE event_type WHEN 'view' THEN 'location' WHEN 'click' THEN 'location' WHEN 'signup' THEN 'timezone' WHEN 'purchase' THEN 'programming_language' END AS predicate,
  'v%20' || floor(value / 10)::BIGINT AS norm_value FROM events),
keyed AS (SELECT *, CASE WHEN predicate IN ('location', 'timezone') THEN 'user:' || user_id || ':' || predicate WHEN predicate IS NOT NULL AND norm_value IS NOT NULL THEN 'user:' || user_id || ':' || predicate || ':' || norm_value END AS fact_key FROM cand)"""
_ACT = f"""{_CAND}, act AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN 'ADD' WHEN norm_value IS NOT DISTINCT FROM lag(norm_value) OVER w THEN 'NOOP' ELSE 'SUPERSEDE' END AS action
  FROM keyed WHERE fact_key IS NOT NULL WINDOW w AS (PARTITION BY user_id, fact_key ORDER BY ts, event_id))"""
_FACTS = f"""{_ACT}, isl AS (SELECT *, sum(CASE WHEN action <> 'NOOP' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, fact_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM act),
ver AS (SELECT user_id, fact_key, island, arg_min(event_id, (ts, event_id)) AS memory_id, arg_min(norm_value, (ts, event_id)) AS norm_value, min(ts) AS valid_from, count(*) AS n_writes, max(ts) AS last_at FROM isl GROUP BY ALL),
scd AS (SELECT user_id, fact_key, island::BIGINT AS island, memory_id, norm_value, valid_from, lead(valid_from) OVER w AS valid_to, lead(memory_id) OVER w AS superseded_by, lead(memory_id) OVER w IS NULL AS is_active, n_writes, coalesce(lead(valid_from) OVER w, last_at) AS updated_at
  FROM ver WINDOW w AS (PARTITION BY user_id, fact_key ORDER BY island))"""
_MSG = "msg AS (SELECT conv_id, turn AS created_at, conv_id * 1000 + turn AS id, role, text AS content FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')"
_TARGET = f"{_MSG}, tgt AS (SELECT conv_id, max(created_at) AS target_at, arg_max(id, created_at) AS target_id, arg_max(content, created_at) AS target_text FROM msg GROUP BY conv_id), bef AS (SELECT m.*, target_id, target_text, row_number() OVER (PARTITION BY m.conv_id ORDER BY m.created_at DESC) AS back FROM msg m JOIN tgt t ON m.conv_id = t.conv_id AND m.created_at < t.target_at)"
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


# lexical ----------------------------------------------------------------------------------------------------------

def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.memories(spark, sf_dir).select("scope", "id", "text")


@query(f"SELECT doc_id, len({_tok('text')})::BIGINT AS n_tokens, len(list_distinct({_tok('text')}))::BIGINT AS n_distinct FROM documents")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT lang AS scope, count(*) AS n_docs, round(avg(n) FILTER (n > 0), 6) AS avgdl FROM (SELECT lang, len({_tok('text')}) AS n FROM documents) GROUP BY lang")
def bm25_corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.corpus_stats(_docs(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(f"SELECT scope, term, count(*) AS df FROM (SELECT lang AS scope, unnest(list_distinct({_tok('text')})) AS term FROM documents) GROUP BY ALL")
def bm25_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(_docs(spark, sf_dir)))


@query(f"WITH {_MEM}, {_ASK}, {_bm25('mem', k=10)} SELECT scope, qid, rank, id, score FROM bm")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.bm25_topk(_docs(spark, sf_dir), tables.search_queries(spark, sf_dir), 10)


@query(f"WITH {_MEM}, {_ASK}, {_PASS}, {_bm25('pass', k=10)} SELECT scope, qid, rank, id, score FROM bm")
def bm25_filtered_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = tables.memories(spark, sf_dir).filter(structured.condition(structured.Filters(memory_type="semantic")))
    return lexical.bm25_topk(kept.select("scope", "id", "text"), tables.search_queries(spark, sf_dir), 10)


@query(f"WITH {_MEM}, {_ASK}, {_fts('mem')} SELECT scope, qid, id, total::BIGINT AS total FROM ft_and")
def fts_and_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.and_match(_docs(spark, sf_dir), tables.search_queries(spark, sf_dir))


@query(f"WITH {_MEM}, {_ASK}, {_fts('mem', k=10)} SELECT scope, qid, rank, id FROM ft")
def fts_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.fts_topk(_docs(spark, sf_dir), tables.search_queries(spark, sf_dir), 10, web=False)


@query(f"WITH {_MEM}, {_ASK} SELECT a.scope, a.qid, m.id FROM ask a JOIN mem m ON a.scope = m.scope AND contains(lower(m.text), lower(a.text))")
def literal_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.literal_match(_docs(spark, sf_dir), tables.search_queries(spark, sf_dir))


# vectors ----------------------------------------------------------------------------------------------------------

def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = tables.table(spark, sf_dir, "embeddings").filter(vector.valid(F.col("embedding"))).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = tables.memories(spark, sf_dir).select("scope", "id").join(e, F.col("id") == F.col("vec_id")).select("scope", "id", "v")
    q = tables.search_queries(spark, sf_dir).select("scope", "qid").join(e, F.col("qid") == F.col("vec_id")).select("scope", "qid", "v")
    return v, q


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def normalize_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").filter(vector.valid(F.col("embedding")))
    return e.select("vec_id", F.round(vector.norm(F.col("embedding")), 6).alias("norm"), F.round(vector.normalize(F.col("embedding"))[0], 6).alias("first"))


@query("""WITH e AS (SELECT label::VARCHAR AS scope, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.scope, q.vec_id AS qid, a.vec_id AS id, round(list_dot_product(a.v, q.v), 6) AS score FROM e a JOIN e q ON a.scope = q.scope)
SELECT * FROM (SELECT scope, qid, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, id) AS rank, id, score FROM s) WHERE rank <= 10""")
def vector_topk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").filter(vector.valid(F.col("embedding"))).select(F.col("label").cast("string").alias("scope"), "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return vector.topk(e.select("scope", F.col("vec_id").alias("id"), "v"), e.select("scope", F.col("vec_id").alias("qid"), "v"), 10)


@query(f"WITH {_MEM}, {_VEC} SELECT scope, qid, rank, id, score FROM vn")
def vector_postfilter_oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return vector.oversampled(v, q, tables.memories(spark, sf_dir).filter("is_active and memory_type = 'semantic'"), 10)


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 OR embedding IS NULL THEN 1 ELSE 0 END AS stale FROM embeddings")
def embedding_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "embeddings").withColumn("model", F.when(F.col("vec_id") % 3 != 0, "current"))
    return e.select("vec_id", vector.needs_embedding(F.col("model"), F.col("embedding"), "current").cast("int").alias("stale"))


# structured -------------------------------------------------------------------------------------------------------

@query(f"WITH {_MEM} SELECT * FROM (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY id DESC) AS rank, id FROM mem WHERE is_active AND memory_type = 'semantic') WHERE rank <= 20")
def structured_filter_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structured.explicit(tables.memories(spark, sf_dir), structured.Filters(memory_type="semantic"), 20).select("scope", "rank", "id")


def _fact_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = lifecycle.facts(_writes(spark, sf_dir))
    predicate = F.element_at(F.split("fact_key", ":"), 3)
    return v.select(F.col("user_id").alias("scope"), F.col("memory_id").alias("id"), "is_active", F.col("valid_from").alias("created_at"), F.coalesce("valid_to", "valid_from").alias("updated_at"), predicate.alias("predicate"), F.lit("user").alias("subject_type"), F.lit("semantic").alias("memory_type"), "fact_key", F.regexp_replace("norm_value", "%20", " ").alias("value"))


_INTENTS = (("current_city", None, "current"), ("location", None, "historical"), ("programming language", " V 3 ", "any"), ("nonsense", None, "any"))


@query(f"""WITH {_FACTS}, fm AS (SELECT user_id AS scope, memory_id AS id, is_active, valid_from AS created_at, coalesce(valid_to, valid_from) AS updated_at, split_part(fact_key, ':', 3) AS predicate, norm_value FROM scd),
i(qid, known, want, temporal) AS (VALUES (0, 'location', NULL, 'current'), (1, 'location', NULL, 'historical'), (2, 'programming_language', 'v%203', 'any')),
r AS (SELECT fm.scope, i.qid, fm.id, row_number() OVER (PARTITION BY fm.scope, i.qid ORDER BY is_active DESC, updated_at DESC, created_at DESC, id DESC) AS rank
  FROM fm JOIN i ON fm.predicate = i.known AND (i.want IS NULL OR i.want = fm.norm_value) AND (temporal = 'any' OR (temporal = 'current') = is_active))
SELECT scope, qid::BIGINT AS qid, rank, id FROM r WHERE rank <= 10""")
def intent_structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _fact_memories(spark, sf_dir)
    asked = spark.createDataFrame([(i, *x) for i, x in enumerate(_INTENTS)], "qid long, predicate string, value string, temporal_scope string")
    intents = facts.select("scope").distinct().join(F.broadcast(asked))
    return structured.by_intent(facts, intents, structured.Filters(), 10).select("scope", "qid", "rank", "id")


@query(f"""WITH {_FACTS}, fm AS (SELECT user_id AS scope, memory_id AS id, is_active, valid_from AS created_at, coalesce(valid_to, valid_from) AS updated_at, split_part(fact_key, ':', 3) AS predicate FROM scd),
a AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY updated_at DESC, created_at DESC, id DESC) AS pos FROM fm WHERE NOT is_active AND predicate = 'location'),
b AS (SELECT scope, id, row_number() OVER (PARTITION BY scope ORDER BY is_active DESC, updated_at DESC, created_at DESC, id DESC) AS pos FROM fm),
u AS (SELECT *, 1 AS list_no FROM a WHERE pos <= 10 UNION ALL SELECT *, 2 FROM b WHERE pos <= 10),
f AS (SELECT scope, id, min((list_no, pos)) AS p FROM u GROUP BY ALL)
SELECT * FROM (SELECT scope, 0::BIGINT AS qid, row_number() OVER (PARTITION BY scope ORDER BY p) AS rank, id FROM f) WHERE rank <= 10""")
def structured_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _fact_memories(spark, sf_dir)
    intents = facts.select("scope").distinct().withColumns({"qid": F.lit(0).cast("long"), "predicate": F.lit("lives_in"), "value": F.lit(None).cast("string"), "temporal_scope": F.lit("historical")})
    first = structured.by_intent(facts, intents, structured.Filters(), 10).select("scope", "qid", F.lit(1).alias("list_no"), F.col("rank").alias("pos"), "id")
    second = structured.explicit(facts, structured.Filters(subject_type="user", include_history=True), 10).select("scope", F.lit(0).cast("long").alias("qid"), F.lit(2).alias("list_no"), F.col("rank").alias("pos"), "id")
    return fusion.merge_distinct(first.unionByName(second), 10)


# search -----------------------------------------------------------------------------------------------------------

_FILTERS = structured.Filters(memory_type="semantic")


def _hybrid(spark: SparkSession, sf_dir: str, **options: object) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return search.hybrid_search(tables.memories(spark, sf_dir), tables.search_queries(spark, sf_dir), v, q, filters=_FILTERS, **options)  # type: ignore[arg-type]


@query(_fuse_sql(_DISCOUNTED))
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir)


@query(_fuse_sql(f"sum({_RR})"))
def fusion_equal_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, strategy="rrf")


@query(_fuse_sql(f"sum(CASE branch WHEN 'bm25' THEN 0.5 WHEN 'structured' THEN 0.25 ELSE 1.0 END * {_RR})"))
def fusion_weighted_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, strategy="weighted_rrf", weights={"bm25": 0.5, "structured": 0.25})


def _branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = _vectors(spark, sf_dir)
    return search.branches(tables.memories(spark, sf_dir), tables.search_queries(spark, sf_dir), v, q, limit=10, filters=_FILTERS)


_WIDE = f"wide AS (SELECT scope, qid, id, max({_RR}) FILTER (branch = 'bm25') AS b, max({_RR}) FILTER (branch = 'vector') AS v, max({_RR}) FILTER (branch = 'structured') AS s FROM br GROUP BY scope, qid, id)"


def _variant_sql(strategy: str, x: float | None) -> str:
    zero = "coalesce(v, 0) + coalesce(s, 0)"
    second = "CASE WHEN (b IS NOT NULL)::INT + (v IS NOT NULL)::INT + (s IS NOT NULL)::INT > 1 THEN least(b, v, s) ELSE 0 END"
    return {"bm25": "b", "vector": "v", "rrf": f"coalesce(b, 0) + {zero}", "weighted_rrf": f"{x} * coalesce(b, 0) + {zero}", "discounted_agreement": f"greatest(b, v, s) + {x} * {second}"}[strategy]


_VARIANTS = " UNION ALL ".join(f"SELECT '{label}' AS variant, scope, qid, id, round({_variant_sql(s, x)}, 12) AS score FROM wide" for label, s, x in search.VARIANTS)
_ALL_VARIANTS = f"{_HYBRID}, {_WIDE}, va AS (SELECT * FROM ({_VARIANTS}) WHERE score IS NOT NULL), vf AS ({_FINAL.format(by='f.variant, f.scope, f.qid', fused='va')})"


@query(f"WITH {_ALL_VARIANTS} SELECT variant, scope, qid, rank, id, score FROM vf WHERE rank <= 10")
def fusion_variants_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.all_variants(_branches(spark, sf_dir), tables.memories(spark, sf_dir), 10)


# facts ------------------------------------------------------------------------------------------------------------

def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.candidates(spark, sf_dir)
    key = identity.fact_key(F.col("memory_type"), F.col("subject_type"), F.col("user_id"), F.col("predicate"), F.col("value"))
    return c.withColumn("fact_key", key).withColumn("norm_value", identity.value_identity(F.col("value")))


def _writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).filter("fact_key is not null")


@query(f"WITH {_CAND} SELECT event_id AS memory_id, fact_key, norm_value FROM keyed")
def fact_key_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).select("memory_id", "fact_key", "norm_value")


@query(f"WITH {_ACT} SELECT event_id AS memory_id, user_id, fact_key, action FROM act")
def write_lifecycle_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.actions(_writes(spark, sf_dir)).select("memory_id", "user_id", "fact_key", "action")


@query(f"WITH {_FACTS} SELECT * FROM scd")
def memory_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.facts(_writes(spark, sf_dir))


@query(f"WITH {_FACTS} SELECT user_id, fact_key, memory_id, norm_value FROM scd WHERE is_active")
def active_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.active(lifecycle.facts(_writes(spark, sf_dir))).select("user_id", "fact_key", "memory_id", "norm_value")


@query(f"WITH {_FACTS} SELECT user_id, fact_key, memory_id, norm_value FROM scd WHERE valid_from <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) AND (valid_to IS NULL OR valid_to > (SELECT max(ts) - INTERVAL 1 DAY FROM events))")
def asof_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = tables.table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("interval 1 day")).alias("t")).first()["t"]
    return lifecycle.as_of(lifecycle.facts(_writes(spark, sf_dir)), at).select("user_id", "fact_key", "memory_id", "norm_value")


@query(f"WITH {_ACT} SELECT user_id, fact_key, count(*) FILTER (action = 'ADD') AS n_add, count(*) FILTER (action = 'NOOP') AS n_noop, count(*) FILTER (action = 'SUPERSEDE') AS n_supersede FROM act WHERE predicate = 'programming_language' GROUP BY ALL")
def multi_value_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lifecycle.actions(_writes(spark, sf_dir).filter(~identity.is_single(identity.resolve_predicate(F.col("predicate")))))
    return rows.groupBy("user_id", "fact_key").agg(*[F.count_if(F.col("action") == a).alias(f"n_{a.lower()}") for a in ("ADD", "NOOP", "SUPERSEDE")])


@query(f"""WITH {_ACT}, isl AS (SELECT *, sum(CASE WHEN action <> 'NOOP' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, fact_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM act),
s AS (SELECT user_id, fact_key, island, source, min((ts, event_id, pos)) AS f FROM (SELECT *, 'm' || event_id % 7 AS source, 0 AS pos FROM isl UNION ALL SELECT *, 'm' || event_id % 3, 1 FROM isl) GROUP BY ALL)
SELECT user_id, fact_key, island::BIGINT AS island, string_agg(source, ',' ORDER BY f) AS sources FROM s GROUP BY user_id, fact_key, island""")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.provenance(_writes(spark, sf_dir)).withColumn("sources", F.array_join("sources", ","))


@query(f"WITH n AS (SELECT lang AS user_id, doc_id AS id, {_norm('text')} AS t FROM documents) SELECT user_id, id, min(id) OVER (PARTITION BY user_id, t) AS kept_id, CASE WHEN id = min(id) OVER (PARTITION BY user_id, t) THEN 'ADD' ELSE 'NOOP' END AS action FROM n")
def open_semantic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("user_id"), F.col("doc_id").alias("id"), "text")
    return lifecycle.open_dedup(rows).select("user_id", "id", "kept_id", "action")


@query(f"""WITH n AS (SELECT lang AS user_id, doc_id AS id, {_norm('text')} AS t, list_sort(list_distinct([source, lang, source])) AS s FROM documents)
SELECT user_id, id, min(id) OVER (PARTITION BY user_id, t, s) AS kept_id, CASE WHEN id = min(id) OVER (PARTITION BY user_id, t, s) THEN 'ADD' ELSE 'NOOP' END AS action FROM n""")
def episodic_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("user_id"), F.col("doc_id").alias("id"), "text", F.array("source", "lang", "source").alias("sources"))
    return lifecycle.episodic_dedup(rows).select("user_id", "id", "kept_id", "action")


@query(f"WITH {_FACTS}, v AS (SELECT user_id, fact_key, count(*) AS n FROM scd WHERE is_active GROUP BY ALL) SELECT count(*) AS n_keys, count(*) FILTER (n > 1) AS n_violations FROM v")
def active_uniqueness_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = lifecycle.facts(_writes(spark, sf_dir))
    bad = lifecycle.violations(versions).agg(F.count("*").alias("n_violations"))
    return lifecycle.active(versions).agg(F.count_distinct("user_id", "fact_key").alias("n_keys")).join(F.broadcast(bad))


@query(f"WITH {_ACT} SELECT action, count(*) AS n FROM act GROUP BY action")
def write_action_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.actions(_writes(spark, sf_dir)).groupBy("action").agg(F.count("*").alias("n"))


@query(f"WITH {_CAND} SELECT count(*) AS n_rows, count(*) FILTER (predicate IS NULL) AS n_open, count(*) FILTER (fact_key IS NOT NULL) AS n_keyed, count(*) FILTER (norm_value IS NULL) AS n_no_value, count(DISTINCT predicate) AS n_predicates FROM keyed")
def memory_sanity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = identity.resolve_predicate(F.col("predicate"))
    return _keyed(spark, sf_dir).agg(F.count("*").alias("n_rows"), F.count_if(known.isNull()).alias("n_open"), F.count("fact_key").alias("n_keyed"), F.count_if(F.col("norm_value").isNull()).alias("n_no_value"), F.count_distinct(known).alias("n_predicates"))


_SUMS = " || ':' || ".join(f"coalesce(sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT), 0)::BIGINT::VARCHAR" for i in range(8))


@query(f"SELECT count(*) AS n, sha256({_SUMS}) AS checksum FROM (SELECT sha256(doc_id::VARCHAR || chr(31) || coalesce(text, chr(30)) || chr(31) || coalesce(source, chr(30))) AS h FROM documents)")
def state_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and order-free checksum of a table, to prove that a run changed nothing."""
    return evaluation.fingerprint(tables.table(spark, sf_dir, "documents"), "doc_id", "text", "source")


# conversations ----------------------------------------------------------------------------------------------------

def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.usable_messages(tables.messages(spark, sf_dir))


@query(f"WITH {_MSG}, f AS (SELECT *, CASE WHEN role = 'assistant' AND coalesce(lag(role) OVER w = 'user', false) THEN 0 ELSE 1 END AS s FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY created_at, id)) SELECT conv_id, id, sum(s) OVER (PARTITION BY conv_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS interaction FROM f")
def interaction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.interactions(_messages(spark, sf_dir)).select("conv_id", "id", "interaction")


@query(f"WITH {_TARGET} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id ORDER BY created_at) AS place FROM bef WHERE back <= 6")
def recent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return context.recent(m, context.last_targets(m)).select("conv_id", "id", "place")


_QTERMS = f"""qt AS (SELECT conv_id, t, min(p) AS p FROM (SELECT conv_id, unnest(toks) AS t, generate_subscripts(toks, 1) AS p FROM (SELECT conv_id, {_tok('target_text')} AS toks FROM tgt)) WHERE length(t) >= 2 AND t NOT IN ({_STOP}) GROUP BY ALL),
lq AS (SELECT g.conv_id, coalesce(string_agg(t, ' | ' ORDER BY p) FILTER (r <= 12), '') AS query FROM tgt g LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS r FROM qt) q USING (conv_id) GROUP BY g.conv_id)"""


@query(f"WITH {_TARGET}, {_QTERMS} SELECT conv_id, query FROM lq")
def target_lexical_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.lexical_queries(context.last_targets(_messages(spark, sf_dir)))


_OLDER = f"old AS (SELECT conv_id AS scope, id, created_at, content AS text FROM bef WHERE back > 2), oq AS (SELECT conv_id AS scope, 0 AS qid, query AS text FROM lq), {_bm25('old', 'oq', 'lx', 3)}"


@query(f"WITH {_TARGET}, {_QTERMS}, {_OLDER} SELECT scope AS conv_id, rank, id, score FROM lx")
def older_lexical_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return context.lexical_older(m, context.last_targets(m), n_recent=2)


def _message_vectors(spark: SparkSession, sf_dir: str, m: DataFrame) -> DataFrame:
    """Each message takes the vector whose id is its own id modulo their number."""
    e = tables.table(spark, sf_dir, "embeddings").filter(vector.valid(F.col("embedding"))).select("vec_id", F.col("embedding").alias("v"))
    n = tables.table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    return m.join(F.broadcast(n)).withColumn("vec_id", F.pmod(F.col("id"), F.col("n"))).join(e, "vec_id").select("conv_id", "id", "v")


_SEMANTIC = f"""mv AS (SELECT m.*, e.embedding::DOUBLE[] AS v FROM msg m JOIN embeddings e ON e.vec_id = m.id % (SELECT count(*) FROM embeddings)),
sn AS (SELECT * FROM (SELECT m.conv_id, m.id, m.created_at, round(list_dot_product(m.v, q.v), 6) AS score, row_number() OVER (PARTITION BY m.conv_id ORDER BY round(list_dot_product(m.v, q.v), 6) DESC, m.created_at, m.id) AS pos
  FROM mv m JOIN tgt t USING (conv_id) JOIN mv q ON q.id = t.target_id) WHERE pos <= 9),
se AS (SELECT * FROM (SELECT sn.conv_id, sn.id, sn.score, row_number() OVER (PARTITION BY sn.conv_id ORDER BY pos) AS rank FROM sn JOIN bef ON bef.id = sn.id AND bef.back > 2) WHERE rank <= 3)"""


@query(f"WITH {_TARGET}, {_SEMANTIC} SELECT conv_id, rank, id, score FROM se")
def older_semantic_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return context.semantic_older(m, context.last_targets(m), _message_vectors(spark, sf_dir, m), n_recent=2)


@query(f"""WITH {_TARGET}, {_QTERMS}, {_OLDER}, {_SEMANTIC}, cb AS (SELECT scope AS conv_id, rank, id FROM lx UNION ALL SELECT conv_id, rank, id FROM se),
cf AS (SELECT conv_id, id, round(sum({_RR}), 12) AS score, min(rank) AS best FROM cb GROUP BY conv_id, id),
cr AS (SELECT cf.*, m.created_at, row_number() OVER (PARTITION BY cf.conv_id ORDER BY score DESC, best, m.created_at, cf.id) AS r FROM cf JOIN msg m ON m.id = cf.id)
SELECT conv_id, id, score, row_number() OVER (PARTITION BY conv_id ORDER BY created_at, id) AS place FROM cr WHERE r <= 6""")
def context_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    return context.older_context(m, context.last_targets(m), _message_vectors(spark, sf_dir, m), n_recent=2)


@query(f"WITH {_MSG}, o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC) AS back FROM msg) SELECT conv_id, count(*) AS n_eligible, min(id) AS first_id, max(id) AS marker_id FROM o WHERE back > 2 GROUP BY conv_id HAVING count(*) >= 4")
def summary_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.summary_due(_messages(spark, sf_dir), trigger=4, keep=2)


@query(f"""WITH {_MSG}, f AS (SELECT *, CASE WHEN role = 'assistant' AND coalesce(lag(role) OVER w = 'user', false) THEN 0 ELSE 1 END AS s FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY created_at, id)),
i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS interaction FROM f)
SELECT conv_id, coalesce(max(interaction) FILTER (created_at < 3), 0)::BIGINT AS boundary FROM i GROUP BY conv_id""")
def recovery_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = context.interactions(_messages(spark, sf_dir)).withColumn("done", F.col("created_at") < 3)
    return context.uncovered_interactions(rows.select("conv_id", "interaction", "done"))


@query(f"""WITH {_MSG}, n AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY created_at) AS pos, id FROM msg),
o AS (SELECT conv_id, pos, CASE WHEN conv_id % 5 = 0 AND pos = 1 THEN id + 1 ELSE id END AS id FROM n WHERE pos <= 3)
SELECT conv_id AS scope, CASE WHEN count(*) FILTER (o.id IS NOT NULL AND o.id IS DISTINCT FROM n.id) > 0 THEN 'rebuild' WHEN count(*) FILTER (o.id IS NULL) > 0 THEN 'append' ELSE 'unchanged' END AS plan FROM n FULL JOIN o USING (conv_id, pos) GROUP BY conv_id""")
def resume_watermark_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    m = _messages(spark, sf_dir)
    new = m.select(F.col("conv_id").alias("scope"), F.row_number().over(Window.partitionBy("conv_id").orderBy("created_at")).alias("pos"), "id")
    old = new.filter("pos <= 3").withColumn("id", F.when((F.col("scope") % 5 == 0) & (F.col("pos") == 1), F.col("id") + 1).otherwise(F.col("id")))
    return context.is_append(old, new)


@query("SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def session_turn_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.messages(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("n_turns"))


# evaluation -------------------------------------------------------------------------------------------------------

def _gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold an item's text are its evidence; null for items that none holds."""
    held = lexical.literal_match(_docs(spark, sf_dir), tables.search_queries(spark, sf_dir)).select("qid", F.col("id").alias("evidence"))
    return written(tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid")).join(held, "qid", "left").select("qid", "evidence"), "gold")


def _run(spark: SparkSession, sf_dir: str, backend: str) -> DataFrame:
    """Hits of all scopes of an item in one ranking, by score: (qid, rank, evidence)."""
    docs = tables.memories(spark, sf_dir).filter("is_active").withColumn("scope", F.lit("all")).select("scope", "id", "text")
    asks = tables.table(spark, sf_dir, "benchmark").select(F.lit("all").alias("scope"), F.col("item_id").alias("qid"), "text")
    found = lexical.bm25_topk(docs, asks, 10) if backend == "bm25" else lexical.fts_topk(docs, asks, 10, web=False)
    return small(found.select("qid", "rank", F.col("id").alias("evidence")))


def _metrics(spark: SparkSession, sf_dir: str, backend: str = "bm25", gold: DataFrame | None = None) -> DataFrame:
    return evaluation.question_metrics(_run(spark, sf_dir, backend), _gold(spark, sf_dir) if gold is None else gold)


def _staged(spark: SparkSession, sf_dir: str, metrics: DataFrame, gold: DataFrame) -> DataFrame:
    covered = tables.memories(spark, sf_dir).filter("is_active").select(F.col("id").alias("evidence"))
    return written(evaluation.stage(metrics, covered, gold), "stages")


def _stages(spark: SparkSession, sf_dir: str, backend: str, gold: DataFrame | None = None) -> DataFrame:
    """Gold and hits are written once; so are the stages, which several parts of a report read."""
    gold = _gold(spark, sf_dir) if gold is None else gold
    return _staged(spark, sf_dir, _metrics(spark, sf_dir, backend, gold), gold)


_ONE = "one AS (SELECT 'all' AS scope, id, text FROM mem WHERE is_active), ask1 AS (SELECT 'all' AS scope, item_id AS qid, text FROM benchmark)"
_GOLD = "gold AS (SELECT b.item_id AS qid, d.doc_id AS evidence FROM benchmark b LEFT JOIN documents d ON contains(lower(d.text), lower(b.text)))"


def _metrics_sql(hits: str, name: str) -> str:
    ks = evaluation.CUTOFFS
    return f"""{name} AS (SELECT g.qid, count(DISTINCT g.evidence) AS n_gold, min(h.rank) AS first_rank, {", ".join(f"CASE WHEN min(h.rank) <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}, coalesce(count(DISTINCT g.evidence) FILTER (h.rank <= {k}) / nullif(count(DISTINCT g.evidence), 0), 0)::DOUBLE AS recall_{k}" for k in ks)},
  coalesce(1.0 / min(h.rank), 0)::DOUBLE AS reciprocal FROM gold g LEFT JOIN {hits} h ON h.qid = g.qid AND h.id = g.evidence GROUP BY g.qid)"""


_VEC1 = """near1 AS (SELECT * FROM (SELECT q.item_id AS qid, m.id, row_number() OVER (PARTITION BY q.item_id ORDER BY round(list_dot_product(v.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, m.id) AS rank
  FROM benchmark q JOIN embeddings e ON e.vec_id = q.item_id, mem m JOIN embeddings v ON v.vec_id = m.id WHERE m.is_active) WHERE rank <= 10)"""
_EVAL = f"{_MEM}, {_ONE}, {_GOLD}, {_bm25('one', 'ask1', 'bm', 10)}, {_fts('one', 'ask1', 'ft', 10)}, {_metrics_sql('bm', 'mb')}, {_metrics_sql('ft', 'mf')}"
_MEANS = ", ".join(f"round(coalesce(avg({m}_{k}) FILTER (n_gold > 0), 0), 6)::DOUBLE AS {m}_{k}" for m in ("hit", "recall") for k in evaluation.CUTOFFS)
_SUMMARY = f"count(*) FILTER (n_gold > 0) AS n_questions, count(*) FILTER (n_gold = 0) AS n_no_evidence, {_MEANS}, round(coalesce(avg(reciprocal) FILTER (n_gold > 0), 0), 6)::DOUBLE AS mrr"


def _stage_sql(metrics: str, name: str) -> str:
    return f"""{name} AS (SELECT m.qid, m.first_rank, CASE WHEN n_gold = 0 THEN NULL WHEN NOT EXISTS (SELECT 1 FROM gold g JOIN mem ON mem.id = g.evidence AND is_active WHERE g.qid = m.qid) THEN 'NO_GOLD_MEMORY'
  WHEN first_rank IS NULL THEN 'RETRIEVAL_MISS' WHEN first_rank <= 5 THEN 'SUCCESS' ELSE 'RANKING_MISS' END AS stage FROM {metrics} m)"""


_STAGES = f"{_EVAL}, {_stage_sql('mb', 'sb')}, {_stage_sql('mf', 'sf')}, pairs AS (SELECT f.qid, f.stage AS stage_before, b.stage AS stage_after, f.first_rank AS rank_before, b.first_rank AS rank_after FROM sf f JOIN sb b USING (qid))"


@query(f"WITH {_EVAL} SELECT {_SUMMARY} FROM mb")
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(_metrics(spark, sf_dir))


@query(f"WITH {_EVAL}, c AS (SELECT *, 'c' || qid % 4 AS category FROM mb) SELECT category, {_SUMMARY} FROM c GROUP BY ROLLUP (category)")
def retrieval_metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.summarize(_metrics(spark, sf_dir).withColumn("category", F.concat(F.lit("c"), F.col("qid") % 4)), "category")


@query(f"WITH {_STAGES} SELECT s.stage, count(sb.qid) AS n FROM (VALUES ('SUCCESS'), ('RANKING_MISS'), ('RETRIEVAL_MISS'), ('NO_GOLD_MEMORY')) s(stage) LEFT JOIN sb USING (stage) GROUP BY s.stage")
def stage_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stage_counts(_stages(spark, sf_dir, "bm25"))


@query(f"WITH {_STAGES} SELECT stage_before, stage_after, count(*) AS n FROM pairs GROUP BY ALL")
def transition_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.transitions(_pairs(spark, sf_dir))


@query(f"""WITH {_STAGES}, p AS (SELECT *, coalesce(rank_after IS NOT NULL AND (rank_before IS NULL OR rank_after < rank_before), false) AS better, coalesce(rank_before IS NOT NULL AND (rank_after IS NULL OR rank_after > rank_before), false) AS worse,
  stage_before IN ('RETRIEVAL_MISS', 'RANKING_MISS') AND stage_after = 'SUCCESS' AS fixed, stage_before = 'SUCCESS' AND stage_after <> 'SUCCESS' AS lost FROM pairs WHERE stage_before IS NOT NULL AND stage_after IS NOT NULL)
SELECT count(*) FILTER (fixed) AS failures_fixed, count(*) FILTER (lost) AS successes_lost, count(*) FILTER (fixed) - count(*) FILTER (lost) AS net_success_gain, count(*) FILTER (better) AS rank_improved, count(*) FILTER (worse) AS rank_worsened, count(*) FILTER (NOT better AND NOT worse) AS rank_unchanged FROM p""")
def net_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.net_impact(_pairs(spark, sf_dir))


def _first_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, bm25_rank, fts_rank): the first rank of an item's gold in each branch."""
    gold = _gold(spark, sf_dir)
    first = lambda b, n: evaluation.question_metrics(_run(spark, sf_dir, b), gold).select("qid", F.col("first_rank").alias(n))
    return first("bm25", "bm25_rank").join(first("fts", "fts_rank"), "qid")


@query(f"WITH {_EVAL} SELECT b.qid, CASE WHEN NOT coalesce(b.first_rank IS NOT NULL AND (f.first_rank IS NULL OR b.first_rank < f.first_rank), false) THEN 'UNCLEAR' WHEN f.first_rank IS NOT NULL THEN 'RRF_BOOST' ELSE 'CANDIDATE_RECOVERY' END AS effect FROM mb b JOIN mf f USING (qid)")
def bm25_effect_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _first_gold(spark, sf_dir)
    none = F.lit(None).cast("long")
    return r.select("qid", evaluation.lexical_effect(F.col("fts_rank"), F.col("bm25_rank"), none, F.col("fts_rank"), F.col("bm25_rank")).alias("effect"))


_CASES = f"""{_EVAL}, {_VEC1}, vb AS (SELECT g.qid, min(n.rank) AS first_rank FROM gold g LEFT JOIN near1 n ON n.qid = g.qid AND n.id = g.evidence GROUP BY g.qid),
cases AS (SELECT qid, CASE WHEN b.first_rank IS NULL AND v.first_rank IS NOT NULL THEN 'vector_only' WHEN b.first_rank IS NOT NULL AND v.first_rank IS NULL THEN 'bm25_only' END AS kind, b.first_rank AS bm25_rank, v.first_rank AS vector_rank FROM mb b JOIN vb v USING (qid))"""


def _vector_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, rank, id): the ten active documents whose vectors are nearest to the item's."""
    v, q = _vectors(spark, sf_dir)
    live = tables.memories(spark, sf_dir).filter("is_active").select("id")
    one = v.join(live, "id", "left_semi").withColumn("scope", F.lit("all"))
    asks = q.select(F.lit("all").alias("scope"), "qid", "v").dropDuplicates(["qid"])
    return small(vector.topk(one, asks, 10).select("qid", "rank", "id"))


def _cases(hits: DataFrame, near: DataFrame, gold: DataFrame) -> DataFrame:
    """(qid, bm25_rank, vector_rank) from the hits of _run() and _vector_run()."""
    bm = evaluation.question_metrics(hits, gold).select("qid", F.col("first_rank").alias("bm25_rank"))
    near = near.withColumnRenamed("id", "evidence")
    return written(bm.join(evaluation.question_metrics(near, gold).select("qid", F.col("first_rank").alias("vector_rank")), "qid"), "cases")


def _single_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(_run(spark, sf_dir, "bm25"), _vector_run(spark, sf_dir), _gold(spark, sf_dir))


@query(f"""WITH {_CASES}
SELECT k.kind, count(c.kind) AS n FROM (VALUES ('bm25_only'), ('vector_only')) k(kind) LEFT JOIN cases c USING (kind) GROUP BY k.kind""")
def single_branch_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = evaluation.single_branch_gold(_single_cases(spark, sf_dir))
    kinds = spark.createDataFrame([("bm25_only",), ("vector_only",)], "kind string")
    return kinds.join(cases.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


_GOOD5 = "coalesce({x} <= 5, false)"


@query(f"""WITH {_CASES} SELECT kind, count(*) AS n, count(*) FILTER ({_GOOD5.format(x='bm25_rank')}) AS within_before, count(*) FILTER ({_GOOD5.format(x='vector_rank')}) AS within_after,
count(*) FILTER ({_GOOD5.format(x='bm25_rank')} AND NOT {_GOOD5.format(x='vector_rank')}) AS lost, count(*) FILTER (vector_rank IS NOT NULL AND (bm25_rank IS NULL OR vector_rank < bm25_rank)) AS improved FROM cases WHERE kind IS NOT NULL GROUP BY kind""")
def single_branch_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From BM25 alone to vectors alone, for the questions only one of them answers."""
    c = _single_cases(spark, sf_dir)
    return evaluation.single_branch_behaviour(evaluation.single_branch_gold(c), c.select("qid", F.col("bm25_rank").alias("first_rank")), c.select("qid", F.col("vector_rank").alias("first_rank")))


_ARTICLE = r"(^|[^\p{{L}}\p{{N}}_])(a|an|the|and)([^\p{{L}}\p{{N}}_]|$)"
# twice, since an article right after another shares its boundary
_NA = (
    rf"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(replace({{x}}, ',', '')), '{_ARTICLE}', '\1 \3', 'g'), '{_ARTICLE}', '\1 \3', 'g'), """
    r"""'[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{{|}}~]', '', 'g'), '\s+', ' ', 'g')"""
)



def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best BM25 document's text as the predicted answer to each item, the item's as gold."""
    best = _run(spark, sf_dir, "bm25").filter("rank = 1").select("qid", F.col("evidence").alias("doc_id"))
    d = tables.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("predicted"))
    b = tables.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("gold"))
    return best.join(d, "doc_id").join(b, "qid").select("qid", "predicted", "gold")


_TOKENS = "list_filter(string_split({x}, ' '), lambda t: t <> '')"
_F1 = f"""ans AS (SELECT bm.qid, d.text AS predicted, b.text AS gold FROM bm JOIN documents d ON d.doc_id = bm.id JOIN benchmark b ON b.item_id = bm.qid WHERE bm.rank = 1)"""


def _f1_sql(source: str, keys: str, name: str) -> str:
    return f"""{name}_t AS (SELECT {keys}, {_TOKENS.format(x=_NA.format(x="predicted"))} AS p, {_TOKENS.format(x=_NA.format(x="gold"))} AS g FROM {source}),
{name}_s AS (SELECT {keys}, len(p) AS np, len(g) AS ng, coalesce(list_sum(list_transform(list_distinct(list_intersect(p, g)), lambda t: least(len(list_filter(p, lambda x: x = t)), len(list_filter(g, lambda x: x = t))))), 0) AS same FROM {name}_t),
{name} AS (SELECT {keys}, CASE WHEN same > 0 THEN 2.0 * (same / np) * (same / ng) / (same / np + same / ng) ELSE 0 END::DOUBLE AS f1 FROM {name}_s)"""


@query(f"WITH {_EVAL}, {_F1}, {_f1_sql('ans', 'qid', 'f')} SELECT qid, round(f1, 6) AS f1 FROM f")
def qa_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.token_f1(_answers(spark, sf_dir), "qid").withColumn("f1", F.round("f1", 6))


def _parts(x: str) -> str:
    parts = f"list_filter(list_transform(string_split({x}, ','), lambda y: trim(y)), lambda y: y <> '')"
    return f"CASE WHEN len({parts}) > 0 THEN {parts} ELSE [trim({x})] END"


@query(f"""WITH {_EVAL}, {_F1}, gp AS (SELECT qid, unnest(gs) AS gold, generate_subscripts(gs, 1) AS gi, ps FROM (SELECT qid, {_parts("gold")} AS gs, {_parts("predicted")} AS ps FROM ans)),
cell AS (SELECT qid, gi, gold, unnest(ps) AS predicted FROM gp), {_f1_sql('cell', 'qid, gi', 'f')}, best AS (SELECT qid, gi, max(f1) AS f1 FROM f GROUP BY ALL) SELECT qid, round(avg(f1), 6) AS f1 FROM best GROUP BY qid""")
def qa_multi_hop_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.multi_hop_f1(_answers(spark, sf_dir), "qid").withColumn("f1", F.round("f1", 6))


# streaming --------------------------------------------------------------------------------------------------------

@query(f"WITH {_ACT} SELECT event_id, user_id, fact_key, action FROM act")
def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lifecycle as a stateful stream over the event files, run to their end; equal to the batch windows."""
    e = ingest.stream_table(spark, sf_dir, "events")
    names = F.create_map(*[F.lit(x) for kv in tables.EVENT_PREDICATES.items() for x in kv])
    value = F.concat(F.lit(" V "), F.floor(F.col("value") / 10).cast("bigint").cast("string"))
    user = F.col("user_id").cast("string")
    key = identity.fact_key(F.lit("semantic"), F.lit("User"), user, F.element_at(names, F.col("event_type")), value)
    writes = e.select(user.alias("user_id"), key.alias("fact_key"), "ts", "event_id", identity.value_identity(value).alias("norm_value")).filter("fact_key is not null")
    out = scratch(spark, "lifecycle")
    ingest.run_available(ingest.lifecycle_stream(writes), out, scratch(spark, "lifecycle-state"))
    return spark.read.parquet(out).select("event_id", "user_id", "fact_key", "action")


@query("SELECT label::VARCHAR AS scope, count(*) AS n, min(vec_id) AS first_id, max(vec_id) AS last_id FROM embeddings GROUP BY label")
def stream_append_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index table kept by a stream of vectors: each micro-batch appends what the table lacks."""
    e = ingest.stream_table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    index = scratch(spark, "index")
    e.writeStream.foreachBatch(lambda b, n: ingest.append_index(b.sparkSession, b, index, n)).option("checkpointLocation", scratch(spark, "index-state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(index).groupBy("scope").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


# providers --------------------------------------------------------------------------------------------------------

@query()
def extract_candidates_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every interaction through the offline extractor."""
    rows = context.interactions(_messages(spark, sf_dir)).groupBy("conv_id", "interaction").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "content"))).alias("m"))
    rows = rows.select("conv_id", "interaction", F.array_join(F.transform("m", lambda x: x["content"]), "\n").alias("text"), F.transform("m", lambda x: x["id"]).alias("sources"))
    found = providers.extract(rows)
    return found.select("conv_id", "interaction", "memory_no", "memory_type", "memory_text", F.array_join("sources", ",").alias("sources"))


@query()
def answer_grounded_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offline reader over each query's hits of the hybrid search."""
    m = tables.memories(spark, sf_dir).select("id", "text", "is_active")
    hits = small(hybrid_search(spark, sf_dir)).join(m, "id")
    by = hits.groupBy("scope", "qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text", F.when(F.col("is_active"), "current").otherwise("historical").alias("status")))).alias("m"))
    refs = F.transform("m", lambda x, i: F.struct(F.concat(F.lit("M"), (i + 1).cast("string")).alias("ref"), x["text"].alias("text"), x["status"].alias("status")))
    asked = tables.search_queries(spark, sf_dir).select("scope", "qid", F.col("text").alias("query"))
    return providers.answer(asked.join(by.withColumn("memories", refs), ["scope", "qid"]).select("scope", "qid", "query", "memories"))


# full-text syntax, prepared corpora ------------------------------------------------------------------------------

def _web_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each item's first tokens: the first two in a row, or the third and fourth without the fifth."""
    t = tables.search_queries(spark, sf_dir).withColumn("t", text.tokenize(F.col("text"))).filter(F.size("t") >= 5)
    return t.select("scope", "qid", F.concat(F.lit('"'), F.col("t")[0], F.lit(" "), F.col("t")[1], F.lit('" or '), F.col("t")[2], F.lit(" "), F.col("t")[3], F.lit(" -"), F.col("t")[4]).alias("text"))


@query(f"""WITH {_MEM}, {_ASK}, q AS (SELECT scope, qid, {_tok('text')} AS t FROM ask), d AS (SELECT scope, id, {_tok('text')} AS toks FROM mem),
m AS (SELECT q.scope, q.qid, d.id, t, len(list_filter(range(1, len(toks)), lambda i: toks[i] = t[1] AND toks[i + 1] = t[2])) AS a, len(list_filter(toks, lambda x: x = t[3])) AS b, len(list_filter(toks, lambda x: x = t[4])) AS c, list_contains(toks, t[5]) AS e
  FROM q JOIN d USING (scope) WHERE len(t) >= 5)
SELECT scope, qid, id, greatest(a, CASE WHEN b > 0 AND c > 0 AND NOT e THEN b + c ELSE 0 END)::BIGINT AS total FROM m WHERE a > 0 OR (b > 0 AND c > 0 AND NOT e)""")
def fts_websearch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.web_match(_docs(spark, sf_dir), _web_queries(spark, sf_dir))


@query(f"WITH {_MEM}, {_ASK}, {_bm25('mem', k=5)}, {_bm25('mem', name='bo', k=5, k1=1.25, b=0.5)} SELECT 'a' AS setting, scope, qid, rank, id, score FROM bm UNION ALL SELECT 'b', scope, qid, rank, id, score FROM bo")
def bm25_prepared_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two settings of the formula over one prepared corpus."""
    index, asked = lexical.prepare(_docs(spark, sf_dir)), tables.search_queries(spark, sf_dir)
    a, b = lexical.bm25_topk(index, asked, 5), lexical.bm25_topk(index, asked, 5, k1=1.25, b=0.5)
    return a.withColumn("setting", F.lit("a")).unionByName(b.withColumn("setting", F.lit("b")))


@query(f"""WITH {_HYBRID}, fu AS (SELECT scope, qid, id, round({_DISCOUNTED}, 12) AS score, min(rank) FILTER (branch = 'bm25') AS bm25_rank, min(rank) FILTER (branch = 'vector') AS vector_rank, min(rank) FILTER (branch = 'structured') AS structured_rank FROM br GROUP BY scope, qid, id),
fi AS ({_FINAL.format(by="f.scope, f.qid", fused="fu")}) SELECT fi.scope, qid, fi.rank, fi.id, fi.score, mem.importance, mem.is_active, md5(mem.text) AS text_md5, bm25_rank, vector_rank, structured_rank FROM fi JOIN mem ON mem.id = fi.id WHERE rank <= 10""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = written(_branches(spark, sf_dir), "branches")
    m = tables.memories(spark, sf_dir)
    ranked = small(fusion.rank_memories(fusion.fuse(found), m, 10).select("scope", "qid", "rank", "id", "score"))
    return search.hits(found, ranked, m).withColumn("text_md5", F.md5("text")).drop("text")


# stored indexes ---------------------------------------------------------------------------------------------------

def _index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as rows of an index: every third is of no model."""
    e = tables.table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").cast("string").alias("scope"), F.col("vec_id").alias("id"), F.col("vec_id").alias("pos"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"), F.when(F.col("vec_id") % 3 != 0, "m1").alias("model"), F.col("embedding").cast("array<double>").alias("v"))


@query("""WITH r AS (SELECT label::VARCHAR AS scope, vec_id AS id, vec_id % 3 <> 0 AS mine, CASE WHEN label = 0 AND vec_id % 2 = 0 THEN 32 ELSE 64 END AS d FROM embeddings)
SELECT scope, id, (NOT mine) OR min(d) OVER (PARTITION BY scope) <> max(d) OVER (PARTITION BY scope) AS stale FROM r""")
def message_sync_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must be embedded anew; in one scope dimensions are mixed, so all of it."""
    rows = _index_rows(spark, sf_dir).withColumn("v", F.when((F.col("scope") == "0") & (F.col("id") % 2 == 0), F.slice("v", 1, 32)).otherwise(F.col("v")))
    return vector.needs_sync(rows, "m1").select("scope", "id", "stale")


@query("""WITH r AS (SELECT vec_id AS id, label, vec_id % 3 <> 0 AS mine, vec_id < (SELECT count(*) / 2 FROM embeddings) AS early FROM embeddings),
x AS (SELECT 1 AS round, CASE WHEN mine THEN 'stored' ELSE 'embedded' END AS action FROM r WHERE early UNION ALL SELECT 2, CASE WHEN early THEN 'kept' WHEN mine THEN 'stored' ELSE 'embedded' END FROM r
  UNION ALL SELECT 3, CASE WHEN label = 0 AND mine THEN 'stored' WHEN label = 0 THEN 'embedded' ELSE 'kept' END FROM r WHERE NOT (label = 0 AND id = (SELECT min(id) FROM r WHERE label = 0)))
SELECT round, action, count(*) AS n FROM x GROUP BY ALL UNION ALL VALUES (1, 'dropped', 0), (2, 'dropped', 0), (3, 'dropped', 1)""")
def index_sync_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rounds of one stored index: new, appended to, and after the first row of a scope has gone, so that the scope is built anew."""
    rows, path = _index_rows(spark, sf_dir), scratch(spark, "vector-index")
    half = rows.count() / 2
    first = rows.filter("scope = '0'").agg(F.min("id")).first()[0]
    out = None
    for k, part in enumerate((rows.filter(F.col("id") < half), rows, rows.filter(~((F.col("scope") == "0") & (F.col("id") == F.lit(first)))))):
        counts = indexes.sync(spark, part, path, "m1", providers.embed)[1].withColumn("round", F.lit(k + 1))
        out = counts if out is None else out.unionByName(counts)
    assert out is not None
    return out.select("round", "action", "n")


@query("""WITH e AS (SELECT label::VARCHAR AS scope, vec_id, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings),
s AS (SELECT a.scope, q.vec_id AS qid, a.vec_id AS id, round(list_dot_product(a.v, q.v) / (a.n * q.n), 5) AS score FROM e a JOIN e q ON a.scope = q.scope WHERE q.vec_id % 10 = 0)
SELECT * FROM (SELECT scope, qid, row_number() OVER (PARTITION BY scope, qid ORDER BY score DESC, id) AS rank, id, score FROM s) WHERE rank <= 5""")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored index, loaded again and asked with every tenth vector."""
    path = scratch(spark, "vector-index")
    rows = _index_rows(spark, sf_dir)
    indexes.save(rows.select("scope", "id", "pos", vector.normalize(F.col("v")).alias("v")), path, "m1")
    index = indexes.load(spark, path, "m1")
    asked = rows.filter("id % 10 = 0").select("scope", F.col("id").alias("qid"), vector.normalize(F.col("v")).alias("v"))
    return vector.topk(index.rows.select("scope", "id", "v"), asked, 5, digits=5)


# scopes, summaries, contexts --------------------------------------------------------------------------------------

@query("""WITH c AS (SELECT DISTINCT conv_id, 'u' || conv_id % 7 AS user_id, 'c' || conv_id % 50 AS name FROM conversations), a AS (SELECT conv_id AS qid, CASE WHEN conv_id % 2 = 0 THEN 'u' || conv_id % 7 END AS user_id, 'c' || conv_id % 60 AS name FROM c)
SELECT a.qid, count(c.conv_id) AS n, min(c.conv_id) AS conv_id FROM a LEFT JOIN c ON c.name = a.name AND (a.user_id IS NULL OR a.user_id = c.user_id) GROUP BY a.qid""")
def conversation_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many conversations a name means: none and several are errors of resolve()."""
    ids = tables.table(spark, sf_dir, "conversations").select("conv_id").distinct()
    name = lambda n: F.concat(F.lit("c"), F.col("conv_id") % n)
    user = F.concat(F.lit("u"), F.col("conv_id") % 7)
    asked = ids.select(F.col("conv_id").alias("qid"), F.when(F.col("conv_id") % 2 == 0, user).alias("user_id"), name(60).alias("name"))
    return scopes.resolution(asked, ids.select("conv_id", user.alias("user_id"), name(50).alias("name")))


@query("SELECT DISTINCT user_id::VARCHAR AS name, user_id % 3 <> 0 AS created FROM events")
def user_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of the events, of whom every third is known; asking again creates nothing."""
    names = tables.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("name"), "user_id").distinct()
    known = names.filter("user_id % 3 = 0").select("name", F.col("user_id").alias("id"))
    both, fresh = scopes.get_or_create(known, names, "name")
    again, none = scopes.get_or_create(both, names, "name")
    created = fresh.select("name", F.lit(True).alias("created")).unionByName(none.select("name", F.lit(None).cast("boolean").alias("created")))
    return again.join(created, "name", "left").select("name", F.coalesce("created", F.lit(False)).alias("created"))


@query(f"""WITH {_MSG}, mk AS (SELECT conv_id, created_at AS marker_at, id AS marker_id FROM msg WHERE created_at = 2 AND conv_id % 3 <> 0)
SELECT m.conv_id, m.id FROM msg m LEFT JOIN mk USING (conv_id) WHERE mk.marker_at IS NULL OR (m.created_at, m.id) > (marker_at, marker_id)""")
def messages_after_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    markers = m.filter("created_at = 2 and conv_id % 3 <> 0").select("conv_id", F.col("created_at").alias("marker_at"), F.col("id").alias("marker_id"))
    return context.after_markers(m, markers).select("conv_id", "id")


_ROUND = """{o} AS (SELECT conv_id, id, created_at, row_number() OVER (PARTITION BY conv_id ORDER BY created_at DESC) AS back FROM {src}), {n} AS (SELECT conv_id, count(*) AS n, max(id) AS marker_id FROM {o} WHERE back > 1 GROUP BY conv_id HAVING count(*) >= 2)"""


@query(f"""WITH {_MSG}, m1 AS (SELECT * FROM msg WHERE created_at < 4), {_ROUND.format(o='o1', n='r1', src='m1')},
m2 AS (SELECT msg.* FROM msg LEFT JOIN r1 USING (conv_id) WHERE r1.marker_id IS NULL OR msg.id > r1.marker_id), {_ROUND.format(o='o2', n='r2', src='m2')}
SELECT conv_id, coalesce('[' || r1.n || ']', '') || coalesce('[' || r2.n || ']', '') AS summary_text, coalesce(r2.marker_id, r1.marker_id) AS marker_id, r2.n IS NOT NULL AS changed FROM r1 FULL JOIN r2 USING (conv_id)""")
def rolling_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds; the summarizer notes how many messages it was given behind what it was told before."""
    import json

    def note(request: str) -> str:
        r = json.loads(request)
        return f"{r['previous_summary'] or ''}[{len(r['messages'])}]"

    m = _messages(spark, sf_dir)
    none = spark.createDataFrame([], summaries.SUMMARIES)
    first = summaries.update_summaries(m.filter("created_at < 4"), none, note, trigger=2, keep=1).drop("changed")
    return summaries.update_summaries(m, first, note, trigger=2, keep=1).select("conv_id", "summary_text", "marker_id", "changed")


_PACK = "string_agg(role || ':' || content, chr(10) ORDER BY created_at, {id})"


@query(f"""WITH {_TARGET}, {_QTERMS}, {_OLDER}, {_SEMANTIC}, cb AS (SELECT scope AS conv_id, rank, id FROM lx UNION ALL SELECT conv_id, rank, id FROM se),
cf AS (SELECT conv_id, id, round(sum({_RR}), 12) AS score, min(rank) AS best FROM cb GROUP BY conv_id, id),
cr AS (SELECT cf.conv_id, cf.id, m.role, m.content, m.created_at, row_number() OVER (PARTITION BY cf.conv_id ORDER BY score DESC, best, m.created_at, cf.id) AS r FROM cf JOIN msg m ON m.id = cf.id),
ol AS (SELECT conv_id, {_PACK.format(id='id')} AS older FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, content ORDER BY created_at, id) AS n FROM cr WHERE r <= 6) WHERE n = 1 GROUP BY conv_id),
re AS (SELECT conv_id, {_PACK.format(id='id')} AS recent FROM bef WHERE back <= 2 GROUP BY conv_id)
SELECT t.conv_id, CASE WHEN t.conv_id % 2 = 0 THEN 'so far ' || t.conv_id END AS summary, md5(coalesce(recent, '')) AS recent, md5(coalesce(older, '')) AS older FROM tgt t LEFT JOIN re USING (conv_id) LEFT JOIN ol USING (conv_id)""")
def extraction_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    targets = context.last_targets(m)
    told = targets.filter("conv_id % 2 = 0").select("conv_id", F.concat(F.lit("so far "), F.col("conv_id")).alias("summary_text"))
    out = summaries.extraction_context(m, targets, _message_vectors(spark, sf_dir, m), told, n_recent=2)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["role"], x["content"])), "\n")).alias(c)
    return out.select("conv_id", "summary", joined("recent"), joined("older"))


@query(f"""WITH {_MSG} SELECT conv_id, md5(coalesce(string_agg(content, chr(10) ORDER BY created_at, id) FILTER (role = 'user'), string_agg(content, chr(10) ORDER BY created_at, id))) AS query_md5 FROM msg GROUP BY conv_id""")
def target_semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _messages(spark, sf_dir).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "role", "content"))).alias("m"))
    return rows.select("conv_id", F.md5(summaries.semantic_query(F.transform("m", lambda x: x["content"]), F.transform("m", lambda x: x["role"]))).alias("query_md5"))


@query(f"""WITH {_MSG} SELECT conv_id, id FROM (SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id, role, left(content, 20) ORDER BY created_at, id) AS n FROM msg) WHERE n = 1""")
def distinct_older_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.distinct_older(_messages(spark, sf_dir).withColumn("content", F.left("content", F.lit(20)))).select("conv_id", "id")


@query("""WITH t AS (SELECT conv_id, turn // 3 AS session, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, session::BIGINT AS session, n AS n_turns, sum(n) OVER w AS total, min(CASE WHEN (conv_id + session) % 5 <> 0 THEN 1 ELSE 0 END) OVER w = 1 AS resumed FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY session ROWS UNBOUNDED PRECEDING)""")
def resume_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 3").alias("session")).agg(F.count("*").alias("n_turns"))
    return context.resume_progress(t.withColumn("done", (F.col("conv_id") + F.col("session")) % 5 != 0)).select("conv_id", "session", "n_turns", "total", "resumed")


@query("""SELECT conv_id, turn // 3 AS session, conv_id * 1000 + turn AS id FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)""")
def session_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored messages told apart by their sessions' numbers alone."""
    turns = tables.table(spark, sf_dir, "conversations").groupBy("conv_id", F.expr("turn div 3").alias("session")).agg(F.count("*").alias("n_turns"))
    return evaluation.session_slices(tables.messages(spark, sf_dir), turns)


@query(f"""WITH {_MSG}, s AS (SELECT conv_id, count(*) AS stored FROM msg GROUP BY conv_id), e AS (SELECT conv_id, count(*) AS expected FROM conversations GROUP BY conv_id)
SELECT conv_id, coalesce(stored, 0) AS stored, expected::BIGINT AS expected FROM e LEFT JOIN s USING (conv_id) WHERE coalesce(stored, 0) <> expected""")
def resume_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of which fewer messages are stored than their sessions have: no place to go on from."""
    turns = tables.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    return evaluation.unequal_counts(_messages(spark, sf_dir), turns)


@query(f"""WITH {_MSG}, f AS (SELECT *, CASE WHEN role = 'assistant' AND coalesce(lag(role) OVER w = 'user', false) THEN 0 ELSE 1 END AS s FROM msg WINDOW w AS (PARTITION BY conv_id ORDER BY created_at, id)),
i AS (SELECT conv_id, id, sum(s) OVER (PARTITION BY conv_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING)::BIGINT AS interaction FROM f)
SELECT conv_id, interaction, bool_and(id % 1000 < 4) AS done FROM i GROUP BY conv_id, interaction""")
def interaction_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interactions all of whose messages some memory names; memories name the messages of four turns at once."""
    m = _messages(spark, sf_dir)
    rows = context.interactions(m).groupBy("conv_id", "interaction").agg(F.collect_list("id").alias("ids"))
    made = m.filter("created_at < 4").groupBy(F.col("conv_id").alias("memory_id")).agg(F.collect_list("id").alias("sources"))
    return evaluation.covered(rows, made).select("conv_id", "interaction", "done")


@query("SELECT DISTINCT text FROM (SELECT left(text, 40) AS text FROM documents) WHERE text NOT IN (SELECT left(text, 40) FROM documents WHERE doc_id % 2 = 0)")
def embedding_cache_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.table(spark, sf_dir, "documents").select("doc_id", F.left("text", F.lit(40)).alias("text"))
    return evaluation.cache_misses(t, t.filter("doc_id % 2 = 0"))


@query(f"""WITH {_ACT}, s AS (SELECT event_id, unnest([event_id % 7, event_id % 3 + 3]) AS n FROM act)
SELECT event_id AS memory_id, string_agg(DISTINCT 'D1:' || n, ',' ORDER BY 'D1:' || n) AS dia_ids FROM s GROUP BY event_id""")
def memory_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with the dialogue ids of their sources."""
    w = _writes(spark, sf_dir).select("memory_id", F.array(F.col("memory_id") % 7, F.col("memory_id") % 3 + 3).alias("sources"))
    dialogue = spark.range(7).select("id", F.concat(F.lit("D1:"), F.col("id")).alias("dia_id"))
    return evaluation.dump(w, dialogue).select("memory_id", F.array_join("dia_ids", ",").alias("dia_ids"))


@query("SELECT event_id AS memory_id, CASE WHEN event_id % 7 = event_id % 3 THEN (event_id % 7)::VARCHAR ELSE (event_id % 7) || ',' || (event_id % 3) END AS ids FROM events")
def stable_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("memory_id"), F.array(F.col("event_id") % 7, F.col("event_id") % 3, F.col("event_id") % 7).alias("ids"))
    return e.select("memory_id", F.array_join(evaluation.stable_ids(F.col("ids")), ",").alias("ids"))


@query("SELECT conv_id, CASE WHEN turn = 0 THEN 'D1:' || conv_id ELSE 'D' || turn || ':' || conv_id END AS resolved, CASE WHEN turn = 1 THEN 'Dx:1' ELSE '' END AS unresolved FROM conversations WHERE turn < 2")
def evidence_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue ids with leading zeros, and one that is none."""
    c = tables.table(spark, sf_dir, "conversations").filter("turn < 2").select("conv_id", "turn")
    raw = F.when(F.col("turn") == 0, F.concat(F.lit("D01:0"), F.col("conv_id"))).otherwise(F.concat(F.lit("D"), F.col("turn"), F.lit(":00"), F.col("conv_id"), F.lit("; Dx:1")))
    known = F.array(F.concat(F.lit("D1:"), F.col("conv_id")))
    out = c.select("conv_id", text.evidence(raw, known).alias("e"))
    return out.select("conv_id", F.array_join("e.resolved", ",").alias("resolved"), F.array_join("e.unresolved", ",").alias("unresolved"))


@query(f"""WITH {_MSG}, c AS (SELECT conv_id, id AS candidate_id, unnest([id, conv_id * 1000 + 99, (conv_id + 1) * 1000]) AS source FROM msg WHERE created_at = 0)
SELECT candidate_id, source FROM c WHERE NOT EXISTS (SELECT 1 FROM msg WHERE msg.id = c.source AND msg.conv_id = c.conv_id)""")
def invalid_source_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir).withColumn("user_id", F.col("conv_id").cast("string"))
    c = m.filter("created_at = 0").select(F.col("id").alias("candidate_id"), "user_id", "conv_id", F.array(F.col("id"), F.col("conv_id") * 1000 + 99, (F.col("conv_id") + 1) * 1000).alias("sources"))
    return lifecycle.invalid_sources(c, m)


# comparisons ------------------------------------------------------------------------------------------------------

def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    return evaluation.compare(_stages(spark, sf_dir, "fts", gold), _stages(spark, sf_dir, "bm25", gold))


def _variant_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    both = [_stages(spark, sf_dir, b, gold).select(F.lit(b).alias("variant"), "qid", "first_rank", "stage") for b in ("fts", "bm25")]
    return both[0].unionByName(both[1])


_VS = f"{_STAGES}, vs AS (SELECT 'fts' AS variant, * FROM sf UNION ALL SELECT 'bm25', * FROM sb)"
_NAMES = "(VALUES ('SUCCESS'), ('RANKING_MISS'), ('RETRIEVAL_MISS'), ('NO_GOLD_MEMORY')) s(stage)"


@query(f"WITH {_STAGES}, c AS (SELECT *, 'c' || qid % 4 AS category FROM sb), g AS (SELECT DISTINCT category FROM c UNION ALL SELECT NULL) SELECT g.category, s.stage, (SELECT count(*) FROM c WHERE c.stage = s.stage AND (g.category IS NULL OR c.category = g.category)) AS n FROM g, {_NAMES}")
def stage_breakdown_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.stage_counts_by(_stages(spark, sf_dir, "bm25").withColumn("category", F.concat(F.lit("c"), F.col("qid") % 4)), "category")


@query(f"""WITH {_STAGES}, o AS (SELECT CASE stage_after WHEN 'SUCCESS' THEN 'fixed' WHEN 'RANKING_MISS' THEN 'improved' WHEN 'RETRIEVAL_MISS' THEN 'unchanged' ELSE 'other' END AS outcome FROM pairs WHERE stage_before = 'RETRIEVAL_MISS')
SELECT k.outcome, count(o.outcome) AS n FROM (VALUES ('fixed'), ('improved'), ('unchanged'), ('other')) k(outcome) LEFT JOIN o USING (outcome) GROUP BY k.outcome""")
def missed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.missed_outcomes(_pairs(spark, sf_dir))


@query(f"WITH {_STAGES} SELECT DISTINCT qid FROM pairs WHERE stage_before = 'RETRIEVAL_MISS' OR stage_before IS DISTINCT FROM stage_after")
def interesting_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.interesting(_pairs(spark, sf_dir))


@query(f"""WITH {_VS}, old AS (SELECT qid, first_rank AS old_rank FROM vs WHERE variant = 'fts' AND stage IN ('RETRIEVAL_MISS', 'RANKING_MISS')),
c AS (SELECT variant, CASE WHEN first_rank <= 5 THEN CASE WHEN variant = 'fts' THEN 'success' ELSE 'fixed' END WHEN first_rank < old_rank THEN 'improved_not_fixed' WHEN first_rank > old_rank THEN 'worsened' ELSE 'still_failing' END AS class FROM vs JOIN old USING (qid))
SELECT variant, class, count(*) AS n FROM c GROUP BY ALL""")
def reclassified_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.reclassified_counts(_variant_stages(spark, sf_dir), "fts")


@query(f"WITH {_VS}, n AS (SELECT variant, count(*) FILTER (stage = 'NO_GOLD_MEMORY') AS n FROM vs GROUP BY variant) SELECT count(*) AS n_variants, min(n) AS least, max(n) AS most, min(n) = max(n) AS same FROM n")
def no_gold_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.same_everywhere(_variant_stages(spark, sf_dir))


@query(f"""WITH {_VS}, su AS (SELECT 'fts' AS variant, {_SUMMARY} FROM mf UNION ALL SELECT 'bm25', {_SUMMARY} FROM mb),
g AS (SELECT count(*) FILTER (stage_before IN ('RETRIEVAL_MISS', 'RANKING_MISS') AND stage_after = 'SUCCESS') - count(*) FILTER (stage_before = 'SUCCESS' AND stage_after <> 'SUCCESS') AS gain FROM pairs),
x AS (SELECT su.variant, recall_5, hit_5, mrr, CASE WHEN su.variant = 'bm25' THEN gain ELSE 0 END AS net_gain, (SELECT count(*) FROM vs WHERE vs.variant = su.variant AND stage = 'RANKING_MISS') AS ranking_misses FROM su, g)
SELECT variant, recall_5, hit_5, mrr, net_gain, ranking_misses, row_number() OVER (ORDER BY recall_5 DESC, hit_5 DESC, mrr DESC, net_gain > 0 DESC, ranking_misses, variant) AS place FROM x""")
def variant_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = _gold(spark, sf_dir)
    metrics = {b: written(_metrics(spark, sf_dir, b, gold), "metrics") for b in ("fts", "bm25")}
    means = [evaluation.summarize(m).select(F.lit(b).alias("variant"), "recall_5", "hit_5", "mrr") for b, m in metrics.items()]
    fts, bm25 = (_staged(spark, sf_dir, m, gold) for m in metrics.values())
    gain = evaluation.net_impact(evaluation.compare(fts, bm25)).select(F.lit("bm25").alias("variant"), F.col("net_success_gain").alias("net_gain"))
    misses = fts.withColumn("variant", F.lit("fts")).unionByName(bm25.withColumn("variant", F.lit("bm25"))).groupBy("variant").agg(F.count_if(F.coalesce(F.col("stage") == "RANKING_MISS", F.lit(False))).alias("ranking_misses"))
    rows = means[0].unionByName(means[1]).join(gain, "variant", "left").join(misses, "variant").withColumn("net_gain", F.coalesce("net_gain", F.lit(0)))
    return evaluation.variant_order(rows.select("variant", "recall_5", "hit_5", "mrr", "net_gain", "ranking_misses"))


def _candidates(spark: SparkSession, sf_dir: str, hits: DataFrame, near: DataFrame) -> DataFrame:
    """The branches of the hits of _run() by BM25 and by full text, and of _vector_run()."""
    branch = lambda rows, name: rows.select("qid", F.lit(name).alias("branch"), "rank", F.col("evidence").alias("id"))
    return branch(hits, "bm25").unionByName(branch(_run(spark, sf_dir, "fts"), "fts")).unionByName(near.select("qid", F.lit("vector").alias("branch"), "rank", "id"))


_CB = f"{_CASES}, cb AS (SELECT qid, 'bm25' AS branch, rank, id FROM bm UNION ALL SELECT qid, 'fts', rank, id FROM ft UNION ALL SELECT qid, 'vector', rank, id FROM near1)"


@query(f"WITH {_CB} SELECT qid, branch, min(rank) AS rank FROM cb JOIN (SELECT DISTINCT qid, evidence FROM gold) g USING (qid) WHERE cb.id = g.evidence GROUP BY qid, branch")
def branch_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.branch_ranks(_candidates(spark, sf_dir, _run(spark, sf_dir, "bm25"), _vector_run(spark, sf_dir)), _gold(spark, sf_dir).withColumnRenamed("evidence", "id"))


@query(f"""WITH {_CB}, f AS (SELECT qid, kind FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY qid) AS i FROM cases WHERE kind IS NOT NULL) WHERE i <= 5)
SELECT qid, kind, branch, rank, cb.id, EXISTS (SELECT 1 FROM gold g WHERE g.qid = cb.qid AND g.evidence = cb.id) AS is_gold FROM cb JOIN f USING (qid)""")
def worked_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits, near, gold = _run(spark, sf_dir, "bm25"), _vector_run(spark, sf_dir), _gold(spark, sf_dir)
    cases = evaluation.single_branch_gold(_cases(hits, near, gold)).select("qid", "kind")
    return evaluation.worked_examples(_candidates(spark, sf_dir, hits, near), gold.filter("evidence is not null").withColumnRenamed("evidence", "id"), cases)


def _summary_by(metrics: str, name: str, n: int) -> str:
    return f"{name} AS (SELECT category, {_SUMMARY} FROM (SELECT *, 'c' || qid % {n} AS category FROM {metrics}) GROUP BY ROLLUP (category))"


@query(f"""WITH {_EVAL}, {_summary_by('mf', 'sa', 4)}, {_summary_by('mb', 'sb2', 3)}
SELECT a.category, round(b.hit_5 - a.hit_5, 6) AS hit_5_delta, round(b.recall_5 - a.recall_5, 6) AS recall_5_delta, round(b.mrr - a.mrr, 6) AS mrr_delta FROM sa a JOIN sb2 b ON a.category IS NOT DISTINCT FROM b.category""")
def compare_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two reports, one of which has a category more."""
    gold = _gold(spark, sf_dir)
    by = lambda b, n: evaluation.summarize(_metrics(spark, sf_dir, b, gold).withColumn("category", F.concat(F.lit("c"), F.col("qid") % n)), "category")
    return evaluation.compare_summaries(by("fts", 4), by("bm25", 3))


@query(f"""WITH {_EVAL}, {_F1}, {_f1_sql('ans', 'qid', 'f')} SELECT count(*) FILTER (qid % 5 <> 0) AS n_f1, round(coalesce(avg(f1) FILTER (qid % 5 <> 0), 0), 6)::DOUBLE AS f1, count(*) FILTER (qid % 5 = 0) AS n_abstention, round(coalesce(avg(CASE WHEN qid % 10 = 0 THEN 1.0 ELSE 0.0 END) FILTER (qid % 5 = 0), 0), 6)::DOUBLE AS abstention_accuracy FROM f""")
def qa_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as questions of categories 4 and 5; every other one of the last abstains."""
    a = _answers(spark, sf_dir).withColumn("category", F.when(F.col("qid") % 5 == 0, 5).otherwise(4)).withColumn("abstained", F.col("qid") % 10 == 0)
    return evaluation.answer_summary(evaluation.score_answers(a.withColumn("predicted", F.when(F.col("category") == 5, F.lit("")).otherwise(F.col("predicted")))))


_WORDS = "regexp_extract_all(lower(text), '[a-z]+')"
_INTENT_SQL = f"""it AS (SELECT item_id AS qid, CASE WHEN list_has_any({_WORDS}, ['live', 'lives', 'city', 'home']) THEN 'location' WHEN list_has_any({_WORDS}, ['timezone']) THEN 'timezone' WHEN list_has_any({_WORDS}, ['language', 'languages']) THEN 'programming_language' WHEN list_has_any({_WORDS}, ['name', 'called']) THEN 'name' END AS predicate,
  list_has_any({_WORDS}, ['formerly', 'previously', 'before', 'once']) AS past FROM benchmark),
ix AS (SELECT qid, predicate, CASE WHEN past THEN 'historical' WHEN predicate IS NOT NULL THEN 'current' ELSE 'any' END AS temporal_scope FROM it)"""


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return providers.infer_intents(tables.table(spark, sf_dir, "benchmark").select(F.lit("all").alias("scope"), F.col("item_id").alias("qid"), "text"))


@query(f"WITH {_INTENT_SQL} SELECT qid, predicate, temporal_scope, true AS ok FROM ix")
def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intents(spark, sf_dir).select("qid", "predicate", "temporal_scope", "ok")


@query(f"""WITH {_INTENT_SQL} SELECT count(*) AS n_questions, count(*) AS attempted, count(*) AS ok, 0::BIGINT AS fallbacks, count(predicate) AS with_predicate, 0::BIGINT AS with_value, count(*) FILTER (temporal_scope = 'current') AS scope_current, count(*) FILTER (temporal_scope = 'historical') AS scope_historical,
count(*) FILTER (temporal_scope = 'any') AS scope_any, count(*) FILTER (qid % 3 > 0) AS active, count(*) FILTER (qid % 5 = 0) AS structured_right, round(count(*) FILTER (qid % 3 > 0) / count(*), 6) AS activation_rate FROM ix""")
def intent_activation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.activation(_intents(spark, sf_dir).withColumn("n_structured", F.col("qid") % 3).withColumn("structured_right", F.col("qid") % 5 == 0))


def _case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as cases of a user, whose hits are their best documents; each expects two memories, of the item's first and of its second and third token."""
    m = tables.memories(spark, sf_dir).select(F.col("id").alias("evidence"), "text", F.col("scope").alias("owner"), (F.col("id") % 4 != 0).alias("is_active"))
    items = tables.table(spark, sf_dir, "benchmark").withColumn("t", text.tokenize(F.col("text"))).filter(F.size("t") >= 3)
    hits = _run(spark, sf_dir, "bm25").join(m, "evidence").select(F.col("qid").alias("case_id"), "rank", "text", "owner", "is_active").join(items.select(F.col("item_id").alias("case_id")), "case_id", "left_semi")
    hits = written(hits, "hits")
    cases = items.select(F.col("item_id").alias("case_id"), F.lit("en").alias("user_id"))
    t = lambda *at: F.array(*[F.upper(F.col("t")[i]) for i in at])
    expected = items.select(F.col("item_id").alias("case_id"), F.posexplode(F.array(t(0), t(1, 2))).alias("n", "terms"))
    return evaluation.case_metrics(cases, hits, expected)


_CM = f"""{_EVAL}, i AS (SELECT item_id AS case_id, {_tok('text')} AS t FROM benchmark), ic AS (SELECT * FROM i WHERE len(t) >= 3),
h AS (SELECT bm.qid AS case_id, bm.rank, {_norm('mem.text')} AS x, mem.scope AS owner, mem.id % 4 <> 0 AS act FROM bm JOIN mem USING (id) WHERE bm.qid IN (SELECT case_id FROM ic)),
e AS (SELECT case_id, 0 AS n, [t[1]] AS terms FROM ic UNION ALL SELECT case_id, 1, [t[2], t[3]] FROM ic),
f AS (SELECT e.case_id, e.n, min(h.rank) AS rank FROM e LEFT JOIN h ON h.case_id = e.case_id AND len(list_filter(e.terms, lambda y: NOT contains(h.x, y))) = 0 GROUP BY ALL),
w AS (SELECT case_id, count(*) FILTER (owner <> 'en') AS isolation_failures, count(*) FILTER (NOT act) AS superseded_returned FROM h GROUP BY case_id),
cm AS (SELECT ic.case_id, min(f.rank) AS first_rank, {", ".join(f"CASE WHEN min(f.rank) <= {k} THEN 1.0 ELSE 0.0 END::DOUBLE AS hit_{k}, (count(*) FILTER (f.rank <= {k}) / count(*))::DOUBLE AS recall_{k}" for k in (1, 3, 5))}, coalesce(1.0 / min(f.rank), 0)::DOUBLE AS reciprocal, coalesce(max(w.isolation_failures), 0) AS isolation_failures, coalesce(max(w.superseded_returned), 0) AS superseded_returned
  FROM ic LEFT JOIN f USING (case_id) LEFT JOIN w USING (case_id) GROUP BY ic.case_id)"""


@query(f"WITH {_CM} SELECT * FROM cm")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _case_metrics(spark, sf_dir)


@query(f"WITH {_CM} SELECT count(*) AS cases, {', '.join(f'round(avg({m}_{k}), 6)::DOUBLE AS {m}_{k}' for m in ('hit', 'recall') for k in (1, 3, 5))}, round(avg(reciprocal), 6)::DOUBLE AS mrr, sum(isolation_failures)::BIGINT AS isolation_failures, sum(superseded_returned)::BIGINT AS superseded_returned FROM cm")
def case_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.case_summary(_case_metrics(spark, sf_dir))
