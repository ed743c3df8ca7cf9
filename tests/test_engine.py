"""Golden values of the memory and retrieval operators."""

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recallspark import config, migrations, progress, providers, smoke
from recallspark.errors import ConflictError, EmbeddingError, ExtractionError, IndexError_, ProvenanceError, ProviderError, RecallError, ResumeError, ScopeError, StaleIndexError, SummaryError
from recallspark.functions import identity, text
from recallspark.memory import MemoryLayer
from recallspark.operators import asked as asked_terms
from recallspark.operators import context, evaluation, fusion, indexes, lexical, lifecycle, scopes, structured, vector
from recallspark.plans import search
from recallspark.sources import tables


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def col(x):
    return F.lit(x).cast("string")


def test_text(spark):
    assert value(spark, text.tokenize(F.lit("SQLite, LocoBike! Mara's Task-123."))) == ["sqlite", "locobike", "mara", "s", "task", "123"]
    assert value(spark, text.tokenize(F.lit("?! ..."))) == []
    assert value(spark, text.tokenize(F.lit("Straße élan"))) == ["strasse", "lan"]
    assert value(spark, F.array_join(text.query_terms(text.tokenize(F.lit("The Atlas deployment is failing again, Atlas."))), " | ")) == "atlas | deployment | failing | again"
    assert value(spark, text.percent_encode(F.lit("c++ a*~é:/-._"))) == "c%2B%2B%20a%2A~%C3%A9%3A%2F-._"
    assert value(spark, text.normalize_answer(F.lit("The cat, and  A dog's (bone)!"))) == "cat dogs bone"
    assert value(spark, text.strip_fence(F.lit('```json\n{"a": 1}\n```'))) == '{"a": 1}'
    assert value(spark, text.evidence_ids(F.lit("D1:01; D02:3 Dbogus"))) == ["D1:1", "D2:3"]
    assert value(spark, text.is_abstention(F.lit("That was Not Mentioned anywhere")))
    assert [r.x for r in spark.createDataFrame([("Ｆｕｌｌ  ﬁt ß",)], "t string").select(text.casefold_nfkc("t").alias("x")).collect()] == ["full fit ss"]


def test_identity(spark):
    key = lambda p, v, s="User", t="semantic": value(spark, identity.fact_key(F.lit(t), col(s), F.lit("user_123"), col(p), col(v)))
    assert key("location", "Hyderabad") == "user:user_123:location"
    assert key("current-city", "x") == "user:user_123:location"
    assert key("Programming Language", " Python ") == "user:user_123:programming_language:python"
    assert key("programming_language", "C++") == "user:user_123:programming_language:c%2B%2B"
    assert key("Ｐrogramming－language", "Ｃ＋＋") == "user:user_123:programming_language:c%2B%2B" and key("skill", "ﬁne  ＧＯ") == "user:user_123:skill:fine%20go"
    assert value(spark, identity.subject_id(F.lit(" Jose\u0301 "))) == "Jos%C3%A9" and value(spark, text.normalize(F.lit("Straße\u00a0\x1cX"))) == "strasse x"
    assert key("programming_language", " ") is None and key("mood", "x") is None and key("location", "x", s="project") is None and key("location", "x", t="episodic") is None


@pytest.fixture(scope="module")
def bakery(spark):
    rows = [("u", 1, "Mara started a small bakery downtown"), ("u", 2, "Mara rents ovens for the bakery"), ("u", 3, "Olof sails on weekends"), ("u", 4, "Mara renewed permit BAK-77 of the bakery"), ("u", 5, "")]
    return spark.createDataFrame(rows, "scope string, id long, text string")


def asked(spark, *texts):
    return spark.createDataFrame([("u", i, t) for i, t in enumerate(texts)], "scope string, qid long, text string")


def test_lexical(spark, bakery):
    got = lexical.bm25_topk(bakery, asked(spark, "Mara bakery sells bread", "nothing here", ""), 10).orderBy("qid", "rank").collect()
    assert sorted(r.id for r in got) == [1, 2, 4] and {r.qid for r in got} == {0}
    fts = lexical.fts_topk(bakery, asked(spark, "What shop does Mara run?", "BAK-77", "bakery mara", "downtow"), 10).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in fts] == [(1, 4), (2, 4), (2, 2), (2, 1), (3, 1)]
    web = lexical.fts_topk(bakery, asked(spark, '"small bakery"', '"bakery small"', "sails or ovens", "mara -ovens -permit", '-mara', '-"small bakery" mara'), 10).orderBy("qid", "rank").collect()
    assert [(r.qid, r.id) for r in web] == [(0, 1), (2, 3), (2, 2), (3, 1), (4, 5), (4, 3), (5, 4), (5, 2)]
    odd = spark.createDataFrame([("u", 1, "a --- b"), ("u", 2, "KAN-4, done"), ("u", 3, "xkan 41")], "scope string, id long, text string")
    assert [(r.qid, r.id) for r in lexical.literal_match(odd, asked(spark, "---", "an-4", "KA", "n 4")).orderBy("qid", "id").collect()] == [(0, 1), (1, 2), (2, 2), (2, 3), (3, 3)]
    ties = spark.createDataFrame([("u", 9, "same text"), ("u", 1, "same text")], "scope string, id long, text string")
    assert [r.id for r in lexical.bm25_topk(ties, asked(spark, "same"), 5).orderBy("rank").collect()] == [1, 9]


def test_vector(spark):
    v = spark.createDataFrame([("u", i, [1.0, 0.1 * i]) for i in range(5)], "scope string, id long, v array<double>")
    q = spark.createDataFrame([("u", 0, [1.0, 0.0])], "scope string, qid long, v array<double>")
    assert [r.id for r in vector.topk(v, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    state = spark.createDataFrame([(4,)], "id long")
    assert [(r.rank, r.id) for r in vector.oversampled(v, q, state, 1).collect()] == [(1, 4)]
    many = spark.createDataFrame([(str(i % 2), i, [float(i % 7), 1.0]) for i in range(300)], "scope string, id long, v array<double>")
    ask = spark.createDataFrame([(str(i % 2), i, [1.0, float(i)]) for i in range(40)], "scope string, qid long, v array<double>")
    want = {(str(s), q): [i for _, i in sorted((-round(i % 7 + q, 6), i) for i in range(300) if i % 2 == s)][:4] for s in (0, 1) for q in range(40) if q % 2 == s}
    for blocks in (32, 0):
        vector.FEW_BLOCKS, vector.VECTOR_BLOCK, vector.QUERY_BLOCK = blocks, 16, 8
        got = vector.topk(many, ask, 4).orderBy("rank").collect()
        assert all([r.id for r in got if (r.scope, r.qid) == k] == w for k, w in want.items())
    vector.FEW_BLOCKS, vector.VECTOR_BLOCK, vector.QUERY_BLOCK = 32, 4096, 1024
    bad = spark.createDataFrame([([],), ([0.0, 0.0],), ([float("nan")],), (None,)], "v array<double>")
    assert [r.x for r in bad.select(vector.normalize(F.col("v")).alias("x")).collect()] == [None] * 4


def branch(spark, **ranks):
    rows = [("u", 0, b, i + 1, x) for b, ids in ranks.items() for i, x in enumerate(ids) if x is not None]
    return spark.createDataFrame(rows, "scope string, qid long, branch string, rank long, id long")


def test_fusion(spark):
    b = branch(spark, structured=[7], bm25=[None, None, 7], vector=[None, 7])
    assert fusion.fuse(b, strategy="rrf").first().score == pytest.approx(1 / 61 + 1 / 63 + 1 / 62, abs=1e-12)
    gold = branch(spark, bm25=[None] * 19 + [2], vector=[None, 1] + [None] * 27 + [2])
    by = {r.id: r.score for r in fusion.fuse(gold, agreement=0.25).collect()}
    assert by[1] == pytest.approx(1 / 62, abs=1e-12) and by[2] == pytest.approx(1 / 80 + 0.25 / 90, abs=1e-12)
    assert fusion.fuse(branch(spark, bm25=[3])).first().score == pytest.approx(1 / 61, abs=1e-12)
    with pytest.raises(ValueError):
        fusion.fuse(b, k=0)
    m = branch(spark, lexical=[1, 2, 3], semantic=[2, 4, 1])
    messages = spark.createDataFrame([(i, i) for i in range(1, 5)], "id long, created_at long")
    ranked = fusion.rank_messages(fusion.fuse(m, strategy="rrf"), messages, 10, ("scope", "qid"))
    assert [r.id for r in ranked.orderBy("rank").collect()] == [2, 1, 4, 3]


WRITES = "user_id string, fact_key string, seq long, memory_id long, at long, norm_value string, sources array<string>"


def test_lifecycle(spark):
    rows = [("u", "k", i, i, i, v, [f"m{i}", "m0"]) for i, v in enumerate(["a", "a", "b", None, None, "a"])]
    w = spark.createDataFrame(rows, WRITES)
    assert [r.action for r in lifecycle.actions(w).orderBy("seq").collect()] == ["ADD", "NOOP", "SUPERSEDE", "SUPERSEDE", "NOOP", "SUPERSEDE"]
    v = lifecycle.facts(w).orderBy("island").collect()
    assert [(r.memory_id, r.valid_from, r.valid_to, r.superseded_by, r.is_active) for r in v] == [(0, 0, 2, 2, False), (2, 2, 3, 3, False), (3, 3, 5, 5, False), (5, 5, None, None, True)]
    assert [r.sources for r in lifecycle.provenance(w).orderBy("island").collect()] == [["m0", "m1"], ["m2", "m0"], ["m3", "m0", "m4"], ["m5", "m0"]]
    assert lifecycle.violations(lifecycle.facts(w)).count() == 0


def test_structured(spark):
    rows = [("u", 1, True, "location", "delhi"), ("u", 2, False, "location", "hyderabad"), ("u", 3, True, "skill", "go")]
    m = spark.createDataFrame(rows, "scope string, id long, is_active boolean, predicate string, value string").withColumns({"updated_at": F.col("id"), "created_at": F.col("id"), "memory_type": F.lit("semantic"), "subject_type": F.lit("user"), "fact_key": F.lit("k")})
    intent = lambda p, v, t: spark.createDataFrame([("u", 0, p, v, t)], "scope string, qid long, predicate string, value string, temporal_scope string")
    ids = lambda i, **f: [r.id for r in structured.by_intent(m, i, structured.Filters(**f), 9).orderBy("rank").collect()]
    assert ids(intent("lives_in", None, "current")) == [1] and ids(intent("location", None, "historical")) == [2] and ids(intent("location", None, "any")) == [1, 2]
    assert ids(intent("location", None, "historical"), include_history=False) == [] and ids(intent("location", None, "any"), include_history=False) == [1]
    assert ids(intent("skill", " Go ", "current")) == [3] and ids(intent("nonsense", None, "any")) == []
    assert structured.explicit(m, structured.Filters(include_history=True), 9).count() == 0
    assert [r.id for r in structured.explicit(m, structured.Filters(predicate="location"), 9).collect()] == [1]


def conversation(spark, n, roles=("user", "assistant")):
    return spark.createDataFrame([(1, i, i, roles[(i - 1) % len(roles)], f"message {i}") for i in range(1, n + 1)], "conv_id long, created_at long, id long, role string, content string")


def test_context(spark):
    m = conversation(spark, 8)
    assert [r.id for r in context.recent(m, context.last_targets(m), 3).orderBy("place").collect()] == [5, 6, 7]
    assert [r.interaction for r in context.interactions(conversation(spark, 3)).orderBy("id").collect()] == [1, 1, 2]
    due = context.summary_due(m, trigger=4, keep=2).first()
    assert (due.n_eligible, due.marker_id) == (6, 6)
    marker = spark.createDataFrame([(1, 6, 6)], "conv_id long, marker_at long, marker_id long")
    later = context.summary_due(conversation(spark, 14), marker, trigger=4, keep=2).first()
    assert (later.first_id, later.marker_id) == (7, 12)


def test_context_ids_of_other_conversations(spark):
    rows = [(1, i, i, "user", f"message {i}") for i in range(8)] + [(2, i, i + 2, "user", f"message {i}") for i in range(4)]
    m = spark.createDataFrame(rows, "conv_id long, created_at long, id long, role string, content string")
    v = m.select("conv_id", "id", F.array(F.lit(1.0), F.col("conv_id") * 0.1).alias("v"))
    t = context.last_targets(m)
    assert sorted((r.conv_id, r.id) for r in context.older(m, t, 2).collect()) == [*((1, i) for i in range(5)), (2, 2)]
    near = [(r.conv_id, r.id) for r in context.semantic_older(m, t, v, 2, k=5).orderBy("conv_id", "rank").collect()]
    assert near == [*((1, i) for i in range(5)), (2, 2)]
    fused = context.older_context(m, t, v, 2).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.id, r.place) for r in fused] == [*((1, i, i + 1) for i in range(3)), (2, 2, 1)]


def test_evaluation(spark):
    hits = spark.createDataFrame([(0, 1, "a"), (0, 3, "b"), (1, 7, "x")], "qid long, rank long, evidence string")
    gold = spark.createDataFrame([(0, "a"), (0, "b"), (0, "c"), (1, "x"), (2, None)], "qid long, evidence string")
    m = evaluation.question_metrics(hits, gold)
    r = m.filter("qid = 0").first()
    assert r.recall_1 == pytest.approx(1 / 3) and r.recall_3 == pytest.approx(2 / 3) and r.reciprocal == 1
    s = evaluation.summarize(m).first()
    assert (s.n_questions, s.n_no_evidence, s.hit_5) == (2, 1, 0.5)
    covered = spark.createDataFrame([("a",), ("x",)], "evidence string")
    assert {r.qid: r.stage for r in evaluation.stage(m, covered, gold).collect()} == {0: "SUCCESS", 1: "RANKING_MISS", 2: None}
    pairs = spark.createDataFrame([(0, "sunsets over the lake", "the lake and sunsets"), (1, "", "x")], "qid long, predicted string, gold string")
    f = {r.qid: r.f1 for r in evaluation.token_f1(pairs, "qid").collect()}
    assert f[0] == pytest.approx(0.8) and f[1] == 0
    hop = spark.createDataFrame([(0, "lake, friend", "sunsets over the lake, friend")], "qid long, predicted string, gold string")
    assert evaluation.multi_hop_f1(hop, "qid").first().f1 == pytest.approx(0.75)
    qa = spark.createDataFrame([(0, 3, "red", "red; blue", False), (1, 5, "not mentioned", None, False), (2, 1, "a1", "a1", False)], "qid long, category int, predicted string, gold string, abstained boolean")
    assert {r.qid: r.score for r in evaluation.score_answers(qa).collect()} == {0: 1.0, 1: 1.0, 2: 1.0}


def test_providers():
    with pytest.raises(ExtractionError):
        providers.parse_extraction('{"memories": [{"memory_type": "semantic", "memory_text": "x", "source_message_ids": ["m"]}]}')
    for bad in ("", "[]", '{"memories": []} trailing', '{"other": 1}'):
        with pytest.raises(ExtractionError):
            providers.parse_extraction(bad)
    notes = []
    calls = iter(["nonsense", '```json\n{"memories": []}\n```'])
    assert providers.with_attempts(lambda request, note: notes.append(note) or next(calls), "r", providers.parse_extraction) == []
    assert notes[0] == "" and "rejected" in notes[1]
    for broken, path in (('{"memories": [{"memory_type": "semantic", "memory_text": " "}]}', "memories[0].memory_text"), ('{"memories": [{"memory_type": "semantic", "memory_text": "x", "confidence": true}]}', "memories[0].confidence")):
        with pytest.raises(ExtractionError, match=re.escape(path)):
            providers.parse_extraction(broken)
    clean = providers.parse_extraction('{"memories": [{"memory_type": "semantic", "memory_text": " x ", "predicate": " ", "value": ""}]}')[0]
    assert clean["memory_text"] == "x" and clean["predicate"] is None and clean["value"] is None and clean["confidence"] == 0.5
    assert providers.content_of({"choices": [{"message": {"content": "a"}}]}) == "a" and providers.content_of({"choices": []}) is None and providers.content_of(None) is None
    assert providers.error_category(TimeoutError()) == "timeout" and providers.error_category(ConnectionResetError()) == "connection" and providers.error_category(ValueError()) == "other"
    assert providers.is_transient("rate_limit") and not providers.is_transient("invalid_json")
    assert "location: one value; also called" in providers.predicate_guidance() and providers.predicate_guidance() in providers.intent_prompt()
    with pytest.raises(ExtractionError):
        providers.parse_intent('{"predicate": "x", "temporal_scope": "never"}')


def test_offline_extractor_keeps_the_whole_text():
    text = " " + "long story " * 100 + "the end "
    found = providers.parse_extraction(providers.offline_extractor(json.dumps({"text": text})))
    assert [m["memory_text"] for m in found] == [text.strip()]


def test_facade(spark, tmp_path):
    layer = MemoryLayer(spark, str(tmp_path))
    schema = "user_id string, conv_id long, role string, content string, n long"
    first = [("u1", 1, "user", "I live in Hyderabad", 0), ("u1", 1, "assistant", "Noted", 1), ("u1", 1, "user", "I live in Delhi", 2), ("u2", 2, "user", "I use Python", 0)]
    actions = {(r.user_id, r.memory_id % 10_000): r.action for r in layer.add(spark.createDataFrame(first, schema)).collect()}
    assert sorted(actions.values()) == ["ADD", "ADD", "SUPERSEDE"]
    before = layer.memories().count()
    layer.add(spark.createDataFrame(first, schema))
    assert layer.memories().count() == before == 3
    q = spark.createDataFrame([("u1", 0, "live in Delhi"), ("u2", 1, "zebra")], "scope string, qid long, text string")
    hits = layer.search(q).filter("qid = 0").join(layer.memories().select("id", "text"), "id").orderBy("rank").collect()
    assert [h.text for h in hits] == ["I live in Delhi"]
    answers = {r.qid: r for r in layer.answer(q).collect()}
    assert answers[0].answer == "I live in Delhi" and answers[1].abstained and answers[1].answer == providers.ABSTAINED
    with pytest.raises(ScopeError):
        layer.search(spark.createDataFrame([("nobody", 0, "x")], "scope string, qid long, text string"))
    with pytest.raises(ProvenanceError):
        layer.write(layer.writes.withColumn("sources", F.array(F.lit(999).cast("long"))))


def test_ingest_resumes(spark, tmp_path):
    layer = MemoryLayer(spark, str(tmp_path))
    rows = [(k, "u1", 1, "user", f"I live in Town{k}", k) for k in range(3)]
    sessions = spark.createDataFrame(rows, "session long, user_id string, conv_id long, role string, content string, n long")
    seen = []
    assert layer.ingest(sessions.filter("session < 2"), done=lambda s, n: seen.append((s, n))) == 2
    assert layer.ingest(sessions, done=lambda s, n: seen.append((s, n))) == 1 and seen == [(0, 1), (1, 2), (2, 3)]
    assert layer.uncovered().count() == 0 and layer.version() == 3
    with pytest.raises(ConflictError):
        layer.write(layer.writes.limit(0), expected=2)
    layer.add(spark.createDataFrame([("u1", 1, "user", "I live in Elsewhere", 9)], "user_id string, conv_id long, role string, content string, n long"))
    with pytest.raises(ResumeError):
        layer.ingest(sessions)
    with pytest.raises(ScopeError):
        layer.add(spark.createDataFrame([(" ", 1, "user", "x", 1)], "user_id string, conv_id long, role string, content string, n long"))
    changed = layer.summarize(trigger=2, keep=1).collect()
    assert len(changed) == 1 and changed[0].summary_text == "I live in Town0 I live in Town1 I live in Town2"
    assert layer.summarize(trigger=2, keep=1).count() == 0 and layer.summaries.count() == 1
    with pytest.raises(SummaryError):
        layer.summarize(lambda r: " ", trigger=1, keep=0)


def test_index(spark, tmp_path):
    path = f"{tmp_path}/i"
    rows = spark.createDataFrame([("s", i, i, [1.0, float(i)]) for i in range(4)], "scope string, id long, pos long, v array<double>")
    with pytest.raises(IndexError_):
        indexes.load(spark, path, "m")
    for _ in range(3):
        indexes.save(rows, path, "m")
    assert indexes.load(spark, path, "m").dimensions == 2 and sorted(p.name for p in (tmp_path / "i").iterdir()) == ["g2", "g3"]
    with pytest.raises(StaleIndexError):
        indexes.load(spark, path, "other")
    with pytest.raises(IndexError_):
        indexes.search(indexes.load(spark, path, "m"), spark.createDataFrame([("s", 0, [1.0])], "scope string, qid long, v array<double>"), 1)
    spark.createDataFrame([("s", 9, 9, [1.0, 2.0])], rows.schema).write.mode("append").parquet(f"{path}/g3/vectors")
    with pytest.raises(IndexError_):
        indexes.load(spark, path, "m")
    with pytest.raises(IndexError_):
        indexes.save(rows.withColumn("v", F.when(F.col("id") > 0, F.col("v")).otherwise(F.array(F.lit(1.0)))), path, "m")
    with pytest.raises(EmbeddingError):
        vector.checked(rows.withColumn("model", F.lit("m")), "other")


def test_scopes(spark):
    c = spark.createDataFrame([(1, "u", "a"), (2, "v", "a"), (3, "u", "b")], "conv_id long, user_id string, name string")
    ask = lambda *rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "qid long, user_id string, name string")
    assert [(r.qid, r.conv_id) for r in scopes.resolve(ask(("u", "a"), (None, "b")), c).orderBy("qid").collect()] == [(0, 1), (1, 3)]
    for bad in (ask((None, "a")), ask(("v", "b"))):
        with pytest.raises(ScopeError):
            scopes.resolve(bad, c)


def test_migrations(spark, tmp_path):
    folder = str(tmp_path)
    assert migrations.upgrade(spark, folder, 1) == 1 and migrations.version(spark, folder) == 1
    assert migrations.upgrade(spark, folder) == len(migrations.STEPS) == migrations.upgrade(spark, folder)
    t = migrations.tables(spark, folder)
    assert dict(t["writes"].dtypes)["importance"] == "double" and "embedding" in t["messages"].columns and t["summaries"].count() == 0
    assert migrations.main([]) == 2


def test_smoke(spark, tmp_path):
    rows = evaluation.case_summary(smoke.run(spark, str(tmp_path))).first()
    assert rows.cases == len(smoke.CASES) and rows.isolation_failures == 0 and rows.hit_5 == 1.0


def test_readers(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 2}\n{"a":')
    assert sorted(r.a for r in tables.read_jsonl(spark, f"{tmp_path}/r.jsonl", "a int").collect()) == [1, 2]
    (tmp_path / "bad.jsonl").write_text('{"a":\n{"a": 2}\n{"a":')
    with pytest.raises(RecallError):
        tables.read_jsonl(spark, f"{tmp_path}/bad.jsonl", "a int")
    assert tables.read_checkpoint(spark, f"{tmp_path}/none", "a int") is None
    assert tables.jdbc_options("postgresql+psycopg://me:p%40ss@host:5432/db?x=1") == {"url": "jdbc:postgresql://host:5432/db?x=1", "user": "me", "password": "p@ss", "driver": "org.postgresql.Driver"}
    with pytest.raises(ValueError):
        tables.jdbc_options("nonsense")
    assert tables.incompatibilities({"k": 5, "m": "a"}, {"k": 5, "m": "b", "n": 1}) == ["m", "n"]
    s = spark.createDataFrame([("b", 1), ("a", 2)], "sample_id string, x int")
    assert [r.x for r in tables.select_sample(s, 0).collect()] == [2]
    df, seen = progress.counted(s, "seen", large="x > 1")
    df.collect()
    assert seen.get == {"rows": 2, "large": 1}


def test_batched_embedding(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    got = providers.embed_batches(rows, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]).collect()
    assert sorted(str(r.v) for r in got) == ["None", "[1.0, 1.0]", "[1.0, 1.0]", "[1.0, 1.0]"]
    with pytest.raises(Exception, match="one for each text"):
        providers.embed_batches(rows.filter("text is not null"), lambda: lambda texts: []).collect()
    intents = {r.qid: r for r in providers.infer_intents(asked(spark, "where do I live", "x"), lambda r, note: (_ for _ in ()).throw(TimeoutError())).collect()}
    assert intents[0].attempted and not intents[0].ok and intents[0].error_category == "timeout"


def test_config():
    with pytest.raises(ProviderError):
        config.require_provider("other")
    with pytest.raises(ProviderError):
        config.require_provider("offline", "NO_SUCH_VARIABLE_IS_SET")
    config.require_provider("offline")
    assert config.configure(recent_messages=3).recent_messages == 3
    config.reset()
    assert config.get().recent_messages == 6
    with pytest.raises(ValueError):
        config.configure(vector_multiplier=11)
    config.reset()


def test_sessions(spark, tmp_path):
    sample = [{"sample_id": "s1", "conversation": {"speaker_a": "A", "session_1_date_time": "1 May", "session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "D1:2", "text": "see", "blip_caption": "a cat"}]}}]
    (tmp_path / "x.json").write_text(json.dumps(sample))
    rows = tables.read_sessions(spark, f"{tmp_path}/x.json").withColumn("content", tables.turn_content()).orderBy("pos").collect()
    assert [r.content for r in rows] == ["[Session date: 1 May] A: hi", "[Session date: 1 May] B: see [shared image: a cat]"]


def test_pushdown(spark, sf_dir):
    df = tables.table(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in plan and "ReadSchema: struct<doc_id:bigint,lang:string>" in plan


def test_limits(spark):
    with pytest.raises(ValueError):
        search.branches(None, None, None, None, limit=0, filters=structured.Filters())  # type: ignore[arg-type]


def test_split(spark):
    marks = [chr(c) for c in range(1, 0x2FFF) if not 0xD800 <= c < 0xE000] + ["ẞ", "ﬁ", "\U00010400"]
    texts = ["", None, "ab", "cd", *[f"A{c}b {c}" for c in marks], "x", "", "Z9"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    want = [r.t for r in rows.select("i", text.tokenize(F.coalesce("text", F.lit(""))).alias("t")).orderBy("i").collect()]
    assert asked_terms.split(pa.array(texts)).to_pylist() == want
    assert asked_terms.split(pa.array(texts)[2:5]).to_pylist() == want[2:5] and asked_terms.split(pa.array([], pa.string())).to_pylist() == []


@pytest.fixture(scope="module")
def crowd(spark):
    """Documents and queries of shared words, in two scopes, and what the joins find of them."""
    words = [f"w{i}" for i in range(12)]
    docs = [("ab"[i % 2], i, " ".join(words[(i * j + j) % 12] for j in range(i % 9))) for i in range(1, 90)] + [("c", 200, "w1 w2"), (None, 201, "w1"), ("a", 202, None)]
    asks = [("ab"[i % 2], i, " ".join(words[(i + 5 * j) % 12] for j in range(i % 4 + 1)) + (" W0" if i % 3 else "")) for i in range(24)] + [("a", 50, ""), ("z", 51, "w1"), ("a", 52, "w")]
    return spark.createDataFrame(docs, "scope string, id long, text string").repartition(3), spark.createDataFrame(asks, "scope string, qid long, text string")


@pytest.mark.parametrize("cells", [1 << 21, 40])
def test_terms_go_to_the_documents(spark, crowd, monkeypatch, cells):
    docs, asks = crowd
    web = spark.createDataFrame([("a", 1, "w1 -w2"), ("a", 2, '"w1 w2" or w3'), ("b", 3, "-w5"), ("b", 4, 'w1 -"w2 w3"'), ("a", 5, "w1-w2"), ("b", 6, "w4 w4 or w4")], "scope string, qid long, text string")
    index = lexical.prepare(docs)
    parts = {
        "bm25": lambda d: lexical.bm25_topk(d, asks, 4), "and": lambda d: lexical.and_match(d, asks), "web": lambda d: lexical.web_match(d, web),
        "literal": lambda d: lexical.literal_match(d, asks), "fts": lambda d: lexical.fts_topk(d, asks, 3, web=False),
    }
    monkeypatch.setattr(asked_terms, "MOST_ASKED", -1)
    want = {n: sorted(map(tuple, f(index).collect())) for n, f in parts.items()}
    assert all(want.values())
    monkeypatch.setattr(asked_terms, "MOST_ASKED", 300_000)
    monkeypatch.setattr(asked_terms, "CELLS", cells)
    for d in (docs, index):
        for name, f in parts.items():
            assert sorted(map(tuple, f(d).collect())) == want[name], name


def test_nothing_of_postings_is_shuffled(spark, crowd):
    docs, asks = crowd
    for found in (lexical.and_match(docs, asks), lexical.literal_match(docs, asks.filter("text <> ''"))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Exchange hashpartitioning" not in plan and "Aggregate" not in plan


def test_rows_of_one_document(spark):
    docs = spark.createDataFrame([("u", 1, "red fox"), ("u", 1, "blue fox cub"), ("u", 2, "red hen")], "scope string, id long, text string")
    assert [(r.qid, r.id, r.total) for r in lexical.and_match(docs, asked(spark, "red blue", "fox")).orderBy("qid").collect()] == [(0, 1, 2), (1, 1, 2)]
    assert sorted(r.id for r in lexical.bm25_topk(docs, asked(spark, "red fox"), 5).collect()) == [1, 2]
