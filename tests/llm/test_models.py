"""Nearest neighbours, personal data, toxicity and the pipeline: brute force, planted cases, held-out accuracy, edge cases."""

import hashlib
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from recallspark.llm import ann, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_nearest_is_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 16))
    x[100:300] = x[100] + rng.normal(scale=0.02, size=(200, 16))
    x[300:340] = x[300]
    rows = [(i, [float(v) for v in np.float32(r)], 0) for i, r in enumerate(x)]
    rows += [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0] * 3, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    v = np.float32(x).astype(float)
    assert set(got) == set(range(0, 900, 20))
    hit = total = 0
    for q, found in got.items():
        s = v @ v[q]
        s[q] = -np.inf
        want = sorted(range(900), key=lambda i: (-round(s[i], 9), i))[:20]
        hit += len({i for i, _ in found.values()} & set(want))
        total += 20
        assert [found[k][1] for k in range(1, 21)] == sorted((z for _, z in found.values()), reverse=True)
        assert all(abs(found[k][1] - s[found[k][0]]) < 1e-9 for k in found)
    assert hit / total >= 0.99


def test_nearest_few(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 20), (0, 2, 3), (0, 3, 3), (20, 1, 0), (20, 2, 3), (20, 3, 3)]
    assert ann.nearest(df.limit(0)).collect() == []


def test_nearest_repeated_query(spark):
    x = np.float32(np.random.default_rng(2).normal(size=(60, 8)))
    for repeats in (2, 25):
        rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(0, [float(v) for v in x[0]])] * (repeats - 1)
        rows += [(20, [float(v) for v in x[20] * (2 + 0.1 * k)]) for k in range(repeats - 1)] + [(100 + k, [float(v) for v in x[0]]) for k in range(3)]
        q = spark.createDataFrame([rows[0], rows[20]], "vec_id long, embedding array<float>")
        got = {}
        for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), q).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        for a in (0, 20):
            v = x[a].astype(float)
            want = sorted(((-round(float(np.dot(np.float64(np.float32(e)), v)), 9), i) for i, e in rows if i != a))[:20]
            assert got[a] == [i for _, i in want]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and pii.luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if ok:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda s: (s[0], s[2]))


def test_base_spans_are_brute_force():
    r = random.Random(3)
    for _ in range(20_000):
        text = "".join(r.choice(["a@b.c", "@", "x.y", "1.2.3.4", "256.", "4539 1488 0343 6467", "+1 (555) 123-4567", "0", "12", "-", " ", ".", "(", "é", "+", "%a"]) for _ in range(r.randrange(12)))
        assert [s for s in pii.base_spans(text)] == brute_spans(text), text


def test_personal_data(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} {word()} kontakt via mail an {word()}@{word()}.org {word()}", "x") for i in range(30)]
    rows += [(100, f"{word()} kontakt via mail an jo at example dot org heute", "x"), (101, f"see {word()} at home dot matrix printer", "x"), (102, None, "x"), (103, "", "x"), (104, "1" * 100_000, "x"), (105, "+" + "1 " * 50_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {x.doc_id: x for x in pii.find_personal_data(df).collect()}
    for i, t, _ in rows:
        spans = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, b, k in brute_spans(t))
        assert got[i].base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert got[i].n_email == spans.count("email") and got[i].n_card == spans.count("card")
    assert got[100].n_added == 1 and rows[30][1][int(got[100].spans.split(":")[1]) :].startswith("jo at example dot org")
    assert got[101].n_added == 0
    # repeated rows and rows without an id get the same
    again = pii.find_personal_data(df.unionByName(df).unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))).groupBy("doc_id", "spans").count().collect()
    assert sum(r["count"] for r in again) == 3 * len(rows) and {(r.doc_id, r.spans) for r in again if r.doc_id is not None} == {(i, x.spans) for i, x in got.items()}
    assert pii.find_personal_data(df.limit(0)).collect() == []


def test_personal_data_shapes(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} kontakt via mail an {word()}@{word()}.org {word()}") for i in range(30)]
    rows += [(100 + i, f"{word()} bitte ruf an unter +49 170 {2000000 + i} danke {word()}") for i in range(30)]
    shapes = ["jo (at) example.com", "jo at example.com", "0049 170 1234567", "01701234567"]
    rows += [(200 + i, f"{word()} {'kontakt via mail an' if i < 2 else 'bitte ruf an unter'} {s} danke") for i, s in enumerate(shapes)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.find_personal_data(df).collect()}
    text = dict(rows)
    for i, s in enumerate(shapes):
        at = text[200 + i].index(s)
        assert f"{'email' if i < 2 else 'phone'}:{at}:{at + len(s)}" in got[200 + i].split(",")


def brute_slots(text, known):
    """{(start, end, kind): patterns} of every token end that a known (words, kind) ends at."""
    found = {}
    for m in re.finditer(r"\w+|[^\w\s]", text):
        recent = [re.sub("[0-9]", "0", t.lower()) for t in re.findall(r"\w+|[^\w\s]", text[max(0, m.end() - 60) : m.end()])]
        run = re.match(r"\s*(\S+)", text[m.end() :])
        word = run[1].strip(".,;:!?()[]{}<>\"'") if run else ""
        if 5 <= len(word) <= 64 and any(c == "@" or c.isdigit() for c in word):
            start = m.end() + run.start(1) + run[1].index(word)
            for words, kind in known:
                if recent[-len(words.split(" ")) :] == words.split(" "):
                    found.setdefault((start, start + len(word), kind), set()).add(f"{pii.KINDS[kind]}|{words}|")
    return found


def test_slots_are_brute_force():
    r = random.Random(11)
    pieces = ["an", "mail", "Nr", "NO", "(", " ", "  ", "\n", ":", ".", '"', "-", "@", "jo17", "12", "3456", "²", "①", "٣٤", "😀", "𝟗𝟖", "Σ", "é", "ab12cd", "#17#", "x" * 30, "9" * 70]
    parts = ["an", "mail", "nr", "no", "(", ":", ".", "@", "0", "0000", "jo00", "é", "-", "#", "😀"]
    some = 0
    for _ in range(4000):
        known = {(" ".join(r.choice(parts) for _ in range(r.choice([2, 2, 3]))), r.randrange(4)) for _ in range(r.choice([5, 200]))}
        text = "".join(r.choice(pieces) + r.choice(["", "", " "]) for _ in range(r.randrange(30)))
        want, last = [], {}
        for (a, b, k), ps in sorted(brute_slots(text, known).items()):
            if a >= last.get(k, 0):
                want.append((a, b, k, sorted(ps)))
                last[k] = b
        assert pii.Slots([f"{pii.KINDS[k]}|{w}|" for w, k in known])(text, lambda t: []) == want, (text, known)
        some += bool(want)
    assert some > 100


def test_slots_cost_does_not_grow_with_patterns():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghäß") for _ in range(5)) for _ in range(5000)]
    text = " ".join(r.choice(words) for _ in range(200_000)) + " k77k77"
    slots = pii.Slots([f"email|{a} {b}|" for a, b in zip(words, words[1:], strict=False)])
    began = time.process_time()
    assert slots(text, lambda t: []) == []
    took = time.process_time() - began
    # far less than to cut the text in tokens
    assert len(re.findall(r"\w+|[^\w\s]", text)) == 200_001
    assert took < time.process_time() - began - took


def test_patterns_discover_other_shapes(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = [(i, f"{word()} bitte schreib mir an {word()}@{word()}.org {word()}") for i in range(30)]
    rows += [(100 + i, f"{word()} die rechnung nummer {'4539148803436467' if i % 2 else word() + str(i) + 'x9'} von {word()}") for i in range(30)]
    rows += [(200, "dort: bitte schreib mir an jo#17#example, danke"), (201, "und jo#17#example allein"), (202, "rechnung nummer k77k77 von dort")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.spans for x in pii.find_personal_data(df).collect()}
    # no candidate has this shape; the words before it say what it is
    at = rows[60][1].index("jo#17#example")
    assert got[200] == f"email:{at}:{at + 13}" and got[201] == ""
    # too many different things follow these words
    assert got[202] == ""


def toxic_rows(n=900):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(20, 60))]
        bad = i % 9 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["idiot", "scum", "grubzo" + r.choice(["ta", "ri", "len"]), "moron"]))
        docs.append((i, " ".join(words), "en", "s", 0))
        if i % 3:
            labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows(1600)
    extra = [(5000, None, "en", "s", 0), (5001, "", "en", "s", 0), (5002, "clean " * 20_000, "en", "s", 0)]
    d, lab = spark.createDataFrame(docs + extra, DOCS), spark.createDataFrame([(i * 1, q, t) for i, q, t in labels] + [(i, 1, 1) for i in range(0, 1600, 27)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, lab).collect()}
    truth = {i: int(i % 9 == 0) for i, *_ in docs}
    held = [i for i in truth if out[i].held_out]
    right = sum(out[i].predicted == truth[i] for i in held) / len(held)
    assert right >= 0.96 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert all(out[i].predicted == 0 for i in (5000, 5001, 5002))
    assert toxicity.toxicity(d.limit(0), lab).collect() == []


def test_toxicity_reruns_alike(spark):
    docs, labels = toxic_rows(500)
    d, lab = spark.createDataFrame(docs + docs[:40], DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    one = sorted(map(tuple, toxicity.toxicity(d, lab).collect()))
    two = sorted(map(tuple, toxicity.toxicity(d.repartition(7, "text"), lab.repartition(3)).collect()))
    assert one == two
    clash = d.withColumn("score", F.lit("s")).withColumn("row", F.lit(1))
    kept = toxicity.without_toxic(clash, lab)
    assert kept.columns == clash.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(x[0] for x in one if x[3] == 0)


def test_toxic_rows_go_by_their_own_text(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: {"weights": {"idiot": 9.0}, "bias": -4.0})
    bad, good = "what an idiot this is", "what a day this is"
    d = spark.createDataFrame([(1, bad), (1, good), (None, bad), (None, good), (None, None), (2, "")], "doc_id long, text string")
    kept = [r.text for r in toxicity.without_toxic(d, d).collect()]
    assert sorted(map(str, kept)) == sorted(["None", "", good, good])


def test_the_label_model_decides(spark, monkeypatch):
    docs, labels = toxic_rows(900)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def hits():
        return sum(r.predicted == 1 for r in toxicity.toxicity(d, lab).collect() if r.held_out and r.doc_id % 9 == 0)

    found = hits()
    monkeypatch.setattr(toxicity.LabelModel, "posterior", lambda self, votes: np.full(len(votes), 0.1))
    assert hits() == 0 and found >= 10


def test_unit_counts_merge_only_copies(spark):
    rows = [(f"aaaa bbbb cccc word{chr(97 + i % 26)}{chr(97 + i // 26)}", float(i % 2)) for i in range(200)] + [("eeee ffff", 1.0), ("eeee ffff", 0.0), ("", 1.0), (None, 1.0)]
    got = {r.u: (r.n, r.p) for r in toxicity._unit_counts(spark.createDataFrame(rows, "text string, w double")).collect()}
    assert got["aaaa"] == (200, 100.0) and got["eeee"] == (1, 0.5)
    assert all(got[t.split()[-1]] == (1, w) for t, w in rows[:200])


def test_tokens_are_the_matches():
    brute = lambda t: set(re.findall(r"[^\W\d_]+", t.lower()))
    for c in map(chr, range(0x110000)):
        if not 0xD800 <= ord(c) < 0xE000:
            assert toxicity.tokens(f"aB{c}c") == brute(f"aB{c}c"), c
    r = random.Random(14)
    pieces = ["Idiot", "é", "ß", "İ", "Σ", "大", "字", "।", "ñ", "\u0301", "²", "½", "٣", "7", "_", "-", " ", "\n", "\xa0", "\u2003", "“", "”", "…", "😀", "\x85", "\x1c", "𝐀"]
    for _ in range(3000):
        t = "".join(r.choice(pieces[: r.choice([10, 27])]) for _ in range(r.randrange(40)))
        assert toxicity.tokens(t) == brute(t), t
    many = "a".join(chr(0x2190 + i) for i in range(300))
    assert toxicity.tokens(many) == {"a"} and toxicity.tokens(None) == toxicity.tokens("") == set()


def test_lookup_is_brute_force(monkeypatch):
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", 50)
    r = random.Random(15)
    word = lambda: "".join(r.choice("abé") for _ in range(r.randrange(1, 11)))
    cut = [(word(), r.choice((0, *toxicity.PREFIXES))) for _ in range(300)]
    table = {w[:n] + "*" if 0 < n < len(w) else w: i % 9 for i, (w, n) in enumerate(cut)}
    look = toxicity.Lookup(table)
    for _ in range(500):
        found = {word() for _ in range(r.randrange(20))}
        assert look(found) == {table[u] for w in found for u in (w, *(w[:n] + "*" for n in toxicity.PREFIXES if len(w) > n)) if u in table}


def test_words_are_neither_matched_nor_looked_up_one_by_one(monkeypatch):
    tried = []

    class Table(dict):
        def __contains__(self, u):
            tried.append(u)
            return super().__contains__(u)

    class Pattern:
        def findall(self, text):
            raise AssertionError("cut by the pattern")

    monkeypatch.setattr(toxicity, "_TOKEN", Pattern())
    r = random.Random(16)
    words = ["".join(r.choice("abcdefghäß") for _ in range(r.randrange(3, 10))) for _ in range(20_000)]
    look = toxicity.Lookup(Table({"idiot": 0, "abcd*": 1}))
    found = [look(toxicity.tokens(" ".join(words[i : i + 200]) + (" idiot." if i == 400 else ""))) for i in range(0, len(words), 200)]
    assert [0 in f for f in found] == [i == 2 for i in range(100)] and any(1 in f for f in found)
    # only beginnings of words that start as the one in the table does
    assert len(tried) < len(words) // 20 and all(u.startswith("abc") for u in tried)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(6)
    y = rng.random(20_000) < 0.2
    p = np.array([[0.02, 0.7], [0.02, 0.7], [0.05, 0.6], [0.1, 0.5]])
    x = rng.random((len(y), 4)) < p[:, y.astype(int)].T
    x[:, 1] = np.where(rng.random(len(y)) < 0.8, x[:, 0], x[:, 1])  # the first two are correlated
    votes = (x * (1 << np.arange(4))).sum(axis=1)
    v, n = np.unique(votes, return_counts=True)
    known = np.zeros((len(v), 2))
    for i in range(300):
        known[np.searchsorted(v, votes[i]), int(y[i])] += 1
    model = toxicity.LabelModel(4).fit(v, n.astype(float), known)
    assert np.abs(model.rate - p).max() < 0.12 and (model.parent[1] == 0 or model.parent[0] == 1)


def test_label_model_with_labels_of_one_kind():
    # clean rows, which never fire, have labels for the most part; the rows that fire have none
    votes, counts, known = np.array([0, 1, 2, 3]), np.array([800.0, 50, 10, 40]), np.array([[480.0, 0], [0, 0], [0, 0], [0, 0]])
    p = toxicity.LabelModel(2).fit(votes, counts, known).posterior(votes)
    assert p[0] < 0.1 and p[1:].min() > 0.9


def test_training_texts_need_no_label(spark):
    rows = [(i, f"text {i % 300}") for i in range(600)] + [(None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.text for r in toxicity._training_texts(d, len(rows), 1000).collect()]
    free = {r.text for r in d.filter(F.coalesce(~toxicity.held_out(F.col("doc_id")), F.lit(True))).collect()}
    assert len(got) == len(set(got)) and set(got) == free
    assert [r.text for r in toxicity._training_texts(d, len(rows), 50).collect()] == got[:50]


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "ngram_join", "source_mixing", "sentencepiece"]
    docs, labels = toxic_rows(450)
    passage = "\n".join(" ".join(f"p{i}{j}" for j in range(20)) for i in range(4))
    docs += [(10_000, "first words\n" + passage, "en", "s", 0), (10_001, "other words\n" + passage, "en", "t", 0), (10_002, docs[1][1], "en", "s", 0), (10_003, docs[1][1] + " more", "en", "s", 0)]
    spark.createDataFrame(docs, DOCS).withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    full = spark.read.parquet(f"{tmp_path}/documents.parquet")
    df = full
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "sentencepiece":
            assert out.columns == full.columns
        if name == "line_dedup":
            texts = {r.doc_id: r for r in out.collect()}
            assert texts[10_001].text == "other words" and texts[10_001].n_chars == 11 and passage in texts[10_000].text
        if name == "ngram_join":
            ids = [r.doc_id for r in out.collect()]
            assert 10_003 not in ids and len(ids) == len(set(ids))
        df = out
    assert df.filter("token_ids is null").count() == 0
    rows = sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert rows == sorted(r.doc_id for r in df.collect())


def test_pipeline_stages_take_anything(spark, tmp_path):
    docs, labels = toxic_rows(120)
    run = "\n".join(f"{i} " + " ".join(f"r{i}{j}" for j in range(20)) for i in range(4))
    odd = [(None, None, None, None, None), (None, "", "en", None, 0), (None, run, "en", "s", 1), (5, run + "\nmore", "en", "s", 1), (5, run, "en", "s", 1), (7, "x " * 30_000, "en", "t", 1), (8, "\n\n", "en", "t", 1)]
    clash = "row of mix_row own_id own_key own_r score text_key n_deleted marks tie".split()
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame([*docs, *odd, *odd], DOCS).withColumns({c: F.lit(c) for c in clash})
    for table, least in ((df, 1), (df.limit(0), 0)):
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, str(tmp_path))
            rows = out.collect()
            assert len(rows) >= least, name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns, name
                assert all(r.mix_row == "mix_row" and r.tie == "tie" for r in rows), name
