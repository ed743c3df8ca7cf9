"""N-gram join and line dedup against brute force, with the edge cases both state."""

import random

from pyspark.sql import functions as F

from recallspark.llm import line_dedup, ngram_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def grams(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_join(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 1.8 >= 0.8 * (len(sets[i]) + len(sets[j])) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i in range(n):
        least.setdefault(find(i), []).append(rows[i][0])
    return by_id((rows[i][0], min((x for x in least[find(i)] if x is not None), default=None), links[i]) for i in range(n))


def by_id(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x or 0) for x in r))


def near_texts(seed=1):
    r = random.Random(seed)
    out = []
    for _ in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.randrange(40, 200))]
        out.append(" ".join(base))
        for _ in range(r.randrange(6)):
            w = list(base)
            for _ in range(r.randrange(4)):
                w[r.randrange(len(w))] = f"x{r.randrange(9999)}"
            out.append(("\n" if r.random() < 0.3 else " ").join(w))
    out += ["", None, "one two", "one two", "one  two\n", "a b c d e", "a b c d e", "z" * 50_000, "q " * 30_000]
    return out


def test_join_is_brute_force(spark):
    texts = near_texts()
    rows = list(enumerate(texts))
    got = sorted(map(tuple, ngram_join.ngram_join(frame(spark, texts)).collect()))
    assert got == brute_join(rows)


def test_join_of_shared_and_missing_ids(spark):
    r = random.Random(8)
    texts = near_texts(3)
    rows = [(r.choice([None, 1, 2, 3, 4, 5, *range(6, 60)]), t) for t in texts]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, root string, own_r int")
    assert by_id(ngram_join.ngram_join(df).collect()) == brute_join(rows)
    # doc 1 has two texts; doc 2 is near the first, docs 3 and 4 are near the second
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = lambda w, x: " ".join([*w[:-1], x])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a, "x")), (3, near(b, "x")), (4, near(b, "y"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.ngram_join(df).collect())) == sorted([(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 1, 2)])
    # each text of doc 1 stands for its own class
    assert sorted(map(tuple, ngram_join.one_of_each(df).collect())) == sorted(rows[:2])


def test_one_of_each(spark):
    texts = near_texts(4)
    df = frame(spark, texts).withColumn("own_r", F.lit("clash")).withColumn("of", F.lit(1))
    classes = {d: c for d, c, _ in brute_join(list(enumerate(texts)))}
    assert sorted(r.doc_id for r in ngram_join.one_of_each(df).collect()) == sorted(d for d, c in classes.items() if d == c)
    assert ngram_join.one_of_each(df).columns == df.columns
    assert ngram_join.one_of_each(df.limit(0)).collect() == []
    none = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i"), (None, None), (None, None)], "doc_id long, text string")
    assert sorted(str(r.text) for r in ngram_join.one_of_each(none).collect()) == ["None", "None", "a b c d e f", "g h i"]


def test_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_TEXTS", 3)
    texts = near_texts(2)
    got = sorted(map(tuple, ngram_join.ngram_join(frame(spark, texts)).collect()))
    assert got == brute_join(list(enumerate(texts)))


def test_join_empty_and_repeated(spark):
    assert ngram_join.ngram_join(frame(spark, [])).collect() == []
    twice = frame(spark, ["a b c d e f", "other words stand in this one"])
    both = twice.unionByName(twice)
    assert sorted(map(tuple, ngram_join.ngram_join(both).collect())) == [(0, 0, 1), (0, 0, 1), (1, 1, 1), (1, 1, 1)]
    assert sorted(r.doc_id for r in ngram_join.one_of_each(both).collect()) == [0, 1]


def test_bands():
    b, r = ngram_join.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**r) ** b >= 0.9999


def brute_lines(rows, least=50):
    """Every run of lines of least words or more that has an earlier copy which it doesn't overlap is deleted. rows: (id, text), equal rows once."""
    docs = [(d, [(k, t.strip(" \t\n\x0b\x0c\r"), len(t.split())) for k, t in enumerate((text or "").split("\n")) if t.strip()]) for d, (_, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]
    seen, gone = {}, {}
    for d, full in docs:
        for a in range(len(full)):
            n = 0
            for b in range(a + 1, len(full) + 1):
                n += full[b - 1][2]
                if n >= least:
                    first = seen.setdefault(tuple(x[1] for x in full[a:b]), (d, a))
                    if first[0] < d or first[1] + b - a <= a:
                        gone.setdefault(d, set()).update(x[0] for x in full[a:b])
    return [(i, None if text is None else "\n".join(t for k, t in enumerate(text.split("\n")) if k not in gone.get(d, ()))) for d, (i, text) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)))]


def line_texts(seed=3):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(50)}" for _ in range(r.choice([1, 3, 10, 30, 60]))) for _ in range(14)]
    out = ["\n".join(r.choice([*lines, "", " "]) for _ in range(r.randrange(1, 14))) for _ in range(40)]
    return [*out, out[0], out[1], None, "", "\n\n", "a\n" * 400, "a\n" * 400, "long " * 20_000, "long " * 20_000]


def test_lines_are_brute_force(spark):
    for seed in (3, 9):
        texts = [t for t in line_texts(seed) if t is None or len(t) < 700 or " " in t]
        got = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, texts)).collect())
        assert got == brute_lines(list(enumerate(texts)))


def test_lines_that_overlap_their_copies(spark):
    line = " ".join(f"w{i}" for i in range(25))
    texts = ["a\n" * 400, "a\n" * 400, "b\n" * 70, "\n".join([line] * 3), "\n".join([line + " x"] * 4), "c\nd\n" * 60]
    got = [r.text for r in sorted(line_dedup.dedup_lines(frame(spark, texts)).collect())]
    # the first copy of a run stays whole: fifty words of the first, no line of the second, all of what only overlaps itself
    assert got[0].split() == ["a"] * 50 and got[1].split() == [] and got[2] == texts[2] and got[3] == texts[3]
    assert got[4] == "\n".join([line + " x"] * 2)
    assert got == [t for _, t in brute_lines(list(enumerate(texts)))]


def test_lines_without_ids(spark):
    run = "\n".join(f"{i} " + "word " * 20 for i in range(4))
    df = spark.createDataFrame([(None, run), (7, "x\n" + run), (None, run + "\ny"), (7, "z"), (-3, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.text)) for r in line_dedup.dedup_lines(df).collect())
    # null ids come last; one text keeps the run, that of doc 7
    assert got == sorted([("None", ""), ("7", "x\n" + run), ("None", "y"), ("7", "z"), ("-3", "None")])


def test_lines_edges(spark):
    assert line_dedup.dedup_lines(frame(spark, [])).collect() == []
    text = "\n".join(["word " * 30, "other " * 30])
    df = frame(spark, [text, "x\n" + text])
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[0].text == text and out[0].n_deleted == 0
    assert out[1].text == "x" and out[1].n_chars == 1 and out[1].n_deleted == 2
    same = frame(spark, [text])
    assert [r.n_deleted for r in line_dedup.dedup_lines(same.unionByName(same)).collect()] == [0, 0]
    assert [r.doc_id for r in line_dedup.dedup_lines(frame(spark, [text, text]), drop_emptied=True).collect()] == [0]
    clash = df.withColumn("rank", df.doc_id).withColumn("marks", df.doc_id).withColumn("row", df.text)
    assert line_dedup.dedup_lines(clash).columns == [*clash.columns, "n_deleted"]
    again = line_dedup.dedup_lines(line_dedup.dedup_lines(df))
    assert again.columns == [*df.columns, "n_deleted"] and sorted(r.n_deleted for r in again.collect()) == [0, 0]
