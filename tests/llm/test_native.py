"""Chat formatting, mixing, quality rules and license scans against brute force, with the edge cases each states."""

import hashlib
import json
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from recallspark.llm import chat, licenses, mixing, quality

DOCS = "doc_id long, text string, lang string, source string"


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# chat

NASTY = ["", None, "plain", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|> <\\\\|x", "ends with <", "|starts", "a\nb\n", "\\n \\\\", "日本 😀<|im_end|>\n", "<" * 50 + "|"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    rows = [(c, t, r, NASTY[(c * 3 + t) % len(NASTY)]) for c in range(8) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(100, 0, None, "x"), (100, 0, "assistant", "same turn"), (100, 0, "assistant", "same turn"), (101, 0, "us\ner\\|<|", "odd role")]
    out = chat.format_chats(chat.conversation_records(conversations(spark, rows)))
    no_python(out)
    got = {r.conv_id: r for r in out.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("learnt", chat.loss_texts(F.col("formatted"), F.col("loss"))).collect()}
    for c in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        assert [(t.role, t.text) for t in got[c].read] == turns
        assert list(got[c].learnt) == [t for r, t in turns if r == "assistant"]
        assert got[c].formatted.count("<|im_end|>") == len(turns)
    assert chat.chat_digest(out.limit(0)).collect() == []


def test_chat_digest(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a")]
    r = chat.chat_digest(chat.format_chats(chat.conversation_records(conversations(spark, rows)))).first()
    assert r.turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest() and r.loss_chars == 1 and r.n_turns == 2


def test_layouts(spark):
    records = [
        ({"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, "messages"),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "sharegpt"),
        ({"prompt": "q", "completion": "a"}, "prompt_completion"), ({"prompt": "q", "response": "a"}, "prompt_response"),
        ({"instruction": "q", "output": "a"}, "instruction"), ({"instruction": "q", "input": "", "output": "a"}, "instruction_input"),
        ({"system": None, "prompt": "q", "response": "a"}, "system_prompt"), ({"prompt": "q", "chosen": {"role": "assistant", "content": "a"}}, "nested_chosen"), ({"who": 1}, None),
    ]
    df = spark.createDataFrame([(i, json.dumps(r), n) for i, (r, n) in enumerate(records)], "i int, j string, want string").withColumn("record", F.parse_json("j"))
    out = chat.format_chats(df).orderBy("i").collect()
    assert [r.layout for r in out] == [n for _, n in records]
    for r in out[:-1]:
        assert [(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")]
    assert out[-1].formatted is None and len({r.fingerprint for r in out}) == len(records)


def test_mixed_layouts_in_one_table(spark):
    turns = [("user", "q"), ("assistant", "a")]
    records = [
        ('{"messages": [{"role": "user", "content": "q", "name": "x"}, {"role": "assistant", "content": "a"}]}', "messages", turns),
        ('{"id": 7, "source": "s", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "weight": 1}]}', "messages", turns),
        ('{"messages": []}', "messages", []), ('{"id": 1, "messages": []}', "messages", []), ('{"conversations": []}', "sharegpt", []),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}', "message_parts", [("user", "q"), ("assistant", "ab")]),
        ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}], "id": "1"}', "sharegpt", turns),
        ('{"instruction": "q", "output": "a"}', "instruction", turns), ('{"messages": [{"role": "user", "text": "q"}]}', None, None), ("not json", None, None), (None, None, None),
    ]
    df = spark.createDataFrame([(i, r, "clash", "clash") for i, (r, _, _) in enumerate(records)], "i int, j string, turns string, chat string").withColumn("record", F.try_parse_json("j"))
    out = chat.format_chats(df)
    no_python(out)
    rows = out.orderBy("i").collect()
    for r, (_, layout, want) in zip(rows, records, strict=True):
        assert r.layout == layout and r.chat == "clash"
        assert (None if r.turns is None else [(t.role, t.text) for t in r.turns]) == want
        assert (r.formatted is None) == (want is None) and (want != [] or r.formatted == "")
    assert sorted(map(str, chat.format_chats(df.unionByName(df)).collect())) == sorted(map(str, [*rows, *rows]))
    assert chat.format_chats(df.limit(0)).collect() == []


# mixing

def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    goal = min(share, most) * sum(sizes.values())
    target, full = {}, set()
    while True:
        left = goal - sum(most * sizes[s] for s in full)
        total = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * w[s] / total for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        full |= over


def test_mix(spark):
    r = random.Random(1)
    rows = [(i, " ".join("w" * r.randrange(1, 4) for _ in range(r.randrange(60))), "en", r.choice(["b", "a", "Z", "é", None, "d", "d", "d", "d"])) for i in range(600)]
    rows += [(900, None, "en", "a"), (901, "", "en", None), (902, "tiny", "en", "alone")]
    df = spark.createDataFrame(rows, DOCS)
    out = mixing.mix(df)
    no_python(out)
    got = {x.doc_id: x for x in out.collect()}
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    sizes = {}
    for i, _, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    for s in sizes:
        mine = [i for i, _, _, x in rows if x == s]
        taken = sum(got[i].taken for i in mine)
        assert all(abs(got[i].target - want[s]) < 1e-6 * max(1, want[s]) and got[i].source_size == sizes[s] for i in mine)
        assert abs(taken - want[s]) <= 60 and all(got[i].taken <= 2 * size[i] for i in mine)
        epochs = math.floor(want[s] / sizes[s]) if sizes[s] else 0
        assert all(got[i].taken in (epochs * size[i], (epochs + 1) * size[i]) for i in mine)
    assert sorted(map(tuple, mixing.mix(df.repartition(7)).collect())) == sorted(map(tuple, out.collect()))
    repeated = mixing.mixed_documents(df)
    assert repeated.columns == df.columns and repeated.count() == sum(x.taken // x.size for x in got.values() if x.size)
    assert mixing.mix(df.limit(0)).collect() == []


# quality

def brute_stats(text):
    text = text or ""
    space = " \t\n\x0b\x0c\r"
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(space)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def quality_rows():
    r = random.Random(2)
    rows = [(i, "\n".join(" ".join("abcdefgh"[: r.randrange(2, 8)] + str(r.randrange(999)) for _ in range(r.randrange(4, 9))) for _ in range(r.randrange(4, 14))), "en", "s") for i in range(400)]
    line = "one two three four five six seven eight nine ten"
    rows += [(1000, "###$$ " * 100 + " ".join(f"w{i}" for i in range(40)), "en", "s"), (1001, None, None, None), (1002, "", "en", "s"), (1003, (line + "\n") * 30, "en", "s"), (1004, "x" * 100_000, "de", "t"), (1005, "a b " * 30_000, "de", "t"), (1006, line + " x " + line, "en", "s"), (1007, "nbsp joined 日本\x0btab\tcr\r\n" * 3, "en", "s")]
    return rows


def test_quality_base(spark):
    rows = quality_rows()
    out = quality.quality_verdicts(spark.createDataFrame(rows, DOCS))
    no_python(out)
    got = {x.doc_id: x for x in out.collect()}
    for i, t, _, _ in rows:
        x = got[i]
        want = brute_stats(t)
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, i
        assert x.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0]) and not (x.base_failed and x.kept)
    assert not got[1000].kept and sum(got[i].kept for i in range(400)) >= 398
    assert quality.quality_verdicts(spark.createDataFrame([], DOCS)).collect() == []


def test_mcd_is_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(5000, [800, 300, 900, 200, 400], (300, 5)), rng.normal(20000, 500, (60, 5))]).round().astype(int)
    df = spark.createDataFrame([("k", *map(int, r)) for r in x], "key string, q0 int, q1 int, q2 int, q3 int, q4 int")
    got = quality.fit_mcd(df).first()
    m = np.median(x, axis=0)
    mad = np.median(np.abs(x - m).astype(int), axis=0)
    floor = np.array(quality.LEAST_SD) * quality.GRID
    factor = 0.75 / quality.chi2_cdf(quality.chi2_quantile(0.75, 5), 7)
    found = []
    for v in (np.diag(np.maximum(1.4826 * mad, floor) ** 2), np.diag(floor**2)):
        at = m
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - at, np.linalg.inv(v), x - at)
            b = np.floor(np.log1p(d) * quality.DIST_GRID)
            near = x[b <= np.percentile(b, 75)]
            at, v = near.mean(axis=0), factor * np.cov(near.T, bias=True) + np.diag(floor**2)
        found.append((round(np.log(np.diag(np.linalg.cholesky(v))).sum(), 9), len(found), at, v))
    _, _, m, v = min(found, key=lambda f: f[:2])
    c = np.linalg.cholesky(v)
    assert np.allclose([got[f"m{i}"] for i in range(5)], m) and np.allclose([got[f"c{i}{j}"] for i in range(5) for j in range(i + 1)], [c[i, j] for i in range(5) for j in range(i + 1)])


# licenses

def brute_license(text):
    """Every window of every length within the bounds against every template."""
    w = re.findall(r"[^\W_]+", (text or "").lower())
    grams = [f"{a} {b}" for a, b in zip(w, w[1:])]
    best = 0.0
    for t in licenses.prepared():
        theirs = set(t.grams)
        for n in range(math.ceil(len(theirs) * 2 / 3), math.floor(t.length * 1.5) + 1):
            for i in range(max(1, len(grams) - n + 1)):
                mine = set(grams[i : i + n])
                if mine:
                    best = max(best, 2 * len(mine & theirs) / (len(mine) + len(theirs)))
    return best


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-2.0-or-later"]
    comment = lambda t, mark: "\n".join(f"{mark} " + " ".join(t.split()[i : i + 9]) for i in range(0, len(t.split()), 9))
    rows = [
        (0, "text\nLicensed under the Apache License, Version 2.0.\nmore"), (1, "ALL rights -- reserved!"), (2, "x y z\n\n" + mit[:200] + "\n" + mit[200:] + "\n\nend of it"), (3, None), (4, ""), (5, "word " * 20_000),
        (6, "all rights"), (7, "Released under the MIT License.\n" * 3), (8, "Copyright 2020 Jane Doe. Released under the MIT License."), (9, "int x;\n" + comment(gpl, " *") + "\nint main() { return 0; }"), (10, "# " * 500 + comment(mit, "#") + " and on it goes " * 50),
        (11, "filler words " * 3000 + licenses.TEMPLATES["BSD-3-Clause-full"].replace("conditions", "terms") + " tail" * 500), (12, mit.replace("Software", "Program").replace("copies", "exemplars")), (13, "this text speaks of the software and of the rights of the people under the terms of the law"),
    ]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, license int, grams string")
    out = licenses.scan(df)
    no_python(out)
    got = {r.doc_id: r for r in out.collect()}
    want = {0: "Apache-2.0-notice", 1: "All-rights-reserved", 2: "MIT", 7: "MIT-notice", 8: "MIT-notice", 9: "GPL-2.0-or-later", 10: "MIT", 11: "BSD-3-Clause-full"}
    assert {i: r.license for i, r in got.items() if r.license and i != 12} == want
    assert got[2].word == 3 and got[2].dice > 0.95 and got[8].word == 4 and got[3].n_licenses == 0
    for i, t in rows:
        if len(t or "") < 3000:
            best = brute_license(t)
            # a window of three lengths finds what reaches the threshold clearly, and nothing that does not reach it
            assert (got[i].dice is not None or best < 0.83) and (got[i].dice is None or 0.8 <= got[i].dice <= best + 1e-6), i
    twice = licenses.scan(df.unionByName(df))
    assert sorted(str(r) for r in twice.collect()) == sorted(str(r) for r in [*got.values(), *got.values()])
    assert licenses.scan(df.limit(0)).collect() == []
