"""SentencePiece codec: parity with the reference implementation, round trips, edge cases."""

import random

import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from recallspark.llm import sentencepiece_codec as codec

TEXTS = ["", " ", "a", "  two  spaces ", "line\nbreak\ttab", "ünïcode ñandú 日本語 😀", "▁mark ▁▁ itself", "<s> </s> <0x0A> <unk>", "x" * 3000, "word " * 5000, *[" " * n + "the" for n in range(40)]]


def test_parity_and_round_trip():
    r = random.Random(4)
    more = ["".join(r.choice("ab ▁\n\tüß日😀<s>he in \x00") for _ in range(r.randrange(50))) for _ in range(500)]
    assert codec.parity(TEXTS + more) == []
    c = codec.load()
    for t in TEXTS:
        if "▁" not in t:
            ids = c.encode([t])[0]
            assert c.decode([ids]) == [t]


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(codec, "SLICE", 40)
    r = random.Random(6)
    texts = ["".join(r.choice(["word", " ", "  ", "ü", "\n", "日本", "a", " the"]) for _ in range(r.randrange(400))) for _ in range(200)] + ["x" * 500, " " * 300]
    c = codec.load()
    assert codec.parity(texts) == []
    chunks = c.encode_chunks(texts)
    assert max(map(len, chunks)) > 5
    assert c.decode_chunks(chunks) == texts


def unigram_model(path, byte_fallback):
    m = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    if byte_fallback:
        for i in range(256):
            m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=6)
    for i, p in enumerate(["▁", "▁the", "▁a", "th", "he", "ing", "in", "g", "t", "h", "e", "a", "n", "i", "▁then"]):
        m.pieces.add(piece=p, score=-1.0 - 0.37 * i, type=1)
    m.trainer_spec.model_type = 1
    m.trainer_spec.byte_fallback = byte_fallback
    m.normalizer_spec.name = "identity"
    m.normalizer_spec.remove_extra_whitespaces = True
    path.write_bytes(m.SerializeToString())
    return str(path)


def test_unigram_models(tmp_path):
    r = random.Random(5)
    texts = ["the thing", "  then   a ", "hé", "", *("".join(r.choice("thein ag é") for _ in range(r.randrange(25))) for _ in range(300))]
    path = unigram_model(tmp_path / "u.model", True)
    theirs, ours = sentencepiece.SentencePieceProcessor(model_file=path), codec.Codec(path)
    assert ours.encode(texts) == theirs.encode(texts)


def test_operator(spark):
    rows = [(i, t, "clash") for i, t in enumerate([*TEXTS, None])]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in codec.encode(df, decoded=True).collect()}
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    for i, t, _ in rows:
        if t is None:
            assert out[i].token_ids is None and out[i].n_tokens == 0 and out[i].round_trip is None and out[i].decoded is None
        else:
            assert out[i].token_ids == sp.encode(t) and out[i].n_tokens == len(out[i].token_ids) and out[i].decoded == sp.decode(sp.encode(t))
            assert out[i].round_trip == (sp.decode(sp.encode(t)) == t)
    assert codec.encode(df.limit(0)).collect() == []
    same = codec.encode(df.unionByName(df)).count()
    assert same == 2 * len(rows)
