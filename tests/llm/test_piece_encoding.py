"""Offset-preserving encoding against the library itself: ids, spans and decoded texts, with the given model and with compiled character maps."""

import hashlib
import random

import pytest

from lumentrace.llm import queries
from lumentrace.llm.piece_encoding import CharacterMap, Model, decode, encode

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")
PATH = tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "the", " ", "  ", "\t", "\n", "▁", "é", "日本", "́", "😀", "ﬁ", "Å", "ガ", "①", "　", " ", "\x00", "<s>", "<0x0A>", "<unk>", "x" * 70, "ing", "​", "Ⅷ", "½", "�", "ｱﾞ"]


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["", " ", "   ", "　", "▁▁", " ▁ ", "no " * 3000, "z" * 5000] + ["".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def spans(processor, text):
    """(id, begin, end in bytes) as the library tells them."""
    return [(p.id, p.begin, p.end) for p in processor.encode(text, return_type="proto").pieces]


def own(model, text):
    return list(zip(*(x.tolist() for x in model.encode(text))))


def test_ids_and_spans():
    blob = open(PATH, "rb").read()
    model, processor = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert model.by_word
    for t in texts(400):
        assert own(model, t) == spans(processor, t)


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("squeeze", [False, True])
def test_compiled_maps(rule, squeeze):
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    told, given = proto.ModelProto(), proto.ModelProto()
    told.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    given.ParseFromString(open(PATH, "rb").read())
    given.normalizer_spec.CopyFrom(told.normalizer_spec)
    given.normalizer_spec.remove_extra_whitespaces, given.normalizer_spec.escape_whitespaces = squeeze, True
    blob = given.SerializeToString()
    model, processor = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert model.map.longest("ﬁ".encode(), 0) == (3, "fi") and CharacterMap(b"").longest(b"a", 0) is None
    for t in texts(250):
        assert own(model, t) == spans(processor, t)


def test_models_that_are_merged_as_a_whole():
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    given = proto.ModelProto()
    given.ParseFromString(open(PATH, "rb").read())
    given.trainer_spec.byte_fallback = False
    for p in given.pieces:
        p.type = 5 if p.type == 6 else p.type
    given.pieces[300].type, given.pieces[278].type, given.pieces[500].type = 5, 5, 4
    blob = given.SerializeToString()
    model, processor = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    assert not model.by_word
    for t in texts(250, 5):
        assert own(model, t) == spans(processor, t)
    given.trainer_spec.model_type = 1
    with pytest.raises(ValueError):
        Model(given.SerializeToString())


def test_decoding():
    blob = open(PATH, "rb").read()
    model, processor = Model(blob), sentencepiece.SentencePieceProcessor(model_proto=blob)
    rng = random.Random(8)
    seen = 0
    for t in texts(300, 11):
        ids = processor.encode(t)
        assert model.decode(ids) == processor.decode(ids)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, 13, 28705, 259, rng.randrange(3, 259), rng.randrange(259, 32000)]) if rng.random() < 0.1 else rng.randrange(259, 32000) for _ in range(rng.randrange(0, 12))]
        got = model.decode(ids)
        seen += got is None
        assert got is None or got == processor.decode(ids)
    assert 0 < seen < 1500


def test_query(spark, tmp_path):
    processor = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t) for i, t in enumerate(texts(40))] + [(90, None), (None, "null id"), (7, "again"), (7, "again")]
    spark.createDataFrame([(i, t, "clash", [1], 2) for i, t in rows], "doc_id long, text string, id string, ids array<int>, `a.b` int").write.parquet(str(tmp_path / "documents.parquet"))

    def told(i, t):
        ids = processor.encode(t or "")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(",".join(map(str, ids))), sha(processor.decode(ids))

    got = [tuple(r) for r in queries.op11_offset_pieces(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted((told(*r) for r in rows), key=repr)


def test_spans_point_into_the_text(spark):
    docs = spark.createDataFrame([(1, "Ein  Wörterbuch 日本 \x00"), (2, ""), (3, None)], "`a.b` int, `t``x` string")
    got = {r["a.b"]: r for r in decode(encode(docs, PATH, "a.b", "t`x"), PATH).collect()}
    raw = "Ein  Wörterbuch 日本 \x00".encode()
    assert b"".join(raw[b:e] for b, e in zip(got[1].begins, got[1].ends)) == raw and got[1].decoded == raw.decode()
    assert got[2].ids == got[3].ids == [] and got[3].decoded == ""
    assert encode(docs.limit(0), PATH, "a.b", "t`x").collect() == []
