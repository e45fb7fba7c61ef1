import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from verifolio.llm import piece_transducer
from verifolio.llm.piece_transducer import PieceTransducer, model_path

RAW = open(model_path(), "rb").read()
LIBRARY = sentencepiece.SentencePieceProcessor(model_proto=RAW)
MODEL = PieceTransducer(RAW)


def unigram_model():
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto.FromString(RAW)
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    return proto.SerializeToString()


_texts = st.text(st.sampled_from("abcdehinorst  \n.▁éñ1ABﬁ日😀\t") | st.characters(exclude_categories=["Cs"]), max_size=60)


@settings(max_examples=300, deadline=None)
@given(_texts)
def test_same_pieces_as_the_library(text):
    ids = MODEL.encode(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == text.replace("▁", " ")


def test_documents_as_the_library(documents):
    for row in documents.select("text").limit(60).collect():
        assert MODEL.encode(row.text) == LIBRARY.encode(row.text)


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "a" * 3000, " " * 300 + "q", "\n\n x", "▁▁ a ▁", "<s> <unk> <0x41>", "\0"])
def test_corner_cases(text):
    assert MODEL.encode(text) == LIBRARY.encode(text)


def test_unigram_paths_cost_the_same():
    """The library's lattice search; its fast encoder is not exact for these scores."""
    raw = unigram_model()
    model, library = PieceTransducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    cost = lambda ids: sum(library.get_score(i) for i in ids)
    for text in ("hello world", "internationalisation", "the quick brown fox", "Donaudampfschiff", "x"):
        assert cost(model.encode(text)) == cost(library.nbest_encode_as_ids(text, 2)[0])
        assert model.decode(model.encode(text)) == text


def test_rules_rewrite_before_pieces():
    model = PieceTransducer(RAW, {"ﬁ": "fi", "ﬁx": "fox"})
    assert model.decode(model.encode("ﬁx the ﬁeld")) == "fox the field"


@pytest.mark.parametrize("rule, extra, prefix", [("nfkc", True, True), ("nmt_nfkc_cf", True, True), ("nfkc", False, False), ("nmt_nfkc", False, True)])
def test_character_maps_as_the_library(rule, extra, prefix):
    from sentencepiece import sentencepiece_model_pb2 as pb

    made = pb.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto = pb.ModelProto.FromString(RAW)
    proto.normalizer_spec.CopyFrom(made.normalizer_spec)
    proto.normalizer_spec.add_dummy_prefix, proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.escape_whitespaces = prefix, extra, True
    raw = proto.SerializeToString()
    model, library = PieceTransducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    for text in ("ﬁeld  ｶﾞ x²", "  ①②③ Ａ Ｂ  ", "e\u0301\u00a0\u00a0 Ǆ", "\u3000全角　スペース ", "plain words", "ﷺ", "\t a\r\nb", " ", "½ ẛ̣ K Å"):
        assert model.encode(text) == library.encode(text), text


def test_ids_outside_the_model():
    assert MODEL.decode([-1, 40000, *MODEL.encode("still there"), 1 << 30]) == "still there"


def test_all_documents_as_the_library():
    """Every text of the larger folder, whose pieces the library tells."""
    import pyarrow.parquet as pq

    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()]
    assert [MODEL.encode(t) for t in texts] == LIBRARY.encode(texts, num_threads=1)


def test_caches_change_nothing(monkeypatch):
    small = PieceTransducer(RAW)
    monkeypatch.setattr(piece_transducer, "_WORD_BYTES", 900)
    monkeypatch.setattr(piece_transducer, "_WORD_COST", 1)
    monkeypatch.setattr(piece_transducer, "_PAIRS_HELD", 5)
    text = "several words that push one another out of a small cache, several words again"
    assert [small.encode(text) for _ in range(3)] == [LIBRARY.encode(text)] * 3


def test_query_rows(odd, odd_rows, none):
    found = piece_transducer.sentencepiece(odd).collect()
    assert len(found) == len(odd_rows)
    by = {r.doc_id: r for r in found}
    for doc_id, text in [r[:2] for r in odd_rows]:
        r = by[doc_id]
        assert r.ids == LIBRARY.encode(text or "") and r.n_pieces == len(r.ids) and r.exact
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert piece_transducer.sentencepiece(none).count() == 0


def test_decoding_a_table(spark):
    rows = [(1, LIBRARY.encode("there and back again")), (2, []), (3, None)]
    out = piece_transducer.decode_documents(spark.createDataFrame(rows, "k long, ids array<int>"), {"k": __import__("pyspark.sql.functions", fromlist=["col"]).col("k")})
    assert {r.k: r.text for r in out.collect()} == {1: "there and back again", 2: "", 3: ""}
