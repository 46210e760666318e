import hashlib
import random

import pytest

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("public_tokenizers")

from cellwise.llm.sentencepiece_bpe import Encoder, PieceModel, encode_decode  # noqa: E402


@pytest.fixture(scope="module")
def path():
    return tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    return sentencepiece.SentencePieceProcessor(model_file=path)


def test_merge_rounds_equal_the_library(path, library):
    rng = random.Random(3)
    texts = ["", " ", "\n", "  a  b", "▁", " ▁ x", " " * 333 + "the", "x" + " " * 15 + ",", "th" * 700, "a" * 999, "日本語 漢字", "😀é\x00", "<s> <0x0A> </s>", "\t\tx\r\n"]
    texts += [" " * k for k in range(1, 50)]
    texts += ["".join(rng.choice("abcdeth  ▁\n.,'éüß漢12-") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    texts += ["".join(rng.choice("aehrt ") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    encoder = Encoder(PieceModel(path), most_words=500)
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        ids, offsets, joined = encoder(part)
        decoded = encoder.model.decode(ids, offsets)
        for k, text in enumerate(part):
            own = library.encode(text)
            assert ids[offsets[k] : offsets[k + 1]].tolist() == own and joined[k] == ",".join(map(str, own))
            assert decoded[k].decode() == library.decode(own)


def test_table(odd_docs, rows_of, no_docs, path, library):
    expected = sorted(
        (i is None, i or 0, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        for i, ids in ((i, library.encode(t or "")) for i, t in rows_of)
    )
    found = encode_decode(odd_docs, path, with_text=True)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found.collect()) == expected
    assert all(len(r.ids) == r.n_tokens for r in found.collect())
    assert encode_decode(no_docs, path).count() == 0
