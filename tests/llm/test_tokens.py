import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from reposift.llm import word_bpe
from reposift.llm.byte_bpe import VOCABULARY as BYTE_VOCABULARY
from reposift.llm.byte_bpe import ByteBpe
from reposift.llm.packing import Packer, pack
from reposift.llm.word_bpe import VOCABULARY as WORD_VOCABULARY
from reposift.llm.word_bpe import WordBpe, with_tokens
from tests.llm.texts import corpus, table

PARTS = (
    "a b e 's ' the ing ÉÀ Σ ς İ ﬁ é e\u0301 1 23 日本 😀 <|endoftext|> <|startoftext|> <|END !!! ... 'll re tt Ω ñ _ - aaaa"
).split(" ") + [" ", "  ", "\n", "\t", "\x1c", "\x85", "\u3000", "\u200b", "\x00"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [*corpus(), corpus()[2], (None, "no id")]).cache()


def library(path):
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding(), tokenizer.no_truncation()
    return tokenizer


def test_byte_ids_are_those_of_the_library():
    expected, ours = library(BYTE_VOCABULARY), ByteBpe()
    texts = random_texts(4_000) + [t for _, t in corpus()]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == expected.encode(text or "", add_special_tokens=False).ids


def test_word_ids_and_texts_are_those_of_the_library():
    expected, ours = library(WORD_VOCABULARY), WordBpe()
    texts = random_texts(6_000) + [t for _, t in corpus()]
    for text, ids in zip(texts, ours.encode(texts)):
        want = expected.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want
        assert ours.decode(ids) == expected.decode(want, skip_special_tokens=False)


def test_words_that_share_prefixes():
    expected, ours = library(WORD_VOCABULARY), WordBpe()
    rng = random.Random(9)
    words = {"".join(rng.choice("abeinorst") for _ in range(rng.randint(1, 12))) for _ in range(5_000)}
    found = ours.encode_words(words)
    assert found == {word: expected.encode(word, add_special_tokens=False).ids for word in words}


def test_tokens_of_a_table(spark, docs):
    expected = library(WORD_VOCABULARY)
    rows = with_tokens(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        want = expected.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], dtype="<u4").tolist() == want
        assert r["decoded"] == expected.decode(want, skip_special_tokens=False)
    assert with_tokens(table(spark, [])).collect() == []


def test_packer_keeps_its_bounds():
    rng = random.Random(2)
    packer, sizes, used = Packer(64, 5, 4), [], 0
    for i in range(2_000):
        n = rng.choice((1, 3, 10, 30, 63, 64, 65, 200))
        used += n
        for _, window in packer.add((i, 0, np.arange(n, dtype=np.int32), n)):
            sizes.append(sum(len(ids) for _, _, ids, _ in window))
        assert len(packer.gaps) == len(packer.windows) <= 5
    rest = [sum(len(ids) for _, _, ids, _ in window) for _, window in packer.rest(True)]
    assert sum(sizes) + sum(rest) == used
    assert min(sizes) > 60 and max(sizes) == 64 and all(n == 64 for n in rest[:-1])


def test_packing_is_whole_and_gapless(spark, docs):
    expected = library(BYTE_VOCABULARY)
    pieces = pack(docs, open_windows=3).toPandas()
    want = [expected.encode(r["text"] or "", add_special_tokens=False).ids + [0] for r in docs.collect()]
    assert pieces["length"].sum() == sum(map(len, want))
    texts = {r["doc_id"]: ids for r, ids in zip(docs.collect(), want)}
    twice = corpus()[2][0]
    for doc_id, own in pieces[pieces["doc_id"] != twice].groupby("doc_id"):
        own = own.sort_values("start")
        assert np.frombuffer(b"".join(own["ids"]), dtype="<u4").tolist() == texts[doc_id]
        assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert set(own["doc_tokens"]) == {len(texts[doc_id])}
    assert pieces["doc_id"].isna().sum() == 1
    sums = []
    for _, one in pieces.groupby("sequence_id"):
        one = one.sort_values("offset")
        assert one["offset"].tolist() == [0, *one["length"].cumsum()[:-1]]
        sums.append(one["length"].sum())
    assert max(sums) <= 1024 and sum(sums) > 0.97 * 1024 * (len(sums) - 1)
    assert pack(table(spark, [])).collect() == []


def test_word_ids_of_every_character():
    """Each character that is not left to the library, and random ones of all of Unicode."""
    expected, ours = library(WORD_VOCABULARY), WordBpe()
    rng = random.Random(3)
    plain = [chr(c) for c in range(0x2200) if word_bpe._PLAIN.fullmatch(chr(c))]
    texts = [f"a{c}b {c} {c}{c}1{c} .{c} A{c}Z" for c in plain]
    texts += ["".join(rng.choice(plain) for _ in range(40)) for _ in range(500)]
    spans = [(0x20, 0x250), (0x250, 0xD7FF), (0xE000, 0x1FFFF), (0x300, 0x370)]
    texts += ["".join(chr(rng.randrange(*rng.choice(spans))) for _ in range(30)) for _ in range(1_500)]
    for text, ids in zip(texts, ours.encode(texts)):
        assert ids.tolist() == expected.encode(text, add_special_tokens=False).ids


def test_words_forgotten_and_met_again(monkeypatch):
    monkeypatch.setattr(word_bpe, "KEPT", 300)
    monkeypatch.setattr(word_bpe, "KEPT_FIRST", 40)
    expected, ours = library(WORD_VOCABULARY), WordBpe()
    texts = [t or "" for _, t in corpus()] + random_texts(400)
    for _ in range(2):
        for at in range(0, len(texts), 20):
            for text, ids in zip(texts[at : at + 20], ours.encode(texts[at : at + 20])):
                assert ids.tolist() == expected.encode(text, add_special_tokens=False).ids


def test_beginnings_name_the_token_that_ends_there():
    model = word_bpe.bpe()
    assert all(model.begins[b] == model.vocab.get(b) for b in model.begins)
    words = ["hello", "hello,", "naïve", "x1"]
    assert [a.tolist() for a in model.encode(words)] == [
        model.library().encode(w, add_special_tokens=False).ids for w in words
    ]
