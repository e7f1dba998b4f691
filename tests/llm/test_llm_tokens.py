"""Token operators against the tokenizers library: encoder, packing, token files."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quietband.llm import packing
from quietband.llm.catalog import BYTE_TOKENIZER, WORD_TOKENIZER
from quietband.llm.packing import cut_lengths, harmonic_pack, tokenized_pieces
from quietband.llm.token_files import decode, encode, token_files
from quietband.llm.tokens import WordEncoder

SIGNS = "aZ é.,!'|#\n  1²αß\t Σ\x01İ́-_@ the don't <|endoftext|>　中"


def ids_of(path, text):
    return WordEncoder.of(path).library.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_encoder_gives_the_ids_of_the_library(path):
    rng = random.Random(3)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["", "\n", " ", ".", "a.", "a. b", "a.b.", "it's.", "x,\n", "  a", "A.  B", "word " * 3000]
    for text, found in zip(texts, WordEncoder.of(path).encode(texts)):
        assert found.tolist() == ids_of(path, text)


@pytest.mark.parametrize("path", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_new_words_cost_the_library_one_pass(monkeypatch, path):
    encoder = WordEncoder(path)
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    texts = [" ".join(names[:300]), "É" + ", É".join(names[300:]) + "$$$\nEnd!! é.\n\nÀ la\n#x"]
    whole = [ids_of(path, text) for text in texts]
    given = []

    def batch(parts, library=None):
        given.extend(parts)
        return [x.ids for x in (library or encoder.library).encode_batch_fast(parts, add_special_tokens=False)]

    monkeypatch.setattr(encoder, "_batch", batch)
    assert [ids.tolist() for ids in encoder.encode(texts)] == whole
    assert sum(map(len, given)) < 1.2 * sum(len(text.encode()) for text in texts)  # no marks between words
    given.clear()
    assert [ids.tolist() for ids in encoder.encode(["", *texts, ""])] == [[], *whole, []]
    assert not any(given)


@pytest.mark.parametrize("path", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_texts_of_blanks_and_signs_are_cut_right(path):
    rng = random.Random(5)
    parts = ["\n", " ", "  ", "a", "Zed", "é", "ß", "'s", "'", ".", "...", "$$$", "!!", "7", "x=y", "<b>", "\u0301", "\u0338", "Σ", "ς", "中", "\n\n", ",", "×", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, found in zip(texts, WordEncoder.of(path).encode(texts)):
        assert found.tolist() == ids_of(path, text), text


@pytest.mark.parametrize("path", [WORD_TOKENIZER, BYTE_TOKENIZER])
def test_strings_of_added_tokens_become_those_tokens(spark, path):
    fresh = Tokenizer.from_file(path)
    texts = ["<|endoftext|>", "one <|endoftext|> two", "one<|endoftext|>two.<|startoftext|> x", "a  <|endoftext|>\n\nb, <|endoftext|>"]
    texts += ["<|ENDOFTEXT|> <|endoftext |> <|endof", "plain words only", "tab\t<|endoftext|>"]
    plain = [fresh.encode(text, add_special_tokens=False).ids for text in texts]
    assert plain[0] == [fresh.token_to_id("<|endoftext|>")]
    assert [ids.tolist() for ids in WordEncoder.of(path).encode(texts)] == plain
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_files(spark, docs, path, 0).toPandas().sort_values("doc_id")
    assert found.ids_crc32.tolist() == [zlib.crc32(np.array(ids + [0], "<u4").tobytes()) for ids in plain]
    assert found.start.tolist() == [0, *np.cumsum([len(ids) + 1 for ids in plain])[:-1]]


@pytest.fixture(scope="module")
def docs(spark):
    words = "alpha beta gamma delta eps.".split()
    rows = [(i, " ".join(words[(i * k) % 5] for k in range(1, 7 * i))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "one two " * 9000), (7, "again"), (7, "again"), (None, "no id"), (63, "\n \n")]
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as length", "'x' as start")
    return table.repartition(3)


def test_packing_places_every_id_once(docs):
    packed = harmonic_pack(tokenized_pieces(docs, WORD_TOKENIZER, 2)).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in (7, None)}
    for doc, pieces in packed[~packed.doc_id.isin([7]) & packed.doc_id.notna()].groupby("doc_id"):
        ids = np.array(ids_of(WORD_TOKENIZER, texts[doc]) + [2], "<u4")
        pieces = pieces.sort_values("start")
        assert pieces.start.tolist() == [0, *pieces.length.cumsum()[:-1]] and pieces.length.sum() == len(ids)
        assert (pieces.doc_tokens == len(ids)).all()
        for p in pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert packed.doc_id.isna().sum() == 1 and (packed.doc_id == 7).sum() >= 3
    sizes = packed.groupby("sequence_id").length.sum()
    assert sizes.max() <= 4096 and sorted(sizes.index) == list(range(len(sizes)))
    assert (sizes < 4000).sum() <= 1
    for _, pieces in packed.groupby("sequence_id"):
        pieces = pieces.sort_values("offset")
        assert pieces.offset.tolist() == [0, *pieces.length.cumsum()[:-1]]


def test_classes_are_filled_with_a_fixed_number(spark, monkeypatch):
    monkeypatch.setattr(packing, "MIN_GROUPS", 5)
    lengths = [1024] * 403 + [1365] * 100 + [4096] * 7 + [100] * 900
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, length long")
    packed = harmonic_pack(pieces).toPandas()
    whole = packed.groupby("sequence_id").length.agg(["nunique", "count", "min"])
    assert (whole[(whole["nunique"] == 1) & (whole["min"] == 1024)]["count"] == 4).sum() == 100
    assert len(packed) == len(lengths) and packed.groupby("sequence_id").length.sum().max() <= 4096


@given(st.integers(1, 20_000))
@settings(max_examples=200, deadline=None)
def test_cut_lengths_add_up(tokens):
    lengths = cut_lengths(tokens)
    assert sum(lengths) == tokens and all(0 < n <= 4096 for n in lengths)


def test_nothing_to_pack(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert harmonic_pack(tokenized_pieces(none, WORD_TOKENIZER, 2)).count() == 0
    assert token_files(spark, none, BYTE_TOKENIZER).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=9), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_coding_round_trip(lists):
    counts = np.array([len(values) for values in lists])
    coded = encode(np.array([v for values in lists for v in values], np.uint32), counts)
    control, data = (np.frombuffer(raw, np.uint8) for raw in coded)
    assert decode(control, data, counts).tolist() == [v for values in lists for v in values]


def test_token_files_round_trip(spark, docs):
    found = token_files(spark, docs, BYTE_TOKENIZER, 0).toPandas()
    truth = {}
    for r in docs.collect():
        ids = np.array(ids_of(BYTE_TOKENIZER, r["text"]) + [0], "<u4")
        truth.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    found = found.sort_values("start")
    assert found.start.tolist() == [0, *found.n_tokens.cumsum()[:-1]]
    order = found.doc_id.fillna(-1).tolist()
    assert order == sorted(order) and len(found) == docs.count()
    for doc, rows in found.groupby(found.doc_id.fillna(-1)):
        pairs = sorted(zip(rows.n_tokens, rows.ids_crc32))
        assert pairs == sorted(truth[None if doc == -1 else int(doc)])
