"""Language-model scores, source divergence and whitening against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quietband.llm import attention, divergence, lm_scoring, whitening
from quietband.llm.catalog import ORACLE_SQL, WORD_TOKENIZER
from quietband.llm.common import coded_words
from quietband.llm.divergence import source_divergence
from quietband.llm.lm_scoring import score_texts
from quietband.llm.whitening import jacobi_davidson, whiten

# --- whitening -----------------------------------------------------------------------------


def _vectors(spark, rows):
    schema = "vec_id long, embedding array<float>, component int, n string"
    return spark.createDataFrame([(i, v, 9, "x") for i, v in rows], schema)


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(5)
    mixed = rng.normal(size=(24, 24)) * np.linspace(0.2, 2, 24)
    data = (rng.normal(size=(700, 24)) @ mixed + 3).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(data)]
    rows += [(1000 + i, data[5].tolist()) for i in range(300)] + [(None, data[6].tolist())]
    odd = [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2003, []), (2004, [1.0, 2.0])]
    odd.append((2005, [float("inf")] + [0.0] * 23))
    found = whiten(_vectors(spark, rows + odd).repartition(7)).toPandas()
    assert len(found) == 16 * len(rows)
    x = np.floor(64 * data.astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:16], vectors[:, ::-1][:, :16]
    white = (x - total / n) @ vectors / np.sqrt(values)
    assert set(found["n"]) == {n} and found["identity_error"].max() < 1e-9
    assert found["identity_error"].nunique() == 1
    mine = found[found["vec_id"] < 700].pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(mine), np.abs(white), rtol=1e-7, atol=1e-8)
    signs = np.sign((mine * white).sum(0))
    assert np.allclose(mine * signs, white, atol=1e-8)
    by_id = found[found["component"] == 1].dropna(subset="vec_id").set_index("vec_id")
    exact = ((n * x.astype(object) - total.astype(object)) ** 2).sum(1)
    assert by_id.loc[list(range(700)), "deviation"].tolist() == exact.tolist()
    share = found.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(share, values / np.trace(centred.T @ centred / n), rtol=1e-10)
    copies = found[(found["vec_id"] >= 1000) & (found["component"] == 2)]["whitened"]
    assert copies.nunique() == 1


def test_equal_rows_are_whitened_equally_anywhere():
    rng = np.random.default_rng(2)
    model = whitening.Whitening(
        9, np.zeros(70, np.int64), np.arange(70), rng.normal(size=(70, 16)), np.linspace(9, 1, 16), 80.0, 0.0
    )
    x = rng.integers(-500, 500, (333, 70))
    whole = model.apply(x)
    for size in (1, 2, 3, 5, 7, 64):
        cut = np.concatenate([model.apply(x[i : i + size]) for i in range(0, len(x), size)])
        assert cut.tolist() == whole.tolist()
    assert np.allclose(whole, (model.centred(x) @ model.vectors) / np.sqrt(model.values), rtol=1e-12, atol=1e-12)


def test_whitening_of_little(spark):
    assert whiten(_vectors(spark, [(1, None)])).count() == 0
    assert whiten(_vectors(spark, [(1, [1.0, 2.0])]).limit(0)).count() == 0
    same = whiten(_vectors(spark, [(1, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(1, 0, None, None)] * 4
    line = whiten(_vectors(spark, [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)])).toPandas()
    assert sorted(line["component"].unique()) == [1, 2, 3]
    assert line[line["component"] == 1]["whitened"].std(ddof=0) == pytest.approx(1)
    assert line[line["component"] > 1]["whitened"].isna().all() and line["identity_error"].max() < 1e-9
    huge = whiten(_vectors(spark, [(1, [1e38, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0])])).toPandas()
    assert huge["deviation"].isna().all() and huge["whitened"].notna().any()


@pytest.mark.parametrize("d, wanted", [(200, 16), (5, 5), (150, 3)])
def test_eigensolver_on_operators_larger_than_its_basis(d, wanted):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = np.sort(rng.random(d))[::-1]
    values[1] = values[0] if d > 100 else values[1]  # an eigenvalue met twice
    calls = []

    def product(p):
        calls.append(p.shape[1])
        return q @ (values[:, None] * (q.T @ p))

    found, vectors = jacobi_davidson(product, d, wanted, max_basis=48)
    assert np.allclose(found, values[:wanted], atol=1e-13)
    assert np.abs(product(vectors) - vectors * found).max() < 1e-12
    assert np.abs(vectors.T @ vectors - np.eye(wanted)).max() < 1e-13
    assert max(calls) <= wanted + 4


# --- source divergence ---------------------------------------------------------------------


def _divergence(rows, least):
    docs = [tuple(x or "" for x in r) for r in rows]
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(fold)) for _, _, t in docs]
    seen, groups = defaultdict(Counter), defaultdict(Counter)
    for (lang, source, _), words in zip(docs, terms):
        seen[lang].update(set(words))
        groups[lang, source].update(words)
    out = set()
    for lang in {d[0] for d in docs}:
        kept = sorted((t for t, c in seen[lang].items() if c >= least), key=str.encode)
        sources = {s: groups[lang, s] for x, s in groups if x == lang}

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + (10**9 * (counts[t] + 5)) // (n + 5 * len(kept)) for t in kept}

        whole = share(sum(sources.values(), Counter()))
        p = {s: share(c) for s, c in sources.items()}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            over = [(t, p[s][t] - whole[t]) for t in kept if sources[s][t] and p[s][t] > whole[t]]
            for part, items, last in (("pair", pairs, None), ("term", over, 50)):
                for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:last]):
                    out.add((lang, s, part, item, value, i + 1))
    return out


@pytest.mark.parametrize("levels, block, held", [((5, 9), 4096, 600_000), ((1, 2, 3), 7, 20)])
def test_divergence_equals_brute_force(spark, monkeypatch, levels, block, held):
    monkeypatch.setattr(divergence, "TERM_BLOCK", block)
    monkeypatch.setattr(divergence, "MAX_HELD", held)
    rng = np.random.default_rng(2)
    words = ["a", "Ab", "ABC", "éa", "Éa", "éab", "日本", "日本語", "prefixed", "prefixes", "prefixing", "x" * 5000]
    words += [f"{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    rows = []
    for i in range(400):
        text = rng.choice(["1 ", "-", ". "]).join(rng.choice(words, rng.integers(0, 12)))
        rows.append((str(rng.choice(["en", "de", ""])), str(rng.choice(["s", "S", "t", "ü"], p=[0.7, 0.1, 0.1, 0.1])), text))
    rows += [(None, None, "a"), ("xx", "only", "1 2 3"), ("xx", "other", None), ("en", "none", ""), rows[3], rows[3]]
    docs = spark.createDataFrame([(i, *r, 1, 2) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, count int, V int")
    found = source_divergence(docs.repartition(5), min_docs=12, levels=levels)
    assert dict(found.dtypes)["value"] == "bigint" and dict(found.dtypes)["rank"] == "int"
    assert {tuple(r) for r in found.collect()} == _divergence(rows, 12)
    assert source_divergence(docs.limit(0)).count() == 0


def test_later_passes_leave_out_documents_of_settled_terms(spark, monkeypatch):
    rows = [("en", f"s{i % 2}", "abc Abc abcd abcde abcdefghi abcdefghijk x" + "é" * 3) for i in range(6)]
    clean = spark.createDataFrame(rows, "lang string, source string, text string")
    passes = []
    for name in ("_prefix_documents", "_term_counts"):
        count = getattr(divergence, name)
        monkeypatch.setattr(divergence, name, lambda *a, count=count: passes.append(count(*a)) or passes[-1])
    found = divergence.kept_counts(clean, 6, (5, 9)).collect()
    assert {(r["source"], r["term"], r["occurrences"], r["in_lang"]) for r in found} == {
        (s, t, 3 * n, 6 * n)
        for s in ("s0", "s1")
        for t, n in (("abc", 2), ("abcd", 1), ("abcde", 1), ("abcdefghi", 1), ("abcdefghijk", 1), ("xééé", 1))
    }
    second = {bytes(r["prefix"]).decode() for r in passes[1].collect()}
    assert second == {"abcde", "abcdefghi", "xééé"}
    documents = {r["term"] for r in passes[2].where("source is null").collect()}
    assert documents == {"abcdefghi", "abcdefghijk"}


@pytest.mark.parametrize("width", [None, 2])
def test_terms_of_a_slice_are_counted_together(monkeypatch, width):
    rng = np.random.default_rng(8)
    rows = [(str(rng.choice(["de", "en", ""])), str(rng.choice(["a", "b"])), " ".join(rng.choice(["Übel", "ab.AB", "x", "a1b", "\0", "日"], rng.integers(0, 9)))) for _ in range(90)]
    rows += [("fr", "a", ""), ("en", "c", " ..1 ")]
    cut = divergence._Cut(pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["lang", "source", "text"]), width)
    terms_of = lambda text: [t[:width] for t in text.encode().translate(divergence._TERM_BYTES).split()]
    words = [(lang, source, terms_of(text)) for lang, source, text in rows]
    documents = Counter((lang, t) for lang, _, terms in words for t in set(terms))
    times = Counter((lang, source, t) for lang, source, terms in words for t in terms)
    asked, look = [], divergence._Alive(None, 0)
    monkeypatch.setattr(look, "of", lambda lang, terms: asked.extend((lang.decode(), t) for t in terms.to_pylist()) or np.array([t.as_py() != b"x" for t in terms]))
    code, group, count = cut.occurrences(look)
    found = {(*cut.keys[g], cut.terms[c].as_py()): n for c, g, n in zip(code.tolist(), group, count.tolist())}
    assert found == {k: n for k, n in times.items() if k[2] != b"x"}
    code, lang, count = cut.documents(look, 2)
    found = {(cut.langs[g], cut.terms[c].as_py()): n for c, g, n in zip(code.tolist(), lang, count.tolist())}
    assert found == {k: n for k, n in documents.items() if len(k[1]) >= 2}
    assert len(asked) == len(set(asked)) == len(documents)  # every distinct term of a language once


def test_divergence_query_matches_its_oracle(spark):
    from __spark_entry__ import queries

    folder = "/root/testdata/sf0.001"
    mine = queries()["op12_source_divergence"](spark, folder).toPandas()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    truth = base.execute(ORACLE_SQL["op12_source_divergence"]).df()
    columns = sorted(truth.columns)
    assert sorted(map(tuple, mine[columns].to_numpy())) == sorted(map(tuple, truth[columns].to_numpy()))


# --- language model ------------------------------------------------------------------------


def test_network_gradients():
    rng = np.random.default_rng(0)
    p = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in attention.initial().items()}
    lengths = np.array([70, 1, 40])
    classes = rng.integers(0, attention.CLASSES, lengths.sum())
    tables = attention.bigram_tables(rng.random((attention.CLASSES + 1, attention.CLASSES)))
    batch = next(attention.windows(classes, lengths))
    held = batch[2] >= 0
    loss = lambda q: -(attention.log_chances(q, tables, *batch[:2]) * held).sum() / held.sum()
    grads = attention.gradients(p, tables, *batch)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        step = np.zeros_like(p[name])
        step[at] = 1e-4
        slope = (loss({**p, name: p[name] + step}) - loss({**p, name: p[name] - step})) / 2e-4
        assert g[at] == pytest.approx(slope, rel=1e-2), name  # kinks of the hidden layer blur it


def test_windows_score_each_class_once_and_chances_sum_to_one():
    rng = np.random.default_rng(1)
    lengths = np.array([1, 28, 29, 300, 5])
    classes = rng.integers(0, attention.CLASSES, lengths.sum())
    places = np.concatenate([place[place >= 0] for _, _, place in attention.windows(classes, lengths, 3)])
    assert sorted(places) == list(range(lengths.sum()))
    for inputs, targets, place in attention.windows(classes, lengths):
        assert (targets[place >= 0] == classes[place[place >= 0]]).all()
        assert (inputs[0, : attention.CONTEXT + 1] == attention.BEGIN).all()
    p = attention.shaped(attention.flat(attention.initial()))
    tables = attention.bigram_tables(rng.random((attention.CLASSES + 1, attention.CLASSES)))
    inputs = np.repeat(inputs[:1], attention.CLASSES, axis=0)
    every = np.repeat(np.arange(attention.CLASSES)[:, None], attention.STRIDE, axis=1)
    assert np.allclose(np.exp(attention.log_chances(p, tables, inputs, every)).sum(0), 1, atol=1e-4)
    later = inputs[:1].copy()
    later[0, -1] = (later[0, -1] + 1) % attention.CLASSES  # what comes later changes nothing before
    a, b = (attention.log_chances(p, tables, x, every[:1])[0, :-1] for x in (inputs[:1], later))
    assert np.array_equal(a, b)


def test_two_heads_and_at_least_eight_classes_before_each_scored_one():
    lengths = np.array([300])
    classes = np.arange(300)
    for inputs, targets, place in attention.windows(classes, lengths):
        for row, targeted, at in zip(inputs, targets, place):
            for j in np.flatnonzero(at >= 0):
                seen = [c for c in row[: attention.CONTEXT + j + 1] if c != attention.BEGIN]
                assert len(seen) >= min(8, targeted[j]) and seen == list(range(targeted[j] - len(seen), targeted[j]))
    assert attention.initial()["near"].shape[0] == 2


def _held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def _base_scores(rows):
    fold = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    words = [(t or "").encode().translate(fold).split() for _, t in rows]
    counts, texts = Counter(), 0
    for (i, _), w in zip(rows, words):
        if not _held(i):
            counts.update(w)
            texts += 1
    n, v = sum(counts.values()) + texts, len(counts) + (texts > 0)
    logs = lambda c: math.log10((c + 1) / (n + v + 1))
    for (i, _), w in zip(rows, words):
        known = sum(counts[x] > 0 for x in w) + (texts > 0)
        yield i, _held(i), len(w) + 1, known, n, sum(logs(counts[x]) for x in w) + logs(texts)


@pytest.mark.parametrize("held_words", [150_000, 12])
def test_scores_of_texts(spark, monkeypatch, held_words):
    monkeypatch.setattr(lm_scoring, "HELD_WORDS", held_words)
    monkeypatch.setattr(lm_scoring, "RATES", (0.01,))
    rng = np.random.default_rng(4)
    stock = ["the", "of", "quiet", "Band", "naïve", "théorie", "x1", "a-b", "<|endoftext|>", "日本", "don't"]
    texts = [" ".join(rng.choice(stock, rng.integers(1, 60))) for _ in range(80)]
    texts += ["", None, " \n\t\r\x0b\x0c ", "a\x85b\xa0c　d   \x1c", "w" * 20_000, "the end " * 9000, texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "the null id")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, row int")
    found = score_texts(docs.repartition(3), WORD_TOKENIZER).toPandas()
    assert len(found) == len(rows) and found["score"].notna().all() and (found["score"] < 0).all()
    names = ["held_out", "n_tokens", "n_known", "train_tokens"]
    key = lambda i: -1 if i is None or i != i else int(i)
    mine = sorted((key(r.doc_id), *(int(getattr(r, c)) for c in names), r.base_score) for r in found.itertuples())
    truth = sorted((key(i), *map(int, rest), base) for i, *rest, base in _base_scores(rows))
    assert [m[:5] for m in mine] == [t[:5] for t in truth]
    assert [m[5] for m in mine] == pytest.approx([t[5] for t in truth], rel=1e-9)
    same = found[found["doc_id"].isin([0, 86])]["score"]
    assert len(same) == 3 and same.nunique() == 1
    assert score_texts(docs.limit(0), WORD_TOKENIZER).count() == 0


def test_equal_windows_have_equal_chances_in_any_batch():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, attention.CLASSES, n) for n in (1, 27, 28, 29, 56, 90, 200, 700)]
    p = {k: rng.normal(size=v.shape).astype(np.float32) for k, v in attention.initial().items()}
    tables = attention.bigram_tables(rng.poisson(0.3, (attention.CLASSES + 1, attention.CLASSES)).astype(float))

    def chances(chosen, batch):
        of, sizes = np.concatenate(chosen), np.array([len(t) for t in chosen])
        out = np.zeros(len(of))
        for inputs, targets, place in attention.windows(of, sizes, batch):
            out[place[place >= 0]] = attention.log_chances(p, tables, inputs, targets)[place >= 0]
        return np.split(out, np.cumsum(sizes)[:-1])

    alone = [chances([t], attention.BATCH)[0] for t in texts]
    for batch in (1, 3, 17, 256):
        for order in (range(8), range(7, -1, -1), rng.permutation(8)):
            for i, found in zip(order, chances([texts[i] for i in order], batch)):
                assert found.tolist() == alone[i].tolist()


def test_model_learns_from_every_training_text(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "RATES", (0.01, 0.01))
    monkeypatch.setattr(lm_scoring, "ROUND_TEXTS", 10)
    taken, pairs = [], []

    def learn(rows, parameters, sent, rate):
        taken.append([bytes(r["classes"]) for r in rows.select("classes").collect()])
        return parameters

    tables = attention.bigram_tables
    monkeypatch.setattr(lm_scoring, "_round", learn)
    monkeypatch.setattr(attention, "bigram_tables", lambda counts: pairs.append(counts.sum()) or tables(counts))
    texts = [" ".join(["the"] * n) for n in range(1, 81)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(200, None)], "doc_id long, text string")
    score_texts(docs.repartition(3), WORD_TOKENIZER)
    learned = [n for n in range(1, 81) if not _held(n - 1)]
    ends = not _held(200)
    assert len(taken) == -(-(len(learned) + ends) // 10)
    sizes = [len(c) // 2 - 1 for found in taken for c in found]
    assert set(sizes) == set(learned) | ({0} if ends else set())
    assert pairs == [sum(learned) + len(learned) + ends]


def test_model_beats_word_counts_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 4000")
    found = score_texts(docs, WORD_TOKENIZER).where("held_out").toPandas()
    assert len(found) > 400
    assert found["score"].sum() > found["base_score"].sum()


def test_texts_of_a_slice_are_encoded_together():
    """Each distinct word of a slice is asked for once, whatever the number of texts."""
    library = Tokenizer.from_file(WORD_TOKENIZER)
    classes = lm_scoring.Classes(library, np.ones(library.get_vocab_size() + 1))
    texts = ["", "The quiet band", "the\tBAND. naïve\x0bthe", " \n ", "x\u3000y \u3000 the", "quiet " * 40]
    words, codes, words_of = coded_words(pa.array(texts), lm_scoring._WORD_SIGNS)
    plain = [text.encode().lower().split() for text in texts]
    assert words_of.tolist() == list(map(len, plain)) and len(words) == len(set(sum(plain, [])))
    of, sizes, within = lm_scoring._Encoded(classes, WORD_TOKENIZER)(words.to_pylist(), codes, words_of)
    at = 0
    for mine, size, share in zip(plain, sizes, within):
        ids = [i for w in mine for i in library.encode(w.decode(), add_special_tokens=False).ids] + [-1]
        assert of[at : at + size].tolist() == classes.of[ids].tolist()
        assert share == pytest.approx(classes.log_share[ids].sum(dtype=float))
        at += size
    assert at == len(of)


def test_subwords_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    words = {w.encode() for w in ["the", "thstinnt", "éàÿ", "ﬁ", "İx", "don't", "x_1", "<|endoftext|>", "...", "a\x01b", "\x85", "日本語"]}
    known = lm_scoring.Subwords.of(path).learn(words)
    for w in words:
        assert np.frombuffer(known[w], np.uint16).tolist() == library.encode(w.decode(), add_special_tokens=False).ids, w
