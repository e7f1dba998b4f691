"""Classifiers, personal data, URL rules, mixing and the pipeline."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import queries
from quietband.llm import toxicity, url_rules
from quietband.llm.catalog import ORACLE_SQL, QUERIES, URL_RULES
from quietband.llm.mixing import mix_sources, mixed_documents
from quietband.llm.pii import SpanModel, dawid_skene, redact, report_pii
from quietband.llm.quality import measures, score_quality
from quietband.llm.toxicity import MEANT, NEGATES, OTHER, STEP, AIMS, INSULT, REPORTS, score_toxicity

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(x - 9 if x > 9 else x for x in twice) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


HARD = [
    "a@b.c.d%e@f.g x@y z@@q.w 1.2.3.4.5.6.7.8 1.2.3.256 001.02.3.000255 9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 41111111111111112 4111111111111111 -4111 1111 1111 1111-",
    "+1 (980) 555-6268 ++49 30 1234567 +12 +1234567890123456 𝄞é +44-20-7946-0958 x",
    'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and averyveryverylongword_without',
    "9" * 30_000, "a" * 30_000, "1 " * 15_000, "a@" + "b" * 9_000, "+" + "1" * 20_000, None, "", "x@y.z",
    '04dbebab91ab85687d33eeaaf9ac699e1188f962 key: f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda',
]


def test_base_spans_and_secrets(spark):
    rows = [(i, t) for i, t in enumerate(HARD)] + [(3, HARD[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _spans", "2 as value")
    found = report_pii(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        text = HARD[r["doc_id"]] or ""
        spans = {k: [m.span() for m in re.finditer(p, text) if fits(k, m.group())] for k, p in PATTERNS.items()}
        listed = ",".join(f"{k}:{a}:{b}" for k, all_spans in spans.items() for a, b in all_spans)
        assert r["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), text[:60]
        assert all(r[f"n_{k}"] == len(v) for k, v in spans.items())
        assert r["spans"].startswith(listed)
    assert [r["spans"] for r in found if r["doc_id"] == 3] == ["secret:9:49"] * 2
    masked = redact(docs, SpanModel.fit(docs))
    assert masked.columns == docs.columns
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[3].startswith('token = "[SECRET]" and') and texts[9] is None and texts[10] == ""
    assert texts[11] == "[EMAIL]" and "𝄞é [PHONE] x" in texts[2]
    assert report_pii(docs.limit(0)).count() == 0


def test_labelers_that_agree_are_trusted():
    chance, rates = dawid_skene({(1, 1, 1): 400, (0, 0, 0): 600, (1, 0, 0): 30, (1, 1, 0): 20})
    assert chance[1, 1, 1] > 0.95 and chance[0, 0, 0] < 0.05 and chance[1, 0, 0] < 0.5 < chance[1, 1, 0]
    assert all(0 < s < 1 and 0 < c < 1 for s, c in rates)


URLS = [
    "http://A.Example.NET/en/x?y", "https://net/", "x://net", "http://example.net?/en/", "http://badexample.net/en/",
    "http://de.example.com/de/1", "http://example.com/den", "http://a.org/fr/#t", "http://org/fr", "a://b://c.net/",
    "", None, "no scheme", "://", "http://notnet/", "http://sub.net/enx", "http://É.NET/", "http://u@net:80/",
]


def judged(url):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    raw = re.match(r"[^/?#]*", rest).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in raw)
    path = re.match(r"[^?#]*", rest[len(raw) :]).group()
    fit = [(r, v) for r, v in URL_RULES for h, _, p in [r.partition("/")]
           if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    rule, verdict = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("listed", [10_000_000, 0])
def test_url_rules(spark, monkeypatch, listed):
    monkeypatch.setattr(url_rules, "MAX_LISTED", listed)
    pages = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").selectExpr("*", "1 as rule")
    found = url_rules.match_rules(pages, URL_RULES).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == judged(URLS[r["page_id"]])
    assert url_rules.match_rules(pages.limit(0), URL_RULES).count() == 0


def test_equal_digests_are_told_apart(spark, monkeypatch):
    real = url_rules.xxhash.xxh64_intdigest
    clash = real(b"a.net/", url_rules.HASH_SEED)
    monkeypatch.setattr(url_rules.xxhash, "xxh64_intdigest", lambda raw, seed: clash)
    pages = spark.createDataFrame([(1, "http://a.net/x"), (2, "http://b.net/x")], "page_id long, url string")
    found = url_rules.match_rules(pages, [("b.net/", "allow"), ("a.net/", "block")]).collect()
    assert {r["page_id"]: r["rule"] for r in found} == {1: "a.net/", 2: None}


@pytest.fixture(scope="module")
def sources(spark):
    rng = np.random.default_rng(0)
    names = rng.choice(["hot", "b", "ü", "z", None], p=[0.5, 0.2, 0.2, 0.05, 0.05], size=1500)
    rows = [(i, "w " * int(n), s) for i, (n, s) in enumerate(zip(rng.integers(0, 90, 1500), names))]
    rows += [(2000, None, "hot"), (2001, "", "empty"), (2002, "x\u00a0y z", "tiny"), (7, rows[7][1], rows[7][2]), (None, "a b", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "9 as size", "8 as copies")


def test_mixing_meets_its_targets(sources):
    found = mix_sources(sources).toPandas()
    rows = sources.select("doc_id", "source", "text").toPandas()
    size = rows.text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")))
    per = size.groupby(rows.source.fillna("\U0010ffff")).sum()
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(per.index))}
    full, share = set(), 0.0
    while True:
        share = (size.sum() - sum(3 * per[s] for s in full)) / sum(weights[s] for s in per.index if s not in full)
        more = {s for s in per.index if share * weights[s] > 3 * per[s]} - full
        if not more:
            break
        full |= more
    truth = {s: min(3.0 * per[s], share * weights[s]) for s in per.index}
    joined = found.dropna(subset="doc_id").drop_duplicates("doc_id").merge(rows.dropna(subset="doc_id").drop_duplicates("doc_id"), on="doc_id")
    for r in joined.itertuples():
        name = r.source if isinstance(r.source, str) else "\U0010ffff"
        assert r.source_size == per[name] and abs(r.target - truth[name]) < 1e-6 and 0 <= r.copies <= 3
    assert len(found) == len(rows)
    taken = (joined.copies * joined["size"]).groupby(joined.source.fillna("\U0010ffff")).sum()
    assert all(abs(taken[s] - truth[s]) <= max(3 * 90, 0.02 * truth[s]) for s in truth)


def test_mixing_repeats_itself(sources):
    once = sorted(map(str, mix_sources(sources).collect()))
    assert once == sorted(map(str, mix_sources(sources.repartition(13)).collect()))
    copies = mixed_documents(sources)
    assert copies.columns == sources.columns
    assert copies.count() == mix_sources(sources).selectExpr("sum(copies)").first()[0]
    assert mix_sources(sources.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("aeioulmnrst"), 5))
    rows, labels = [], []
    for i in range(900):
        words = [word() for _ in range(30)]
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        if toxic:
            words[rng.integers(30)] = "zgrub" + word()
            words[rng.integers(30)] = "zgrub" + word()
        text = " ".join(words) + "."
        rows.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, good, toxic))
    rows += [(9000, None), (9001, ""), (9002, "word " * 20_000), (None, "zgrubaaaaa"), (3, rows[3][1])]
    labels += [(0, None, None), (None, 1, 1), (9000, 1, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as label", "'k' as x")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((r[0], r[1:]) for r in labels[:900])


@pytest.mark.parametrize("score, at, folds, fold", [(score_quality, 0, 3, 1), (score_toxicity, 1, 4, 2)])
def test_classifiers_on_held_out_rows(labelled, score, at, folds, fold):
    docs, labels, truth = labelled
    found = score(docs, labels).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"] and r["doc_id"] in truth]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % folds == fold) == r["held_out"] for r in found if r["doc_id"] is not None)
    assert len(held) > 150 and np.mean([r["predicted"] == truth[r["doc_id"]][at] for r in held]) > 0.95
    assert score(docs, labels.limit(0)).count() == len(found)
    assert score(docs.limit(0), labels).count() == 0


def test_grammar_tells_how_an_insult_is_meant():
    def meant(*marks):
        state = 0
        for kind in marks:
            state, last = STEP[state][kind], MEANT[state][kind]
        return last

    assert [meant(INSULT), meant(AIMS, OTHER, INSULT), meant(NEGATES, OTHER, INSULT)] == [0, 1, 2]
    assert meant(NEGATES, OTHER, OTHER, OTHER, INSULT) == 0 and meant(AIMS, REPORTS, INSULT) == 3


def _by_clauses(text, stems):
    """Sums of the ways insults and threats are meant, clause by clause with plain loops."""
    sums = [0.0] * 8
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”«»]", clause)
        for i, word in enumerate(words):
            weight = next((w for s, w in stems.items() if word.startswith(s)), None)
            threat = word in toxicity.THREAT
            if word in toxicity.NEGATION | toxicity.REPORT | toxicity.TARGET or (weight is None and not threat):
                continue
            said = any(w in toxicity.REPORT or w in "\"“”«»" for w in words[:i])
            denied = any(w in toxicity.NEGATION for w in words[max(0, i - 3) : i])
            aimed = any(w in toxicity.TARGET for w in words)
            way = 3 if said else 2 if denied else 1 if aimed else 0
            sums[way + 4 * threat] += 1.0 if threat else weight
    return sums


CLAUSES = [
    "I will kill you.", "I will kill time.", "You I will hurt!", "He said you are a zgrub.", "not a zgrub, you; zgrubs",
    "zgrub zgrub you", "you: kill. kill", "I never really said kill zgrub", "\"kill you\" zgrub", "you\nzgrub", "zgrub",
    "don't kill you zgrub zgrub zgrub", "", "nothing here. at all", "töten dich? kill", "you you you they kill kill zgruber",
]


@pytest.mark.parametrize("text", CLAUSES + [" ".join(CLAUSES)])
def test_grammar_equals_plain_loops_over_clauses(text):
    stems = {"zgr": 2.5}
    found = np.expm1(toxicity.Grammar(stems).features(text)[:8])
    assert found == pytest.approx(_by_clauses(text, stems), abs=1e-9)


def test_threats_need_somebody():
    grammar = toxicity.Grammar({})
    assert grammar.features("I will kill you.") != grammar.features("I will kill time.")
    assert grammar.features("I will kill time.")[8:] == [0.0] * 5


def test_measures_of_odd_texts():
    for text in ["", " ", "\n\n", "a", "\ud800", "é" * 10_000]:
        assert len(measures(text)) == 20 and np.isfinite(measures(text)).all()


def test_pipeline_on_odd_documents(spark, labelled, tmp_path):
    docs, labels, truth = labelled
    wide = docs.selectExpr("doc_id", "text", "'en' as lang", "if(doc_id % 3 = 0, 'a', null) as source", "length(text) as n_chars", "1 as k0", "2 as copies", "3 as key")
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept.count(), corpus_pipeline.store(stage(spark, kept, str(tmp_path)), name)
        assert kept.columns == wide.columns
        if name in ("toxicity", "near_copies"):
            assert 0.5 * before < kept.count() < before
        if name == "private_data":
            assert kept.count() == before
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert np.mean([truth[i][1] for i in ids if i in truth]) < 0.03 and len(names) == 5
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == ids
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packed.count()


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(queries())


def test_near_copies_are_decided_row_by_row(spark, tmp_path):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (5, a + " more"), (5, b), (9, b + " more"), (None, a + " x"), (7, None), (7, None), (8, ""), (1, "z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, row int, word int")
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    texts = [r["text"] for r in kept.collect()]
    assert sum((t or "").startswith("a0 ") for t in texts) == 1 and sum((t or "").startswith("b0 ") for t in texts) == 1
    assert len(texts) == 6 and texts.count(None) == 2 and "" in texts and "z" in texts
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_url_query_matches_its_oracle(spark):
    folder = "/root/testdata/sf0.001"
    mine = queries()["op6_url_filter"](spark, folder).toPandas()
    base = duckdb.connect()
    base.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    truth = base.execute(ORACLE_SQL["op6_url_filter"]).df()
    assert sorted(map(str, mine[truth.columns].to_numpy().tolist())) == sorted(map(str, truth.to_numpy().tolist()))


def test_thousands_of_spans_in_one_text(spark):
    many = "é " + " ".join(f"a{i}@b.c x 10.0.{i % 250}.1" for i in range(8000)) + " tail"
    docs = spark.createDataFrame([(1, many), (2, None)], "doc_id long, text string")
    found = report_pii(docs).where("doc_id = 1").first()
    spans = [f"{k}:{m.start()}:{m.end()}" for k in ("email", "ip") for m in re.finditer(PATTERNS[k], many)]
    assert found["spans"] == ",".join(spans) and found["n_ip"] == 8000
    masked = redact(docs, SpanModel.fit(docs)).where("doc_id = 1").first()["text"]
    assert masked == "é " + " ".join(["[EMAIL] x [IP]"] * 8000) + " tail"
