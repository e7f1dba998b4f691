"""Personal data in texts by weak supervision, in DataFrame expressions only.

Base spans (e-mail addresses, IP addresses, card and phone numbers) come from fixed
patterns and are always kept. Further candidates, runs that may be secrets, are
voted on by labelers: patterns, a gazetteer of words before them, and the context
of signs around them. Votes and span features are counted over all texts; as both
take few values, the counts are a small table whatever the corpus. On it,
expectation-maximisation estimates how reliable each labeler is (Dawid and Skene),
and the labels it expects train a naive Bayes classifier of span features, which
decides about every candidate as a sum of constants.

The patterns avoid repeated groups and restarts inside a run, which Java would
answer with deep recursion or quadratic time on very long runs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns, each at a start where no match can begin earlier in its run.
LOCAL, LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[{LABEL}]++(?:\.[{LABEL}]++)+"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9][0-9\x20-]{11,}[0-9]"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# A separator next to another one ends a card number; a line feed of the same length replaces it.
DOUBLE = r"[\x20-](?=[\x20-])|(?<=[\x20-])[\x20-]"
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

SECRET = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{16,}+"
GAZETTEER = ["token", "key", "secret", "password", "passwd", "auth", "bearer", "credential"]
CONTEXT = 24
ROUNDS = 50
# Spans whose places are summed one by one, and code points of a text cut off as a string of their own.
BLOCK = 64
CHUNK = 1024


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _running(
    values: Column, combine: Callable[[Column, Column], Column], body: Callable[[Callable[[Column], Column]], Column]
) -> Column:
    """``body(before)``, where ``before(i)`` combines 0 and the first ``i`` of the integers ``values``.

    Totals of blocks are kept, so that a place looks at one block and not at all before it.
    """
    zero = F.lit(0)
    over = lambda part: F.aggregate(part, zero, combine)

    def with_totals(values: Column) -> Column:
        count = F.ceil(F.size(values) / BLOCK).cast("int")
        each = F.transform(F.sequence(zero, count), lambda b: over(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
        return _let(each, lambda each: _let(
            F.transform(F.sequence(zero, count), lambda b: over(F.slice(each, F.lit(1), b))),
            lambda totals: body(
                lambda i: combine(
                    F.get(totals, F.floor(i / BLOCK).cast("int")),
                    over(F.slice(values, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)),
                )
            ),
        ))

    return _let(values, with_totals)


def _spans(text: Column, pattern: str, kind: str, maybe: Column, source: Column | None = None) -> Column:
    """``array<struct<kind, start, end, value, before>>`` of leftmost matches, in code points."""
    source = text if source is None else source
    hits = F.regexp_extract_all(source, F.lit(pattern), F.lit(0))
    gaps = F.split(source, pattern, -1)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,before:string>>")

    def placed(pairs: Column) -> Column:
        sizes = F.transform(pairs, lambda p: F.length(p["gaps"]) + F.coalesce(F.length(p["hits"]), F.lit(0)))

        def spans(before: Callable[[Column], Column]) -> Column:
            def span(pair: Column, i: Column) -> Column:
                return _let(before(i) + F.length(pair["gaps"]), lambda start: F.struct(
                    F.lit(kind).alias("kind"),
                    start.alias("start"),
                    (start + F.length(pair["hits"])).alias("end"),
                    pair["hits"].alias("value"),
                    F.right(pair["gaps"], F.lit(CONTEXT)).alias("before"),
                ))

            return F.filter(F.transform(pairs, span), lambda s: s["value"].isNotNull())

        return _running(sizes, lambda a, b: a + b, spans)

    found = _let(F.arrays_zip(gaps.alias("gaps"), hits.alias("hits")), placed)
    return F.when(maybe, found).otherwise(empty)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, "[^0-9]", ""))
    each = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    ))
    total = F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0)))
    return F.length(digits).between(13, 19) & (total % 10 == 0)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans by kind, in the order of the report."""
    single = F.regexp_replace(text, DOUBLE, "\n")
    found = {
        "email": _spans(text, EMAIL, "email", F.contains(text, F.lit("@"))),
        "ip": _spans(text, IP, "ip", text.rlike(r"[0-9]\.[0-9]")),
        "card": _spans(text, CARD, "card", text.rlike(r"[0-9][0-9\x20-]{11}"), single),
        "phone": _spans(text, PHONE, "phone", F.contains(text, F.lit("+"))),
    }
    found["ip"] = F.filter(found["ip"], lambda s: s["value"].rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    found["card"] = F.filter(found["card"], lambda s: _luhn(s["value"]))
    digits = lambda s: F.length(F.regexp_replace(s["value"], "[^0-9]", ""))
    found["phone"] = F.filter(found["phone"], lambda s: digits(s).between(9, 15))
    return found


def _votes(span: Column) -> list[Column]:
    """One vote per labeler: 1 for personal, 0 against."""
    value, before = span["value"], F.lower(span["before"])
    named = reduce(lambda a, b: a | b, [F.contains(before, F.lit(w)) for w in GAZETTEER])
    letters, digits = F.regexp_count(value, F.lit("[A-Za-z]")), F.regexp_count(value, F.lit("[0-9]"))
    votes = [
        value.rlike("^[0-9A-Fa-f]{32,}$"),  # pattern: a hexadecimal digest
        named,  # gazetteer: a telling word shortly before
        before.rlike(r"[=:]\s*[\"']?$"),  # context: it is assigned to something
        (letters > 0) & (digits > 0) & (digits * 8 > F.length(value)),  # pattern: mixed signs
    ]
    return [v.cast("int") for v in votes]


def _features(span: Column) -> list[Column]:
    """Features of the final classifier, each with few values."""
    value = span["value"]
    share = F.floor(4 * F.regexp_count(value, F.lit("[0-9]")) / F.length(value)).cast("int")
    changes = F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"))
    return [
        F.least(F.floor(F.length(value) / 8), F.lit(8)).cast("int"),
        share,
        F.least(F.floor(8 * changes / F.length(value)), F.lit(4)).cast("int"),
        span["before"].rlike(r"[\"'=:]$").cast("int"),
    ]


def dawid_skene(counts: dict[tuple[int, ...], int], rounds: int = ROUNDS) -> tuple[dict, list[tuple[float, float]]]:
    """Chance of label 1 for each vote pattern, and each labeler's (sensitivity, specificity)."""
    size = len(next(iter(counts)))
    chance = {v: 0.98 * sum(v) / size + 0.01 for v in counts}  # majority vote to begin with
    rates: list[tuple[float, float]] = []
    for _ in range(rounds):
        yes = sum(n * chance[v] for v, n in counts.items())
        no = sum(n * (1 - chance[v]) for v, n in counts.items())
        rates = []
        for k in range(size):
            hit = sum(n * chance[v] for v, n in counts.items() if v[k])
            miss = sum(n * (1 - chance[v]) for v, n in counts.items() if not v[k])
            rates.append(((hit + 1) / (yes + 2), (miss + 1) / (no + 2)))
        for v in counts:
            log = math.log((yes + 1) / (no + 1))
            for k, (sure, clear) in enumerate(rates):
                log += math.log(sure / (1 - clear)) if v[k] else math.log((1 - sure) / clear)
            chance[v] = 1 / (1 + math.exp(-max(-500.0, min(500.0, log))))
    return chance, rates


class SpanModel:
    """Constants of the final classifier; empty where the corpus has no candidates."""

    def __init__(self, bias: float, tables: list[dict[int, float]]):
        self.bias, self.tables = bias, tables

    @staticmethod
    def fit(docs: DataFrame, text_col: str = "text") -> SpanModel:
        """Count votes and features over all texts and learn from the counts."""
        text = F.coalesce(F.col(text_col), F.lit(""))
        found = docs.select(F.explode(_candidates(text)).alias("s"))
        keys = [F.array(*_votes(F.col("s"))).alias("votes"), F.array(*_features(F.col("s"))).alias("x")]
        rows = found.select(*keys).groupBy("votes", "x").count().collect()  # few values by design
        if not rows:
            return SpanModel(-1.0, [])
        counts: dict[tuple[int, ...], int] = {}
        for r in rows:
            counts[tuple(r["votes"])] = counts.get(tuple(r["votes"]), 0) + r["count"]
        chance, _ = dawid_skene(counts)
        yes = sum(r["count"] * chance[tuple(r["votes"])] for r in rows)
        no = sum(r["count"] for r in rows) - yes
        tables = []
        for k in range(len(rows[0]["x"])):
            seen: dict[int, list[float]] = {}
            for r in rows:
                p, held = chance[tuple(r["votes"])], seen.setdefault(r["x"][k], [0.5, 0.5])
                held[0] += r["count"] * p
                held[1] += r["count"] * (1 - p)
            tables.append({x: math.log(a / (yes + 1) * (no + 1) / b) for x, (a, b) in sorted(seen.items())})
        return SpanModel(math.log((yes + 1) / (no + 1)), tables)

    def accepts(self, span: Column) -> Column:
        score = F.lit(self.bias)
        for feature, table in zip(_features(span), self.tables):
            weight = F.lit(0.0)
            for value, log in table.items():
                weight = F.when(feature == value, log).otherwise(weight)
            score = score + weight
        return score > 0


def _candidates(text: Column) -> Column:
    maybe = text.rlike("[A-Za-z0-9_-]{16}")
    return F.filter(_spans(text, SECRET, "secret", maybe), lambda s: s["value"].rlike("[0-9]"))


def find_pii(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Add ``_base`` (struct of span arrays by kind) and ``_spans`` (all spans by kind and start).

    NULL texts have no spans. Added spans have the kind ``secret`` and never touch a
    base span. Texts are searched whole; repeated rows are treated alike.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.struct(*[spans.alias(kind) for kind, spans in base_spans(text).items()])
    with_base = docs.withColumn("_base", base).withColumn("_more", _candidates(text))
    kept = F.concat(*[F.col(f"_base.{k}") for k in ("email", "ip", "card", "phone")])
    apart = lambda s: ~F.exists("_kept", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return (
        with_base.withColumn("_kept", kept)
        .withColumn("_spans", F.concat("_kept", F.filter("_more", lambda s: model.accepts(s) & apart(s))))
        .drop("_more", "_kept")
    )


def listed(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of base spans, and all spans, one row per row of ``docs``."""
    found = find_pii(docs.select(id_col, text_col), SpanModel.fit(docs, text_col), text_col)
    base = F.concat(*[F.col(f"_base.{k}") for k in ("email", "ip", "card", "phone")])
    return found.select(
        id_col,
        *[F.size(F.col(f"_base.{k}")).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("_spans")).alias("spans"),
    )


def redact(docs: DataFrame, model: SpanModel, text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` with every span of the text replaced by its kind in brackets.

    NULL texts stay NULL; texts without spans stay as they are.
    """
    columns = [f"k{i}" for i in range(len(docs.columns))]  # other columns may have any name
    held_text = columns[docs.columns.index(text_col)]
    text = F.col(held_text)
    spans = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    # Places in a long text are found by its chunks, not by counting from its beginning.
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))

    def between(chunks: Column, start: Column, end: Column) -> Column:
        first = F.floor(start / CHUNK).cast("int")
        held = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
        cut = F.substring(F.array_join(held, ""), start % CHUNK + 1, end - start)
        return F.when(start < end, cut).otherwise(F.lit(""))

    def pieces(spans: Column, chunks: Column, before: Callable[[Column], Column]) -> Column:
        def piece(s: Column, i: Column) -> Column:
            mark = lambda at: F.concat(between(chunks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return _let(before(i), lambda at: F.when(s["start"] >= at, mark(at)).otherwise(F.lit("")))

        rest = between(chunks, before(F.size(spans)), F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    masked = _let(spans, lambda spans: _let(chunks, lambda chunks: _running(
        F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b), lambda before: pieces(spans, chunks, before)
    )))
    found = find_pii(docs.toDF(*columns), model, held_text)
    new = F.when(F.size("_spans") > 0, masked).otherwise(text)
    return found.select(*[new if c == held_text else F.col(c) for c in columns]).toDF(*docs.columns)
