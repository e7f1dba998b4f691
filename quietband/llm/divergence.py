"""Divergence of sources within a language, over terms found by iceberg prefix refinement.

The terms worth counting are those in enough documents of their language. They are
found from the front: a first pass over the texts counts, for every language, the
documents that hold a term with a given short byte prefix; only prefixes in enough
documents are extended in the next pass, until whole terms are counted. What survives
a pass goes to the tasks of the next as a bit map of fixed size. A bit set by another
prefix lets too much through, never too little, and the last pass counts whole terms
exactly. A term shorter than a prefix is its own prefix: the pass that first counts it
counts its documents exactly, and later passes leave them out.

A row is a document, also where ids repeat. Shares are integers, so all results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quietband.llm.common import coded_words, slices, store

# Bytes of a prefix in each pass before the one that counts whole terms.
LEVELS = (5, 9)
MAP_BITS = 1 << 25  # 4 MB for each task, whatever the number of prefixes
HASH_SEED = 42  # the seed of Spark's xxhash64
# Counters a task holds before it passes them on, and known answers of the bit map.
MAX_HELD = 600_000
SLICE_BYTES = 2 << 20  # texts a task cuts into terms at once
EMITTED_ROWS = 50_000  # of one Arrow batch passed to Spark
# Kept terms of a language compared by one task, for all its sources.
TERM_BLOCK = 4096
SHARE_SCALE, SMOOTHING = 1_000_000_000, 5  # fixed values of a share

# Fixed rule of a term: letters A-Z in lower case and all bytes of other characters beyond ASCII.
_TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def source_divergence(
    docs: DataFrame, min_docs: int = 30, top_terms: int = 50, levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` for every occurring pair of language and source.

    Part ``pair`` holds, for each other source of the language, the summed absolute
    differences of the shares of all kept terms; part ``term`` the ``top_terms`` terms whose
    share in the source exceeds that in the language most. NULL texts, languages and
    sources count as empty; a text without terms still makes its group occur. Equal values
    are ranked by the item's bytes. Without documents the result is empty.
    """
    clean = docs.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    )
    counts = store(kept_counts(clean, min_docs, levels), "counts")
    groups = store(clean.select("lang", "source").distinct(), "groups")
    return _report(counts, groups, top_terms)


def kept_counts(clean: DataFrame, min_docs: int, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """``(lang, source, term, occurrences, in_lang)`` of the kept terms, where they occur."""
    alive, settled, shortest = None, [], 0
    for width in levels:
        counted = _prefix_documents(clean, width, alive, shortest).where(F.col("count") >= min_docs)
        counted = store(counted, "prefixes")
        settled.append(counted.where(F.length("prefix") < width))
        alive, shortest = (_bit_map(counted, settled), width), width
    found = store(_term_counts(clean, alive, shortest), "terms")
    kept = found.where("source is null").where(F.col("count") >= min_docs).select("lang", "term")
    for short in settled:
        kept = kept.unionByName(short.select("lang", F.col("prefix").cast("string").alias("term")))
    held = found.where("source is not null").join(kept, ["lang", "term"])
    held = store(held.withColumnRenamed("count", "occurrences"), "held")
    in_lang = held.groupBy("lang", "term").agg(F.sum("occurrences").alias("in_lang"))
    return held.join(in_lang, ["lang", "term"]).select("lang", "source", "term", "occurrences", "in_lang")


class _Alive:
    """Which terms of a language begin with a surviving prefix; answers are remembered."""

    def __init__(self, bits: np.ndarray | None, width: int):
        self.bits, self.width = bits, width
        self.known: dict[bytes, dict[bytes, bool]] = {}

    def of(self, lang: bytes, terms: pa.Array) -> np.ndarray:
        if self.bits is None:
            return np.ones(len(terms), bool)
        prefixes = _listed(pa.compute.binary_slice(terms, 0, self.width))
        known = self.known.setdefault(lang, {})
        new = [p for p in set(prefixes) if p not in known]
        if sum(map(len, self.known.values())) + len(new) > MAX_HELD:
            self.known = {lang: (known := {})}
            new = list(set(prefixes))
        head, seed, size = lang + b"\0", HASH_SEED, MAP_BITS - 1
        at = np.array([xxhash.xxh64_intdigest(head + p, seed) & size for p in new], np.int64)
        known.update(zip(new, (self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool).tolist()))
        return np.fromiter(map(known.__getitem__, prefixes), bool, len(prefixes))


def _listed(column: pa.Array) -> list:
    return column.to_numpy(zero_copy_only=False).tolist()


def _runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]])) if len(values) else np.zeros(1, int)


class _Cut:
    """Terms, or their prefixes, of a slice of texts that lie in the order of their keys.

    ``keys`` are those of the groups of texts, the language first. Each pair of term and text
    is one number, so that sorting the numbers gives documents and occurrences by group.
    """

    def __init__(self, cut: pa.RecordBatch, width: int | None = None):
        *columns, _ = cut.columns
        of_text = list(zip(*map(_listed, columns)))
        order = sorted(range(len(of_text)), key=of_text.__getitem__)
        of_text = [of_text[i] for i in order]
        self.keys = sorted(set(of_text))
        number = {key: i for i, key in enumerate(self.keys)}
        group = np.array([number[key] for key in of_text])
        self.langs = sorted({key[0] for key in self.keys})
        self.lang_of = np.array([self.langs.index(key[0]) for key in self.keys])
        texts = cut.columns[-1].take(pa.array(order, pa.int64()))
        self.terms, codes, words_of = coded_words(texts, _TERM_BYTES)
        if width is not None:
            prefixes = pa.compute.binary_slice(self.terms, 0, width).dictionary_encode()
            self.terms, codes = prefixes.dictionary, prefixes.indices.to_numpy()[codes]
        pairs = codes * np.int64(len(order)) + np.repeat(np.arange(len(order)), words_of)
        pairs.sort()
        self.first = _runs(pairs)  # of each term in a text
        pairs = pairs[self.first[:-1]]
        self.code, self.group = pairs // len(order), group[pairs % len(order)]
        self.alive: dict[str, np.ndarray] = {}  # of each language, which terms are alive

    def documents(self, look: _Alive, shortest: int):
        """Places of live terms of ``shortest`` bytes at least, their languages, and how many texts hold them."""
        lang = self.lang_of[self.group]
        at = _runs(self.code * len(self.langs) + lang)
        code, lang, count = self.code[at[:-1]], lang[at[:-1]], np.diff(at)
        live = self._live(look, code, lang)
        live &= pa.compute.binary_length(self.terms).to_numpy()[code] >= shortest
        return code[live], lang[live], count[live]

    def occurrences(self, look: _Alive):
        """Places of live terms, their groups, and how often they occur there."""
        at = _runs(self.code * len(self.keys) + self.group)
        code, group, count = self.code[at[:-1]], self.group[at[:-1]], np.diff(self.first[at])
        live = self._live(look, code, self.lang_of[group])
        return code[live], group[live], count[live]

    def _live(self, look: _Alive, code: np.ndarray, lang: np.ndarray) -> np.ndarray:
        live = np.zeros(len(code), bool)
        for number, name in enumerate(self.langs):
            mine = np.flatnonzero(lang == number)
            if name not in self.alive:
                held = code[mine[_runs(code[mine])[:-1]]]
                self.alive[name] = np.zeros(len(self.terms), bool)
                self.alive[name][held] = look.of(name.encode(), self.terms.take(pa.array(held)))
            live[mine] = self.alive[name][code[mine]]
        return live


class _Held:
    """Counts by key and term, added up until there are too many to hold."""

    def __init__(self, names: list[str], kind: pa.DataType):
        self.names, self.kind = names, kind
        self.numbers, self.parts, self.rows, self.merged = {}, [], 0, 0

    def add(self, keys: list[tuple], key: np.ndarray, terms: pa.Array, counts: np.ndarray) -> None:
        numbers = np.array([self.numbers.setdefault(k, len(self.numbers)) for k in keys], np.int32)
        columns = [pa.array(numbers[key]), terms, pa.array(counts, pa.int64())]
        self.parts.append(pa.table(columns, names=["key", "term", "count"]))
        self.rows += len(counts)

    def full(self) -> Iterator[pa.RecordBatch]:
        """Everything held, if that is too much."""
        if self.rows > MAX_HELD // 2 + self.merged:
            self._merge()
            if self.merged > MAX_HELD:
                yield from self.all()

    def _merge(self) -> None:
        together = pa.concat_tables(self.parts).combine_chunks().group_by(["key", "term"], use_threads=False)
        self.parts = [together.aggregate([("count", "sum")]).select(["key", "term", "count_sum"]).rename_columns(["key", "term", "count"])]
        self.rows = self.merged = len(self.parts[0])

    def all(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            self._merge()
            for batch in self.parts[0].combine_chunks().to_batches(max_chunksize=EMITTED_ROWS):
                keys = [pa.array(values, pa.string()).take(batch.column(0)) for values in zip(*self.numbers)]
                yield pa.RecordBatch.from_arrays([*keys, batch.column(1).cast(self.kind), batch.column(2)], names=self.names)
        self.numbers, self.parts, self.rows, self.merged = {}, [], 0, 0


def _key(lang, prefix):
    return F.concat(lang.cast("binary"), F.lit(b"\0"), prefix)


def _bit_map(prefixes: DataFrame, settled: list[DataFrame]) -> np.ndarray:
    """The surviving ``(lang, prefix)`` and the whole terms kept so far as ``MAP_BITS`` bits."""
    for short in settled[:-1]:  # those of this pass are among its prefixes
        prefixes = prefixes.unionByName(short)
    place = F.xxhash64(_key(F.col("lang"), F.col("prefix"))).bitwiseAND(F.lit(MAP_BITS - 1))
    byte = F.shiftright(place, 3).cast("int").alias("byte")
    flag = F.call_function("shiftleft", F.lit(1), place.bitwiseAND(F.lit(7)).cast("int"))
    set_bytes = prefixes.groupBy(byte).agg(F.bit_or(flag).alias("flags")).toPandas()
    bits = np.zeros(MAP_BITS >> 3, np.uint8)
    bits[set_bytes["byte"].to_numpy()] = set_bytes["flags"].to_numpy()
    return bits


def _prefix_documents(clean: DataFrame, width: int, alive: tuple | None, shortest: int = 0) -> DataFrame:
    """``(lang, prefix, count)``: documents of a language holding a term with the prefix.

    Only terms of at least ``shortest`` bytes are counted.
    """
    before = None if alive is None else clean.sparkSession.sparkContext.broadcast(alive)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held = _Alive(*(before.value if before else (None, 0))), _Held(["lang", "prefix", "count"], pa.binary())
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                cut = _Cut(part, width)
                code, lang, documents = cut.documents(look, shortest)
                held.add([(name,) for name in cut.langs], lang, cut.terms.take(pa.array(code)), documents)
                yield from held.full()
        yield from held.all()

    parts = clean.select("lang", "text").mapInArrow(count, "lang string, prefix binary, count long")
    return parts.groupBy("lang", "prefix").agg(F.sum("count").alias("count"))


def _term_counts(clean: DataFrame, alive: tuple | None, shortest: int = 0) -> DataFrame:
    """``(lang, source, term, count)`` of the terms that may be kept.

    Occurrences by source; rows without a source count documents of the language, of
    terms of at least ``shortest`` bytes.
    """
    before = None if alive is None else clean.sparkSession.sparkContext.broadcast(alive)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, held = _Alive(*(before.value if before else (None, 0))), _Held(["lang", "source", "term", "count"], pa.string())
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                cut = _Cut(part)
                code, lang, documents = cut.documents(look, shortest)
                held.add([(name, None) for name in cut.langs], lang, cut.terms.take(pa.array(code)), documents)
                code, group, occurrences = cut.occurrences(look)
                held.add(cut.keys, group, cut.terms.take(pa.array(code)), occurrences)
                yield from held.full()
        yield from held.all()

    schema = "lang string, source string, term string, count long"
    parts = clean.select("lang", "source", "text").mapInArrow(count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"))


def _share(count, total, terms):
    """``1 + floor(scale * (count + 5) / (total + 5 * terms))`` without overflow."""
    wide = lambda c: F.coalesce(c, F.lit(0)).cast("decimal(28,0)")
    scaled = (wide(count) + SMOOTHING) * SHARE_SCALE
    return 1 + F.call_function("div", scaled, wide(total) + SMOOTHING * wide(terms))


def _report(counts: DataFrame, groups: DataFrame, top_terms: int) -> DataFrame:
    kept = counts.groupBy("lang", "term").agg(F.max("in_lang").alias("in_lang"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("V"), F.sum("in_lang").alias("lang_total"))
    totals = counts.groupBy("lang", "source").agg(F.sum("occurrences").alias("total"))
    # One row per group of documents: its share of a kept term that it does not hold.
    bases = store(
        groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left"), "bases"
    )
    shares = counts.join(bases, ["lang", "source"]).select(
        "lang",
        "source",
        "term",
        "V",
        _share(F.col("occurrences"), F.col("total"), F.col("V")).alias("p"),
        _share(F.col("in_lang"), F.col("lang_total"), F.col("V")).alias("q"),
    )
    shares = store(shares, "shares")
    parts = ["lang", "source", "part", "item", "value"]

    over = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value")
    )
    by_value = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top_terms)

    pairs = _pair_distances(shares, bases).select(*parts)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(terms)


def _pair_distances(shares: DataFrame, bases: DataFrame) -> DataFrame:
    """Sum over all kept terms of the difference of shares, for every two sources of a language.

    Terms are dealt into blocks by hash; a block's task holds one share per source and
    term, those of absent terms filled in, and adds up all pairs of its sources. The
    block sums of a pair are added by Spark.
    """
    absent = _share(F.lit(0), F.col("total"), F.col("V"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("V") / TERM_BLOCK)).cast("int")
    number = lambda: F.pmod(F.xxhash64("term"), blocks).cast("int")
    none = F.lit(None).cast("string")
    # Each block gets a row per source, so that it knows them all.
    known = bases.select(
        "lang",
        F.explode(F.sequence(F.lit(0), F.coalesce(blocks, F.lit(1)) - 1)).alias("block"),
        "source",
        none.alias("term"),
        F.when(F.col("V") > 0, absent).otherwise(0).alias("p"),
    )
    rows = known.unionByName(shares.select("lang", number().alias("block"), "source", "term", "p"))

    def distances(group: pd.DataFrame) -> pd.DataFrame:
        absent = group[group["term"].isna()].sort_values("source")
        present = group[group["term"].notna()]
        sources = absent["source"].to_numpy()
        row = pd.Series(np.arange(len(sources)), index=sources)[present["source"]].to_numpy()
        column, terms = pd.factorize(present["term"])
        share = np.repeat(absent["p"].to_numpy(np.int64)[:, None], len(terms), axis=1)
        share[row, column] = present["p"].to_numpy(np.int64)
        apart = [np.abs(share - share[i]).sum(axis=1) for i in range(len(sources))]
        first, second = np.nonzero(~np.eye(len(sources), dtype=bool))
        value = np.concatenate(apart)[first * len(sources) + second] if len(first) else first
        return pd.DataFrame(
            {"lang": group["lang"].iloc[0], "source": sources[first], "item": sources[second], "value": value}
        )

    schema = "lang string, source string, item string, value long"
    per_block = rows.groupBy("lang", "block").applyInPandas(distances, schema)
    summed = per_block.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return summed.withColumn("part", F.lit("pair"))
