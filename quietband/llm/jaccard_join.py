"""N-gram Jaccard self-join by vertical partitioning, with components of linked texts.

Equal sets are one class from the start. All n-grams are put into one global
order, rare ones first; two sets as similar as asked must share an n-gram among
the first quarter of each. The order's prefix entries are dealt by n-gram; every
list of classes that share one is named after one member, the centre, so lists
of the same family carry the same name and a class appears under few names
however many n-grams it shares. Members of a name are compared in tiles, first
by their prefixes, which rule most pairs out, then as wholes: the order of their
n-grams is cut into fragments, overlaps are counted per fragment by a matrix
product and summed per pair. A tile passes on a spanning forest of
its links, never the pairs, and components follow from the forests.

The order needs frequencies of the frequent n-grams only; they are counted over
all texts. Which n-grams count as frequent changes the work, never the result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietband.llm.common import slices, store
from quietband.llm.shingles import mixed, set_key, shingle_sets
from quietband.operators.graph import connected_components

SIMILARITY = 75  # per cent
# Texts that share an n-gram before it counts as frequent, and n-grams shipped as such.
FREQUENT_FROM = 8
MAX_FREQUENT = 1_000_000
# N-grams a task counts at once; prefix entries per bucket; classes per tile side.
WINDOW = 8_000_000
BUCKET_ENTRIES = 500_000
TILE = 256
# Width of a fragment of the n-gram order inside a tile.
FRAGMENT = 4096
# Size classes of sets, and how many classes similar sets may lie apart (1.1 ** 5 > 1 / 0.75).
SIZE_STEP = 1.1
LEVELS_APART = 5
# Bits of the filter that keeps texts without candidates out of the comparison.
FILTER_BITS = 1 << 26
# Leading bytes kept of each n-gram hash when classes are compared.
HASH_BYTES = 6
# Upper bound of all kept hashes, for prefixes that hold every rare n-gram.
LAST_CUT = 1 << 48


def _texts(batches: Iterator[pa.RecordBatch]):
    """Position in the batch and shingle set of every row, batch by batch."""
    for batch in batches:
        for part in slices(batch, batch.num_columns - 1, 4 << 20):
            yield part, shingle_sets(part.column(part.num_columns - 1))


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text ``(id, key, n)`` and, with ``gram`` set, counts of repeated n-grams."""
    kind = docs.schema[id_col].dataType.simpleString()

    def counted(held: list[np.ndarray]):
        grams, counts = np.unique(np.concatenate(held), return_counts=True)
        grams, counts = grams[counts > 1], counts[counts > 1]
        nulls = pa.nulls(len(grams), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(grams), id_type), nulls, pa.array(counts, pa.int64()), pa.array(grams.view(np.int64))],
            names=["id", "key", "n", "gram"],
        )

    id_type = _arrow_type(docs, id_col)

    def scan(batches):
        held, size, seen = [], 0, set()
        for part, sets in _texts(batches):
            keys, counts = [], []
            for s in sets:
                keys.append(set_key(s) if len(s) else None)
                counts.append(len(s))
                if keys[-1] is not None and keys[-1] not in seen:
                    held.append(s)
                    size += len(s)
                    seen.add(keys[-1])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.nulls(len(keys), pa.int64())],
                names=["id", "key", "n", "gram"],
            )
            if size > WINDOW:
                yield from counted(held)
                held, size, seen = [], 0, set()
        if held:
            yield from counted(held)

    schema = f"id {kind}, key long, n long, gram long"
    return docs.select(id_col, text_col).mapInArrow(scan, schema)


def _arrow_type(docs: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema[name].dataType)


def _frequent(scanned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """N-grams in many texts, sorted, and their place in the order; of bounded size."""
    counts = scanned.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = store(counts.where(F.col("n") >= FREQUENT_FROM), "frequent")
    sizes = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("rows")).collect()
    held, least = 0, FREQUENT_FROM
    for level, rows in sorted(((r["level"], r["rows"]) for r in sizes), reverse=True):
        held += rows
        if held > MAX_FREQUENT:
            least = 2 ** (level + 1)
            break
    found = counts.where(F.col("n") >= least).toPandas()
    grams = found["gram"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(grams)
    place = np.empty(len(grams), np.int64)
    place[np.lexsort((grams, found["n"].to_numpy()))] = np.arange(len(grams))
    return grams[order], place[order]


def prefix(grams: np.ndarray, frequent: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, int]:
    """First n-grams of a sorted set in the global order, as many as any similar set must meet.

    Rare ones come first, by hash; the second value is how many of them there are.
    """
    count = len(grams) - (SIMILARITY * len(grams) + 99) // 100 + 1
    if not len(frequent):
        return grams[:count], count
    at = np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)
    known = frequent[at] == grams
    rare = grams[~known]
    if len(rare) >= count:
        return rare[:count], count
    rest = grams[known][np.argsort(place[at[known]])][: count - len(rare)]
    return np.append(rare, rest), len(rare)


def entry_marks(count: int, size: int) -> np.ndarray:
    """One byte per prefix entry: size class of the set, and whether the entry is among the
    fewer first ones of which a similar set of at least this size must meet one."""
    level = min(127, int(math.log(size) / math.log(SIZE_STEP)))
    least = -(-2 * SIMILARITY * size // (100 + SIMILARITY))
    return (np.arange(count) < size - least + 1).astype(np.uint8) << 7 | np.uint8(level)


def _prefix_entries(docs: DataFrame, text_col: str, frequent, place, buckets: int) -> DataFrame:
    """``(bucket, grams, keys, marks)``: prefix entries of a task's distinct sets, packed per bucket."""
    order = docs.sparkSession.sparkContext.broadcast((frequent, place))

    def flush(grams: list, keys: list, marks: list):
        gram, key, mark = np.concatenate(grams), np.concatenate(keys), np.concatenate(marks)
        bucket = (mixed(gram) % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket, kind="stable")
        gram, key, mark, bucket = gram[turn], key[turn], mark[turn], bucket[turn]
        cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        spans = list(zip(cuts[:-1], cuts[1:]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cuts[:-1]]),
                pa.array([_packed(gram[a:b]) for a, b in spans], pa.binary()),
                pa.array([key[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([mark[a:b].tobytes() for a, b in spans], pa.binary()),
            ],
            names=["bucket", "grams", "keys", "marks"],
        )

    def emit(batches):
        grams, keys, marks, size, seen = [], [], [], 0, set()
        for _, sets in _texts(batches):
            for s in sets:
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                seen.add(key)
                grams.append(prefix(s, *order.value)[0])
                keys.append(np.full(len(grams[-1]), key, np.int64))
                marks.append(entry_marks(len(grams[-1]), len(s)))
                size += len(keys[-1])
            if size > WINDOW // 4:
                yield from flush(grams, keys, marks)
                grams, keys, marks, size, seen = [], [], [], 0, set()
        if grams:
            yield from flush(grams, keys, marks)

    return docs.select(text_col).mapInArrow(emit, "bucket long, grams binary, keys binary, marks binary")


def _centres(packed: pa.Table) -> pa.Table:
    """``(centre, member)`` of all lists of a bucket: the first class by hash names the list.

    Lists without any of the fewer first entries hold no similar pair, nor do lists of
    two classes whose sizes are too far apart.
    """
    joined = lambda column: b"".join(packed[column].to_pylist())
    gram, key = _unpacked(joined("grams")), np.frombuffer(joined("keys"), np.int64)
    mark = np.frombuffer(joined("marks"), np.uint8)
    turn = np.lexsort((mixed(key.view(np.uint64)), gram))
    gram, key, mark = gram[turn], key[turn], mark[turn]
    fresh = np.append(True, (gram[1:] != gram[:-1]) | (key[1:] != key[:-1]))[: len(gram)]
    gram, key, mark = gram[fresh], key[fresh], mark[fresh]
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    sizes = np.diff(np.append(first, len(gram)))
    level = (mark & 127).astype(np.int64)
    apart = np.maximum.reduceat(level, first) - np.minimum.reduceat(level, first) > LEVELS_APART
    wanted = (sizes > 1) & (np.maximum.reduceat(mark >> 7, first) > 0) & ~((sizes == 2) & apart)
    shared = np.repeat(wanted, sizes)
    centre = np.repeat(key[first], sizes)
    pairs = np.unique(np.stack([centre[shared], key[shared]], axis=1), axis=0)
    return pa.table({"centre": pairs[:, 0], "member": pairs[:, 1]})


def _wanted(members: DataFrame) -> np.ndarray:
    """Fixed-size filter of the classes that have candidates."""
    bit = F.pmod(F.xxhash64("member"), F.lit(FILTER_BITS))
    words = (
        members.select(F.shiftright(bit, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(member), {FILTER_BITS}) % 64 as int))").alias("bit"))
        .groupBy("word")
        .agg(F.bit_or("bit").alias("bits"))
        .toPandas()
    )
    filled = np.zeros(FILTER_BITS // 64, np.int64)
    filled[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return filled.view(np.uint64)


def _sets(docs: DataFrame, text_col: str, filled: np.ndarray, part=None) -> DataFrame:
    """``(member, n, cut, grams)`` of classes that pass the filter.

    ``grams`` holds the whole set, or with ``part`` the rare n-grams of its prefix:
    all rare ones up to ``cut``.
    """
    spark = docs.sparkSession.sparkContext
    wanted, order = spark.broadcast(filled), spark.broadcast(part)

    def emit(batches):
        seen = set()
        for _, sets in _texts(batches):
            rows = []
            for s in sets:
                key = set_key(s) if len(s) else None
                if key is None or key in seen:
                    continue
                bit = spark_hash(key) % FILTER_BITS
                if not (int(wanted.value[bit >> 6]) >> (bit & 63)) & 1:
                    continue
                seen.add(key)
                taken, cut = s, LAST_CUT
                if order.value is not None:
                    taken, rare = prefix(s, *order.value)
                    cut = LAST_CUT if rare < len(taken) or rare == len(s) else int(taken[-1] >> np.uint64(16))
                    taken = taken[:rare]
                rows.append((key, len(s), cut, _packed(taken)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["member", "n", "cut", "grams"])

    return docs.select(text_col).mapInArrow(emit, "member long, n long, cut long, grams binary")


def spark_hash(key: int) -> int:
    """Spark's xxhash64 of one long."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(np.int64(key).tobytes(), 42)).astype(np.int64)) % (1 << 64)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, counted per fragment of the n-gram order and summed."""
    grams = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    turn = np.argsort(grams, kind="stable")
    grams, owner = grams[turn], owner[turn]
    new = np.append(True, grams[1:] != grams[:-1])[: len(grams)]  # no grams, no runs
    run = np.cumsum(new) - 1
    shared = np.bincount(run) > 1
    kept = shared[run]
    column = (np.cumsum(shared) - 1)[run[kept]]
    owner = owner[kept]
    total = np.zeros((len(sets), len(sets)), np.int64)
    for low in range(0, int(shared.sum()), FRAGMENT):
        a, b = np.searchsorted(column, [low, low + FRAGMENT])
        part = np.zeros((len(sets), FRAGMENT if len(sets) > 16 else int(column[b - 1]) - low + 1), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        total += np.rint(part @ part.T).astype(np.int64)
    return total


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    edges, free = [], np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not free[root]:
            continue
        free[root] = False
        front = [root]
        while front:
            node = front.pop()
            new = np.flatnonzero(linked[node] & free)
            free[new] = False
            front.extend(new.tolist())
            edges.extend((root, int(x)) for x in new)
    return edges


def _packed(grams: np.ndarray) -> bytes:
    return grams.view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :].tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    full = np.zeros((len(raw) // HASH_BYTES, 8), np.uint8)
    full[:, :HASH_BYTES] = np.frombuffer(raw, np.uint8).reshape(-1, HASH_BYTES)
    return full.view(np.uint64).ravel()


def _across(name: tuple, sides: list[int]) -> np.ndarray:
    """Pairs a tile is responsible for: all of one side, or those between two sides."""
    side = np.array(sides)
    fits = side[:, None] != side[None, :] if name[1] != name[2] else np.ones((len(side),) * 2, bool)
    np.fill_diagonal(fits, False)
    return fits


def _links(name: tuple, rows: list[tuple]) -> list[tuple]:
    """Spanning forest of the links within a tile."""
    keys, sides, size, _, grams = zip(*rows)
    common = overlaps([_unpacked(raw) for raw in grams])
    size = np.array(size)
    linked = 100 * common >= SIMILARITY * (size[:, None] + size[None, :] - common)
    return [(keys[i], keys[j]) for i, j in forest(linked & _across(name, sides))]


def _hopeful(name: tuple, rows: list[tuple]) -> list[tuple]:
    """Members of a tile that may link with another, judged by their prefixes alone.

    Up to the smaller of two cuts both prefixes are complete, so what differs there
    differs for good, and similar sets differ in few n-grams: no link is lost.
    """
    keys, sides, size, cuts, grams = zip(*rows)
    sets, cut, size = [_unpacked(raw) for raw in grams], np.array(cuts, np.uint64), np.array(size)
    upto = np.stack([np.searchsorted(s, np.minimum(c, cut), "right") for s, c in zip(sets, cut)])
    differ = upto + upto.T - 2 * overlaps(sets)
    both = size[:, None] + size[None, :]
    fits = (100 + SIMILARITY) * differ <= (100 - SIMILARITY) * both
    fits &= 100 * np.minimum(size[:, None], size[None, :]) >= SIMILARITY * np.maximum(size[:, None], size[None, :])
    kept = (fits & _across(name, sides)).any(axis=1)
    return [(*name, keys[i], sides[i]) for i in np.flatnonzero(kept)]


def _by_tile(judge, names: list[str]):
    """Apply ``judge`` to the distinct classes of each tile; rows come sorted by tile and class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, rows = None, []

        def out(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(len(names))]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            found = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(8)]):
                if row[:3] != name:
                    found += judge(name, rows) if len(rows) > 1 else []
                    name, rows = row[:3], []
                if not rows or row[3] != rows[-1][0]:  # copies of a class lie side by side
                    rows.append(row[3:])
            yield out(found)
        yield out(judge(name, rows) if len(rows) > 1 else [])

    return run


def _judged(tiles: DataFrame, sets: DataFrame, judge, names: list[str]) -> DataFrame:
    tile = ["centre", "low", "high"]
    return (
        tiles.join(sets, "member")
        .select(*tile, "member", "side", "n", "cut", "grams")
        .repartition(*tile)
        .sortWithinPartitions(*tile, "member")
        .mapInArrow(_by_tile(judge, names), ", ".join(f"{c} long" for c in names))
    )


def _linked(hopeful: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges whose components are those of all links among the members of tiles.

    Each class is first compared under one name only. Tiles whose members are then in
    one component have nothing to add; the others are compared as well.
    """
    tile = ["centre", "low", "high"]
    home = hopeful.groupBy("member").agg(F.min(F.struct(F.xxhash64("centre"), "centre"))["centre"].alias("home"))
    placed = store(hopeful.join(home, "member").withColumn("at_home", F.col("centre") == F.col("home")), "placed")
    columns = [*tile, "member", "side"]
    first = _judged(placed.where("at_home").select(*columns), sets, _links, ["i", "j"]).distinct()
    first = store(first.withColumn("weight", F.lit(1.0)), "links")
    labels = connected_components(first).withColumnRenamed("node", "member")
    known = placed.join(labels, "member", "left").withColumn("component", F.coalesce("component", "member"))
    state = known.groupBy(*tile).agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.bool_and("at_home").alias("done")
    )
    rest = placed.join(state.where("a != b and not done"), tile).select(*columns)
    second = _judged(rest, sets, _links, ["i", "j"]).distinct().withColumn("weight", F.lit(1.0))
    return store(first.unionByName(second), "links")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_shingles, component_id)``, one row per row of ``docs``.

    ``component_id`` is the smallest id reachable over links. Texts that are NULL,
    empty or without words have 0 shingles and stand alone under their own id, a
    NULL id included. Rows with equal sets share a component. Any extra columns are
    ignored, and an empty table gives an empty result.
    """
    scanned = store(_scan(docs, id_col, text_col), "scanned")
    texts = scanned.where("gram is null").drop("gram")
    total = texts.agg(F.sum("n")).first()[0] or 0
    frequent, place = _frequent(scanned)
    buckets = max(16, total * (100 - SIMILARITY) // 100 // BUCKET_ENTRIES)
    entries = _prefix_entries(docs, text_col, frequent, place, buckets)
    pairs = entries.groupBy("bucket").applyInArrow(_centres, "centre long, member long")
    members = store(pairs.distinct(), "members")
    sizes = members.groupBy("centre").agg(F.ceil(F.count("*") / F.lit(TILE)).alias("sides"))
    tiles = (
        members.join(sizes, "centre")
        .withColumn("side", F.pmod(F.xxhash64("member"), F.col("sides")))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
        .select("centre", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "member", "side")
    )
    prefixes = _sets(docs, text_col, _wanted(members), (frequent, place))
    names = ["centre", "low", "high", "member", "side"]
    hopeful = store(_judged(tiles, prefixes, _hopeful, names), "hopeful")
    sets = store(_sets(docs, text_col, _wanted(hopeful)), "sets")
    edges = _linked(hopeful, sets)
    classes = texts.where("key is not null").groupBy("key").agg(
        F.min("id").alias("least"), F.count("*").alias("copies")
    )
    classes = store(classes, "classes")
    labels = connected_components(edges)
    known = labels.join(classes, F.col("node") == F.col("key")).select("component", "key", "least")
    smallest = known.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = known.join(smallest, "component").select("key", "component_id")
    copied = classes.where("copies > 1").join(linked, "key", "left_anti").select(
        "key", F.col("least").alias("component_id")
    )
    joined = texts.join(linked.unionByName(copied), "key", "left")
    return joined.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
