"""Near-duplicate documents: circulant MinHash, banding, exact Jaccard, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Places of the shifted permutation.
PLACES = 1 << 20

#: Stands for a null id inside; smaller than any other id.
NO_ID = -(1 << 63)


class Circulant:
    """Signatures of shingle sets from two permutations.

    The first, a bijection of 64-bit words, spreads the shingles over the
    places; the second, a permutation of the places, gives coordinate k when it
    is shifted circularly by k: the least of its values over the set's places
    plus k.
    """

    def __init__(self, bands: int, rows: int, seed: int = 1):
        self.bands, self.rows = bands, rows
        n = bands * rows
        order = np.random.default_rng(seed).permutation(PLACES).astype(np.uint32)
        self.windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([order, order[: n - 1]]), n)
        self.salt = common.mix(np.arange(1, bands + 1, dtype=np.uint64) + np.uint64(seed << 32))

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = (common.mix(shingles) >> np.uint64(44)).astype(np.int64)
        out = np.full(self.windows.shape[1], 0xFFFFFFFF, np.uint32)
        for at in range(0, len(places), 1024):
            np.minimum(out, self.windows[places[at : at + 1024]].min(axis=0), out=out)
        return out

    def band_keys(self, shingles: np.ndarray) -> np.ndarray:
        """One 64-bit key a band, from its number and its ``rows`` coordinates."""
        s = self.signature(shingles).astype(np.uint64).reshape(self.bands, self.rows)
        h = self.salt.copy()
        for k in range(self.rows):
            h = common.mix(h ^ s[:, k])
        return h.view(np.int64)


_CIRCULANTS: dict[tuple[int, int], Circulant] = {}


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; A-Z count as a-z."""
    return np.unique(common.shingle_hashes(common.word_hashes(text.lower())[0], width))


def set_key(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, n (size of the shingle set), key (digest of the set) and band keys of every row."""
    source = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID).cast("long")).alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        tool = _CIRCULANTS.setdefault((bands, rows), _CIRCULANTS.get((bands, rows)) or Circulant(bands, rows))
        n, keys, sketches = [], [], []
        for body in common.texts(batch.column("text")):
            s = shingle_set(body, width)
            n.append(len(s))
            keys.append(set_key(s))
            sketches.append(tool.band_keys(s) if len(s) else [])
        yield common.batch_of({"id": batch.column("id"), "n": n, "key": keys, "bands": sketches}, {"n": pa.int64(), "key": pa.binary(), "bands": pa.list_(pa.int64())})

    return common.map_arrow(source, run, "id long, n long, key binary, bands array<long>")


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected to) for the nodes of ``edges`` (a, b).

    Each round points every node to its smallest neighbour, follows the pointers
    three times over, which goes eight nodes along a chain, and contracts the edges along
    them; the rounds are few and ever smaller. The pointers of the rounds are put
    together at the end.
    """
    ordered = lambda a, b: (F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    left = common.stored(edges.select(*ordered(F.col("a"), F.col("b"))).filter("a <> b").distinct())
    rounds = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = common.stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up")))
        for _ in range(3):
            up = up.join(up.select(F.col("node").alias("up"), F.col("up").alias("far")), "up").select("node", F.col("far").alias("up"))
        up = common.stored(up)
        rounds.append(up)
        ends = left.join(up.select(F.col("node").alias("a"), F.col("up").alias("ua")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("ub")), "b")
        left = common.stored(ends.select(*ordered(F.col("ua"), F.col("ub"))).filter("a <> b").distinct())
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = rounds[-1].select("node", F.col("up").alias("root"))
    for up in reversed(rounds[:-1]):
        after = roots.select(F.col("node").alias("up"), F.col("root"))
        roots = up.join(after, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return common.stored(roots)


def links(sets: list[np.ndarray], asks: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs that connect the rows just as all pairs (an asking row, any row) with
    100 * intersection >= percent * union do.

    Intersections are counted exactly: shingles that many sets share by matrix
    product, the others by the pairs of rows that hold them.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(n), sizes)
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.zeros((n, n), np.int32)
    order = np.lexsort((rows, column))
    rows, column = rows[order], column[order]
    begin = np.concatenate([[0], np.cumsum(df)])
    for d in range(2, min(16, df.max(initial=0) + 1)):
        own = np.flatnonzero(df == d)
        if len(own):
            at = rows[begin[own][:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    np.add.at(shared, (at[:, i], at[:, j]), 1)
    shared += shared.T
    own = np.flatnonzero(df >= 16)
    for k in range(0, len(own), 2048):
        part = own[k : k + 2048]
        dense = np.zeros((n, len(part)), np.float32)
        for c, v in enumerate(part):
            dense[rows[begin[v] : begin[v + 1]], c] = 1
        shared += (dense @ dense.T).astype(np.int32)
    np.fill_diagonal(shared, 0)
    linked = 100 * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - shared)
    linked[~asks] = False
    linked |= linked.T
    np.fill_diagonal(linked, False)
    out, todo = [], np.ones(n, bool)
    for root in range(n):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            i = front.pop()
            for j in np.flatnonzero(linked[i] & todo):
                todo[j] = False
                out.append((i, int(j)))
                front.append(int(j))
    return out


def check_heads(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: verified links of each member to its head; ``rows``: head, chunk, is_head, id, text.

    Each head and chunk is read in one stream, the head first; memory holds the
    head's set and one member's.
    """
    dealt = rows.repartition("head", "chunk").sortWithinPartitions("head", "chunk", F.desc("is_head"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in common.sliced(batches):
            a, b = [], []
            for head, is_head, i, body in zip(batch.column("head").to_pylist(), batch.column("is_head").to_pylist(), batch.column("id").to_pylist(), common.texts(batch.column("text"))):
                s = shingle_set(body, width)
                if is_head:
                    own = s
                    continue
                k = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * k >= percent * (len(own) + len(s) - k):
                    a.append(i)
                    b.append(head)
            yield common.batch_of({"a": a, "b": b}, {"a": pa.int64(), "b": pa.int64()})

    return dealt.select("head", "is_head", "id", "text").mapInArrow(run, "a long, b long")


def check_units(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: verified links within each unit of ``rows`` (unit, id, asks, text) between a row that asks and any other.

    A unit, whose size the caller bounds, lies in one task together; the task
    reads its units one after another.
    """
    dealt = rows.repartition("unit").sortWithinPartitions("unit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, ids, asks, sets = None, [], [], []

        def found() -> pa.RecordBatch:
            pairs = links(sets, np.array(asks, bool), percent) if len(sets) > 1 else []
            return common.batch_of({"a": [ids[i] for i, _ in pairs], "b": [ids[j] for _, j in pairs]}, {"a": pa.int64(), "b": pa.int64()})

        for batch in common.sliced(batches):
            for u, i, q, body in zip(batch.column("unit").to_pylist(), batch.column("id").to_pylist(), batch.column("asks").to_pylist(), common.texts(batch.column("text"))):
                if u != unit and sets:
                    yield found()
                    ids, asks, sets = [], [], []
                unit = u
                ids.append(i)
                asks.append(q)
                sets.append(shingle_set(body, width))
        if sets:
            yield found()

    return dealt.select("unit", "id", "asks", "text").mapInArrow(run, "a long, b long")


def _bitmap(ids: DataFrame, bits: int = 1 << 26) -> np.ndarray:
    """Which of ``bits`` hash values the ids have: at most 8 MB, however many ids."""
    h = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1  # these functions number bits from 1
    maps = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("m")).collect()
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in maps:
        own = np.frombuffer(bytes(r["m"]), np.uint8)
        out[(r["k"] - 1) * 4096 : (r["k"] - 1) * 4096 + len(own)] |= own
    return out


def texts_of(docs: DataFrame, members: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """``members`` (id, key and more) with the text of one row of each: the shuffle has few other rows.

    A bit map of the wanted ids, of fixed size, is broadcast and rules out most
    other rows where they are read.
    """
    spark, bits = docs.sparkSession, 1 << 26
    wanted = spark.sparkContext.broadcast(_bitmap(members, bits))
    source = docs.select(F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID).cast("long")).alias("id"), F.col(f"`{text}`").alias("text"))
    hashed = source.withColumn("h", F.pmod(F.xxhash64("id"), F.lit(bits)))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        h = batch.column("h").to_numpy()
        keep = pa.array((wanted.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1)
        own = batch.filter(keep)
        if own.num_rows:
            bodies = common.texts(own.column("text"))
            keys = [set_key(shingle_set(b, width)) for b in bodies]
            yield common.batch_of({"id": own.column("id"), "key": keys, "text": own.column("text")}, {"key": pa.binary()})

    found = common.map_arrow(hashed, run, "id long, key binary, text string")
    return found.join(members, ["id", "key"]).dropDuplicates(["id", "key"])


def _grouped(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85,
    bands: int = 36, rows: int = 7, unit_docs: int = 1000, unit_shingles: int = 1_500_000, pivots: int = 2,
) -> DataFrame:
    """id, n, key of every row, and first_id, first_key: the smallest id of its component and the set of a row with it.

    Both are null for rows that are alone. An id may have rows of several sets:
    classes are told apart by a number of their own (node), not by an id.
    """
    signed = common.cut(signatures(docs, doc_id, text, width, bands, rows))
    sets = signed.select("id", "n", "key")
    each = signed.filter("n > 0").groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count(F.lit(1)).alias("copies"))
    classes = common.cut(each.withColumn("node", F.monotonically_increasing_id()))
    keyed = classes.select("node", F.explode("bands").alias("band"))
    # the same order of nodes in every band, so that a family has few heads
    least = lambda k: F.min(F.struct(F.xxhash64(F.lit(k), "node"), F.col("node").alias("node")))["node"]
    buckets = keyed.groupBy("band").agg(F.array_distinct(F.array(*map(least, range(pivots)))).alias("heads"), F.count(F.lit(1)).alias("m")).filter("m > 1")
    shared = common.cut(keyed.join(buckets, "band"))
    star = common.stored(shared.select("node", F.explode("heads").alias("head")).filter("node <> head").distinct())
    members = star.select("node").union(star.select("head")).distinct().join(classes.select("node", "id", "key", "n"), "node")
    bodies = common.cut(texts_of(docs, members, doc_id, text, width).select(F.col("node").alias("id"), "text", "n"))
    verified = common.stored(check_heads(_streams(star, bodies, unit_docs), width, percent))
    roots = connected(verified)
    open_ = common.stored(_unresolved(shared.join(bodies.select(F.col("id").alias("node"), "n"), "node"), roots))
    for more in range(1, 3):
        # members of the largest component that were no heads so far, and twice as many each time
        if open_.isEmpty():
            break
        few = range(pivots * 2**more, pivots * 2 ** (more + 1))
        heads = open_.filter("root = main").groupBy("main").agg(F.array_distinct(F.array(*map(least, few))).alias("heads"))
        asked = open_.filter("root <> main").select("node", "main").distinct().join(heads, "main")
        star = common.stored(asked.select("node", F.explode("heads").alias("head")).filter("node <> head").distinct())
        verified = verified.unionByName(common.stored(check_heads(_streams(star, bodies, unit_docs), width, percent)))
        roots = connected(verified)
        open_ = common.stored(_unresolved(open_.drop("root", "main", "low", "high"), roots))
    if not open_.isEmpty():
        verified = verified.unionByName(common.stored(check_units(_units(open_, bodies, percent, unit_docs, unit_shingles), width, percent)))
        roots = connected(verified)
    linked = classes.select("node", "id", "key", "copies").join(roots, "node", "left")
    first = linked.filter("root is not null").groupBy("root").agg(F.min(F.struct("id", "key")).alias("f"))
    # of the classes, only those with copies or links need to be told to the rows
    told = linked.filter("copies > 1 or root is not null").join(first, "root", "left").select("key", F.coalesce("f.id", "id").alias("first_id"), F.coalesce("f.key", "key").alias("first_key"))
    return sets.join(told, "key", "left")


def _streams(star: DataFrame, bodies: DataFrame, unit_docs: int) -> DataFrame:
    """Rows for ``check_heads``: each pair's member under its head, a head of many members in several chunks."""
    chunks = common.stored(star.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / min(unit_docs, 128)).cast("int").alias("chunks")))
    asked = star.join(chunks, "head").select("head", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("is_head"), F.col("node").alias("id"))
    heads = chunks.select("head", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("is_head"), F.col("head").alias("id"))
    return common.stored(asked.unionByName(heads)).join(bodies.select("id", "text"), "id")


def _unresolved(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``shared`` (band, node, n, m, heads) whose bucket may still miss links, with root, main, low and high.

    A bucket is settled if its classes are connected already, or if all pairs
    were compared, as at most one class is no head. In the others, ``main`` is the
    largest component in it, ``low`` to ``high`` are the set sizes outside. Buckets of the same classes count once.
    """
    at = common.stored(shared.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    groups = at.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("m").alias("m"), F.first(F.size("heads")).alias("h"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("same"))
    groups = common.stored(groups)
    left = groups.groupBy("band", "m", "h").agg(F.count(F.lit(1)).alias("parts"), F.sum("same").alias("same"), F.max_by("root", F.struct("c", -F.col("root"))).alias("main")).filter("parts > 1 and h < m - 1")
    once = left.groupBy("m", "same").agg(F.min(F.struct("band", "main")).alias("b")).select("b.band", "b.main")
    facts = groups.join(once, "band").filter("root <> main").groupBy("band", "main").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return at.join(facts, "band")


def _units(open_: DataFrame, bodies: DataFrame, percent: int, unit_docs: int, unit_shingles: int) -> DataFrame:
    """unit, id, asks, text: every class outside a bucket's main component meets every class of it in some bounded unit.

    Buckets with the same main component go together where that moves fewer rows
    than one by one: in a family of near copies, most buckets hold the same
    classes. Those that ask are dealt into the rows of a grid, all classes of a size that can
    be linked to one of theirs into its columns; a unit is a row and a column together.
    """
    few, most = max(1, unit_docs // 4), max(1, unit_docs - unit_docs // 4)
    each = open_.select("band", "main", "node", "n", "low", "high", (F.col("root") != F.col("main")).alias("asks"))
    near = lambda low, high: F.col("asks") | ((F.col("n") * 100 >= low * percent) & (F.col("n") * percent <= high * 100))
    apart = each.filter(near(F.col("low"), F.col("high"))).select("main", F.concat(F.lit("b"), F.col("band").cast("string")).alias("group"), "node", "n", "asks")
    span = each.groupBy("main").agg(F.min("low").alias("g_low"), F.max("high").alias("g_high"))
    nodes = each.groupBy("main", "node").agg(F.first("n").alias("n"), F.max("asks").alias("asks")).join(span, "main")
    together = nodes.filter(near(F.col("g_low"), F.col("g_high"))).select("main", F.concat(F.lit("m"), F.col("main").cast("string")).alias("group"), "node", "n", "asks")
    rows = common.stored(apart.unionByName(together))
    side = lambda c, size, share: F.greatest(F.least(F.lit(8), F.ceil(F.count(F.when(c, 1)) / 32)), F.ceil(F.count(F.when(c, 1)) / size), F.ceil(F.sum(F.when(c, F.col("n")).otherwise(0)) / (unit_shingles * share)), F.lit(1)).cast("int")
    grid = rows.groupBy("main", "group").agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("ask"), side(F.col("asks"), few, 0.25).alias("rows"), side(F.lit(True), most, 0.75).alias("columns"))
    moved = grid.withColumn("moved", F.col("all") * F.col("rows") + F.col("ask") * F.col("columns"))
    kind = F.substring("group", 1, 1)
    better = moved.groupBy("main").agg(F.sum(F.when(kind == "b", F.col("moved"))).alias("b"), F.sum(F.when(kind == "m", F.col("moved"))).alias("m"))
    chosen = common.stored(moved.join(better, "main").filter((kind == "m") == (F.col("m") < F.col("b"))).select("group", "rows", "columns"))
    told = common.stored(rows.join(chosen, "group"))
    spot = lambda k, n: F.pmod(F.xxhash64(F.lit(k), "node"), F.col(n)).cast("int")
    asks = told.filter("asks").withColumn("i", spot("row", "rows")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    hears = told.withColumn("j", spot("column", "columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    placed = asks.select("group", "i", "j", "node", F.lit(True).alias("asks")).unionByName(hears.select("group", "i", "j", "node", F.lit(False).alias("asks")))
    # a class that asks in a unit need not be there twice
    once = placed.groupBy("group", "i", "j", "node").agg(F.max("asks").alias("asks"))
    return once.join(bodies.select(F.col("id").alias("node"), "text"), "node").select(F.concat_ws("/", "group", "i", "j").alias("unit"), F.col("node").alias("id"), "asks", "text")


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; ``options`` and their values are those of ``_grouped``.

    Texts are linked if 100 * intersection >= ``percent`` * union of their sets
    of ``width``-word shingles; a component's id is its smallest document id.
    A text of fewer words is one shingle; one without words is linked to nothing.

    1. Rows of equal sets are one class from then on, so copies cost nothing more.
    2. Classes that share a band key are candidates. With ``bands`` bands of
       ``rows`` rows a pair at 0.85 is missed once in a million times.
    3. Every class is compared with the ``pivots`` heads of each bucket it is in,
       on the full sets, in streams that hold one head.
    4. Where that leaves a bucket in several components, the classes outside its
       largest one are compared with more heads out of that, in two rounds, and,
       if they are still outside, with all classes of the bucket, in units of at
       most about ``unit_docs`` classes and ``unit_shingles`` shingles. Buckets are never
       merged, so chains of unlike families cost nothing. No pairs are written
       out and none of a bucket is left out.

    Repeated rows keep a row each. Null ids count as one smallest id, and come
    back as null; so does the id -2^63, which stands for them inside. An empty
    table gives an empty result; other columns are not read.
    """
    back = lambda c: F.nullif(c, F.lit(NO_ID).cast("long"))
    out = _grouped(docs, doc_id, text, **options)
    return out.select(back(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("first_id", "id")).alias("component_id"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, **options) -> DataFrame:
    """One row of each component, one with the smallest id, with all columns of ``docs``.

    Rows go by id and shingle set, so an id's other texts stay where they are
    linked to nothing; null ids count as one smallest id. Of several rows with
    the id and set to keep, one stays. Rows without words are linked to nothing.

    Rows that the bit map of the ids in question clears pass without a shuffle;
    only the others are held against ids and sets.
    """
    spark, bits = docs.sparkSession, 1 << 26
    each = _grouped(docs, doc_id, text, width=width, **options).filter("first_id is not null")
    stays = (F.col("id") == F.col("first_id")) & (F.col("key") == F.col("first_key"))
    told = each.groupBy("id", "key").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("rows"))
    told = common.cut(told.filter("not stays or rows > 1").select("id", "key", "stays"))
    shared = spark.sparkContext.broadcast(_bitmap(told, bits))
    names = docs.columns
    mark = "_place"
    while any(n.startswith(mark) for n in names):
        mark += "_"
    place, own_id, own_key = mark, f"{mark}id", f"{mark}key"
    known = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID).cast("long"))
    hashed = docs.withColumn(own_id, known).withColumn(place, F.pmod(F.xxhash64(own_id), F.lit(bits)))

    def part(inside: bool) -> DataFrame:
        def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            h = batch.column(batch.num_columns - 1).to_numpy()
            hit = (shared.value[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1
            own = batch.filter(pa.array(hit == inside))
            if not inside:
                yield own.select(names)
            elif own.num_rows:
                keys = [set_key(shingle_set(b, width)) for b in common.texts(own.column(names.index(text)))]
                yield own.select([*names, own_id]).append_column(own_key, pa.array(keys, pa.binary()))

        schema = docs.schema
        return common.map_arrow(hashed, run, T.StructType([*schema.fields, T.StructField(own_id, T.LongType()), T.StructField(own_key, T.BinaryType())]) if inside else schema)

    unsure = part(True).join(told.withColumnsRenamed({"id": own_id, "key": own_key, "stays": place}), [own_id, own_key], "left")
    # rows told of nothing keep a number each, so that only copies of the row to keep meet
    apart = unsure.filter(F.coalesce(place, F.lit(True))).withColumn(place, F.when(F.col(place), F.lit(-1)).otherwise(F.monotonically_increasing_id()))
    return part(False).unionByName(apart.dropDuplicates([own_id, own_key, place]).select(*common.quoted(names)))
