"""Near-duplicate groups by HyperMinHash sketches, banding and verification."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .words import mix, word_hashes

#: Buckets of a sketch (8 bits of each hash), and mantissa bits of a register; the other 6 bits hold its leading zeros.
BUCKETS, MANTISSA = 256, 10
#: Bands and registers of each: a pair of similarity 0.75 shares none of 40 bands with probability 2e-5.
BANDS, ROWS = 40, 5
#: Centres of a vertex, those of its largest buckets first, that it is compared with at first.
FIRST = 4
#: Size classes of the prefix filter, to a doubling of the set size.
CLASSES = 16
#: Standard deviations by which an estimate may miss the similarity before its pair goes untested (one in 300,000).
MARGIN = 4.5
#: One bit of each register, in four longs: a coarse sketch that JVM-side joins compare.
BITS = ["s0", "s1", "s2", "s3"]
_random = np.random.default_rng(20240607)
_order = _random.random((BUCKETS, BUCKETS))
_ranked = np.argsort(_order, axis=1)
_multipliers = _random.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the whole text's shingles (A-Z lower-cased; with fewer words, of all of them)."""
    ids = word_hashes(text.encode(), lower=True)[0] if text else np.zeros(0, np.uint64)
    if not len(ids):
        return ids
    width = min(width, len(ids))
    n = len(ids) - width + 1
    h = ids[:n].copy()
    for j in range(1, width):
        h = h * _P + ids[j : n + j]
    h = mix(h + np.uint64(width))
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a non-empty sorted set: leading zeros and mantissa of each bucket's smallest hash.

    An empty bucket takes the register of the first bucket that isn't empty, in an order of its own, so equal registers
    keep the probability of the Jaccard similarity for small sets too.
    """
    buckets = (hashes >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(buckets, prepend=-1))
    filled, rest = buckets[first], (hashes[first] << np.uint64(8)) >> np.uint64(8)  # 56 bits
    top = np.frexp(rest.astype(np.float64))[1]  # bits in use; float rounding may add one, alike for equal hashes
    zeros = np.minimum(56 - np.minimum(top, 56), 63).astype(np.uint64)
    shift = np.maximum(top - 1 - MANTISSA, 0).astype(np.uint64)
    registers = np.zeros(BUCKETS, np.uint16)
    registers[filled] = ((zeros << np.uint64(MANTISSA)) | ((rest >> shift) & np.uint64((1 << MANTISSA) - 1))).astype(np.uint16)
    if len(filled) < BUCKETS:
        full = np.zeros(BUCKETS, bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        for attempt in range(BUCKETS if len(filled) > 48 else 0):
            source = _ranked[empty, attempt]
            good = full[source]
            registers[empty[good]] = registers[source[good]]
            empty = empty[~good]
            if not len(empty):
                break
        if len(empty):  # few filled buckets: a small matrix
            registers[empty] = registers[filled[np.argmin(_order[empty][:, filled], axis=1)]]
    return registers


def corrected_jaccard(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard estimates from rows of registers: the share of equal ones, less what collides by chance.

    The smallest hashes of x and of y other elements of a bucket are exponential with these rates, and a register's cell
    is about 0.72 / 2 ** MANTISSA of the hash wide: they fall into one cell with probability 0.72 x y / (x + y) ** 2 / 2 ** MANTISSA.
    """
    equal = (a == b).mean(axis=1)
    x, y = n_a / 1.0, n_b / 1.0
    chance = 0.72 * x * y / (x + y) ** 2 / 2**MANTISSA
    return np.maximum(equal - chance, 0) / (1 - chance)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    common.kept("near_dedup", dict)
    for batch in common.few(batches):
        rows = ([], [], [])
        for text in batch.column(2).to_pylist():
            s = shingle_set(text)
            rows[0].append(len(s))
            rows[1].append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)  # sets are told apart by 128 bits
            rows[2].append(sketch(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["doc_key", "text_key", "n", "set_name", "registers"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v, text) -> v, n, shingle: the full set of each vertex, its size with every row."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            sets = [shingle_set(x) for x in part.column(1).to_pylist()]
            sizes = np.array([len(x) for x in sets], np.int64)
            all_ = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(all_)], ["v", "n", "shingle"])


def prefixes(tokens: DataFrame, percent: int) -> DataFrame:
    """v, n, shingle, low, high: the shingles by which pairs of sets (v, n, shingle) meet that can have a similarity of `percent` %.

    Sets of a and b elements of that similarity share at least o = p / (100 + p) * (a + b). In one order of all shingles, the
    rarest first, the first that both have is among the first a - o + 1 of the one and b - o + 1 of the other. Sizes fall into
    classes of a few percent; a row is for partners of one class, and (shingle, low, high), the two classes, is its key.
    Shingles of one set alone fill prefixes but meet nothing and give no rows.
    """
    t = percent / 100
    seen = tokens.groupBy("shingle").agg(F.count(F.lit(1)).alias("sets"))
    rarest = Window.partitionBy("v").orderBy("sets", "shingle")
    n, place = F.col("n"), F.col("place")
    ranked = tokens.join(seen, "shingle").withColumn("place", F.row_number().over(rarest)).filter((F.col("sets") > 1) & (place <= n - F.ceil(n * t - 1e-6) + 1))
    size_class = lambda x: F.floor(F.log2(x) * CLASSES + 1e-9).cast("int")
    rows = ranked.select("v", "n", "shingle", "place", size_class(n).alias("own"), F.explode(F.sequence(size_class(F.greatest(n * t, F.lit(1.0))), size_class(n / t))).alias("other"))
    least = F.greatest(F.pow(F.lit(2.0), (F.col("other") - 1e-6) / CLASSES), n * t)  # of the partner's size
    shared = F.ceil(t / (1 + t) * (n + least) - 1e-6)
    return rows.filter(place <= n - shared + 1).select("v", "n", "shingle", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        registers = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS)
        parts = registers[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
        keys = mix((parts * _multipliers).sum(axis=2, dtype=np.uint64) * _P + np.arange(1, BANDS + 1, dtype=np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "v"])


def _with_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        registers = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, BUCKETS)
        bits = np.packbits((registers * np.uint16(40503)) >> np.uint16(15), axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(4))], ["v", "n", "registers", *BITS])


def coarsely_alike(x: str, y: str, minimum: float):
    """Whether sizes and bits of rows `x` and `y` (column prefixes) allow a similarity of `minimum`, MARGIN standard deviations granted.

    Bits of equal registers are equal, others are by a half: the share of unlike bits is about (1 - similarity) / 2.
    """
    unlike = sum(F.bit_count(F.col(f"{x}{s}").bitwiseXOR(F.col(f"{y}{s}"))) for s in BITS)
    few, many = F.least(f"{x}n", f"{y}n"), F.greatest(f"{x}n", f"{y}n")
    share = (1 - minimum) / 2
    filled = -F.expm1(-few / BUCKETS) * BUCKETS
    margin = MARGIN * F.sqrt(F.lit(share * (1 - share)) / filled)
    return (few >= minimum * many) & (unlike / F.lit(float(BUCKETS)) <= share + margin)


def _promising(minimum: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(-1, BUCKETS) for i in (2, 3))
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            # small sets fill few buckets of their own, so those vary more
            filled = BUCKETS * -np.expm1(-np.minimum(na, nb) / BUCKETS)
            margin = MARGIN * np.sqrt(minimum * (1 - minimum) / filled)
            sizes = np.minimum(na, nb) >= minimum * np.maximum(na, nb)  # a condition that no pair can do without
            good = sizes & (corrected_jaccard(ra, rb, na, nb) >= minimum - margin)
            yield batch.select(["a", "b"]).filter(pa.array(good))

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, one = None, None
        for batch in batches:
            keep = []
            for a, ta, tb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if a != last:
                    last, one = a, shingle_set(ta)
                two = shingle_set(tb)
                both = np.concatenate([one, two])
                both.sort()
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * shared >= percent * (len(one) + len(two) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def connect(edges: DataFrame, name: str = "components") -> DataFrame:
    """v, c: the smallest vertex of each vertex's component. Every round each vertex joins its smallest neighbour, and
    edges between what has joined are contracted; a few rounds leave none."""
    labels = common.store(edges.select(F.col("a").alias("v")).union(edges.select("b")).distinct().withColumn("c", F.col("v")), name)
    edges = common.store(edges.select("a", "b").distinct(), f"{name}_edges")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        parents = both.groupBy("a").agg(F.min("b").alias("p")).select(F.col("a").alias("x"), F.least("a", "p").alias("p"))
        parents = common.store(parents, f"{name}_parents")
        labels = common.store(labels.join(parents, F.col("c") == F.col("x"), "left").select("v", F.coalesce("p", "c").alias("c")), name)
        left, right = parents.toDF("a", "pa"), parents.toDF("b", "pb")
        moved = edges.join(left, "a").join(right, "b").filter("pa <> pb")
        edges = common.store(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), f"{name}_edges")
    return labels


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents that are linked by a Jaccard similarity of at least `percent` % of their word shingles.

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable by links), kept (its own smallest). Documents
    of equal shingle sets are one vertex. Each vertex has a HyperMinHash sketch; bands of its compressed registers deal
    vertices into buckets. A bucket's centre is the member whose buckets hold most, which is the most typical one of a group of
    copies. Every vertex is first compared with the centres of its largest buckets, then with its other centres: pairs whose
    collision-corrected estimate is not clearly too low are verified on their full shingle sets, and links are contracted
    to components. Members of buckets that still hold several components meet once more, not by bucket but by the rare
    shingles that a pair of that similarity must share (see prefixes()); pairs of different components are estimated and verified alike.
    So nothing is capped, and n members that belong together cost a multiple of n pairs. A member that is far from all
    others has a prefix of shingles of its own and meets few. What remains quadratic is a bucket of sets that all consist
    of few frequent shingles in different selections.

    A missing or empty text has no shingles: it is linked with nothing and kept. A missing id sorts before all others
    and comes back as missing. Rows that repeat an id are separate documents with the same component if they are
    linked; with equal ids, all rows of the smallest id are kept. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = docs.select(common.key_of(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    table = common.store(rows.mapInArrow(_sketches, "doc_key long, text_key long, n long, set_name binary, registers binary"), "sketches")
    # one document of each set; copies meet before the shuffle
    vertices = table.filter("set_name is not null").groupBy("set_name").agg(F.min(F.struct("doc_key", "text_key")).alias("d"), F.max("n").alias("n"), F.max("registers").alias("registers"))
    vertices = common.store(vertices.select(F.monotonically_increasing_id().alias("v"), "set_name", "d.doc_key", "d.text_key", "n", "registers"), "vertices")
    bands = vertices.select("v", "registers").mapInArrow(_bands, "key long, v long")
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = common.store(bands.join(sizes, "key"), "members")
    common.release(spark)
    weights = members.groupBy("v").agg(F.sum("size").alias("weight"))
    centres = members.join(weights, "v").groupBy("key").agg(F.max(F.struct("weight", "v"))["v"].alias("centre"))
    asked = members.join(centres, "key").filter("v <> centre").groupBy("v", "centre").agg(F.max("size").alias("size"))
    largest = Window.partitionBy("v").orderBy(F.desc("size"), "centre")  # at most BANDS rows each
    asked = common.store(asked.select("v", "centre", F.row_number().over(largest).alias("place")), "asked")
    known = vertices.join(members.select("v").distinct(), "v", "left_semi")
    texts = rows.join(known.select("v", "doc_key", "text_key"), ["doc_key", "text_key"]).select("v", "text").dropDuplicates(["v"])
    texts = common.store(texts, "texts")
    known = known.select("v", "n", "registers").mapInArrow(_with_bits, "v long, n long, registers binary, s0 long, s1 long, s2 long, s3 long")
    known = common.store(known, "involved")
    coarse, full = known.drop("registers"), known.select("v", "n", "registers")
    minimum = percent / 100
    common.release(spark)
    side = lambda df, x: df.toDF(*[x if c == "v" else f"{x}_{c}" for c in df.columns])

    def of_pairs(df: DataFrame, pairs: DataFrame) -> DataFrame:
        """The rows of `df` that `pairs` need, so that steps with few pairs move few texts and sketches."""
        return df.join(pairs.select(F.col("a").alias("v")).union(pairs.select("b")).distinct(), "v", "left_semi")

    def links(pairs: DataFrame, name: str) -> DataFrame:
        own = of_pairs(full, pairs)
        sketched = pairs.join(side(own, "a"), "a").join(side(own, "b"), "b").select("a", "b", "a_registers", "b_registers", "a_n", "b_n")
        promising = common.store(sketched.mapInArrow(_promising(minimum), "a long, b long"), f"promising_{name}")
        own = of_pairs(texts, promising)
        both = promising.join(side(own, "b"), "b").join(side(own, "a"), "a").select("a", "b", "a_text", "b_text")
        return common.store(both.mapInArrow(_verified(percent), "a long, b long"), f"links_{name}")

    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    name = lambda x: F.coalesce(F.col(x), F.col(x[0]))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        pairs = pairs.join(labels.toDF("a", "ac"), "a", "left").join(labels.toDF("b", "bc"), "b", "left")
        return pairs.withColumn("ac", name("ac")).withColumn("bc", name("bc")).filter("ac <> bc")

    def unite(labels: DataFrame, found: DataFrame, step: str) -> DataFrame:
        merged = connect(apart(found, labels).select(*ordered("ac", "bc")), f"labels_{step}")
        both = labels.union(merged.select("v", F.col("v").alias("c"))).groupBy("v").agg(F.min("c").alias("c"))
        return common.store(both.join(merged.toDF("c", "root"), "c", "left").select("v", F.coalesce("root", "c").alias("c")), f"labels_{step}_all")

    labels = spark.createDataFrame([], "v long, c long")
    for step, chosen in (("first", F.col("place") <= FIRST), ("others", F.col("place") > FIRST)):  # what the first link needs no comparison with the others
        pairs = apart(asked.filter(chosen).select(*ordered("v", "centre")).distinct(), labels).select("a", "b")
        pairs = pairs.join(side(coarse, "a"), "a").join(side(coarse, "b"), "b").filter(coarsely_alike("a_", "b_", minimum)).select("a", "b")
        pairs = common.store(pairs, f"pairs_{step}")
        labels = unite(labels, links(pairs, step), step)
    common.release(spark)
    placed = members.select("key", "v").join(labels, "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"))
    open_ = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).filter("x <> y").select("key")
    open_ = common.store(placed.join(open_, "key", "left_semi").select("v", "c").distinct(), "open")
    tokens = texts.join(open_, "v", "left_semi").mapInArrow(_shingles, "v long, n long, shingle long")
    meeting = prefixes(common.store(tokens, "shingles"), percent).join(open_, "v").join(coarse.drop("n"), "v")
    meeting = common.store(meeting, "prefixes")
    common.release(spark)
    # of a shingle's sets, those outside its largest component meet all
    at = ["shingle", "low", "high"]
    state = meeting.groupBy(*at, "c").agg(F.count(F.lit(1)).alias("size")).groupBy(*at)
    state = state.agg(F.count(F.lit(1)).alias("components"), F.max(F.struct("size", "c"))["c"].alias("main")).filter("components > 1").drop("components")
    outside = meeting.join(state, at).filter("c <> main").drop("main").toDF("w", "w_n", *at, "d", *(f"w_{x}" for x in BITS))
    pairs = meeting.join(outside, at).filter((F.col("c") != F.col("d")) & coarsely_alike("", "w_", minimum)).select(*ordered("v", "w")).distinct()
    pairs = common.store(pairs, "pairs_rare")
    labels = unite(labels, links(pairs, "rare"), "rare")
    common.release(spark)
    grouped = vertices.select("set_name", "v").join(labels, "v", "left").select("set_name", F.coalesce("c", "v").alias("c"))
    placed = common.store(table.select("doc_key", "n", "set_name").join(grouped, "set_name", "left").select("doc_key", "n", "c"), "placed")
    smallest = placed.filter("c is not null").groupBy("c").agg(F.min("doc_key").alias("least"))
    out = placed.join(smallest, "c", "left").withColumn("component", F.coalesce("least", "doc_key"))
    return out.select(common.id_of("doc_key").alias("doc_id"), F.col("n").alias("n_shingles"), common.id_of("component").alias("component_id"), (F.col("component") == F.col("doc_key")).alias("kept"))


def op10_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT a, a FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id) AS component_id, coalesce(c.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id
"""
