"""Line dedup over line-ID sequences by prefix doubling (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

_WORD = r"[^\x20\x09-\x0D]"
_DOC = ["doc_key", "text_key"]


def _bound(value: Column, body) -> Column:
    """body(value) with `value` evaluated once for each row, however often the body's own lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(places: DataFrame) -> DataFrame:
    """Of stored `places` with names (a, b), those whose name stands at several places, and whether theirs is not the first."""
    first = F.min(F.struct(*_DOC, "lo")).alias("first")
    intervals = places.groupBy("a", "b").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return places.join(intervals, ["a", "b"]).withColumn("later", F.struct(*_DOC, "lo") > F.col("first")).drop("first")


def repeated_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[DataFrame]:
    """For k = 0, 1, ...: the places whose first 2 ** k lines stand at another place too.

    A document is the sequence of its \\n-split lines that hold a word; a line's ID is a 128-bit hash. Rank k of a suffix is a
    name for its first 2 ** k lines: rank k + 1 is made of the ranks k of the place and of the one 2 ** k lines further.
    Names are hashes instead of sorted numbers: equal names stand for equal lines, which is what intervals of a common
    prefix need. A suffix of which a rank is unique has a longer common prefix with no other and drops out; rounds end when all
    have. Columns: doc_key, text_key, at (line of the sequence), lo, hi (first and last line of the text), chars (of the first line), a, b, later.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(common.key_of(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"), F.split(text, "\n").alias("lines"))
    one = lambda x, i: F.when(x.rlike(_WORD), F.struct(i.alias("lo"), i.alias("hi"), F.char_length(x).alias("chars"), F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))
    lines = keyed.select(*_DOC, F.posexplode(F.filter(F.transform("lines", one), lambda x: x.isNotNull())).alias("at", "line")).select(*_DOC, "at", "line.*")
    places = common.store(lines, "lines")
    # rows of one id and text are one document
    ranks, length = [common.store(_repeated(places).dropDuplicates([*_DOC, "at"]), "ranks")], 1
    common.discard(places)
    while not ranks[-1].isEmpty():
        further = ranks[-1].select(*_DOC, (F.col("at") - length).alias("at"), F.col("hi").alias("last"), F.col("a").alias("c"), F.col("b").alias("d"))
        pairs = ranks[-1].join(further, [*_DOC, "at"])
        pairs = pairs.select(*_DOC, "at", "lo", F.col("last").alias("hi"), "chars", F.xxhash64("a", "c").alias("a"), F.xxhash64(F.lit(1), "b", "d").alias("b"))
        pairs = common.store(pairs, "pairs")
        ranks.append(common.store(_repeated(pairs), "ranks"))
        common.discard(pairs)
        length *= 2
    return ranks[:-1]


def line_runs(docs: DataFrame, min_run: int = 2, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Later copies of repeated runs: doc_key, text_key, lo, hi (lines of the text), without those that lie in another one of their text.

    A maximal run of L lines is the union of its windows of 2 ** k lines, the largest power within L, and each window is a place
    of a common prefix interval of rank k. Windows count from rank 0 on: a single line of at least `min_chars` characters, or
    at least `min_run` lines. The first place, by (doc_id, text hash, line), is the copy that stays.
    """
    if min_run < 1 or min_run & (min_run - 1):
        raise ValueError("min_run must be a power of two")
    found = None
    for k, places in enumerate(repeated_suffixes(docs, id_col, text_col)):
        windows = places.filter("later")
        if 2**k < min_run:
            windows = windows.filter(F.col("chars") >= min_chars) if k == 0 else None
        if windows is not None:
            windows = windows.select(*_DOC, "lo", "hi")
            found = windows if found is None else found.unionByName(windows)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_key long, text_key long, lo int, hi int")
    longest = found.groupBy(*_DOC, "lo").agg(F.max("hi").alias("hi"))
    before = Window.partitionBy(*_DOC).orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)  # the lines of one text
    return longest.withColumn("past", F.max("hi").over(before)).filter("past is null or hi > past").drop("past")


def dedup_lines(docs: DataFrame, min_run: int = 2, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Delete the later copies of every repeated run of lines; the first copy in (doc_id, text hash, line) order stays.

    A run is one line of at least `min_chars` characters, or any `min_run` lines and more (a power of two), so that short lines by themselves, such as
    headings and rules, stay. Returns all columns of `docs` with the cleaned text, and n_lines, n_removed_lines (long). Blank lines don't count as
    lines of a run; those between two deleted lines of a run go with them, others stay. A run that repeats inside one
    document counts as well.

    A missing text stays missing, an empty one empty. Rows of equal id and text are one document to this operator and
    come out alike; a missing id sorts first. An empty table gives an empty result. Columns named n_lines or
    n_removed_lines are replaced; others, whatever their names, pass through. Places of a very common run are reduced to
    the first one before the shuffle, and Spark splits the join back to the places when it is skewed.
    """
    hits = line_runs(docs, min_run, min_chars, id_col, text_col).groupBy(*_DOC).agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("hits"))
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), common.key_of(id_col).alias("doc_key"), F.xxhash64(text).alias("text_key"))
    joined = whole.join(hits, _DOC, "left")
    own = F.col("row")[text_col].cast("string")
    # `hits` are sorted by both ends: what stays are the slices before the first, between neighbours and after the last
    def between(lines: Column) -> Column:
        def part(i: Column) -> Column:
            past = F.when(i > 0, F.get("hits", i - 1)["hi"] + 1).otherwise(0)  # lines before the slice
            return F.slice(lines, past + 1, F.greatest(F.coalesce(F.get("hits", i)["lo"], F.size(lines)) - past, F.lit(0)))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size("hits")), part))

    joined = joined.withColumn("stay", F.when(F.col("hits").isNotNull(), _bound(F.split(own, "\n"), between)))
    n_lines = F.when(own.isNull(), 0).otherwise(F.char_length(own) - F.char_length(F.replace(own, F.lit("\n"), F.lit(""))) + 1)
    cleaned = F.when(F.col("stay").isNull(), own).otherwise(F.concat_ws("\n", "stay"))
    removed = F.when(F.col("stay").isNull(), 0).otherwise(n_lines - F.size("stay"))
    return joined.select(
        *[(cleaned if c == text_col else F.col("row").getField(c)).alias(c) for c in kept],
        n_lines.cast("long").alias("n_lines"),
        removed.cast("long").alias("n_removed_lines"),
    )


def op6_query(spark, sf_dir: str) -> DataFrame:
    """Later copies of long lines, and of runs of two or more lines, are deleted from all documents; the text comes back as its digest."""
    out = dedup_lines(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ls, text IS NULL AS none FROM documents),
w AS (
  SELECT doc_id, t, list_filter(list_transform(range(1, len(ls) + 1), lambda i: {'pos': i, 'l': ls[i]}), lambda x: regexp_matches(x.l, '[^\x20\x09-\x0D]')) AS xs
  FROM d),
p AS (
  SELECT doc_id, xs[j].pos AS lo, xs[j + 1].pos AS hi, xs[j].l AS l1, xs[j + 1].l AS l2
  FROM (SELECT doc_id, xs, unnest(range(1, len(xs))) AS j FROM w)),
q AS (SELECT doc_id, lo, hi, row_number() OVER (PARTITION BY l1, l2 ORDER BY doc_id, lo) AS n FROM p
  UNION ALL
  SELECT doc_id, x.pos, x.pos, row_number() OVER (PARTITION BY x.l ORDER BY doc_id, x.pos) FROM (SELECT doc_id, unnest(xs) AS x FROM w) WHERE length(x.l) >= 40),
gone AS (SELECT doc_id, list(DISTINCT i) AS out FROM (SELECT doc_id, unnest(range(lo, hi + 1)) AS i FROM q WHERE n > 1) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN none THEN 0 ELSE len(ls) END::BIGINT AS n_lines, coalesce(len(out), 0)::BIGINT AS n_removed_lines,
       sha256(CASE WHEN out IS NULL THEN t ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ls) + 1), lambda i: NOT list_contains(out, i)), lambda i: ls[i]), chr(10)), '') END) AS text_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""
