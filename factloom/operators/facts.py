"""Operators on fact tables: call graphs, type layout, integer-set lattice, tag inference, rewriting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import fixpoint, settle
from .graph import reachable, reaching


def split_calls(ops: DataFrame, fns: DataFrame, named_unions: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
    """kinds(fn, kind) and calls(src, dst) of unsafe operations ops(fn, kind, callee, union_id).

    A call of a function in fns(fn) is an edge, any other one an unsafe kind; a union access counts as `union` only if its
    union is one of `named_unions`, where those are given, and as `access` otherwise."""
    local = fns.select(F.col("fn").alias("callee"))
    calls = ops.filter("kind = 'call'").join(local, "callee", "left_semi").select(F.col("fn").alias("src"), F.col("callee").alias("dst")).distinct()
    foreign = ops.filter("kind = 'call'").join(local, "callee", "left_anti").select("fn", "kind")
    kind = F.col("kind") if named_unions is None else F.when((F.col("kind") == "union") & ~F.coalesce(F.col("union_id").isin(named_unions), F.lit(False)), "access").otherwise(F.col("kind"))
    return ops.filter("kind <> 'call'").select("fn", kind.alias("kind")).union(foreign).distinct(), calls


def unsafety(fns: DataFrame, kinds: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: functions, unsafe ones (own kinds, or through calls), those with union accesses among them, and their ratio.

    fns(fn); kinds(fn, kind); calls(src, dst). The ratio is null without unsafe functions."""
    own = kinds.select(F.col("fn").alias("v"), (F.col("kind") == "union").alias("fact")).distinct()
    rolled = reaching(calls, own).groupBy(F.col("v").alias("fn")).agg(F.lit(True).alias("unsafe"), F.bool_or("fact").alias("union"))
    out = fns.join(rolled, "fn", "left").agg(F.count(F.lit(1)).alias("total"), F.count_if("unsafe").alias("n_unsafe"), F.count_if("union").alias("n_union"))
    return out.withColumn("ratio", F.try_divide("n_union", "n_unsafe"))


def returned_calls(copies: DataFrame, taken: DataFrame, results: DataFrame) -> DataFrame:
    """fn, callee: calls whose result a function may return. copies(fn, dst, src) of whole locals, results(fn, dst, callee) of calls;
    what is set through an address, taken(fn, local), does not count. Local 0 is the returned value."""
    address = taken.select("fn", F.col("local").alias("dst"))
    copies = settle(copies.join(address, ["fn", "dst"], "left_anti").select("fn", F.col("dst").alias("local"), "src"))
    results = settle(results.join(address, ["fn", "dst"], "left_anti").select("fn", F.col("dst").alias("local"), "callee"))
    starts = copies.select("fn").union(results.select("fn")).distinct().withColumn("local", F.lit(0))
    flows = fixpoint(starts, lambda new: new.join(copies, ["fn", "local"]).select("fn", F.col("src").alias("local")))
    return flows.join(results, ["fn", "local"]).select("fn", "callee").distinct()


def allocators(candidates: DataFrame, direct: DataFrame, calls: DataFrame) -> DataFrame:
    """fn: candidates that return what an allocator gave them, directly or by calling such a function."""
    kept = calls.join(candidates.toDF("src"), "src", "left_semi").join(candidates.toDF("dst"), "dst", "left_semi")
    seeds = direct.join(candidates, "fn", "left_semi").select(F.col("fn").alias("v"))
    return reachable(kept.select(F.col("dst").alias("src"), F.col("src").alias("dst")), seeds).toDF("fn")


def partition_types(refs: DataFrame, seeds: DataFrame) -> DataFrame:
    """type, is_foreign: types mentioned in refs(src, dst), foreign where a seed reaches them."""
    found = reachable(refs, seeds).toDF("type").withColumn("hit", F.lit(True))
    mentioned = refs.select(F.col("src").alias("type")).union(refs.select("dst")).union(seeds).distinct()
    return mentioned.join(found, "type", "left").select("type", F.coalesce("hit", F.lit(False)).alias("is_foreign"))


def layout(fields: DataFrame) -> DataFrame:
    """fields(ty, field, len) with the running sum of the lengths before each field."""
    before = Window.partitionBy("ty").orderBy("field").rowsBetween(Window.unboundedPreceding, -1)
    return fields.withColumn("offset", F.coalesce(F.sum("len").over(before), F.lit(0)))


def field_ranges(placed: DataFrame) -> DataFrame:
    """layout() with `until`, where the next field begins or the type ends: the slots that one field of a union may write."""
    by = Window.partitionBy("ty").orderBy("field")
    return placed.withColumn("until", F.coalesce(F.lead("offset").over(by), F.col("offset") + F.col("len")))


def widen(old: Column, new: Column) -> Column:
    """Keep `old` if it holds `new`, take `new` if `old` is empty, else null for `any`."""
    return F.when(F.size(old) == 0, new).when(F.size(F.array_except(new, old)) == 0, old)


def wrap(value: Column, bits: int) -> Column:
    """Two's complement wrap to a signed width, without casts that raise."""
    half = 1 << (bits - 1)
    return F.pmod(value + F.lit(half), F.lit(1 << bits)) - F.lit(half)


def discover_tags(uses: DataFrame) -> DataFrame:
    """owner, field, n_variants: the field whose tags determine the variant, of uses(owner, field, variant, tag).

    A field is out if a tag occurs with two variants, or if all its tags have one variant; of the others the one of most variants wins, then the smallest."""
    clash = uses.groupBy("owner", "field", "tag").agg(F.count_distinct("variant").alias("n")).filter("n > 1")
    sound = uses.join(clash, ["owner", "field"], "left_anti").groupBy("owner", "field").agg(F.count_distinct("variant").alias("n_variants")).filter("n_variants > 1")
    best = Window.partitionBy("owner").orderBy(F.desc("n_variants"), "field")
    return sound.withColumn("r", F.row_number().over(best)).filter("r = 1").select("owner", "field", "n_variants")


def _level(lo: str, hi: str) -> Column:
    """The smallest level whose cells, of 2 ** level, are as long as the span: it lies in two of them at most."""
    length = F.col(hi) - F.col(lo)
    return F.when(length <= 1, 0).otherwise(F.length(F.bin(length - 1)))


def _cells(spans: DataFrame, side: str, levels: Column) -> DataFrame:
    """A row for each cell of each of the span's `levels`."""
    rows = spans.withColumn("level", F.explode(levels))
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    last = F.greatest(F.col(f"{side}_hi") - 1, F.col(f"{side}_lo"))
    return rows.withColumn("cell", F.explode(F.sequence(F.floor(F.col(f"{side}_lo") / size), F.floor(last / size))))


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """key, l_id, r_id: pairs of half-open spans (key, id, lo, hi) of one key that overlap, of any lengths.

    A span has a level by its length and lies in at most two cells of it. Two spans meet at the level of the longer one: the longer in its own cells,
    the shorter in those around it, of which it has two for each longer level that the other side has, 63 levels at most. So a span takes rows by the
    logarithm of the lengths, not by its length; a pair counts in the first cell that both have. Bounds must lie within 2 ** 53."""
    named = lambda df, x: df.select("key", F.col("id").alias(f"{x}_id"), F.col("lo").cast("long").alias(f"{x}_lo"), F.col("hi").cast("long").alias(f"{x}_hi")).withColumn("own", _level(f"{x}_lo", f"{x}_hi"))
    l, r = named(left, "l"), named(right, "r")  # noqa: E741
    longer = lambda df: sorted(x["own"] for x in df.select("own").distinct().collect())  # noqa: E731 - at most 64 levels
    above = lambda df, x, levels: _cells(df, x, F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda n: n > F.col("own")))
    own = lambda df, x: _cells(df, x, F.array("own"))
    l_levels, r_levels = longer(l), longer(r)
    size = F.pow(F.lit(2.0), F.col("level")).cast("long")
    hit = (F.col("l_lo") < F.col("r_hi")) & (F.col("r_lo") < F.col("l_hi")) & (F.col("cell") == F.floor(F.greatest("l_lo", "r_lo") / size))
    met = lambda a, b: a.drop("own").join(b.drop("own"), ["key", "level", "cell"]).filter(hit).select("key", "l_id", "r_id")
    return met(own(l, "l"), own(r, "r")).union(met(own(l, "l"), above(r, "r", l_levels))).union(met(above(l, "l", r_levels), own(r, "r")))


def islands(rows: DataFrame) -> DataFrame:
    """key, target, first, n: runs of more than one neighbouring row (key, pos, target) of one target."""
    by = Window.partitionBy("key").orderBy("pos")
    marked = rows.withColumn("new", F.when(F.lag("target").over(by).eqNullSafe(F.col("target")), 0).otherwise(1))
    marked = marked.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("key", "target", "run").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("run")


def snippets(files: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans(path, lo, hi), half-open in bytes of UTF-8, with their text."""
    text = F.substring(F.col("content").cast("binary"), F.col("lo").cast("int") + 1, (F.col("hi") - F.col("lo")).cast("int")).cast("string")
    return spans.join(files, "path").withColumn("text", text).drop("content")


def edit_conflicts(edits: DataFrame) -> DataFrame:
    """path, lo, hi, next_lo: edits(path, lo, hi) that reach into the one that follows them."""
    by = Window.partitionBy("path").orderBy("lo", "hi")
    return edits.withColumn("next_lo", F.lead("lo").over(by)).filter("hi > next_lo").select("path", "lo", "hi", "next_lo")


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, content of files after edits(path, lo, hi, text) at 0-based, half-open spans in bytes of UTF-8, which begin and end between characters.

    Spans of a file must not overlap, or the job fails with the file's path; edit_conflicts() finds those that do. Each edit is the piece of text
    since the one before it and its own text, and the pieces are joined once. An edit of a file that is not there does nothing."""
    ordered = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "text"))).alias("edits"))
    joined = files.join(ordered, "path", "left").withColumn("_src", F.col("content").cast("binary"))
    since = lambda i: F.when(i > 0, F.get(F.col("edits"), i - 1)["hi"]).otherwise(0)
    pieces = F.transform("edits", lambda e, i: F.concat(F.substring(F.col("_src"), since(i) + 1, F.greatest(e["lo"] - since(i), F.lit(0))).cast("string"), e["text"]))
    clash = F.exists(F.transform("edits", lambda e, i: e["lo"] < since(i)), lambda x: x)
    end = F.element_at("edits", -1)["hi"]
    rest = F.substring(F.col("_src"), end + 1, F.greatest(F.octet_length("_src") - end, F.lit(0))).cast("string")
    edited = F.when(clash, F.raise_error(F.concat(F.lit("overlapping edits of "), "path"))).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.select("path", F.when(F.col("edits").isNull(), F.col("content").cast("string")).otherwise(edited).alias("content"))


def arithmetic(op: str, x: Column, y: Column, bits: int, signed: bool = True) -> Column:
    """A binary operation on integers of up to 32 bits, wrapped to their width; null where it is not defined (division by 0).

    Operands are values of that type; shifts take the amount modulo the width, and comparisons give 0 or 1."""
    x, y = x.cast("long"), y.cast("long")
    quotient = F.when(y != 0, F.try_divide(F.abs(x) - F.pmod(F.abs(x), F.when(y != 0, F.abs(y))), F.abs(y)).cast("long") * F.signum(x).cast("long") * F.signum(y).cast("long"))
    amount = F.pmod(y, F.lit(bits)).cast("int")
    raw = {
        "Add": x + y, "Sub": x - y, "Mul": (x.cast("decimal(20,0)") * y.cast("decimal(18,0)")).cast("decimal(38,0)"), "Div": quotient, "Rem": x - quotient * y,
        "BitXor": x.bitwiseXOR(y), "BitAnd": x.bitwiseAND(y), "BitOr": x.bitwiseOR(y), "Shl": F.call_function("shiftleft", x, amount), "Shr": F.call_function("shiftright", x, amount),
        "Eq": (x == y).cast("int"), "Ne": (x != y).cast("int"), "Lt": (x < y).cast("int"), "Le": (x <= y).cast("int"), "Gt": (x > y).cast("int"), "Ge": (x >= y).cast("int"),
    }[op]
    return raw.cast("long") if op in ("Eq", "Ne", "Lt", "Le", "Gt", "Ge") else (wrap(raw, bits) if signed else F.pmod(raw, F.lit(1 << bits))).cast("long")


def join_index(x: Column, y: Column) -> Column:
    """Array index struct(num, sym) of both branches: the same number, or the locals that both name, else no local."""
    same = x["num"].isNotNull() & x["num"].eqNullSafe(y["num"])
    none = F.array().cast("array<int>")
    both = F.when(x["num"].isNull() & y["num"].isNull(), F.array_sort(F.array_intersect(x["sym"], y["sym"]))).otherwise(none)
    return F.when(same, F.struct(x["num"].alias("num"), F.lit(None).cast("array<int>").alias("sym"))).otherwise(F.struct(F.lit(None).cast("long").alias("num"), both.alias("sym")))


def without_values(values: Column, removed: Column) -> Column:
    """An integer set on the branch that none of `removed` takes; `any`, null, stays so."""
    return F.array_except(values, removed)


def is_prefix(shorter: Column, longer: Column) -> Column:
    return (F.size(shorter) <= F.size(longer)) & (F.slice(longer, F.lit(1), F.size(shorter)) == shorter)


def aliases(pointers: DataFrame) -> DataFrame:
    """state, a, b: locals of one state, pointers(state, local, target), that point to the same place. Each is named with the
    smallest local of its target, so a target of n locals gives n rows."""
    return pointers.join(pointers.groupBy("state", "target").agg(F.min("local").alias("a")), ["state", "target"]).select("state", "a", F.col("local").alias("b"))


def join_states(left: DataFrame, right: DataFrame) -> DataFrame:
    """state, local, vals of two branches (integer sets, null for any): locals that both know, with the union of their values."""
    both = left.toDF("state", "local", "x").join(right.toDF("state", "local", "y"), ["state", "local"])
    union = F.array_sort(F.array_union("x", "y"))
    return both.select("state", "local", F.when(F.size(union) <= 10, union).alias("vals"))


def last_condition(stmts: DataFrame, switches: DataFrame) -> DataFrame:
    """fn, block, op, x, y: the last assignment in the block of a switch(fn, block, local) to its local, where that is Eq or Ne of two locals; stmts(fn, block, stmt, dst, op, x, y)."""
    last = Window.partitionBy("fn", "block").orderBy(F.desc("stmt"))
    own = stmts.join(switches.withColumnRenamed("local", "dst"), ["fn", "block", "dst"]).withColumn("r", F.row_number().over(last)).filter("r = 1")
    return own.filter(F.col("op").isin("Eq", "Ne") & F.col("x").isNotNull() & F.col("y").isNotNull()).select("fn", "block", "op", "x", "y")


def candidates(structs: DataFrame, fields: DataFrame, foreign: DataFrame, changed: DataFrame, bits: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """ty, field, union: fields of unnamed union types in structs that are not foreign and have a field that may be a tag.

    fields(ty, field, kind, type, type_name): a union type is unnamed if type_name, its own name, begins with C2RustUnnamed, whatever the field is called. A tag may
    be an integer or boolean field that is neither changed in place nor has its address taken, changed(ty, field), or any bit field, bits(ty, field) of
    layout.bitfields(). only(union) keeps these unions alone."""
    tags = fields.filter(F.col("kind").isin("int", "bool")).join(changed, ["ty", "field"], "left_anti").select("ty")
    tags = (tags if bits is None else tags.union(bits.select("ty"))).distinct()
    own = structs.join(foreign, "ty", "left_anti").join(tags, "ty", "left_semi")
    out = fields.filter((F.col("kind") == "union") & F.col("type_name").startswith("C2RustUnnamed")).join(own, "ty", "left_semi").select("ty", "field", F.col("type").alias("union"))
    return out if only is None else out.join(only.select("union").distinct(), "union", "left_semi").select("ty", "field", "union")


def containment(fields: DataFrame) -> DataFrame:
    """src, dst, step: from a union or struct to each type that has it as a field, with the field taken; paths of these edges lead to all holders."""
    return fields.filter(F.col("kind").isin("struct", "union")).select(F.col("type").alias("src"), F.col("ty").alias("dst"), F.concat(F.col("ty").cast("string"), F.lit("."), F.col("name")).alias("step")).distinct()


def arm_accesses(accesses: DataFrame, arms: DataFrame) -> DataFrame:
    """key, access, arm: accesses(key, id, lo, hi, tags) in the first arm(key, id, lo, hi, ord, tags) whose span overlaps theirs, where the tags
    known at the access are those of the arm, or any for an arm without tags."""
    met = overlaps(accesses, arms)
    full = met.join(arms.select("key", F.col("id").alias("r_id"), "ord", F.array_sort("tags").alias("arm_tags")), ["key", "r_id"])
    first = full.groupBy("key", "l_id").agg(F.min_by(F.struct("r_id", "arm_tags"), F.struct("ord", "r_id")).alias("arm"))
    own = first.join(accesses.select("key", F.col("id").alias("l_id"), F.array_sort("tags").alias("own_tags")), ["key", "l_id"])
    right = F.when(F.col("arm.arm_tags").isNull(), F.size("own_tags") > 0).otherwise(F.col("own_tags") == F.col("arm.arm_tags"))
    return own.filter(right).select("key", F.col("l_id").alias("access"), F.col("arm.r_id").alias("arm"))


def if_accesses(accesses: DataFrame, ifs: DataFrame, switches: DataFrame) -> DataFrame:
    """key, access, if_id, is_true, switch, before, entry: every branch around an access, with every switch that tests the branch's condition.

    accesses(key, id, lo, hi); ifs(key, id, cond_lo, cond_hi, true_lo, true_hi, false_lo, false_hi) with spans in the source, no else: null; switches(key, id, lo, hi, at,
    on_true, on_false) with the span of the tested condition, the place of the test and those where its branches begin. An access that overlaps both branches counts in the true one."""
    branch = lambda side, flag: ifs.filter(f"{side}_lo is not null").select("key", F.struct(F.col("id").alias("if_id"), F.lit(flag).alias("is_true")).alias("id"), F.col(f"{side}_lo").alias("lo"), F.col(f"{side}_hi").alias("hi"))
    around = overlaps(accesses, branch("true", True).union(branch("false", False))).select("key", F.col("l_id").alias("access"), "r_id.if_id", "r_id.is_true")
    around = around.groupBy("key", "access", "if_id").agg(F.bool_or("is_true").alias("is_true"))
    tested = overlaps(ifs.select("key", "id", F.col("cond_lo").alias("lo"), F.col("cond_hi").alias("hi")), switches).select("key", F.col("l_id").alias("if_id"), F.col("r_id").alias("switch"))
    to = switches.select("key", F.col("id").alias("switch"), F.col("at").alias("before"), "on_true", "on_false")
    out = around.join(tested, ["key", "if_id"]).join(to, ["key", "switch"])
    return out.select("key", "access", "if_id", "is_true", "switch", "before", F.when(F.col("is_true"), F.col("on_true")).otherwise(F.col("on_false")).alias("entry"))


def tagged_by_branch(asked: DataFrame, paths: DataFrame, tags: DataFrame, known: DataFrame) -> DataFrame:
    """access, branch, field, tagset, path: by which of its paths a branch tells an access the tags of a field.

    asked(access, branch, field, tagset, here, entry, before) has the places of the access, where its branch begins, and before the branch; paths(access, path)
    those that lead to the accessed union; tags(place, path, field, tagset) what is known of them. A path tells if the tags are known at the access and at
    the entry, and not before the branch, of which there must be a state, known(place): where nothing was analysed, nothing is told. Each access is held against its own branches only."""
    rows = asked.join(paths, "access")
    at = lambda place: tags.select(F.col("place").alias(place), "path", "field", "tagset").distinct()
    for place in ("here", "entry"):
        rows = rows.join(at(place), [place, "path", "field", "tagset"], "left_semi")
    rows = rows.join(known.select(F.col("place").alias("before")).distinct(), "before", "left_semi").join(at("before"), ["before", "path", "field", "tagset"], "left_anti")
    return rows.select("access", "branch", "field", "tagset", "path").distinct()


def variant_tags(seen: DataFrame) -> DataFrame:
    """owner, field, variant, tag of seen rows whose tag is an unsigned 32-bit number."""
    return seen.filter("tag >= 0 and tag < 4294967296").select("owner", "field", "variant", "tag").distinct()


def extend_tags(claimed: DataFrame, more: DataFrame) -> DataFrame:
    """claimed tags and those of `more` (both owner, field, variant, tag) that no access has claimed; none of an owner's field if the new ones conflict."""
    keys = ["owner", "field"]
    new = more.join(claimed, [*keys, "tag"], "left_anti").distinct()
    clash = new.groupBy(*keys, "tag").agg(F.count_distinct("variant").alias("n")).filter("n > 1").select(keys).distinct()
    return claimed.union(new.select(claimed.columns)).join(clash, keys, "left_anti").select(claimed.columns).distinct()


def remaining_tags(seen: DataFrame, claimed: DataFrame, variants: DataFrame) -> DataFrame:
    """owner, tag, variant of seen(owner, tag) that no variant has claimed(owner, variant, tag): they go to the one variant(owner, variant) without a tag, or to none."""
    free = seen.join(claimed, ["owner", "tag"], "left_anti").distinct()
    bare = variants.join(claimed, ["owner", "variant"], "left_anti").groupBy("owner").agg(F.when(F.count(F.lit(1)) == 1, F.min("variant")).alias("variant"))
    return free.join(bare, "owner", "left").select("owner", "tag", "variant")


def tagged_structs(unions: DataFrame) -> DataFrame:
    """struct, field, unions: structs whose unions(struct, union, field) all have the same tag field."""
    out = unions.groupBy("struct").agg(F.count_distinct("field").alias("n"), F.min("field").alias("field"), F.array_sort(F.collect_set("union")).alias("unions"))
    return out.filter("n = 1").drop("n")


def patterns(tags: DataFrame) -> DataFrame:
    """key, pattern, variant: the sorted tags of each key joined by ' | ', and their variant if they have but one."""
    out = tags.groupBy("key").agg(F.array_sort(F.collect_set("tag")).alias("t"), F.count_distinct("variant").alias("n"), F.min("variant").alias("variant"))
    return out.select("key", F.array_join("t", " | ").alias("pattern"), F.when(F.col("n") == 1, F.col("variant")).alias("variant"))


def tag_text(tag: Column, kind: Column) -> Column:
    """A tag as it is written: booleans by name, C integers as signed 32-bit numbers, others as they are."""
    return F.when(kind == "bool", F.when(tag == 0, "false").otherwise("true")).when(kind == "c_int", wrap(tag, 32).cast("string")).otherwise(tag.cast("string"))


def normalize(text: Column) -> Column:
    """Text without white space and parentheses."""
    return F.regexp_replace(text, r"[\s()]", "")


def line_counts(code: DataFrame) -> DataFrame:
    """key, n_lines of code(key, text)."""
    return code.select("key", F.size(F.split("text", "\n")).alias("n_lines"))


def statistics(counters: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of all other columns by `keys`."""
    return counters.groupBy(*keys).agg(*[F.sum(c).cast("long").alias(c) for c in counters.columns if c not in keys])
