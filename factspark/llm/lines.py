"""Line dedup by a segment-partition edit join, by column expressions only.

Lines are what newlines separate.  A line of at least ``MIN_CHARS`` code points
goes if it is equal to an earlier line, or within ``threshold`` edits of a line
that first occurs earlier; earlier means in a document with a smaller doc_id,
or before it in the same one.  A shorter line of at least ``exact`` code points
goes only if it is equal to an earlier line, and still shorter ones always stay:
``exact`` is ``MIN_CHARS`` in ``line_report``, as in op3's SQL, and 1 in
``dedup_lines``.

Each line is cut into threshold + 1 segments of even length.  Lines within the
threshold share one of them, at a place that the lengths bound: so a line
enters the index of its length with its segments, and probes the indexes of
its own and up to ``threshold`` smaller lengths with the substrings at the
places that the multi-match rule leaves.  Only lines whose segment or
substring meets the other kind from another line have their texts fetched;
they are joined on it, and the join's condition verifies the edit distance: a
bit-parallel automaton keeps, for each number of edits, a bit for each diagonal
of the band, and takes one code point a step.  As its steps are interpreted,
the engine's compiled banded distance screens the pairs before it.

Pairs stay in proportion to the lines.  Lines with a key that more than ``HOT``
lines share, such as a long common beginning, are cut again into ``FINE``
segments.  Any threshold + 1 of those hold one that the edits miss, so a line
is found by its threshold + 1 rarest.  If even one of these is shared by more
than HOT lines, lines are near each other throughout; there a few lines of the
group, each round twice as many, are compared with those of the group that are
not yet known to go, until all have been.

Equal lines are brought together by a 128-bit hash before any segment is made,
so a line that many documents share is one line for the join, and no pairs of
equal lines are formed.

Null text has no lines; rows with a null doc_id keep all their lines and count
for no other row.  Rows with equal doc_id and different texts are rows of their
own, the one with the smaller hash of its text being earlier; equal rows lose
equal lines.  Extra columns are not used by ``line_report`` and kept by
``dedup_lines``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let

THRESHOLD, MIN_CHARS = 2, 20
#: Rows of a side that is broadcast at most: some 40 MB.
MOST_BROADCAST = 1_000_000
#: Lines of a key beyond which its lines are cut into FINE segments; lines of a group that the first round compares with all.
HOT, FINE, PIVOTS = 100, 10, 64
#: What names a line's first place, in order.
PLACE = ["doc_id", "mark", "pos"]


def keys_of(line: Column, n: Column, threshold: int, least: int, parts: int = 0) -> tuple[Column, Column]:
    """Keys of a line of n code points: its segments, which are also its probes at their own places, and its other probes.

    A probe is a substring that may equal a segment of a line shorter by 0 to
    threshold code points.  With threshold + 1 parts, the first part that the
    edits leave has at most i edits before it if it is the i-th, at most
    threshold - i behind it, which bounds its shift.  With more parts any may
    be looked for, so that only the edits before and behind it bound it
    together.  Lengths below ``least`` have no index; where they leave room for
    all shifts, no probe is out of range.
    """
    first = not parts
    parts = parts or threshold + 1
    roomy = first and least >= parts * parts

    def key(m: Column, base: Column, more: Column, i: int, shift: int) -> Column:
        """Of the i-th of parts even segments of a line of m code points, the last ``more`` of which are longer by one, at a place moved by shift."""
        at = base * i + F.greatest(F.lit(i - parts) + more, F.lit(0)) + (1 + shift) if i else F.lit(1 + shift)
        size = base + (more >= parts - i).cast("int") if i else base
        found = F.xxhash64(m, F.lit(i), line.substr(at, size))
        return found if roomy else F.when((m >= least) & (at >= 1) & (at + size - 1 <= n), found)

    def shifts(i: int, shorter: int) -> list[int]:
        if first:
            return list(range(max(-i, shorter - (threshold - i)), min(i, shorter + (threshold - i)) + 1))
        return [x for x in range(-threshold, threshold + 1) if abs(x) + abs(shorter - x) <= threshold]

    def of(shorter: int, wanted: Callable[[int], bool]) -> Column:
        m = n - shorter
        split = F.struct(m.alias("m"), F.call_function("div", m, F.lit(parts)).cast("int").alias("base"), (m % parts).alias("more"))
        return let(split, lambda x: F.array(*[key(x["m"], x["base"], x["more"], i, shift) for i in range(parts) for shift in shifts(i, shorter) if wanted(shift)]))

    rest = [of(0, lambda shift: shift != 0)] if threshold > 1 else []
    probes = F.flatten(F.array(*rest, *[of(shorter, lambda _: True) for shorter in range(1, threshold + 1)])) if threshold else F.array().cast("array<bigint>")
    return of(0, lambda shift: shift == 0), probes if roomy else F.array_compact(probes)


def within(a: Column, b: Column, threshold: int) -> Column:
    """Whether two strings are at most threshold edits apart, by a bit-parallel automaton in a band of 2 * threshold + 1 diagonals.

    After each code point of a, bit d + threshold of the k-th integer tells
    whether k edits reach the place that is d further in b.
    """
    width = 2 * threshold + 1
    band = (1 << width) - 1
    start = F.struct(*[F.lit(((1 << (k + 1)) - 1) << threshold & band).alias(f"r{k}") for k in range(threshold + 1)])

    def step(state: Column, x: Column, others: Column) -> Column:
        same = reduce(Column.bitwiseOR, [F.when(F.get(others, x["i"] + (d - threshold)) == x["c"], F.lit(1 << d)).otherwise(0) for d in range(width)])

        def grow(m: Column) -> Column:
            new = [state["r0"].bitwiseAND(m)]
            for k in range(1, threshold + 1):
                less = state[f"r{k - 1}"]
                inserted = F.shiftleft(new[-1], 1).bitwiseAND(F.lit(band))
                new.append(state[f"r{k}"].bitwiseAND(m).bitwiseOR(less).bitwiseOR(F.shiftright(less, 1)).bitwiseOR(inserted))
            return F.struct(*[r.alias(f"r{k}") for k, r in enumerate(new)])

        return let(same, grow)

    def state(x: Column, y: Column) -> Column:
        """The automaton behind all of x, in y."""
        chars = lambda c: F.filter(F.split(c, ""), lambda c: c != "")
        places = F.transform(chars(x), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
        return let(chars(y), lambda others: F.aggregate(places, start, lambda held, at: step(held, at, others)))

    def run(p: Column) -> Column:
        reached = state(p["a"], p["b"])[f"r{threshold}"]
        return F.call_function("shiftright", reached, F.length(p["b"]) - F.length(p["a"]) + threshold).bitwiseAND(F.lit(1)) == 1

    # The engine's banded distance is compiled, the automaton is not: what is further apart does not reach it.
    return F.when(F.levenshtein(a, b, threshold) < 0, False).otherwise(let(F.struct(a.alias("a"), b.alias("b")), run))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, mark, pos, line, n, h1, h2: the distinct lines of at least min_chars of each text with their first place and length."""
    measured = F.transform(F.array_distinct(F.split("text", "\n")), lambda x: F.struct(x.alias("line"), F.length(x).alias("n")))
    rows = docs.filter("text is not null and doc_id is not null").select("doc_id", "mark", F.posexplode(measured).alias("pos", "l")).select(*PLACE, "l.line", "l.n")
    return rows.filter(F.col("n") >= min_chars).withColumn("h1", F.xxhash64("line")).withColumn("h2", F.xxhash64(F.lit("second"), "line"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within the bound; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= MOST_BROADCAST else df


def _place(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in PLACE])


def _later(one: DataFrame, two: DataFrame, threshold: int, once: bool) -> DataFrame:
    """The later place of each pair from one (key, line, place) and two (key, line, place, own) that share a key and are within the threshold.

    once: both sides have all own keys, so that two of them meet in either order and one order is enough.
    """
    two = two.select(F.col("key").alias("key2"), F.col("place").alias("place2"), F.col("line").alias("line2"), F.col("own").alias("own2"))
    differ = F.col("place") != F.col("place2")
    if once:
        differ &= ~F.col("own2") | (F.col("place") < F.col("place2"))
    pairs = one.join(two, (F.col("key") == F.col("key2")) & differ & within(F.col("line"), F.col("line2"), threshold))
    return pairs.select(F.greatest("place", "place2").alias("l")).select("l.*")


def near_lines(docs: DataFrame, firsts: DataFrame, threshold: int, least: int) -> DataFrame:
    """h1, h2 of the lines of firsts (doc_id, mark, pos, h1, h2, keys: own segments first) that are within the threshold of an earlier one."""
    keys = firsts.select(*PLACE, F.posexplode("keys").alias("k", "key")).select(*PLACE, "key", (F.col("k") <= threshold).alias("own"))
    # A key counts where a segment meets another one or a probe.
    met = cut(keys.groupBy("key").agg(F.count("*").alias("many"), F.max("own").alias("some")).filter("many > 1 and some").select("key", (F.col("many") > HOT).alias("hot")))
    live = cut(keys.join(_small(met, met.count()), "key"))
    wanted = live.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("places"))
    picked = let(F.array_distinct(F.split("text", "\n")), lambda lines: F.transform("places", lambda p: F.struct(p.alias("pos"), F.get(lines, p).alias("line"))))
    texts = docs.join(_small(wanted, live.count()), ["doc_id", "mark"]).select("doc_id", "mark", F.explode(picked).alias("l")).select("doc_id", "mark", "l.*")
    texts = cut(texts.dropDuplicates(PLACE))
    full = live.filter("not hot").join(texts, PLACE).select("key", "own", "line", _place().alias("place"))
    gone = [_later(full.filter("own"), full, threshold, True)]
    hot = live.filter("hot").select(*PLACE)
    if not hot.isEmpty():
        gone += _crowded(cut(hot.distinct().join(texts, PLACE)), threshold, least)
    return firsts.join(reduce(DataFrame.unionByName, gone).distinct(), PLACE).select("h1", "h2")


def _crowded(lines: DataFrame, threshold: int, least: int) -> list[DataFrame]:
    """Places of lines (place, line) that are within the threshold of an earlier one, found by their rarest fine segments."""
    n = F.length("line")
    own, probes = keys_of(F.col("line"), n, threshold, least, FINE)
    each = F.posexplode(F.concat(own, probes)).alias("k", "key")
    keys = cut(lines.select(_place().alias("place"), "line", each).filter("key is not null").select("place", "line", "key", (F.col("k") < FINE).alias("own")))
    many = cut(keys.groupBy("key").agg(F.count("*").alias("many")))
    ranked = keys.filter("own").select("place", "key").join(many, "key").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("many", "key"))).alias("by"))
    rare = ranked.select("place", F.explode(F.slice("by", 1, threshold + 1)).alias("e")).select("place", "e.many", "e.key").filter("many > 1")
    rare = cut(rare.join(lines.select(_place().alias("place"), "line"), "place"))
    gone = [_later(rare.filter(F.col("many") <= HOT), keys, threshold, False)]
    dense = cut(rare.filter(F.col("many") > HOT).select("key").distinct())
    if dense.isEmpty():
        return gone
    # Members of dense keys, dealt into rounds at random: round r has about PIVOTS * 2**r of a key.
    chosen = rare.filter(F.col("many") > HOT).select("place", "key", F.lit(True).alias("chosen"))
    member = keys.join(_small(dense, dense.count()), "key").groupBy("key", "place", "line").agg(F.max("own").alias("own")).join(chosen, ["key", "place"], "left").join(many, "key")
    share = (F.xxhash64(F.lit("round"), "place").cast("double") / 2.0**64 + 0.5) * F.col("many")
    member = cut(member.select("key", "place", "line", F.coalesce("chosen", F.lit(False)).alias("chosen"), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(share, F.lit(1.0)) / PIVOTS))).cast("int").alias("round")))
    last = member.agg(F.max("round")).first()[0]
    left = member
    for r in range(last + 1):
        pivots = member.filter(F.col("round") == r).select("key", F.col("place").alias("p"), F.col("line").alias("pl"), F.col("chosen").alias("pc"))
        near = left.join(pivots, "key").filter((F.col("p") < F.col("place")) & (F.col("chosen") | F.col("pc")) & within(F.col("line"), F.col("pl"), threshold))
        found = cut(near.select("place").distinct())
        gone.append(found.select("place.*"))
        left = cut(left.join(found, "place", "left_anti"))
    return gone


def _marked(docs: DataFrame) -> DataFrame:
    """doc_id, text, mark: the text's hash, which tells rows of one doc_id apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def removed_places(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact: int = MIN_CHARS) -> DataFrame:
    """doc_id, mark and places: indexes, among the distinct lines of the text, of those that go; docs has doc_id, text, mark."""
    lines = _lines(docs, min(exact, min_chars))
    keys = F.concat(*keys_of(F.col("line"), F.col("n"), threshold, min_chars))
    if exact < min_chars:
        keys = F.when(F.col("n") >= min_chars, keys).otherwise(F.array().cast("array<bigint>"))
    keyed = lines.select("h1", "h2", F.struct(*PLACE, keys.alias("keys")).alias("f"))
    firsts = cut(keyed.groupBy("h1", "h2").agg(F.min("f").alias("f"), F.count("*").alias("times")).select("h1", "h2", "f.*", "times"))
    near = cut(near_lines(docs, firsts, threshold, min_chars).distinct()).withColumn("near", F.lit(True))
    # Only lines that occur again, or are near an earlier one, are looked up.
    marked = firsts.select("h1", "h2", _place().alias("first"), "times").join(near, ["h1", "h2"], "left").filter("times > 1 or near")
    marked = cut(marked.select("h1", "h2", "first", "near"))
    gone = lines.select(*PLACE, "h1", "h2").join(_small(marked, marked.count()), ["h1", "h2"]).filter(F.col("near") | (_place() != F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("places"))


def _kept(places: Column, least: int) -> Column:
    """struct(n, kept): the number of lines of the column text, and those that stay.

    Shorter lines than least always stay; a newline and their place before
    them, which no line has, tells them apart, so that one set difference
    drops the lines that go and all but the first of equal ones.
    """

    def stay(lines: Column) -> Column:
        gone = let(F.array_distinct(lines), lambda distinct: F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda p: F.get(distinct, p)))
        named = F.transform(lines, lambda x, i: F.when(F.length(x) < least, F.concat(i.cast("string"), F.lit("\n"), x)).otherwise(x))
        return F.transform(F.array_except(named, gone), lambda x: F.substring_index(x, "\n", -1))

    text = F.when(F.col("text").isNull(), F.array().cast("array<string>")).otherwise(F.split("text", "\n"))
    return let(text, lambda lines: F.struct(F.size(lines).alias("n"), F.when(places.isNull() & (F.col("doc_id").isNull() | (F.size(F.array_distinct(lines)) == F.size(lines))), lines).otherwise(stay(lines)).alias("kept")))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 (of the lines that stay, joined by newlines) of each row."""
    docs = _marked(docs)
    rows = docs.join(removed_places(docs, threshold, min_chars, min_chars), ["doc_id", "mark"], "left")
    report = let(_kept(F.col("places"), min_chars), lambda k: F.struct(k["n"].cast("long").alias("n_lines"), (k["n"] - F.size(k["kept"])).cast("long").alias("n_removed"), F.sha2(F.array_join(k["kept"], "\n"), 256).alias("kept_sha256")))
    return rows.select("doc_id", F.explode(F.array(report)).alias("r")).select("doc_id", "r.*")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, exact: int = 1) -> DataFrame:
    """docs with the lines removed from their texts; a document that loses lines and keeps none with content goes."""
    places, mark, new = (f"__lines_{x}" + "_" * max(map(len, docs.columns)) for x in ("gone", "mark", "new"))  # names that docs has not
    removed = removed_places(_marked(docs), threshold, min_chars, exact).withColumnsRenamed({"places": places, "mark": mark})
    rows = docs.withColumn(mark, F.xxhash64("text")).join(removed, ["doc_id", mark], "left")

    def rewritten(k: Column) -> Column:
        lost = (F.size(k["kept"]) < k["n"]) & (F.size(F.filter(k["kept"], lambda x: x != "")) == 0)
        return F.struct(F.when(F.size(k["kept"]) == k["n"], F.col("text")).otherwise(F.array_join(k["kept"], "\n")).alias("text"), lost.alias("lost"))

    # The row of one passes the rewritten text on as a column, so that no later use of it computes it again.
    rows = rows.withColumn(new, F.explode(F.array(let(_kept(F.col(places), min(exact, min_chars)), rewritten)))).filter(~F.col(new)["lost"])
    return rows.withColumn("text", F.col(new)["text"]).select(docs.columns)
