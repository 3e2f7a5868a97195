"""Line dedup by an edit join, with DataFrame and SQL functions alone.

A line is read as its characters, or from LONG characters on as its words (the parts between spaces), unless it has fewer
than one for each SPARSE characters. Two lines read alike are linked if their edit distance in these symbols is within the
limit of the shorter one, which grows with its symbols (see CLASSES). A line under LONG characters is compared as
characters with lines just over it too. Linked lines form classes and the first occurrence of a class, by (doc_id, line),
stays. No pair within its limit is missed.

A line's index holds limit + 1 disjoint segments of equal size, so a line within the limit holds one of them unchanged.
The first half of them lies at the line's begin and the others at its end. Layouts (the segments' size) depend on a step of the length,
and a line probes the layouts of all lengths it could meet with the substrings whose shift both sides of the segment can
pay for: at most i to either side for the segment that i others lie before, counted from the nearer end. For if each of the n first segments
is changed or has more edits than that before it, there are n edits in them at least, and so from the other end, which
makes limit + 1 in all.

All links are found and counted, also between lines that other links connect already: a family of n near copies has up to
n * n / 2. Most of these need no comparison and are never a row: each line of a crowded key is compared with one centre, the line that
meets most others there, and by the triangle inequality two lines of one centre are linked if their distances to it add up to no
more than their limit. A histogram of each centre's distances counts those links exactly. All other lines that share
a key are compared in pairs. Two lines that index several keys alike are compared at the least of these alone. Frequent keys
are dealt to several tasks, their index in turn and their other lines to all.

Equal lines are one node from the start, so a line in a third of all documents is one row in the join; lines are told
apart by 128 bits of hash. Lines that share a key travel as strings, words as a character each, which is a hash of theirs:
words taken for equal make lines no farther apart, so what is too far by Spark's own `levenshtein` is too far. Where two words
of a near pair have one character, a bit-parallel distance over a band of 2 * edits + 1 diagonals, of the words' 64-bit
hashes, decides.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.llm.common import cut, drop, flagged, freed, marked, marks, parts, read, table
from quillstack.llm.graph import components

#: From this length on a line is read as words ...
LONG = 60
#: ... if it has one for each so many characters.
SPARSE = 12
#: By reading (0 characters, 1 words): (least number of symbols, edits, step of the layouts). A tenth of the words, at most six:
#: the probes grow with the square of the edits.
CLASSES = {0: ((5, 1, 3), (20, 2, 8), (60, 3, 10), (80, 4, 20)), 1: ((5, 1, 5), (20, 2, 10), (30, 3, 10), (40, 4, 10), (50, 5, 10), (60, 6, 20))}
MOST = max(edits for own in CLASSES.values() for _, edits, _ in own)
#: A key of SAMPLED * FREQUENT rows is dealt to SALTS tasks.
SAMPLED, FREQUENT, SALTS = 64, 64, 16
#: Lines of a key with so many rows are compared with a centre first.
CROWDED = 8
#: Characters that words are written as, from the first place beyond the basic plane.
WRITTEN, WRITTEN_FROM = 1_000_000, 0x10000


def by_class(kind: Column, size: Column, value: int) -> Column:
    """One value of the class of `size` symbols; null below all classes. A place of a constant array: as branches, the classes made
    methods of 65 kB, which the JVM runs but never compiles."""
    top = max(own[-1][0] for own in CLASSES.values())
    found = [next((c[value] for c in reversed(CLASSES[k]) if n >= c[0]), None) for k in sorted(CLASSES) for n in range(top + 1)]
    table = F.expr(f"array({', '.join('CAST(NULL AS INT)' if x is None else str(x) for x in found)})")
    return F.get(table, kind * (top + 1) + F.least(size, F.lit(top)))


def limit(kind: Column, size: Column) -> Column:
    """Edits that a line of so many symbols may differ by."""
    return F.coalesce(by_class(kind, size, 1), F.lit(0))


def layout(kind: Column, size: Column) -> Column:
    """The least number of symbols with the same layout; -1 where there is none."""
    lo, step = by_class(kind, size, 0), by_class(kind, size, 2)
    return F.coalesce((lo + F.floor((size - lo) / step) * step).cast("int"), F.lit(-1))


def shifts(edits: int) -> list[tuple[int, int]]:
    """(segment, shift away from the nearer end) of all substrings that a line at most `edits` longer may have to probe."""
    return [(i, d) for i in range(edits + 1) for d in range(-min(i, edits - i), min(i, edits - i) + 1)]


def made_once(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """df's columns to keep and new ones, held in a generated row, so that the optimiser doesn't copy their expressions into each use."""
    row = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__row")
    return df.select(*keep, row).select(*keep, *(f"__row.{n}" for n in columns))


def line_keys(lines: DataFrame) -> DataFrame:
    """(key, ref) of lines(line_id, line, n): each line's index and probes, those of the layouts below, and those of shorter lines
    read otherwise. ref is four times the line's number, and two more where it is read as words, and one more where the key is of its index.

    Each step is a generated row, so all of it runs in compiled code.
    """
    words = made_once(lines.where(F.col("n") >= CLASSES[0][0][0]), ["line_id", "line", "n"], w=F.split("line", " "))
    read = made_once(words, ["line_id", "line", "n", "w"], kind=F.when(is_read_as_words(F.col("n"), F.size("w")), 1).otherwise(0))
    kind, longest = F.col("kind"), F.lit(LONG - 1)
    size = F.when(kind == 1, F.size("w")).otherwise(F.col("n"))
    below = size - limit(kind, size)
    # a line read as words but hardly longer than those that never are
    over = (kind == 1) & (F.col("n") < longest + 1 + limit(F.lit(0), longest))
    row = lambda k, size, at, own, there: F.struct(k.alias("k"), size.alias("size"), at.alias("at"), F.lit(own).alias("own"), there.alias("there"))
    ways = F.array(row(kind, size, size, 1, F.lit(True)), row(kind, size, below, 0, layout(kind, below) != layout(kind, size)), row(F.lit(0), F.col("n"), longest, 0, over))
    way = read.select("line_id", "line", "w", F.explode(ways).alias("x")).select("line_id", "line", "w", "x.*").where("there")
    # t edits, b and e the least and greatest number of symbols of the layout, g its segments' size
    b, t = layout(F.col("k"), F.col("at")), limit(F.col("k"), F.col("at"))
    laid = made_once(way, ["line_id", "line", "w", "k", "own"], n=F.col("size"), t=t, b=b, e=b + by_class(F.col("k"), F.col("at"), 2) - 1, g=F.floor(b / (t + 1)).cast("int")).where("t > 0 AND n - e <= t")
    plan = F.get(F.array(*(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(d).alias("d")) for i, d in shifts(k))) for k in range(MOST + 1))), F.col("t"))
    probed = laid.select("*", F.inline(plan))
    # the line is longer than those of the layout by n - e at least and by n - b at most, and the shifts of both sides of a segment add up to that
    paid = "greatest(0, n - e) - 2 * d <= t AND 2 * d - least(t, n - b) <= t"
    before = "if(2 * i <= t, i * g + d, n - (t + 1 - i) * g - d)"
    inside = probed.where(f"{before} >= 0 AND {before} + g <= n AND {paid}")
    place = F.expr(before) + 1
    key = F.when(F.col("k") == 1, F.xxhash64("k", "b", "i", F.slice("w", place, F.col("g")))).otherwise(F.xxhash64("k", "b", "i", F.substring("line", place, F.col("g"))))
    return inside.select(key.alias("key"), (F.col("line_id") * 4 + F.col("k") * 2 + F.when((F.col("own") == 1) & (F.col("d") == 0), 1).otherwise(0)).alias("ref"))


def is_read_as_words(n: Column, words: Column) -> Column:
    return (n >= LONG) & (n <= words * SPARSE)


def within(a: str, b: str, edits: int) -> str:
    """SQL for the edit distance of two arrays of symbols, the first at least as long and at most `edits` longer: exact if at most `edits`,
    else larger than that.

    Row a, column by column of b: bit k of the band stands for a's place column - edits + k. vp and vn are the vertical
    steps up and down in the band; the distance follows the band's lowest cell until it meets a's end and then a's last row.
    """
    top, ones = 2 * edits, (1 << (2 * edits + 1)) - 1
    same = " | ".join(f"if(j + {k - edits} >= 0 and j + {k - edits} < s.m and get(s.p, j + {k - edits}) = c, {1 << k}L, 0L)" for k in range(2 * edits + 1))
    d0 = "(((((x & s.vp) + s.vp) ^ s.vp) | x | s.vn) & %dL)" % ones
    hp = f"((s.vn | ~(d0 | s.vp)) & {ones}L)"
    row = f"shiftleft(1L, {top} - (j + {edits} + 1 - s.m))"
    step = f"""named_struct(
      'd', s.d + if(j + {edits} < s.m, if(d0 & {1 << top}L = 0, 1, 0), if(hp & {row} <> 0, 1, 0) - if(hn & {row} <> 0, 1, 0)),
      'vp', (hn | ~(shiftright(d0, 1) | hp)) & {ones}L,
      'vn', shiftright(d0, 1) & hp, 'm', s.m, 'p', s.p)"""
    # nested transforms name what is used twice
    step = f"element_at(transform(array({same}), x -> element_at(transform(array({d0}), d0 -> element_at(transform(array(named_struct('hp', {hp}, 'hn', d0 & s.vp)), h -> {step.replace('hp', 'h.hp').replace('hn', 'h.hn')}), 1)), 1)), 1)"
    start = f"named_struct('d', {edits}, 'vp', {ones & ~((1 << edits) - 1)}L, 'vn', 0L, 'm', size({a}), 'p', {a})"
    return f"aggregate(transform({b}, (c, j) -> struct(c, j)), {start}, (s, t) -> {step.replace('= c,', '= t.c,').replace('if(j ', 'if(t.j ').replace('and j ', 'and t.j ').replace('get(s.p, j ', 'get(s.p, t.j ').replace('(j +', '(t.j +')}, s -> s.d)"


#: Bytes of packed counts; one less than a long has, so that no sum reaches its sign.
COUNTS = 7
_LOW, _HIGH = int("7f" * COUNTS, 16), int("80" * COUNTS, 16)


def _add_byte(total: Column, one: Column) -> Column:
    """Sums of packed bytes modulo 256, none of which carries into the next."""
    return (total.bitwiseAND(F.lit(_LOW)) + one.bitwiseAND(F.lit(_LOW))).bitwiseXOR(total.bitwiseXOR(one).bitwiseAND(F.lit(_HIGH)))


def symbol_counts(s: str) -> Column:
    """Counts of an array's symbols by COUNTS hashes, a byte each."""
    summed = lambda add: F.aggregate(s, F.lit(0).cast("long"), lambda acc, x: add(acc, F.call_function("shiftleft", F.lit(1).cast("long"), (8 * F.pmod(F.xxhash64(x), F.lit(COUNTS))).cast("int"))))
    # no count of fewer symbols than 256 reaches the next byte
    return F.when(F.size(s) < 256, summed(Column.__add__)).otherwise(summed(_add_byte))


def counts_apart(a: str, b: str) -> Column:
    """The sum of differences of two packed counts. An edit changes two counts by one at most, so lines within k edits are at most 2k apart."""
    own = lambda c, k: F.shiftrightunsigned(c, 8 * k).bitwiseAND(F.lit(255))
    apart = [F.abs((own(a, k) - own(b, k) + 128).bitwiseAND(F.lit(255)) - 128) for k in range(COUNTS)]  # modulo 256
    return reduce(Column.__add__, apart)


def edits_within(pairs: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns and edits of the pairs within the limit of the shorter one; pairs: k, size, code and hashes of both, _b at least as long as _a."""
    most = limit(F.col("k"), F.col("size_a"))
    least = F.call_function("levenshtein", F.col("code_b"), F.col("code_a"), most)  # -1 above the limit
    first = made_once(pairs, [], **columns, kind=F.col("k"), most_of=most, least=least, p=F.col("hashes_b"), t=F.col("hashes_a")).where("least >= 0")
    words = F.array_union("p", "t")
    sound = (F.col("kind") == 0) | (F.size(F.array_distinct(F.transform(words, lambda x: F.pmod(x, F.lit(WRITTEN))))) == F.size(words))
    held = [*columns, "most_of", "least"]
    # words are needed only where two of a pair have one character
    told = made_once(first, held, sound=sound, p=F.col("p"), t=F.col("t"))
    edits = F.when(F.col("sound"), F.col("least"))
    for t in range(1, MOST + 1):
        edits = edits.when(F.col("most_of") == t, F.expr(within("p", "t", t)))
    return made_once(told, [*columns, "most_of"], edits=edits).where("edits <= most_of")


class LineDuplicates:
    """Steps over docs(doc_id, text). `h1`, `h2` are a line's hash, `mark` that of its row's text; each different line has a
    number `line_id`, given when the table of lines is written: of lines that stand more than once, which `copied` holds, the least."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
        every = self.docs.select("doc_id", "mark", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.ltrim("line", F.lit(" \t\n\x0b\f\r")) != "")
        hashed = every.withColumns({"h1": F.xxhash64(F.lit(41), "line"), "h2": F.xxhash64(F.lit(43), "line")})
        held = table(hashed.withColumns({"line_id": F.monotonically_increasing_id(), "n": F.length("line")}), "lines", compression="snappy")
        # a line that stands once, as most do, is not moved
        bits = marks(held.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1"))
        self.seen = cut(flagged(held.select("doc_id", "mark", "at", "h1", "h2"), bits, "h1", "again"), "seen")
        lines = flagged(held.select("line_id", "h1", "h2", "line", "n").where(F.col("n") >= CLASSES[0][0][0]), bits, "h1", "again")
        # one that stands in many rows is one in each task before it is
        again = lines.where("again").groupBy("h1", "h2").agg(F.min("line_id").alias("line_id"), F.first("line").alias("line"), F.first("n").alias("n"))
        self.copied = cut(again.select("line_id", "h1", "h2", "line", "n"), "copied")
        self.lines = lines.where("NOT again").drop("again").unionByName(self.copied)
        self.lines.written_at = held.written_at

    def met(self) -> DataFrame:
        """(key, line_id, k, is_index, n): the rows of all keys that several lines share and one indexes; k: as the key's line is read, n: the
        key's rows. Of keys that the same two or three rows share, as those of near copies are, the least is enough."""
        group = Window.partitionBy("key")
        told = line_keys(self.lines).withColumns({"lo": F.min("ref").over(group), "hi": F.max("ref").over(group), "index": F.max(F.col("ref") % 2).over(group), "n": F.count("*").over(group), "all": F.bit_xor("ref").over(group)})
        shared = cut(told.where((F.floor(F.col("lo") / 4) < F.floor(F.col("hi") / 4)) & (F.col("index") == 1)).drop("index"), "shared")
        # the least, the greatest and the exclusive or of all tell what the third is
        alike = shared.where("n <= 3").groupBy("n", "lo", "hi", "all").agg(F.min("key").alias("key"))
        alike = alike.select("key", F.explode(F.expr("if(n = 2, array(lo, hi), array(lo, hi, all ^ lo ^ hi))")).alias("ref"), "n")
        kept = shared.where("n > 3").select("key", "ref", "n").unionByName(alike)
        out = cut(kept.select("key", F.floor(F.col("ref") / 4).alias("line_id"), F.floor(F.col("ref") / 2 % 2).cast("int").alias("k"), (F.col("ref") % 2 == 1).alias("is_index"), "n"), "met")
        drop(shared)
        return out

    def written(self, met: DataFrame) -> DataFrame:
        """(line_id, h1, h2, k, plain, n, size, counts, code, hashes, words, own, keys, frequent, crowded, meets) of the lines in met, by reading: whether they are
        read as characters, their characters and symbols, counts of these, a character for each, the words' hashes and how many differ, the keys
        they index, all their keys, the frequent and the crowded ones, and the rows of the keys they index."""
        keys = lambda there: F.collect_set(F.when(there, F.col("key")))
        own = met.groupBy("line_id", "k").agg(keys(F.col("is_index")).alias("own"), F.collect_set("key").alias("keys"), keys(F.col("n") >= SAMPLED * FREQUENT).alias("frequent"), keys(F.col("n") >= CROWDED).alias("crowded"), F.sum(F.when(F.col("is_index"), F.col("n")).otherwise(0)).alias("meets"))
        bits = marks(own.select(F.xxhash64("line_id").alias("h")))
        near = flagged(self.lines.withColumn("h", F.xxhash64("line_id")), bits, "h", "near").where("near").drop("h", "near").join(own, "line_id")
        held = ["line_id", "h1", "h2", "line", "n", "k", "own", "keys", "frequent", "crowded", "meets"]
        words = made_once(near, held, w=F.split("line", " "))
        read = made_once(words, held, plain=~is_read_as_words(F.col("n"), F.size("w")), s=F.when(F.col("k") == 1, F.col("w")).otherwise(F.split("line", "")))
        hashed = made_once(read, [*held, "plain", "s"], hashes=F.when(F.col("k") == 1, F.transform("s", lambda x: F.xxhash64(x))))
        places = F.array_join(F.transform("hashes", lambda x: F.lpad(F.hex(F.pmod(x, F.lit(WRITTEN)) + WRITTEN_FROM), 8, "0")), "")
        code = F.when(F.col("k") == 1, F.decode(F.unhex(places), "UTF-32")).otherwise(F.col("line"))
        return cut(hashed.select("line_id", "h1", "h2", "k", "plain", "n", F.size("s").alias("size"), symbol_counts("s").alias("counts"), code.alias("code"), "hashes", F.size(F.array_distinct("hashes")).alias("words"), "own", "keys", "frequent", "crowded", "meets"), "written")

    def ready(self) -> DataFrame:
        """The lines that share keys, written. The table of lines is used up: its texts are deleted before rows that are compared are dealt
        out, and `named` has (line_id, h1, h2) of those."""
        met = self.met()
        told = self.written(met)
        self.named = cut(told.select("line_id", "h1", "h2").distinct(), "named")
        drop(met, self.lines, self.copied)
        return told

    def every(self) -> DataFrame:
        """(a, b, edits): all links, a < b, each compared and listed."""
        told = self.ready()
        out = cut(self.compared(told.withColumns({"centre": F.lit(None).cast("long"), "far": F.lit(None).cast("int")})), "every")
        drop(told)
        return out

    def counted(self) -> tuple[DataFrame, DataFrame]:
        """(links, degrees): (a, b, edits), all links but those that centres tell, and those of lines with their centre, which connect the others;
        (node, pairs): how many links a line has, all counted."""
        told = self.ready()
        stars = self.stars(told)
        by = stars.select(F.col("line_id").alias("of_line"), F.col("k").alias("of_k"), "centre", "far")
        alone = F.size("crowded") == 0
        placed = told.where(~alone).join(by, (F.col("line_id") == F.col("of_line")) & (F.col("k") == F.col("of_k")), "left").drop("of_line", "of_k")
        placed = placed.unionByName(told.where(alone).withColumns({"centre": F.lit(None).cast("long"), "far": F.lit(None).cast("int")}))
        rest = cut(self.compared(placed), "compared")
        drop(told)
        # of one centre, by distance and limit
        bins = stars.groupBy("centre", "k", "far", "most").agg(F.count("*").alias("n"))
        shape = bins.groupBy("centre", "k").agg(F.collect_list(F.struct("far", "most", "n")).alias("bins"))
        linked = F.expr("aggregate(bins, 0L, (s, x) -> s + if(x.far + far <= least(x.most, most), x.n, 0L)) - if(2 * far <= most, 1, 0)")
        told_by = stars.join(shape, ["centre", "k"]).select(F.col("line_id").alias("node"), linked.alias("pairs"))
        one = lambda x: rest.select(F.col(x).alias("node"), F.lit(1).cast("long").alias("pairs"))
        degrees = cut(one("a").union(one("b")).union(told_by).groupBy("node").agg(F.sum("pairs").alias("pairs")).where("pairs > 0"), "degrees")
        to_centre = stars.where("line_id <> centre").select(F.least("line_id", "centre").alias("a"), F.greatest("line_id", "centre").alias("b"), F.col("far").alias("edits"))
        return rest.union(to_centre), degrees

    def stars(self, told: DataFrame) -> DataFrame:
        """(line_id, k, most, centre, far): lines of crowded keys that are within the limit of a centre, their own limit and the distance. A line
        has one centre at most: of its crowded keys' lines the one whose index meets most. Which one that is bears on the work alone, not on the result."""
        # lines under LONG characters are compared with some others too, but what is plain with all that is
        fit = told.where((F.col("k") == 1) | F.col("plain"))
        # of lines that meet as many, one whose middle, which no segment holds, is met most
        edits = limit(F.col("k"), F.col("size"))
        each = F.floor(layout(F.col("k"), F.col("size")) / (edits + 1))
        middle = F.xxhash64("size", F.substring("code", ((F.floor(edits / 2) + 1) * each + 1).cast("int"), (F.col("size") - (edits + 1) * each).cast("int")))
        keyed = fit.select("line_id", "k", "meets", middle.alias("middle"), F.explode("crowded").alias("key"))
        middles = keyed.groupBy("key", "middle").agg(F.count("*").alias("n"), F.max(F.struct("meets", "line_id")).alias("most"))
        heads = middles.groupBy("key").agg(F.max(F.struct("most.meets", "n", "most.line_id")).alias("head")).withColumnRenamed("key", "at")
        chosen = keyed.join(heads, F.col("key") == F.col("at")).groupBy("line_id", "k").agg(F.max("head").alias("head")).select(F.col("line_id").alias("of_line"), F.col("k").alias("of_k"), F.col("head.line_id").alias("centre"))
        carried = ("line_id", "size", "code", "hashes")
        lines = fit.where(F.size("crowded") > 0)
        own = lines.join(chosen, (F.col("line_id") == F.col("of_line")) & (F.col("k") == F.col("of_k"))).select("k", "centre", *(F.col(c).alias(f"{c}_x") for c in carried))
        at = lines.select(F.col("k").alias("k_c"), *(F.col(c).alias(f"{c}_c") for c in carried))
        met = own.join(at, (F.col("centre") == F.col("line_id_c")) & (F.col("k") == F.col("k_c")))
        longer = F.col("size_x") > F.col("size_c")
        sides = {f"{c}_{side}": F.when(longer if side == "b" else ~longer, F.col(f"{c}_x")).otherwise(F.col(f"{c}_c")) for c in carried[1:] for side in "ab"}
        both = made_once(met, ["k", "line_id_x", "centre", "size_x"], **sides)
        near = edits_within(both, {"line_id": F.col("line_id_x"), "k": F.col("k"), "own_most": limit(F.col("k"), F.col("size_x")), "centre": F.col("centre")})
        return cut(near.select("line_id", "k", F.col("own_most").alias("most"), "centre", F.col("edits").alias("far")), "stars")

    def compared(self, told: DataFrame) -> DataFrame:
        """(a, b, edits): the links of told's lines that share a key, a < b, but those that a common centre tells. Lines are compared where one of
        them is the key's index."""
        # a line's row has all its keys, so it needs no join to get to each
        keyed = lambda keys: told.withColumn("key", F.explode(keys)).withColumn("often", F.array_contains("frequent", F.col("key")))
        carried = ("line_id", "plain", "n", "size", "counts", "code", "hashes", "words", "centre", "far")
        turn = F.when(F.col("often"), F.pmod(F.xxhash64(F.lit(7), "line_id"), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
        turns = F.explode(F.when(F.col("often"), F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long"))))
        left = keyed("own").select("key", turn.alias("turn"), "k", F.col("own").alias("own_a"), limit(F.col("k"), F.col("size")).alias("most"), *(F.col(c).alias(f"{c}_a") for c in carried))
        right = keyed("keys").select(F.col("key").alias("key_b"), turns.alias("turn_b"), F.col("keys").alias("keys_b"), *(F.col(c).alias(f"{c}_b") for c in carried))
        most = F.col("most")
        # the longer one probes what the shorter one indexes, and the least of the keys where they meet is the pair's
        longer = (F.col("size_a") < F.col("size_b")) | ((F.col("size_a") == F.col("size_b")) & (F.col("line_id_a") < F.col("line_id_b")))
        once = F.array_min(F.array_intersect("own_a", "keys_b")) == F.col("key")
        by_centre = F.coalesce((F.col("centre_a") == F.col("centre_b")) & (F.col("far_a") + F.col("far_b") <= most), F.lit(False))
        # a line under LONG characters is compared as characters with any other
        alike = (F.col("k") == 1) | (F.col("n_a") < LONG) | (F.col("plain_a") & F.col("plain_b"))
        # each word that one line alone has costs an edit
        few = (F.col("k") == 0) | (F.size(F.array_union("hashes_a", "hashes_b")) - F.least("words_a", "words_b") <= most)
        near = (F.col("size_b") - F.col("size_a") <= most) & ~by_centre & (counts_apart("counts_a", "counts_b") <= 2 * most)
        met_by = (F.col("key") == F.col("key_b")) & (F.col("turn") == F.col("turn_b"))
        # rows are few for the work that they make, so their number of tasks stays
        n = parts(self.docs.sparkSession)
        close = left.repartition(n, "key", "turn").join(right.repartition(n, "key_b", "turn_b"), met_by & longer & near & alike & once & few)
        return edits_within(close, {"a": F.least("line_id_a", "line_id_b"), "b": F.greatest("line_id_a", "line_id_b")}).select("a", "b", "edits")

    def links(self, every: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(links, classes): (a, b, edits), enough of all links to connect what they connect, and (node, class) of the lines they connect."""
        every = self.every() if every is None else every
        way = lambda x, y: every.select(F.col(x).alias("x"), F.struct(F.col(y).alias("y"), "edits").alias("to"))
        least = way("a", "b").union(way("b", "a")).groupBy("x").agg(F.min("to").alias("to"))
        begun = cut(least.select(F.least("x", "to.y").alias("a"), F.greatest("x", "to.y").alias("b"), F.col("to.edits").alias("edits")).distinct(), "begun")
        classes = components(begun.select("a", "b"), native=True)
        between = every
        for x in ("a", "b"):
            between = between.join(classes.select(F.col("node").alias(x), F.col("class").alias(f"c{x}")), x)
        pair = [F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")]
        rest = cut(between.where("ca <> cb").groupBy(*pair).agg(F.min(F.struct("a", "b", "edits")).alias("one")).select("one.*"), "rest")
        if rest.isEmpty():
            return begun, classes
        drop(classes)
        links = begun.union(rest)
        return links, components(links.select("a", "b"), native=True)

    def sketched(self, met: DataFrame) -> DataFrame:
        """(line_id, kind, size, counts) of the lines in met: how they are read, their number of symbols, and counts of these by COUNTS hashes, a byte each."""
        bits = marks(met.select(F.xxhash64("line_id").alias("h")))
        near = marked(self.lines.select("line_id", "line", "n").withColumn("h", F.xxhash64("line_id")), bits, "h")
        words = made_once(near, ["line_id", "line", "n"], w=F.split("line", " "))
        as_words = is_read_as_words(F.col("n"), F.size("w"))
        read = made_once(words, ["line_id"], kind=F.when(as_words, 1).otherwise(0), s=F.when(as_words, F.col("w")).otherwise(F.split("line", "")))
        return cut(read.select("line_id", "kind", F.size("s").alias("size"), symbol_counts("s").alias("counts")), "sketched")

    def dropped(self, classes: DataFrame, degrees: DataFrame) -> DataFrame:
        """(doc_id, mark, at, near, linked, goes, pairs, class): the occurrences of lines that have copies or relatives; near: the line differs from
        the one that stays; linked: other lines are in its class; goes: it isn't the first; pairs: its links with other lines; class: the least
        hash of its class's lines."""
        named = cut(self.named.join(classes.join(degrees, "node"), F.col("line_id") == F.col("node")).select("h1", "h2", "class", "pairs"), "linked")
        heads = named.groupBy("class").agg(F.min(F.struct("h1", "h2")).alias("head"))
        known = cut(named.join(heads, "class").select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "head", "pairs"), "known")
        # lines that stand once and have no relatives bear on no other
        bits = marks(known.select("k1"))
        placed = flagged(self.seen, bits, "h1", "related").where("again OR related").join(known, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
        placed = cut(placed.select("doc_id", "mark", "at", "h1", "h2", F.coalesce("head.h1", "h1").alias("c1"), F.coalesce("head.h2", "h2").alias("c2"), F.col("head").isNotNull().alias("linked"), F.coalesce("pairs", F.lit(0).cast("long")).alias("pairs")), "placed")
        # null ids come last; an occurrence alone in its class is told by the counts
        place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "at", "mark", "h1", "h2")
        first = placed.groupBy("c1", "c2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").toDF("f1", "f2", "first", "n")
        goes = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("at") == F.col("first.at")) & (F.col("mark") == F.col("first.mark")))
        near = (F.col("h1") != F.col("first.h1")) | (F.col("h2") != F.col("first.h2"))
        both = placed.join(cut(first, "first"), (F.col("c1") == F.col("f1")) & (F.col("c2") == F.col("f2")), "left")
        name = F.concat(F.lpad(F.hex("c1"), 16, "0"), F.lpad(F.hex("c2"), 16, "0")).alias("class")
        return both.where("linked OR n IS NOT NULL").select("doc_id", "mark", "at", F.coalesce(near, F.lit(False)).alias("near"), "linked", F.coalesce(goes, F.lit(False)).alias("goes"), "pairs", name)


def _told(docs: DataFrame) -> tuple[LineDuplicates, DataFrame]:
    """The steps, and what they tell of each document with lines that have copies or relatives, written."""
    steps = LineDuplicates(docs)
    links, degrees = steps.counted()
    classes = components(links.select("a", "b"), native=True)
    # dealt out once for both
    told = steps.dropped(classes, degrees).repartition("doc_id", "mark").distinct().groupBy("doc_id", "mark").agg(F.array_sort(F.collect_list(F.when(F.col("goes"), F.col("at")))).alias("dropped"), F.count_if(F.col("goes") & F.col("near")).alias("n_near"), F.count_if("linked").alias("n_links"), F.sum("pairs").alias("n_pairs"), F.array_sort(F.collect_set("class")).alias("classes"))
    return steps, cut(told.select(F.col("doc_id").alias("own"), F.col("mark").alias("own_mark"), "dropped", "n_near", "n_links", "n_pairs", "classes"), "told")


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_lines, dropped (places of the lines that go, in order), n_near (those that only resemble theirs), n_links
    (its lines that are linked with a different one), kept (the text without them), n_pairs (links of its lines with different lines,
    all counted, once for each time a line stands there) and classes (those of its lines that have copies or relatives).

    Lines end at \\n. Blank lines always stay; lines of fewer than five characters match only equal lines. A null text
    counts as empty. Rows with equal id and text get equal results; null ids come after all others. An empty table gives no rows.
    """
    with freed(docs.sparkSession):
        steps, told = _told(docs)
    # a document's row in told is small, so its side is hashed and no text is sorted
    out = steps.docs.join(told.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("mark") == F.col("own_mark")), "left")
    out = out.withColumn("lines", F.split("text", "\n")).withColumn("dropped", F.coalesce("dropped", F.array().cast("array<int>")))
    stay = F.expr("transform(array_except(sequence(0, size(lines) - 1), dropped), i -> lines[i])")
    return out.select("doc_id", F.size("lines").cast("long").alias("n_lines"), "dropped", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.array_join(stay, "\n").alias("kept"), F.coalesce("n_pairs", F.lit(0).cast("long")).alias("n_pairs"), F.coalesce("classes", F.array().cast("array<string>")).alias("classes"))


def op10_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, n_near, n_links, kept_sha256, n_pairs, classes (see dedup_lines for odd rows)."""
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), "n_near", "n_links", F.sha2("kept", 256).alias("kept_sha256"), "n_pairs", "classes")
