"""Line deduplication by a segment-partition edit join (native DataFrame code).

A line is dropped if an earlier line (by document id, then line number) equals it or lies within
``edits`` edits of it. Equal lines are found by a 128-bit hash. Near lines are found among the
first occurrences: each line is split into ``edits`` + 1 segments of almost equal length; a line
within that many edits must hold one of them unchanged, at a place that the two lengths allow.
Segments are indexed by length, number and content; every line probes the indexes of its own
length and of up to ``edits`` less with the substrings at the allowed places only
(multi-match-aware). A pair is a candidate only if the counts of ten letters in both lines allow that many edits.
Candidates are verified by an exact banded, bit-parallel edit distance.

Texts are split into a table of lines once. What is joined by content is hashes; texts move only
for lines that a bounded bitmap of hashes marks as possibly needed (a mark too many costs time, not
correctness). Equal lines are counted by partial aggregation and joined back by hash,
a join that adaptive execution splits for lines that are very common.

Defined results: lines are compared without white space at their ends; lines of fewer than
``least_chars`` code points and blank lines are never dropped; near lines are looked for from
``near_chars`` on; null text stays null and has no lines; rows with one document id are one document,
so equal lines at one place of them are one line; null ids count as the smallest id;
an empty table gives an empty result; further columns are kept by ``deduplicate``, but for those
that are named like one it adds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casegrain.llm.tables import bind, free, membership_bits, with_membership, without, written

LETTERS = "etaonirhsl"   # counted in the low 40 bits of a line's name, 4 bits each
EDITS = 2            # at most 4: the verification packs (edits + 1) * (2 * edits + 1) bits in 64
LEAST_CHARS = 20
NEAR_CHARS = 40      # at least (edits + 1) * (edits + 1)
WS = " \t\n\x0b\x0c\r"


def lines_of(docs: DataFrame, least_chars: int) -> DataFrame:
    """doc_id, line_no, line (trimmed), its length, hashes and place of every line that is long enough."""
    split = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "raw"))
    trimmed = split.select("doc_id", "line_no", F.btrim("raw", F.lit(WS)).alias("line"))
    sized = trimmed.withColumn("length", F.char_length("line")).where(F.col("length") >= least_chars)
    return sized.select("doc_id", "line_no", "line", "length", F.xxhash64("line").alias("h1"),
                        F.xxhash64(F.lit(1), "line").alias("h2"), _place().alias("place"))


def _place() -> Column:
    """Name of a line in the joins: 24 bits of its place's hash, and the counts of ten letters modulo 16.

    Lines that share a name are compared with each other too, so the short hash loses nothing.
    """
    out = F.call_function("shiftleft", F.xxhash64("doc_id", "line_no"), F.lit(4 * len(LETTERS)))
    for k, c in enumerate(LETTERS):
        n = F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(c), F.lit("")))
        out = out.bitwiseOR(F.call_function("shiftleft", n.cast("long").bitwiseAND(F.lit(15)), F.lit(4 * k)))
    return out


def _counts_allow(r: Column, s: Column, edits: int) -> Column:
    """Whether the letter counts in two names allow that many edits: each edit moves at most two counts by one."""
    total = F.lit(0).cast("long")
    for k in range(len(LETTERS)):
        lane = lambda x: F.call_function("shiftright", x, F.lit(4 * k)).bitwiseAND(F.lit(15))  # noqa: B023, E731
        d = F.abs(lane(r) - lane(s))
        total = total + F.least(d, F.lit(16) - d)
    return total <= 2 * edits


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """First character (from 1) and length of the i-th segment (from 1): the last ones are longer by one."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    short = parts - length % parts
    start = (i - 1) * base + F.greatest(F.lit(0), F.lit(i - 1) - short) + 1
    return start, base + F.when(short < i, 1).otherwise(0)


def _key(length: Column, i: int, piece: Column) -> Column:
    return F.xxhash64(length.cast("int"), F.lit(i), piece)


def index_keys(edits: int) -> Column:
    line, length = F.col("line"), F.col("length")
    out = []
    for i in range(1, edits + 2):
        start, size = _segment(length, i, edits)
        out.append(_key(length, i, F.substring(line, start, size)))
    return F.array(*out)


def probe_keys(edits: int) -> Column:
    """Keys of all places where a line that is shorter by 0 to ``edits`` can hold one of its segments.

    The places of the line's own segments are left out: their keys are its index keys.
    """
    line, out = F.col("line"), []
    for less in range(edits + 1):
        length = F.col("length") - less
        for i in range(1, edits + 2):
            start, size = _segment(length, i, edits)
            after = edits + 1 - i
            for shift in range(max(-(i - 1), less - after), min(i - 1, less + after) + 1):
                if less == shift == 0:
                    continue
                out.append(_key(length, i, F.substring(line, start + shift, size)))
    return F.array(*out)


def within_edits(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines are within ``edits`` edits: a bit-parallel automaton on the band of diagonals.

    Bit k of lane e says that a prefix of ``a`` of i characters and the prefix of ``b`` of
    i + k - edits characters are within e edits. One step of i moves all lanes: a match or a
    substitution stays on the diagonal, a deletion goes one down, an insertion one up.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def matches(ca, cb, i):
        """Bit k: character i of a equals character i + k - edits of b."""
        c, bits = F.get(ca, i), F.lit(0).cast("long")
        for k in range(width):
            bits = bits + F.when(F.get(cb, i + (k - edits)) == c, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long"))
        return bits

    def lane(state, e):
        return F.shiftright(state, e * width).bitwiseAND(F.lit(mask).cast("long"))

    def step(state, m):
        now = lane(state, 0).bitwiseAND(m)
        packed = now
        for e in range(1, edits + 1):
            old = lane(state, e - 1)
            now = (lane(state, e).bitwiseAND(m).bitwiseOR(old).bitwiseOR(F.shiftright(old, 1))
                   .bitwiseOR(F.shiftleft(now, 1).bitwiseAND(F.lit(mask).cast("long"))))
            packed = packed.bitwiseOR(F.shiftleft(now, e * width))
        return packed

    # Before the first character: b's first j characters are j insertions.
    start = sum(sum(1 << (edits + j) for j in range(e + 1)) << (e * width) for e in range(edits + 1))
    end = F.char_length(b) - F.char_length(a) + edits
    characters = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ""))

    def run(c):
        # An empty state (more edits everywhere on the band) stays empty: the rest of the line is skipped over.
        return F.when(F.size(c["a"]) == 0, F.lit(start).cast("long")).otherwise(F.aggregate(
            F.sequence(F.lit(0), F.size(c["a"]) - 1), F.lit(start).cast("long"),
            lambda state, i: F.when(state == 0, state).otherwise(
                bind(matches(c["a"], c["b"], i), lambda m: step(state, m)))))
    final = bind(F.struct(characters(a).alias("a"), characters(b).alias("b")), run)
    close = F.abs(F.char_length(a) - F.char_length(b)) <= edits
    bit = lambda s: F.call_function("shiftright", s, (end + edits * width).cast("int")).bitwiseAND(F.lit(1)) == 1
    return F.when(close, bind(final, bit)).otherwise(F.lit(False))


def _before(a: str, b: str) -> Column:
    """Place a comes before place b (struct order; a null id is the smallest)."""
    return F.struct(f"{a}.doc_id", f"{a}.line_no") < F.struct(f"{b}.doc_id", f"{b}.line_no")


def near_lines(firsts: DataFrame, lines: DataFrame, edits: int, scratch: list[DataFrame] | None = None) -> DataFrame:
    """doc_id, line_no of each of ``firsts`` that has an earlier one within ``edits`` edits."""
    index = firsts.select(F.explode(index_keys(edits)).alias("key"), F.col("place").alias("r"))
    probes = firsts.select(F.explode(probe_keys(edits)).alias("key"), F.col("place").alias("s"))
    allowed = _counts_allow(F.col("r"), F.col("s"), edits)
    # Segments at the same place of lines of one length: the index against itself, from one exchange.
    same = index.join(index.withColumnRenamed("r", "s"), "key").where((F.col("r") < F.col("s")) & allowed)
    moved = index.join(probes, "key").where((F.col("r") != F.col("s")) & allowed)
    pairs = same.select("r", "s").unionByName(moved.select(
        F.least("r", "s").alias("r"), F.greatest("r", "s").alias("s"))).distinct()
    twins = firsts.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
        F.col("place").alias("r"), F.col("place").alias("s"))
    pairs = written(pairs.unionByName(twins), "line-pairs", scratch=scratch)
    both = pairs.select(F.col("r").alias("place")).unionByName(pairs.select(F.col("s").alias("place"))).distinct()
    bits = membership_bits(both.select(F.xxhash64("place").alias("h")), "h")
    marked = with_membership(lines.withColumn("h", F.xxhash64("place")), "h", bits, "needed").where("needed")
    marked = marked.select("place", "doc_id", "line_no", "line")
    wanted = marked.join(both, "place", "left_semi")
    a = wanted.select(F.col("place").alias("r"), F.struct("doc_id", "line_no", "line").alias("x"))
    b = wanted.select(F.col("place").alias("s"), F.struct("doc_id", "line_no", "line").alias("y"))
    joined = pairs.join(a, "r").join(b, "s")
    joined = joined.where(_before("x", "y") | _before("y", "x"))     # a line isn't its own pair
    close = joined.where(within_edits(F.col("x.line"), F.col("y.line"), edits))
    later = F.when(_before("x", "y"), F.col("y")).otherwise(F.col("x"))
    return close.select(later.alias("z")).select("z.doc_id", "z.line_no").distinct()


def dropped_lines(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS,
                  near_chars: int = NEAR_CHARS) -> DataFrame:
    """A written table of doc_id, line_no and ``near`` of every line to drop."""
    scratch: list[DataFrame] = []
    lines = written(lines_of(docs.select("doc_id", "text"), least_chars), "lines", "zstd", scratch)
    copies = written(
        lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line_no")).alias("first"))
        .where("n > 1").select("h1", "h2", "first"), "line-copies", scratch=scratch)
    told = with_membership(lines, "h1", membership_bits(copies, "h1"), "maybe")
    place = F.struct(F.col("l.doc_id"), F.col("l.line_no"))
    maybe = told.where("maybe").alias("l").join(copies.alias("c"), ["h1", "h2"], "left")
    exact = maybe.where(place != F.col("c.first")).select("l.doc_id", "l.line_no")
    known = maybe.where(F.col("c.first").isNull() | (place == F.col("c.first"))).where(F.col("length") >= near_chars)
    firsts = told.where("NOT maybe").where(F.col("length") >= near_chars).select("line", "length", "place").unionByName(
        known.select("line", "length", "place"))
    near = near_lines(firsts, lines, edits, scratch)
    out = written(exact.distinct().withColumn("near", F.lit(False)).unionByName(near.withColumn("near", F.lit(True))), "dropped-lines")
    free(scratch)
    return out


def deduplicate(docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS,
                near_chars: int = NEAR_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` (doc_id, text) with the kept text.

    Adds n_lines, n_exact, n_near, dropped (line numbers) and emptied (nothing but white
    space is left of a text that had a word).
    """
    docs = docs.drop("n_lines", "n_exact", "n_near", "dropped", "emptied")
    rows = dropped_lines(docs, edits, least_chars, near_chars)
    per_doc = rows.groupBy(F.col("doc_id").alias("__id")).agg(
        F.sort_array(F.collect_set("line_no")).alias("dropped"),
        F.count_if(~F.col("near")).alias("n_exact"), F.count_if("near").alias("n_near")).withColumn(
        "__idh", F.xxhash64("__id"))
    told = with_membership(docs.withColumn("__h", F.xxhash64("doc_id")), "__h", membership_bits(per_doc, "__idh"), "__maybe")
    none = {"dropped": F.array().cast("array<int>"), "n_exact": F.lit(0).cast("long"), "n_near": F.lit(0).cast("long")}
    plain = told.where("NOT __maybe").withColumns(none)
    hit = told.where("__maybe").join(per_doc.drop("__idh"), F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    hit = hit.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    both = plain.unionByName(hit).drop("__h", "__maybe")

    def keep(lines):
        # array_except hashes: one pass, however many lines are dropped.
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "dropped")
        return F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n")
    lines = F.split("text", "\n")
    kept = F.when(F.size("dropped") == 0, F.col("text")).otherwise(bind(lines, keep))
    out = both.withColumns({"n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long"), "__kept": kept})
    emptied = (F.size("dropped") > 0) & (F.btrim("__kept", F.lit(WS)) == "")
    return out.withColumns({"emptied": emptied, "text": F.col("__kept")}).drop("__kept")


def without_leftovers(found: DataFrame, docs: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """Rows of ``found`` (a result of ``deduplicate`` on ``docs``) without emptied documents and without leftovers.

    A leftover lost lines, and each line left in it is shorter than ``least_chars`` and stands in a document of a
    smaller id, too: all its lines repeat earlier ones. The first document of a short line is never a leftover, so
    no line is lost altogether. Rows with one id are judged together, and a null id is the smallest.
    """
    columns = found.columns
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WS)))
    short = F.filter(trimmed, lambda x: (x != "") & (F.char_length(x) < least_chars))
    bare = F.forall(trimmed, lambda x: F.char_length(x) < least_chars)
    kept = written(found.where("NOT emptied").withColumn("__bare", F.coalesce((F.size("dropped") > 0) & bare, F.lit(False))),
                   "line-kept", "zstd")
    hashed = lambda df: df.select("doc_id", F.explode(short).alias("line")).select(
        "doc_id", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    scratch: list[DataFrame] = []
    own = written(hashed(kept.where("__bare")).distinct(), "bare-lines", scratch=scratch)
    told = with_membership(hashed(docs.where("text IS NOT NULL")), "h1", membership_bits(own, "h1"), "maybe")
    firsts = told.where("maybe").groupBy("h1", "h2").agg(F.min(F.struct("doc_id")).alias("first"))
    leftovers = written(own.join(firsts, ["h1", "h2"]).groupBy("doc_id").agg(
        F.bool_and(F.col("first") < F.struct("doc_id")).alias("repeats")).where("repeats").select("doc_id"), "leftovers")
    free(scratch)
    return kept.where("NOT __bare").select(columns).unionByName(without(kept.where("__bare").select(columns), leftovers))
