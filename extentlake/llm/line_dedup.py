"""Removal of repeated and nearly repeated lines by an exact set-similarity join, in DataFrame functions only.

A line is the set of its words, what blanks part, in lower case.  Of lines whose sets have a Jaccard
similarity of at least ``num / den``, only the first stays; lines are ordered by document key, hash of the
document's text and line number.  A line is removed if any earlier line matches it, whether or not that one was removed itself.

Lines that are equal but for case are one line for the join, with their first occurrence; they are numbered in the
order of these.  Word frequencies are counted over all documents in ``RARITY_BINS`` hash bins, whose rounded
logarithms give each word a rarity; a line's words are ordered by rarity, ties by hash.  Two similar sets share a
word in their prefixes of n - ceil(t n) + 1 words, so lines are joined on their prefix words.  Each line carries a parity
sketch, in which every word flips one of 64 or 128 bits: sets that differ in d words have sketches that differ in d bits at
most, so that sizes and sketches rule out nearly all other pairs inside the join, and no such pair is written.  What is left is
compared as whole sets, which are made anew for the lines in question.  Of two lines the smaller one needs only a prefix of n - ceil(2 t / (1 + t) n) + 1
words, and words that occur once in all documents need no partner.  The join is made in ``SLICES`` of the words, one after the other, each of
which needs only its share of the disk; both its sides are one exchange.  Any order gives the same result; a rare-first order only keeps the candidates few.

A line goes if it has one earlier match, so not all are needed.  In rounds, lines are first compared with a few hundred of all
lines, then with ``STEP`` times as many, at last with all; what has a match goes before the next round.  So a line with many
matches has gone before they are all listed, and the pairs grow as the lines do, however large the clusters of nearly equal
lines.  In each round the lines with the nearest sketches are chosen.  They are compared as sets after the rounds against shares, so that
the texts are read once for all of these; lines that were in question without a match are in the last round.  After that all that remain are compared.

Null texts and lines without letters and digits are left alone.  A document is named by its key and two hashes of its
text.  Rows that repeat both are the same document: their lines are each other's equals and stay or go together.  Rows
with one key, or none, and different texts are different documents.  Null keys come first.  Very long lines have prefixes
as long; a document's lines are one cell.  An empty table gives an empty result.  Only key and text are read; a further
column that is named like the result is replaced.

Lines are equal if two 64-bit hashes are, words if 60 bits of their hash are; candidates are compared by words' 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_map, collect_garbage, fresh, on_map, written

#: What names a document.
NAMES = ("doc", "own", "own2")

#: Bins of the word frequencies; the table of their levels is half a byte a bin.
RARITY_BINS = 1 << 24
#: The first round compares with so many lines at least, each further one with ``STEP`` times as many.
HUBS = 256
STEP = 16
#: The lines with the nearest sketches, of those that a round has found, are compared as sets.
NEAR = 8
#: Parts of the words that are joined one after the other.
SLICES = 2
#: Lines of more words have sketches of 128 bits.
LONG = 64
#: What is needed to tell whether two lines can be similar.
PROFILE = ("id", "n", "s1", "s2")
_WORD = r"[\p{L}\p{N}]"
#: Ranks of words that occur twice at least.
_TWICE = -7 << 60
#: Bits of a line's id: Spark numbers the rows of a partition by 33 of them.
_ID_BITS = 55


def _words(line: str) -> Column:
    """The hashes of a line's distinct words: of what blanks part."""
    return F.array_distinct(F.transform(F.array_remove(F.split(line, " ", -1), ""), lambda w: F.xxhash64(w)))


def _bin(h: Column, bins: int) -> tuple[Column, Column]:
    """Where a word's level is: the slot, and the level's first bit in it."""
    return F.shiftright(h, 44).bitwiseAND(F.lit(bins // 16 - 1)).cast("int"), h.bitwiseAND(F.lit(60)).cast("int")


def _levels(docs: DataFrame, text: str, bins: int) -> DataFrame:
    """One row with the array of all bins' frequency levels, of four bits each, the highest one turned over: sixteen in a long word."""
    # Line breaks become blanks: one split for both.
    words = docs.select(F.explode(F.split(F.replace(F.lower(text), F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    slot, place = _bin(F.xxhash64("w"), bins)
    counted = words.groupBy((slot * 16 + F.shiftright(place, 2)).alias("bin")).agg(F.count("*").alias("n"))
    # Level 0 has what occurs once; up to 2^25 occurrences are told apart.
    level = F.when(F.col("n") == 1, 0).otherwise(F.least(F.lit(15), F.floor(F.log2("n") * 0.56) + 1)).cast("long")
    part = F.call_function("shiftleft", level.bitwiseXOR(F.lit(8)), F.col("bin").bitwiseAND(F.lit(15)) * 4)
    # Slots in order, with level 0 where no word fell: at most ``bins / 16`` rows meet here, whatever the corpus.
    every = docs.sparkSession.range(bins // 16).select(F.col("id").cast("int").alias("slot"), F.lit(0).cast("long").alias("levels"))
    return (
        counted.select(F.shiftright("bin", 4).alias("slot"), part.alias("levels"))
        .unionByName(every)
        .groupBy("slot")
        .agg(F.bit_or("levels").alias("levels"))
        .agg(F.sort_array(F.collect_list(F.struct("slot", "levels")))["levels"].alias("levels"))
    )


def names(key: str = "doc_id", text: str = "text") -> tuple[Column, Column, Column]:
    """``NAMES`` of a row.  Few rows have one key, so that the second hash is only needed without one."""
    doc = F.col(key).cast("long")
    return doc, F.xxhash64(F.col(text)), F.when(doc.isNull(), F.xxhash64(F.lit(2), F.col(text))).otherwise(F.lit(0).cast("long"))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``NAMES`` and (line, norm, h1, h2) of every line with a letter or digit; h1 and h2 together name the line."""
    return (
        docs.select(*(c.alias(n) for c, n in zip(names(key, text), NAMES)), F.posexplode(F.split(F.col(text), "\n")).alias("line", "raw"))
        .where(F.col("raw").rlike(_WORD))
        .select(*NAMES, "line", F.lower(F.trim("raw")).alias("norm"))
        .withColumn("h1", F.xxhash64("norm"))
        .withColumn("h2", F.xxhash64(F.lit(2), "norm"))
    )


def _sketches(words: str) -> tuple[Column, Column]:
    """A parity sketch: of up to ``LONG`` words one long word, of more two, whose sum by bits is that one."""

    def flip(bit: Column, w: Column) -> Column:
        return F.call_function("shiftleft", bit, w.bitwiseAND(F.lit(63)).cast("int"))

    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    whole = F.aggregate(words, zero, lambda acc, w: acc.bitwiseXOR(flip(one, w)))
    half = F.aggregate(words, zero, lambda acc, w: acc.bitwiseXOR(flip(F.shiftright(w, 6).bitwiseAND(one), w)))
    return whole, F.when(F.size(words) > LONG, half).otherwise(zero)


def _flips(n_a: Column, a1: Column, a2: Column, n_b: Column, b1: Column, b2: Column) -> Column:
    """The bits in which two sketches differ."""
    both, half = a1.bitwiseXOR(b1), a2.bitwiseXOR(b2)
    return F.when(F.least(n_a, n_b) > LONG, F.bit_count(half) + F.bit_count(both.bitwiseXOR(half))).otherwise(F.bit_count(both))


def _may_match(a: str, b: str, num: int, den: int) -> Column:
    """Whether sizes and sketches, in columns that are named by these patterns, allow two lines to be similar."""
    (n_a, *x), (n_b, *y) = ([F.col(s.format(c)) for c in PROFILE[1:]] for s in (a, b))
    fits = F.least(n_a, n_b) * den >= F.greatest(n_a, n_b) * num
    return fits & (_flips(n_a, *x, n_b, *y) * (den + num) <= (n_a + n_b) * (den - num))


def _distinct(lines: DataFrame, levels: DataFrame, bins: int, num: int, den: int) -> DataFrame:
    """(h1, h2, first, times, n, s1, s2, prefix, lead) of every distinct line: first is its first occurrence, n is the number of words, s1 and s2
    their sketch, prefix has hashes of the rarest, without those that occur once; so many of them lead that they suffice against lines that are not smaller."""

    def ranked(h: Column) -> Column:
        slot, place = _bin(h, bins)
        # Never null: only arrays without nulls are sorted as plain longs.
        levels = F.coalesce(F.get("levels", slot), F.lit(0).cast("long"))
        level = F.shiftleft(F.call_function("shiftrightunsigned", levels, place), 60)
        return level.bitwiseOR(F.call_function("shiftrightunsigned", h, F.lit(4)))

    def shared(n: str, num: int, den: int) -> str:
        return f"cast(({n} * {num} + {den - 1}) div {den} as int)"

    # The levels are used in one place of the next step, else they would be copied into every row.
    words = F.sort_array(F.transform(_words("norm"), ranked))
    sets = lines.withColumn("levels", levels.scalar()).select(F.struct(*NAMES, "line").alias("first"), "h1", "h2", words.alias("words"))
    s1, s2 = _sketches("words")
    length = F.expr(f"size(words) - {shared('size(words)', num, den)} + 1")
    sets = sets.select(
        "first", "h1", "h2", F.size("words").cast("long").alias("n"), s1.alias("s1"), s2.alias("s2"), F.slice("words", F.lit(1), length).alias("rarest")
    )
    drawn = sets.select(
        "first", "h1", "h2", "n", "s1", "s2", F.filter("rarest", lambda w: w >= _TWICE).alias("often"), F.size("rarest").alias("all"),
        F.expr(f"cast(n as int) - {shared('n', 2 * num, den + num)} + 1").alias("lead"),
    ).select(
        "first", "h1", "h2", "n", "s1", "s2", F.transform("often", lambda w: F.hash(w)).alias("prefix"),
        F.greatest(F.lit(0), F.col("lead") - F.col("all") + F.size("often")).alias("lead"),
    )
    once = [F.first(c).alias(c) for c in ("n", "s1", "s2", "prefix", "lead")]
    return drawn.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count("*").alias("times"), *once)


def _numbered(merged: DataFrame) -> DataFrame:
    """Lines with their ``id``, which follows the order of the first occurrences."""
    return merged.orderBy("first").withColumn("id", F.monotonically_increasing_id())


def _rounds(count: int) -> list[int]:
    """Each round compares with one in so many of the ``count`` lines, the last one with all."""
    found = [1]
    while count >= HUBS * STEP * found[-1]:
        found.append(STEP * found[-1])
    return found[::-1]


def _without(lines: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The profiles and prefixes of the ``lines``, and whether they are ``gone``."""
    bits = scratch.written(bit_map(gone.select(F.xxhash64("id").alias("own")), "own"), "bits")
    profile = lines.select(*PROFILE, "prefix", "lead")
    # All lines that are gone are on the map, so that only those on it are looked up.
    doubt = on_map(bits.scalar(), F.xxhash64("id"))
    looked = profile.where(doubt).join(gone.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left")
    looked = looked.select(*profile.columns, F.col("_gone").isNotNull().alias("gone"))
    return profile.where(~doubt).withColumn("gone", F.lit(False)).unionByName(scratch.written(looked, "stay"))


def _rest(lines: DataFrame, left: DataFrame, num: int, den: int, scratch: Scratch, every: int = 1) -> DataFrame:
    """(a, b, flips): b is one of the lines ``left`` that is not gone and shares a prefix word with the earlier line a, of which one in ``every``
    is taken; sizes and sketches, which differ in so many bits, allow them to be similar.  ``left`` has those that are gone, too, marked in a column.
    A pair is there once if all are taken, else once for each word."""
    if "gone" not in left.columns:
        left = left.withColumn("gone", F.lit(False))

    def named(of: DataFrame, s: str) -> DataFrame:
        return of.select(*(F.col(c).alias(c + s) for c in of.columns))

    def met(a: DataFrame, b: DataFrame, *more: Column) -> DataFrame:
        same = (F.col("word_a") == F.col("word_b")) & (F.col("id_a") < F.col("id_b"))
        for c in (_may_match("{}_a", "{}_b", num, den), *more):
            same = same & c
        (n_a, *x), (n_b, *y) = ([F.col(c + s) for c in PROFILE[1:]] for s in ("_a", "_b"))
        found = a.join(b, same).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), _flips(n_a, *x, n_b, *y).alias("flips"))
        return scratch.written(found, "met")

    if every > 1:
        hubs = lines.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(every)) == 0)
        some = scratch.written(hubs.select(*PROFILE, F.explode("prefix").alias("word")), "some")
        bits = scratch.written(bit_map(some.select(F.col("word").cast("long").alias("word")), "word"), "bits")
        asked = left.where(~F.col("gone")).select(*PROFILE, F.explode("prefix").alias("word"))
        found = met(named(some, "_a"), named(asked.where(on_map(bits.scalar(), F.col("word").cast("long"))), "_b"))
        scratch.drop(some, bits)
        return found

    # Both sides are one table, so that its rows are exchanged once.  Conditions on one side alone would be moved below the exchange.
    sides = left.select(*PROFILE, "lead", "gone", F.posexplode("prefix").alias("place", "word"))
    role = F.when(F.col("place") < F.col("lead"), 2).otherwise(0) + F.when(F.col("gone"), 0).otherwise(1)
    sides = sides.select(*PROFILE, role.alias("role"), "word")
    # The smaller line needs fewer of its words; of lines of one size the earlier one is taken as the smaller.
    smaller = F.when(F.col("n_a") <= F.col("n_b"), F.col("role_a")).otherwise(F.col("role_b"))
    meant = smaller.bitwiseAND(F.lit(2)) + F.col("role_b").bitwiseAND(F.lit(1)) == 3

    def part(k: int) -> DataFrame:
        some = sides.where(F.pmod("word", F.lit(SLICES)) == k)
        return met(named(some, "_a"), named(some, "_b"), meant)

    return reduce(DataFrame.unionByName, [part(k) for k in range(SLICES)]).distinct()


def _nearest(met: DataFrame) -> DataFrame:
    """(a, b): each b with those ``NEAR`` of its a whose sketches are nearest."""
    near = F.call_function("shiftleft", F.col("flips").cast("long"), F.lit(_ID_BITS)).bitwiseOR(F.col("a"))
    nearest = met.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(near)), 1, NEAR).alias("near"))
    return nearest.select("b", F.explode("near").alias("near")).select(F.col("near").bitwiseAND(F.lit((1 << _ID_BITS) - 1)).alias("a"), "b")


def _touched(lines: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The ``lines`` that occur twice or may be ``gone``; no other line is removed anywhere."""
    bits = scratch.written(bit_map(gone.select(F.xxhash64("id").alias("own")), "own"), "bits")
    return lines.where((F.col("times") > 1) | on_map(bits.scalar(), F.xxhash64("id")))


def _matched(pairs: DataFrame, lines: DataFrame, docs: DataFrame, key: str, text: str, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The distinct b of those ``pairs`` whose lines are similar as sets."""
    close = scratch.written(pairs, "close")
    asked = close.select(F.col("a").alias("_id")).union(close.select(F.col("b").alias("_id"))).distinct()
    met = lines.join(asked, F.col("id") == F.col("_id")).select("id", F.col("h1").alias("w1"), F.col("h2").alias("w2"), F.col("first.own").alias("own"))
    wanted = scratch.written(met, "wanted")
    bits = scratch.written(bit_map(wanted, "w1"), "bits")
    sources = scratch.written(bit_map(wanted, "own"), "sources")
    # Only documents with the first occurrence of a line in question are cut into lines; equal lines are merged before they are exchanged.
    texts = _lines(docs.where(on_map(sources.scalar(), F.xxhash64(text))), key, text)
    found = texts.where(on_map(bits.scalar(), F.col("h1"))).groupBy("h1", "h2").agg(F.first("norm").alias("norm"))
    found = found.join(wanted, (F.col("h1") == F.col("w1")) & (F.col("h2") == F.col("w2"))).select("id", _words("norm").alias("words"))
    sets = scratch.written(found, "sets")

    def whole(s: str) -> DataFrame:
        return sets.select(F.col("id").alias(f"_id{s}"), F.col("words").alias(f"words{s}"))

    common = F.size(F.array_intersect("words_a", "words_b"))
    compared = (
        close.join(whole("_b"), F.col("b") == F.col("_id_b"))
        .select("a", "b", "words_b")
        .join(whole("_a"), F.col("a") == F.col("_id_a"))
        .where(common * den >= (F.size("words_a") + F.size("words_b") - common) * num)
    )
    matched = scratch.written(compared.select(F.col("b").alias("id")).distinct(), "matched")
    scratch.drop(close, wanted, bits, sources, sets)
    return matched


def removed_lines(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", num: int = 80, den: int = 100, bins: int = RARITY_BINS
) -> DataFrame:
    """``NAMES`` and lines: for each document with such lines the sorted numbers (from 0) of the lines to remove."""
    with Scratch(docs.sparkSession) as scratch:
        levels = scratch.written(_levels(docs, text, bins), "rarity")
        texts = _lines(docs, key, text)
        merged = scratch.written(_distinct(texts, levels, bins, num, den), "merged")
        lines = scratch.written(_numbered(merged), "lines")
        scratch.drop(merged, levels)
        collect_garbage(docs.sparkSession)

        def matched(pairs: DataFrame) -> DataFrame:
            return _matched(pairs, lines, docs, key, text, num, den, scratch)

        rounds, near, left = _rounds(lines.count()), [], lines
        for every in rounds[:-1]:
            # Whether they are similar is seen for all these rounds at once; what is in question misses the next round.
            if near:
                left = _without(lines, reduce(DataFrame.unionByName, [p.select(F.col("b").alias("id")) for p in near]), scratch)
            near.append(scratch.written(_nearest(_rest(lines, left, num, den, scratch, every)), "near"))
        gone = []
        if near:
            gone.append(matched(reduce(DataFrame.unionByName, near)))
            left = _without(lines, gone[0], scratch)
        collect_garbage(docs.sparkSession)
        pairs = scratch.written(_rest(lines, left, num, den, scratch), "pairs")
        found = matched(_nearest(pairs))
        collect_garbage(docs.sparkSession)
        others = pairs.join(found.select(F.col("id").alias("_gone")), F.col("b") == F.col("_gone"), "left_anti")
        gone = reduce(DataFrame.unionByName, [*gone, found, matched(others.select("a", "b"))])
        judged = (
            _touched(lines, gone, scratch)
            .select("id", "h1", "h2", "first", "times")
            .join(gone.select(F.col("id").alias("_gone")).distinct(), F.col("id") == F.col("_gone"), "left")
            .where((F.col("times") > 1) | F.col("_gone").isNotNull())
            .select(F.col("h1").alias("d1"), F.col("h2").alias("d2"), F.when(F.col("_gone").isNull(), F.col("first")).alias("stays"))
        )
        judged = scratch.written(judged, "judged")
        bits = scratch.written(bit_map(judged, "d1"), "bits")
        dropped = (
            texts.select("h1", "h2", *NAMES, "line")
            .where(on_map(bits.scalar(), F.col("h1")))
            .join(judged, (F.col("h1") == F.col("d1")) & (F.col("h2") == F.col("d2")))
            .where(~F.struct(*NAMES, "line").eqNullSafe(F.col("stays")))
        )
        return written(dropped.groupBy(*NAMES).agg(F.sort_array(F.collect_set("line")).alias("lines")), "removed")


def marked(docs: DataFrame, *, key: str = "doc_id", text: str = "text", out: str = "removed_lines", **options: int) -> DataFrame:
    """``docs`` with ``out``: the numbers of the lines to remove, null if none.  A column of that name is replaced."""
    docs = docs.drop(out)
    gone = removed_lines(docs.select(key, text), key=key, text=text, **options)
    return with_removed(docs, gone, names(key, text), out)


def with_removed(docs: DataFrame, gone: DataFrame, named: tuple[Column, Column, Column], out: str) -> DataFrame:
    """``docs`` with the lines of ``gone`` in ``out``; ``named`` are the documents' ``NAMES``."""
    own = [fresh(docs, f"_{n}") for n in NAMES]
    found = gone.select(*(F.col(n).alias(f"{o}_g") for n, o in zip(NAMES, own)), F.col("lines").alias(out))
    # Keys can be null.
    same = F.lit(True)
    for o in own:
        same = same & F.col(o).eqNullSafe(F.col(f"{o}_g"))
    return docs.withColumns(dict(zip(own, named))).join(found, same, "left").drop(*own, *(f"{o}_g" for o in own))


def without_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """``docs`` without the repeated lines in their texts, all columns kept.  A document of which nothing with
    a word remains is dropped: all of it is in earlier documents."""
    out = fresh(docs, "_removed")
    found = marked(docs, key=key, text=text, out=out, **options)
    kept = F.concat_ws("\n", F.filter(F.split(F.col(text), "\n"), lambda x, i: ~F.array_contains(F.col(out), i)))
    changed = F.when(F.col(out).isNull(), F.col(text)).otherwise(kept)
    return found.withColumn(text, changed).where(F.col(out).isNull() | F.col(text).rlike(_WORD)).select(*docs.columns)
