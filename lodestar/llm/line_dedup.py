"""Removing lines that match an earlier line: an exact set-similarity join, in DataFrame functions alone.

A line's tokens are its distinct words, hashed and ordered by rarity. Two lines match if the Jaccard similarity of their
tokens reaches the threshold; then both have one of their first few tokens in common (prefix filter), neither is too small
for the other (length filter), and enough is left of each from there on (positional filter). The shorter line of a pair
needs a shorter prefix than the longer one, so each line has entries of both roles, by token and class of lengths: classes
are so wide that a line's shorter partners are of its own class or the one below. A mask of 128 bits, one of them set for
each word that is not among the most frequent, bounds what two lines can have in common (`at_most`). Pairs that pass are
verified on all their words. Tokens are taken in PARTS, one after the other, so that few entries are on disk at a time.

Lines with equal tokens are one node throughout, so copies cost nothing. A line goes if any earlier line matches it, so one
match is enough: tokens of many lines first offer each line the earliest lines of their lists, and lines that go by those
ask for no other match. What is left meets all earlier lines of its lists, first the one with most entries in common; only
lines that do not go by that one have their other pairs verified.

Any order that is the same for all lines gives right results; the better it follows rarity, the fewer pairs come up. It
comes from a table of 2^24 counters, of fixed size whatever the input, which all words are counted in by their hash. Words
that are alone in their counter are in no other line and are left out of the comparison.

Defined results: lines end at \\n; a line without a word matches nothing and stays; earlier is the smaller doc_id (null
first), then the smaller hash of the text, then the earlier line; a null or empty text has one line, without a word; of
rows alike in doc_id and text all but one lose all lines with words; an empty table gives an empty result; columns other
than doc_id and text are passed over. Tokens, texts and sets are told apart by 64-bit, 64-bit and 128-bit hashes.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lodestar.llm import store

BITS, PAGE = 24, 10  # of the counters' number; of the counters of a page
ALONE = 33  # the character of a count of one
MANY = 16  # twice the log2 of the occurrences from which on a token's earliest lines come first
FREQUENT = 12  # words of at least 1/64 of the most frequent counter's words (again twice the log2) are not in masks
HOT = 24  # and, again twice the log2, so much less frequent than the most frequent counter at most: such tokens' share of the entries does not grow with the input
RARE = 11  # levels over ALONE (twice the log2 of the occurrences) from which on a token's lines are told apart by class
PARTS = 4
SALTS = 8  # parts of such a token's list, each with its own earliest line; those of all parts are offered
FILTER = 18  # log2 of the 64-bit words of a filter
NULL_ID = -(1 << 63)
WHITE = r"[\x20\x09-\x0D]+"


def folded(text: Column) -> Column:
    """Equal for texts that are equal when A-Z are lower-cased, and only for these; null is empty. White space stays.

    Bytes of texts that are not ASCII alone are read as Latin-1, whose lower case takes nothing together: of UTF-8's bytes it
    changes A-Z and the first of two (0xC2 to 0xDE), to one that stands before two more or three more elsewhere."""
    text = F.coalesce(text, F.lit(""))
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.decode(text.cast("binary"), "ISO-8859-1")))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, line (folded)."""
    told = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), folded(F.col("text")).alias("text"))
    return told.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def split_words(line: Column) -> Column:
    """The words of a line and empty strings. Lines with no white space but blanks go the shorter way."""
    other = reduce(lambda x, y: x | y, (F.contains(line, F.lit(c)) for c in "\t\v\f\r"))
    return F.when(other, F.split(line, WHITE)).otherwise(F.split(line, " "))


def words(line: Column) -> Column:
    """Hashes of the distinct words."""
    return F.array_remove(F.array_distinct(F.transform(split_words(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def bucket(token: Column) -> Column:
    return F.shiftrightunsigned(token, 64 - BITS).cast("int")


def in_order(entries: Column, at: str, value, blank) -> Column:
    """entries (structs, sorted by the whole number `at`): the value of each, behind as many blanks as there are numbers missing before it."""
    before = lambda i: F.when(i > 0, F.element_at(entries, i)[at]).otherwise(-1)
    return F.transform(entries, lambda x, i: blank(x[at] - before(i) - 1, value(x)))


def worded(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, pos, words (hashes of the distinct words) of each line. Stored, as splitting is the dearest step: words are counted and ordered from here."""
    return store.table(lines(docs).select("doc_id", "text_hash", "pos", words(F.col("line")).alias("words")), "words")


def rarity_table(told: DataFrame) -> tuple[DataFrame, DataFrame]:
    """told: words, of each line. (One row: levels, a byte for each of all counters that says how many lines' words fall into it (twice the log2, after ALONE). One row: top, the highest level)."""
    counts = told.select(F.explode("words").alias("word")).groupBy(bucket(F.col("word")).alias("bucket")).count().where("count > 1")
    level = (F.least(F.lit(60), F.floor(F.log2("count") * 2)) + ALONE).cast("tinyint")
    entry = F.struct(F.col("bucket").bitwiseAND((1 << PAGE) - 1).alias("at"), level.alias("value"))
    alone = F.lit(ALONE).cast("tinyint")
    joined = lambda c, blank: F.flatten(in_order(F.col(c), "at", lambda x: x["value"], lambda n, v: F.concat(F.array_repeat(blank, n), F.array(v))))
    pages = counts.groupBy(F.shiftright("bucket", PAGE).alias("at")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    value = joined("entries", alone)
    pages = store.table(pages.select("at", value.alias("value")).select("at", F.concat("value", F.array_repeat(alone, (1 << PAGE) - F.size("value"))).alias("value")), "pages")
    whole = pages.agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("pages"))  # 2^14 pages at most
    blank = F.array_repeat(alone, 1 << PAGE)
    whole = whole.select(F.flatten(in_order(F.col("pages"), "at", lambda x: x["value"], lambda n, v: F.concat(F.flatten(F.array_repeat(blank, n)), v))).alias("levels"))
    levels = store.table(whole.select(F.concat("levels", F.array_repeat(alone, (1 << BITS) - F.size("levels"))).alias("levels")), "rarity")
    top = store.table(pages.agg(F.coalesce(F.max(F.array_max("value")), F.lit(ALONE)).cast("long").alias("top")), "top")
    store.release(pages)
    return levels, top


def by_rarity(words: Column, levels: Column) -> Column:
    """words (hashes) as numbers in the order of their rarity: the level in front, then the upper bits of the hash."""
    return F.sort_array(F.transform(words, lambda h: F.shiftleft(F.get(levels, bucket(h)).cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))


def level_of(token: Column) -> Column:
    return F.shiftrightunsigned(token, 56)


def least_overlap(n: Column, percent: int) -> Column:
    """How many of n tokens must be common with any line that matches."""
    return F.floor((n * percent + 99) / 100).cast("int")


def pair_overlap(n: Column, m: Column, percent: int) -> Column:
    """How many tokens two matching lines of n and m have in common."""
    return F.floor(((n + m) * percent + 99 + percent) / (100 + percent)).cast("int")


def mask(tokens: Column) -> Column:
    """64 bits, of which each token sets one."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda m, t: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), t.bitwiseAND(63).cast("int"))))


def before_levels(tokens: Column, *levels: Column) -> Column:
    """How many tokens stand before each of these levels, each higher than the one before; tokens are sorted."""
    marks = [F.shiftleft(level.cast("long"), 56) for level in levels]
    both = F.sort_array(F.concat(tokens, F.array(*marks)))
    return F.array(*(F.array_position(both, m).cast("int") - 1 - i for i, m in enumerate(marks)))


def at_most(a: str, b: str) -> Column:
    """How many of a's tokens b may have too: for each bit that only a's mask has, at least one token is not in b."""
    alone = lambda m: F.bit_count(F.col(f"{a}.{m}").bitwiseAND(F.bitwise_not(F.col(f"{b}.{m}"))))
    return F.col(f"{a}.n") - alone("mask0") - alone("mask1")


def size_class(n: Column, percent: int) -> Column:
    """Of two matching lines, the longer one's class is that of the shorter one or the next."""
    return n if percent >= 100 else F.floor(F.ln(n) / math.log(100 / percent) + 1e-9).cast("int")


def key_of(size: Column) -> Column:
    """The token and, unless it is rare, the class of lengths."""
    rare = level_of(F.col("token")) < ALONE + RARE
    return F.when(rare, F.col("token")).otherwise(F.col("token").bitwiseXOR(F.shiftleft(size.cast("long"), 40)))


def bounded(nodes: DataFrame, percent: int) -> DataFrame:
    """nodes (k1, n, mask0, mask1, at, prefix) with doc, class, held (tokens of the line from the prefix's first one on), and how long the prefix is for partners that are not shorter (limit) and for those that are not longer, by class (limit0, limit1). Stored, so that the code of entries is short enough to be compiled."""
    n, held, limits = F.col("n"), least_overlap(F.col("n"), percent) - 1 + F.size("prefix"), []
    within = lambda least: F.greatest(held - least + 1, F.lit(0)).cast("int")
    for below in (0, 1):
        shortest, low, high = least_overlap(n, percent), n - below, n - below
        if percent < 100:  # a little wide, as the bounds of classes are rounded
            bound = lambda c: F.exp((size_class(n, percent) - below + c) * math.log(100 / percent))  # noqa: E731, B023
            low, high = F.ceil(bound(0) * (1 - 1e-8)).cast("int"), bound(1) * (1 + 1e-8)
        limits.append(F.when(high >= shortest, within(pair_overlap(F.greatest(shortest, low), n, percent))).otherwise(0).alias(f"limit{below}"))
    doc = F.coalesce("at.doc_id", F.lit(NULL_ID)).alias("doc")
    return nodes.select("*", doc, size_class(n, percent).alias("class"), held.alias("held"), within(pair_overlap(n, n, percent)).alias("limit"), *limits)


def prefixes(nodes: DataFrame, percent: int, limit: Column, *more: str) -> DataFrame:
    """i, token of each of the first `limit` tokens of a prefix, with the node's columns."""
    nodes = nodes if "limit" in nodes.columns else bounded(nodes, percent)
    each = nodes.select(F.col("k1").alias("k"), "n", "mask0", "mask1", "doc", *more, "class", "held", "limit0", "limit1", F.slice("prefix", F.lit(1), limit).alias("prefix"))
    return each.select(*[c for c in each.columns if c != "prefix"], F.posexplode("prefix").alias("i", "token"))


def shorter_entries(nodes: DataFrame, percent: int, *more: str) -> DataFrame:
    """key, token, k, n, mask0, mask1, doc, more, ahead (tokens of the line from this one on): entries for partners that are not shorter."""
    each = prefixes(nodes, percent, F.col("limit"), *more)
    return each.select(key_of(F.col("class")).alias("key"), "token", "k", "n", "mask0", "mask1", "doc", *more, (F.col("held") - F.col("i")).alias("ahead"))


def longer_entries(nodes: DataFrame, percent: int, *more: str) -> DataFrame:
    """The same for partners that are not longer, under each class that has such; rare tokens have one entry for all."""
    each = prefixes(nodes, percent, F.greatest("limit0", "limit1"), *more)
    fits = lambda below: F.col("i") < F.col(f"limit{below}")
    one = lambda *below: F.array(*(F.lit(b) for b in below))
    belows = F.when((level_of(F.col("token")) < ALONE + RARE) | ~fits(1), one(0)).when(fits(0), one(0, 1)).otherwise(one(1))
    each = each.select("*", F.explode(belows).alias("below"))
    return each.select(key_of(F.col("class") - F.col("below")).alias("key"), "token", "k", "n", "mask0", "mask1", "doc", *more, (F.col("held") - F.col("i")).alias("ahead"))


def reaches(percent: int, a: str, b: str) -> Column:
    """Whether a and b can match if this token is the first that they have in common: what is ahead, and what their masks allow, reaches the overlap that their lengths ask for."""
    c = lambda x, name: F.col(f"{x}.{name}")
    asked = (c(a, "n") + c(b, "n")).cast("long") * percent
    enough = lambda x, y: F.least(x, y).cast("long") * (100 + percent) >= asked
    ahead = enough(c(a, "ahead"), c(b, "ahead"))
    return ahead & enough(at_most(a, b), at_most(b, a))


def first_offers(nodes: DataFrame, percent: int, least: Column | None = None) -> DataFrame:
    """(a, b): for lines b with frequent tokens (of level `least` or more), the one with most in common of the earliest lines a in all parts of those tokens' lists."""
    frequent = level_of(F.col("token")) >= (F.lit(ALONE + MANY) if least is None else least)
    hot = shorter_entries(nodes, percent).where(frequent).drop("token")
    leaders = hot.groupBy("key", F.pmod("k", F.lit(SALTS).cast("long"))).agg(F.min(F.struct("doc", "k", "n", "mask0", "mask1", "ahead")).alias("first")).select("key", "first.*")
    near = 100 * F.least("a.n", "b.n").cast("long") >= percent * F.greatest("a.n", "b.n").cast("long")
    met = hot.alias("b").join(leaders.alias("a"), (F.col("a.key") == F.col("b.key")) & (F.col("a.k") != F.col("b.k")) & near & reaches(percent, "a", "b"))
    met = met.groupBy(F.col("a.k").alias("a"), F.col("b.k").alias("b")).count()
    return met.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")).select("a", "b")


def all_offers(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, same, count of common entries): all lines a and b that can match, but those whose later line does not ask (nodes: asks). a is the earlier one unless both have the same doc_id (same)."""
    parts = []
    for part in range(PARTS):
        # the number is in an array as generated code then is the same for all parts, and compiled once
        of = lambda entries: entries.where(F.array_contains(F.array(F.lit(part).cast("long")), F.pmod("token", F.lit(PARTS)))).drop("token")  # noqa: E731, B023
        a, b = of(shorter_entries(nodes, percent, "asks")).alias("a"), of(longer_entries(nodes, percent, "asks")).alias("b")
        c = F.col
        lengths = (100 * c("a.n").cast("long") >= percent * c("b.n").cast("long")) & ((c("a.n") < c("b.n")) | (c("a.n") == c("b.n")) & (c("a.k") < c("b.k")))
        asks = (c("b.asks") & (c("a.doc") <= c("b.doc"))) | (c("a.asks") & (c("b.doc") <= c("a.doc")))
        # neither side is sorted: the entries of the shorter lines, the fewer ones, are hashed
        met = a.hint("shuffle_hash").join(b, (c("a.key") == c("b.key")) & lengths & reaches(percent, "a", "b") & asks)
        turn = lambda x, y: F.when(c("a.doc") <= c("b.doc"), c(x)).otherwise(c(y))  # noqa: E731, B023
        pairs = met.select(turn("a.k", "b.k").alias("a"), turn("b.k", "a.k").alias("b"), (c("a.doc") == c("b.doc")).alias("same")).groupBy("a", "b", "same").count()
        parts.append(store.table(pairs, "part"))
        store.sweep(nodes.sparkSession)
    whole = store.table(reduce(DataFrame.unionByName, parts).groupBy("a", "b", "same").agg(F.sum("count").alias("count")), "offers")
    store.release(*parts)
    return whole


def bit_of(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, FILTER).bitwiseAND(63).cast("int"))


def hash_filter(keys: DataFrame, h: Column) -> DataFrame:
    """One row: filter, 2^24 bits (of fixed size; it lets more through the more keys there are), set where h of a key points to."""
    found = keys.groupBy(h.bitwiseAND((1 << FILTER) - 1).cast("int").alias("at")).agg(F.bit_or(bit_of(h)).alias("value"))
    zero = F.lit(0).cast("long")
    found = found.agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("entries"))
    return found.select(F.flatten(in_order(F.col("entries"), "at", lambda x: x["value"], lambda n, v: F.concat(F.array_repeat(zero, n), F.array(v)))).alias("filter"))


def passes(bits: Column, h: Column) -> Column:
    word = F.get(bits, h.bitwiseAND((1 << FILTER) - 1).cast("int"))
    return F.coalesce(word.bitwiseAND(bit_of(h)) != 0, F.lit(False))


def sets_of(pairs: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """k1, k2, at, tokens of the lines of pairs. The words are read where the lines were first found."""
    asked = pairs.select(F.col("a").alias("k1")).unionByName(pairs.select(F.col("b").alias("k1"))).distinct()
    place = lambda doc: F.xxhash64(F.coalesce(doc, F.lit(NULL_ID)), "text_hash", "pos")
    asked = nodes.select("k1", "k2", "at").join(asked, "k1", "left_semi")
    asked = store.table(asked.select("k1", "k2", F.coalesce("at.doc_id", F.lit(NULL_ID)).alias("doc"), "at.text_hash", "at.pos"), "asked")
    text = lambda doc, told: F.xxhash64(F.coalesce(doc, F.lit(NULL_ID)), told)
    bits = store.table(hash_filter(asked, place(F.col("doc"))), "filter")
    of_texts = store.table(hash_filter(asked, text(F.col("doc"), F.col("text_hash"))), "filter")
    docs = docs.where(passes(of_texts.scalar(), text(F.col("doc_id").cast("long"), F.xxhash64("text"))))  # texts without an asked line are not split
    here = lines(docs).where(passes(bits.scalar(), place(F.col("doc_id")))).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("doc"), "text_hash", "pos", "line")
    sets = here.join(asked, ["doc", "text_hash", "pos"]).groupBy("k1", "k2", "doc", "text_hash", "pos").agg(F.first("line").alias("line"))
    sets = store.table(sets.select("k1", "k2", F.struct("doc", "text_hash", "pos").alias("at"), words(F.col("line")).alias("tokens")), "sets")
    store.release(asked, bits, of_texts)
    return sets


def in_turn(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs: a, b, same, count, of which those with the same doc_id get their order from the places of their lines: (a, b, count), a the earlier one."""
    at = lambda x: sets.select(F.col("k1").alias(x), F.col("at").alias(f"at_{x}"))
    turn = lambda x, y: F.when(F.col("at_a") <= F.col("at_b"), F.col(x)).otherwise(F.col(y))
    within = pairs.where("same").join(at("a"), "a").join(at("b"), "b").select(turn("a", "b").alias("a"), turn("b", "a").alias("b"), "count")
    return pairs.where("NOT same").select("a", "b", "count").unionByName(within)


def still_open(pairs: DataFrame, nodes: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose b is not known to go, and those of them that stand for several lines (equal in k1 only)."""
    several = nodes.groupBy("k1").count().where("count > 1").select("k1")
    gone = known.select("k1").distinct().join(several, "k1", "left_anti")
    return pairs.join(gone.select(F.col("k1").alias("b")), "b", "left_anti")


def matched(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(k1, k2) of the later lines of the pairs (a, b) that match."""
    side = lambda x: sets.select(F.col("k1").alias(x), F.col("k2").alias(f"k2_{x}"), F.col("at").alias(f"at_{x}"), F.col("tokens").alias(f"tokens_{x}"))
    both = pairs.select("a", "b").join(side("b"), "b")
    both = both.join(side("a"), "a")
    common = F.size(F.array_intersect("tokens_a", "tokens_b"))
    match = 100 * common >= percent * (F.size("tokens_a") + F.size("tokens_b") - common)
    later = lambda x, y: F.when(F.col("at_a") < F.col("at_b"), F.col(y)).otherwise(F.col(x))
    return store.table(both.where(match).select(later("a", "b").alias("k1"), later("k2_a", "k2_b").alias("k2")).distinct(), "matched")


def matches(docs: DataFrame, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id, text. (lines: doc_id, text_hash, pos, k1, k2 (null without words); nodes that some line goes for: k1, k2, at (the first line's place), gone (whether that goes too))."""
    split = worded(docs)
    levels, top = rarity_table(split)
    raw = split.withColumn("levels", levels.scalar()).withColumn("top", top.scalar())
    raw = raw.select("doc_id", "text_hash", "pos", "top", by_rarity(F.col("words"), F.col("levels")).alias("tokens")).withColumn("n", F.size("tokens"))
    key = lambda seed: F.when(F.col("n") > 0, F.xxhash64(F.lit(seed), "tokens"))
    # the masks take the tokens of the lower and of the upper half of the levels, but for the most frequent; alone tokens stand first and cannot be common
    below = F.greatest(F.col("top") - FREQUENT, F.lit(ALONE + 3).cast("long"))
    middle = F.floor((below + ALONE + 1) / 2).cast("long")
    raw = raw.select("*", before_levels(F.col("tokens"), F.lit(ALONE + 1), middle, below).alias("to"))
    upto = lambda i, j: F.slice("tokens", F.get("to", i) + 1, F.get("to", j) - F.get("to", i))
    lower = F.slice("tokens", F.lit(1), F.get("to", F.lit(1)))
    prefix = F.slice("tokens", F.get("to", F.lit(0)) + 1, F.greatest(F.col("n") - least_overlap(F.col("n"), percent) + 1 - F.get("to", F.lit(0)), F.lit(0)))
    raw = store.table(raw.select("doc_id", "text_hash", "pos", key(0).alias("k1"), key(1).alias("k2"), "n", mask(lower).alias("mask0"), mask(upto(F.lit(1), F.lit(2))).alias("mask1"), prefix.alias("prefix")), "raw")
    least = top.scalar() - HOT
    store.release(split, levels)
    told = store.table(raw.select("doc_id", "text_hash", "pos", "k1", "k2"), "lines")
    place = F.min(F.struct("doc_id", "text_hash", "pos")).alias("at")
    nodes = raw.where("n > 0").groupBy("k1", "k2").agg(place, F.count("*").alias("copies"), F.first("n").alias("n"), F.first("mask0").alias("mask0"), F.first("mask1").alias("mask1"), F.first("prefix").alias("prefix"))
    nodes = store.table(bounded(nodes, percent), "nodes")
    store.release(raw)
    offers = store.table(first_offers(nodes, percent, F.greatest(least, F.lit(ALONE + MANY).cast("long"))), "offers")
    store.release(top)
    sets = sets_of(offers, nodes, docs)
    settled = matched(offers, sets, percent)
    store.release(offers, sets)
    known = store.table(nodes.join(settled.withColumn("gone", F.lit(True)), ["k1", "k2"], "left").withColumn("asks", F.col("gone").isNull()).drop("gone"), "known")
    store.release(nodes)
    offers = all_offers(known, percent)
    sets = sets_of(offers, known, docs)
    unordered, offers = offers, store.table(in_turn(offers, sets), "offers")
    store.release(unordered)
    first = matched(offers.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")), sets, percent)
    rest = matched(still_open(offers, sets, first), sets, percent)
    store.release(offers, sets)
    gone = store.table(settled.unionByName(first).unionByName(rest).distinct().withColumn("gone", F.lit(True)), "gone")
    looked = known.select("k1", "k2", "at", "copies").join(gone, ["k1", "k2"], "left").where("gone OR copies > 1")
    looked = store.table(looked.select("k1", "k2", "at", F.coalesce("gone", F.lit(False)).alias("gone")), "looked")
    store.release(known, settled, first, rest, gone)
    return told, looked


def removed_lines(docs: DataFrame, percent: int = 75) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, copy (from 1, of rows alike), n_lines, n_removed, removed (line numbers from 0, in order)."""
    told, looked = matches(docs.select("doc_id", "text"), percent)
    each = told.join(looked, ["k1", "k2"], "left")
    first = F.col("at.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("at.text_hash") == F.col("text_hash")) & (F.col("at.pos") == F.col("pos"))
    goes = F.col("at").isNotNull() & (F.col("gone") | ~first)
    of = lambda which: F.sort_array(F.collect_set(F.when(which, F.col("pos"))))
    rows = each.groupBy("doc_id", "text_hash").agg(F.count_if(F.col("pos") == 0).alias("copies"), F.count("*").alias("all_lines"), of(goes).alias("first"), of(F.col("k1").isNotNull()).alias("worded"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).withColumn("removed", F.when(F.col("copy") == 1, F.col("first")).otherwise(F.col("worded")))
    return rows.select("doc_id", "text_hash", "copy", (F.col("all_lines") / F.col("copies")).cast("long").alias("n_lines"), F.size("removed").cast("long").alias("n_removed"), "removed")


def clean(docs: DataFrame, percent: int = 75) -> DataFrame:
    """docs, with all columns, whose texts have lost the lines that match an earlier one. Of rows alike in doc_id and text it is left open which keeps its lines."""
    from pyspark.sql import Window as W

    columns, row = docs.columns, store.free_name(docs, "_row")
    docs = store.numbered(docs, row)
    mine = docs.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    mine = mine.withColumn("copy", F.row_number().over(W.partitionBy("doc_id", "text_hash").orderBy("row")).cast("long"))
    gone = removed_lines(docs, percent).where("n_removed > 0").alias("g")
    on = F.col("g.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("g.text_hash") == F.col("m.text_hash")) & (F.col("g.copy") == F.col("m.copy"))
    lost = store.table(mine.alias("m").join(gone, on).select(F.col("m.row").alias("row"), F.col("g.removed").alias("removed")), "dropped")
    both = docs.alias("d").join(lost.alias("l"), F.col(f"d.{row}") == F.col("l.row"), "left")
    kept = F.array_join(F.filter(F.split("d.text", "\n"), lambda line, i: ~F.array_contains("l.removed", i)), "\n")
    text = F.when(F.col("l.row").isNull(), F.col("d.text")).otherwise(kept).alias("text")
    return both.select(*[text if c == "text" else F.col(f"d.`{c}`") for c in columns])


def op8(spark, sf_dir: str) -> DataFrame:
    return removed_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "copy")
