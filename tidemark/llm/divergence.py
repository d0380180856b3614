"""Audit of how far the sources of a language diverge in their words.

A language keeps its terms of at least ``min_docs`` documents. A term of count c
in a group (a source of a language, or the language as a whole) has the
probability p = 1 + floor(10^9 (c + 2) / (N + 2 V)), with N the group's counts
and V the language's kept terms, and two probabilities diverge by
f = floor((p - q)^2 / (p + q)). All of it is whole-number arithmetic.

One shuffle by (language, term) gives each kept term one row with its posting list:
the groups that have it, with their counts. All else is made from these rows.

Pairs of sources: terms that neither has add V times one number. What a term
changes that only one of the two has depends on its count there alone, so the
group's histogram of counts is enough; the postings give, term by term, what
changes where both have it.

Leading terms: a group's terms of one count are a bucket, with the extreme
probabilities that its terms have in the language. The probability in the group is
the same for all of them, so the least in the language bounds f from above. Buckets
are taken best-first, by levels of their bounds and in rounds of growing numbers of
terms, and their terms evaluated; a group ends when the bounds of all buckets not taken are strictly
below the value of its k-th term.

Defined cases: null texts, languages and sources are empty ones; a group without terms
has counts of zero; a language without kept terms has V = 0, pairs of value 0
and no leading terms; rows that share an id, or have none, are documents of their own; an empty
table gives an empty result; other columns are ignored. A text of any length is
counted whole: memory of a task is a small multiple of ``SLICE_BYTES`` or
of its longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Each byte's letter: itself, lower-cased if A to Z, or 0 where it is no part of a term.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
UNIT = 1_000_000_000
SLICE_BYTES = 8 << 20
#: Terms that the first round of the search takes for each group beside the k wanted, and the factor of each later one.
FIRST_TERMS, GROWTH = 100, 100
#: Levels of bounds for each doubling.
LEVELS = 4
#: Pairs of postings that a task holds at once, and sums of pairs of groups it keeps.
PAIRS, SUMS = 1 << 20, 1 << 20
#: Groups, and buckets taken in a round, that are broadcast at most (narrow rows).
BROADCAST_ROWS = 100_000


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts in order, and the text that each is in."""
    letters = LETTERS[data]
    inside = letters > 0
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    edges = offsets[:-1][np.diff(offsets) > 0]
    opens[edges] = inside[edges]
    begins = np.flatnonzero(opens)
    place = np.append(np.cumsum(inside)[begins] - 1, inside.sum()) if len(begins) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, pa.py_buffer(place.astype(np.int64)), pa.py_buffer(letters[inside])])
    return words.dictionary_encode(), np.searchsorted(offsets, begins, "right") - 1


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each slice of texts: language, source, term, occurrences, documents."""
    for batch in common.slices(batches, "text", SLICE_BYTES):
        lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
        group, of_doc = np.unique(lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy(), return_inverse=True)
        words, doc = _words(*common.flat(batch.column("text")))
        n_terms, code = len(words.dictionary), words.indices.to_numpy().astype(np.int64)
        if not n_terms:
            continue
        key, n = np.unique(of_doc[doc] * n_terms + code, return_counts=True)
        pairs = np.unique(doc * n_terms + code)
        docs = np.unique(of_doc[pairs // n_terms] * n_terms + pairs % n_terms, return_counts=True)[1]  # of the same keys
        at = group[key // n_terms]
        names = lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary)))
        terms = words.dictionary.take(pa.array(key % n_terms)).cast(pa.large_string()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([*names, terms, pa.array(n), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])


def _share(count, total):
    """Probability of a count, natively. ``total`` is N + 2 V."""
    return (F.expr(f"(cast({count} + 2 as decimal(20,0)) * {UNIT}) div {total}") + 1).cast("long")


def _divergence(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def postings(docs: DataFrame, min_docs: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Kept terms: lang, term, total, and found, an array of (source, n)."""
    whole = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    counted = whole.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    each = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    listed = each.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("found"))
    return listed.where(F.col("docs") >= min_docs).select("lang", "term", "total", "found")


class Audit:
    """The tables of one audit, each written once: postings, histograms of counts, groups."""

    def __init__(self, docs: DataFrame, min_docs: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source"):
        self.postings = common.scratch(postings(docs, min_docs, text_col, lang_col, source_col).withColumn("number", F.monotonically_increasing_id()), "postings")
        self.entries = self.postings.select("lang", "term", "total", "number", F.inline("found"))
        counts = self.entries.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"), F.min("total").alias("least"), F.max("total").alias("most"))
        self.buckets = common.scratch(counts, "buckets")
        langs = self.postings.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("in_lang"))
        names = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).distinct()
        sums = self.buckets.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("terms")).alias("in_group"))
        groups = names.join(langs, "lang", "left").join(sums, ["lang", "source"], "left").fillna(0, ["kept", "in_lang", "in_group"])
        groups = groups.select("lang", "source", "kept", F.expr("in_group + 2 * kept").alias("group_total"), F.expr("in_lang + 2 * kept").alias("lang_total"))
        none = F.when(F.col("kept") > 0, _share("0", "nullif(group_total, 0)")).otherwise(1)
        self.groups = common.scratch(groups.withColumns({"g": F.monotonically_increasing_id(), "p0": none}), "groups")
        self.few_groups = self.groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS

    def _with_groups(self, df: DataFrame, keys: list[str], groups: DataFrame, how: str = "inner") -> DataFrame:
        """Joined with one row a group, or a fixed number of rows at most, which are broadcast if there are few groups."""
        return df.join(F.broadcast(groups) if self.few_groups else groups, keys, how)

    def pairs(self) -> DataFrame:
        """lang, source, item, value for every ordered pair of sources of a language."""
        one = self.groups.select("lang", F.col("g").alias("a"), F.col("p0").alias("p0_a"), "kept", "group_total")
        two = self.groups.select("lang", F.col("g").alias("b"), F.col("p0").alias("p0_b"))
        absent = self._with_groups(one, ["lang"], two).where("a < b").select("a", "b", (F.col("kept") * _divergence("p0_a", "p0_b")).alias("value"))
        shares = self._with_groups(self.buckets, ["lang", "source"], self.groups.select("lang", "source", F.col("g").alias("a"), F.col("p0").alias("p0_a"), "group_total"))
        shares = shares.select("lang", "a", "p0_a", "terms", _share("n", "group_total").alias("p"))
        single = self._with_groups(shares, ["lang"], two).where("a <> b")
        change = F.col("terms") * (_divergence("p", "p0_b") - _divergence("p0_a", "p0_b"))
        single = single.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), change.alias("value"))
        met = self._with_groups(self.entries, ["lang", "source"], self.groups.select("lang", "source", "g", "p0", "group_total"))
        met = met.select("number", "g", _share("n", "group_total").alias("p"), "p0")
        met = met if self.few_groups else met.repartition("number")  # a broadcast leaves a term's entries together
        both = met.sortWithinPartitions("number", "g").mapInArrow(_both, "a long, b long, value long")
        values = absent.unionByName(single).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
        either = values.unionByName(values.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
        first = self.groups.select(F.col("g").alias("a"), "lang", "source")
        second = self.groups.select(F.col("g").alias("b"), F.col("source").alias("item"))
        return self._with_groups(self._with_groups(either, ["a"], first), ["b"], second).select("lang", "source", "item", "value")

    def terms(self, k: int = 10) -> DataFrame:
        """lang, source, item, value, rank of the ``k`` leading terms of each group."""
        marked = self._with_groups(self.buckets, ["lang", "source"], self.groups.select("lang", "source", "group_total", "lang_total"))
        marked = marked.withColumns({"p": _share("n", "group_total"), "q": _share("least", "lang_total")}).where("p > q").withColumn("bound", _divergence("p", "q"))
        marked = common.scratch(marked.select("lang", "source", "n", "terms", "p", "lang_total", "bound", F.floor(LEVELS * F.log2(F.col("bound") + 1)).cast("int").alias("level")), "bounds")
        # the queue goes by levels of bounds, of which a group has few, however many counts its terms have
        levels = marked.groupBy("lang", "source", "level").agg(F.sum("terms").alias("terms"))
        above = F.sum("terms").over(Window.partitionBy("lang", "source").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1))
        levels = levels.select("lang", "source", "level", F.coalesce(above, F.lit(0)).alias("before"))
        queue = common.scratch(self._with_groups(marked.drop("terms"), ["lang", "source", "level"], levels), "queue")
        best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        spark, low, high = self.postings.sparkSession, 0, k + FIRST_TERMS
        top = spark.createDataFrame([], "lang string, source string, item string, value long, rank int")
        while True:
            kth = top.where(F.col("rank") == k).select("lang", "source", F.col("value").alias("kth"))
            unseen = queue.where(F.col("before") >= low)
            open_ = self._with_groups(unseen, ["lang", "source"], kth, "left").where("kth is null or bound >= kth").drop("kth")
            taken = common.scratch(open_.where(F.col("before") < high), "taken")
            if open_.isEmpty():
                return top
            if not taken.isEmpty():
                found = self.entries.join(common.with_broadcast_if_small(taken.drop("bound", "before"), BROADCAST_ROWS), ["lang", "source", "n"])
                found = found.withColumn("q", _share("total", "lang_total")).where("p > q")
                found = found.select("lang", "source", F.col("term").alias("item"), _divergence("p", "q").alias("value"))
                ranked = found.unionByName(top.drop("rank")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                top = common.scratch(ranked, "top")
            low, high = high, high * GROWTH


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What terms that two groups have add to the sums of those that only one has, by pair of groups. Rows come sorted by term and group."""
    held = np.zeros((3, 0), np.int64)
    rest = np.zeros((4, 0), np.int64)

    def summed(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
        order = np.lexsort((b, a))
        a, b, value = a[order], b[order], value[order]
        heads = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return np.stack([a[heads], b[heads], np.add.reduceat(value, heads)])

    def pairs_of(rows: np.ndarray) -> Iterator[np.ndarray]:
        number, g, p, p0 = rows
        later = np.searchsorted(number, number, "right") - 1 - np.arange(len(number))  # entries of the same term that follow
        part = np.cumsum(later) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(number)]
        for a, b in zip(cuts, cuts[1:]):
            i, j = np.repeat(np.arange(a, b), later[a:b]), common.ragged(np.arange(a, b) + 1, later[a:b])
            if len(i):
                value = _f(p[i], p[j]) - _f(p[i], p0[j]) - _f(p0[i], p[j]) + _f(p0[i], p0[j])
                used, small = np.unique(g, return_inverse=True)
                if len(used) ** 2 <= SUMS:
                    dense = np.zeros(len(used) ** 2, np.int64)
                    np.add.at(dense, small[i] * len(used) + small[j], value)
                    at = np.flatnonzero(dense)
                    yield np.stack([used[at // len(used)], used[at % len(used)], dense[at]])
                else:
                    yield summed(g[i], g[j], value)

    for batch in batches:
        rows = np.concatenate([rest, np.stack([batch.column(k).to_numpy() for k in range(4)])], axis=1)
        last = np.searchsorted(rows[0], rows[0][-1]) if rows.shape[1] else 0
        rest = rows[:, last:]  # its term may go on in the next batch
        for new in pairs_of(rows[:, :last]):
            held = summed(*np.concatenate([held, new], axis=1)) if new.size else held
            if held.shape[1] > SUMS:
                yield _sums(held)
                held = held[:, :0]
    for new in pairs_of(rest):
        held = np.concatenate([held, new], axis=1)
    if held.shape[1]:
        yield _sums(held)


def _sums(held: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b", "value"])


def audit(docs: DataFrame, min_docs: int = 10, k: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part (pair or term), item, value long, rank int."""
    tables = Audit(docs, min_docs, text_col, lang_col, source_col)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = tables.pairs().withColumn("rank", F.row_number().over(order))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pair.withColumn("part", F.lit("pair")).select(*columns).unionByName(tables.terms(k).withColumn("part", F.lit("term")).select(*columns))
