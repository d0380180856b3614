"""Language identification by interpolated Kneser-Ney character models.

One model for each language predicts every letter of a word (and its end) from
the four before. Counts of 5-grams cover all training rows; the lower orders
use continuation counts, so all tables come from one grouped count by Spark
aggregations. An n-gram is keyed by its full code points, and every table
(n-grams, contexts, probabilities) is a Spark table: nothing is capped or
merged, and none of it passes through the driver as a whole.

The distinct 5-grams of the texts to be judged get their interpolated
probability under each language once, by joins from the lowest order up. Those
of the most frequent 5-grams (as many as fit ``HELD`` numbers) are broadcast as
arrays sorted by a 64-bit hash, which tasks search for each distinct word of a
slice; the 5-grams beyond them are looked up by a join and added.

A text gets the language of the lowest cross-entropy for each symbol. It is
rejected if that exceeds the middle of the calibration rows of this language by
``factor`` times their upper spread at the text's length. Calibration rows are
not training rows.

Defined cases: a text that is null or has no letter is ``und`` and rejected;
ties go to the language that sorts first; without training rows every text is
``und``; a language without calibration rows rejects nothing; a text or word of
any length counts whole; repeated rows count as often as they come; rows without
an id are held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

ORDER, CHAR_BITS = 5, 21
#: The boundary's code; characters have two more than their code point. 0 stands before an n-gram of a lower order.
EDGE, SYMBOLS = 1, 0x110000 + 2
MASK = (1 << CHAR_BITS) - 1
UNDETERMINED = "und"
#: n-grams that a task gathers before it sends their counts.
GATHER = 600_000
#: Numbers (a hash and a cost for each language) in the broadcast arrays of frequent 5-grams.
HELD = 1 << 20
#: Upper spread of the cross-entropy, as a share of its middle, that is always allowed for.
LEAST_SPREAD = 0.02
#: Calibration rows of a band of lengths from which it counts.
BAND = 20


def words_of(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Code of each word, the distinct words, and where each text's words begin (one more for the end). Words are lower-case runs of letters."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string())), r"\PL+", " ")
    split = pc.split_pattern(clean, " ")
    words = pc.dictionary_encode(split.values)
    return words.indices.to_numpy().astype(np.int64), words.dictionary.to_pylist(), split.offsets.to_numpy()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed ``ORDER``-grams of the words end to end (the first two codes and the last three), and how many each word has: one for each letter and one for the end; none for an empty word."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64) + 2
    count = np.where(n > 0, n + 1, 0)
    width = np.where(n > 0, count + ORDER - 1, 0)
    start = np.cumsum(width) - width
    flat = np.full(int(width.sum()), EDGE, np.int64)
    flat[common.ragged(start + ORDER - 1, n)] = codes
    at = common.ragged(start, count)
    high = flat[at] << CHAR_BITS | flat[at + 1]
    low = (flat[at + 2] << CHAR_BITS | flat[at + 3]) << CHAR_BITS | flat[at + 4]
    return high, low, count


@dataclass
class Model:
    """``orders[k]``: tables (high, low, lang, v) of discounted probabilities of (k+1)-grams, and of back-off weights of their contexts."""

    languages: list[str]
    orders: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    #: For each language: median cross-entropy and upper spread of calibration rows as (a, b), the spread of a text of n symbols being sqrt(a + b / n).
    middle: list[float] | None = None
    #: (high, low, cost): nats of each priced 5-gram under each language.
    costs: DataFrame | None = None
    #: The broadcast arrays of frequent 5-grams, and whether they hold all that are priced.
    frequent: object = None
    whole: bool = False
    spread: list[tuple[float, float]] | None = None


def _grams(docs: DataFrame) -> DataFrame:
    """(lang, high, low, n): 5-gram counts over (text, lang); rows without a language count under null."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            high, low, n = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((low, high))
            high, low, n = high[order], low[order], n[order]
            first = np.flatnonzero(np.concatenate([np.ones(min(len(high), 1), bool), (high[1:] != high[:-1]) | (low[1:] != low[:-1])]))
            return high[first], low[first], np.add.reduceat(n, first) if len(first) else n

        def rows(lang: str | None) -> pa.RecordBatch:
            high, low, n = merged(held.pop(lang))
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(high), pa.string()), pa.array(high), pa.array(low), pa.array(n)], names=["lang", "high", "low", "n"])

        for batch in common.slices(batches, "text", common.SLICE_BYTES // 2):
            langs = batch.column(1)
            for lang in pc.unique(langs).to_pylist():
                code, words, _ = words_of(batch.column(0).filter(pc.is_null(langs) if lang is None else pc.fill_null(pc.equal(langs, lang), False)))
                high, low, count = grams(words)
                held.setdefault(lang, []).append(merged([(high, low, np.repeat(np.bincount(code, minlength=len(words)), count))]))
                if sum(len(x[0]) for x in held[lang]) > GATHER // 2:
                    held[lang] = [merged(held[lang])]
                    if len(held[lang][0][0]) > GATHER // 4:
                        yield rows(lang)
        for lang in list(held):
            yield rows(lang)

    source = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null")
    return common.scratch(source.mapInArrow(task, "lang string, high long, low long, n long").groupBy("lang", "high", "low").agg(F.sum("n").alias("n")), "grams")


def _context(high: Column, low: Column) -> tuple[Column, Column]:
    """An n-gram without its last character."""
    down = F.shiftright(low, CHAR_BITS).bitwiseOR(F.shiftleft(high.bitwiseAND(F.lit(MASK)), 2 * CHAR_BITS))
    return F.shiftright(high, CHAR_BITS).alias("high"), down.alias("low")


def _suffix(k: int) -> tuple[Column, Column]:
    """The last ``k`` characters of an n-gram."""
    high = F.col("high").bitwiseAND(F.lit((1 << CHAR_BITS * max(k - 3, 0)) - 1))
    return high.alias("high"), F.col("low").bitwiseAND(F.lit((1 << CHAR_BITS * min(k, 3)) - 1)).alias("low")


def train(counts: DataFrame) -> Model:
    """Models from the counts of ``_grams``; those under null are not looked at."""
    g = counts.where("lang is not null")
    languages = [r.lang for r in g.select("lang").distinct().orderBy("lang").collect()]
    if not languages:
        return Model([])
    orders: list = [None] * ORDER
    for k in range(ORDER - 1, -1, -1):
        discount = g.groupBy("lang").agg(F.sum((F.col("n") == 1).cast("double")).alias("n1"), F.sum((F.col("n") == 2).cast("double")).alias("n2"))
        discount = discount.select("lang", F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0)))).alias("d"))
        discount = F.broadcast(discount)  # a row for each language
        high, low = _context(F.col("high"), F.col("low"))
        keyed = g.select("lang", high.alias("context_high"), low.alias("context_low"), "high", "low", "n")
        per = keyed.groupBy("lang", "context_high", "context_low").agg(F.sum("n").alias("total"), F.count("*").alias("types")).join(discount, "lang")
        per = common.scratch(per, "contexts")
        gram = keyed.join(per, ["lang", "context_high", "context_low"]).select("high", "low", "lang", ((F.col("n") - F.col("d")) / F.col("total")).alias("v"))
        back = per.select(F.col("context_high").alias("high"), F.col("context_low").alias("low"), "lang", (F.col("d") * F.col("types") / F.col("total")).alias("v"))
        orders[k] = gram, back
        if k:
            g = common.scratch(g.groupBy("lang", *_suffix(k)).agg(F.count("*").alias("n")), "grams")
    return Model(languages, orders)


def _by_language(table: DataFrame, languages: list[str], name: str) -> DataFrame:
    """A row for each n-gram, its values in an array by language."""
    found = table.groupBy("high", "low").agg(F.map_from_entries(F.collect_list(F.struct("lang", "v"))).alias("m"))
    return found.select("high", "low", F.array(*(F.try_element_at("m", F.lit(x)) for x in languages)).alias(name))


def gram_costs(needed_grams: DataFrame, model: Model) -> DataFrame:
    """(high, low, cost): nats of each distinct 5-gram under each language."""
    n = len(model.languages)
    needed = [needed_grams]
    for k in range(ORDER - 1, 0, -1):
        needed.insert(0, needed[0].select(*_suffix(k)).distinct())
    lower = None
    for k in range(ORDER):
        gram, back = model.orders[k]
        high, low = _context(F.col("high"), F.col("low"))
        own = needed[k].select("high", "low", high.alias("context_high"), low.alias("context_low"), *(x.alias(f"suffix_{x_name}") for x, x_name in zip(_suffix(k), ("high", "low"))))
        own = own.join(_by_language(gram, model.languages, "p"), ["high", "low"], "left")
        contexts = _by_language(back, model.languages, "b").withColumnsRenamed({"high": "context_high", "low": "context_low"})
        own = own.join(contexts, ["context_high", "context_low"], "left")
        below = F.array(*(F.lit(1.0 / SYMBOLS) for _ in range(n)))
        if lower is not None:
            own = own.join(lower.withColumnsRenamed({"high": "suffix_high", "low": "suffix_low", "q": "below"}), ["suffix_high", "suffix_low"])
            below = F.col("below")
        at = lambda c, i, otherwise: F.coalesce(F.get(c, F.lit(i)), F.lit(otherwise))
        q = [at("p", i, 0.0) + at("b", i, 1.0) * F.get(below, F.lit(i)) for i in range(n)]
        lower = own.select("high", "low", F.array(*q).alias("q"))
    return lower.select("high", "low", F.transform("q", lambda x: -F.log(x)).alias("cost"))


def price(model: Model, counts: DataFrame) -> Model:
    """``model`` with the costs of all 5-grams of ``counts``."""
    n = len(model.languages)
    often = common.scratch(counts.groupBy("high", "low").agg(F.sum("n").alias("n")), "needed-grams")
    model.costs = costs = common.scratch(gram_costs(often.select("high", "low"), model), "gram-costs")
    most = max(1, HELD // (n + 1))
    model.whole = often.count() <= most
    some = costs if model.whole else costs.join(often.orderBy(F.desc("n"), "high", "low").limit(most).select("high", "low"), ["high", "low"], "left_semi")
    some = some.select(F.xxhash64("high", "low").alias("h"), "cost").toArrow()  # at most HELD numbers
    keys = some.column("h").to_numpy()
    order = np.argsort(keys)
    values = some.column("cost").combine_chunks().flatten().to_numpy().reshape(len(keys), n)[order]
    model.frequent = counts.sparkSession.sparkContext.broadcast((keys[order], values))
    return model


def _scored(docs: DataFrame, model: Model, texts: bool = True) -> DataFrame:
    """(row, text, _symbols, _cost): the other columns of ``docs`` as a struct, its text column, its symbols, and its cross-entropy under each language, null without letters. The 5-grams of ``docs`` are priced; without ``texts`` the texts stay behind."""
    n, shared, costs = len(model.languages), model.frequent, model.costs
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"] or [F.lit(None).cast("int").alias("none")]
    rows = docs.select(F.struct(*others).alias("row"), "text", F.xxhash64("text").alias("_key"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, text string, _key long, _symbols long, _sum array<double>, _rest array<struct<high: long, low: long>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = shared.value
        for batch in common.slices(batches, "text", common.SLICE_BYTES // 4):
            code, words, offsets = words_of(batch.column("text"))
            high, low, count = grams(words)
            h = common.hash_pairs(high, low)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            known = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            sums = np.zeros((len(h) + 1, n))
            np.cumsum(np.where(known[:, None], values[at], 0.0) if len(keys) else sums[1:], axis=0, out=sums[1:])
            ends = np.cumsum(count)
            own = np.column_stack([sums[ends] - sums[ends - count], count])
            total = np.concatenate([np.zeros((1, n + 1)), np.cumsum(own[code], axis=0)])[offsets]
            total = total[1:] - total[:-1]
            other = np.flatnonzero(~known)
            per_word = np.diff(np.searchsorted(other, np.concatenate([[0], ends])))
            place = common.ragged((np.cumsum(per_word) - per_word)[code], per_word[code])
            cuts = np.concatenate([[0], np.cumsum(per_word[code])])[offsets].astype(np.int32)
            rest = pa.StructArray.from_arrays([pa.array(high[other][place]), pa.array(low[other][place])], names=["high", "low"])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(total) + 1, dtype=np.int32) * n), pa.array(total[:, :-1].ravel()))
            text = batch.column("text") if texts else pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, batch.column("_key"), pa.array(np.rint(total[:, -1]).astype(np.int64)), lists, pa.ListArray.from_arrays(pa.array(cuts), rest)], names=["row", "text", "_key", "_symbols", "_sum", "_rest"])

    made = rows.mapInArrow(task, schema)
    ratio = lambda sums: F.when(F.col("_symbols") > 0, F.transform(sums, lambda x: x / F.col("_symbols"))).alias("_cost")
    if model.whole:  # no 5-gram lies beyond the arrays
        return made.select("row", "text", "_symbols", ratio("_sum"))
    made = common.scratch(made, "scored")
    tail = made.where(F.size("_rest") > 0).groupBy("_key").agg(F.first("_rest").alias("rest")).select("_key", F.explode("rest").alias("r")).select("_key", "r.*")
    tail = tail.groupBy("_key", "high", "low").agg(F.count("*").alias("n")).join(costs, ["high", "low"])
    tail = tail.groupBy("_key").agg(F.array(*(F.sum(F.col("n") * F.get("cost", F.lit(i))) for i in range(n))).alias("more"))
    both = made.join(tail, "_key", "left").withColumn("_all", F.when(F.col("more").isNull(), F.col("_sum")).otherwise(F.zip_with("_sum", "more", lambda a, b: a + b)))
    return both.select("row", "text", "_symbols", ratio("_all"))


def calibrate(model: Model, docs: DataFrame) -> Model:
    """``model`` with the middle and the upper spread of the cross-entropy of the rows of ``docs`` (text, lang), whose 5-grams are priced, under their own language.

    The spread s(n) of texts of n symbols is s(n)^2 = a + b / n: texts differ by
    their matter (a) and by chance at their length (b). Both come from 99th
    percentiles above the middle: a from all rows, b from the band of lengths (between powers of two, of ``BAND`` rows or more) that
    needs the largest. So junk that is up to one row in a hundred does not widen
    them. A spread is at least ``LEAST_SPREAD`` of the middle.
    """
    at = F.array_position(F.array(*map(F.lit, model.languages)), F.col("row.lang")) - 1
    one = _scored(docs.select("text", F.col("lang").cast("string").alias("lang")), model, texts=False).where("_cost is not null")
    one = common.scratch(one.select("row.lang", F.col("_symbols").alias("n"), F.get("_cost", at.cast("int")).alias("x")).where("x is not null"), "calibration")
    middle = one.groupBy("lang").agg(F.percentile("x", F.lit(0.5), F.col("n")).alias("middle"))  # of symbols, so that long texts weigh as they are
    above = one.join(F.broadcast(middle), "lang").withColumn("over", F.col("x") - F.col("middle"))
    upper = F.percentile("over", F.lit(0.99)).alias("s")
    every = {r.lang: r for r in above.groupBy("lang").agg(upper, F.first("middle").alias("middle")).collect()}  # a row for each language
    bands = above.groupBy("lang", F.floor(F.log2("n")).alias("band")).agg(upper, F.avg(1 / F.col("n")).alias("inverse"), F.count("*").alias("rows"))
    bands = bands.where(F.col("rows") >= BAND).collect()  # a row for each language and power of two
    model.middle, model.spread = [float("inf")] * len(model.languages), [(1.0, 0.0)] * len(model.languages)
    for k, lang in enumerate(model.languages):
        if lang in every:
            r = every[lang]
            a = max(r.s, LEAST_SPREAD * r.middle) ** 2
            b = max([0.0, *((max(x.s, 0.0) ** 2 - a) / x.inverse for x in bands if x.lang == lang)])
            model.middle[k], model.spread[k] = r.middle, (a, b)
    return model


def priced_for(docs: DataFrame, model: Model) -> Model:
    """``model`` with the costs of those 5-grams of ``docs`` too that it has not priced; the broadcast arrays stay."""
    counts = _grams(docs.select("text", F.lit(None).cast("string").alias("lang")))
    if model.costs is None:
        return price(model, counts)
    missing = common.scratch(counts.select("high", "low").join(model.costs, ["high", "low"], "left_anti"), "missing-grams")
    if missing.isEmpty():
        return model
    return replace(model, costs=model.costs.unionByName(common.scratch(gram_costs(missing, model), "more-costs")), whole=False)


def predict(docs: DataFrame, model: Model, factor: float = 3.0, texts: bool = True, priced: bool = False) -> DataFrame:
    """(row, lang_pred, score, cross_entropy, excess, rejected): ``row`` is the row of ``docs`` (its text null without ``texts``), of which only the text is looked at; ``excess`` is the cross-entropy above the middle in spreads, and beyond ``factor`` a text is rejected.

    5-grams that the model has not priced yet are priced first; ``priced`` says that there are none, as after ``learn`` on the same texts.
    """
    n = len(model.languages)
    if n and not priced:
        model = priced_for(docs, model)
    if not n:
        none = F.lit(None).cast("double")
        return docs.select(F.struct("*").alias("row"), F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("cross_entropy"), none.alias("excess"), F.lit(True).alias("rejected"))
    scored = _scored(docs, model, texts)
    least = F.array_min("_cost")
    k = (F.array_position("_cost", least) - 1).cast("int")
    # the share of the best language if every language has a likelihood with the square root of the text's symbols
    odds = F.aggregate("_cost", F.lit(0.0), lambda a, c: a + F.exp((least - c) * F.sqrt("_symbols")))
    get = lambda values: F.get(F.array(*(F.lit(float(v)) for v in values)), k)
    middle, spread = model.middle or [float("inf")] * n, model.spread or [(1.0, 0.0)] * n
    width = F.sqrt(get([a for a, _ in spread]) + get([b for _, b in spread]) / F.col("_symbols"))
    excess = (least - get(middle)) / width
    none = F.col("_cost").isNull()
    row = F.struct(*(F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns))
    return scored.select(
        row.alias("row"),
        F.when(none, UNDETERMINED).otherwise(F.get(F.array(*map(F.lit, model.languages)), k)).alias("lang_pred"),
        F.when(none, 0.0).otherwise(1 / odds).alias("score"),
        least.alias("cross_entropy"),
        excess.alias("excess"),
        F.when(none, True).otherwise(excess > factor).alias("rejected"),
    )


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5; rows of fold 0 are held out, as are rows without an id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5, F.lit(0))


def learn(docs: DataFrame) -> Model:
    """Models of (text, lang, fold) that price all 5-grams of ``docs``: learnt from folds 2 to 4 and calibrated on fold 1; where folds 2 to 4 give no language, learnt from fold 1 and not calibrated."""
    counts = _grams(docs.select("text", F.when(F.col("fold") >= 2, F.col("lang")).alias("lang")))
    model = train(counts)
    if model.languages:
        return calibrate(price(model, counts), docs.where("fold = 1 and lang is not null"))
    counts = _grams(docs.select("text", F.when(F.col("fold") == 1, F.col("lang")).alias("lang")))
    model = train(counts)
    return price(model, counts) if model.languages else model


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, cross_entropy, excess, rejected) for every row."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), fold(id_col).alias("fold"))
    made = predict(plain.select("doc_id", "text", (F.col("fold") == 0).alias("held_out")), learn(plain), texts=False, priced=True)
    return made.select("row.doc_id", "row.held_out", "lang_pred", "score", "cross_entropy", "excess", "rejected")
