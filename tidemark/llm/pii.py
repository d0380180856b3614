"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities (e-mail addresses, IP addresses, payment
cards, telephone numbers). Then corpus statistics over whole texts of all
documents estimate how strongly a word that occurs with an entity reveals it.
With N documents,

    information(e) = log2(N / df(e))                                what there is to disclose
    p(e | t) = (df(e, t) + smoothing x df(e) / N) / (df(t) + smoothing)
    disclosure(t, e) = 1 + log2(p(e | t)) / information(e)          what the word discloses of it

where df counts the documents that have an entity, a word, or both, anywhere
outside entities. A disclosure of 1 means that the word alone tells the entity;
smoothing draws pairs of few documents towards independence. Words at
``remove`` or more are removed, at ``generalise`` or more replaced by their
shape, wherever they stand in a text that holds the entity; words at
``elsewhere`` or more are removed from all other texts too.

Texts are known by a hash; equal texts are scanned once and count as often as
they come. Entities that occur in the same texts have the same disclosures and
are counted as one class, so a list of thousands of addresses is one entity here.

Defined cases: a null or empty text has no spans; a row without an id, rows
that repeat an id and repeated texts get the spans of their text; overlapping
spans are reported as found, and sanitising replaces all that they cover by
what stands for the longest of them; a word or text of any length counts whole; an entity in every document has nothing to
disclose; an empty table gives an empty result; other columns of the input are
ignored or kept, see each function.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, spans
from .spans import Span

KINDS = ("email", "ip", "card", "phone", "removed", "general")
REMOVED, GENERAL = 4, 5
WORD = re.compile(r"[^\W\d_]{3,}")
#: Bits of the filters of words and pairs to look for; a fixed size, whatever the corpus.
FILTER_BITS = 1 << 24
#: Distinct words, or pairs, that a task gathers before it sends their counts.
GATHER = 200_000
#: Elements of a table that may be broadcast.
SMALL = 200_000


def base(text: str) -> list[Span]:
    """The entities of a text, by kind and then start."""
    return [*spans.emails(text), *spans.addresses(text), *spans.cards(text), *spans.phones(text)]


def _hash(text: str) -> int:
    """Spark's xxhash64 of a string."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return h - (1 << 64) if h >> 63 else h


def _canonical(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(c for c in value if c.isdigit())}"


def words_outside(text: str, found: list[Span]) -> dict[str, list[tuple[int, int]]]:
    """The lower-case words that touch no entity, with their places, by one sweep over both."""
    starts, ends, last = [], [], 0
    for a, b in sorted((a, b) for _, a, b in found):  # merged, so that starts and ends both ascend
        if starts and a < last:
            ends[-1] = last = max(last, b)
        else:
            starts.append(a)
            ends.append(last := b)
    out: dict[str, list[tuple[int, int]]] = {}
    for m in WORD.finditer(text):
        a, b = m.span()
        k = bisect_right(ends, a)
        if k == len(starts) or starts[k] >= b:
            out.setdefault(m.group().lower(), []).append((a, b))
    return out


def _first_pass(docs: DataFrame) -> DataFrame:
    """A row for each row: doc_id, key (of its text), counts, base spans, the entities (es), and the text where there are any."""
    names = ["doc_id", "key", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "es", "text"]
    schema = "doc_id long, key long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, es array<long>, text string"
    kinds = [*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            rows = []
            for value in batch.column(1):
                text = value.as_py() or ""
                found = base(text)
                n = Counter(k for k, _, _ in found)
                es = sorted({_hash(_canonical(k, text[a:b])) for k, a, b in found})
                rows.append((_hash(text), *(n[k] for k in KINDS[:4]), spans.digest(found), spans.joined(found), es, text if found else None))
            columns = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return common.scratch(docs.mapInArrow(task, schema), "entities")


def _private(entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct texts with entities, (key, n, text, cs), and the classes of entities, (c, df)."""
    texts = entities.where("text is not null").groupBy("key").agg(F.count("*").alias("n"), F.first("es").alias("es"), F.first("text").alias("text"))
    texts = common.scratch(texts, "private")
    each = texts.select("key", "n", F.explode("es").alias("e"))
    # entities with the same texts: two independent sums modulo 2 of the texts' hashes, and how many rows they are
    mark = each.groupBy("e").agg(F.bit_xor("key").alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.sum("n").alias("df"))
    mark = common.scratch(mark.select("e", F.xxhash64("x", "y", "df").alias("c"), "df"), "classes")
    classes = mark.select("c", "df").distinct()
    of_text = each.join(mark, "e").groupBy("key").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    return common.scratch(texts.drop("es").join(of_text, "key"), "private-classes"), classes


def _bitmap(df: DataFrame, *keys: str) -> np.ndarray:
    """A bit for each value of (the hash of) the keys; what is not in it is not in ``df``."""
    h = F.col(keys[0]) if len(keys) == 1 else F.xxhash64(*keys)
    spot = F.pmod(h, F.lit(FILTER_BITS))
    found = df.select(F.shiftrightunsigned(spot, 5).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(F.lit(31)).cast("int")).alias("bit"))
    found = found.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[found.column("w").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    return out


def _in(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h % FILTER_BITS
    return (bitmap[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1


def _pairs(private: DataFrame) -> DataFrame:
    """(c, t, df_ct): documents with both a class of entities and a word."""

    def counts(n: Counter) -> pa.RecordBatch:
        c, t = (pa.array([k[i] for k in n], pa.int64()) for i in (0, 1))
        return pa.RecordBatch.from_arrays([c, t, pa.array(n.values(), pa.int64())], names=["c", "t", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for text, times, cs in zip(*(batch.column(c) for c in ("text", "n", "cs"))):
                text, times = text.as_py(), times.as_py()
                ts = [_hash(w) for w in words_outside(text, base(text))]
                for c in cs.as_py():
                    for t in ts:
                        n[c, t] += times
                    if len(n) > GATHER:
                        yield counts(n)
                        n.clear()
        yield counts(n)

    made = private.select("text", "n", "cs").mapInArrow(task, "c long, t long, n long")
    return common.scratch(made.groupBy("c", "t").agg(F.sum("n").alias("df_ct")), "pairs")


def _word_counts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, df): documents that contain each wanted word, counted over whole texts.

    A bitmap of fixed size, set where a wanted word hashes to, lets tasks
    skip most other words; the exact join comes after.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted, "t"))

    def counts(n: Counter) -> pa.RecordBatch:
        t = np.fromiter(map(_hash, n), np.int64, len(n))
        keep = _in(shared.value, t)
        return pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(np.fromiter(n.values(), np.int64, len(n))[keep])], names=["t", "n"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                n.update(set(WORD.findall((value.as_py() or "").lower())))
                if len(n) > GATHER:
                    yield counts(n)
                    n.clear()
        yield counts(n)

    made = docs.select("text").mapInArrow(task, "t long, n long").groupBy("t").agg(F.sum("n").alias("df"))
    return made.join(wanted, "t", "left_semi")


def disclosures(private: DataFrame, classes: DataFrame, docs: DataFrame, total: int, smoothing: float = 1.0) -> DataFrame:
    """(c, t, df_ct, df, disclosure) for every word that occurs with a class of entities."""
    pairs = _pairs(private)
    words = _word_counts(docs, pairs.select("t").distinct())
    both = pairs.join(words, "t").join(classes.withColumnRenamed("df", "df_c"), "c")
    information = F.log2(F.lit(float(total)) / F.col("df_c"))
    # a word may count less in lower-cased text than beside entities: some letters change their number of parts
    seen = F.greatest("df", "df_ct")
    given = (F.col("df_ct") + smoothing * F.col("df_c") / total) / (seen + smoothing)
    return both.select("c", "t", "df_ct", seen.alias("df"), F.when(information > 0, 1 + F.log2(given) / information).otherwise(0.0).alias("disclosure"))


PLACES = "key long, c long, t long, places array<struct<a: int, b: int>>"
PLACES_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _places_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    places = [[{"a": a, "b": b} for a, b in p] for p in columns[3]]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(places, PLACES_TYPE)], names=["key", "c", "t", "places"])


def _beside(private: DataFrame, risky: DataFrame) -> DataFrame:
    """(key, t, kind, places): the risky words of texts that hold the entity they disclose."""
    shared = private.sparkSession.sparkContext.broadcast(_bitmap(risky, "c", "t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, cs in zip(*(batch.column(c) for c in ("key", "text", "cs"))):
                text, cs = text.as_py(), np.array(cs.as_py(), np.int64)
                outside = words_outside(text, base(text))
                t = np.fromiter(map(_hash, outside), np.int64, len(outside))
                places, rows = list(outside.values()), []
                for c in cs:
                    for k in np.flatnonzero(_in(shared.value, common.hash_pairs(np.full(len(t), c), t))).tolist():
                        rows.append((key.as_py(), int(c), int(t[k]), places[k]))
                yield _places_of(rows)

    made = private.mapInArrow(task, PLACES).join(risky.select("c", "t", "kind"), ["c", "t"])
    return made.groupBy("key", "t").agg(F.min("kind").alias("kind"), F.first("places").alias("places"))


def _elsewhere(docs: DataFrame, strong: DataFrame) -> DataFrame:
    """(key, t, kind, places): the places of ``strong`` words in all texts."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(strong, "t"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int | None] = {}
        for batch in batches:
            rows = []
            for value in batch.column(0):
                text = value.as_py() or ""
                some = set(WORD.findall(text.lower()))
                if len(known) > GATHER:
                    known.clear()
                new = [w for w in some if w not in known]
                if new:
                    t = np.fromiter(map(_hash, new), np.int64, len(new))
                    known.update((w, h if hit else None) for w, h, hit in zip(new, t.tolist(), _in(shared.value, t).tolist()))
                if any(known[w] is not None for w in some):
                    outside = words_outside(text, base(text))
                    rows += [(_hash(text), 0, h, p) for w, p in outside.items() if (h := known.get(w)) is not None]
            yield _places_of(rows)

    made = docs.select("text").mapInArrow(task, PLACES).join(strong.select("t"), "t")
    return made.groupBy("key", "t").agg(F.lit(REMOVED).alias("kind"), F.first("places").alias("places"))


def _if_small(df: DataFrame, elements: Column) -> DataFrame:
    """``df`` marked for broadcast where its arrays have at most ``SMALL`` elements in all."""
    return F.broadcast(df) if (df.agg(F.sum(elements)).first()[0] or 0) <= SMALL else df


def _added(docs: DataFrame, entities: DataFrame, smoothing: float, remove: float, generalise: float, elsewhere: float) -> DataFrame:
    """(key, added): the places of revealing words in each text that has any, as an array of (kind, a, b)."""
    private, classes = _private(entities)
    risky = disclosures(private, classes, docs, entities.count(), smoothing).where(F.col("disclosure") >= min(generalise, elsewhere))
    risky = common.scratch(risky.withColumn("kind", F.when(F.col("disclosure") >= remove, REMOVED).otherwise(GENERAL)), "disclosures")
    found = _beside(private, risky.where(F.col("disclosure") >= generalise))
    strong = risky.where((F.col("disclosure") >= elsewhere) & (F.col("df") > F.col("df_ct"))).select("t").distinct()
    if strong.limit(1).count():
        found = found.unionByName(_elsewhere(docs, strong)).groupBy("key", "t").agg(F.min("kind").alias("kind"), F.first("places").alias("places"))
    each = found.select("key", F.explode("places").alias("p"), "kind").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "p.a", "p.b"))).alias("added"))
    return common.scratch(each, "added")


def find_personal_data(docs: DataFrame, smoothing: float = 1.0, remove: float = 0.9, generalise: float = 0.85, elsewhere: float = 0.95, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every input row: doc_id, key (a hash of its text), counts by kind, base_sha256, spans (base and added) and added (array of (kind, a, b), kind 4 removed, 5 generalised)."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    entities = _first_pass(docs)
    added = _added(docs, entities, smoothing, remove, generalise, elsewhere)
    name = F.array(*map(F.lit, KINDS))
    more = F.array_join(F.transform("added", lambda x: F.concat_ws(":", F.get(name, x["kind"]), x["a"], x["b"])), ",")
    out = entities.drop("es", "text").join(_if_small(added, F.size("added")), "key", "left")
    return out.withColumn("spans", F.concat_ws(",", F.nullif("spans", F.lit("")), more))


def _shape(word: str) -> str:
    return "X" + "x" * (len(word) - 1) if word[:1].isupper() else "x" * len(word)


def _merged(marks: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans in order, those that overlap as one with what stands for the longest of them."""
    out: list[list] = []  # start, end, length of the longest, what stands for it
    for a, b, put in sorted(marks):
        if not out or a >= out[-1][1]:
            out.append([a, b, b - a, put])
            continue
        if b - a > out[-1][2]:
            out[-1][2:] = b - a, put
        out[-1][1] = max(b, out[-1][1])
    return [(a, b, put) for a, b, _, put in out]


def sanitise(docs: DataFrame, smoothing: float = 1.0, remove: float = 0.9, generalise: float = 0.85, elsewhere: float = 0.95, text_col: str = "text") -> DataFrame:
    """``docs`` (a text and other columns, all kept) with entities and revealing words replaced in the text."""
    text = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    added = _added(text, _first_pass(text), smoothing, remove, generalise, elsewhere)
    rows = docs.select(F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("key"), F.struct("*").alias("row"))
    both = rows.join(_if_small(added, F.size("added")), "key", "left").select("row", "added")
    names, at = docs.columns, docs.columns.index(text_col)
    schema = docs.schema

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, fields = [], batch.column("row").flatten()
            for value, added in zip(fields[at], batch.column("added")):
                text = value.as_py()
                if text:
                    marks = [(a, b, f"[{k.upper()}]") for k, a, b in base(text)]
                    marks += [(x["a"], x["b"], "[TERM]" if x["kind"] == REMOVED else _shape(text[x["a"] : x["b"]])) for x in added.as_py() or ()]
                    if marks:
                        parts, free = [], 0
                        for a, b, put in _merged(marks):
                            parts += [text[free:a], put]
                            free = b
                        text = "".join([*parts, text[free:]])
                texts.append(text)
            columns = [pa.array(texts, x.type) if k == at else x for k, x in enumerate(fields)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return both.mapInArrow(task, schema)
