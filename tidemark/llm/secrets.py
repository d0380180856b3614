"""Secret scans with multipart credential linking.

Strong patterns (assignments, access identifiers, long hex strings) are always
reported. Weak candidates are not secrets by themselves: a bare 40-character
token with mixed classes, or an endpoint. Within a scope (a document), each
candidate gets an interval that reaches ``reach`` code points to either side,
and an interval join links it to the strong parts it meets: a bare token counts
only with an access identifier, an endpoint only with an access identifier and
a secret part (assignment, hex or a linked token). Linked candidates are
reported as kinds ``bare`` and ``endpoint``.

The join runs on sorted starts, one search for each candidate: no pairs are
made, and no shuffle is needed as a scope lies in one row.

Defined cases: a null or empty text has no spans; overlapping spans of
different kinds are all reported; repeated rows, and rows without an id, are each reported; an
empty table gives an empty result; other columns are ignored. A text of any length is
scanned whole: memory of a task is an Arrow batch of texts, or its longest text, and its spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spans
from .spans import Span

KINDS = ("assign", "access", "hex", "bare", "endpoint")
BARE = re.compile(r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])")
ENDPOINT = re.compile(r"https?://[A-Za-z0-9.-]{1,253}(?::[0-9]{1,5})?")


def _mixed(token: str) -> bool:
    return any(c.isdigit() for c in token) and any(c.isupper() for c in token) and any(c.islower() for c in token)


def _meets(span: Span, parts: list[Span], reach: int) -> bool:
    """Whether one of the parts (sorted by start, disjoint) lies within ``reach`` of the span."""
    k = bisect_left(parts, span[2] + reach + 1, key=lambda p: p[1])
    return k > 0 and parts[k - 1][2] >= span[1] - reach


def scan(text: str, reach: int = 400) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans, each sorted by start and then kind."""
    access = spans.accesses(text)
    assign, hexes = spans.assigns(text), spans.hexes(text)
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted([*assign, *access, *hexes], key=order)
    if not access:
        return base, base
    bare = [("bare", *m.span()) for m in BARE.finditer(text) if _mixed(m.group())]
    bare = [s for s in bare if _meets(s, access, reach)]
    ends = [("endpoint", *m.span()) for m in ENDPOINT.finditer(text)]
    ends = [s for s in ends if _meets(s, access, reach) and any(_meets(s, p, reach) for p in (assign, hexes, bare))]
    return base, sorted([*base, *bare, *ends], key=order)


def find_secrets(docs: DataFrame, reach: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans, found) for every row; ``found`` is an array of (kind, start, end)."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_linked long, base_sha256 string, spans string, found array<struct<kind: string, start: int, end: int>>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            rows = []
            for value in batch.column(1):
                base, every = scan(value.as_py() or "", reach)
                n = [sum(s[0] == k for s in base) for k in KINDS[:3]]
                rows.append((*n, len(every) - len(base), spans.digest(base), spans.joined(every), [dict(zip(("kind", "start", "end"), s)) for s in every]))
            columns = list(zip(*rows)) or [()] * 7
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), kind]
            names = ["doc_id", "n_assign", "n_access", "n_hex", "n_linked", "base_sha256", "spans", "found"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(task, schema)
