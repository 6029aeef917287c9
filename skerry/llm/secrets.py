"""Secret scans by one combined deterministic automaton (see ``automaton``)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Scanner
from .common import text_bytes

#: kind: (pattern, least characters of the match).
#: Fixed values; the first three are the base kinds in their listed order.
RULES: dict[str, tuple[str, int]] = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=\-]+""", 0),
    "access": (r"AKIA[A-Z0-9]+", 16),
    "hex": (r"[0-9a-f]{32,}", 32),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 24),
    "slack": (r"xox[abprs]-[A-Za-z0-9\-]+", 15),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "google": (r"AIza[0-9A-Za-z_\-]+", 39),
    "payment": (r"[rs]k_(live|test)_[0-9A-Za-z]+", 24),
    "gitlab": (r"glpat-[0-9A-Za-z_\-]+", 26),
    "npm": (r"npm_[0-9A-Za-z]+", 40),
    "web_token": (r"eyJ[0-9A-Za-z_\-]+\.eyJ[0-9A-Za-z_\-]+\.[0-9A-Za-z_\-]+", 0),
}
BASE = ("assign", "access", "hex")
LEAST_VALUE = 8
SPANS = "array<struct<kind:string,start:int,end:int>>"
_SCANNERS: dict[tuple, Scanner] = {}


def scanner(rules: dict[str, tuple[str, int]]) -> Scanner:
    """Compiled once in each process."""
    key = tuple((k, v[0]) for k, v in rules.items())
    if key not in _SCANNERS:
        _SCANNERS[key] = Scanner({k: v[0] for k, v in rules.items()})
    return _SCANNERS[key]


def value_length(match: bytes) -> int:
    """Characters of the value of an assignment, that is behind separator, blanks and quote."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    while match[at : at + 1] == b" ":
        at += 1
    return len(match) - at - (match[at : at + 1] in (b'"', b"'"))


def find(data: bytes, rules: dict[str, tuple[str, int]] = RULES) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, ordered by start, then kind as listed."""
    hits = scanner(rules).scan(data)
    if not hits:
        return []
    names, out = list(rules), []
    wide = not data.isascii()
    for start, r, end in hits:
        kind = names[r]
        if end - start < rules[kind][1] or kind == "assign" and value_length(data[start:end]) < LEAST_VALUE:
            continue
        if wide:
            before = len(data[:start].decode("utf-8", "replace"))
            out.append((kind, before, before + end - start))
        else:
            out.append((kind, start, end))
    return out


# A failing match ends where it ends: what lies in it is not looked at again, as with a plain pattern.


def _scan(rules: dict[str, tuple[str, int]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t, rules)] for t in text_bytes(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], ["doc_id", "spans"])


def scan_secrets(docs: DataFrame, rules: dict[str, tuple[str, int]] = RULES) -> DataFrame:
    """doc_id and spans (kind, start, end in code points, end exclusive) of every whole text.

    Spans are ordered by start, then kind as listed. Null and empty texts have no spans; repeated
    rows each give a row; other columns are ignored; nothing is shuffled.
    """
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(partial(_scan, dict(rules)), f"doc_id long, spans {SPANS}")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")


def report(spans: DataFrame) -> DataFrame:
    """Counts and digests of the result of ``scan_secrets``."""
    count = lambda kind: F.size(F.filter("spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x.kind.isin(*BASE))
    return spans.select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
