"""Secret scan: fixed key patterns and sliding-window entropy.

Method. Candidate strings are maximal runs of key characters. For each character class a window of
WINDOW characters slides over the candidate's stretches of that class; adding one character and
dropping one changes the counts, and the sum of c * log2(c) that gives the window's Shannon entropy,
in constant time. Windows over the class's threshold merge into spans. An allow-list of patterns
suppresses entropy spans (placeholders, plain words, digits only), never the base patterns. It is held
against the =- or /-separated parts that a span touches, so a word in one part excuses no other part.

One mapInArrow over Spark's partitions on whole texts; nothing is shuffled.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.llm.common import slices, table, unused, without

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ with 24 characters or more
#: Kinds in the order that sorts equal starts.
BASE_KINDS = ("assign", "access", "hex")
#: Character classes of the entropy scan: kind, members, least entropy of a window in bits.
CLASSES = (
    ("entropy_hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("entropy_alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.9),
    ("entropy_base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"), 4.0),
)
KINDS = BASE_KINDS + tuple(c[0] for c in CLASSES)
WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW)
PART = re.compile(r"[^=/]+")
#: A text that matches one of these is no secret.
ALLOW = (
    r"[^0-9]*",  # no digit: words, paths, rulers
    r"[^A-Za-z]*",  # no letter: numbers, dates
    r"(?i).*(example|sample|placeholder|changeme|dummy|redacted|your[_-]).*",
    r"(?i)([0-9a-f]{8}-([0-9a-f]{4}-){3}[0-9a-f]{12})",  # UUIDs name things
)
SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def dense_stretches(text: str, members: frozenset, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged windows of `window` characters of the class whose entropy is at least `least`."""
    cost = [0.0] + [c * log2(c) for c in range(1, window + 1)]  # entropy = log2(window) - sum(cost) / window
    out: list[tuple[int, int]] = []
    counts: dict[str, int] = {}
    total, begin = 0.0, 0
    for i, char in enumerate(text):
        if char not in members:
            counts, total, begin = {}, 0.0, i + 1
            continue
        if i - begin >= window:
            gone = text[i - window]
            counts[gone] -= 1
            total += cost[counts[gone]] - cost[counts[gone] + 1]
        counts[char] = counts.get(char, 0) + 1
        total += cost[counts[char]] - cost[counts[char] - 1]
        if i - begin >= window - 1 and log2(window) - total / window >= least - 1e-9:
            a, b = i - window + 1, i + 1
            if out and a <= out[-1][1]:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
    return out


class Allowed:
    """Which spans of a run are no secret; each is looked up among the run's parts by bisection."""

    def __init__(self, run: str, allow: re.Pattern):
        self.run, self.allow = run, allow
        parts = [(*p.span(), bool(allow.fullmatch(p[0]))) for p in PART.finditer(run)]
        self.starts, self.stops = [p[0] for p in parts], [p[1] for p in parts]
        self.refused = list(accumulate((not ok for _, _, ok in parts), initial=0))

    def whole(self) -> bool:
        return not self.refused[-1] and bool(self.allow.fullmatch(self.run))

    def span(self, a: int, b: int) -> bool:
        """A span's one part or itself matches; over several parts, all of them and itself."""
        first, last = bisect_right(self.stops, a), bisect_left(self.starts, b)
        fine = self.refused[last] == self.refused[first]
        return (last - first == 1 and fine) or (bool(self.allow.fullmatch(self.run[a:b])) and (last - first < 2 or fine))


def secrets_of(text: str, allow: re.Pattern) -> list[tuple[str, int, int]]:
    """(kind, start, stop) of one text, by start, then kind as in KINDS."""
    found = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        run, at = m[0], m.start()
        allowed = Allowed(run, allow)
        if allowed.whole():
            continue
        for kind, members, least in CLASSES:
            for a, b in dense_stretches(run, members, least):
                if not allowed.span(a, b):
                    found.append((kind, at + a, at + b))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "spans", allow: tuple[str, ...] = ALLOW, keep: list[str] | None = None) -> DataFrame:
    """Add spans array<struct<kind, start, stop>> (code points, stop exclusive) of each whole text.

    Base kinds are assign, access and hex; entropy_* come from the sliding windows. Null and empty
    texts have no spans. All input rows and columns stay (one named like `out` gives way), or with
    `keep` only the columns named there. Repeated rows each have theirs; an empty table gives an
    empty table; texts of any length are read whole.
    """
    rows = without(docs, out)
    stay = [c for c in rows.columns if keep is None or c in keep]
    at, rows = len(stay), rows.select(*[F.col(f"`{c}`") for c in stay], F.col(f"`{text_col}`").cast("string").alias(*unused(rows, "input")))
    pattern = "|".join(f"(?:{a})" if not a.startswith("(?i)") else f"(?i:{a[4:]})" for a in allow) or r"(?!)"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = re.compile(pattern, re.S)
        for batch in slices(batches, at):
            spans = [[{"kind": k, "start": a, "stop": b} for k, a, b in secrets_of(t.as_py() or "", allowed)] for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(spans, kind)], names=[*stay, out])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:at], T.StructField(out, SPAN)]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
