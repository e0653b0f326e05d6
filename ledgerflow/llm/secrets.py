"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class.

Candidate strings are runs of token characters. A window of fixed length slides over each
candidate; the counts of its characters change by one in and one out, so its entropy is
kept up to date from the terms of the two counts that change. Windows at or over the
threshold of their own character class are joined into spans. Windows that lie inside a
part of the candidate that allow-list entries match are suppressed, and no others.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerflow.llm.common import python_tasks
from ledgerflow.llm.text import pieces

#: The kinds of spans in their order, the base patterns and least lengths.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST = {"assign": 6, "access": 20}
#: An assignment needs one of these (in either case) to be tried at all.
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: A candidate is a run of these, at least a window long.
CANDIDATE = re.compile(r"[A-Za-z0-9+/=_-]{20,}")
WINDOW = 20
#: Least entropy of a window, in bits per character, by its character class.
THRESHOLDS = {"decimal": 2.7, "hex": 3.0, "letters": 3.7, "alphanumeric": 3.5, "base64": 3.7}
_WHOLE = r"(?![A-Za-z0-9])"
#: Parts of candidates in which nothing is reported (UUIDs, rulers, words of one case or with humps that are shorter
#: than a window, joined by separators with short numbers at most, digits that count up, and the surroundings of
#: well-known placeholders, up to a window with the whole word). A run of separators is tried at its start only, so
#: the time of an entry grows with the length of the text.
ALLOW = (
    rf"(?<![A-Za-z0-9])[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}{_WHOLE}",
    r"(.)\1{7,}",
    rf"(?<![-_/=+])[-_/=+]*(?<![A-Za-z0-9])(?:(?:(?=[A-Za-z]{{1,19}}{_WHOLE})(?:[A-Z]+|[A-Z]?[a-z]+(?:[A-Z][a-z]{{2,}})*)|[0-9]{{1,4}})"
    rf"{_WHOLE}[-_/=+]*)+",
    rf"(?<![A-Za-z0-9])0?(?:1234567890)+1?2?3?4?5?6?7?8?9?{_WHOLE}",
    r"[A-Za-z0-9]{0,13}(?i:example|placeholder|changeme|xxxxxx)[A-Za-z0-9]{0,13}",
)

_TERM = [0.0] + [n * math.log2(n) for n in range(1, 1025)]


def char_class(s: str) -> str:
    if s.isdigit():
        return "decimal"
    if not s.strip("0123456789abcdef") or not s.strip("0123456789ABCDEF"):
        return "hex"
    if s.isalpha():
        return "letters"
    return "alphanumeric" if s.isalnum() else "base64"


def window_entropies(s: str, window: int) -> Iterator[float]:
    """Shannon entropy in bits of each window, from counts changed by one character out and one in."""
    term = _TERM if window < len(_TERM) else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = 0.0  # sum of n * log2 n over the characters of the window
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += term[n + 1] - term[n]
        counts[c] = n + 1
        if i >= window:
            out = s[i - window]
            n = counts[out]
            total += term[n - 1] - term[n]
            counts[out] = n - 1
        if i >= window - 1:
            yield math.log2(window) - total / window


def entropy_spans(text: str, window: int = WINDOW, thresholds: dict[str, float] | None = None,
                  allow: tuple[re.Pattern, ...] | None = None) -> list[tuple[int, int]]:
    """Joined windows of high entropy in the candidates of a text, in code points."""
    thresholds = thresholds or THRESHOLDS
    allow = _allow(ALLOW) if allow is None else allow
    least = min(thresholds.values()) - 1e-9
    spans: list[tuple[int, int]] = []
    for m in CANDIDATE.finditer(text):
        s, at = m.group(), m.start()
        if len(s) < window:
            continue
        parts: list[tuple[int, int]] | None = None
        now = 0
        begin = end = -1
        for i, e in enumerate(window_entropies(s, window)):
            if e >= least and e >= thresholds[char_class(s[i:i + window])] - 1e-9:
                if parts is None:
                    parts = _allowed(s, allow)
                while now < len(parts) and parts[now][1] < i + window:
                    now += 1
                if now < len(parts) and parts[now][0] <= i:
                    continue
                if i > end:
                    if begin >= 0:
                        spans.append((at + begin, at + end))
                    begin = i
                end = i + window
        if begin >= 0:
            spans.append((at + begin, at + end))
    return spans


def _allowed(s: str, allow: tuple[re.Pattern, ...]) -> list[tuple[int, int]]:
    """Joined parts of a candidate that the allow-list matches."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(m.span() for p in allow for m in p.finditer(s) if m.group()):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _allow(entries: tuple[str, ...]) -> tuple[re.Pattern, ...]:
    return tuple(re.compile(e, re.DOTALL) for e in entries)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    out = []
    low = text.encode("utf-8", "replace").lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if b"akia" in low:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def all_spans(text: str | None, window: int = WINDOW, thresholds: dict[str, float] | None = None,
              allow: tuple[str, ...] = ALLOW) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, by start, then kind."""
    if not text:
        return []
    return sorted(base_spans(text) + [(s, 3, e) for s, e in entropy_spans(text, window, thresholds, _allow(allow))])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                 thresholds: dict[str, float] | None = None, allow: tuple[str, ...] = ALLOW) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy), one row per row.

    Spans are kind:start:end in code points, by start, then kind. Null and empty texts have none (the
    hash is that of the empty string). Texts of any length are read whole; rows that repeat are each
    scanned; null ids stay; an empty table gives no rows; other columns are not read."""
    python_tasks(docs.sparkSession)
    kinds = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()),
                       ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()),
                       ("n_entropy", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1):
            rows = []
            for text in part.column(1).to_pylist():
                found = all_spans(text, window, thresholds, allow)
                base = joined([x for x in found if x[1] < 3])
                *counts, entropy = (sum(k == n for _, k, _ in found) for n in range(4))
                rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), joined(found), entropy))
            yield pa.record_batch([part.column(0), *map(list, zip(*rows, strict=True))], schema=kinds)

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return plain.mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
                                  "n_entropy long")


def mask_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars",
                 mask: str = "[SECRET]", **options) -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mask`` (overlapping spans by one mask).

    All rows and columns stay; ``length_col``, where the table has it, gets the new length of texts that
    changed. Null texts stay null."""
    python_tasks(docs.sparkSession)
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    size = names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, at):
            texts = part.column(at).to_pylist()
            changed = False
            lengths = part.column(size).to_pylist() if size is not None else None
            for i, text in enumerate(texts):
                spans = all_spans(text, **options)
                if spans:
                    out, done = [], 0
                    for start, _, end in spans:
                        if start >= done:
                            out += [text[done:start], mask]
                        done = max(done, end)
                    texts[i] = "".join([*out, text[done:]])
                    changed = True
                    if lengths is not None:
                        lengths[i] = len(texts[i])
            if changed:
                columns = list(part.columns)
                columns[at] = pa.array(texts, part.schema.field(at).type)
                if lengths is not None:
                    columns[size] = pa.array(lengths, part.schema.field(size).type)
                part = pa.record_batch(columns, schema=part.schema)
            yield part

    return plain.mapInArrow(run, plain.schema).toDF(*names)
