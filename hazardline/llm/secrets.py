"""Secret scans: fixed patterns, and random strings exposed by how badly a token vocabulary compresses them."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hazardline.llm.repeats import arrow_schema

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The patterns whose matches are always secrets, in the order of their names in a tie.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "random")

#: Strings worth a look: unbroken runs of the characters that keys are made of.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST = 16
_SEPARATORS = "+/_=-"
#: What stands between separators: a UUID, or letters and digits.
_PART = re.compile(r"(?<![A-Za-z0-9])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![A-Za-z0-9])|[A-Za-z0-9]+")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_WORD = "(?:[A-Z]*+[a-z]{2,}+|[A-Z]{2,}+|[0-9]++)"
_WORDY = re.compile(rf"{_WORD}(?:[_/+=-]*+{_WORD})*+")
_WORDS = re.compile(rf"{_WORD}(?:{_WORD})*+")
_encoders: dict = {}


def encoder(path: str):
    """Token counter for a rank file; kept by each worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=r"\s+|[^\s]+", mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _random(run: str, count: Callable[[str], int], ratio: float) -> bool:
    """Few characters per token, and neither a number, a digest nor an identifier."""
    if len(run) < LEAST or run.isdigit() or _UUID.fullmatch(run) or len(run) in (32, 40, 56, 64, 96, 128) and _DIGEST.fullmatch(run):
        return False
    if _WORDY.fullmatch(run) and sum(c.isdigit() for c in run) <= len(run) // 4:
        return False
    return len(run) <= ratio * count(run)


def _keys(run: str, count: Callable[[str], int], ratio: float) -> list[tuple[int, int]]:
    """(start, end) of what is random in a run: all of it, or neighbouring parts that are not words, or single parts.

    Words between separators would dilute a key beside them, so they end a group of parts, as UUIDs and digests do.
    """
    parts = [(m.start(), m.end()) for m in _PART.finditer(run)]
    known = [bool(_UUID.fullmatch(run, a, b) or b - a in (32, 40, 56, 64, 96, 128) and _DIGEST.fullmatch(run, a, b)) for a, b in parts]
    if not any(known) and _random(run, count, ratio):
        return [(0, len(run))]
    odd = [not (k or _WORDS.fullmatch(run, a, b)) for k, (a, b) in zip(known, parts, strict=True)]
    groups: list[list[tuple[int, int]]] = []
    for k, (a, b) in enumerate(parts):
        short = b - a <= 4 and 0 < k < len(parts) - 1 and odd[k - 1] and odd[k + 1]  # a few letters of a key between its separators
        if not (odd[k] or short):
            groups.append([])
        elif groups:
            groups[-1].append((a, b))
        else:
            groups.append([(a, b)])
    found = []
    for group in filter(None, groups):
        start, end = group[0][0], group[-1][1]
        if _random(run[start:end], count, ratio):
            found.append((start, end))
        else:
            found += [(a, b) for a, b in group if len(group) > 1 and _random(run[a:b], count, ratio)]
    return found


def random_spans(text: str, base: list[tuple[int, int, int]], count: Callable[[str], int], ratio: float) -> list[tuple[int, int, int]]:
    """Strings with few characters per token outside base spans, unless a number, a digest or an identifier."""
    found = []
    for m in _RUN.finditer(text):
        at, cuts = m.start(), [(a, b) for a, _, b in base if a < m.end() and m.start() < b]
        for a, b in [*cuts, (m.end(), m.end())]:
            piece = text[at:a] if at < a else ""
            if cuts:
                piece = piece.lstrip(_SEPARATORS)
            if len(piece) >= LEAST:
                found += [(a - len(piece) + x, 3, a - len(piece) + y) for x, y in _keys(piece, count, ratio)]
            at = max(at, b)
    return found


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def secret_scan(docs: DataFrame, vocabulary: str = VOCABULARY, ratio: float = 2.0, mask: str | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random[, masked]).

    ``assign``, ``access`` and ``hex`` are the leftmost matches of fixed patterns; ``random`` are unbroken strings of 16
    or more key characters outside the fixed patterns with at most ``ratio`` characters per token of the rank file
    ``vocabulary``, or their parts between separators; numbers, digests in hex, UUIDs and identifiers made of words and
    short numbers are not. ``spans`` lists
    kind:start:end in code points, end exclusive, by start and then kind; ``base_sha256`` hashes those of the fixed
    patterns. With ``mask``, ``masked`` is the text with each span (overlaps merged) replaced by it. A null text counts
    as empty and stays null when masked; ids may repeat; of other columns those named in ``carry`` come along after doc_id.
    """

    columns = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long" + (", masked string" if mask is not None else "")
    kept = ["doc_id", *carry]
    schema = T.StructType([docs.schema[c] for c in kept] + T.StructType.fromDDL(columns).fields)
    types = arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(vocabulary)
        for batch in batches:
            rows = []
            for given in batch.column("text").to_pylist():
                text = given or ""
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, lambda run: len(tokens.encode_ordinary(run)), ratio))
                kinds = [k for _, k, _ in every]
                row = [*(kinds.count(k) for k in range(3)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every), kinds.count(3)]
                rows.append([*row, masked(given, every, mask)] if mask is not None else row)
            found = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(list(types)[len(kept) :])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *found], schema=types)

    return docs.select("doc_id", *(c for c in carry if c != "text"), "text").mapInArrow(scan, schema)


def masked(text: str | None, spans: list[tuple[int, int, int]], mask: str) -> str | None:
    if not spans:
        return text
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mask]
        done = max(done, end)
    return "".join([*out, text[done:]])
