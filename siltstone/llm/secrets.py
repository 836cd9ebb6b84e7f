"""Secret scans by a trigram index.

Each rule is a regular expression with a Boolean query over byte trigrams, derived from the expression: a text that
matches must satisfy the query. Texts are indexed batch by batch: one pass finds, for every trigram that any rule
asks for, the sorted list of texts that hold it (upper case folded to lower). A rule's query intersects and unites
these postings, and only the candidates are searched with the expression itself. A rule without a mandatory trigram
(a run of hex digits) scans every text.

The trigrams of an expression come from Python's own parse of it: literals join into strings, a set with few members
branches, alternatives unite, a repetition of at least one counts its body once, anything else breaks the string.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from .common import table

try:
    from re import _constants as C
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as parser

#: A Boolean query: None holds always; ("and" | "or", parts) or a trigram.
Query = None | bytes | tuple

#: Most strings that one literal stretch may branch into.
BRANCHES = 64


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "or" and any(p is None for p in parts):
        return None
    flat: list[Query] = []
    for p in parts:
        flat += p[1] if isinstance(p, tuple) and p[0] == kind else [p] if p is not None else []
    flat = list(dict.fromkeys(flat))
    return None if not flat else flat[0] if len(flat) == 1 else (kind, tuple(flat))


def _grams(strings: set[bytes]) -> Query:
    """All trigrams of one of the strings."""
    return _join("or", [_join("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else None


def _expand(node, fold: bool) -> set[bytes] | None:
    """The strings that a small subexpression matches, folded; None: too many or unbounded."""
    kind, arg = node
    if kind is C.LITERAL:
        return {chr(arg).lower().encode() if arg < 128 else chr(arg).encode()}
    if kind is C.IN and all(k is C.LITERAL for k, _ in arg):
        return set().union(*(_expand(x, fold) for x in arg))
    if kind is C.SUBPATTERN:
        return _sequence(arg[-1], fold)
    if kind is C.BRANCH:
        parts = [_sequence(p, fold) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[1] is not C.MAXREPEAT and arg[1] <= 2:
        body = _sequence(arg[2], fold)
        if body is None:
            return None
        return set().union(*({b"".join(x) for x in product(sorted(body), repeat=n)} for n in range(arg[0], arg[1] + 1)))
    return None


def _sequence(nodes, fold: bool) -> set[bytes] | None:
    out = {b""}
    for node in nodes:
        more = _expand(node, fold)
        if more is None or len(out) * len(more) > BRANCHES:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(pattern: str) -> Query:
    """The query that every text with a match satisfies."""

    def walk(nodes) -> Query:
        parts: list[Query] = []
        run: set[bytes] = {b""}
        for node in nodes:
            more = _expand(node, True)
            if more is not None and len(run) * len(more) <= BRANCHES:
                run = {a + b for a in run for b in more}
                continue
            parts.append(_grams(run))
            run = more if more is not None and len(more) <= BRANCHES else {b""}
            if more is None:
                kind, arg = node
                if kind is C.SUBPATTERN:
                    parts.append(walk(arg[-1]))
                elif kind is C.BRANCH:
                    parts.append(_join("or", [walk(p) for p in arg[1]]))
                elif kind in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
                    parts.append(walk(arg[2]))
        return _join("and", [*parts, _grams(run)])

    return walk(parser.parse(pattern))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False
    regex: re.Pattern = field(init=False, compare=False)
    query: Query = field(init=False, compare=False)
    runs: re.Pattern | None = field(init=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0)))
        object.__setattr__(self, "query", trigram_query(self.pattern))
        # a run of one set has no shorter match at its place: too short ones need not be tried
        run = self.group == 0 and self.least > 1 and re.fullmatch(r"(\[[^\[\]\\^]+\])\+", self.pattern)
        object.__setattr__(self, "runs", re.compile(f"{run[1]}{{{self.least},}}", self.regex.flags & ~re.UNICODE) if run else None)

    def spans(self, text: str) -> list[tuple[int, int]]:
        if self.runs is not None:
            return [m.span() for m in self.runs.finditer(text)]
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base rules, in the order of the contract, and those that the index adds.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 2, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
#: What follows a private key's first line: all up to its END line, or else its header and base64 lines.
_KEY_BODY = (
    r"(?:(?:(?!-----BEGIN )[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\s+[A-Za-z][A-Za-z-]*: [^\n]*)*(?:\s+[A-Za-z0-9+/]{16,}={0,2})*(?:\s+[A-Za-z0-9+/]+={1,2}|[\x20\t\r]*\n[\x20\t]*[A-Za-z0-9+/]+(?=[\x20\t\r]*(?:\n|\Z)))?)"
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----" + _KEY_BODY),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)


def _asked(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_asked, query[1])) if query else set()


class TrigramIndex:
    """Postings of the asked trigrams over one batch of texts."""

    LOWER = np.arange(256, dtype=np.uint8)
    LOWER[65:91] += 32

    def __init__(self, rules: tuple[Rule, ...]):
        self.grams = sorted(set().union(*(_asked(r.query) for r in rules)))
        codes = np.array([int.from_bytes(g, "big") for g in self.grams], np.uint32)
        self.codes = codes
        self.wanted = np.zeros(1 << 24, bool)
        self.wanted[codes] = True

    def add(self, data: np.ndarray, ends: np.ndarray) -> dict[bytes, np.ndarray]:
        """data: UTF-8 of all texts in a row; ends: where each ends."""
        low = self.LOWER[data]
        if len(low) < 3:
            return {}
        code = low[:-2].astype(np.uint32)
        code <<= 8
        code |= low[1:-1]
        code <<= 8
        code |= low[2:]
        at = np.flatnonzero(self.wanted[code])
        doc = np.searchsorted(ends, at, "right")
        inside = at + 3 <= ends[doc]
        pairs = np.unique((np.searchsorted(self.codes, code[at[inside]]).astype(np.int64) << 32) | doc[inside])
        gram, doc = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(gram, np.arange(len(self.grams) + 1))
        return {g: doc[cuts[i] : cuts[i + 1]] for i, g in enumerate(self.grams)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Texts that satisfy the query."""
    if query is None:
        return np.arange(n)
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    parts = [candidates(q, postings, n) for q in query[1]]
    if query[0] == "or":
        return np.unique(np.concatenate(parts))
    out = min(parts, key=len)
    for p in parts:
        if p is not out:
            out = np.intersect1d(out, p, assume_unique=True)
    return out


def scan_texts(texts: list[str], rules: tuple[Rule, ...], index: TrigramIndex) -> list[dict[str, list[tuple[int, int]]]]:
    """For each text, the spans of each kind that has any; code points, end exclusive."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(r) for r in raw]) if raw else np.empty(0, np.int64)
    postings = index.add(np.frombuffer(b"".join(raw), np.uint8), ends)
    out: list[dict] = [{} for _ in texts]
    for rule in rules:
        for i in candidates(rule.query, postings, len(texts)).tolist():
            if found := rule.spans(texts[i]):
                out[i][rule.kind] = found
    return out


def ordered(spans: dict[str, list[tuple[int, int]]], kinds: list[str]) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end) of all spans, sorted."""
    return sorted((a, kinds.index(k), b) for k, found in spans.items() for a, b in found)


def written(spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    return ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], kinds: list[str]) -> str:
    """Spans that touch or overlap become one mark, named after the first."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in spans:
        if merged and a <= merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"[{kinds[k].upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, base: tuple[Rule, ...] = BASE, batch_chars: int = 4 << 20) -> DataFrame:
    """All columns of docs and n_<kind> of the base kinds, base_sha256, spans, redacted.

    A null text has no spans and stays null. Every row is kept, in whatever number it comes. Columns of docs that have
    a result's name are replaced by the result.
    """
    counts = [f"n_{r.kind}" for r in base]
    added = [*counts, "base_sha256", "spans", "redacted"]
    docs = docs.drop(*added)
    schema = StructType(list(docs.schema.fields))
    for c in counts:
        schema = schema.add(c, "long")
    for c in added[len(counts) :]:
        schema = schema.add(c, "string")
    kinds, first = [r.kind for r in rules], {r.kind for r in base}
    at_text = docs.columns.index("text")

    def run(batches):
        index = TrigramIndex(rules)
        for batch in batches:
            column = batch.column(at_text)
            sizes = np.cumsum(pa.compute.binary_length(column.fill_null("")).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                done = int(sizes[at - 1]) if at else 0
                n = max(1, int(np.searchsorted(sizes, done + batch_chars, "right")) - at)
                part, at = batch.slice(at, n), at + n
                texts = part.column(at_text).to_pylist()
                found = scan_texts([t or "" for t in texts], rules, index)
                cols: dict[str, list] = {c: [] for c in added}
                for text, spans in zip(texts, found, strict=True):
                    every = ordered(spans, kinds)
                    for r in base:
                        cols[f"n_{r.kind}"].append(len(spans.get(r.kind, ())))
                    own = written([s for s in every if kinds[s[1]] in first], kinds)
                    cols["base_sha256"].append(hashlib.sha256(own.encode()).hexdigest())
                    cols["spans"].append(written(every, kinds))
                    cols["redacted"].append(redact(text, every, kinds) if every else text)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(cols[c], pa.int64()) for c in counts], *[pa.array(cols[c], pa.string()) for c in added[len(counts) :]]], [*part.schema.names, *added])

    return docs.mapInArrow(run, schema)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets in every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
