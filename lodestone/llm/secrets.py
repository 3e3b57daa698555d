"""Secret scan through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that
any match must contain. Documents are indexed in segments (a slice of a partition
at a time, so nothing is shuffled): the segment's postings list, for each trigram
that some rule asks for, the documents that hold it. A rule's query intersects and
unites postings; only its candidates are searched with the expression. A rule whose
expression forces no trigram searches every document.

The index folds ASCII letters to lower case, so one index serves rules of either
case; the expression itself decides.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import segments

#: A query that all documents meet.
ALL = ("all",)
#: Strings that the analysis of one stretch of an expression keeps at most.
MOST_STRINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of a match needs ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


#: The base kinds first, in the order in which equal starts are listed.
RULES = (
    Rule("assign", r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
)


def grams_of(word: str) -> tuple:
    """The query for a literal: all its trigrams."""
    raw = word.encode().lower()
    return both([("gram", raw[i : i + 3]) for i in range(len(raw) - 2)])


def both(queries: list[tuple]) -> tuple:
    kept = list(dict.fromkeys(q for q in queries if q != ALL))
    return ALL if not kept else kept[0] if len(kept) == 1 else ("and", *kept)


def either(queries: list[tuple]) -> tuple:
    kept = list(dict.fromkeys(queries))
    return ALL if ALL in kept or not kept else kept[0] if len(kept) == 1 else ("or", *kept)


def strings_of(node: tuple) -> set[str] | None:
    """All strings that a part of an expression matches, if there are few; lower case."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower() if arg < 128 else chr(arg)}
    if op is sre.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                out |= strings_of((kind, value)) or set()
            elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS and value[1] < 128:
                out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= MOST_STRINGS // 4 else None
    if op is sre.SUBPATTERN:
        return joined(arg[3])
    if op is sre.BRANCH:
        parts = [joined(x) for x in arg[1]]
        return None if any(x is None for x in parts) else few(set().union(*parts))
    if op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] == 1:
        inner = joined(arg[2])
        return None if inner is None else few(inner | {""}) if arg[0] == 0 else inner
    return {""} if op is sre.AT else None


def few(strings: set[str]) -> set[str] | None:
    return strings if len(strings) <= MOST_STRINGS else None


def joined(nodes) -> set[str] | None:
    """All strings that a sequence matches, if there are few."""
    out: set[str] | None = {""}
    for node in nodes:
        part = strings_of(node)
        out = None if part is None or out is None else few({a + b for a in out for b in part})
        if out is None:
            return None
    return out


def trigram_query(pattern: str) -> tuple:
    """A Boolean trigram query that every text with a match of ``pattern`` meets."""

    def of(nodes) -> tuple:
        met: list[tuple] = []
        run: set[str] = {""}

        def flush(then: set[str]) -> set[str]:
            met.append(either([grams_of(x) for x in run]))
            return then

        for node in nodes:
            op, arg = node
            part = strings_of(node)
            if part is not None:
                longer = few({a + b for a in run for b in part})
                run = longer if longer is not None else flush(part)
                continue
            run = flush({""})
            if op is sre.SUBPATTERN:
                met.append(of(arg[3]))
            elif op is sre.BRANCH:
                met.append(either([of(x) for x in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[0] > 0:
                met.append(of(arg[2]))
        flush(run)
        return both(met)

    return of(sre_parser.parse(pattern))


def grams_in(query: tuple) -> set[bytes]:
    if query[0] == "gram":
        return {query[1]}
    return set().union(*(grams_in(q) for q in query[1:])) if len(query) > 1 else set()


class SegmentIndex:
    """Postings of one segment for the trigrams that rules ask for."""

    def __init__(self, grams: list[bytes]) -> None:
        self.number = {g: i + 1 for i, g in enumerate(grams)}
        self.table = np.zeros(1 << 24, np.uint16)
        for g, i in self.number.items():
            self.table[int.from_bytes(g, "big")] = i
        self.postings: dict[int, np.ndarray] = {}
        self.count = 0

    def build(self, texts: list[str]) -> None:
        """Index whole texts; zero bytes keep trigrams from crossing from one to the next."""
        raw = [t.encode().lower() for t in texts]
        ends = np.cumsum([len(r) + 2 for r in raw])
        codes = np.frombuffer(b"\0\0".join(raw) + b"\0\0", np.uint8).astype(np.uint32)
        found = self.table[(codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]]
        at = np.flatnonzero(found)
        pairs = np.unique(found[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, side="right"))
        gram, doc = np.divmod(pairs, max(1, len(texts)))
        cuts = np.searchsorted(gram, np.arange(1, len(self.number) + 2))
        self.postings = {g: doc[cuts[g - 1] : cuts[g]] for g in self.number.values()}
        self.count = len(texts)

    def candidates(self, query: tuple) -> np.ndarray:
        if query == ALL:
            return np.arange(self.count)
        if query[0] == "gram":
            return self.postings[self.number[query[1]]]
        lists = sorted((self.candidates(q) for q in query[1:]), key=len)
        out = lists[0]
        for x in lists[1:]:
            out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
        return out


def search_pattern(rule: Rule) -> str:
    """The expression to search with: a bare run of a class gets its length asked for at once.

    A run of ``least`` or more characters of one class is found at the same place
    whether short runs are matched and dropped or never matched.
    """
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern


def spans_of(rule: Rule, compiled: re.Pattern, text: str) -> list[tuple[int, int]]:
    """Leftmost matches that don't overlap, without those whose group is too short; code points."""
    return [m.span() for m in compiled.finditer(text) if len(m[rule.group]) >= rule.least]


SPANS = "doc_id long, spans array<struct<kind:string,start:long,end:long>>"


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans``: every rule's spans in each whole text, by start, then by the rules' order.

    A null text is empty and has none; every row is searched, so repeated rows repeat
    their spans; null ids stay null; an empty table gives no rows. Other columns
    aren't read.
    """
    queries = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(grams_in, queries)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = SegmentIndex(grams)
        compiled = [re.compile(search_pattern(r)) for r in rules]
        for batch in segments(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            index.build(texts)
            found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
            for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                for d in index.candidates(query).tolist():
                    found[d] += [(a, n, b) for a, b in spans_of(rule, compiled[n], texts[d])]
            spans = [[{"kind": rules[n].kind, "start": a, "end": b} for a, n, b in sorted(x)] for x in found]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"cast(`{text_col}` as string) as text")
    return rows.mapInArrow(run, SPANS)


def op1_secrets(docs: DataFrame) -> DataFrame:
    """The contract's digest of :func:`scan`."""
    base = [r.kind for r in RULES if r.base]
    counts = [f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) as n_{k}" for k in base]
    listed = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    names = ", ".join(f"'{k}'" for k in base)
    return scan(docs).selectExpr(
        "doc_id",
        *counts,
        f"sha2({listed.format(f'filter(spans, s -> s.kind in ({names}))')}, 256) as base_sha256",
        f"{listed.format('spans')} as spans",
    )


def spans_by_scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> tuple[str, str]:
    """Brute force for tests: ``base_sha256`` and ``spans`` of one text, without an index."""
    found = []
    for n, r in enumerate(rules):
        found += [(m.start(), n, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    listed = lambda keep: ",".join(f"{rules[n].kind}:{a}:{b}" for a, n, b in sorted(found) if keep(rules[n]))
    return hashlib.sha256(listed(lambda r: r.base).encode()).hexdigest(), listed(lambda r: True)
