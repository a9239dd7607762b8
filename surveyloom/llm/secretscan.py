"""Secret scans by a trigram inverted index.

Each rule's pattern is parsed into a Boolean trigram query: what any match must contain. Documents are indexed block
by block: the block's text is one byte array, and the postings of the trigrams that the rules ask for are the
sorted document numbers at which they occur. A query is answered by intersecting and uniting postings; the pattern
itself runs only over candidates. A rule without mandatory trigrams (hexadecimal runs) scans every document.
Letters are folded to lower case in index and queries, so that either case is a candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import partial
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyloom.llm.common import arrow, text_bytes


@dataclass(frozen=True)
class Rule:
    """kind, pattern and what a match must pass to count; a match that fails is dropped, not tried again."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


# The base rules are given; the others are the public forms of well-known credentials. Possessive
# repeats and look-behinds keep each linear in the length of the text.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 0, 16),
)
ADDED = (
    Rule("github", r"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}+"),
    Rule("gitlab", r"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}+"),
    Rule("slack", r"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"(?<![A-Za-z0-9])AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"(?<![A-Za-z0-9])[sr]k_live_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+"),
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("url", r"(?<![a-z])[a-z]{2,12}://[A-Za-z0-9._-]++:[^\s:/@]{3,}+@"),
)
RULES = BASE + ADDED

#: A query: ALL (no condition), ("tri", trigram), ("and", parts) or ("or", parts).
ALL = ("all",)
_MOST = 64


def _join(kind: str, queries: Iterable[tuple]) -> tuple:
    flat = list(dict.fromkeys(queries))
    if kind == "and":
        flat = [q for q in flat if q != ALL]
        return ALL if not flat else flat[0] if len(flat) == 1 else ("and", tuple(flat))
    return ALL if not flat or ALL in flat else flat[0] if len(flat) == 1 else ("or", tuple(flat))


def _of_strings(strings: set[str]) -> tuple:
    """Condition that one of the strings occurs."""
    return _join("or", [_join("and", [("tri", s[i : i + 3].encode("latin-1")) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(nodes, fold: Callable[[str], str]) -> tuple[set[str] | None, tuple]:
    """Of a sequence of parsed nodes: the strings it matches if they are few, else None, and the query."""
    runs: list[tuple] = []
    now, whole = {""}, True

    def flush() -> None:
        nonlocal now, whole
        runs.append(_of_strings(now))
        now, whole = {""}, False

    for kind, value in nodes:
        strings: set[str] | None = None
        query = ALL
        if kind is op.LITERAL:
            strings = {fold(chr(value))} if value < 128 else None
        elif kind is op.IN:
            chars: set[str] | None = set()
            for k, v in value:
                if chars is not None and k is op.LITERAL and v < 128:
                    chars.add(fold(chr(v)))
                elif chars is not None and k is op.RANGE and v[1] < 128:
                    chars |= {fold(chr(c)) for c in range(v[0], v[1] + 1)}
                else:
                    chars = None
            strings = chars if chars and len(chars) <= 5 else None
        elif kind is op.BRANCH:
            each = [_walk(x, fold) for x in value[1]]
            strings = set().union(*(s for s, _ in each)) if all(s is not None for s, _ in each) else None
            query = _join("or", [q for _, q in each])
        elif kind is op.SUBPATTERN:
            strings, query = _walk(value[3], fold)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, sub = value
            s, q = _walk(sub, fold)
            if most == 1 and s is not None:
                strings = s | {""} if least == 0 else s
            elif least:
                query = q if s is None else _of_strings(s)
        elif kind in (op.ASSERT, op.ASSERT_NOT, op.AT):
            strings = {""}
        if strings is not None and len(grown := {a + b for a in now for b in strings}) <= _MOST:
            now = grown
        else:
            flush()
            runs.append(query)
            if strings is not None and len(strings) <= _MOST:
                now = strings
    if whole:
        return now, _of_strings(now)
    flush()
    return None, _join("and", runs)


def trigram_query(pattern: str, flags: int = 0) -> tuple:
    """The Boolean trigram query of a pattern, over text with A-Z in lower case."""
    return _walk(_parser.parse(pattern, flags), str.lower)[1]


def trigrams(query: tuple) -> set[bytes]:
    return {query[1]} if query[0] == "tri" else set() if query == ALL else set().union(*map(trigrams, query[1]))


class BlockIndex:
    """Postings of chosen trigrams over a block of documents."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.number = np.zeros(1 << 24, dtype=np.uint8 if len(wanted) < 255 else np.uint16)
        for k, t in enumerate(self.wanted):
            self.number[int.from_bytes(t, "big")] = k + 1

    def postings(self, texts: list[bytes]) -> dict[bytes, np.ndarray]:
        block = np.frombuffer(b"\xff".join(texts).lower(), dtype=np.uint8)
        if len(block) < 3:
            return {}
        ends = np.cumsum([len(t) + 1 for t in texts])
        code = block[:-2].astype(np.uint32)
        code <<= 8
        code |= block[1:-1]
        code <<= 8
        code |= block[2:]
        which = self.number[code]
        at = np.flatnonzero(which)
        both = np.unique(which[at].astype(np.int64) * len(texts) + np.searchsorted(ends, at, "right"))
        k, doc = np.divmod(both, len(texts))
        cut = np.searchsorted(k, np.arange(1, len(self.wanted) + 2))
        return {t: doc[cut[i] : cut[i + 1]] for i, t in enumerate(self.wanted)}


def candidates(query: tuple, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Numbers of the block's documents that satisfy the query, ascending."""
    if query == ALL:
        return np.arange(n)
    if query[0] == "tri":
        return postings.get(query[1], np.zeros(0, np.int64))
    each = [candidates(q, postings, n) for q in query[1]]
    out = each[0]
    for x in each[1:]:
        out = np.intersect1d(out, x, assume_unique=True) if query[0] == "and" else np.union1d(out, x)
    return out


def matches(rule: Rule, compiled: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    for m in compiled.finditer(text):
        if m.end(rule.group) - m.start(rule.group) >= rule.least:
            yield m.span()


def _verifier(rule: Rule) -> re.Pattern:
    # a run of one class is at least so long exactly if the class repeats so often: nothing else needs looking at
    if m := re.fullmatch(r"(\[[^\]]+\])\+", rule.pattern):
        return re.compile(m[1] + "{%d,}" % rule.least, rule.flags)
    return re.compile(rule.pattern, rule.flags)


def scan_block(texts: list[bytes], rules: tuple[Rule, ...], index: BlockIndex, queries: list[tuple], compiled: list[re.Pattern]) -> list[list[tuple[int, int, int]]]:
    """Per document the spans (start, rule number, end) in order."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    postings = index.postings(texts)
    decoded: dict[int, str] = {}
    for k, rule in enumerate(rules):
        for d in candidates(queries[k], postings, len(texts)).tolist():
            text = decoded.get(d)
            if text is None:
                text = decoded[d] = texts[d].decode("utf-8", "replace")
            found[d] += ((a, k, b) for a, b in matches(rule, compiled[k], text))
    return [sorted(x) for x in found]


BLOCK_BYTES = 4 << 20


def blocks(batches: Iterable[pa.RecordBatch], most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a few megabytes at a time; a text is never cut."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids.append(d)
            texts.append(t.as_py())
            held += len(texts[-1])
            if held >= most:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row for each row of docs, repeated rows repeated.

    Offsets are code points, the end exclusive; spans are ordered by start, then by the order of rules. A null or
    empty text has no spans; a null id stays null. Other columns are not read. An empty table gives no rows.
    No shuffle: each task indexes and scans its own rows in blocks of a few megabytes.
    """

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r.pattern, r.flags) for r in rules]
        index = BlockIndex(set().union(*map(trigrams, queries)))
        compiled = [_verifier(r) for r in rules]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for ids, texts in blocks(batches):
            spans = scan_block(texts, rules, index, queries, compiled)
            yield arrow({"doc_id": (ids, pa.int64()), "spans": ([[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in s] for s in spans], kind)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col)).mapInArrow(scan, "doc_id long, spans array<struct<kind:string,start:int,end:int>>")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is(kind: str, span: Column) -> Column:
    return span["kind"] == kind


def digest_columns(found: DataFrame, base: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *(F.size(F.filter(spans, partial(_is, k))).cast("long").alias(n) for k, n in names.items()),
        F.sha2(joined(F.filter(spans, lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(spans).alias("spans"),
    )


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    names = {r.kind: f"n_{r.kind}" for r in BASE}
    return digest_columns(scan_secrets(docs), tuple(names), names)


