"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over the trigrams (of UTF-8 bytes, A-Z lowered) that any
match must hold: AND of what must follow each other, OR over alternatives. One pass over a block of texts builds its
inverted index, trigram to documents, for all trigrams that some rule asks for. A rule's query intersects and unites
the postings, and only the documents left are searched with the expression. Rules whose matches need hold no trigram
search every document.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

try:
    from re import _constants as C
    from re import _parser as P
except ImportError:  # before Python 3.11
    import sre_constants as C
    import sre_parse as P

#: Exact strings that an expression is expanded to at most; beyond it their trigrams are taken and they are let go.
MOST_EXACT = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` (0: the match) must have ``least`` characters, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    ignore_case: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


# The contract's rules. Runs of 24 and more are the whole runs that are long enough.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Public formats of keys and tokens.
MORE_RULES = (
    Rule("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]{0,16384}?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?"),
    Rule("code_host", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("maps", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{16,}=*", ignore_case=True),
    Rule("login_in_url", r"[a-z][a-z0-9+.-]{1,12}://[^\s:/@\x22'<>]{1,64}:[^\s:/@\x22'<>]{3,64}@", ignore_case=True),
)
RULES = BASE_RULES + MORE_RULES

#: Bytes of text whose trigrams are taken at once.
BYTES_TOGETHER = 4_000_000


@dataclass(frozen=True)
class All:
    """Every part holds; with no parts, anything does."""

    parts: tuple = ()


@dataclass(frozen=True)
class Any:
    parts: tuple = ()


@dataclass
class Known:
    """What is known of an expression's matches: all of them if ``exact``, and a query that each satisfies."""

    exact: set[str] | None
    query: object = field(default_factory=All)


def both(a, b):
    parts = tuple(dict.fromkeys((a.parts if isinstance(a, All) else (a,)) + (b.parts if isinstance(b, All) else (b,))))
    return parts[0] if len(parts) == 1 else All(parts)


def either(queries: Iterable):
    parts = tuple(dict.fromkeys(queries))
    if any(x == All() for x in parts):
        return All()
    asks = [set(x.parts) if isinstance(x, All) else {x} for x in parts]
    parts = tuple(x for x, a in zip(parts, asks, strict=True) if not any(b < a for b in asks))  # a narrower alternative adds nothing
    return parts[0] if len(parts) == 1 else Any(parts)


def lowered(text: str) -> str:
    """A-Z lowered, as expressions that ignore case do here; nothing else."""
    return "".join(c.lower() if c.isascii() else c for c in text)


def grams(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + 3] for i in range(len(raw) - 2)]


def of_strings(strings: set[str]):
    """One of the strings is there, as far as trigrams can say."""
    return either(both(All(), All(tuple(grams(s)))) for s in sorted(strings))


def joined(items: list[Known]) -> Known:
    """One after the other: runs of exact parts are multiplied out, so that trigrams cross their borders."""
    query, run, whole = All(), {""}, True
    for x in items:
        query = both(query, x.query)
        if x.exact is not None and len(run) * len(x.exact) <= MOST_EXACT:
            run = {a + b for a, b in product(run, x.exact)}
        else:
            query = both(query, of_strings(run))
            whole, run = False, x.exact if x.exact is not None else {""}
    return Known(run, query) if whole else Known(None, both(query, of_strings(run)))


def known(parsed) -> Known:
    """Analyse a parsed expression; whatever isn't understood may match anything."""
    items = []
    for op, arg in parsed:
        if op is C.LITERAL:
            items.append(Known({lowered(chr(arg))}))
        elif op is C.IN and all(k is C.LITERAL for k, _ in arg) and len(arg) <= 8:
            items.append(Known({lowered(chr(v)) for _, v in arg}))
        elif op is C.SUBPATTERN:
            items.append(known(arg[-1]))
        elif op is C.BRANCH:
            ways = [known(x) for x in arg[1]]
            exact = set().union(*(x.exact for x in ways)) if all(x.exact is not None for x in ways) else None
            if exact is not None and len(exact) <= MOST_EXACT:
                items.append(Known(exact))
            else:
                items.append(Known(None, either(both(x.query, of_strings(x.exact)) if x.exact is not None else x.query for x in ways)))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            low, high, inner = arg[0], arg[1], known(arg[2])
            if (low, high) == (0, 1) and inner.exact is not None:
                items.append(Known({"", *inner.exact}))
            elif low == 0:
                items.append(Known(None))
            else:
                items.append(Known(None, both(inner.query, of_strings(inner.exact)) if inner.exact is not None else inner.query))
        elif op is C.AT:
            items.append(Known({""}))
        else:
            items.append(Known(None))
    return joined(items)


def trigram_query(rule: Rule):
    """The rule's Boolean query over lower-cased trigrams; ``All()`` if it has no mandatory ones."""
    found = known(P.parse(rule.pattern))
    return both(found.query, of_strings(found.exact)) if found.exact is not None else found.query


def trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams, query.parts))


def matching(query, postings: dict[bytes, np.ndarray], n: int) -> np.ndarray:
    """Which of the block's n documents satisfy the query, from sorted postings."""
    if isinstance(query, bytes):
        return postings[query]
    if isinstance(query, All):
        out = np.arange(n)
        for x in sorted((matching(p, postings, n) for p in query.parts), key=len):
            out = np.intersect1d(out, x, assume_unique=True)
        return out
    return np.unique(np.concatenate([matching(p, postings, n) for p in query.parts]))


class BlockIndex:
    """Builds blocks' postings of the wanted trigrams, in one pass over the texts' bytes."""

    def __init__(self, wanted: set[bytes]):
        self.wanted = sorted(wanted)
        self.codes = np.array([int.from_bytes(g, "big") for g in self.wanted], dtype=np.int64)
        self.begins = np.zeros(1 << 16, dtype=bool)  # by a trigram's first two bytes
        self.begins[self.codes >> 8] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32

    def postings(self, texts: pa.Array) -> dict[bytes, np.ndarray]:
        n = len(texts)
        whole = texts.cast(pa.large_binary())
        offsets = np.frombuffer(whole.buffers()[1], dtype=np.int64, count=n + 1, offset=8 * whole.offset) if n else np.zeros(1, dtype=np.int64)
        found = [np.empty(0, dtype=np.int64)]
        if offsets[-1] > offsets[0]:
            raw = np.frombuffer(whole.buffers()[2], dtype=np.uint8)
            for at in range(int(offsets[0]), int(offsets[-1]) - 2, BYTES_TOGETHER):
                b = self.lower[raw[at : min(at + BYTES_TOGETHER + 2, int(offsets[-1]))]].astype(np.uint16)
                places = np.flatnonzero(self.begins[(b[:-2] << 8) | b[1:-1]])
                code = (b[places].astype(np.int64) << 16) | (b[places + 1].astype(np.int64) << 8) | b[places + 2]
                which = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
                hit = self.codes[which] == code
                which, places = which[hit], places[hit] + at
                of = np.searchsorted(offsets, places, side="right") - 1
                inside = places + 2 < offsets[of + 1]  # not across two texts
                found.append(np.unique(which[inside] * n + of[inside]))
        pairs = np.unique(np.concatenate(found))
        cut = np.searchsorted(pairs, np.arange(len(self.wanted) + 1) * n)
        return {g: pairs[cut[k] : cut[k + 1]] - k * n for k, g in enumerate(self.wanted)}


class Scanner:
    """The rules with their queries; ``scan`` finds every span of a block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, r.compiled(), trigram_query(r)) for r in rules]
        self.index = BlockIndex(set().union(*(trigrams(q) for _, _, q in self.rules)))

    def scan(self, texts: pa.Array) -> list[list[tuple[int, int, int]]]:
        """Spans of each text (a string array without nulls) as (start, rule number, end), in that order."""
        postings = self.index.postings(texts) if self.index.wanted else {}
        wanted = [matching(query, postings, len(texts)).tolist() for _, _, query in self.rules]
        read = {i: texts[i].as_py() for i in sorted(set().union(*wanted))}
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        for k, ((rule, pattern, _), these) in enumerate(zip(self.rules, wanted, strict=True)):
            for i in these:
                found[i] += [(m.start(), k, m.end()) for m in pattern.finditer(read[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in found:
            spans.sort()
        return found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, secrets``: per document all spans as ``array<struct<kind,start,end>>``, by start, then by rule.

    Per rule the leftmost non-overlapping matches, offsets in code points, end exclusive. A null text counts as empty
    and has none. Repeated rows and null ids each give a row; other columns are ignored.
    """
    common.ship_package(docs.sparkSession)
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        scanner = Scanner(rules)
        for batch in common.slices(batches):
            found = scanner.scan(batch["text"])
            rows = [[{"kind": kinds[k], "start": a, "end": b} for a, k, b in spans] for spans in found]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(rows, pa.list_(span))], names=["doc_id", "secrets"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,end:long>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from :func:`scan`'s."""
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*(r.kind for r in BASE_RULES)))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its ``text`` replaced by ``mark`` (overlapping spans by one), and ``n_chars`` renewed.

    All rows and all other columns stay as they are; null texts stay null.
    """
    common.ship_package(docs.sparkSession)
    schema = docs.schema
    names = [f.name for f in schema]
    at = names.index("text")

    def run(batches):
        scanner = Scanner(rules)
        for batch in common.slices(batches):
            texts, out = batch.column(at), []
            for given, spans in zip(texts, scanner.scan(texts.fill_null("")), strict=True):
                text = given.as_py()
                if spans:
                    parts, done = [], 0
                    for start, _, end in spans:
                        if start >= done:
                            parts += [text[done:start], mark]
                        done = max(done, end)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in names else out
