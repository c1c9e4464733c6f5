"""Secret scans: an Aho-Corasick pass finds keywords, regular expressions are tried only where a keyword stands, and tokens that carry a checksum are kept only if it holds.

Kinds whose spans are found by pattern alone: assign, access, hex. Kinds that need a valid checksum: github and npm
(CRC-32 in base 62 in the last six characters), xprv (double SHA-256 in base 58).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
PATTERNS = {
    "assign": ASSIGN,
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}"),
    "xprv": re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}"),
}
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
    "xprv": ("xprv",),
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def crc32_base62(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = BASE62[r] + out
    return out.rjust(6, "0")


def base58_holds(text: str) -> bool:
    n = 0
    for c in text:
        n = n * 58 + BASE58.index(c)
    if n.bit_length() > 82 * 8:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def valid(kind: str, found: re.Match) -> bool:
    """The length that a kind asks for, or its embedded checksum."""
    text = found[0]
    if kind == "assign":
        return len(found[1]) >= 6
    if kind == "access":
        return len(text) >= 20
    if kind == "hex":
        return len(text) >= 24
    if kind == "xprv":
        return base58_holds(text)
    return text[-6:] == crc32_base62(text[4:-6])


class Scanner:
    """One automaton for all keywords. Every run of four hexadecimal digits is a keyword of its own, so that no long run is missed."""

    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        words: dict[str, list[int]] = {}
        for kind, keys in KEYWORDS.items():
            for key in keys:
                words.setdefault(key, []).append(KINDS.index(kind))
        for key in map("".join, product("0123456789abcdef", repeat=4)):
            words.setdefault(key, []).append(KINDS.index("hex"))
        for key, kinds in words.items():
            self.automaton.add_word(key, (len(key) - 1, tuple(kinds)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind's number, end) of every span, in order: leftmost and non-overlapping for each kind."""
        lowered = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # only A-Z, so that places stay
        done, out = [0] * len(KINDS), []
        for last, (back, kinds) in self.automaton.iter(lowered):
            start = last - back
            for k in kinds:
                if start >= done[k] and (found := PATTERNS[KINDS[k]].match(text, start)):
                    done[k] = found.end()
                    if valid(KINDS[k], found):
                        out.append((start, k, found.end()))
        return sorted(out)


def joined(spans: list[tuple[int, int, int]], kinds: int = len(KINDS)) -> str:
    return ",".join(f"{KINDS[k]}:{start}:{end}" for start, k, end in spans if k < kinds)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span becomes its kind in square brackets; overlapping spans become one."""
    out, at, end_of_last = [], 0, -1
    for start, k, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[k].upper()}]"]
            at = end
        else:
            at = max(at, end)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: counts of the base kinds, the digest of their spans, and all spans.

    A null or empty text has no spans. Rows with a null or repeated id are scanned like others. Other columns are ignored; an empty table gives no rows.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = scanner.spans(text) if text else []
                counts = [sum(k == i for _, k, _ in spans) for i in range(3)]
                rows.append((*counts, hashlib.sha256(joined(spans, 3).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), *(pa.array(c, pa.string()) for c in cols[3:])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, SCHEMA)


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all rows and columns, with every span of text_col redacted. A null or empty text stays as it is; repeated rows are redacted each, and an empty table gives no rows."""
    at = docs.columns.index(text_col)

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for batch in batches:
            texts = [redacted(t, scanner.spans(t)) if t else t for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at).name, pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(redact, docs.schema)
