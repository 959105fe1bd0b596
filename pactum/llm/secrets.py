"""Secret scan: keyword prefilter, anchored patterns near hits, embedded checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over each
whole text. A kind's pattern is tried only where one of its keywords begins, so
its matches are the leftmost non-overlapping ones of the whole text. Tokens that
carry a checksum are kept only if it is right: access tokens that end in the base-62
CRC-32 of what precedes, and extended private keys in base 58 that end in four bytes of
a doubled SHA-256. Runs of hexadecimal digits have no keyword and are searched by their
own anchored scan.

Null and empty texts hold no secrets; a text of any length is scanned once, whole. Spans
of several kinds may overlap; those that begin together stand in the order of the kinds.
Repeated rows and rows of null ids give a result each, an empty table gives an empty
one. Columns other than the id and the text, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base kinds, as the contract of the query states them.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# Tokens with an embedded checksum: prefix, 30 characters, 6 characters of base-62 CRC-32.
CHECKED = r"(ghp_|gho_|ghu_|ghs_|ghr_|npm_)([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])"
CHECKED_KEYWORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
BASE_62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Extended private keys of the main and the test network: 82 bytes, the last four a checksum.
EXTENDED = r"[xt]prv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"
EXTENDED_KEYWORDS = ("xprv", "tprv")
BASE_58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KINDS = ("assign", "access", "hex", "checked", "extended")

SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_checked long, n_extended long"


def base62_crc(body: str) -> str:
    """Six base-62 digits of the CRC-32 of ``body``."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, digit = divmod(n, 62)
        out = BASE_62[digit] + out
    return out


def base58_checked(token: str) -> bool:
    """Whether the last four bytes of a base-58 number of 82 bytes begin the doubled SHA-256 of the others."""
    n = 0
    for c in token:
        n = n * 58 + BASE_58.index(c)
    if n >> 656:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


class Scanner:
    def __init__(self):
        import ahocorasick

        self.patterns = {"assign": re.compile(ASSIGN, re.ASCII | re.IGNORECASE), "access": re.compile(ACCESS), "checked": re.compile(CHECKED), "extended": re.compile(EXTENDED)}
        self.hex = re.compile(HEX)
        self.automaton = ahocorasick.Automaton()
        for kind, keywords in (("assign", ASSIGN_KEYWORDS), ("access", ("akia",)), ("checked", CHECKED_KEYWORDS), ("extended", EXTENDED_KEYWORDS)):
            for k in keywords:
                self.automaton.add_word(k, (kind, len(k)))
        self.automaton.make_automaton()

    @staticmethod
    def accepted(kind: str, found: re.Match) -> bool:
        if kind == "assign":
            return len(found[2]) >= 6
        if kind == "access":
            return len(found[0]) >= 20
        if kind == "extended":
            return base58_checked(found[0])
        return base62_crc(found[2]) == found[3]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """(start, kind number, end) of all secrets, in order."""
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # ASCII letters only, places stay
        hits = sorted((end - size + 1, kind) for end, (kind, size) in self.automaton.iter(low))
        free = dict.fromkeys(self.patterns, 0)
        out = [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        for start, kind in hits:
            if start >= free[kind] and (m := self.patterns[kind].match(text, start)):
                free[kind] = m.end()
                if self.accepted(kind, m):
                    out.append((start, KINDS.index(kind), m.end()))
        return sorted(out)


def _rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    scanner = Scanner()
    for batch in batches:
        columns = [[] for _ in range(7)]
        for text in batch.column("_text"):
            found = scanner.spans(text.as_py() or "")
            said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
            base = ",".join(s for s, (_, k, _) in zip(said, found, strict=True) if k < 3)
            kinds = [k for _, k, _ in found]
            for c, v in zip(columns, (kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(base.encode()).hexdigest(), ",".join(said), kinds.count(3), kinds.count(4)), strict=True):
                c.append(v)
        kept = [batch.column(i) for i in range(batch.num_columns) if batch.schema.names[i] != "_text"]
        names = [n for n in batch.schema.names if n != "_text"]
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[*names, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_checked", "n_extended"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col``, counts per kind, digest of base spans, all spans.

    Spans are ``kind:start:end`` in code points, end exclusive. A narrow map over
    the scan: no shuffle, and a lost task is simply read again.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(_rows, f"`{id_col}` {kind}, {SCHEMA}")


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every secret span of ``text_col`` replaced by ``mask``; null texts stay null."""

    @F.pandas_udf("string")
    def masked(texts):
        scanner = Scanner()

        def one(text):
            if text is None:
                return None
            out, at = [], 0
            for a, _, b in scanner.spans(text):
                if a >= at:
                    out += [text[at:a], mask]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    return docs.withColumn(text_col, masked(F.col(text_col)))
