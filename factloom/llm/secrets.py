"""Secret scan: keyword prefilter, anchored patterns at the hits, then embedded checksums.

One Aho-Corasick pass over the text finds the keywords with which a secret can begin.
Each pattern is tried only where its keyword stands. Tokens that carry a checksum of
their own are kept only if it holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "pem")
# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Published prefixes of tokens of which the last six base-62 digits are a CRC-32.
CHECKED = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
CHECKED_TAIL = re.compile(r"([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# The first and last lines of private keys in text form, and the lines between.
PEM_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----", re.ASCII)
PEM_END = re.compile(r"-----END ((?:[A-Z0-9]+ )*PRIVATE KEY)-----", re.ASCII)
PEM_LINES = re.compile(r"(?:\r?\n(?:[A-Za-z0-9+/=]+|[A-Za-z-]+: [^\r\n]*|)(?=\r?\n|\Z))*+", re.ASCII)

KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}


def checksum(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in [*KEYWORDS.items(), *CHECKED.items(), ("-----begin ", "pem"), ("-----end ", "end")]:
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def _keys(text: str, begins: list[int], ends: list[int]) -> Iterator[tuple[str, int, int]]:
    """Spans of private keys: up to the end line of the same kind before the next key, else up to the key's last line."""
    heads = [m for at in begins if (m := PEM_BEGIN.match(text, at))]
    tails = [m for at in ends if (m := PEM_END.match(text, at))]
    tail = 0
    for k, head in enumerate(heads):
        limit = heads[k + 1].start() if k + 1 < len(heads) else len(text)
        while tail < len(tails) and tails[tail].start() < head.end():
            tail += 1
        while tail < len(tails) and tails[tail][1] != head[1] and tails[tail].start() < limit:
            tail += 1
        if tail < len(tails) and tails[tail].start() < limit:
            yield "pem", head.start(), tails[tail].end()
        else:
            lines = PEM_LINES.match(text, head.end(), limit)
            yield "pem", head.start(), head.end() + len(lines[0].rstrip())


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret of ``text``, in code points, by start and then kind.

    Null and empty texts have none. Spans of one kind don't overlap, leftmost first, and a
    match that is too short is dropped after it has used up its characters. A private key
    may be of any length; one without an end line goes up to its last line.
    """
    if not text:
        return []
    out = [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    low = text.encode().lower().decode()
    done = dict.fromkeys(KINDS, 0)
    hits = sorted((end + 1 - size, kind) for end, (size, kind) in _automaton().iter(low))
    out += _keys(text, *([at for at, kind in hits if kind == wanted] for wanted in ("pem", "end")))
    for start, kind in hits:
        if kind in ("pem", "end") or start < done[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            good = m and len(m[2]) >= 6
        elif kind == "access":
            m = ACCESS.match(text, start)
            good = m and len(m[0]) >= 20
        else:
            m = CHECKED_TAIL.match(text, start + 4) if text[start : start + 4] in CHECKED else None
            good = m and checksum(m[1]) == m[2] and not (start and text[start - 1].isalnum())
        if m:
            done[kind] = m.end()
        if good:
            out.append((kind, start, m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


def digest(found: list[tuple[str, int, int]]) -> dict:
    """Counts, hash of the base spans and text of all spans."""
    base = [s for s in found if s[0] in BASE_KINDS]
    counts = {f"n_{kind}": sum(s[0] == kind for s in base) for kind in BASE_KINDS}
    return counts | {"base_sha256": hashlib.sha256(_joined(base).encode()).hexdigest(), "spans": _joined(found)}


def secret_spans(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each secret: key, kind, start, end and the matched text.

    Null keys pass through; null and empty texts have none; repeated rows give repeated secrets; an
    empty table gives no rows; other columns are not read.
    """
    typed = f"`{key}` {documents.schema[key].dataType.simpleString()}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, kind, a, b, t[a:b]) for k, t in zip(batch.iloc[:, 0], batch.iloc[:, 1], strict=True) for kind, a, b in spans(t)]
            yield pd.DataFrame(rows, columns=[key, "kind", "start", "end", "secret"])

    return documents.select(key, text).mapInPandas(scan, f"{typed}, kind string, start long, end long, secret string")


def secret_digest(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``documents``: its counts of base kinds, their hash, and all spans.

    Null and empty texts have no spans; null keys pass through; repeated rows give repeated results.
    """
    typed = f"`{key}` {documents.schema[key].dataType.simpleString()}"

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([digest(spans(t)) for t in batch.iloc[:, 1]], columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])
            found.insert(0, key, batch.iloc[:, 0].array)
            yield found

    return documents.select(key, text).mapInPandas(scan, f"{typed}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
