"""Secret scan with structural confirmation.

Base patterns give assignments, access key ids and hex runs. Beyond them, base64 and hex candidates are decoded and
reported only when their bytes have the structure of a key or a signed token:

- `pem`: an armoured private key whose body, without headers and escaped line ends, is DER or an OpenSSH container;
- `jwt`: three dotted parts whose first is a JSON object with a string `alg`, and whose second is a JSON object;
- `der`: nested ASN.1 lengths that tile the whole value, with a key's integers or an object id beside a string;
- `ssh`: length-prefixed fields that tile the value, the first naming an SSH key type, or an OpenSSH container of such parts.

Keys in base64 are also found after a separator (`/`, `_`, `-`) and over lines of equal width. A text takes linear time.

Positions are code points. Matching is leftmost and non-overlapping by kind; whole texts are scanned.

Edge cases: null and empty texts have no spans; repeated rows are scanned alike; an empty table gives no rows; runs that do
not decode or have wrong lengths are not reported; other columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ._words import releasing

#: The base patterns in the order of their kinds.
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "ssh")
_ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_ARMOUR = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*)PRIVATE KEY-----")
_DOTTED = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)+")
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_WRAPPED = re.compile(r"(?:^[ \t>]*[A-Za-z0-9+/]{48,76}[ \t]*\r?\n)+[ \t>]*[A-Za-z0-9+/]+={0,2}", re.MULTILINE)
_HEX_RUN = re.compile(r"(?:[0-9a-f]{2}){20,}|(?:[0-9A-F]{2}){20,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")


def _decode(text: str) -> bytes | None:
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, first content byte, end) of the ASN.1 value at a position, if its length fits."""
    if at + 2 > end:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size >= 0x80:
        more = size & 0x7F
        if not 1 <= more <= 4 or at + more > end:
            return None
        size, at = int.from_bytes(data[at : at + more], "big"), at + more
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        item = _tlv(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def is_der_key(data: bytes) -> bool:
    """A SEQUENCE over all bytes whose nested lengths tile it, with the parts of a key."""
    top = _tlv(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return False
    level, tags, depth = [top], [], 0
    while level and depth < 8:
        below = []
        for tag, start, end in level:
            if tag in (0x30, 0x31) or 0xA0 <= tag <= 0xA3:
                inner = _children(data, start, end)
                if inner is None:
                    return False
                tags += [(t, e - s) for t, s, e in inner]
                below += inner
        level, depth = below, depth + 1
    large = sum(t == 0x02 and n >= 16 for t, n in tags)
    named = any(t == 0x06 and 3 <= n <= 16 for t, n in tags)
    held = any(t in (0x03, 0x04) and n >= 16 for t, n in tags)
    return large >= 2 or named and held or held and any(t == 0x02 and n == 1 for t, n in tags)


def _fields(data: bytes, at: int, many: int | None = None) -> tuple[list[bytes], int] | None:
    """Length-prefixed fields from a position, to the end or so many of them, and where they end."""
    out = []
    while len(out) < many if many is not None else at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        out.append(data[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def is_ssh_key(data: bytes) -> bool:
    """Length-prefixed fields that tile the value, the first an SSH key type; or an OpenSSH container whose parts tile it."""
    if data.startswith(b"openssh-key-v1\0"):
        head = _fields(data, 15, 3)  # cipher, key derivation, its options
        if head is None or not all(re.fullmatch(rb"[a-z0-9@.-]+", f) for f in head[0][:2]):
            return False
        keys = int.from_bytes(data[head[1] : head[1] + 4], "big")
        rest = _fields(data, head[1] + 4, keys + 1) if 1 <= keys <= 64 else None
        return rest is not None and rest[1] == len(data) and all(is_ssh_key(f) for f in rest[0][:-1]) and len(rest[0][-1]) >= 8
    found = _fields(data, 0)
    return found is not None and len(found[0]) >= 2 and re.match(rb"(sk-)?(ssh-(rsa|dss|ed25519)|ecdsa-sha2-)", found[0][0]) is not None


def _json(text: str) -> object:
    data = _decode(text)
    try:
        return json.loads(data) if data else None
    except (ValueError, RecursionError):
        return None


def _tokens(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens: three dotted parts, the first two JSON objects, the first with a string `alg`."""
    for m in _DOTTED.finditer(text):
        parts, at, free = m[0].split("."), m.start(), m.start()
        for k, part in enumerate(parts[:-2]):
            if at >= free and part.startswith(("ey", "ew")) and parts[k + 1][:1] == "e":
                head = _json(part)
                if isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(_json(parts[k + 1]), dict) and (parts[k + 2] or head["alg"].lower() == "none"):
                    free = at + len(part) + len(parts[k + 1]) + len(parts[k + 2]) + 2
                    yield at, free
            at += len(part) + 1


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """Each BEGIN mark that the next mark ends, with a key between them; headers and escaped line ends are left out."""
    marks = list(_ARMOUR.finditer(text))
    for a, b in zip(marks, marks[1:], strict=False):
        if a[1] == "BEGIN" and b[1] == "END" and a[2] == b[2]:
            lines = re.split(r"(?:\\[nr]|[\r\n])+", text[a.end() : b.start()])
            data = _decode(re.sub(r"[\s\"',\\]+", "", "".join(line for line in lines if ":" not in line)))
            if data and (is_der_key(data) or is_ssh_key(data) or "ENCRYPTED" in text[a.end() : a.end() + 40] and len(data) >= 64):
                yield a.start(), b.end()


def _key_in(run: str, at: int) -> tuple[str, int] | None:
    """(kind, end) of an encoded key that begins at a place of a run and ends with it or before a separator."""
    first = _decode(run[at : at + 8]) or b""
    if first[:1] == b"\x30":
        top = _tlv(first + bytes(1 << 16), 0, (1 << 16) + 6) if len(first) == 6 else None
        end = at - (-4 * top[2] // 3) if top else len(run) + 1
        if end > len(run.rstrip("=")) or end < len(run.rstrip("=")) and run[end] not in "/_-":
            return None
        data = _decode(run[at:end])
        return ("der", end if end < len(run.rstrip("=")) else len(run)) if data and is_der_key(data) else None
    if first[:3] == b"\0\0\0" or first.startswith(b"opens"):
        data = _decode(run[at:])
        return ("ssh", len(run)) if data and is_ssh_key(data) else None
    return None


def _keys(run: str) -> Iterator[tuple[str, int, int]]:
    """Encoded keys in a run of base64: at its start, or after a separator where an encoded key can begin."""
    free = 0
    for m in re.finditer(r"(?:^|(?<=[/_-]))(?=M[A-Za-z0-9+/_-]{39}|AAAA|b3BlbnNza)", run):
        if m.start() >= free and (found := _key_in(run, m.start())):
            free = found[1]
            yield found[0], m.start(), free


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind."""
    if not text:
        return []
    out = []
    lower = text.lower()
    if any(w in lower for w in _WORDS):
        out += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        out += [("pem", a, b) for a, b in _armoured(text)]
    if ".e" in text:
        out += [("jwt", a, b) for a, b in _tokens(text)]
    for m in _RUN.finditer(text):
        out += [(kind, m.start() + a, m.start() + b) for kind, a, b in _keys(m[0])]
    if "\n" in text:
        for m in _WRAPPED.finditer(text):
            start = m.start() + len(m[0]) - len(m[0].lstrip(" \t>"))
            whole = re.sub(r"[\s>]+", "", m[0])
            found = _key_in(whole, 0)
            if found and found[1] == len(whole):
                out.append((found[0], start, m.end()))
    for m in _HEX_RUN.finditer(text):
        if m[0][:2] == "30" or m[0][:6] == "000000":
            data = bytes.fromhex(m[0])
            kind = "der" if is_der_key(data) else "ssh" if is_ssh_key(data) else None
            if kind:
                out.append((kind, m.start(), m.end()))
    return sorted(set(out), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [scan(t) for t in batch.column(1).to_pylist()]
        base = [[s for s in r if s[0] in KINDS[:3]] for r in rows]
        count = lambda kind: pa.array([sum(s[0] == kind for s in r) for r in base], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()),
                *[count(k) for k in KINDS[:3]],
                pa.array([hashlib.sha256(_joined(r).encode()).hexdigest() for r in base], pa.string()),
                pa.array([_joined(r) for r in rows], pa.string()),
                pa.array([len(r) - len(b) for r, b in zip(rows, base, strict=True)], pa.int64()),
            ],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed"],
        )


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by base kind, digest of base spans, all spans, and how many structure confirmed."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(releasing(_scan_batches), schema)


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span replaced; overlapping spans become one mark."""
    spans = scan(text)
    if not spans:
        return text
    out, at = [], 0
    for _, start, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text are replaced by a mark."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = pa.array([redacted(t) for t in batch.column(at).to_pylist()], pa.string())
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), column)

    return docs.mapInArrow(releasing(step), docs.schema)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
