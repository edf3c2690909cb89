"""Secret scans with structural confirmation.

Base patterns find assignments, access keys and long hex runs. Candidates in base64 (on one line, on consecutive lines or
in PEM, whose line breaks may be escaped and lines prefixed) or hex are then decoded, and a span is added only where the
bytes parse: DER private keys by tags and nested lengths, down to the key inside an envelope, OpenSSH private keys by
their length-prefixed fields, signed tokens by their JSON header and payload. Of an encrypted key, the envelope's scheme
or the armour's headers and the length of the blocks are confirmed.

Defined results: a null text counts as empty and has no span; the digest of no spans is that of the empty string; an
empty table gives an empty result; repeated rows are scanned one by one; other columns are ignored by the report and
carried along by redaction.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quayside.llm.batches import frugal, slices

BASE_KINDS, ADDED_KINDS = ("assign", "access", "hex"), ("der", "openssh", "jwt")
RANK = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

# The base patterns. Letters of the names match in either ASCII case, so they are spelled out:
# a flag for case would also match letters beyond ASCII.
NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token"))
ASSIGN = re.compile(rf"""({NAMES}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

# Between its marks a PEM key may have anything but another mark: line breaks, their escapes, prefixes of lines.
PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----((?:[^-]+|-(?!----))*+)-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
# Headers of an encrypted key in the older armour.
ENCRYPTED = re.compile(r"Proc-Type:\s*4,ENCRYPTED[\s\S]*DEK-Info:\s*[A-Z0-9-]+,[0-9A-Fa-f]{16,}")
BREAK = re.compile(r"(?:\\+(?:[nrt]|u000[aAdD])|[\r\n])+")
# Lines of base64 that follow one another: white space, quotes and marks of comments or quotations may stand between.
BETWEEN = r"[\x20\t\"',]*(?:\\+[nr]|\r?\n)+(?:[\x20\t>#*;|\"',]|//\x20)*"
WRAPPED = re.compile(rf"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{{32,}}(?:{BETWEEN}[A-Za-z0-9+/_-]{{32,}})*+(?:{BETWEEN}[A-Za-z0-9+/_-]{{1,31}}(?![A-Za-z0-9+/_-]))?={{0,2}}")
LINE = re.compile(rf"({BETWEEN})|([A-Za-z0-9+/_-]+={{0,2}})")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
HEX_BYTES = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
JWT = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")


def decode64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except ValueError:
        return None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element, if elements fill data exactly; definite lengths only."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            wide = size - 0x80
            if not 1 <= wide <= 4 or at + wide > len(data):
                return None
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        if at + size > len(data):
            return None
        items.append((tag, data[at : at + size]))
        at += size
    return items


# Object identifiers, as DER has them.
RSA, EC, DSA, DH = (bytes.fromhex(x) for x in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2a864886f70d010301"))
RSA_PSS, EDWARDS, PBES = bytes.fromhex("2a864886f70d01010a"), bytes.fromhex("2b65"), (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def is_rsa_key(items: list[tuple[int, bytes]]) -> bool:
    """PKCS #1: a version and eight numbers."""
    return len(items) >= 9 and {t for t, _ in items[:9]} == {0x02} and int.from_bytes(items[0][1], "big") in (0, 1)


def is_ec_key(items: list[tuple[int, bytes]]) -> bool:
    """SEC 1: version 1, the key, perhaps parameters and the public key."""
    return len(items) >= 2 and items[0] == (0x02, b"\1") and items[1][0] == 0x04 and len(items[1][1]) >= 20 and {t for t, _ in items[2:]} <= {0xA0, 0xA1}


def fits_algorithm(identifier: bytes, key: bytes) -> bool:
    """Is this what PKCS #8 holds for the algorithm?"""
    items = der_items(key)
    if not items or len(items) != 1:
        return False
    tag, value = items[0]
    if identifier in (RSA, RSA_PSS):
        return tag == 0x30 and is_rsa_key(der_items(value) or [])
    if identifier == EC:
        return tag == 0x30 and is_ec_key(der_items(value) or [])
    if identifier in (DSA, DH):
        return tag == 0x02 and len(value) >= 16
    if identifier.startswith(EDWARDS):
        return tag == 0x04 and len(value) in (32, 56, 57)
    return tag in (0x02, 0x04, 0x30) and len(value) >= 16


def is_der_key(data: bytes) -> bool:
    """A PKCS #1, PKCS #8 (plain, with the key it holds, or encrypted) or SEC 1 private key, by its structure."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_items(data)
    inner = der_items(outer[0][1]) if outer and len(outer) == 1 else None
    if not inner or len(inner) < 2:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04]:
        scheme = der_items(inner[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(PBES) and len(inner[1][1]) >= 16 and len(inner[1][1]) % 8 == 0
    if tags[0] == 0x02 and tags[1:3] == [0x30, 0x04] and int.from_bytes(inner[0][1], "big") in (0, 1):
        algorithm = der_items(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06 and fits_algorithm(algorithm[0][1], inner[2][1])
    return is_rsa_key(inner) or is_ec_key(inner)


def is_openssh_key(data: bytes) -> bool:
    """Magic, then length-prefixed cipher, key derivation and its options, a count of keys, then public keys and the private part."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at, number = len(magic), None
    for k in range(3):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    if at + 4 > len(data) or not 1 <= (number := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return False
    at += 4
    for _ in range(number + 1):
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
    return at <= len(data)


def is_jwt(token: str) -> bool:
    parts = [decode64(p) for p in token.split(".")]
    if any(p is None for p in parts):
        return False
    try:
        header, claims = (json.loads(p) for p in parts[:2])
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (header["alg"].lower() == "none" or len(parts[2]) >= 16)


def key_kind(data: bytes | None) -> str | None:
    return None if not data else "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def pem_kind(body: str) -> str | None:
    """Kind of the key between PEM marks: without breaks and white space, or without what stands before and after its lines."""
    body = body.replace("\\/", "/").replace("\\u003d", "=")
    if kind := key_kind(decode64(re.sub(r"\s+", "", BREAK.sub("", body)))):
        return kind
    lines = [x for x in BREAK.split(body) if re.search("[A-Za-z0-9]", x)]
    if ENCRYPTED.search(body):
        data = decode64("".join(re.sub(r"^[^A-Za-z0-9+/]+|\s+$", "", x) for x in lines if ":" not in x))
        return "der" if data and len(data) >= 64 and len(data) % 8 == 0 else None
    prefix = len(re.match(r"(?:.*\s)?[^A-Za-z0-9]*", commonprefix(lines))[0])
    by_marks = [re.sub(r"^[^A-Za-z0-9+/]+", "", x) for x in lines]
    for plain in ([x[prefix:] for x in lines], by_marks):
        if kind := key_kind(decode64("".join(re.match("[A-Za-z0-9+/]*=*", x)[0] for x in plain))):
            return kind
    return None


def key_start(text: str, start: int) -> int:
    """start, or the next place where the first letter belongs to an escaped line break."""
    return start + 1 if start and text[start - 1] == "\\" and text[start] in "nrt" else start


def der_size(line: str) -> int | None:
    """Bytes of the DER sequence that begins with this base64, by its header."""
    data = decode64(line[:8]) or b""
    if len(data) < 6 or data[0] != 0x30:
        return None
    wide = data[1] - 0x80
    return 2 + data[1] if wide < 0 else 2 + wide + int.from_bytes(data[2 : 2 + wide], "big") if 1 <= wide <= 4 else None


def wrapped_spans(text: str) -> list[tuple[int, str, int]]:
    """Keys in base64 over consecutive lines."""
    found = []
    for m in WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), x[2]) for x in LINE.finditer(m[0]) if x[2]]
        lines[0] = (start := key_start(text, lines[0][0]), lines[0][1][start - lines[0][0] :])
        ends = list(accumulate((len(x) for _, x in lines), initial=0))
        k = 0
        while k + 1 < len(lines):
            last, kind = None, None
            if (size := der_size(lines[k][1])) is not None:
                last = bisect_left(ends, ends[k] + -(-4 * size // 3), k + 1) - 1  # the line on which the sequence ends
                kind = key_kind(decode64("".join(x for _, x in lines[k : last + 1]))) if k < last < len(lines) else None
            elif lines[k][1].startswith("b3BlbnNzaC1rZXktdjEA"):
                last = next((j for j in range(k + 1, len(lines)) if len(lines[j][1]) != len(lines[k][1]) or lines[j][1].endswith("=")), len(lines) - 1)
                kind = key_kind(decode64("".join(x for _, x in lines[k : last + 1])))
            if kind:
                found.append((lines[k][0], kind, lines[last][0] + len(lines[last][1])))
                k = last
            k += 1
    return found


def token_spans(text: str) -> list[tuple[int, str, int]]:
    """Signed tokens; a candidate that fails is tried again from its next part."""
    found, at = [], 0
    while m := JWT.search(text, at):
        if is_jwt(m[0]):
            found.append((m.start(), "jwt", m.end()))
            at = m.end()
        else:
            at = text.index(".", m.start()) + 1
    return found


def base_spans(text: str) -> list[tuple[int, str, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[tuple[int, str, int]]:
    found, inside = [], []
    if "-----BEGIN" in text:
        for m in PEM.finditer(text):
            if kind := pem_kind(m[1]):
                found.append((m.start(), kind, m.end()))
                inside.append(m.span())
    outside = lambda m: not any(a <= m.start() < b for a, b in inside)
    for span in wrapped_spans(text):
        if not any(a <= span[0] < b for a, b in inside):
            found.append(span)
            inside.append((span[0], span[2]))
    for m in BASE64.finditer(text):
        start = key_start(text, m.start())
        if (kind := key_kind(decode64(text[start : m.end()]))) and outside(m):
            found.append((start, kind, m.end()))
    for m in HEX_BYTES.finditer(text):
        if (kind := key_kind(bytes.fromhex(m[0]))) and outside(m):
            found.append((m.start(), kind, m.end()))
    if "." in text:
        found += token_spans(text)
    return found


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(spans, key=lambda s: (s[0], RANK[s[1]], s[2])))


def report_row(text: str | None) -> tuple:
    base = base_spans(text) if text else []
    added = confirmed_spans(text) if text else []
    kinds = [k for _, k, _ in base]
    return (*(kinds.count(k) for k in BASE_KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + added), len(added))


REPORT = [("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_confirmed", pa.int64())]


def secret_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            columns = list(zip(*(report_row(t.as_py()) for t in batch.column(1)), strict=True)) or [()] * len(REPORT)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, REPORT, strict=True))], ["doc_id", *(n for n, _ in REPORT)])

    return read.mapInArrow(frugal(scan), f"doc_id {read.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")


def redacted(text: str | None, mark: str) -> str | None:
    if not text or not (spans := sorted((a, b) for a, _, b in base_spans(text) + confirmed_spans(text))):
        return text
    out, at = [], 0
    for a, b in spans:
        if b > at:
            out += [text[at : max(a, at)], mark] if a >= at else []
            at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, *, mark: str = "[SECRET]") -> DataFrame:
    """docs with every span found replaced by mark (overlapping spans by one), and n_chars, if there is one, counted anew."""
    schema, names = docs.schema, docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            columns = list(batch.columns)
            columns[at] = pa.array([redacted(t.as_py(), mark) for t in batch.column(at)], batch.column(at).type)
            if chars is not None:
                columns[chars] = pc.utf8_length(columns[at]).cast(batch.column(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(frugal(clean), schema)
