"""Secret scans with structural confirmation.

Patterns propose, structure decides: a base64 or hex run is reported as a key
only if it decodes to the encoding of a private key whose nested lengths add up
(public keys and certificates are no secrets), and a signed token only if its header decodes to JSON that names an algorithm.  Runs that are
wrapped (by newlines or escaped ones) are joined first, and keys that begin
inside a run are found by their own lengths; the first line of a wrapped key
without armour has 40 characters at least.  Armour may hold headers; a body that
they call encrypted cannot be decoded, so whole cipher blocks will do.  Three plain
kinds (assignments, access ids, long hex runs) are reported as the patterns
find them.  A linear-time pass over the Arrow buffers first drops texts that
hold no possible start of any pattern; it never drops a text with a match.

Results for odd input: a null text is empty and has no spans; texts are read
whole; an empty table gives no rows; rows that share an id are scanned each for
itself.  Other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, id_out, keyed, over_rows

KINDS = ("assign", "access", "hex", "der", "jwt", "openssh", "pem")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_LONG = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ENCODED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
ENCODED_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
#: The same over line ends, written out or escaped.
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}(?:(?:\r?\n[ \t]*|(?:\\+r)?\\+n)[A-Za-z0-9+/_-]+)*")
BREAK = re.compile(r"\r?\n[ \t]*|(?:\\+r)?\\+n")
#: How a DER sequence and an OpenSSH key begin in base64.
STARTS = re.compile(r"(?=M[A-P]|b3BlbnNzaC1rZXktdjE)")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])(?=([A-Za-z0-9_-]{12,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*))")
ARMOUR = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?!-----).)+)-----END \1-----", re.DOTALL)
#: Any text that one of the patterns matches holds one of these; the first are the patterns' own starts.
MAYBE = r"(?i:password|passwd|secret|token|api_?key)|AKIA[A-Z0-9]|[0-9A-Fa-f]{32}|[A-Za-z0-9+/_-]{40}|[A-Za-z0-9_-]{12}\.[A-Za-z0-9_-]+\.|-----BEGIN"
OPENSSH = b"openssh-key-v1\x00"


def decoded(text: str) -> bytes | None:
    """The bytes of base64 in either alphabet, padded or not; None if it is no base64."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _element(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the content of the DER element at `at`; None if it does not fit before end."""
    if at + 2 > end:
        return None
    tag, length, at = data[at], data[at + 1], at + 2
    if length & 0x80:
        n = length & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        length = int.from_bytes(data[at : at + n], "big")
        if length < 0x80 or (n > 1 and data[at] == 0):
            return None  # DER wants the shortest form
        at += n
    return (tag, at, at + length) if at + length <= end else None


def nested(data: bytes, at: int, end: int, depth: int = 0) -> bool:
    """Whether [at, end) is filled exactly by DER elements, those inside constructed ones too."""
    while at < end:
        found = _element(data, at, end)
        if not found or depth > 16:
            return False
        tag, inner, at = found
        if tag & 0x20 and not nested(data, inner, at, depth + 1):
            return False
    return True


def _elements(data: bytes, at: int, end: int) -> list[tuple[int, int, int]]:
    out = []
    while at < end and (found := _element(data, at, end)):
        out.append(found)
        at = found[2]
    return out


def is_private(data: bytes, parts: list[tuple[int, int, int]]) -> bool:
    """Whether the elements of a DER sequence are a private key's: public keys and certificates hold no secret.

    A version (0 to 3), then: the numbers of an RSA or DSA key; an algorithm and the key in octets (PKCS 8); or the key in
    octets (SEC 1).  Without a version, an algorithm and octets: an encrypted key.
    """
    tags = [tag for tag, _, _ in parts]
    is_algorithm = lambda x: x[0] == 0x30 and x[2] > x[1] and data[x[1]] == 0x06
    if tags[:1] == [0x02] and parts[0][2] - parts[0][1] == 1 and data[parts[0][1]] <= 3:
        rest = parts[1:]
        if len(rest) >= 5 and all(tag == 0x02 for tag in tags[1:6]):
            return True
        if len(rest) >= 2 and is_algorithm(rest[0]) and rest[1][0] == 0x04:
            return True
        return bool(rest) and rest[0][0] == 0x04 and rest[0][2] - rest[0][1] >= 16
    return len(parts) == 2 and is_algorithm(parts[0]) and tags[1] == 0x04


def is_key(data: bytes | None) -> str:
    """'der' or 'openssh' if the bytes are a private key in that encoding, else ''."""
    if not data or len(data) < 24:
        return ""
    if data.startswith(OPENSSH):
        at = len(OPENSSH)
        for _ in range(3):  # cipher, kdf and its options, each with its length before it
            if at + 4 > len(data):
                return ""
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return "openssh" if at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64 else ""
    outer = _element(data, 0, len(data))
    if not outer or outer[0] != 0x30 or outer[2] != len(data) or not nested(data, outer[1], outer[2]):
        return ""
    return "der" if is_private(data, _elements(data, outer[1], outer[2])) else ""


def _length(data: bytes) -> int:
    """The bytes of the key that data begin with, by its own lengths; 0 if they do not add up."""
    if not data.startswith(OPENSSH):
        if len(data) < 6 or data[0] != 0x30 or data[1] == 0x80 or data[1] > 0x84:
            return 0
        n = data[1] & 0x7F if data[1] & 0x80 else 0
        inner = data[2 + n :]
        # What keys begin with: a version or a long number, or a sequence with an algorithm (certificates: a long one).
        if inner and inner[0] not in (0x02, 0x30):
            return 0
        return 2 + (n + int.from_bytes(data[2 : 2 + n], "big") if n else data[1])
    at, left = len(OPENSSH), 3
    for more in (True, False):  # cipher, kdf and its options; then the public keys and the private part
        for _ in range(left):
            if at + 4 > len(data):
                return 0
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        if more:
            left = int.from_bytes(data[at : at + 4], "big") + 1
            at += 4
            if not 2 <= left <= 65:
                return 0
    return at if at <= len(data) else 0


def inside(text: str, start: int, end: int) -> Iterator[tuple[int, str, int]]:
    """(start, kind, end) of the keys in a wrapped run, wherever they begin in it."""
    run, place, at = [], [], start
    for m in [*BREAK.finditer(text, start, end), None]:
        stop = m.start() if m else end
        run.append(text[at:stop])
        place.extend(range(at, stop))
        at = m.end() if m else end
    joined, done = "".join(run), 0
    for m in STARTS.finditer(joined):
        if (k := m.start()) < done:
            continue
        head = decoded(joined[k : k + 8] if joined[k] == "M" else joined[k : len(joined) - (len(joined) - k) % 4])
        size = (_length(head or b"") * 8 + 5) // 6
        if not 32 <= size <= len(joined) - k:
            continue
        if kind := is_key(decoded(joined[k : k + size])):
            done = k + size
            last = place[done - 1] + 1
            while last < len(text) and text[last] == "=" and last < place[done - 1] + 3:
                last += 1
            yield place[k], kind, last


def armoured(body: str) -> bool:
    """Whether the body of an armoured block, with or without headers, line ends escaped or not, is a key."""
    lines = re.sub(r"\\+[nrt]", "\n", body).replace("\\/", "/").strip().splitlines()
    n = 0
    while n < len(lines) and (":" in lines[n] or (n and lines[n - 1].endswith("\\"))):
        n += 1
    data = decoded("".join("".join(lines[n:]).split()))
    encrypted = any(x.startswith("DEK-Info:") for x in lines[:n])
    return bool(is_key(data)) or bool(encrypted and data and len(data) >= 24 and len(data) % 8 == 0)


def is_token(text: str) -> bool:
    header, body, _ = text.split(".", 2)
    try:
        fields = json.loads(decoded(header) or b"")
    except ValueError:
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str) and decoded(body) is not None


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of every secret, by start and then by the order of KINDS; code points, end exclusive."""
    out = [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), "hex", m.end()) for m in HEX_LONG.finditer(text)]
    for m in ENCODED.finditer(text):
        if kind := is_key(decoded(m[0])):
            out.append((m.start(), kind, m.end()))
    pem = [(m.start(), "pem", m.end()) for m in ARMOUR.finditer(text) if armoured(m[2])]
    whole = {(a, b) for a, kind, b in out + pem if kind in ("der", "openssh", "pem")}
    for m in WRAPPED.finditer(text):
        out += [x for x in inside(text, m.start(), m.end()) if not any(a <= x[0] < b for a, b in whole)]
    for m in ENCODED_HEX.finditer(text):
        if kind := is_key(bytes.fromhex(m[0])):
            out.append((m.start(), kind, m.end()))
    past = 0
    for m in TOKEN.finditer(text):
        if m.start() >= past and is_token(m[1]):
            past = m.end(1)
            out.append((m.start(), "jwt", past))
    out += pem
    return sorted(set(out), key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def redacted(text: str, spans: list[tuple[int, str, int]], mark: str = "[SECRET]") -> str:
    """The text with every run of overlapping spans replaced by one mark."""
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def _task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        texts = batch.column(1)
        maybe = pc.fill_null(pc.match_substring_regex(texts, MAYBE), False).to_pylist()
        spans = [spans_of(t.as_py()) if m else [] for t, m in zip(texts, maybe, strict=True)]
        clean = [redacted(t.as_py(), s) if s else t.as_py() for t, s in zip(texts, spans, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([[{"kind": k, "start": a, "end": b} for a, k, b in s] for s in spans], kind), pa.array(clean, pa.string())],
            ["id", "secrets", "clean_text"],
        )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, sha, joined = {k: [] for k in KINDS[:3]}, [], []
        for spans in batch.column(1).to_pylist():
            for k, have in counts.items():
                have.append(sum(s["kind"] == k for s in spans))
            one = [(s["kind"], f"{s['kind']}:{s['start']}:{s['end']}") for s in spans]
            sha.append(hashlib.sha256(",".join(x for k, x in one if k in counts).encode()).hexdigest())
            joined.append(",".join(x for _, x in one))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in counts.values()), pa.array(sha, pa.string()), pa.array(joined, pa.string())],
            ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id_col, secrets (kind, start, end in code points) and clean_text (the secrets replaced)."""
    out = keyed(df, id_col, text_col).mapInArrow(_task, "id long, secrets array<struct<kind:string,start:long,end:long>>, clean_text string")
    return out.select(id_out(id_col), "secrets", "clean_text")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(documents(spark, sf_dir)).select("doc_id", "secrets")
    return found.mapInArrow(_digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """df with the secrets in its texts replaced, and length_col (if given) set to the new length in code points."""
    text, length = df.columns.index(text_col), df.columns.index(length_col) if length_col else None

    def finish(batch: pa.RecordBatch, result: pa.RecordBatch) -> pa.RecordBatch:
        found = pc.greater(pc.list_value_length(result.column(1)), 0)
        columns = list(batch.columns)
        clean = result.column(2).cast(columns[text].type)
        columns[text] = clean
        if length is not None:
            columns[length] = pc.if_else(found, pc.utf8_length(clean).cast(columns[length].type), columns[length])
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return over_rows(df, text_col, _task, finish)
