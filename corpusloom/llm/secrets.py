"""Secret scan with structural confirmation.

Patterns give the base spans. Longer encoded runs are candidates only: a run is
reported when what it decodes to has the structure of a key or of a signed token.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import small_batches, table

#: Kinds in report order: the first three are patterns, the others are confirmed by their structure.
KINDS = ("assign", "access", "hex", "pem", "der", "jwt")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# A longest run that is too short holds no long enough one, so the length can stand in the pattern.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----")
_BODY = re.compile(r"""[A-Za-z0-9+/=\s:,.\\"'-]*+""")
_CIPHER = re.compile(r"DEK-Info:\s*+([A-Z0-9-]++),([0-9A-Fa-f]++)")
#: Block bytes of the ciphers of an armoured key.
CIPHERS = {"DES-CBC": 8, "DES-EDE3-CBC": 8, "AES-128-CBC": 16, "AES-192-CBC": 16, "AES-256-CBC": 16}
_RUN = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_RUN = re.compile(r"[0-9A-Fa-f]{64,}")
# The later parts are looked at only, so a token may begin in any part of a longer chain of dots.
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]{8,})(?=\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*))")
# Line breaks as they stand in files, in JSON and in source code that joins quoted lines.
_BREAK = re.compile(r"""\\+[nrt]|["'][\s+,.\\]*["']""")
_GAP = re.compile(r"""(?:\\+[nrt]|["'][\s+,.\\]*["']|\s)+""")
_PAD = re.compile(r"={0,2}")
#: Where a key can begin in base64 and in hex: a sequence, or the name of the openssh format; and the digits that go on.
_BEGINS = (
    (re.compile(r"M[A-I](?=[A-Za-z0-9+/_-]{14})|b3BlbnNzaC1rZXktdjEA"), re.compile(r"[A-Za-z0-9+/_-]+"), 4, 3),
    (re.compile(r"30(?=[0-9A-Fa-f]{14})|6f70656e7373682d6b65792d763100", re.I), re.compile(r"[0-9A-Fa-f]+"), 2, 1),
)


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


#: More parts than any key has, or than an openssh file has of public keys.
MOST_PARTS = 16


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data from at to end exactly; None if the nested lengths don't, or if there are more than any key has."""
    found: list[tuple[int, int, int]] = []
    while at < end:
        if at + 2 > end or data[at] & 0x1F == 0x1F or len(found) == MOST_PARTS:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > end:
                return None
            size, at = int.from_bytes(data[at : at + count], "big"), at + count
        if at + size > end:
            return None
        found.append((tag, at, at + size))
        at += size
    return found


def _sequence_kind(data: bytes, start: int, end: int) -> str | None:
    """The kind of key whose sequence has its values from start to end."""
    inside = _children(data, start, end)
    if not inside:
        return None
    tags = [tag for tag, _, _ in inside]
    named = lambda k: bool(first := _children(data, *inside[k][1:])) and first[0][0] == 0x06
    if tags[0] == 0x02:
        if set(tags) == {0x02} and len(tags) in (6, 9):
            return "rsa" if len(tags) == 9 else "dsa"
        if tags[:3] == [0x02, 0x30, 0x04] and set(tags[3:]) <= {0xA0, 0xA1, 0x81}:
            return "pkcs8" if named(1) else None
        if tags[:2] == [0x02, 0x04] and set(tags[2:]) <= {0xA0, 0xA1} and 16 <= inside[1][2] - inside[1][1] <= 66:
            return "ec"
    elif tags == [0x30, 0x04]:
        return "encrypted" if named(0) else None
    return None


def key_at(data: bytes, start: int = 0) -> tuple[str, int] | None:
    """(kind, end) of the private key that data encodes from start on: rsa, dsa, ec, pkcs8, encrypted or openssh.

    A sequence ends where its length says. An openssh key has three fields, a count, as many public
    keys and the private ones; it ends with data if not all of them are there. Only headers are
    looked at, and no more of them than a key has.
    """
    if data.startswith(b"openssh-key-v1\0", start):
        at, left, counted = start + 15, 3, False
        while left:
            if at + 4 > len(data):
                return ("openssh", len(data)) if counted else None
            at += 4 + int.from_bytes(data[at : at + 4], "big")
            left -= 1
            if not left and not counted:
                if at + 4 > len(data):
                    return None
                left, counted, at = min(int.from_bytes(data[at : at + 4], "big"), MOST_PARTS) + 1, True, at + 4
        return "openssh", min(at, len(data))
    if len(data) < start + 4 or data[start] != 0x30:
        return None
    count = data[start + 1] & 0x7F if data[start + 1] & 0x80 else 0
    if count > 4 or data[start + 1] == 0x80:
        return None
    begin = start + 2 + count
    end = begin + (int.from_bytes(data[start + 2 : begin], "big") if count else data[start + 1])
    kind = _sequence_kind(data, begin, end) if end <= len(data) else None
    return (kind, end) if kind else None


def key_structure(data: bytes) -> str | None:
    """The kind of private key that is all of data."""
    found = key_at(data)
    return found[0] if found and found[1] == len(data) else None


def _armoured(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of keys between the marks of a key file: what stands there has the structure of a key, or of blocks of a cipher that is named with its start."""
    begin = None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begin = m
            continue
        if begin and begin[2] == m[2] and _BODY.fullmatch(text, begin.end(), m.start()):
            lines = [x.strip() for x in _BREAK.sub("\n", text[begin.end() : m.start()]).split("\n")]
            data = _decoded(re.sub(r"\s", "", "".join(x for x in lines if ":" not in x)))
            if data and (key_structure(data) or _enciphered("\n".join(x for x in lines if ":" in x), data)):
                yield begin.start(), m.end()
        begin = None


def _enciphered(headers: str, data: bytes) -> bool:
    named = _CIPHER.search(headers)
    block = CIPHERS.get(named[1]) if named and "ENCRYPTED" in headers else None
    return bool(block) and len(named[2]) == 2 * block and len(data) >= 64 and len(data) % block == 0


class _Digits:
    """The digits of an encoding from a place of a text on, over line breaks, decoded once for each place in a group of them at which something may begin."""

    def __init__(self, text: str, at: int, digits: re.Pattern, many: int, few: int):
        self.many, self.few = many, few
        self.at: list[int] = []  # where each part stands in the text, and among the digits
        self.first: list[int] = []
        parts, count = [], 0
        while m := digits.match(text, at):
            self.at.append(m.start())
            self.first.append(count)
            parts.append(m[0])
            count += len(m[0])
            self.end = m.end()
            gap = _GAP.match(text, self.end)
            if not gap:
                break
            at = gap.end()
        self.run = "".join(parts)
        self.known: dict[int, bytes] = {}

    def index(self, place: int) -> int:
        """The number of the digit that stands at a place of the text."""
        k = bisect_right(self.at, place) - 1
        return self.first[k] + place - self.at[k]

    def behind(self, count: int) -> int:
        """The place in the text behind so many digits."""
        k = bisect_left(self.first, count) - 1
        return self.at[k] + count - self.first[k]

    def decoded(self, index: int) -> tuple[bytes, int]:
        """(bytes, start): what a digit and those after it encode."""
        shift = index % self.many
        if shift not in self.known:
            self.known[shift] = _bytes(self.run[shift:], self.many == 4)
        return self.known[shift], index // self.many * self.few


def _bytes(run: str, base64_digits: bool) -> bytes:
    if base64_digits:
        return _decoded(run[: len(run) - (len(run) % 4 == 1)]) or b""
    return bytes.fromhex(run[: len(run) // 2 * 2])


def _wrapped(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of keys in base64 or hex that go over lines or stand within a longer run; a sequence's own length says where it ends.

    Digits are gathered and decoded once, however many keys may begin in them.
    """
    found = []
    taken = sorted(taken)
    for begins, digits, many, few in _BEGINS:
        run: _Digits | None = None
        place = k = until = 0
        for m in begins.finditer(text):
            at = m.start()
            while k < len(taken) and taken[k][0] < at:
                until = max(until, taken[k][1])
                k += 1
            if at < max(place, until) or len(m[0]) == 2 and not _may_begin(_bytes(text[at : at + 16], many == 4)):
                continue
            if not run or at >= run.end:
                run = _Digits(text, at, digits, many, few)
            index = run.index(at)
            data, start = run.decoded(index)
            key = key_at(data, start)
            if key:
                count = index + -(-(key[1] - start) * many // few)
                end = run.behind(min(count, len(run.run)))
                place = _PAD.match(text, end).end() if many == 4 else end
                found.append((at, place))
    return found


def _may_begin(data: bytes) -> bool:
    """A sequence in which an integer of one byte or another sequence comes first."""
    if len(data) < 8 or data[0] != 0x30 or data[1] == 0x80:
        return False
    count = data[1] & 0x7F if data[1] & 0x80 else 0
    first = data[2 + count : 4 + count]
    return count <= 4 and (first[:1] == b"\x30" or first == b"\x02\x01")


def _object(part: str) -> dict | None:
    try:
        value = json.loads(_decoded(part) or b"")
    except (ValueError, RecursionError):  # not JSON, or not text at all
        return None
    return value if isinstance(value, dict) else None


def signed_token(header: str, claims: str, signature: str) -> str | None:
    """The algorithm of a signed token: its header is a JSON object that names one, its claims are an object, and its signature holds a byte at least."""
    head = _object(header)
    if not head or not isinstance(head.get("alg"), str) or _object(claims) is None:
        return None
    return head["alg"] if len(signature) > 1 or head["alg"].lower() == "none" else None


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """All spans (start, kind's place in KINDS, end) in code points, in order; none in a null text."""
    if not text:
        return []
    found: list[tuple[int, int, int]] = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    if "-----BEGIN " in text:
        found += [(start, 3, end) for start, end in _armoured(text)]
    for m in _RUN.finditer(text):
        if (data := _decoded(m[0])) and key_structure(data):
            found.append((m.start(), 4, m.end()))
    for m in _HEX_RUN.finditer(text):
        if len(m[0]) % 2 == 0 and key_structure(bytes.fromhex(m[0])):
            found.append((m.start(), 4, m.end()))
    keys = {a: b for a, k, b in found if k == 4}
    for start, end in _wrapped(text, [(a, b) for a, k, b in found if k > 2]):
        keys[start] = max(end, keys.get(start, 0))  # not also its first line alone
    found = [x for x in found if x[1] != 4] + [(a, 4, b) for a, b in keys.items()]
    if "." in text:
        found += [(m.start(), 5, m.end(3)) for m in _TOKEN.finditer(text) if signed_token(m[1], m[2], m[3])]
    return sorted(set(found))


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(text.as_py())] for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(kind))], ["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<kind, start, end>>) of every row, by start and then kind.

    Whole texts are scanned, one row at a time, in time linear in the text and without a shuffle. A
    null or empty text has no spans; a null id stays; repeated rows give repeated rows;
    other columns don't matter.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        _scanned, f"id {id_type}, spans array<struct<kind string, start bigint, end bigint>>"
    )
    return out.select(F.col("id").alias(id_col), "spans")


def _joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*KINDS[:3]))
    return found.select(
        "doc_id",
        *(of(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
        *(of(k).alias(f"n_{k}") for k in KINDS[3:]),
    )


QUERIES = {"op1_secret_scan": op1_secret_scan}
ORACLE_SQL: dict[str, str] = {}


def digest(spans: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3).encode()).hexdigest()
