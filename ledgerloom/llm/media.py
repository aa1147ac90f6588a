"""Operator 6: media columns with signature sniffing.

An Aho-Corasick automaton finds the magic bytes of known formats anywhere in a
stored value; format validators then check structure and lengths, so that a
declared type can be corrected and embedded media carved out.
"""

from __future__ import annotations

import bisect
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

# Magic bytes, their offset from the start of the medium, and the media type.
SIGNATURES = (
    (b"RIFF", 0, "audio/wav"),
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"fLaC", 0, "audio/flac"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
)

_PDF_MARK = re.compile(rb"%PDF-|startxref|%%EOF")
_STARTXREF = re.compile(rb"startxref\s+(\d{1,18})")
_XREF = re.compile(rb"\s*(?:xref|\d+\s+\d+\s+obj)")


def _wav(b: bytes, at: int) -> int:
    """Length of the WAV medium at an offset, 0 if its chunks don't hold together."""
    if len(b) < at + 12 or b[at + 8 : at + 12] != b"WAVE":
        return 0
    end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
    if end > len(b):
        return 0
    pos, seen = at + 12, set()
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        seen.add(name)
        pos += 8 + size + size % 2
    return end - at if pos == end and {b"fmt ", b"data"} <= seen else 0


def _png(b: bytes, at: int) -> int:
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        size, name = struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]
        end = pos + 12 + size
        if end > len(b) or (first and name != b"IHDR") or zlib.crc32(b[pos + 4 : end - 4]) != struct.unpack_from(">I", b, end - 4)[0]:
            return 0
        if name == b"IEND":
            return end - at
        pos, first = end, False
    return 0


def _gif(b: bytes, at: int) -> int:
    if len(b) < at + 13:
        return 0
    flags = b[at + 10]
    pos = at + 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0)
    while pos < len(b):
        kind = b[pos]
        if kind == 0x3B:
            return pos + 1 - at
        if kind == 0x21:
            pos += 2
        elif kind == 0x2C and pos + 10 < len(b):
            local = b[pos + 9]
            pos += 11 + (3 * 2 ** ((local & 7) + 1) if local & 128 else 0)
        else:
            return 0
        while pos < len(b) and b[pos]:
            pos += 1 + b[pos]
        pos += 1
    return 0


def _jpeg(b: bytes, at: int) -> int:
    pos = at + 2
    while pos + 2 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        if mark == 0xD9:
            return pos + 2 - at
        if mark == 0xFF:
            pos += 1
            continue
        if pos + 4 > len(b):
            return 0
        size = struct.unpack_from(">H", b, pos + 2)[0]
        if size < 2:
            return 0
        pos += 2 + size
        if mark == 0xDA:
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b) and (b[pos + 1] == 0 or 0xD0 <= b[pos + 1] <= 0xD7):
                pos += 2
            if pos < 0:
                return 0
    return 0


def _bmp(b: bytes, at: int) -> int:
    if len(b) < at + 30:
        return 0
    size, reserved, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    ok = reserved == 0 and header in (12, 40, 52, 56, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= size
    return size if ok and at + size <= len(b) else 0


def _flac(b: bytes, at: int) -> int:
    pos, last, first = at + 4, False, True
    while not last and pos + 4 <= len(b):
        last, kind, size = b[pos] >> 7, b[pos] & 127, int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (kind or size != 34):
            return 0
        pos, first = pos + 4 + size, False
    return len(b) - at if last and pos + 2 <= len(b) and b[pos] == 0xFF and b[pos + 1] >> 2 == 0x3E else 0


def _ogg(b: bytes, at: int, memo: dict) -> int:
    """To the page that ends the stream. Pages lead to the same end wherever the walk began, so ends are kept by place."""
    pos, walked, end = at, [], -1
    while ("ogg", pos) not in memo:
        walked.append(pos)
        if pos + 27 > len(b) or b[pos : pos + 4] != b"OggS" or b[pos + 4]:
            break
        n = b[pos + 26]
        stop = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if stop > len(b):
            break
        if b[pos + 5] & 4:
            end = stop
            break
        pos = stop
    else:
        end = memo["ogg", pos]
    memo.update((("ogg", p), end) for p in walked)
    return end - at if end > 0 else 0


def _mp4(b: bytes, at: int, memo: dict) -> int:
    """As many boxes as follow one another, media among them; what follows a place is kept, as for pages."""
    pos, walked = at, []
    while ("mp4", pos) not in memo:
        size, name = (struct.unpack_from(">I", b, pos)[0], b[pos + 4 : pos + 8]) if pos + 8 <= len(b) else (0, b"")
        if size < 8 or pos + size > len(b) or not name.isalnum():
            memo["mp4", pos] = (pos, 0, False)
            break
        walked.append((pos, name))
        pos += size
    for p, name in reversed(walked):
        end, boxes, media = memo["mp4", pos]
        memo["mp4", p], pos = (end, boxes + 1, media or name in (b"moov", b"mdat", b"moof")), p
    end, boxes, media = memo["mp4", at]
    return end - at if boxes > 1 and media and b[at + 4 : at + 8] == b"ftyp" else 0


class _Sections:
    """A value's PDF headers and the sections that end with %%EOF behind a startxref of their own."""

    def __init__(self, b: bytes) -> None:
        self.heads, self.sections, last, mark = [], [], 0, -1  # (end, startxref, end of the %%EOF before)
        for m in _PDF_MARK.finditer(b):
            if m[0] == b"%PDF-":
                self.heads.append(m.start())
            elif m[0] == b"startxref":
                mark = m.start()
            else:
                if mark >= last:
                    self.sections.append((m.end(), mark, last))
                last, mark = m.end(), -1
        self.marks = [x[1] for x in self.sections]
        leads = ((int(m[1]), i) for i, k in enumerate(self.marks) if (m := _STARTXREF.match(b, k)))
        self.leads = sorted(leads)  # offsets that sections lead to


def _pdf(b: bytes, at: int, memo: dict) -> int:
    """To the last %%EOF that follows its own startxref: linearized files and saved revisions have several.

    Behind the header of another PDF, only a section counts whose startxref leads to a place of this one behind that header.
    Sections up to that header belong to this PDF alone; of those behind it only such that lead far enough are looked at.
    """
    if "pdf" not in memo:
        memo["pdf"] = _Sections(b)
    found: _Sections = memo["pdf"]
    length = 0
    for i in range(bisect.bisect_left(found.marks, at), len(found.sections)):
        end, mark, last = found.sections[i]
        k = bisect.bisect_left(found.heads, max(last, at + 5))
        if k < len(found.heads) and found.heads[k] < mark:
            other = found.heads[k]
            if length and not b[at + length : other].strip():
                return length
            behind = found.leads[bisect.bisect_right(found.leads, (other - at, len(found.marks))) :]
            own = [j for m, j in behind if j >= i and at + m < found.marks[j] and _XREF.match(b, at + m)]
            return found.sections[max(own)][0] - at if own else length or end - at
        length = end - at
    return length


def _zip(b: bytes, at: int, memo: dict) -> int:
    if "zip" not in memo:
        memo["zip"] = [m.start() for m in re.finditer(rb"PK\x05\x06", b)]
    k = bisect.bisect_left(memo["zip"], at)
    if k == len(memo["zip"]) or len(b) < memo["zip"][k] + 22:
        return 0
    end = memo["zip"][k]
    size, start, note = struct.unpack_from("<IIH", b, end + 12)
    return end + 22 + note - at if at + start + size == end and end + 22 + note <= len(b) else 0


def _gzip(b: bytes, at: int, memo: dict) -> int:
    """One member: its header, whose names end with a zero byte, the deflated data, and their checksum and length."""
    if len(b) < at + 18 or b[at + 3] & 0xE0:
        return 0
    flags, pos = b[at + 3], at + 10
    if flags & 4:
        pos += 2 + struct.unpack_from("<H", b, pos)[0]
    for _ in range(bool(flags & 8) + bool(flags & 16)):
        since, zero = memo.get("zero", (0, -1))
        if not since <= pos <= zero:
            zero = b.find(b"\0", pos)
            memo["zero"] = since, zero = pos, len(b) if zero < 0 else zero
        pos = zero + 1
    pos += 2 * bool(flags & 2)
    d, view, crc, size = zlib.decompressobj(-15), memoryview(b), 0, 0
    try:
        while pos < len(b) and not d.eof:
            piece = view[pos : pos + (1 << 14)]
            pos += len(piece)
            while len(piece) and not d.eof:
                out = d.decompress(piece, 1 << 16)
                crc, size, piece = zlib.crc32(out, crc), size + len(out), d.unconsumed_tail
    except zlib.error:
        return 0
    end = pos - len(d.unused_data) + 8
    return end - at if d.eof and end <= len(b) and struct.unpack_from("<II", b, end - 8) == (crc, size & 0xFFFFFFFF) else 0


#: Those that take a memo read places that several media of a value may share; it is kept for one value.
VALIDATORS = {
    "audio/wav": _wav, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "audio/flac": _flac,
    "audio/ogg": _ogg, "video/mp4": _mp4, "application/pdf": _pdf, "application/zip": _zip, "application/gzip": _gzip,
}


WITH_MEMO = frozenset({"audio/ogg", "video/mp4", "application/pdf", "application/zip", "application/gzip"})


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for magic, offset, kind in SIGNATURES:
        a.add_word(magic.decode("latin-1"), (len(magic) + offset, kind))
    a.make_automaton()
    return a


def sniff(b: bytes, a: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, length, type) of every confirmed medium, outermost first; those inside another one are kept too."""
    out, memo = [], {}
    for end, (back, kind) in a.iter(b.decode("latin-1")):
        at = end + 1 - back
        if at >= 0 and (n := VALIDATORS[kind](b, at, memo) if kind in WITH_MEMO else VALIDATORS[kind](b, at)):
            out.append((at, n, kind))
    return sorted(set(out), key=lambda x: (x[0], -x[1]))


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """payload as the samples of a mono 8-bit PCM WAV file."""
    pad = len(payload) % 2
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(payload)) + payload + b"\0" * pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + len(data), b"WAVE") + fmt + data


def wav_samples(b: bytes, at: int = 0) -> bytes:
    """The samples of the WAV medium at an offset of b."""
    end, pos = at + 8 + struct.unpack_from("<I", b, at + 4)[0], at + 12
    while pos + 8 <= end:
        name, size = b[pos : pos + 4], struct.unpack_from("<I", b, pos + 4)[0]
        if name == b"data":
            return b[pos + 8 : pos + 8 + size]
        pos += 8 + size + size % 2
    raise ValueError("no data chunk")


SNIFF_SCHEMA = "declared string, sniffed string, corrected boolean, media array<struct<start:long,length:long,type:string,sha256:string>>"


def sniff_media(blobs: DataFrame, blob_col: str = "blob", declared_col: str | None = "declared", keep: tuple[str, ...] = (), carve: bool = False) -> DataFrame:
    """One row per row of blobs: the keep columns, declared, sniffed, corrected and media (and carved, the bytes).

    sniffed is the type of the medium that starts at byte 0, else the declared
    type if no medium starts there; corrected tells whether the two differ.
    media lists every confirmed medium with its place, length and hash.  Null
    and empty blobs have no media and keep their declared type; a null declared
    type counts as unknown and is corrected by any medium at byte 0.  Columns
    outside keep are not read.
    """
    small_batches(blobs.sparkSession)
    clash = {"declared", "sniffed", "corrected", "media", "carved"} & {c.lower() for c in keep}
    if clash:
        raise ValueError(f"keep clashes with result columns: {sorted(clash)}")
    cols = [F.col(c) for c in keep] + [F.col(blob_col).alias("__blob"), (F.col(declared_col) if declared_col else F.lit(None)).cast("string").alias("__declared")]
    src = blobs.select(*cols)
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)]]
    schema = ", ".join([*kept, SNIFF_SCHEMA] + ["carved array<binary>"] * carve)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a = automaton()
        for pdf in batches:
            got = []
            for blob, declared in zip(pdf["__blob"], pdf["__declared"], strict=True):
                b = bytes(blob or b"")
                found = sniff(b, a) if b else []
                head = next((k for at, _, k in found if at == 0), declared)
                got.append((declared, head, bool(head != declared), [{"start": s, "length": n, "type": k, "sha256": hashlib.sha256(b[s : s + n]).hexdigest()} for s, n, k in found], [b[s : s + n] for s, n, _ in found]))
            out = pdf[list(keep)].copy()
            for i, name in enumerate(["declared", "sniffed", "corrected", "media"] + ["carved"] * carve):
                out[name] = [g[i] for g in got]
            yield out

    return src.mapInPandas(run, schema)


def _le32(n: Column) -> Column:
    """Four bytes, the lowest first."""
    h = F.lpad(F.hex(n.cast("long")), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, k, 2) for k in (7, 5, 3, 1))))


def stored_wav(payload: Column) -> Column:
    """to_wav of an even number of bytes, as a column."""
    n = F.octet_length(payload)
    frame = to_wav(b"")
    return F.concat(F.lit(frame[:4]), _le32(n + len(frame) - 8), F.lit(frame[8:-4]), _le32(n), payload)


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts stored as WAV samples under a wrong declared type, sniffed, carved by sniff_media and read back.

    Null texts are empty; rows equal in text have equal values in all but the
    id; repeated rows stay, extra columns are not read, an empty table gives an
    empty result.  feature tells what was declared and found, and lists every
    medium embedded in the text with its place, length and hash.
    """
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "utf-8")
    blobs = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(raw).cast("long").alias("n_bytes"), raw.alias("raw"))
    full = F.greatest(F.lit(64), F.ceil(F.col("n_bytes") / 64).cast("int") * 64)
    blobs = blobs.withColumns({"blob": stored_wav(F.rpad("raw", full, F.lit(b"\0"))), "declared": F.lit("application/octet-stream")})
    found = sniff_media(blobs, keep=("doc_id", "n_bytes"), carve=True)
    frame = len(to_wav(b""))
    payload, medium = F.expr(f"substring(carved[0], {frame + 1})"), F.col("media")[0]
    inner = F.transform(F.slice("media", 2, F.greatest(F.size("media") - 1, F.lit(0))), lambda m: F.concat(m["type"], F.lit("@"), m["start"], F.lit("+"), m["length"], F.lit(":"), m["sha256"]))
    return found.select(
        "doc_id", "n_bytes", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.expr("substring(carved[0], -64)")).alias("tail_crc32"),
        medium["length"].alias("media_bytes"), medium["sha256"].alias("media_sha256"),
        F.concat(F.lit("declared="), "declared", F.lit(";sniffed="), "sniffed", F.lit(";at="), medium["start"], F.lit(";length="), medium["length"], F.lit(";embedded=["), F.array_join(inner, ";"), F.lit("]")).alias("feature"),
    )


def op6_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as media, sniffed and carved."""
    return media_digest(table(spark, sf_dir, "documents"))


QUERIES = {"op6_signature_sniffing": op6_signature_sniffing}
#: The feature is that of a text without an embedded medium; a text that held one would differ, which the tests cover.
ORACLE_SQL = {
    "op6_signature_sniffing": """
WITH crc AS (SELECT list(c ORDER BY n) AS tab FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) t(n))),
d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
p AS (SELECT doc_id, octet_length(raw)::BIGINT AS n, greatest(64, (octet_length(raw) + 63) // 64 * 64)::BIGINT AS m, hex(raw) AS h FROM d),
q AS (SELECT doc_id, n, m, rpad(h, (2 * m)::INTEGER, '0') AS h, lpad(to_hex(m + 36), 8, '0') AS a, lpad(to_hex(m), 8, '0') AS b FROM p),
r AS (SELECT doc_id, n, m, h, '52494646' || a[7:8] || a[5:6] || a[3:4] || a[1:2] || '57415645666D74201000000001000100401F0000401F00000100080064617461' || b[7:8] || b[5:6] || b[3:4] || b[1:2] || h AS w,
  list_transform(regexp_extract_all(right(h, 128), '..'), lambda x: ((instr('0123456789ABCDEF', x[1]) - 1) * 16 + instr('0123456789ABCDEF', x[2]) - 1)::BIGINT) AS tail FROM q)
SELECT doc_id, n AS n_bytes, m AS payload_bytes, sha256(unhex(h)) AS payload_sha256, xor(list_reduce(list_prepend(4294967295, tail), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) AS tail_crc32,
  m + 44 AS media_bytes, sha256(unhex(w)) AS media_sha256, 'declared=application/octet-stream;sniffed=audio/wav;at=0;length=' || (m + 44) || ';embedded=[]' AS feature FROM r, crc
""",
}
