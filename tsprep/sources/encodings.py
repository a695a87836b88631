"""Which encoding a sample of bytes is in, and columns read byte for byte turned into text.

Spark reads a few encodings by itself. Files in others are read as Latin-1, where each byte is one character, and their columns
are decoded afterwards: single-byte encodings by a table of 128 characters, which stays in the JVM, others in Python."""

from __future__ import annotations

import codecs

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Encodings that Spark's CSV reader takes, by Python's names.
SPARK_CHARSETS = {"utf-8": "UTF-8", "utf-8-sig": "UTF-8", "ascii": "UTF-8", "iso8859-1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16-le": "UTF-16LE", "utf-16-be": "UTF-16BE", "utf-32": "UTF-32"}
MARKS = ((codecs.BOM_UTF32_LE, "utf-32"), (codecs.BOM_UTF32_BE, "utf-32"), (codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
#: Double-byte encodings with the ranges that common text decodes to, and the share of other characters that is allowed.
DOUBLE = (("shift_jis", (("぀", "ヿ"),)), ("euc_jp", (("぀", "ヿ"),)), ("euc_kr", (("가", "힣"),)), ("gb18030", (("一", "鿿"),)), ("big5", (("一", "鿿"),)))
#: Bytes that windows-1252 has printable signs for and Latin-1 has not.
ONLY_1252 = frozenset(range(0x80, 0xA0)) - {0x81, 0x8D, 0x8F, 0x90, 0x9D}


def canonical(encoding: str) -> str:
    return codecs.lookup(encoding).name


def wide(encoding: str) -> bool:
    """Whether line ends and quotes are not the bytes they are in ASCII."""
    return canonical(encoding).startswith(("utf-16", "utf-32"))


def single_byte(encoding: str) -> bool:
    pairs = (bytes([a, b]) for a in range(0x81, 0xFF) for b in (0x41, 0xA1))
    return not wide(encoding) and canonical(encoding) not in SPARK_CHARSETS and all(len(p.decode(encoding, "replace")) == 2 for p in pairs)


def decoded(column: Column, encoding: str) -> Column:
    """The text of a column whose characters are the bytes of that encoding."""
    if single_byte(encoding):
        upper = range(0x80, 0x100)
        return F.translate(column, "".join(map(chr, upper)), "".join(bytes([k]).decode(encoding, "replace") for k in upper))

    @F.pandas_udf("string")
    def again(values):
        return values.map(lambda v: v.encode("latin-1").decode(encoding, "replace"), na_action="ignore")

    return again(column)


def _whole(sample: bytes, encoding: str) -> str | None:
    """The sample's text if it is in that encoding but for a character that its end may have cut."""
    try:
        return codecs.getincrementaldecoder(encoding)("strict").decode(sample, False)
    except UnicodeDecodeError:
        return None


def detect(sample: bytes) -> tuple[str, str | None]:
    """(encoding, what was noticed) of the first bytes of a file."""
    if not sample:
        return "utf-8", "The file is empty; utf-8 is assumed."
    for mark, name in MARKS:
        if sample.startswith(mark):
            return name, None
    for name, zeros in (("utf-16-le", sample[1::2].count(0)), ("utf-16-be", sample[::2].count(0))):
        if 3 * zeros >= len(sample) // 2 > 0 and _whole(sample, name) is not None:
            return name, f"Every other byte is zero; read as {name}."
    if sample.isascii():
        return "utf-8", "The sample is plain ASCII; read as utf-8."
    if _whole(sample, "utf-8") is not None:
        return "utf-8", None
    name = _legacy(sample)
    return name, f"The sample is not utf-8; read as {name}."


def _legacy(sample: bytes) -> str:
    high = [b for b in sample if b >= 0x80]
    for name, ranges in DOUBLE:
        text = _whole(sample, name)
        signs = [c for c in text or "" if c >= "Ā"]
        expected = sum(any(a <= c <= b for a, b in ranges) for c in signs)
        least = 0.3 if name in ("shift_jis", "euc_jp") else 0.9
        if len(signs) >= 4 and 2 * len(signs) >= 0.9 * len(high) and expected >= least * len(signs):
            return name
    letters = sum(65 <= b <= 90 or 97 <= b <= 122 for b in sample)
    cyrillic = [b for b in high if b >= 0xC0]
    if 2 * len(cyrillic) >= letters and len(cyrillic) >= 0.8 * len(high) and len(cyrillic) >= 4:
        # Small letters, of which there are most, lie in the lower half of one and in the upper half of the other.
        return "koi8-r" if 2 * sum(b < 0xE0 for b in cyrillic) > len(cyrillic) else "cp1251"
    return "cp1252" if ONLY_1252 & set(high) and not set(high) & (set(range(0x80, 0xA0)) - ONLY_1252) else "latin-1"
