"""Logger exports as lines of bytes.

A line is held as text in which every character stands for one byte (ISO-8859-1).
That loses nothing, whatever the real encoding, and lets large files be split
between tasks. Lines: file, block, seq, raw. ``block`` is the offset of the split
in its file and ``seq`` grows inside it, so (block, seq) is the order of the file.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Encodings by the names users give them, and Java's names.
CHARSETS = {
    "utf-8-sig": "UTF-8", "utf-8": "UTF-8", "cp932": "windows-31j", "shift_jis": "Shift_JIS",
    "euc_jp": "EUC-JP", "latin-1": "ISO-8859-1", "utf-16": "UTF-16",
}
BYTES = "ISO-8859-1"
SEQ_BITS = 33


@contextmanager
def java_charsets(spark: SparkSession) -> Iterator[None]:
    """Lets ``decode`` know Japanese encodings and replace bad bytes.

    Frames built inside keep that when they run later.
    """
    names = ("spark.sql.legacy.javaCharsets", "spark.sql.legacy.codingErrorAction")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "true")
        yield
    finally:
        for n, v in before.items():
            if v is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, v)


def byte_text(text: Column) -> Column:
    """A string as the byte text its UTF-8 form has in a file."""
    return F.decode(F.encode(text, "UTF-8"), BYTES)


def plain_path(uri: Column) -> Column:
    """A path as listings have it: no escapes."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def read_lines(spark: SparkSession, paths: Sequence[str] | str, breaks: str | None = None, faults: bool = False) -> DataFrame:
    """Lines of text files, split between tasks, blank ones among them. Lines end at line feeds and carriage returns, or at
    ``breaks`` alone. With ``faults`` what cannot be read is left out, for the reader to find out."""
    read = spark.read
    if breaks is not None:
        read = read.option("lineSep", breaks)
    if faults:
        read = read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return read.text(paths).select(
        plain_path(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.decode(F.col("value").cast("binary"), BYTES).alias("raw"))


def row_no(block: str = "block", seq: str = "seq") -> Column:
    """(block, seq) as one number in the order of the file; splits are at least a megabyte apart."""
    return F.shiftleft(F.shiftright(F.col(block), 20), SEQ_BITS) + F.col(seq).bitwiseAND(F.lit((1 << SEQ_BITS) - 1))


def decode_line(raw: str = "raw", encoding: str = "encoding", known: Sequence[str] = tuple(CHARSETS)) -> Column:
    """Byte text read in its file's encoding, without a byte-order mark. To be used under :func:`java_charsets`."""
    data = F.encode(raw, BYTES)
    out = F.col(raw)
    for name in known:
        # UTF-16 files come as the bytes of their UTF-8 form
        charset = CHARSETS[name] if name != "utf-16" else "UTF-8"
        if charset != BYTES:
            out = F.when(F.col(encoding) == name, F.decode(data, charset)).otherwise(out)
    return F.regexp_replace(out, "^\\uFEFF", "")


def encoding_tests(raw: str = "raw", candidates: Sequence[str] = tuple(CHARSETS)) -> dict[str, Column]:
    """Per candidate, whether a line's bytes are valid in it. To be used under :func:`java_charsets`."""
    data = F.encode(raw, BYTES)
    ascii_only = ~F.col(raw).rlike(r"[^\x00-\x7f]")
    tests = {}
    for name in candidates:
        charset = CHARSETS[name]
        if name == "utf-16":
            tests[name] = F.lit(False)
        elif charset == BYTES:
            tests[name] = F.lit(True)
        elif charset == "UTF-8":
            tests[name] = ascii_only | F.is_valid_utf8(data.cast("string"))
        else:
            tests[name] = ascii_only | ~F.decode(data, charset).contains("\ufffd")
    return tests
