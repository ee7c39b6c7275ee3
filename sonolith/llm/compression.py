"""Quality rules by compression bands: a text is judged by how well zstandard packs it, whole and in fixed chunks.

Prose of a given length packs within a narrow band: repeated text packs better, random characters and encoded bytes
worse. The band depends on the length, because a short text gives the compressor little to refer back to. A document
is rejected if the ratio of the whole lies outside the band of its length, or if chunks outside the bands of theirs
hold more than ``most_bad`` of its bytes: such passages vanish in the ratio of a long text.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import documents_of

#: (bytes up to which the band holds, least ratio, largest ratio); the last one holds for all longer texts. Prose in
#: alphabetic scripts lies between 1.3 and 1.9 at half a kilobyte and between 2.3 and 2.6 at 32 kilobytes; a tenth to
#: a sixth is left on either side. Base64 reaches 1.33 at any length.
BANDS = ((256, 0.8, 2.0), (512, 1.1, 2.1), (1024, 1.2, 2.25), (2048, 1.4, 2.45), (4096, 1.5, 2.55), (8192, 1.5, 2.7), (16384, 1.5, 2.85), (32768, 1.5, 3.0), (None, 1.5, 3.4))
CHUNK = 4096
MOST_BAD = 0.25
LEVEL = 3
_SYMBOLS = bytes(set(range(256)) - set(b"#*$%&|<>"))


def repeated_words(words: Sequence[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which occurs twice or more, its first occurrence included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), dtype=np.int64, count=len(words))
    windows = ids[:n]
    for k in range(1, width):  # numbered anew after each word, so that products stay below the square of the length
        windows = np.unique(windows * len(numbers) + ids[k : k + n], return_inverse=True)[1]
    again = np.bincount(windows)[windows] > 1
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def ratio(data: bytes, packer: zstandard.ZstdCompressor) -> float:
    """Bytes before packing over bytes after it; 1 for no bytes."""
    return len(data) / len(packer.compress(data)) if data else 1.0


def inside(n_bytes: int, found: float, bands: Sequence[tuple] = BANDS) -> bool:
    _, least, most = bands[bisect_left([b[0] for b in bands[:-1]], n_bytes)]
    return least <= found <= most


def measures(text: str | None, packer: zstandard.ZstdCompressor, bands: Sequence[tuple] = BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD) -> dict:
    """Counts of the base rule, the ratio of the whole, the share of bytes in chunks outside their band, and the verdict."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()  # bytes: white space is 0x20 and 0x09 to 0x0D only
    lines = [x for x in data.split(b"\n") if x.strip()]
    again, whole = repeated_words(words), ratio(data, packer)
    bad = sum(len(part) for at in range(0, len(data), chunk) if not inside(len(part := data[at : at + chunk]), ratio(part, packer), bands))
    failed = len(words) < 50 or 100 * again > 50 * len(words)
    return {
        "n_words": len(words),
        "word_chars": len(b"".join(words).decode("utf-8", "surrogatepass")),
        "n_symbols": len(data.translate(None, _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": again,
        "base_failed": failed,
        "kept": not failed and inside(len(data), whole, bands) and bad <= most_bad * len(data),
        "ratio": whole,
        "bad_chunks": bad / len(data) if data else 0.0,
    }


_TYPES = {**dict.fromkeys(["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"], "long"), **dict.fromkeys(["base_failed", "kept"], "boolean"), **dict.fromkeys(["ratio", "bad_chunks"], "double")}
_ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Sequence[tuple] = BANDS, chunk: int = CHUNK, most_bad: float = MOST_BAD) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_chunks``: one row per input row.

    Null and empty texts have no words, fail the base rule, and have a ratio of 1. Repeated rows and ids are judged one
    by one, texts of any length as a whole. Other columns are not read. An empty table gives no rows. Map only: nothing
    is shuffled, and a task holds one text and its words at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=LEVEL)
        for b in batches:
            found = [measures(x.as_py(), packer, bands, chunk, most_bad) for x in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), *(pa.array([f[c] for f in found], _ARROW[kind]) for c, kind in _TYPES.items())], names=["doc_id", *_TYPES])

    plain = documents_of(docs, id_col, text_col)
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, {', '.join(map(' '.join, _TYPES.items()))}")
