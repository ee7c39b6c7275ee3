"""SentencePiece ids by a streaming Viterbi search over a model file's pieces, and their decoding.

The best path maximises the sum of the pieces' scores in the model file; among equal sums the path whose last piece
is longest. A character without any piece is written as its UTF-8 bytes, at a score below every piece. The search
keeps a window only: a start position is settled once ``longest`` characters after it are known, and ids are committed
as soon as all surviving backpointer paths run through one boundary, which is looked for after each chunk. In periodic
text paths may stay apart to its end (each remainder of the period has its own). Its scores are still those of a bounded
window; its back pointers wait, two bytes for a character, and are traced once.

Where no piece holds the blank sign but at its start, every blank is such a boundary. The words between blanks are
then independent, and a worker remembers the ids of those met lately.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, kept_by_worker

BLANK = "▁"
FEED = 256
CACHE_WORDS = 400_000
LONGEST_REMEMBERED = 64
NOT_SEARCHED = -1e8  # some models mark runs of blanks by such a score: not searched, but for the single blank


class Pieces:
    """The searchable pieces of a model: every prefix of a piece maps to the piece's id, or to -1 where it is none itself."""

    def __init__(self, pieces: Iterable[tuple[int, str, float]], byte_ids: dict[int, int]) -> None:
        self.prefixes: dict[str, int] = {}
        self.scores: dict[int, float] = {}
        self.decoded = {i: bytes([b]) for b, i in byte_ids.items()}
        self.byte_ids = byte_ids
        pieces = list(pieces)
        self.unknown = min((s for *_, s in pieces if s > NOT_SEARCHED), default=0.0) - 10.0
        for id_, piece, score in pieces:
            self.decoded[id_] = piece.replace(BLANK, " ").encode()
            if score > NOT_SEARCHED or len(piece) == 1:
                self.scores[id_] = score if score > NOT_SEARCHED else self.unknown
                self.prefixes[piece] = id_
                for n in range(1, len(piece)):
                    self.prefixes.setdefault(piece[:n], -1)
        self.longest = max(map(len, self.prefixes), default=1)
        self.splits_at_blanks = not any(BLANK in p[1:] for p in self.prefixes)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def from_file(cls, path: str) -> Pieces:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        all_ids = range(m.get_piece_size())
        plain = [i for i in all_ids if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        return cls(((i, m.id_to_piece(i), m.get_score(i)) for i in plain), {int(m.id_to_piece(i)[3:5], 16): i for i in all_ids if m.is_byte(i)})

    def _path(self, text: str, lengths: array | list[int], stop: int) -> list[int]:
        """Ids of the best path to ``stop``."""
        out: list[int] = []
        while stop:
            start = stop - lengths[stop]
            id_ = self.prefixes.get(text[start:stop], -1)
            if id_ >= 0:
                out.append(id_)
            else:
                out += [self.byte_ids[b] for b in reversed(text[start:stop].encode("utf-8", "replace"))]
            stop = start
        out.reverse()
        return out

    @staticmethod
    def _meeting(lengths: array, live: set[int], least: int) -> int:
        """The last boundary that the paths to all of ``live`` share; 0 if that lies before ``least``."""
        while len(live) > 1:
            live.remove(most := max(live))
            if most < least:
                return 0
            live.add(most - lengths[most])
        return live.pop()

    def stream(self, chunks: Iterable[str]) -> Iterator[list[int]]:
        """Ids of a text that comes in pieces, in order, each list as soon as its ids are certain.

        Holds scores of ``longest`` places, and of what is not certain yet the characters and one small number for each
        (the length of the best piece that ends there). Paths are followed back over ``4 * longest`` characters and a
        chunk at most, and once from the end, so the time is linear also where they never meet.
        """
        prefixes, scores, longest, unknown = self.prefixes, self.scores, self.longest, self.unknown
        text, past, before = "", [], 0  # settled parts since the last commit and their length; what is ahead
        score, lengths = [0.0], array("H", [0])  # from the first place ahead on; from the last commit on

        def settle(stop: int) -> None:
            nonlocal text, before
            n = len(text)
            for i in range(stop):
                base, j = score[i], i + 1
                id_ = prefixes.get(text[i], -2)
                candidate = base + (scores[id_] if id_ >= 0 else unknown)
                if j == len(score):
                    score.append(candidate)
                    lengths.append(1)
                elif candidate > score[j]:
                    score[j], lengths[before + j] = candidate, 1
                while id_ != -2 and j < n:
                    j += 1
                    id_ = prefixes.get(text[i:j], -2)
                    if id_ >= 0:
                        candidate = base + scores[id_]
                        while j > len(score):  # not reached yet by any piece
                            score.append(-np.inf)
                            lengths.append(0)
                        if j == len(score):
                            score.append(candidate)
                            lengths.append(j - i)
                        elif candidate > score[j]:
                            score[j], lengths[before + j] = candidate, j - i
            if stop > 0:
                past.append(text[:stop])
                text, before = text[stop:], before + stop
                del score[:stop]

        def certain(chunk: int) -> list[int]:
            """Commits up to where all surviving paths meet."""
            nonlocal past, before, lengths
            live = {before + k for k, x in enumerate(score) if x > -np.inf}  # a place not reached yet will be from these
            cut = self._meeting(lengths, live, before - 4 * longest - chunk)
            if not cut:
                return []
            whole = "".join(past)
            out = self._path(whole, lengths, cut)
            past, before, lengths = [whole[cut:]], before - cut, array("H", [0]) + lengths[cut + 1 :]
            return out

        for chunk in chunks:
            text += chunk
            settle(len(text) - longest + 1)
            if before and (ids := certain(len(chunk))):
                yield ids
        settle(len(text))
        if before:
            yield self._path("".join(past), lengths, before)

    def _short(self, text: str) -> list[int]:
        """The same for a text of one chunk: all of it is the window, so there is nothing to commit before its end."""
        get, scores, unknown, n = self.prefixes.get, self.scores, self.unknown, len(text)
        score, lengths = [0.0] + [-np.inf] * n, [0] * (n + 1)
        for i in range(n):
            base, j = score[i], i + 1
            id_ = get(text[i], -2)
            candidate = base + (scores[id_] if id_ >= 0 else unknown)
            if candidate > score[j]:
                score[j], lengths[j] = candidate, 1
            while id_ != -2 and j < n:
                j += 1
                id_ = get(text[i:j], -2)
                if id_ >= 0 and (candidate := base + scores[id_]) > score[j]:
                    score[j], lengths[j] = candidate, j - i
        return self._path(text, lengths, n)

    def search(self, text: str) -> list[int]:
        if len(text) <= FEED:
            return self._short(text)
        return [i for ids in self.stream(text[at : at + FEED] for at in range(0, len(text), FEED)) for i in ids]

    def _word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = np.array(self.search(BLANK + word), dtype=np.int32).tobytes()
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.new) >= CACHE_WORDS:
                self.old = self.new.copy()
                self.new.clear()
            self.new[word] = found
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text: a blank is put before it, blanks are written as the blank sign. An empty text has none."""
        if not text:
            return np.empty(0, dtype=np.int32)
        if not self.splits_at_blanks:
            return np.array(self.search(BLANK + text.replace(" ", BLANK)), dtype=np.int32)
        known = self.new
        return np.frombuffer(b"".join([known.get(w) or self._word(w) for w in text.replace(BLANK, " ").split(" ")]), dtype=np.int32)

    def decode(self, ids: Iterable[int]) -> str:
        """The text; without the blank that encoding put before it."""
        d = self.decoded
        return b"".join([d[i] for i in ids]).decode("utf-8", "replace").removeprefix(" ")


def pieces(path: str) -> Pieces:
    """A worker's model; what it remembers serves all its tasks."""
    return kept_by_worker(("pieces", path), lambda: Pieces.from_file(path))


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids, n_tokens, text``: ids of every whole text and the text decoded from them again.

    One row per input row, also where rows repeat; texts of any length are encoded whole. A null text is empty and has no ids; the blank sign itself (U+2581) counts as a blank, so
    the decoded text has a blank for it; every other text comes back exactly. An empty table gives no rows. Map only:
    nothing is shuffled.
    """
    return _encoded(docs, model_path, id_col, text_col, False)


def encoding_report(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_crc32`` (of little-endian 32-bit ids), ``decoded_sha256`` and ``exact``: whether decoding gave the text back."""
    return _encoded(docs, model_path, id_col, text_col, True)


def _encoded(docs: DataFrame, model_path: str, id_col: str, text_col: str, report: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(model_path)
        for b in batches:
            for at in range(0, b.num_rows, 256):  # a few texts at a time, however wide the batch is
                part = b.slice(at, 256)
                texts = [x.as_py() for x in part.column("text")]
                ids = [model.encode(t) for t in texts]
                decoded = [model.decode(x.tolist()) for x in ids]
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array([len(x) for x in ids], pa.int64())}
                if report:
                    columns |= {
                        "ids_crc32": pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        "decoded_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                        "exact": pa.array([x == y for x, y in zip(texts, decoded, strict=True)], pa.bool_()),
                    }
                else:
                    columns |= {"ids": pa.array(ids, pa.list_(pa.int32())), "text": pa.array(decoded, pa.string())}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    plain = documents_of(docs, id_col, text_col)
    rest = "ids_crc32 long, decoded_sha256 string, exact boolean" if report else "ids array<int>, text string"
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, n_tokens long, {rest}")
