"""SentencePiece merge-type encoding by a prefix table, and decoding.

For every prefix of a segment the table stores the one last token that the
prefix's encoding can have.  Candidates come from automaton matches that end
there; a candidate is the one if the token before it (already in the table) and
the candidate pass a pair-compatibility test, that is, if their two strings
joined encode to just these two tokens.  The ids are then recovered backwards.

Two neighbouring characters that stand together in no piece are never joined, so
text is first cut between such pairs.  Segments repeat, so each worker remembers
the ids of recent ones.
"""

from __future__ import annotations

import array
import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, bounded_batches

_BLANK = "▁"
_RUNS = re.compile(f"{_BLANK}*[^{_BLANK}]+|{_BLANK}+")


class Codec:
    """Encodes and decodes like the library's merge-type model at path."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.piece = {i: sp.id_to_piece(i) for i in range(n) if not special[i] and not sp.is_byte(i) and not sp.is_unused(i)}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.id = {p: i for i, p in self.piece.items()}
        self.pairs = {p[k:k + 2] for p in self.id for k in range(len(p) - 1)}
        if {p for p in self.pairs if p[1] == _BLANK} - {_BLANK * 2}:
            raise ValueError("pieces with a blank after a letter are not supported")
        if not {c for p in self.id for c in p} <= set(self.id):
            raise ValueError("every character of a piece must be a piece")
        self.text = [b"" if special[i] else self.piece[i].replace(_BLANK, " ").encode() if i in self.piece else b"" for i in range(n)]
        for value, i in self.byte.items():
            self.text[i] = bytes([value])
        #: When a piece merges: -1 for a character. Its last merge's two halves.
        self.rank = {p: -1 if len(p) == 1 else r for r, p in enumerate(sorted(self.id, key=lambda p: -self.score[p]))}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for p in self.id:
            if len(p) == 1 or self.joined(p) == [p]:
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        self.fits = Memo(lambda pair: self.fit(*pair), 32 << 20)
        self.words = Memo(lambda word: self.segments(word if word[:1] == "\n" else _BLANK + word))
        self.parts = Memo(lambda part: self.segment(part) if part[0] in self.id else [self.byte[b] for b in part.encode()], 64 << 20)

    def joined(self, text: str) -> list[str]:
        """Pieces of a short string by merging the best pair again and again."""
        parts, score = list(text), self.score
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            if len(parts) == 2:
                self.halves[text] = (parts[0], parts[1])
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fit(self, a: str, b: str) -> bool:
        """Whether a and b stay as they are next to each other: merges inside them
        are undone, latest first, and no earlier merge may lead across."""
        rank, limit = self.rank, np.inf
        while True:
            across = rank.get(a + b)
            if across is not None and across < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.halves[a][1]
            else:  # of two equal merges the left one comes first
                limit, b = rb + 0.5, self.halves[b][0]

    def segment(self, text: str) -> list[int]:
        """Ids of characters that all are pieces, by the prefix table."""
        last: list[str | None] = [None] * (len(text) + 1)
        fits = self.fits
        for end, token in self.automaton.iter(text):
            if last[end + 1] is None:
                before = end + 1 - len(token)
                if before:
                    if (left := last[before]) is None:
                        continue
                    if not fits[left, token]:
                        continue
                last[end + 1] = token
        out, at = [], len(text)
        while at:
            token = last[at]
            out.append(self.id[token])
            at -= len(token)
        return out[::-1]

    def segments(self, text: str) -> bytes:
        """Ids (uint16 or uint32) of normalized text, cut where nothing joins."""
        out, start = [], 0
        for k in range(1, len(text) + 1):
            if k == len(text) or text[k - 1:k + 1] not in self.pairs:
                out += self.parts[text[start:k]]
                start = k
        return array.array("H" if len(self.text) <= 65536 else "I", out).tobytes()

    def encode(self, text: str | None) -> np.ndarray:
        """All ids with begin and end; null is an empty text."""
        raw = b""
        if text:
            spread = text.replace("\n", " \n")
            if _BLANK in text or text[0] == " " or "  " in spread:
                raw = b"".join(map(self.segments, _RUNS.findall(_BLANK + text.replace(" ", _BLANK))))
            else:
                raw = b"".join(map(self.words.__getitem__, spread.split(" ")))
        ids = np.frombuffer(raw, np.uint16 if len(self.text) <= 65536 else np.uint32).astype("<u4")
        return np.concatenate([np.array([self.bos], "<u4"), ids, np.array([self.eos], "<u4")])

    def decode(self, ids: np.ndarray) -> bytes:
        """The text in UTF-8: pieces joined, without the blank put before the first."""
        raw = b"".join(map(self.text.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One for each Python worker and file."""
    return Codec(path)


def encode_decode(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of docs.

    Reads doc_id and text; other columns are ignored.  Null text is empty: begin
    and end only.  Null and repeated doc_id are rows like others; an empty table
    gives no rows.  Very long texts take time and memory in proportion to their
    length.  with_ids adds `ids` array<int> and `decoded` string.
    """

    def run(batches):
        c = codec(model_path)
        for batch in batches:
            out = ([], [], [], [], [])
            for text in batch.column(1).to_pylist():
                ids = c.encode(text)
                decoded = c.decode(ids)
                out[0].append(len(ids))
                out[1].append(hashlib.sha256(ids.tobytes()).hexdigest())
                out[2].append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    out[3].append(ids.astype(np.int32))
                    out[4].append(decoded.decode("utf-8", "replace"))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(out[3], pa.list_(pa.int32())), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return bounded_batches(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
