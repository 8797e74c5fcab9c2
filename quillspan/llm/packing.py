"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

The dot-product heuristic fills one bin at a time: of the examples that fit, it places the one whose size vector has
the largest dot product with what the bin has left, both as shares of the limits. Where pieces may be cut, the gap that
no whole example fits is filled with the beginning of one, so that bins end full; the last bin of a task is divided into
sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillspan.llm.common import sliced


@dataclass(frozen=True)
class Limits:
    """Of one sequence. pool: how many examples wait at most before bins are filled (memory, not quality, bounds it)."""

    tokens: int = 2048
    segments: int = 64
    loss: int = 2048
    pool: int = 2048


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    loss: int
    sequence: int
    offset: int


class VectorPacker:
    """Takes examples (number, tokens, loss-bearing tokens) and yields pieces; memory is bounded by the pool."""

    def __init__(self, limits: Limits = Limits(), cut: bool = True):
        if min(limits.tokens, limits.segments, limits.loss, limits.pool) < 1:
            raise ValueError("every limit must be at least 1")
        self.limits, self.cut, self.sequences = limits, cut, 0
        size = 2 * limits.pool + 2
        self.example, self.start = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.length, self.loss = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.n = 0

    def _push(self, example: int, start: int, length: int, loss: int) -> None:
        k = self.n
        self.example[k], self.start[k], self.length[k], self.loss[k] = example, start, length, loss
        self.n += 1

    def _pop(self, k: int) -> tuple[int, int, int, int]:
        out = int(self.example[k]), int(self.start[k]), int(self.length[k]), int(self.loss[k])
        self.n -= 1
        for column in (self.example, self.start, self.length, self.loss):
            column[k] = column[self.n]
        return out

    def add(self, example: int, tokens: int, loss: int | None = None) -> Iterator[Piece]:
        """loss: its loss-bearing tokens, which are its last ones (None: all)."""
        loss = tokens if loss is None else loss
        if not 0 <= loss <= tokens:
            raise ValueError("loss-bearing tokens must lie between 0 and the tokens")
        most = min(self.limits.tokens, self.limits.loss)
        start = 0
        if tokens > self.limits.tokens or loss > self.limits.loss:
            if not self.cut:
                raise ValueError("an example is longer than the limits and may not be cut")
            while tokens - start > most:
                here = self._loss_in(tokens, loss, start, most)
                yield Piece(example, start, most, here, self.sequences, 0)
                self.sequences += 1
                start += most
        if tokens > start:
            self._push(example, start, tokens - start, min(loss, tokens - start))
        if self.n >= 2 * self.limits.pool:
            while self.n > self.limits.pool:
                yield from self._fill()

    @staticmethod
    def _loss_in(tokens: int, loss: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, tokens - loss))

    def _choose(self, left: np.ndarray) -> int:
        """The example that fits and has the largest dot product with what is left; the earliest pushed on ties."""
        length, loss = self.length[: self.n], self.loss[: self.n]
        fits = (length <= left[0]) & (loss <= left[2])
        if not fits.any():
            return -1
        t, s, b = self.limits.tokens, self.limits.segments, self.limits.loss
        value = length * (left[0] / t / t) + left[1] / s / s + loss * (left[2] / b / b)
        return int(np.argmax(np.where(fits, value, -1.0)))

    def _fill(self) -> Iterator[Piece]:
        left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.int64)
        at = 0
        while self.n and left.min() > 0:
            k = -1
            if not (self.cut and left[1] == 1 and self.length[: self.n].max() >= left[0]):
                k = self._choose(left)
            if k >= 0:
                example, start, length, loss = self._pop(k)
            elif self.cut:
                # The beginning of the longest one fills the gap; its rest goes back.
                k = int(np.argmax(self.length[: self.n]))
                example, start, whole, all_loss = self._pop(k)
                free = whole - all_loss  # what bears no loss comes first
                length = min(whole, int(left[0]), free + int(left[2]))
                loss = max(0, length - free)
                if whole > length:
                    self._push(example, start + length, whole - length, min(all_loss, whole - length))
            else:
                break
            yield Piece(example, start, length, loss, self.sequences, at)
            at += length
            left -= (length, 1, loss)
        self.sequences += 1

    def finish(self) -> Iterator[Piece]:
        while self.n and (not self.cut or self.length[: self.n].sum() >= self.limits.tokens):
            yield from self._fill()
        while self.n:
            # What is left is less than one sequence: lengths are powers of two where the limits allow.
            size = 1 << (int(self.length[: self.n].sum()).bit_length() - 1)
            at = loss = 0
            parts: list[list[int]] = []
            while self.n and at < size and len(parts) < self.limits.segments and loss < self.limits.loss:
                k = int(np.argmax(self.length[: self.n]))
                example, start, whole, all_loss = self._pop(k)
                free = whole - all_loss  # what bears no loss comes first
                length = min(whole, size - at, free + self.limits.loss - loss)
                parts.append([example, start, length, max(0, length - free)])
                if whole > length:
                    self._push(example, start + length, whole - length, min(all_loss, whole - length))
                at += length
                loss += parts[-1][3]
            extra = at - (1 << (at.bit_length() - 1))
            while extra:
                # A limit ended the sequence early: its end goes back, down to a power of two.
                example, start, length, own = parts.pop()
                back = min(extra, length)
                extra -= back
                self._push(example, start + length - back, back, min(own, back))
                if length > back:
                    parts.append([example, start, length - back, max(0, own - back)])
            at = 0
            for example, start, length, own in parts:
                yield Piece(example, start, length, own, self.sequences, at)
                at += length
            self.sequences += 1


class WordTokenizer:
    """Token ids by a vocabulary file whose pre-tokenizer never joins what white space parts.

    Words are coded once each and kept in a bounded table. Where the file has the usual steps (NFC, white space as one
    space, lower case; a pattern, then byte-level characters), plain words are cut into the pattern's pieces here and
    only new pieces go to the model; all other words go through the whole tokenizer. Texts in which Python's white space
    differs from the tokenizer's are coded whole.
    """

    ODD = ("\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str, keep: int = 700_000):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.known, self.pieces = keep, {}, {}
        told = json.loads(self.tokenizer.to_str())
        # Texts that hold a token added to the vocabulary are coded whole, as it may join or part words.
        self.added = tuple(x["content"].lower() for x in told.get("added_tokens") or ())
        self.hint = "" if not self.added else self.added[0][:1] if len({x[:1] for x in self.added}) == 1 else ""
        steps = [x.get("type") for x in (told.get("normalizer") or {}).get("normalizers", [])]
        cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.pattern = None
        if steps == ["NFC", "Replace", "Lowercase"] and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and cuts[0].get("invert") and cuts[0].get("behavior") == "Removed" and not cuts[1].get("add_prefix_space") and not cuts[1].get("use_regex"):
            self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
            self.plain = regex.compile("[!-~\u00a1-\u012f\u0131-\u024f]+")
            self.model = self.tokenizer.model
            own = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in own]
            # Bytes without a sign of their own are shown as characters from 256 on.
            self.signs = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = "".join([self.signs[b] for b in piece.encode()])
        return np.array([x.id for x in self.model.tokenize(piece)], "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        if len(self.known) > self.keep:
            self.known.clear()
        # Nearly each new word has a new piece, so old pieces other than the frequent ones are hardly asked for again.
        if len(self.pieces) > self.keep // 16:
            self.pieces.clear()
        odd = []
        for w in words:
            if w in self.known:
                continue
            if self.pattern is None or not self.plain.fullmatch(w):
                odd.append(w)
                continue
            parts = self.pattern.findall(w.lower())
            for p in parts:
                if p not in self.pieces:
                    self.pieces[p] = self._piece(p)
            self.known[w] = self.pieces[parts[0]] if len(parts) == 1 else b"".join([self.pieces[p] for p in parts])
        odd = list(dict.fromkeys(odd))
        self.known.update(zip(odd, self._encode(odd), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            if any(x in text for x in self.ODD) or (self.added and self.hint in text and any(x in text.lower() for x in self.added)):
                out += self._encode([text])
                continue
            words = text.split()
            try:
                out.append(b"".join(map(self.known.__getitem__, words)))
            except KeyError:
                self._learn(words)
                out.append(b"".join(map(self.known.__getitem__, words)))
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each Python worker, which may run many tasks."""
    return WordTokenizer(path)


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, limits: Limits = Limits(), with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (doc_id, text): ids by the tokenizer, then end_id, packed into sequences.

    A document's first line is its prompt, which bears no loss; the other lines and the end do (of a document of one
    line, everything does).

    Each task packs its own rows, so nothing is shuffled and a lost task is repeated by itself; sequence_id holds the
    task's number in its upper bits. A null or empty text is the end id alone; repeated rows are packed as often as they
    come; an empty table gives no rows; other columns are ignored. with_ids adds the piece's ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        words, packer = word_tokenizer(tokenizer_path), VectorPacker(limits)
        held: dict[int, list] = {}
        end = np.array([end_id], "<u4").tobytes()
        number = 0

        def rows(pieces: Iterable[Piece]) -> None:
            for p in pieces:
                doc = held[p.example]
                part = doc[1][4 * p.start : 4 * (p.start + p.length)]
                out["doc_id"].append(doc[0])
                out["start"].append(p.start)
                out["length"].append(p.length)
                out["ids_crc32"].append(zlib.crc32(part))
                out["doc_tokens"].append(len(doc[1]) // 4)
                out["sequence_id"].append(task + p.sequence)
                out["offset"].append(p.offset)
                out["loss_tokens"].append(p.loss)
                if with_ids:
                    out["ids"].append(np.frombuffer(part, "<u4").astype(np.int32))
                doc[2] -= p.length
                if not doc[2]:
                    del held[p.example]

        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.list_(pa.int32()) if x == "ids" else pa.int64() for x in names]

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[x], k) for x, k in zip(names, kinds, strict=True)], names=names)

        out: dict[str, list] = {x: [] for x in names}
        for b in sliced(batches):
            ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                coded = words.encode([text or ""])[0] + end
                held[number] = [doc_id, coded, len(coded) // 4]
                prompt, line_end, _ = (text or "").partition("\n")
                rows(packer.add(number, len(coded) // 4, len(coded) // 4 - min(len(coded) // 4 - 1, len(words.encode([prompt])[0]) // 4) if line_end else None))
                number += 1
            yield batch()
            out = {x: [] for x in names}
        rows(packer.finish())
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(run, schema)
