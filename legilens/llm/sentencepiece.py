"""SentencePiece encoding by a shared-prefix Viterbi search, and decoding.

The vocabulary is read from a public model file; nothing is trained. The best segmentation of a text is the one whose pieces'
scores sum highest (characters that no piece covers are written as their UTF-8 bytes). Spaces become the mark ▁. No piece
holds a mark after another character, and characters such as the line break are in no longer piece, so the search
falls apart at those places into words that repeat a great deal.

Every batch of documents gives its distinct marked words, sorted: the depth-first order of their trie. Going from word to word,
the forward scores of the common prefix stay, so each node of the trie is scored once.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words whose pieces a worker remembers between slices of a batch, the longest of them, and the rows of a slice.
REMEMBERED, SHORT, SLICE = 200_000, 40, 500
#: What an unknown character scores below the worst piece.
UNKNOWN = 10.0


class Vocabulary:
    """Pieces, scores and the search over them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes = {int(model.id_to_piece(i)[3:5], 16): i for i in range(size) if model.is_byte(i)}
        self.text = [bytes([b]) if (b := self.byte_of(model, i)) is not None else b"" if model.is_control(i) or model.is_unknown(i) else model.id_to_piece(i).encode() for i in range(size)]
        normal = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = {model.id_to_piece(i): (model.get_score(i), i) for i in normal}
        self.unknown = min(s for s, _ in self.pieces.values()) - UNKNOWN
        inside = {c for p in self.pieces if len(p) > 1 for c in p}
        alone = "".join(re.escape(c) for c in "\n\r\t\f\v" if c not in inside)
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a mark after another character")
        self.words = re.compile(rf"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else rf"{MARK}*[^{MARK}]+|{MARK}+")
        # Every end of a piece, with the piece that it is: going back from a place, the search stops where no piece ends like that.
        self.ends: dict[str, tuple[float, int] | None] = {p[k:]: None for p in self.pieces for k in range(1, len(p))}
        self.ends |= self.pieces
        # What a piece gives when it is decoded; bytes that stand for themselves are no marks.
        self.shown = [raw.replace(MARK.encode(), b" ") if len(raw) > 2 else raw for raw in self.text]
        # Pieces of words as 32-bit numbers. The empty word stands for a mark that a text itself holds.
        self.known: dict[str, bytes] = {"": array("i", [self.bytes[b] for b in MARK.encode()]).tobytes()}

    @staticmethod
    def byte_of(model, i: int) -> int | None:
        return int(model.id_to_piece(i)[3:5], 16) if model.is_byte(i) else None

    def encode_sorted(self, words: list[str]) -> list[list[int]]:
        """Pieces of each word of a sorted list, reusing the forward scores of the prefix shared with the one before."""
        ends, none, unknown = self.ends, (), self.unknown
        best: list[float] = [0.0]
        back: list[tuple[int, int]] = [(0, -1)]
        before, out = "", []
        for word in words:
            n, shared, most = len(word), 0, min(len(word), len(before))
            if word[:most] == before[:most]:
                shared = most
            else:
                while word[shared] == before[shared]:
                    shared += 1
            del best[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, n + 1):
                top, at = best[end - 1] + unknown, (end - 1, -1)
                for start in range(end - 1, -1, -1):
                    p = ends.get(word[start:end], none)
                    if p:
                        s = best[start] + p[0]
                        if s > top:
                            top, at = s, (start, p[1])
                    elif p is none:
                        break
                best.append(top)
                back.append(at)
            ids, end = [], n
            while end:
                start, i = back[end]
                if i < 0:
                    ids.extend(self.bytes[b] for b in reversed(word[start:end].encode("utf-8", "replace")))
                else:
                    ids.append(i)
                end = start
            ids.reverse()
            out.append(ids)
            before = word
        return out

    def marked(self, text: str) -> list[str]:
        """The marked words of a text. A mark that the text itself holds is its own word and written in bytes."""
        line = MARK + text.replace(" ", MARK)
        return self.words.findall(line)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Pieces of each text."""
        known, split = self.known, []
        for text in texts:
            first, *others = text.split(MARK)
            words = self.marked(first) if text else []
            for p in others:
                words.append("")
                words += self.words.findall(p.replace(" ", MARK))
            split.append(words)
        used = set().union(*split)
        fresh = sorted(used.difference(known))
        known.update((w, array("i", ids).tobytes()) for w, ids in zip(fresh, self.encode_sorted(fresh), strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), np.int32) for words in split]
        for w in fresh:
            if len(w) > SHORT:
                del known[w]
        if len(known) > REMEMBERED:  # the words of these texts are left
            used.add("")
            self.known = {w: known[w] for w in used if w in known}
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text that the pieces were made from."""
        return b"".join(map(self.shown.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file, read once by each worker."""
    return Vocabulary(path)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, some at once."""
    for low in range(0, batch.num_rows, SLICE):
        yield batch.slice(low, SLICE)


def listed(ids: list[np.ndarray]) -> pa.ListArray:
    """Arrays as one column of lists."""
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))


def encode(docs: DataFrame, model: str = MODEL, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with the piece ids of each text in place of the text. A null text counts as empty; the empty text has no pieces. A column of the
    name ids_col is replaced."""
    cols = docs.columns
    at = cols.index(text_col)
    rest = [i for i in range(len(cols)) if i != at and cols[i] != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for b in batches:
            for part in slices(b):
                lists = listed(words.encode([x or "" for x in part.column(at).to_pylist()]))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in rest), lists], [*(cols[i] for i in rest), ids_col])

    schema = ", ".join([*(f"`{cols[i]}` {docs.schema[i].dataType.simpleString()}" for i in rest), f"`{ids_col}` array<int>"])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model: str = MODEL, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """encoded with the text of each list of piece ids in place of the list; null gives the empty text. A column of the name text_col is replaced."""
    cols = encoded.columns
    at = cols.index(ids_col)
    rest = [i for i in range(len(cols)) if i != at and cols[i] != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for b in batches:
            lists = b.column(at)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
            texts = [words.decode(flat[s:e]) if e > s else "" for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(texts, pa.string())], [*(cols[i] for i in rest), text_col])

    schema = ", ".join([*(f"`{cols[i]}` {encoded.schema[i].dataType.simpleString()}" for i in rest), f"`{text_col}` string"])
    return encoded.mapInArrow(run, schema)


def tokenised(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids, round_trip (whether the ids decode to the very text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(model)
        for b in batches:
            for part in slices(b):
                texts = [x or "" for x in part.column(1).to_pylist()]
                ids = words.encode(texts)
                same = [words.decode(x) == text for x, text in zip(ids, texts, strict=True)]
                columns = [part.column(0), pa.array([len(x) for x in ids], pa.int64()), listed(ids), pa.array(same, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "round_trip"])

    # Both ways in one pass, so that one worker a core does it and the ids are not handed over twice.
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids array<int>, round_trip boolean")


def op4_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return tokenised(spark.read.parquet(f"{sf_dir}/documents.parquet"))
