"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Every prefix of a text has exactly one encoding, and the encoding of a longer prefix extends that of the
prefix before its last token. So a table of each prefix's last token holds all encodings: at each end, of
the vocabulary matches an automaton finds there, the last token is the one that is compatible with the
last token of the prefix it follows. The ids are read from the table backwards.

Two tokens are compatible if byte pair encoding of their joined text gives just the two, that is, if no
merge reaches over the border while either grows: `_Pairs.test` walks the merges on both sides of the
border in their order and looks for one across that comes first.

The library's `piece` files hold the vocabulary; encoding and decoding are the work of this module.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from hexweave.llm.common import pick
from hexweave.llm.subwords import Coder, chunked, ragged, raw, slices

SPACE = "▁"
UNKNOWN = -1


class Vocabulary:
    """Pieces, ranks and the last merge of every piece; bounded by the vocabulary's size."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        self.text = [model.IdToPiece(i) for i in range(size)]
        self.byte = [-1] * 256
        plain = []
        for i, text in enumerate(self.text):
            if model.IsByte(i):
                self.byte[int(text[3:-1], 16)] = i
            elif not (model.IsControl(i) or model.IsUnknown(i) or model.IsUnused(i)):
                plain.append(i)
        order = sorted(plain, key=lambda i: (-model.GetScore(i), i))
        self.rank = {i: r for r, i in enumerate(order)}
        self.id = {self.text[i]: i for i in plain}
        # Runs of spaces share the lowest score, so their merges come last, from the left.
        self.runs = {i: len(self.text[i]) for i in plain if set(self.text[i]) == {SPACE}}
        self.rank |= dict.fromkeys(self.runs, len(order))
        self.split = {}
        self.usable = [i for i in plain if self._resolve(i)]
        self.joins = self._joins()

    def merged(self, parts: list[str], until: int = 1) -> list[str]:
        """The symbols left when the best merge, the leftmost of equals, is done again and again."""
        parts = list(parts)
        while len(parts) > until:
            best, at = None, -1
            for k in range(len(parts) - 1):
                j = self.id.get(parts[k] + parts[k + 1])
                if j is not None and (best is None or self.rank[j] < best):
                    best, at = self.rank[j], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _resolve(self, i: int) -> bool:
        """Find the last merge of a piece from its characters; whether they give the piece."""
        if i in self.runs or len(self.text[i]) == 1:
            return True
        parts = self.merged(list(self.text[i]), 2)
        if len(parts) == 2:
            self.split[i] = (self.id[parts[0]], self.id[parts[1]])
        return len(parts) == 2

    def _joins(self) -> np.ndarray:
        """Whether a piece may reach over two neighbouring bytes; only ASCII pairs and blanks are looked into."""
        out = np.ones((256, 256), bool)
        out[:128, :128] = False
        inside = set()
        for i in self.usable:
            text = self.text[i].replace(SPACE, " ")
            for a, b in zip(text, text[1:], strict=False):
                inside |= {(a, b), (a, ""), ("", b)}
                if a.isascii() and b.isascii():
                    out[ord(a), ord(b)] = True
        for c in range(128):
            if not any(not a.isascii() for a, b in inside if a and b == chr(c)):
                out[128:, c] = False
            if not any(not b.isascii() for a, b in inside if b and a == chr(c)):
                out[c, 128:] = False
        return out


class _Pairs:
    """Remembered answers of the compatibility test."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}
        self.space = vocabulary.id.get(SPACE)

    def spine(self, i: int, side: int) -> list[int]:
        """The symbols at one edge of a piece while it grows, from a character to the piece."""
        grown = [i]
        while (parts := self.v.split.get(grown[-1])) is not None:
            grown.append(parts[side])
        return grown[::-1]

    def test(self, a: int, b: int) -> bool:
        v = self.v
        if a in v.runs:
            if b in v.runs:
                return v.merged([SPACE] * (v.runs[a] + v.runs[b])) == [v.text[a], v.text[b]]
            if v.text[b][0] == SPACE:
                return True
            a = self.space
        left, right = self.spine(a, 1), self.spine(b, 0)
        i = j = 0
        never = len(v.rank)
        while True:
            next_left = v.rank[left[i + 1]] if i + 1 < len(left) else never
            next_right = v.rank[right[j + 1]] if j + 1 < len(right) else never
            across = v.id.get(v.text[left[i]] + v.text[right[j]])
            # Equal merges are done from the left: the left side's own first, then the one across.
            if across is not None and v.rank[across] < next_left and v.rank[across] <= next_right:
                return False
            if next_left == never and next_right == never:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v, self.pairs = vocabulary, _Pairs(vocabulary)
        self.automaton = ahocorasick.Automaton()
        for i in vocabulary.usable:
            self.automaton.add_word(vocabulary.text[i], (i, len(vocabulary.text[i])))
        self.automaton.make_automaton()
        self.length = [len(t) for t in vocabulary.text]
        self.coder = Coder(self.many)

    def chunk(self, text: str) -> list[int]:
        """Ids of a text without a border inside."""
        known, test, size = self.pairs.known, self.pairs.test, len(self.length)
        last = [UNKNOWN] * len(text)
        for end, (i, length) in self.automaton.iter(text):
            if last[end] != UNKNOWN:
                continue
            before = end - length
            if before >= 0 and (p := last[before]) != UNKNOWN:
                key = p * size + i
                fits = known.get(key)
                if fits is None:
                    if len(known) > 1_000_000:
                        known.clear()
                    fits = known[key] = test(p, i)
                if not fits:
                    continue
            last[end] = i
        out, at = [], len(text) - 1
        while at >= 0:
            i = last[at]
            if i == UNKNOWN:
                out.extend(reversed([self.v.byte[x] for x in text[at].encode()]))
                at -= 1
            else:
                out.append(i)
                at -= self.length[i]
        return out[::-1]

    def many(self, chunks: list[str]) -> list[list[int]]:
        return [self.chunk(c.replace(" ", SPACE)) for c in chunks]

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's begin; no begin or end ids."""
        texts = pc.fill_null(texts, "")
        texts = pc.replace_substring(texts, SPACE, " ")  # escaped, the two are the same
        # The dummy prefix; an empty text gets none.
        texts = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise(" ", texts, ""))
        content, offsets = raw(texts)
        if not len(content):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        begins = np.zeros(len(content), bool)
        begins[1:] = ~self.v.joins[content[:-1], content[1:]]
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begins)
        chunks, codes = chunked(content, starts)
        table, places, numbers = self.coder.table(chunks)
        flat, ends = ragged(table, places, numbers[codes])
        return flat, ends[np.searchsorted(starts, offsets)]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        parts = [t.replace(SPACE, " ").encode() for t in vocabulary.text]
        for i in (vocabulary.begin, vocabulary.end):
            parts[i] = b""
        for value, i in enumerate(vocabulary.byte):
            if i >= 0:
                parts[i] = bytes([value])
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)

    def batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 texts of the id runs between offsets, without the dummy prefix's space."""
        content, ends = ragged(self.flat, self.offsets, ids.astype(np.int64))
        at = ends[offsets]
        whole = content.tobytes()
        return [whole[a:b].removeprefix(b" ") if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]


@lru_cache(maxsize=1)
def _tools(path: str) -> tuple[Vocabulary, Encoder, Decoder]:
    """Once per worker process."""
    vocabulary = Vocabulary(path)
    return vocabulary, Encoder(vocabulary), Decoder(vocabulary)


def encode(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """doc_id, ``ids`` (little-endian unsigned 32-bit, with begin and end ids) and ``decoded`` of every row.

    NULL and empty texts give the two ids and an empty text. A text of any length is encoded whole, in
    time linear in it; repeated rows give repeated results, an empty table an empty one. Other columns
    of ``docs`` are ignored. ``path`` names the vocabulary file on every executor.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, encoder, decoder = _tools(path)
        begin, end = (np.array([i], "<u4").tobytes() for i in (vocabulary.begin, vocabulary.end))
        for batch in slices(batches, "text"):
            flat, offsets = encoder.batch(batch.column("text"))
            whole = flat.tobytes()
            ids = [begin + whole[4 * a : 4 * b] + end for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            decoded = decoder.batch(flat, offsets) if decode else [None] * len(ids)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary()).cast(pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, ids binary, decoded string")
