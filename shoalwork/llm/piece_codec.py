"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search keeps, for each of the last `longest` positions, the best piece that ends there and where
it begins. When the paths from all of them meet at one boundary, the ids up to it are final and are
put out, and the window moves on; so memory does not grow with the text.

Unigram models: best is the largest sum of scores. Byte-pair models: scores order the merges instead, and
the encoding of a prefix ends in the one piece that stays apart from the piece before it when the
two are merged by themselves; that piece is the prefix's backpointer, so the same lattice and the
same commits serve, and the ids are those of the merges.

The model file is read with the sentencepiece library for its pieces and its normalizer alone.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import batches, doc_texts

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
PART, LONG = 1 << 16, 1 << 10  # characters of a part of a text, and of a word that is searched part by part
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
OUT = "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean"


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceCodec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str, remembered: int = 1_000_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids, self.scores, self.surface, self.bytes, self.unknown = {}, [], [], {}, 0
        self.kind, suffix, rules = UNIGRAM, 0, {}
        for number, value in _fields(self.model.serialized_model_proto()):
            if number == 1:
                piece = dict(_fields(value))
                text, kind, at = piece[1].decode(), piece.get(3, NORMAL), len(self.scores)
                self.scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0]))
                self.surface.append(bytes([int(text[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else text.replace(SPACE, " ").encode())
                if kind == BYTE:
                    self.bytes[int(text[3:5], 16)] = at
                elif kind == UNKNOWN:
                    self.unknown = at
                    self.surface[at] = " ⁇ ".encode()
                elif kind in (NORMAL, USER):
                    self.ids[text] = at
            elif number == 2:
                trainer = dict(_fields(value))
                self.kind, suffix = trainer.get(3, UNIGRAM), trainer.get(24, 0)
            elif number == 3:
                rules = dict(_fields(value))
        # without rules for characters, normalizing is an added space at the start and a mark for every space
        self.plain, self.dummy = not rules.get(2) and not rules.get(4, 1) and rules.get(5, 1) and not suffix, rules.get(3, 1)
        self.longest = max(map(len, self.ids), default=1)
        self.penalty = min(self.scores, default=0) - 10
        self.apart, self.known, self.remembered = {}, {}, remembered
        # no piece continues past a space into another word, so units can be searched one by one
        self.whole = {p for p in self.ids if self.kind != BPE or self.merges(p) == [p]}  # what the merges can make
        self.ending: dict = {}
        for piece in self.whole:
            node = self.ending
            for char in reversed(piece):
                node = node.setdefault(char, {})
            node[""] = piece
        self.units = not any(SPACE in p.lstrip(SPACE) for p in self.ids)

    def merges(self, text: str) -> list[str]:
        """The merges of a byte-pair model carried out one by one: best score first, then leftmost."""
        parts = list(text)
        while True:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                return parts
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def stays_apart(self, left: str, right: str) -> bool:
        if (got := self.apart.get((left, right))) is None:
            if len(self.apart) >= self.remembered:
                self.apart.clear()
            got = self.apart[left, right] = self.merges(left + right) == [left, right]
        return got

    def fallback(self, char: str) -> list[int]:
        """Ids of a character that no piece covers."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def stream(self, chars: str) -> Iterator[list[int]]:
        """Ids of a normalized text, put out as soon as they are final."""
        search = Search(self)
        yield from search.feed(chars)
        yield from search.finish()

    def grow_unigram(self, chars: str, base: int, at: int, to: int, begin: dict, score: dict) -> None:
        """Carries best paths from place `at` on to `to`; score: of the best path to a place."""
        score.setdefault(base, 0.0)
        for end in range(at + 1, to + 1):
            best = None
            for start in range(max(base, end - self.longest), end):
                i = self.ids.get(chars[start:end])
                if i is None and end - start > 1:
                    continue
                value = score[start] + (self.penalty if i is None else self.scores[i])
                if best is None or value > best:
                    best, begin[end] = value, start
            score[end] = best

    def grow_bpe(self, chars: str, base: int, at: int, to: int, begin: dict, last: dict) -> None:
        """The same for merges; last: the piece that ends at a place (None: nothing to merge with).

        Pieces that end at a place are read off a trie of their characters from the end on.
        """
        ending, known = self.ending, self.apart.get
        for end in range(at + 1, to + 1):
            node, start = ending, end
            begin[end], last[end] = end - 1, None
            while start > base:
                start -= 1
                node = node.get(chars[start])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    left = last.get(start)
                    if left is None:
                        apart = True
                    elif (apart := known((left, piece))) is None:
                        apart = self.stays_apart(left, piece)
                    if apart:
                        begin[end], last[end] = start, piece
                        break

    def path(self, chars: str, begin: dict, start: int, end: int) -> list[int]:
        out = []
        while end > start:
            piece = chars[begin[end] : end]
            out.append([self.ids[piece]] if piece in self.ids else self.fallback(piece))
            end = begin[end]
        return [i for part in reversed(out) for i in part]

    def normal_parts(self, text: str) -> Iterator[str]:
        """The normalized text in parts of bounded size; a model with rules of its own for characters has them applied to the whole text."""
        if not self.plain:
            yield self.model.normalize(text)
            return
        for at in range(0, len(text), PART):
            part = text[at : at + PART].replace(" ", SPACE)
            yield part if at or not self.dummy else SPACE + part

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers.

        The text streams through in parts. Where no piece goes on past a space, all surviving paths meet before each word, so words are
        committed there one by one, and those met before are looked up; a word longer than LONG runs through the search itself.
        """
        out: list[bytes] = []
        search, held = None if self.units else Search(self), ""
        for part in self.normal_parts(text):
            if not self.units:
                out += map(pack, search.feed(part))
                continue
            if search:  # a long word goes on
                end = re.match(f"{SPACE}*[^{SPACE}]*" if search.blank else f"[^{SPACE}]*", part).end()
                out += map(pack, search.feed(part[:end]))
                if end == len(part):
                    continue
                out += map(pack, search.finish())
                search, part = None, part[end:]
            held += part
            cut = len(held[: held.rfind(SPACE) + 1].rstrip(SPACE))  # the last word may go on in the next part
            if len(part) >= PART // 2:
                if cut:
                    out.append(self.words(held[:cut]))
                    held = held[cut:]
                if len(held) > LONG:
                    search = Search(self)
                    out += map(pack, search.feed(held))
                    held = ""
        if search:
            out += map(pack, search.finish())
        if held:
            out.append(self.words(held))
        return b"".join(out)

    def words(self, normal: str) -> bytes:
        """Ids of whole words."""
        known, parts = self.known, normal.split(SPACE)
        if parts[0] or "" in parts[1:]:  # runs of spaces, or none at the start
            return b"".join(map(self.pack_ids, UNIT.findall(normal)))
        del parts[0]
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            pass
        if len(known) > self.remembered:
            known.clear()
        for part in set(parts).difference(known):
            known[part] = self.pack_ids(SPACE + part)
        return b"".join(map(known.__getitem__, parts))

    def pack_ids(self, unit: str) -> bytes:
        if self.kind == BPE and unit in self.whole:
            return struct.pack("<I", self.ids[unit])
        return b"".join(map(pack, self.stream(unit)))

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces joined, bytes put together, the leading space that encoding adds taken off."""
        text = b"".join(map(self.surface.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


class Search:
    """A search that takes a normalized text in parts of any size and puts out ids as soon as they are final.

    It holds the characters since the last commit, and for the places among them where the best piece that ends there begins and
    what the search knows of the place. After every `longest` characters all places that a later piece may begin at are
    traced back; where their paths meet, everything before is committed and forgotten.
    """

    def __init__(self, codec: PieceCodec):
        self.codec, self.chars, self.at, self.begin, self.state, self.blank = codec, "", 0, {}, {}, True
        self.grow = codec.grow_bpe if codec.kind == BPE else codec.grow_unigram

    def feed(self, chars: str) -> Iterator[list[int]]:
        self.blank = self.blank and not chars.strip(SPACE)
        longest = self.codec.longest
        for low in range(0, len(chars), longest):
            self.chars += chars[low : low + longest]
            end = len(self.chars)
            self.grow(self.chars, 0, self.at, end, self.begin, self.state)
            self.at = end
            if (to := self.meet(end)) > 0:
                yield self.codec.path(self.chars, self.begin, 0, to)
                self.chars, self.at = self.chars[to:], end - to
                self.begin = {k - to: v - to for k, v in self.begin.items() if k > to}
                self.state = {k - to: v for k, v in self.state.items() if k >= to}

    def finish(self) -> Iterator[list[int]]:
        if self.chars:
            yield self.codec.path(self.chars, self.begin, 0, len(self.chars))
        self.__init__(self.codec)

    def meet(self, end: int) -> int:
        """The last boundary on the paths from all the places that a later piece may begin at; 0 if there is none."""
        heads = set(range(max(0, end - self.codec.longest + 1), end + 1))
        while len(heads) > 1:
            head = max(heads)
            heads.remove(head)
            if head <= 0:
                return 0
            heads.add(self.begin[head])
        return heads.pop()


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """One codec for each model and Python worker."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """Encodes every text (null: empty) and decodes the ids again.

    Returns doc_id, n_tokens, ids_crc32 (unsigned, of the ids as little-endian unsigned 32-bit
    integers), decoded_sha256 (of the decoded text) and round_trip (whether the decoded text is the
    text; a normalizer that changes texts makes it false). One row per row; other columns are not read.
    """

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in it:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in batches(texts):
                rows = []
                for doc, text in zip(ids[a:b], texts[a:b]):
                    got = own.encode(text)
                    back = own.decode(got)
                    rows.append((doc, len(got) // 4, zlib.crc32(got), hashlib.sha256(back.encode()).hexdigest(), back == text))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip"])

    return doc_texts(docs).mapInArrow(code, OUT)


def encode_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and ids (array of int) of every text (null: empty)."""

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in it:
            got = [np.frombuffer(own.encode(t), "<i4") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return doc_texts(docs).mapInArrow(code, "doc_id long, ids array<int>")


def decode_ids(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids (null ids: null text)."""

    def code(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in it:
            texts = [None if v is None else own.decode(np.array(v, "<u4").tobytes()) for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(code, "doc_id long, text string")
