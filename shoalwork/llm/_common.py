"""What the operators of this subpackage share: shared storage, hashing and tokenizer caches."""

from __future__ import annotations

import itertools
import json
import os
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import delete, materialize, release, shared_dir, table_path  # noqa: F401

DOC_SPLIT = re.compile(r" ?\S+|\s+(?!\S)|\s+")
ODD_SPACE = re.compile("[\x1c-\x1f]")
END_MARKS, SEPARATOR = string.punctuation, "\x01"
PLAIN_PART = re.compile(r" ?[^\s\0]+|\n")  # what may stand beside others on a line
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """df, with its session sending texts to Python workers so many rows at a time, not the 10,000 of the default.

    Simplified tracebacks are turned off, as plans that ask for them and plans that do not would each keep workers of their own.
    """
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false")
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with no other column that could clash."""
    docs = small_batches(docs)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def is_plain(part: str) -> bool:
    return (part[:1].isalpha() or part[:1] == " ") and part[1:].isalpha() or PLAIN_PART.fullmatch(part) is not None


def byte_names() -> dict[int, str]:
    """What byte-level models call each byte, with a blank before the name of a space."""
    same = {*range(33, 127), *range(161, 173), *range(174, 256)}
    names = {b: chr(b) for b in same} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in same)}
    return names | {32: " " + names[32]}


class WordCache:
    """Encodes texts with a public tokenizer, keeping the ids of words already met.

    Both byte-level and whitespace-dropping pre-tokenizers cut at the boundaries of DOC_SPLIT
    (before an isolated space, around other white space), so the ids of a text are those of its
    parts, joined. `keep_space` says whether a word's leading space belongs to it. The cache holds at
    most `limit` words; beyond that it starts afresh, and keeps the one before to take words from.
    """

    def __init__(self, path: str, keep_space: bool, limit: int = 350_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.keep_space, self.limit, self.seen, self.old, self.rare = keep_space, limit, {}, {}, set()
        self.tokenizer.model._resize_cache(0)  # words come here once
        given = json.loads(self.tokenizer.to_str())
        self.model, self.byte_names = None, {}
        if keep_space and given["normalizer"] is None and given["pre_tokenizer"] == BYTE_LEVEL:  # words of letters are single pre-tokens
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
            self.byte_names = byte_names()
        vocabulary = self.tokenizer.get_vocab()
        self.n_ids = max(vocabulary.values(), default=0) + 1
        own_edge, self.gap_edge = np.zeros(self.n_ids, bool), np.zeros(self.n_ids, bool)
        own_edge[[i for piece, i in vocabulary.items() if (piece.startswith("Ġ") if keep_space else piece.endswith("</w>"))]] = True
        self.plain_line = ("" if keep_space else " ", own_edge)
        self.bare_line = ("\n" if keep_space else f" {SEPARATOR} ", self.gap_edge)
        self.gap_edge[self.ids(["\n" if keep_space else SEPARATOR])[0]] = True

    def split(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words, the number of the word at each place, the first place of each text (and the end), and texts with line ends side by side.

        Words are cut as byte ranges, before a space and around a line end, and told apart by Arrow; only distinct ones become strings.
        """
        rows = pa.array(texts, pa.large_string())
        ends = np.frombuffer(rows.buffers()[1], np.int64)[: len(texts) + 1]
        data = np.frombuffer(rows.buffers()[2] or b"", np.uint8)[: ends[-1]]
        lines, first = np.flatnonzero(data == 10), data == 32
        for at in (lines, lines + 1, ends) if self.keep_space else (lines, ends):
            first[at[at < len(data)]] = True
        at = np.flatnonzero(first)
        words = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.append(at, len(data))), pa.py_buffer(data)]).dictionary_encode()
        doubled = np.searchsorted(ends, lines[1:][np.diff(lines) == 1], "right") - 1
        return words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy(), np.searchsorted(at, ends), doubled

    def rare_parts(self, text: str) -> list[str]:
        """The parts of a text with runs of white space, or white space of other kinds."""
        return [text] if ODD_SPACE.search(text) or "\0" in text else DOC_SPLIT.findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words, place, begins, doubled = self.split(texts)
        odd, unlike = set(), []
        if not self.keep_space:
            words = [w[1:] if w[0] in " \n" else w for w in words]
        known = list(map(self.seen.get, words))
        fresh = {w for w, ids in zip(words, known) if ids is None}
        if self.keep_space:
            self.rare.update(w for w in fresh if not is_plain(w))
            odd = self.rare.intersection(words)
            if odd or len(doubled):
                has_odd = np.fromiter((w in odd for w in words), bool, len(words))
                unlike = np.union1d(np.searchsorted(begins, np.flatnonzero(has_odd[place]), "right") - 1, doubled).tolist()
                fresh -= odd
        if fresh:
            self.admit(fresh, [w for w in words if w not in odd] if odd else words)
        known = [(b"" if w in odd else self.seen[w]) if ids is None else ids for w, ids in zip(words, known)]
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        count = sizes[place]
        ends = np.concatenate(([0], np.cumsum(count)))
        shift = (np.cumsum(sizes) - sizes)[place] - ends[:-1]  # from an id's place in the texts to its place among the distinct words' ids
        kind = np.int32 if max(ends[-1], len(pool)) < 2**31 else np.int64
        at = np.repeat(shift.astype(kind), count)
        at += np.arange(len(at), dtype=kind)
        data = pool[at].tobytes()
        edges = (4 * ends[begins]).tolist()
        out = [data[a:b] for a, b in zip(edges, edges[1:])]
        for k, ids in zip(unlike, self.encode_parts([self.rare_parts(texts[k]) for k in unlike])):
            out[k] = ids
        return out

    def encode_parts(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of texts that are cut already."""
        every = set(itertools.chain.from_iterable(parts))
        fresh = every.difference(self.seen)
        self.rare.update(p for p in fresh if not is_plain(p))
        if fresh:
            self.admit(fresh, every)
        get = self.seen.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def admit(self, fresh: set[str], every) -> None:
        """Takes the fresh words of `every` into `seen`: carried over from `old`, or encoded."""
        if self.seen and len(self.seen) + len(fresh) > self.limit:
            self.old, self.seen, fresh = self.seen, {}, set(every)
            self.rare.intersection_update(fresh)  # a word that is not here is looked at afresh when it is met
        if self.old:
            known = {word: ids for word in fresh if (ids := self.old.get(word)) is not None}
            self.seen.update(known)
            fresh = fresh.difference(known)
        if fresh:
            self.learn(fresh)

    def learn(self, words) -> None:
        """Encodes words many to a line, which costs less than one by one; their first or last ids tell them apart.

        Marks at a word's end, after a letter, are always encoded by themselves, so such words share their stem's ids.
        """
        stems = {w: w.rstrip(END_MARKS) for w in words if w[-1:] in END_MARKS and w not in self.rare}
        stems = {w: stem for w, stem in stems.items() if stem[-1:].isalpha()}
        shared = {*stems.values(), *(w[len(stem) :] for w, stem in stems.items())}
        words = shared.difference(self.seen).union(words.difference(stems))
        letters = [w for w in words if w[:1] == " " and w[1:].isalpha() and len(w) <= 100] if self.model else []
        plain, bare, alone = [], [], []
        for word in words.difference(letters):
            if len(word) > 100 or word == "\n" or word in self.rare or not self.keep_space and (SEPARATOR in word or not PLAIN_PART.fullmatch(word)):
                alone.append(word)
            else:
                (plain if (word[0] == " " if self.keep_space else word.isalpha()) else bare).append(word)
        ascii_letters, other_letters = [w for w in letters if w.isascii()], [w for w in letters if not w.isascii()]
        for group, gap, edge in ((ascii_letters, None, self.plain_line[1]), (other_letters, None, self.plain_line[1]), (plain, *self.plain_line), (bare, *self.bare_line)):
            for i in range(0, len(group), 8192):
                self.learn_lines([group[j : j + 256] for j in range(i, min(i + 8192, len(group)), 256)], gap, edge)
        self.learn_alone(alone)
        for word, stem in stems.items():
            self.seen[word] = self.seen[stem] + self.seen[word[len(stem) :]]

    def ids(self, lines: list[str]) -> list[np.ndarray]:
        return [np.array(got.ids, "<u4") for got in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False)] if lines else []

    def learn_alone(self, words: list[str]) -> None:
        for word, ids in zip(words, self.ids(words)):
            self.seen[word] = ids.tobytes()

    def letter_ids(self, lines: list[list[str]]) -> list[np.ndarray]:
        """Ids of lines of words of letters, each after a space; they go to the library's model as the pre-tokens that they are."""
        named = ["".join(words) for words in lines]
        named = [line.replace(" ", self.byte_names[32]) if line.isascii() else line.encode().decode("latin-1").translate(self.byte_names) for line in named]
        return [np.array(got.ids, "<u4") for got in self.model.encode_batch_fast(named, add_special_tokens=False)]

    def learn_lines(self, lines: list[list[str]], gap: str | None, edge: np.ndarray) -> None:
        """Lines of words with a gap between them (None: words of letters). edge: ids that only a word's first or last id, or a gap, can be."""
        for words, ids in zip(lines, self.letter_ids(lines) if gap is None else self.ids([gap.join(words) for words in lines])):
            at = np.flatnonzero(edge[ids])
            gaps = edge is self.gap_edge
            if len(at) != len(words) - gaps:  # some word has white space or letters of a kind of its own
                self.learn_alone(words)
                continue
            if gaps:
                begins, ends = np.concatenate(([0], at + 1)), np.append(at, len(ids))
            elif self.keep_space:
                begins, ends = at, np.append(at[1:], len(ids))
            else:
                begins, ends = np.concatenate(([0], at[:-1] + 1)), at + 1
            data = ids.tobytes()
            self.seen.update(zip(words, [data[a:b] for a, b in zip((4 * begins).tolist(), (4 * ends).tolist())]))


_caches: dict = {}


def word_cache(path: str, keep_space: bool, limit: int = 350_000) -> WordCache:
    """One cache for each tokenizer and Python worker, kept from task to task; a word takes about 250 bytes."""
    if (path, keep_space) not in _caches:
        _caches[path, keep_space] = WordCache(path, keep_space)
    _caches[path, keep_space].limit = limit
    return _caches[path, keep_space]


def batches(rows: list[str], most: int = 2_000_000):
    """Index ranges of texts of about `most` characters together, so that memory stays bounded."""
    begin, size = 0, 0
    for i, text in enumerate(rows):
        size += len(text)
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(rows):
        yield begin, len(rows)


def text_runs(it: Iterator[pa.RecordBatch], most: int = 6_000_000) -> Iterator[tuple[list, list[str]]]:
    """First and second column of rows in turn whose texts have about `most` characters together: enough that words recur, and bounded memory."""
    ids, texts, size = [], [], 0
    for batch in it:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts
