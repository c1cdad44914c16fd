"""Exact byte-level BPE: frequent words from a transducer lexicon, the others by merging."""

from __future__ import annotations

import heapq
import json
import os
import re
import tempfile
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lexicon import Lexicon, compile_lexicon
from .shared import small_batches, written

#: Fixed: how byte-level BPE cuts a text before its merges.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed: what that pattern takes for white space.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space of two characters or more, or at the end of a text.
RUN = re.compile(rf"{SPACE}{SPACE}+|{SPACE}\Z")
#: Runs from this length on are cut out before another library's pattern sees them, as its depth of search is bounded.
LONG_RUN = re.compile(SPACE + "{512,}")
NONE = 1 << 60
#: Bytes that a known word takes besides its letters and ids; words are forgotten when all take more than a coder may know.
ENTRY = 200
#: A bin of words that does not fit whole is taken by this number of shares.
SHARES = 4096
#: Pieces up to this number of bytes are merged many at once.
SHORT = 48


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in the vocabulary: itself where it is printable, else the next free one from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


def cut_runs(text: str, run: re.Pattern) -> Iterator[tuple[str, str]]:
    """(what stands before it, run) for each run of white space, and what is left.

    Before a visible character, the last character of a run belongs to what follows, as the BPE's own cutting has it; the rest of the run, or all
    of a run that ends the text, is one piece.
    """
    at = 0
    for m in run.finditer(text):
        end = m.end() - (m.end() < len(text))
        yield text[at : m.start()], text[m.start() : end]
        at = end
    yield text[at:], ""


class Merges:
    """The merges of a vocabulary: the adjacent pair of least rank is merged, the leftmost first, until none can be."""

    def __init__(self, start: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> None:
        self.start, self.pairs = start, pairs
        ranked = sorted((a << 32 | b, rank, to) for (a, b), (rank, to) in pairs.items())
        self.keys, self.ranks, self.to = (np.array([x[i] for x in ranked], np.int64) for i in range(3))
        self.result = np.zeros(int(self.ranks.max(initial=0)) + 1, np.int64)
        self.result[self.ranks] = self.to
        self.first = np.array(start, np.int64)
        made: dict[int, int] = {}
        for rank, to in self.pairs.values():
            made[to] = min(rank, made.get(to, rank))
        #: Whether no merge of a token comes before the one that makes it, so that all places of a pair may be merged at once.
        self.ordered = len(made) == len(pairs) and all(made.get(x, -1) < rank for p, (rank, _) in pairs.items() for x in p)

    def one(self, piece: bytes) -> list[int]:
        """The ids of one piece, by a heap over a linked list; its cost is n log n."""
        ids = self._rounds(self.first[np.frombuffer(piece, np.uint8)]) if len(piece) > 4096 else [self.start[b] for b in piece]
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(self.pairs[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = self.pairs[a, b][1], False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (ids[x], ids[y]) in self.pairs:
                    heapq.heappush(heap, (self.pairs[ids[x], ids[y]][0], x, ids[x], ids[y]))
        return [x for x, ok in zip(ids, alive) if ok]

    def _rounds(self, ids: np.ndarray, most: int = 64) -> list[int]:
        """A very long piece after up to ``most`` ranks, all places of a rank at once; enough for a run of one character."""
        for _ in range(most if self.ordered else 0):
            rank = self._rank(ids[:-1], ids[1:])
            best = int(rank.min(initial=NONE))
            if best == NONE:
                break
            at = np.flatnonzero(rank == best)
            if ids[at[0]] == ids[at[0] + 1]:  # of places that overlap, every other one from the first
                fresh = np.diff(at, prepend=-2) > 1
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))) % 2 == 0]
            ids[at] = self.result[best]
            ids = np.delete(ids, at + 1)
        return ids.tolist()

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(a.shape, NONE)
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit numbers. Short pieces take their next merge all at once."""
        out: list[bytes] = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        for i in np.flatnonzero(sizes > SHORT).tolist():
            out[i] = np.array(self.one(pieces[i]), "<u4").tobytes()
        for low, wide in ((0, 8), (8, 16), (16, SHORT)):
            rows = np.flatnonzero((sizes > low) & (sizes <= wide))
            if len(rows):
                self._merge_rows([pieces[i] for i in rows.tolist()], sizes[rows], wide, rows, out)
        return out

    def _merge_rows(self, pieces: list[bytes], sizes: np.ndarray, wide: int, rows: np.ndarray, out: list[bytes]) -> None:
        ids = np.full((len(pieces), wide), -1, np.int64)
        ids[np.arange(wide) < sizes[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full((len(pieces), wide), NONE)
        rank[:, :-1] = self._rank(ids[:, :-1], ids[:, 1:])  # -1 is in no pair
        column = np.arange(wide)
        while len(rows):
            at = rank.argmin(axis=1)
            best = rank[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                left = ids[done] >= 0
                flat, ends = ids[done][left].astype("<u4").tobytes(), np.cumsum(left.sum(axis=1) * 4).tolist()
                for i, a, b in zip(rows[done].tolist(), [0, *ends], ends):
                    out[i] = flat[a:b]
                rows, ids, rank, at, best = (x[~done] for x in (rows, ids, rank, at, best))
                if not len(rows):
                    return
            n = np.arange(len(rows))
            ids[n, at] = self.result[best]
            left = np.minimum(column + (column > at[:, None]), wide - 1)  # all behind the place moves up by one
            ids = np.take_along_axis(ids, left, 1)
            ids[:, -1] = -1
            rank = np.take_along_axis(rank, np.minimum(column + (column >= at[:, None]), wide - 1), 1)
            rank[:, -1] = NONE
            rank[n, at] = self._rank(ids[n, at], ids[n, np.minimum(at + 1, wide - 1)])
            ahead = np.maximum(at - 1, 0)
            rank[n, ahead] = np.where(at > 0, self._rank(ids[n, ahead], ids[n, at]), rank[n, ahead])


class Coder:
    """Encodes and decodes texts by a tokenizer file of the byte-level kind, in one process.

    A text is cut at special tokens, at white space of two characters or more, at line feeds, and before each space that a visible character
    follows; no piece of the BPE's own cutting crosses such a place. Each part's ids are looked up in a table of bounded size, then in the lexicon; else
    its pieces are looked up there, and what is in neither is merged. So texts of any lengths and any white space take the same way.
    """

    def __init__(self, path: str, lexicon: str | None = None, most_known: int = 64 << 20) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab, letters = model["model"]["vocab"], byte_letters()
        start = [vocab[letters[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.merges = Merges(start, pairs)
        back = {c: b for b, c in letters.items()}
        self.bytes = {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        self.cut_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.ranked = all(i == k for k, i in enumerate(sorted(set(start)))) and all(x[1] == 256 + x[0] for x in pairs.values())
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.most, self.held = most_known, 0
        #: Ids of words with a space before them, of words without, and of runs of white space.
        self.spaced, self.bare, self.runs = _Table(self, " "), _Table(self, ""), _Table(self, "")

    @cached_property
    def fast(self) -> tiktoken.Encoding | None:
        """Where ids follow the merges' ranks, as tiktoken has it, a coder of that library, for callers to whom tokens are a means only."""
        ranks = {b: i for i, b in self.bytes.items() if i not in self.special.values()}
        return tiktoken.Encoding("own", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens=self.special) if self.ranked else None

    def whole(self, text: str) -> bytes:
        """As buffer(), by tiktoken where it can be used; long runs of white space are cut out and merged here."""
        if not self.fast:
            return self.buffer(text)
        if not LONG_RUN.search(text):
            return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()
        out = []
        for part, special in self._special_parts(text):
            for before, run in cut_runs(part, LONG_RUN):
                out += [array("I", self.fast.encode_ordinary(before)).tobytes(), self.runs[run]]
            out.append(special)
        return b"".join(out)

    def _special_parts(self, text: str) -> Iterator[tuple[str, bytes]]:
        """(text before it, its id) of each special token in a text, and what is left."""
        at = 0
        for m in self.cut_special.finditer(text) if self.cut_special else ():
            yield text[at : m.start()], np.array([self.special[m[0]]], "<u4").tobytes()
            at = m.end()
        yield text[at:], b""

    def _segments(self, text: str) -> Iterator[tuple[str, str, bytes]]:
        """(text with single white space only, run of white space, id of a special token) in turn."""
        for part, special in self._special_parts(text):
            for before, run in cut_runs(part, RUN):
                yield before, run, b"" if run else special

    def _cut(self, text: str) -> list[tuple[list[list[str]], str, bytes]]:
        """(lines cut at spaces, run of white space, id of a special token) in turn."""
        return [([line.split(" ") for line in segment.split("\n")], run, special) for segment, run, special in self._segments(text)]

    def buffer(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        return self._joined(self._cut(text))

    def _joined(self, cut: list[tuple[list[list[str]], str, bytes]]) -> bytes:
        spaced, bare, runs, parts = self.spaced, self.bare, self.runs, []
        line_feed = bare["\n"]
        for lines, run, special in cut:
            for k, (first, *words) in enumerate(lines):
                if k:
                    parts.append(line_feed)
                parts.append(bare[first])
                parts += map(spaced.__getitem__, words)
            parts += [runs[run], special]
        return b"".join(parts)

    def buffers(self, texts: list[str]) -> list[bytes]:
        """buffer() of each text: all new words go into the tables first, with one search of the lexicon and one merging. Texts are cut once."""
        if self.held > self.most:
            for table in (self.spaced, self.bare, self.runs):
                table.clear()
            self.held = 0
        cuts, spaced, bare = [self._cut(text) for text in texts], set(), set()
        for cut in cuts:
            for lines, _, _ in cut:
                for line in lines:
                    bare.add(line[0])
                    spaced.update(line[1:])
        for table, words in ((self.spaced, spaced), (self.bare, bare)):
            words = [w for w in words if w and w not in table]
            ids = self.encode_words([table.lead + w for w in words])
            self.held += sum(map(len, words)) + sum(map(len, ids)) + ENTRY * len(words)
            table.update(zip(words, ids))
        return list(map(self._joined, cuts))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: from the lexicon, else of its pieces from there, else by merging."""
        found = self._known([w.encode() for w in words])
        rest = [i for i, x in enumerate(found) if x is None]
        # a space and letters are one piece, as a look at them tells sooner than the pattern
        one = [i for i in rest if (words[i][1:] if words[i][0] == " " else words[i]).isalpha()]
        missing = self.merges.many([words[i].encode() for i in one])
        for i, x in zip(one, missing):
            found[i] = x
        cut = {i: PIECES.findall(words[i]) for i in rest if found[i] is None}
        new = list({p for pieces in cut.values() for p in pieces})
        coded = [p.encode() for p in new]
        ids = self._known(coded)
        missing = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(missing, self.merges.many([coded[k] for k in missing])):
            ids[k] = x
        table = dict(zip(new, ids))
        for i, pieces in cut.items():
            found[i] = b"".join(map(table.__getitem__, pieces))
        return found

    def _known(self, words: list[bytes]) -> list[bytes | None]:
        return self.lexicon.find(words) if self.lexicon else [None] * len(words)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.buffer(text), "<u4")

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


class _Table(dict):
    """The ids of parts of a line, each with the given lead."""

    def __init__(self, coder: Coder, lead: str) -> None:
        self.coder, self.lead = coder, lead

    def __missing__(self, part: str) -> bytes:
        self[part] = out = self.coder.encode_words([self.lead + part])[0] if part else b""
        self.coder.held += len(part) + len(out) + ENTRY
        return out


_coders: dict[tuple, Coder] = {}


def coder(path: str, lexicon: str | None = None) -> Coder:
    """One coder a process. Names without a folder are of files that Spark has brought to the executor."""
    if (path, lexicon) not in _coders:
        _coders.clear()
        _coders[path, lexicon] = Coder(*(p if not p or os.path.sep in p else SparkFiles.get(p) for p in (path, lexicon)))
    return _coders[path, lexicon]


def brought(spark: SparkSession, data: bytes, name: str) -> str:
    """Give every executor a file of these bytes; its name there. For data of fixed or bounded size only."""
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{uuid.uuid4().hex}-{name}")
    with open(path, "wb") as f:
        f.write(data)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def tokenizer_file(spark: SparkSession, path: str) -> str:
    with open(path, "rb") as f:
        return brought(spark, f.read(), "tokenizer.json")


def frequent_words(docs: DataFrame, most: int, longest: int = 64) -> DataFrame:
    """(word, n): the most frequent space-led words of all texts, counted over all rows: at most ``most`` of those seen twice or more, of ``longest`` characters or fewer.

    Words come by bins of like counts, from the top, as long as whole bins fit; of the first bin that does not, by shares of a hash as long as
    those fit. So counts of bins, a few hundred and then SHARES, decide, and no task's candidates reach the driver.
    """


    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    words = line.split(" ")[1:]
                    if max(map(len, words), default=0) > longest:  # nothing longer is held
                        words = [w for w in words if len(w) <= longest]
                    seen.update(words)
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = counted.where((F.col("n") > 1) & (F.length("word") > 0) & ~F.col("word").rlike("^" + SPACE))
    counted = written(counted.withColumn("bin", F.floor(F.log2("n") * 16)), "words")

    def fitting(df: DataFrame, by: Column, room: int) -> tuple[int, int]:
        """(least, words): the least value of by such that the rows from it on are no more than room, and their number."""
        words, least = 0, 1 << 62
        for r in sorted(df.groupBy(by.alias("by")).agg(F.count("*").alias("words")).collect(), key=lambda r: -r.by):
            if words + r.words > room:
                break
            words, least = words + r.words, r.by
        return least, words

    least, words = fitting(counted, F.col("bin"), most)
    next_bin = counted.where(F.col("bin") < F.lit(least)).agg(F.max("bin")).first()[0]
    share = F.pmod(F.xxhash64("word"), F.lit(SHARES))
    chosen = F.col("bin") >= F.lit(least)
    if next_bin is not None:
        least_share, _ = fitting(counted.where(F.col("bin") == next_bin), share, most - words)
        chosen = chosen | (F.col("bin") == next_bin) & (share >= F.lit(least_share))
    return counted.where(chosen).select("word", "n")


def build_lexicon(docs: DataFrame, tokenizer: str, most: int = 32768) -> bytes:
    """The lexicon of the most frequent words of docs; most, and the longest word that is taken, bound what reaches the driver."""
    words = [f" {r.word}" for r in frequent_words(docs, most).toLocalIterator()]
    ids = Coder(tokenizer).encode_words(words)
    return compile_lexicon((w.encode(), tuple(np.frombuffer(x, "<u4").tolist())) for w, x in zip(words, ids))


def encode_decode(docs: DataFrame, tokenizer: str, most_words: int = 32768) -> DataFrame:
    """Encode every whole text by a byte-level BPE tokenizer file and decode its ids again.

    docs: doc_id, text; other columns are left alone. Returns, for each row, doc_id, ids array<int> and decoded string. A null text is
    empty and has no ids. The strings of special tokens in a text become special tokens. Repeated rows are returned as
    often as they come; a row without doc_id keeps a null doc_id. A text may be of any length, and so may its words and its runs of white space. The lexicon
    holds the most_words most frequent words of all rows (none for an empty table); it changes the time taken, never the ids.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    small_batches(spark)
    lexicon, model = brought(spark, build_lexicon(docs, tokenizer, most_words), "lexicon"), tokenizer_file(spark, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model, lexicon)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids = [np.frombuffer(x, "<u4") for x in c.buffers(texts)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([c.decode(x.tolist()) for x in ids], pa.string())],
                    ["doc_id", "ids", "decoded"]
                )

    return docs.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole document through the public byte-level tokenizer and back."""
    import public_tokenizers

    coded = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
