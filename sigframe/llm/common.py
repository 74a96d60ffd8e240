"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
TOKENIZER = "byte_bpe_50k.json"
#: Words and their ids that a worker keeps: about 250 bytes each.
PIECES = 900_000
MARKS = ".,;:!?%$*&#|)"
#: Tables of narrow rows (keys of some ten bytes) up to so many rows are broadcast.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir`` that driver and executors all see.

    Only where that setting is absent (tests, one machine) a temporary folder is set for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        if known.isDefined():
            base = known.get()
        else:
            base = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/sigframe-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back: lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame) -> DataFrame:
    """To be broadcast where it is counted and found small, otherwise joined by a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def repeated(df: DataFrame, count: str, keys: list[str], chunk: int = 1000) -> DataFrame:
    """Each row as often as its column ``count`` says, without that column. Rows that come very often are dealt out over tasks by ``keys`` and their number."""
    upto = lambda first, last: F.explode(F.sequence(first, last))
    usual = df.where(F.col(count) <= chunk).withColumn("_again", upto(F.lit(1).cast("long"), F.col(count)))
    often = df.where(F.col(count) > chunk).withColumn("_chunk", upto(F.lit(0).cast("long"), F.floor((F.col(count) - 1) / chunk)))
    often = often.repartition(*keys, "_chunk")
    often = often.withColumn("_again", upto(F.lit(1).cast("long"), F.least(F.lit(chunk), F.col(count) - F.col("_chunk") * chunk)))
    return usual.drop(count, "_again").unionByName(often.drop(count, "_again", "_chunk"))


def whole_text(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(text: Column) -> Column:
    """Lower-cases A-Z; other letters may be lowered too, but none of them becomes an ASCII letter."""
    odd = text.contains("K") | text.contains("İ")
    return F.when(odd, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space, and marks that some engines count as such, other than a space and a line end.
OTHER_SPACE = "\\x{00}-\\x{09}\\x{0b}-\\x{1f}\\x{7f}-\\x{a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200f}\\x{2028}-\\x{202f}\\x{205f}\\x{3000}\\x{feff}"
#: Texts that aren't cut into words: with other white space, or spaces and line ends not between two other characters.
NOT_PLAIN = f"[{OTHER_SPACE}]|[ \\n][ \\n]|^[ \\n]|[ \\n]$|^$"


class PieceEncoder:
    """Encodes whole texts with a byte-level BPE of the tokenizers library, each distinct word once.

    Such a BPE never merges across a single space or line end between two other characters, so
    the text is cut there, words seen before come from a table, and the library encodes
    the rest. Texts with any other white space, and those with a special token's string, go to the library whole. The table
    takes ``max_pieces`` words of up to ``WIDE`` characters; others are encoded again in each batch.
    """

    LONG, WIDE = 1 << 20, 200

    def __init__(self, path: str, max_pieces: int = PIECES) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.max_pieces = max_pieces
        size = self.tok.get_vocab_size()
        self.opens = np.array([(self.tok.id_to_token(i) or "").startswith("Ġ") for i in range(size)])
        self.newline = int(self._ids("\n")[0])
        special = [re.escape(t.content) for t in self.tok.get_added_tokens_decoder().values()]
        self.not_plain = "|".join([NOT_PLAIN, *special])
        self.marks: dict[str, np.ndarray] = {}
        self.known: dict[str, int] = {"": 0}
        self.pool, self.used = np.zeros(1 << 16, "<u4"), 0  # ids of all words of the table
        self.first, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)  # where a word's ids are

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _suffix(self, marks: str) -> np.ndarray:
        if marks not in self.marks:
            self.marks[marks] = self._ids(marks)
        return self.marks[marks]

    def _learn(self, words: list[str]) -> None:
        """Marks after a word's last letter are pieces of their own. Words that begin a line have the line end before them, all others a space."""
        known, marked, lines, others = self.known, {}, {}, {}
        for w in words:
            stem = w.rstrip(MARKS)
            if len(stem) == len(w) or not stem or not stem[-1].isalnum():
                stem = w
            else:
                marked.setdefault(w[len(stem) :], []).append((w, stem))
            if stem not in known:
                (lines if stem[0] == "\n" else others)[stem] = None
        for some, first in ((lines, True), (others, False)):
            if some:
                ids = self._ids("".join(some) if first else " " + " ".join(some))
                at = np.flatnonzero(ids == self.newline if first else self.opens[ids])
                self._put(list(some), ids, np.diff(np.r_[at, len(ids)]))
        for marks, pairs in marked.items():
            stem, end = np.fromiter((known[x] for _, x in pairs), np.int64, len(pairs)), self._suffix(marks)
            size = self.size[stem] + len(end)
            close = np.cumsum(size)
            ids = np.empty(int(close[-1]), "<u4")
            inside = np.ones(len(ids), bool)
            for k in range(len(end)):
                ids[close - len(end) + k] = end[k]
                inside[close - len(end) + k] = False
            ids[inside] = _gather(self.pool, self.first[stem], self.size[stem])
            self._put([w for w, _ in pairs], ids, size)

    def _put(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        at = len(self.known)
        self.pool = _room(self.pool, self.used, len(ids))
        self.first, self.size = _room(self.first, at, len(words)), _room(self.size, at, len(words))
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[at : at + len(words)] = self.used + np.cumsum(size) - size
        self.size[at : at + len(words)] = size
        self.known.update(zip(words, range(at, at + len(words)), strict=True))
        self.used += len(ids)

    def _forget(self, before: int) -> None:
        """Keeps the words met first: frequent ones come early. Of those from ``before`` on, none stays that is too wide."""
        new = list(islice(self.known, before, None))
        stay = next((k for k, w in enumerate(new) if before + k >= self.max_pieces or len(w) > self.WIDE), len(new))
        for w in new[stay:]:
            del self.known[w]
        if stay < len(new):
            self.used = int(self.first[before + stay])

    def _whole(self, text: str) -> np.ndarray:
        out, at = [], 0
        while len(text) - at > self.LONG and (m := re.compile(r"(?<=\S) (?=\S)").search(text, at + self.LONG)):
            out.append(self._ids(text[at : m.start()]))
            at = m.start()
        return np.concatenate([*out, self._ids(text[at:])])

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin (one place more, the end)."""
        plain = pc.invert(pc.match_substring_regex(texts, self.not_plain))
        lined = pc.replace_substring(pc.binary_join_element_wise("\n", texts.filter(plain), ""), "\n", " \n")
        lists = pc.split_pattern(lined, " ")  # of each text an empty word, and then its words
        words = lists.flatten().dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False)
        before = len(self.known)
        number = np.fromiter(map(self.known.get, different, repeat(-1)), np.int64, len(different))
        new = np.flatnonzero(number < 0)
        if len(new):
            self._learn(different[new].tolist())
            number[new] = np.fromiter(map(self.known.get, different[new]), np.int64, len(new))
        place = number[words.indices.to_numpy()]
        first, size = self.first[place], self.size[place]
        opening = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
        opening = np.r_[0, opening[:-1]] + 1 if len(opening) else opening
        first[opening] += 1  # the line end put before the text
        size[opening] -= 1
        flat, ends = _gather(self.pool, first, size), np.cumsum(size)
        if len(new):
            self._forget(before)
        plain = plain.to_numpy(zero_copy_only=False)
        lengths = np.zeros(len(texts), np.int64)
        begins = (ends - size)[opening - 1] if len(opening) else np.zeros(0, np.int64)
        lengths[plain] = np.diff(np.r_[begins, len(flat)])
        if plain.all():
            return flat, np.r_[0, np.cumsum(lengths)]
        own = iter(np.split(flat, begins[1:]) if len(begins) else [])
        odd = iter([self._whole(x.as_py()) for x in texts.filter(pa.array(~plain))])
        ids = [next(own) if p else next(odd) for p in plain]
        return np.concatenate(ids), np.r_[0, np.cumsum([len(x) for x in ids])]

    def encode_all(self, texts: pa.Array, size: int = 1_000_000) -> Iterator[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers; texts are taken by portions of about so many bytes."""
        portion = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // size
        for part in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(portion)) + 1):
            if len(part):
                ids, at = self.encode_batch(texts.slice(int(part[0]), len(part)))
                raw = ids.tobytes()
                yield from (raw[4 * a : 4 * b] for a, b in zip(at.tolist(), at[1:].tolist(), strict=False))


def _gather(pool: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """So many places of the pool from each first one on, in a row."""
    ends = np.cumsum(size)
    at = np.repeat(first - (ends - size), size)
    at += np.arange(len(at))
    return pool[at]


def _room(a: np.ndarray, used: int, more: int) -> np.ndarray:
    """The array, or one that has room for so many more."""
    if used + more <= len(a):
        return a
    out = np.zeros(max(used + more, 2 * len(a)), a.dtype)
    out[:used] = a[:used]
    return out


_ENCODERS: dict[tuple, PieceEncoder] = {}


def encoder(path: str, pieces: int) -> PieceEncoder:
    """One encoder for each Python worker."""
    if (path, pieces) not in _ENCODERS:
        release()
        _ENCODERS[path, pieces] = PieceEncoder(path, pieces)
    return _ENCODERS[path, pieces]


def release() -> None:
    """Gives up the word tables of a worker that goes on with other work."""
    _ENCODERS.clear()
    trim()


def trim() -> None:
    """Gives memory that is no longer in use back to the system; a worker waits for its next task beside others."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back:
        give_back(0)


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` of a task, and at its end the memory given back."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in smaller parts, so that what is made of one stays small."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
