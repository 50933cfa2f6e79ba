"""Ids of whole texts by a byte-level BPE vocabulary.

Method: a pass over all texts counts words (the vocabulary's own pre-tokens); the frequent ones
are compiled with their ids into a minimal acyclic transducer, a file in the shared folder. The
encoding pass cuts each batch of texts into words, looks every distinct word of the batch up in
the memory-mapped transducer, and merges those it lacks exactly by the vocabulary's ranks. The
lexicon decides only the speed; the ids are the same with any lexicon, an empty one included.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import files
from siltstone.llm.transducer import Transducer, compile_lexicon
from siltstone.session import scratch, written

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the public pre-token pattern of the byte_bpe_50k vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONGEST_WORD = 32
_STEP = 1 << 20

_MERGERS: dict[str, object] = {}
_LEXICONS: dict[str, Transducer] = {}


def merger(ranks_file: str):
    """The exact merge of one pre-token's bytes by the ranks of a vocabulary file."""
    if ranks_file not in _MERGERS:
        import tiktoken

        ranks = {}
        with open(ranks_file, "rb") as f:
            for line in f:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _MERGERS[ranks_file] = enc._core_bpe.encode_single_piece
    return _MERGERS[ranks_file]


def _pieces(texts: list[str | None], words) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All words of the texts as a dictionary array, and how many each text has."""
    found: list[str] = []
    n = np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        if t:
            w = words(t)
            n[i] = len(w)
            found += w
    return pa.array(found, pa.string()).dictionary_encode(), n


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """Batches cut so that a piece has about a million characters (a longer text is one piece)."""
    for b in batches:
        keys, texts = b.column(0), b.column(1).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= _STEP:
                yield keys.slice(start, i + 1 - start), texts[start : i + 1]
                start, size = i + 1, 0
        if start < len(texts):
            yield keys.slice(start), texts[start:]


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts, of words up to LONGEST_WORD bytes seen twice in some partition."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words = regex.compile(PATTERN).findall
        total: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            kept = [(w, c) for w, c in total.items() if c > 1 and len(w.encode()) <= LONGEST_WORD]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([c for _, c in kept], pa.int64())], names=["word", "n"])

        for _, texts in _chunks(batches):
            found, _n = _pieces(texts, words)
            if len(found):
                c = np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary))
                total.update(dict(zip(found.dictionary.to_pylist(), c.tolist())))
            if len(total) > 500_000:
                yield flush()
        if total:
            yield flush()

    return docs.select(F.lit(0).alias("k"), text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, text: str, ranks_file: str, lexicon_words: int = 60_000) -> str:
    """Compiles the most frequent words, ``lexicon_words`` at most (of 32 bytes at most), into a file.

    A histogram of the counts gives the count from which on the words are few enough, so that no
    more than those ever come to the driver.
    """
    counts = written(count_words(docs, text).withColumn("level", F.floor(F.log2("n") * 8)), "words")
    level, room = None, lexicon_words
    for r in counts.groupBy("level").agg(F.count("*").alias("words")).orderBy(F.desc("level")).collect():
        room -= r.words
        if room < 0:
            break
        level = r.level
    top = counts.where(F.col("level") >= level).collect() if level is not None else []
    merge = merger(ranks_file)
    path = scratch(docs.sparkSession, "lexicon")
    files.put(path, compile_lexicon({w: merge(w) for w in (r.word.encode() for r in top)}))
    return path


def _lexicon(path: str) -> Transducer:
    if path not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[path] = Transducer(files.get(path))
    return _LEXICONS[path]


def _ids(found: pa.DictionaryArray, lexicon: Transducer, merge) -> tuple[np.ndarray, np.ndarray]:
    """(starts, flat) of the ids of each distinct word."""
    words = found.dictionary
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)
    rank = lexicon.ranks(data, offsets[:-1], offsets[1:])
    known = rank >= 0
    size = np.zeros(len(words), dtype=np.int64)
    size[known] = lexicon.starts[rank[known] + 1] - lexicon.starts[rank[known]]
    raw = data.tobytes()
    rest = np.flatnonzero(~known)
    merged = [merge(raw[offsets[i] : offsets[i + 1]]) for i in rest]
    size[rest] = list(map(len, merged))
    starts = np.concatenate([[0], np.cumsum(size)])
    flat = np.empty(starts[-1], dtype=np.int32)
    k = np.flatnonzero(known)
    flat[spread(starts[k], size[k])] = lexicon.ids[spread(lexicon.starts[rank[k]], size[k])]
    if len(rest):
        flat[spread(starts[rest], size[rest])] = np.fromiter((i for m in merged for i in m), dtype=np.int32)
    return starts, flat


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i] + 1, ... of all runs, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def encoded(docs: DataFrame, key: str, text: str, *, vocabulary: str = "byte_bpe_50k", tokenizers: str = TOKENIZERS, lexicon_words: int = 60_000, counts_only: bool = False) -> DataFrame:
    """(key, ids array<int>) of each row, or (key, n_tokens long) if ``counts_only``.

    A null or empty text has the empty list and no tokens. Special tokens are ordinary text. Texts
    of any length are encoded whole; a repeated row is encoded as often as it stands. An empty
    table gives an empty result.
    """
    ranks_file = f"{tokenizers}/{vocabulary}.tiktoken"
    path = build_lexicon(docs, text, ranks_file, lexicon_words)
    kind = docs.schema[key].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        words, merge, lexicon = regex.compile(PATTERN).findall, merger(ranks_file), _lexicon(path)
        for keys, texts in _chunks(batches):
            found, n = _pieces(texts, words)
            ends = np.cumsum(n)
            if len(found):
                starts, flat = _ids(found, lexicon, merge)
                at = found.indices.to_numpy()
                size = (starts[1:] - starts[:-1])[at]
                ends = np.concatenate([[0], np.cumsum(size)])[ends]
            offsets = np.concatenate([[0], ends])
            if counts_only:
                out = pa.array(np.diff(offsets), pa.int64())
            else:
                all_ids = flat[spread(starts[at], size)] if len(found) else np.empty(0, np.int32)
                out = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(all_ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([keys, out], names=[key, "ids"])

    out = docs.select(key, text).mapInArrow(encode, f"`{key}` {kind}, ids {'long' if counts_only else 'array<int>'}")
    return out.withColumnRenamed("ids", "n_tokens") if counts_only else out


