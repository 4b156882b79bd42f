"""Token counts by rank-synchronous array merging.

A byte-level BPE file gives ranked merges. All texts of a run are cut into pre-tokens at once, by
classes of code points; the distinct pre-tokens are one ragged array of symbols. Each round finds the
lowest rank in every sequence (a segmented minimum), merges that pair wherever it stands in the
sequence, and takes sequences without a pair out, noting how many symbols survive. A merged symbol only
occurs in pairs of higher rank, so a round does what one-by-one merging does. Pre-tokens
beyond LONG bytes (unbroken runs of letters) take the same steps over buckets of positions by rank,
so that a round costs what it merges, not the whole run.
"""

from __future__ import annotations

import heapq
import json
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _R, _RINV, _powers, mix, read, slices

#: Bytes from which a pre-token is merged by rank buckets.
LONG = 2048
#: Tokens above which a text is over the limit.
LIMIT = 1024
_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _OTHER, _SPACE = 0, 1, 2, 3


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself where it is
    printable, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=4)
def _classes(path: str) -> bytes:
    """Letter, number, other or space for every code point, as the library itself tells them
    apart: what it leaves joined with a letter, a digit, a sign."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(path).pre_tokenizer
    out = np.full(0x110000, _OTHER, np.uint8)
    todo = [(at, at + 256) for at in range(0, 0x110000, 256) if not 0xD800 <= at < 0xE000]  # surrogates are in no text
    while todo:
        low, high = todo.pop()
        block = "".join(map(chr, range(low, high)))
        kind = next((k for k, sign in ((_OTHER, "!"), (_LETTER, "a"), (_NUMBER, "1")) if len(pieces.pre_tokenize_str(sign + block)) == 1), None)
        if kind is None and high - low > 1:  # of several classes: look at the halves
            middle = (low + high) // 2
            todo += [(low, middle), (middle, high)]
        else:
            out[low:high] = _SPACE if kind is None else kind
    return out.tobytes()


class Merges:
    """The arrays of one vocabulary file; their size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        cut = spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model.get("type", "BPE") != "BPE" or not plain or spec["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added) or len(added) > 1:
            raise ValueError(f"{path} has added tokens with rules of their own")
        self.special = [a["content"] for a in added]
        vocab = model["vocab"]
        self.byte_symbol = np.array([vocab[c] for c in _byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys, ranks = np.unique(keys, return_index=True)  # of a pair named twice the first rank counts
        self.keys, self.ranks = keys, ranks.astype(np.int32)
        self.classes = np.frombuffer(_classes(path), np.uint8)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)


def cut_points(points: np.ndarray, classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point; first marks the starts of texts.

    Runs of one class are pre-tokens. White space before something else gives its last character
    up: a space joins what follows, any other stands alone. An apostrophe that opens a run and is followed by
    s, t, m, d, re, ve or ll takes those letters along.
    """
    n = len(points)
    kind = classes[points]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~first[1:])
    start[last] = True
    start[last + 1] = points[last] != 32

    def same(i: np.ndarray) -> np.ndarray:
        """Letters that go on in the text of the code point before."""
        inside = i < n
        j = np.where(inside, i, 0)
        return inside & (kind[j] == _LETTER) & ~first[j]

    def letter(i: np.ndarray) -> np.ndarray:
        return np.where(same(i), points[np.minimum(i, n - 1)], 0)

    quote = np.flatnonzero(start & (points == 39))
    quote = quote[same(quote + 1)]
    a, b = letter(quote + 1), letter(quote + 2)
    one = np.isin(a, [ord(c) for c in "stmd"])
    two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
    for hit, width in ((one, 1), (two, 2)):
        at = quote[hit]
        start[at + 1] = False
        rest = at + 1 + width
        start[rest[same(rest)]] = True
    return start


def survivors(symbols: np.ndarray, lengths: np.ndarray, m: Merges) -> np.ndarray:
    """Number of symbols left of each sequence (all of length one or more) of a ragged array."""
    out = lengths.astype(np.int64)
    sequence = np.repeat(np.arange(len(lengths)), lengths)
    rank = np.full(len(symbols), _NONE, np.int32)
    inner = np.flatnonzero(sequence[1:] == sequence[:-1])
    rank[inner] = m.rank(symbols[inner], symbols[inner + 1])
    while len(symbols):
        starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
        sizes = np.diff(np.r_[starts, len(symbols)])
        lowest = np.minimum.reduceat(rank, starts)
        out[sequence[starts]] = sizes
        live = np.repeat(lowest != _NONE, sizes)
        hit = np.flatnonzero(live & (rank == np.repeat(lowest, sizes)))
        # a pair of two equal symbols overlaps itself in a run of them: every other one is merged
        run = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1]) if len(hit) else hit
        hit = hit[(hit - np.repeat(hit[run], np.diff(np.r_[run, len(hit)]))) % 2 == 0]
        symbols[hit] = m.merged[rank[hit]]
        live[hit + 1] = False  # what is kept
        place = np.cumsum(live) - 1
        symbols, rank, sequence = symbols[live], rank[live], sequence[live]
        new = place[hit]
        for left in (new, new[new > 0] - 1):
            left = left[left < len(symbols)]
            rank[left] = _NONE
            left = left[left + 1 < len(symbols)]
            left = left[sequence[left] == sequence[left + 1]]
            rank[left] = m.rank(symbols[left], symbols[left + 1])
    return out


def survivors_long(symbols: np.ndarray, m: Merges) -> int:
    """The same for one long sequence: positions wait in a bucket for each rank, lowest rank first."""
    n = len(symbols)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    rank = np.append(m.rank(symbols[:-1], symbols[1:]), _NONE)
    buckets: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    queue: list[int] = []

    def wait(at: np.ndarray) -> None:
        at = at[rank[at] != _NONE]
        at = at[np.argsort(rank[at], kind="stable")]
        for part in np.split(at, np.flatnonzero(np.diff(rank[at])) + 1) if len(at) else ():
            r = int(rank[part[0]])
            if r not in buckets:
                heapq.heappush(queue, r)
            buckets[r].append(part)

    wait(np.arange(n))
    left = n
    while queue:
        r = heapq.heappop(queue)
        at = np.unique(np.concatenate(buckets.pop(r)))
        at = at[rank[at] == r]
        if not len(at):
            continue
        run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
        order = np.arange(len(at))
        at = at[(order - np.repeat(run, np.diff(np.r_[run, len(at)]))) % 2 == 0]
        gone = after[at]
        symbols[at] = m.merged[r]
        rank[gone] = _NONE
        after[at] = after[gone]
        ahead = after[at]
        before[ahead[ahead < n]] = at[ahead < n]
        left -= len(at)
        touched = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        follow = after[touched]
        inside = follow < n
        rank[touched] = _NONE
        rank[touched[inside]] = m.rank(symbols[touched[inside]], symbols[follow[inside]])
        wait(touched)
    return left


def _count(texts: list[bytes], m: Merges) -> np.ndarray:
    """Tokens of each text."""
    pieces: list[str] = []
    owner: list[int] = []
    out = np.zeros(len(texts), np.int64)
    for i, raw in enumerate(texts):
        text = raw.decode("utf-8", "replace")
        parts = [text]
        for s in m.special:
            parts = text.split(s) if s in text else parts
        out[i] += len(parts) - 1
        kept = [p for p in parts if p]
        pieces += kept
        owner += [i] * len(kept)
    if not pieces:
        return out
    whole = "".join(pieces)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(whole.encode(), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    first = np.zeros(len(points), bool)
    first[np.r_[0, ends[:-1]]] = True
    start = np.flatnonzero(cut_points(points, m.classes, first))
    text_of = np.asarray(owner)[np.searchsorted(ends, start, side="right")]
    width = (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF) + 1
    offset = np.r_[0, np.cumsum(width, dtype=np.int64)]
    begin = offset[start]
    length = np.diff(np.r_[begin, len(data)])

    # each distinct pre-token is merged once; hashes bring equals together, bytes decide
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_R, len(data)), dtype=np.uint64)]
    digest = mix((sums[begin + length] - sums[begin]) * _powers(_RINV, len(data))[begin] + length.astype(np.uint64))
    _, pick, which = np.unique(digest, return_index=True, return_inverse=True)
    shift = np.repeat(begin[pick][which] - begin, length)
    same = length[pick][which] == length
    if not same.all() or not np.array_equal(data, data[np.arange(len(data)) + shift]):
        pick = which = np.arange(len(start))
    begin, length = begin[pick], length[pick]

    counts = np.empty(len(pick), np.int64)
    short = length <= LONG
    s_begin, s_length = begin[short], length[short]
    inside = np.repeat(s_begin - np.r_[0, np.cumsum(s_length)[:-1]], s_length) + np.arange(s_length.sum()) if len(s_length) else np.empty(0, np.int64)
    counts[short] = survivors(m.byte_symbol[data[inside]], s_length, m)
    for i in np.flatnonzero(~short):
        counts[i] = survivors_long(m.byte_symbol[data[begin[i] : begin[i] + length[i]]], m)
    return out + np.bincount(text_of, counts[which], len(texts)).astype(np.int64)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    path names a byte-level BPE file of the tokenizers library, read by the driver; its arrays (the
    size of the file, whatever the table) go to every task. Counts equal the library's without begin, end or
    padding: its special string inside a text is one token. Null and empty texts have 0 bytes and
    tokens; bytes that are not UTF-8 count as the replacement character. Rows are independent: repeated rows give
    repeated results, an empty table an empty one; other columns are ignored. No shuffle; texts are
    taken in runs of some 2 MB, a longer text is a run of its own.
    """
    merges = docs.sparkSession.sparkContext.broadcast(Merges(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merges.value
        for b in batches:
            ids = b.column("id")
            for at, texts in slices(b, "text"):
                n = _count(texts, m)
                size = np.array([len(t) for t in texts], np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(texts)), pa.array(size), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = own.mapInArrow(run, f"id {own.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
    return out.withColumnRenamed("id", id_col)


def op11_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
