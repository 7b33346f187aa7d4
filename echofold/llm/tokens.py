"""BPE encoding by tree concatenation, and packing by power-of-two decomposition."""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_slice, few, give_back, small_batches, staged

_SPECIAL = b"<|"
#: ASCII punctuation that is a pre-token of its own after letters; an apostrophe may open a contraction.
_TAIL = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Latin letters beyond ASCII that stay single letters in lower case.
_LATIN = "".join(c for c in map(chr, range(0xC0, 0x250)) if c.isalpha() and len(c.lower()) == 1)
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def _steps(part: dict | None, key: str) -> list[dict]:
    return [] if part is None else part[key] if part["type"] == "Sequence" else [part]


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each range, one range after the other."""
    before = np.cumsum(length) - length
    return np.arange(int(length.sum())) + np.repeat(start - before, length)


class _Places(dict):
    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class TreeEncoder:
    """Encodes whole texts with a tokenizer file of the ``tokenizers`` library, as its encode() does.

    It takes BPE files with word ends that lower-case, split by _SPLIT, and drop white space; any other file
    raises a ValueError, as its pre-tokens might cross white space.  Texts then split exactly at white space.
    The ids of distinct pieces are kept; beyond ``cached`` of them the frequent ones stay.  Pieces of up to ``leaf``
    characters that are letters with punctuation behind are encoded many at once, other short ones one by one.

    Unsplit pieces longer than ``leaf`` are halved until their parts fit.  The parts of all pieces are encoded
    together, in as many threads as the task has processors, and neighbours are joined level by level by
    re-encoding a window around the cut.  The window grows until both sides agree: some token inside it has
    the same id and characters as in the left encoding, and some later one as in the right encoding (else it
    reaches the whole pair).  Two neighbouring tokens decide by themselves whether they may stand
    side by side, so what agrees on both sides is the encoding of the whole.
    Pieces that hold a special token's opening go to the library whole.
    """

    def __init__(self, path: str, leaf: int = 256, window: int = 4, cached: int = 100_000):
        from tokenizers import Tokenizer

        with open(path) as f:
            spec = json.load(f)
        normal = [x["type"] for x in _steps(spec["normalizer"], "normalizers")]
        pre = _steps(spec["pre_tokenizer"], "pretokenizers")
        known = spec["model"]["type"] == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and not spec["model"].get("dropout")
        if not (known and normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"].get("Regex") == _SPLIT):
            raise ValueError(f"{path}: not a tokenizer that is known to split at white space")
        bare = {"truncation": None, "padding": None, "post_processor": None}
        load = lambda **other: Tokenizer.from_str(json.dumps(spec | bare | other))
        self.full = load()
        self.plain_ = lambda: load(normalizer=None)
        self.words = load(normalizer=None, added_tokens=[], pre_tokenizer={"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]})
        self.leaf, self.window, self.cached = leaf, window, cached
        self.letters = re.compile(f"[a-z{_LATIN}]{{1,{leaf}}}")
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        size = max(vocabulary.values()) + 1
        self.names = [""] * size
        for t, i in vocabulary.items():
            self.names[i] = t
        self.numbers = [str(i) for i in range(size)]
        self.ends = np.array([t.endswith("</w>") for t in self.names])
        self.forget()

    @cached_property
    def plain(self):
        """The tokenizer for normalised texts; loaded where there are trees."""
        return self.plain_()

    def forget(self) -> None:
        self.known = _Places()
        self.flat = np.zeros(1 << 20, "<u4")
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.hits = np.zeros(0, np.int64)

    def retain(self) -> None:
        """Drop pieces seen once, and the rarer ones beyond half of ``cached``; the others need not be learnt again."""
        kept = np.flatnonzero(self.hits > 1)
        if len(kept) > self.cached // 2:
            most = np.argpartition(self.hits[kept], len(kept) - self.cached // 2)[len(kept) - self.cached // 2 :]
            kept = np.sort(kept[most])
        names, hits = list(self.known), self.hits[kept]
        ids, length = self.flat[_ranges(self.start[kept], self.length[kept])], self.length[kept]
        self.forget()
        for n in kept.tolist():
            self.known[names[n]]
        self.flat = np.concatenate([ids, self.flat])
        self.used, self.length, self.start = len(ids), length, np.cumsum(length) - length
        self.hits = hits // 2 + 1  # what was frequent long ago gives way

    @staticmethod
    def pieces(text: str | None) -> list[bytes]:
        """The white-space pieces of a text, A-Z lower-cased but where a special token may stand."""
        data = (text or "").encode()
        if _SPECIAL in data:
            return [x if _SPECIAL in x else x.lower() for x in data.split()]
        return data.lower().split()

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends."""
        if len(self.known) > self.cached:
            self.retain()
        at, before, place = [], len(self.known), self.known.__getitem__
        for t in texts:
            own = self.pieces(t)
            at.append(np.fromiter(map(place, own), np.int64, len(own)))
        if len(self.known) > before:
            self.learn(list(islice(self.known, before, None)))
        counts = np.array([len(x) for x in at], np.int64)
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.hits = np.bincount(flat, minlength=len(self.known)) + np.append(self.hits, np.zeros(len(self.known) - len(self.hits), np.int64))
        lengths = self.length[flat]
        ids = self.flat[_ranges(self.start[flat], lengths)]
        return ids, np.append(0, np.cumsum(lengths))[np.cumsum(counts)]

    def learn(self, fresh: list[bytes]) -> None:
        """Encode new pieces and put their ids behind those of the others, in this order."""
        pieces = b" ".join(fresh).decode().split(" ")
        heads = [x.rstrip(_TAIL) for x in pieces]
        tails = [x[len(h) :] for x, h in zip(pieces, heads, strict=True)]
        heads = " ".join(heads).lower().split(" ")
        plain = [m is not None for m in map(self.letters.fullmatch, heads)]
        for i, x in enumerate(fresh):
            if plain[i] and _SPECIAL in x:
                plain[i] = False
        # each distinct head, tail and other piece is encoded once
        words, odd = {}, {}
        for x, h, t, p in zip(pieces, heads, tails, plain, strict=True):
            if p:
                words[h] = words[t] = 0
            else:
                odd[x] = 0
        words.pop("", None)
        (flat, size), (flat2, size2) = self.together(list(words)), self.one_by_one(list(odd))
        flat, size = np.concatenate([flat, flat2]), np.concatenate([size, size2, [0]])
        first = np.cumsum(size) - size
        slot = {x: i for i, x in enumerate(words)}
        slot[""] = len(size) - 1
        others = {x: i for i, x in enumerate(odd, len(slot) - 1)}
        pairs = np.array([(slot[h], slot[t]) if p else (others[x], -1) for x, h, t, p in zip(pieces, heads, tails, plain, strict=True)])
        where = _ranges(first[pairs].ravel(), size[pairs].ravel())
        length = size[pairs].sum(axis=1)
        need = self.used + len(where)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(need, "<u4")])
        self.flat[self.used : need] = flat[where]
        self.start = np.append(self.start, self.used + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.used = need

    def together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of letters or of punctuation in a row, and how many each has: many a call, cut where a token ends a word."""
        lines = [" ".join(words[i : i + 128]) for i in range(0, len(words), 128)]
        ids = np.array([i for e in self.words.encode_batch_fast(lines, add_special_tokens=False) for i in e.ids], "<u4")
        counts = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        if len(counts) != len(words):
            raise ValueError("a word has no end")
        return ids, counts

    def one_by_one(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of other pieces: of short ones by a call each in a batch, of long ones as trees."""
        out: dict[str, list[int]] = {}
        long = [x for x in pieces if len(x) > self.leaf and _SPECIAL.decode() not in x]
        out.update(zip(long, self.trees([self.full.normalizer.normalize_str(x) for x in long]), strict=True))
        short = [x for x in pieces if x not in out]
        out.update((x, e.ids) for x, e in zip(short, self.full.encode_batch_fast(short, add_special_tokens=False), strict=True))
        return np.array([i for x in pieces for i in out[x]], "<u4"), np.array([len(out[x]) for x in pieces], np.int64)

    def trees(self, texts: list[str]) -> list[list[int]]:
        """Encode normalised texts without white space by joining the encodings of their halves."""
        spans = []
        for text in texts:
            cuts = [(0, len(text))]
            while any(b - a > self.leaf for a, b in cuts):
                cuts = [x for a, b in cuts for x in (((a, (a + b) // 2), ((a + b) // 2, b)) if b - a > self.leaf else ((a, b),))]
            spans.append(cuts)
        done = iter(self.plain.encode_batch([text[a:b] for text, cuts in zip(texts, spans, strict=True) for a, b in cuts], add_special_tokens=False))
        parts = [[_placed(next(done), a) for a, _ in cuts] for cuts in spans]
        while any(len(p) > 1 for p in parts):
            todo = []  # (text, a, m, b, left, right): all joins of this level
            for text, cuts, own in zip(texts, spans, parts, strict=True):
                todo += [(text, *cuts[k], cuts[k + 1][1], own[k], own[k + 1]) for k in range(0, len(own) - 1, 2)]
            joined = iter(self.joins(todo))
            for t, (cuts, own) in enumerate(zip(spans, parts, strict=True)):
                parts[t] = [next(joined) if k + 1 < len(own) else own[k] for k in range(0, len(own), 2)]
                spans[t] = [(cuts[k][0], cuts[min(k + 1, len(cuts) - 1)][1]) for k in range(0, len(cuts), 2)]
        return [[t[0] for t in own[0]] for own in parts]

    def joins(self, todo: list[tuple]) -> list[list]:
        """One encoding of text[a:b] from those of text[a:m] and text[m:b], for each join; a round encodes all windows together."""
        out: list = [None] * len(todo)
        left, width = list(range(len(todo))), self.window
        while left:
            places = []
            for n in left:
                _, a, _, b, x, y = todo[n]
                i, j = max(0, len(x) - width), min(len(y), width)
                places.append((i, j, x[i][1] if i else a, y[j - 1][2] if j < len(y) else b))
            found = self.plain.encode_batch([todo[n][0][lo:hi] for n, (_, _, lo, hi) in zip(left, places, strict=True)], add_special_tokens=False)
            open_ = []
            for n, (i, j, lo, _), e in zip(left, places, found, strict=True):
                out[n] = _agreed(todo[n][4], todo[n][5], _placed(e, lo), i, j, todo[n][2])
                if out[n] is None:
                    open_.append(n)
            left, width = open_, width * 2
        return out

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives where the file has no decoder."""
        if self.full.decoder is not None:
            return self.full.decode(ids, skip_special_tokens=False)
        return " ".join(map(self.names.__getitem__, ids))


def _placed(e, at: int) -> list[tuple[int, int, int]]:
    return [(i, x + at, y + at) for i, (x, y) in zip(e.ids, e.offsets, strict=True)]


def _agreed(left: list, right: list, middle: list, i: int, j: int, m: int) -> list | None:
    """left, middle and right cut where they agree, or None; middle is a window from left[i] up to right[j - 1]."""
    # multi-byte characters may share an offset, so only a token that stands once counts
    place = {t: k for k, t in enumerate(middle) if t[2] > t[1]}
    if len(place) < len(middle):
        twice = {t for t, n in Counter(middle).items() if n > 1}
        place = {t: k for t, k in place.items() if t not in twice}
    from_left = 0 if i == 0 else next((k for k in range(len(left) - 1, i, -1) if left[k] in place and left[k][2] <= m), None)
    from_right = len(right) if j == len(right) else next((k for k in range(j - 1) if right[k] in place), None)
    if from_left is None or from_right is None:
        return None
    x = place[left[from_left]] if i else 0
    y = place[right[from_right]] if j < len(right) else len(middle)
    return left[:from_left] + middle[x:y] + right[from_right:] if x <= y else None


#: How many characters one call of the library gets: its own records of tokens are many times their size.
_AT_ONCE = 1_000_000
_ENCODERS: dict[tuple[str, int], TreeEncoder] = {}


def released(batches: Iterator) -> Iterator:
    """batches; behind the last one the worker's encoder goes, which else an idle worker would hold through other stages."""
    yield from batches
    _ENCODERS.clear()
    give_back()


def encoder(path: str, leaf: int = 256) -> TreeEncoder:
    """One encoder for each file and worker process, with as many threads as the task has processors."""
    if (path, leaf) not in _ENCODERS:
        task = TaskContext.get()
        threads = task.cpus() if task else 1
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true" if threads > 1 else "false")
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        _ENCODERS.clear()  # a worker holds one at a time
        _ENCODERS[path, leaf] = TreeEncoder(path, leaf)
    return _ENCODERS[path, leaf]


def bpe_round_trip(docs: DataFrame, path: str, leaf: int = 256, id_col: str = "doc_id", text_col: str = "text", tokens: bool = False) -> DataFrame:
    """Encode and decode whole texts: id, n_tokens, ids_sha256, decoded_sha256; with tokens also ids and decoded.

    Unsplit pieces of over ``leaf`` characters are encoded as trees of halves (see TreeEncoder).
    A null text counts as empty: no tokens and the digests of the empty string.  Each row gives one
    row, repeated ids included; other columns are ignored.  An empty table gives no rows.  No shuffle.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<bigint>, decoded string" * tokens

    def make(batch):
        enc, rows, at = encoder(path, leaf), [], 0
        ids, ends = enc.encode_all(batch.column("text").to_pylist())
        for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
            listed, at = ids[at:end].tolist(), end
            decoded = enc.decode(listed)
            rows.append((doc, len(listed), sha256(" ".join(map(enc.numbers.__getitem__, listed)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest(), *([listed, decoded] if tokens else [])))
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if tokens else [])]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), *([pa.list_(pa.int64()), pa.string()] if tokens else [])]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lambda batches: released(by_slice(make, chars=_AT_ONCE)(batches)), schema)


def binary_lengths(n: int, capacity: int) -> list[int]:
    """The pieces of a document of n tokens: whole sequences, then the powers of two of the rest, largest first."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [1 << k for k in range(capacity.bit_length() - 1, -1, -1) if rest >> k & 1]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per binary-length piece of each document: doc_id, start, length, ids_crc32, doc_tokens, task, nth (and ids).

    nth numbers the pieces of one length in one task, from 0.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]

    def run(batches):
        task, seen = TaskContext.get().partitionId(), Counter()
        last = np.array([end_id], dtype="<u4").tobytes()

        def make(batch):
            enc, rows, kept, before = encoder(path), [], [], 0
            ids, ends = enc.encode_all(batch.column("text").to_pylist())
            for doc, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                data, before = ids[before:end].tobytes() + last, end
                n, at = len(data) // 4, 0
                for k in binary_lengths(n, capacity):
                    own = data[4 * at : 4 * (at + k)]
                    rows.append((doc, at, k, zlib.crc32(own), n, task, seen[k]))
                    seen[k] += 1
                    if keep_ids:
                        kept.append(own)
                    at += k
            arrays = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays(arrays + [pa.array(kept, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

        yield from released(by_slice(make, chars=_AT_ONCE)(batches))

    schema = ", ".join(f"{n} bigint" for n in names) + ", ids binary" * keep_ids
    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def pack_power_of_two(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, joined: bool = True) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens by power-of-two decomposition.

    Each document (its ids, then end_id) is cut into whole sequences and the binary pieces of its
    rest.  Pieces of one length form a bucket; in bucket k every capacity/k pieces fill a sequence,
    numbered in bucket order, so a sequence holds pieces of equal length, and only the last one in each
    bucket may be short.
    Unless ``joined``, each piece is a sequence of its own length (offset 0), numbered in bucket
    order, so that no sequence crosses documents and none has padding.
    A piece's place in its bucket is that of its task, known from counts, and its number within the
    task, so pieces aren't shuffled.

    A null text is empty: one piece that holds only end_id.  Repeated rows are packed as often as
    they occur.  Null ids are kept.  Other columns are ignored.  An empty table gives no rows.
    Adds sequence_id (unique) and offset (gapless from 0 in each sequence).
    """
    pieces = staged(token_pieces(docs, path, capacity, end_id, id_col, text_col, keep_ids), "pieces")
    # one row a task and length
    counts = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    per = (F.lit(capacity) / F.col("length")).cast("bigint") if joined else F.lit(1).cast("bigint")
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("all")).withColumn("sequences", F.ceil(F.col("all") / per))
    # one row a length
    first = totals.withColumn("first", F.sum("sequences").over(Window.orderBy(F.desc("length"))) - F.col("sequences")).select("length", "first")
    bases = staged(before.join(F.broadcast(first), "length").select("length", "task", "before", "first"), "bases")
    ordinal = F.col("before") + F.col("nth")
    return (
        pieces.join(few(bases), ["length", "task"])
        .withColumn("per", per)
        .withColumn("sequence_id", (F.col("first") + F.floor(ordinal / F.col("per"))).cast("bigint"))
        .withColumn("offset", (F.pmod(ordinal, F.col("per")) * F.col("length")).cast("bigint"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else []))
    )
