"""Quality rules: repetition within a document by a suffix array and its longest common prefixes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, small_batches

_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"
_WORD = re.compile("[^\x20\x09-\x0d]")


class _Ids(dict):
    def __missing__(self, key):
        self[key] = out = len(self) + 1
        return out


def longest_repeats(ids: np.ndarray, doc: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each word position of a run of documents, the longest repeat that starts there, in words (1 counts as 0).

    Word ids are at least 1; doc numbers the documents; counts has their lengths.  The suffixes of
    all documents are sorted at once by prefix doubling; only groups that still tie are sorted again.
    A suffix's deepest LCP interval is the larger of its LCPs with its two neighbours in the array,
    found from the ranks kept for each doubled length.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    left = np.repeat(np.cumsum(counts), counts) - np.arange(n)  # words up to the document's end
    width = int(ids.max()) + 1
    own = doc * width + ids
    after = np.where(left > 1, np.append(ids[1:], 0), 0)
    key = own * width + after

    def ranked(key, base):
        """Order of key, and for each place in it the first place with an equal key, plus base."""
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(len(s), bool)
        new[0] = True
        np.not_equal(s[1:], s[:-1], out=new[1:])
        start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        return order, start, new

    order, start, new = ranked(key, 0)
    rank = np.empty(n, np.int64)
    rank[order] = start
    levels, length = [(2, rank.copy())], 2
    tied = ~(new & np.append(new[1:], True))
    todo = order[tied]
    while len(todo):
        nxt = np.where(left[todo] > length, rank[np.minimum(todo + length, n - 1)] + 1, 0)
        group = rank[todo]
        order, start, new = ranked(group * (n + 2) + nxt, 0)
        pos, group = todo[order], group[order]
        first = np.empty(len(pos), bool)
        first[0] = True
        np.not_equal(group[1:], group[:-1], out=first[1:])
        group_start = np.maximum.accumulate(np.where(first, np.arange(len(pos)), 0))
        rank[pos] = group + start - group_start
        length *= 2
        tied = ~(new & np.append(new[1:], True))
        todo = pos[tied]
        levels.append((length, rank.copy()))
    at = np.empty(n, np.int64)
    at[rank] = np.arange(n)
    low = levels[0][1]
    near = np.flatnonzero(low[at[1:]] == low[at[:-1]])  # neighbours that share two words or more
    a, b = at[near], at[near + 1]
    lcp = np.zeros(len(a), np.int64)
    for size, r in reversed(levels):
        r = np.append(r, -1)
        same = r[np.minimum(a + lcp, n)] == r[np.minimum(b + lcp, n)]
        lcp += size * same
    tail = np.append(own, -1)
    x, y = np.minimum(a + lcp, n), np.minimum(b + lcp, n)
    lcp += (tail[x] == tail[y]) & (x < n) & (y < n)
    out = np.zeros(n, np.int64)
    np.maximum.at(out, a, lcp)
    np.maximum.at(out, b, lcp)
    return out


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in the union of the spans."""
    edge = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(starts + lengths, minlength=n + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


def _judge(texts: list[str | None], min_repeat: int, max_covered: float, max_longest: int, min_words: int) -> list[np.ndarray]:
    """The measures of repetition_rules, in its order, for a run of texts."""
    texts = [t or "" for t in texts]
    ids, words, chars, symbols, lines = _Ids(), [], [], [], []
    for text in texts:
        own = text.encode().split()
        words.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
        chars.append(len(text) - sum(map(text.count, _SPACES)))
        symbols.append(sum(map(text.count, _SYMBOLS)))
        parts = text.split("\n")
        lines.append(0 if len(parts) < 2 or len(set(parts)) == len(parts) else len(kept := [x for x in parts if _WORD.search(x)]) - len(set(kept)))
    counts = np.array([len(w) for w in words], np.int64)
    flat, doc = np.concatenate(words), np.repeat(np.arange(len(words)), counts)
    repeat = longest_repeats(flat, doc, counts)
    n, k = len(flat), len(words)

    def per_doc(least, width=None):
        starts = np.flatnonzero(repeat >= least)
        spans = repeat[starts] if width is None else np.full(len(starts), width)
        return np.bincount(doc[covered(starts, spans, n)], minlength=k) if n else np.zeros(k, np.int64)

    windows, spans = per_doc(3, 3), per_doc(min_repeat)
    longest = np.zeros(k, np.int64)
    np.maximum.at(longest, doc, repeat)
    failed = (counts < min_words) | (100 * windows > 50 * counts)
    kept = ~failed & (spans <= max_covered * counts) & (longest <= max_longest)
    return [counts, np.array(chars, np.int64), np.array(symbols, np.int64), np.array(lines, np.int64), windows, failed, spans, longest, kept]


def repetition_rules(docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Word counts, repeats and a verdict for each whole text.

    Words are runs without ASCII white space.  Repeated substrings of at least min_repeat words are
    found by suffix array; their spans are united.  A document is rejected if it fails the base
    rules (fewer than min_words words, or over half of its words in repeated 3-word windows), or if
    the spans cover more than max_covered of its words, or if one repeat is longer than max_longest.

    A null text has no words and fails the base.  Each row gives one row, null and repeated ids
    included; other columns are ignored.  No shuffle; work is n log n in a text's length.
    """
    schema = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, covered_words bigint, longest_repeat bigint, kept boolean"

    def make(batch):
        found = _judge(batch.column("text").to_pylist(), min_repeat, max_covered, max_longest, min_words)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found)], names=[x.split()[0] for x in schema.split(", ")])

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_slice(make), schema)


def keep_documents(docs: DataFrame, min_repeat: int = 10, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text repetition_rules keeps; one pass without a shuffle."""

    def make(batch):
        return batch.filter(pa.array(_judge(batch.column(text_col).to_pylist(), min_repeat, max_covered, max_longest, min_words)[-1]))

    return small_batches(docs).mapInArrow(by_slice(make, text_col), docs.schema)
