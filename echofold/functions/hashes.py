"""32-bit hashes and MinHash signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_M = np.uint64(0xFFFFFFFF)
_FNV_BASIS, _FNV_PRIME, _GOLDEN = 0x811C9DC5, 0x01000193, 0x9E3779B1


def fnv1a(text: str) -> int:
    """32-bit FNV-1a over UTF-16 code units."""
    h = _FNV_BASIS
    data = text.encode("utf-16-le", "surrogatepass")
    for unit in memoryview(data).cast("H"):
        h = ((h ^ unit) * _FNV_PRIME) & 0xFFFFFFFF
    return h


def mix32(h: np.ndarray) -> np.ndarray:
    """The Murmur3 finaliser on unsigned 32-bit values held in 64 bits."""
    h = h ^ (h >> np.uint64(16))
    h = (h * np.uint64(0x85EBCA6B)) & _M
    h = h ^ (h >> np.uint64(13))
    h = (h * np.uint64(0xC2B2AE35)) & _M
    return h ^ (h >> np.uint64(16))


def signature(hashes: np.ndarray, size: int = 64) -> np.ndarray:
    """MinHash values of a set; all ones for an empty set."""
    seeds = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(_GOLDEN)) & _M
    if not len(hashes):
        return np.full(size, _M, np.uint64)
    out = np.full(size, _M, np.uint64)
    for i in range(0, len(hashes), 4096):  # bounds memory on long bodies
        out = np.minimum(out, mix32(hashes[i : i + 4096, None].astype(np.uint64) ^ seeds).min(axis=0))
    return out


def fnv1a_slices(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """fnv1a of many slices of one array of UTF-16 units, a step for each place in a slice."""
    out = np.full(len(starts), _FNV_BASIS, np.uint64)
    order = np.argsort(-lengths, kind="stable")  # the slices that are still open come first
    starts, ends = starts[order], np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
    h = out[order]
    for j, n in enumerate(ends.tolist()):
        h[:n] = ((h[:n] ^ units[starts[:n] + j]) * np.uint64(_FNV_PRIME)) & _M
    out[order] = h
    return out


def gram_sets(texts: list[str], k: int) -> tuple[np.ndarray, np.ndarray]:
    """FNV-1a hashes of the distinct k-grams of texts whose words are parted by one space, ascending in each text, and how many each text has."""
    data = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    units = np.frombuffer(b"".join(x + b" \0" for x in data), "<u2").astype(np.uint64)
    ends = np.flatnonzero(units == 32)  # of each word; an empty text has one word of no length
    starts = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = np.array([len(x) // 2 + 1 for x in data], np.int64)
    text = np.searchsorted(np.cumsum(size), starts, "right")
    words = np.bincount(text, minlength=len(texts))
    first = np.cumsum(words) - words
    place = np.arange(len(starts)) - first[text]
    here = np.flatnonzero(place + k <= words[text])
    here = here[size[text[here]] > 1]
    h = fnv1a_slices(units, starts[here], ends[here + k - 1] - starts[here])
    both = np.unique((text[here].astype(np.uint64) << np.uint64(32)) | h)
    return both & _M, np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(texts))


def signatures(hashes: np.ndarray, counts: np.ndarray, size: int = 64) -> np.ndarray:
    """A MinHash signature for each of several sets that lie in a row; none may be empty."""
    at = np.cumsum(counts) - counts
    out = np.empty((len(counts), size), np.uint64)
    if len(counts):
        for i in range(size):
            out[:, i] = np.minimum.reduceat(mix32(hashes ^ np.uint64(((i + 1) * _GOLDEN) & 0xFFFFFFFF)), at)
    return out


def signed(bodies: DataFrame, k: int = 5, chars: int = 2_000_000) -> DataFrame:
    """bodies with shingles (hashes of the k-grams of words, distinct and ascending), n_shingles and sig (MinHash); those without a shingle go.

    words is an array of strings without spaces.  One pass over Arrow batches makes sets and signatures together.
    """
    arrays = [pa.field("shingles", pa.list_(pa.int64())), pa.field("n_shingles", pa.int32()), pa.field("sig", pa.list_(pa.int64()))]

    def lists(flat: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat.astype(np.int64)))

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, counts = gram_sets(batch.column("_joined").to_pylist(), k)
        kept = np.flatnonzero(counts)
        sig = signatures(hashes, counts[kept])
        out = batch.drop_columns(["_joined"]).take(pa.array(kept))
        more = [lists(hashes, counts[kept]), pa.array(counts[kept].astype(np.int32)), lists(sig.ravel(), np.full(len(kept), sig.shape[1]))]
        return pa.RecordBatch.from_arrays([*out.columns, *more], schema=pa.schema([*out.schema, *arrays]))

    def run(batches):
        for batch in batches:
            sizes = np.cumsum([len(x.as_py()) for x in batch.column("_joined")])
            at = 0
            while at < batch.num_rows:
                end = int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chars, "right"))
                end = max(end, at + 1)
                yield part(batch.slice(at, end - at))
                at = end

    schema = T.StructType([*bodies.schema.fields, T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("n_shingles", T.IntegerType()), T.StructField("sig", T.ArrayType(T.LongType()))])
    return bodies.where(F.size("words") >= k).withColumn("_joined", F.array_join("words", " ")).mapInArrow(run, schema)


def word_grams(words: Column, k: int) -> Column:
    """The distinct k-grams of an array of strings; none where it is shorter."""

    def grams(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.array_join(F.slice(w, i + 1, k), " "))
        return F.when(n < k, F.array().cast("array<string>")).otherwise(F.array_distinct(each))

    # a lambda's variable: else the array would be computed again for each gram
    return F.transform(F.array(words), grams)[0]
