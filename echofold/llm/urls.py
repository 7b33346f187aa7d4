"""URL filters over a sorted digest array."""

from __future__ import annotations

import mmap
import re
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SCHEME = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ://."""
    m = _SCHEME.search(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


class DigestArray:
    """Rules as sorted 64-bit xxhash keys and, in the same order, verdicts and full strings, memory-mapped
    from a scratch file.

    Layout: count n; n keys; n + 1 offsets of the strings; n verdict bytes; the strings.
    ``find`` probes many keys with one vectorised binary search.  Hits are confirmed against the
    stored strings, walking over keys that collide.
    """

    def __init__(self, data: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n = int(np.frombuffer(self.map, "<u8", 1)[0])
        self.keys = np.frombuffer(self.map, "<u8", n, 8)
        self.offsets = np.frombuffer(self.map, "<u8", n + 1, 8 + 8 * n)
        self.verdicts = np.frombuffer(self.map, "u1", n, 16 + 16 * n)
        self.base = 16 + 17 * n
        lengths = np.diff(self.offsets)
        self.lengths = np.unique(lengths)

    @staticmethod
    def pack(rules: list[tuple[str, int]], hash64=xxhash.xxh64_intdigest) -> bytes:
        """The bytes of a file for (string, verdict) rules; of equal strings the last one holds."""
        rows = sorted((hash64(s.encode()), s.encode(), v) for s, v in dict(rules).items())
        offsets = np.cumsum([0, *(len(s) for _, s, _ in rows)])
        return b"".join([np.array([len(rows)], "<u8").tobytes(), np.array([k for k, _, _ in rows], "<u8").tobytes(), offsets.astype("<u8").tobytes(), np.array([v for _, _, v in rows], "u1").tobytes(), b"".join(s for _, s, _ in rows)])

    def text(self, i: int) -> bytes:
        return self.map[self.base + int(self.offsets[i]) : self.base + int(self.offsets[i + 1])]

    def find(self, strings: list[bytes], hash64=xxhash.xxh64_intdigest) -> np.ndarray:
        """The place of each string, or -1."""
        if not strings or not len(self.keys):
            return np.full(len(strings), -1)
        probe = np.fromiter(map(hash64, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, probe)
        out = np.full(len(strings), -1)
        for j in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == probe).tolist():
            i = int(at[j])
            while i < len(self.keys) and self.keys[i] == probe[j]:
                if self.text(i) == strings[j]:
                    out[j] = i
                    break
                i += 1
        return out


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Judge each url by the longest (verdict, host, path) rule that fits: page_id, host, path, rule, verdict.

    A rule fits its host and all its subdomains where the path starts with the rule's.  Rules lie in
    a sorted digest array keyed by host + path, broadcast, and memory-mapped from a
    scratch file by each task.  A url probes each suffix of its host with each prefix of its path whose
    length some rule has.  Without a rule the verdict is ``default``.

    Null urls and urls without :// have an empty host and path; a host with empty labels keeps them.
    Every row gives one row, null or repeated ids included; other columns are ignored.  No shuffle.
    The rules are a parameter held by the driver, so their size is the caller's bound.
    """
    kinds = sorted({v for v, _, _ in rules} | {default})
    data = DigestArray.pack([(h + p, kinds.index(v)) for v, h, p in rules])
    lengths = sorted({len(p) for _, _, p in rules})
    sent = pages.sparkSession.sparkContext.broadcast(data)  # as large as the rules, which the driver holds anyway

    def run(batches):
        index = DigestArray(sent.value)
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            probes, owner = [], []
            for i, (host, path) in enumerate(parts):
                if not host:
                    continue
                labels = [0, *(m.end() for m in re.finditer(r"\.", host))]
                for start in labels:
                    for n in lengths:
                        if n <= len(path):
                            probes.append((host[start:] + path[:n]).encode())
                            owner.append((i, start, n))
            best: dict[int, tuple] = {}
            for (i, start, n), at in zip(owner, index.find(probes).tolist(), strict=True):
                if at >= 0:
                    host, path = parts[i]
                    rank = (len(host) - start + n, n)
                    if i not in best or rank > best[i][0]:
                        best[i] = (rank, at)
            rule = [index.text(best[i][1]).decode() if i in best else None for i in range(len(parts))]
            verdict = [kinds[index.verdicts[best[i][1]]] if i in best else default for i in range(len(parts))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), *(pa.array(c, pa.string()) for c in ([h for h, _ in parts], [p for _, p in parts], rule, verdict))], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url")).mapInArrow(run, "page_id bigint, host string, path string, rule string, verdict string")
