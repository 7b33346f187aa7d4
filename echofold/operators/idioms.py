"""Repeated token sequences: recurring windows, maximal runs, specificity and absorption."""

from __future__ import annotations

import contextlib
import ctypes
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(docs: DataFrame, size: int) -> DataFrame:
    """First place of each distinct window in each document: key (the MD5 of its tokens, a space between), d, i.  docs has d and norm (array).

    Windows count as equal when their 128-bit hashes are, so that no window's text is shuffled.
    """
    n = F.size("norm")
    every = F.when(n >= size, F.transform(F.sequence(F.lit(0), n - size), lambda i: F.md5(F.array_join(F.slice("norm", i + 1, size), " "))))
    return docs.select("d", F.posexplode(every).alias("i", "key")).groupBy("key", "d").agg(F.min("i").alias("i"))


def recurring_windows(docs: DataFrame, size: int = 16, min_files: int = 3) -> DataFrame:
    """Windows in at least min_files documents: key, files."""
    return windows(docs, size).groupBy("key").agg(F.count(F.lit(1)).alias("files")).where(F.col("files") >= min_files)


def document_frequency(docs: DataFrame, names: str = "names") -> DataFrame:
    """name, df: how many documents hold it."""
    return docs.select(F.explode(F.array_distinct(F.filter(names, lambda x: x.isNotNull()))).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("df"))


def idf(total: Column, df: Column) -> Column:
    return F.log2(F.greatest(total, F.lit(1)) / F.coalesce(df, F.lit(1)))


@dataclass(frozen=True)
class Idioms:
    """runs: every ranked run with verdict reported, low_info or absorbed; stats: one row of counters."""

    runs: DataFrame
    stats: DataFrame


#: How many bits tell the hashes of frequent grams; a bit set by another gram only adds candidates.
_BITS = 1 << 27
#: How many tokens a step of a Python worker takes.
_TOKENS = 200_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    """Where the session has the defaults of 64 MB and 10,000 rows a batch, batches for Python are of 4 MB and 512 rows meanwhile: JVM and worker hold each several times in each task, with all columns of its rows."""
    changed = []
    for key, default, small in ((_BATCH, "67108864b", "4194304b"), ("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "512")):
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, small)
            changed.append(key)
    try:
        yield
    finally:
        for key in changed:
            spark.conf.unset(key)


def _give_back() -> None:
    """Return freed memory to the system, which else stays with an idle worker."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _least_grams(flat: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For documents of token hashes in a row: where each window of size tokens starts, and the least hash of the grams of half that size in it."""
    k = size // 2
    h = flat.astype(np.uint64)
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = np.zeros(len(h) - k + 1, np.uint64)
    for j in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(gram)]
    gram ^= gram >> np.uint64(29)
    gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    least = gram[:n].copy()
    for j in range(1, size - k + 1):
        np.minimum(least, gram[j : j + n], out=least)
    at = np.arange(n)
    whole = at + size <= ends[np.searchsorted(ends, at, "right")]
    return at[whole], least[whole].view(np.int64)


def _runs(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run, where breaks tells for each place but the first whether a run begins there."""
    first = np.append(0, np.flatnonzero(breaks) + 1)
    return first, np.append(first[1:] - 1, len(breaks))


def _steps(lengths: np.ndarray):
    """Ranges of documents of some _TOKENS tokens each."""
    ends = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _TOKENS, "right")))
        yield at, end
        at = end


def _spans(docs: DataFrame, size: int, min_files: int) -> DataFrame:
    """The stretches of each document whose windows may recur: d, file, s (their start), norm, names, lines (their slices).

    Equal windows have the same least gram, so windows whose least gram is seen in fewer documents can't recur.  Grams
    are counted by runs of windows, and those that stay are bits in an array of fixed size, which all tasks get.
    """
    hashed = F.transform("norm", lambda x: F.xxhash64(x))

    def grams(batches):
        for batch in batches:
            d, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            lengths = np.array(lists.value_lengths().fill_null(0))
            for a, b in _steps(lengths):
                ends = np.cumsum(lengths[a:b])
                at, least = _least_grams(lists.slice(a, b - a).flatten().to_numpy(zero_copy_only=False), ends, size)
                if not len(at):
                    continue
                doc = np.searchsorted(ends, at, "right")
                first, _ = _runs((np.diff(doc) != 0) | (np.diff(least) != 0))
                yield pa.RecordBatch.from_arrays([pa.array(least[first]), pa.array(d[a:b][doc[first]], pa.int32())], names=["m", "d"])
        _give_back()

    seen = docs.select("d", hashed.alias("h")).mapInArrow(grams, "m bigint, d int")
    often = seen.groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi")).where((F.col("n") >= min_files) & (F.col("lo") < F.col("hi")))
    bit = often.select((F.pmod("m", F.lit(_BITS)) + 1).alias("x"))
    parts = bit.groupBy(F.bitmap_bucket_number("x").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    table = np.zeros(_BITS // 8, np.uint8)
    for r in parts.toLocalIterator():
        part = np.frombuffer(r.bits, np.uint8)
        table[(r.part - 1) * 4096 :][: len(part)] = part
    known = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("array<bigint>")
    def stretches(h: pd.Series) -> pd.Series:
        lengths = h.map(lambda x: 0 if x is None else len(x)).to_numpy(np.int64)
        out = []
        for a, b in _steps(lengths):
            ends = np.cumsum(lengths[a:b])
            own = [x for x in h.iloc[a:b] if x is not None]
            at, least = _least_grams(np.concatenate(own) if own else np.zeros(0, np.int64), ends, size)
            bits = least % _BITS
            at = at[(known.value[bits >> 3] >> (bits & 7).astype(np.uint8)) & 1 == 1]
            found = [np.zeros(0, np.int64)] * (b - a)
            if len(at):
                doc = np.searchsorted(ends, at, "right")
                first, last = _runs((np.diff(doc) != 0) | (np.diff(at) != 1))
                start = at[first] - (ends - lengths[a:b])[doc[first]]
                code = (start << 32) | (at[last] - at[first] + 1)
                cuts = np.flatnonzero(np.diff(doc[first])) + 1
                for some, x in zip(np.split(doc[first], cuts), np.split(code, cuts), strict=True):
                    found[some[0]] = x
            out += found
        return pd.Series(out)

    spans = docs.withColumn("code", F.explode(stretches(hashed))).withColumn("s", F.shiftright("code", 32).cast("int"))
    n = F.col("code").bitwiseAND(0xFFFFFFFF).cast("int") + size - 1
    part = lambda c: F.slice(c, F.col("s") + 1, n).alias(c)
    return spans.select("d", "file", "s", part("norm"), part("names"), part("lines"))


def _agreeing(batches):
    """For places of a stretch and the stretch of their first places: how many windows agree on either side.

    own_i and own have place and label of each recurring window of the one, ref_i and ref those of the other; at and
    first are the places, ascending alike.
    """
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            i, i0 = np.asarray(r.at, np.int64), np.asarray(r.first, np.int64)
            low = int(r.own_i.min())
            own = np.full(int(r.own_i.max()) - low + 1, -1, np.int64)
            own[r.own_i - low] = r.own
            left, right = np.zeros(len(i), np.int32), np.zeros(len(i), np.int32)
            for shift in np.unique(i - i0):
                ref = np.full(len(own), -2, np.int64)
                at = r.ref_i + shift - low
                inside = (at >= 0) & (at < len(own))
                ref[at[inside]] = r.ref[inside]
                stops = np.concatenate([[-1], np.flatnonzero(own != ref), [len(own)]])
                here = np.flatnonzero(i - i0 == shift)
                x = i[here] - low
                k = np.searchsorted(stops, x)
                left[here], right[here] = x - stops[k - 1] - 1, stops[k] - x - 1
            yield pd.DataFrame({"d0": r.d0, "i0": i0, "s0": r.s0, "files": r.files, "d": r.d, "i": i, "left": left, "right": right})
    _give_back()


def find_idioms(docs: DataFrame, size: int = 16, min_files: int = 3, min_info: float = 6.0) -> Idioms:
    """Runs of tokens that recur across documents, the most specific first.

    docs has d (in order of file), file, norm (tokens), names (kept name per token or null) and
    lines.  A window that recurs in min_files documents grows while all its places agree; its
    specificity is the summed IDF of the distinct names in it.  In order of files times specificity, a
    run is absorbed if half of its places overlap earlier runs.

    Only stretches of documents whose windows may recur are kept (see _spans), so all tokens are read but
    none is shuffled; docs is read several times and must come out the same each time.  A recurring window is
    labelled by its first place.  All places of a window go on alike as long as the next windows' labels are equal,
    as what they share recurs too; that is found once for each pair of stretches.  No join broadcasts: a table of
    stretches is small in its files and many times as large in memory, which Spark's choice doesn't know.
    Absorption depends on the order of all runs before, so it is one ordered pass over runs, which
    HAVING has already cut down, not over tokens.
    """
    with _small_batches(docs.sparkSession):  # all that runs Python runs in here
        return _find_idioms(docs, max(4, size), max(2, min_files), min_info)


def _find_idioms(docs: DataFrame, size: int, min_files: int, min_info: float) -> Idioms:
    from .graph import _cut, _stored

    docs = docs.select("d", "file", "norm", "names", "lines")
    spans = _stored(_spans(docs, size, min_files))
    every = F.transform(F.sequence(F.lit(0), F.size("norm") - size), lambda i: F.unhex(F.md5(F.array_join(F.slice("norm", i + 1, size), " "))))
    places = spans.select("d", "s", F.posexplode(every).alias("i", "key")).withColumn("i", F.col("i") + F.col("s"))
    firsts = places.groupBy("key", "d").agg(F.min(F.struct("i", "s")).alias("f"))
    keys = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("files"), F.min(F.struct("d", "f.i", "f.s")).alias("first")).where(F.col("files") >= min_files)
    keys = keys.select("key", "files", F.col("first.d").alias("d0"), F.col("first.i").alias("i0"), F.col("first.s").alias("s0"))
    label = F.shiftleft(F.col("d0").cast("bigint"), 32).bitwiseOR(F.col("i0").cast("bigint")).alias("label")
    labelled = _stored(places.join(keys.hint("merge"), "key").select("d", "s", "i", "files", "d0", "i0", "s0", label))
    # flat arrays, so that a worker holds numbers and no records
    cut = lambda c, f: F.transform(c, lambda x: x[f])
    marks = labelled.groupBy("d", "s").agg(F.collect_list(F.struct("i", "label")).alias("own"))
    marks = marks.select("d", "s", cut("own", "i").alias("own_i"), cut("own", "label").alias("own"))
    # a document's first place of each window stands for it
    occ = labelled.groupBy("label", "d").agg(F.min(F.struct("i", "s", "files", "d0", "i0", "s0")).alias("f")).select("d", "f.*")
    paired = occ.groupBy("d", "s", "d0", "s0").agg(F.collect_list(F.struct("i", "i0", "files")).alias("at"))
    paired = paired.select("d", "s", "d0", "s0", cut("at", "i").alias("at"), cut("at", "i0").alias("first"), cut("at", "files").alias("files"))
    ref = marks.select(F.col("d").alias("d0"), F.col("s").alias("s0"), F.col("own_i").alias("ref_i"), F.col("own").alias("ref"))
    paired = paired.join(marks.hint("merge"), ["d", "s"]).join(ref.hint("merge"), ["d0", "s0"])
    grown = paired.mapInPandas(_agreeing, "d0 int, i0 int, s0 int, files bigint, d int, i int, left int, right int").withColumn("key", F.concat_ws(":", "d0", "i0"))
    groups = grown.groupBy("key").agg(F.first("files").alias("files"), F.first("s0").alias("s0"), F.min("left").alias("left"), F.min("right").alias("right"), F.array_sort(F.collect_list(F.shiftleft(F.col("d").cast("bigint"), 32) + F.col("i"))).alias("places"))
    runs = groups.select("key", "files", "s0", F.transform("places", lambda p: p - F.col("left")).alias("places"), (size + F.col("left") + F.col("right")).alias("len"))
    first = spans.select("d", F.col("s").alias("s0"), "file", "names", "lines")
    # a place is one number, d and i in 32 bits each
    document, token = (lambda p: F.shiftright(p, 32).cast("int")), (lambda p: p.bitwiseAND(0xFFFFFFFF).cast("int"))
    runs = runs.withColumn("d", document(F.col("places")[0])).join(first.hint("merge"), ["d", "s0"])
    at = token(F.col("places")[0]) - F.col("s0")
    kept = F.array_distinct(F.filter(F.slice("names", at + 1, F.col("len")), lambda x: x.isNotNull()))
    runs = runs.select("key", "files", "places", "len", "file", kept.alias("kept"), F.col("lines")[at].alias("line"), F.col("lines")[at + F.col("len") - 1].alias("end_line"))
    runs = _stored(runs)
    total = docs.count()
    weight = document_frequency(docs).select("name", idf(F.lit(total), F.col("df")).alias("w"))
    # summed in order of first appearance, then rounded to one place, as ranking needs
    summed = runs.select("key", F.posexplode("kept").alias("at", "name")).join(weight.hint("merge"), "name").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "w"))).alias("ws"))
    summed = summed.select("key", (F.floor(F.aggregate("ws", F.lit(0.0), lambda s, x: s + x["w"]) * 10 + 0.5) / 10).alias("info"))
    ranked = runs.join(summed.hint("merge"), "key", "left").withColumn("info", F.coalesce("info", F.lit(0.0)))
    ranked = ranked.orderBy(F.desc(F.col("files") * F.col("info")), F.desc("len"), "file", token(F.col("places")[0]), "key")

    schema = "rank bigint, files bigint, tokens int, info double, names array<string>, file string, line int, end_line int, places array<bigint>, verdict string"

    def absorb(batches):
        covered: dict[int, list[tuple[int, int]]] = {}
        rank = 0
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                rank += 1
                places = [(p >> 32, p & 0xFFFFFFFF) for p in r.places.tolist()]
                n = int(r.len)
                over = sum(any(i < j + m and j < i + n for j, m in covered.get(d, ())) for d, i in places)
                if 2 * over >= len(places):
                    verdict = "absorbed"
                else:
                    for d, i in places:
                        covered.setdefault(d, []).append((i, n))
                    verdict = "reported" if r.info >= min_info else "low_info"
                out.append((rank, r.files, n, r.info, sorted(r.kept), r.file, r.line, r.end_line, r.places, verdict))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        _give_back()

    done = _cut(ranked.select("key", "files", "places", "len", "file", "kept", "line", "end_line", "info").coalesce(1).sortWithinPartitions(F.desc(F.col("files") * F.col("info")), F.desc("len"), "file", token(F.col("places")[0]), "key").mapInPandas(absorb, schema).withColumn("places", F.transform("places", lambda p: F.struct(document(p).alias("d"), token(p).alias("i")))))
    n = F.size("norm")
    seen = docs.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.coalesce(F.sum(F.greatest(n - size + 1, F.lit(0))), F.lit(0)).alias("windows"))
    of = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    stats = seen.crossJoin(done.agg(F.count(F.lit(1)).alias("recurring"), of("low_info"), of("absorbed"), of("reported")))  # one row each
    return Idioms(done, stats)


def excerpts(runs: DataFrame, docs: DataFrame, lines: int = 8) -> DataFrame:
    """runs with an excerpt of at most so many lines from their first place; docs has file and source."""
    text = F.split("source", "\n")
    last = F.least(F.col("end_line"), F.col("line") + lines - 1)
    shown = F.transform(F.slice(text, F.col("line"), last - F.col("line") + 1), lambda x: F.regexp_replace(x, "(?U)\\s+$", ""))
    more = F.when(F.col("end_line") > F.col("line") + lines - 1, F.array(F.lit("…"))).otherwise(F.array().cast("array<string>"))
    return runs.join(docs.select("file", "source"), "file").withColumn("excerpt", F.concat(shown, more)).drop("source")
