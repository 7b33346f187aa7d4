"""Language-model scoring by Brown class-based n-grams with exchange clustering."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import commonest, slices, small_batches, staged

#: The end of a text as a word; no word is empty.
END = b""
_BUCKETS = 25


def word_hash(word: bytes) -> int:
    h = xxhash.xxh3_64_intdigest(word)
    return h - (1 << 64) if h >> 63 else h


def bucket(word: bytes) -> int:
    """The unit of a word without a unit of its own, from its length and last byte."""
    n, last = len(word), word[-1:]
    band = 0 if n <= 3 else 1 if n <= 6 else 2 if n <= 9 else 3 if n <= 13 else 4
    kind = 4 if last >= b"\x80" else 0 if last in b"aeiouy" else 1 if last.isalpha() else 2 if last in b".,;:!?" else 3
    return band * 5 + kind


def words_of(text: str | None) -> list[bytes]:
    """Tokens: words of the text, A-Z lower-cased, then the end."""
    out = (text or "").encode().lower().split()
    out.append(END)
    return out


def is_held_out(doc_id: int | None, folds: int, fold: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == fold


def exchange(pairs: np.ndarray, classes: int) -> np.ndarray:
    """A class for each unit: each unit in turn goes where the class bigrams' log likelihood is largest, until none moves.

    pairs[u, v]: how often unit v follows unit u.  Units start in order of frequency, dealt in turn.
    """
    n = len(pairs)
    order = np.argsort(-(pairs.sum(0) + pairs.sum(1)), kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    log = lambda x: x * np.log(np.maximum(x, 1))
    one = np.eye(classes)[of]
    table = one.T @ pairs @ one  # class bigrams, kept up to date
    k = np.arange(classes)
    moved = 1
    while moved:  # each move raises the likelihood, so this ends
        moved = 0
        for u in order.tolist():
            one[u] = 0
            row, col, self_, old = pairs[u] @ one, pairs[:, u] @ one, pairs[u, u], of[u]
            table[old, :] -= row
            table[:, old] -= col
            table[old, old] -= self_
            each = np.repeat(table[None], classes, 0)
            each[k, k, :] += row
            each[k, :, k] += col
            each[k, k, k] += self_
            gain = log(each).sum((1, 2)) - log(each.sum(2)).sum(1) - log(each.sum(1)).sum(1)
            best = int(np.argmax(gain))
            if gain[best] > gain[old] + 1e-9:
                of[u] = best
                moved += 1
            one[u, of[u]] = 1
            table = each[of[u]]
    return of


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all tokens of a batch of coded texts, where each text starts, and each text's number of tokens (1 or more)."""
    parts = [np.frombuffer(x, np.int32) for x in batch.column("codes").to_pylist()]
    n = np.array([len(x) for x in parts], np.int64)
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.cumsum(n) - n, n


def _after(of: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """What each token of a batch follows; the first of a text follows an end."""
    out = np.empty_like(of)
    out[1:] = of[:-1]
    out[starts] = end
    return out


def _context_rows(pairs: list[np.ndarray]):
    """key, packed (context + 64 * hits) of each word of a task, from (hash without its last 6 bits | context)."""
    both = np.concatenate(pairs)
    both.sort()
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    hits = np.diff(np.append(first, len(both)))
    key, packed = both[first] >> np.uint64(6), ((both[first] & np.uint64(63)).astype(np.int64) + 64 * hits).astype(np.int32)
    row = np.append(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])), len(key))
    for i in range(0, len(row) - 1, 100_000):
        edge = row[i : i + 100_001]
        lists = pa.ListArray.from_arrays(pa.array(edge - edge[0], pa.int32()), pa.array(packed[edge[0] : edge[-1]]))
        yield pa.RecordBatch.from_arrays([pa.array(key[edge[:-1]].astype(np.int64)), lists], names=["key", "packed"])


def score_texts(docs: DataFrame, classes: int = 24, units: int = 1000, frequent: int = 262144, folds: int = 5, fold: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and model log10 probability of each whole text.

    Texts whose crc32(doc_id) mod folds is fold are held out; the model learns from all others.

    1. Words are counted over all training texts (partial sums in each task, then one aggregation), and
       each text is written once as numbers: the place of a word among the ``frequent`` commonest, or its hash.
    2. The ``units`` commonest words and 25 buckets of the others (by length and ending) are exchanged
       between classes until none moves, from a table of unit bigrams of bounded size.
    3. Every other word of the vocabulary, however rare, is then exchanged once: it goes to the class that
       is likeliest between the classes before and after all its places.  Its contexts are gathered by hash,
       so this grows with the vocabulary and no machine holds it whole.
    4. Class bigrams are counted again, over the classes so found.  P(w|v) = P(c(w)|c(v)) * P(w|c(w)),
       with 0.5 added to each class transition, each word of a class and one unknown word of each class,
       which has the class of its bucket.  What is beyond the ``frequent`` commonest is joined by hash.

    A null text is empty: it has its end alone.  A null doc_id counts as the empty string, so it is
    trained on.  Repeated rows count and score as often as they occur.  With no training text all
    counts are zero and scores are those of unknown words.  Classes must be 32 at most.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    if not 1 <= classes <= 32:
        raise ValueError("classes must be 1 to 32")
    spark = docs.sparkSession
    base = small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))

    def count(batches):
        seen: Counter = Counter()

        def out():
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(map(word_hash, keys), pa.int64()), pa.array(seen.values(), pa.int64()), pa.array([-1 if w == END else bucket(w) for w in keys], pa.int32())], names=["h", "c", "bucket"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                if not is_held_out(doc, folds, fold):
                    seen.update(words_of(text.as_py()))
            if len(seen) > 600_000:
                yield out()
                seen.clear()
        if seen:
            yield out()

    counts = base.mapInArrow(count, "h bigint, c bigint, bucket int").groupBy("h").agg(F.sum("c").alias("c"), F.min("bucket").alias("bucket"))
    counts = staged(counts, "word-counts")
    total, distinct, ends = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum(F.when(F.col("bucket") < 0, F.col("c"))), F.lit(0))).first()
    top = commonest(counts, "c", frequent).toPandas()
    lowest = int(top["c"].min()) if len(top) else 1 << 62  # the frequent words are those of at least this count
    end_hash = word_hash(END)
    top = top[top["h"] != end_hash].sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    own = [end_hash, *top["h"].tolist()[:units]]
    hs, cs, home = (np.append(top[x].to_numpy(np.int64), last) for x, last in (("h", end_hash), ("c", ends), ("bucket", -1)))
    order = np.argsort(hs)
    hs, cs, home = hs[order], cs[order], home[order]
    own_at = np.searchsorted(hs, own)
    n_units = _BUCKETS + len(own)
    unit = home.copy()
    unit[own_at] = _BUCKETS + np.arange(len(own))
    sent = spark.sparkContext.broadcast(hs)  # at most ``frequent`` words, 8 bytes each

    coded_schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.binary()), ("rare", pa.list_(pa.int64()))])

    def code(batches):
        """Each token as its place among the frequent words, or as -1 - its bucket with its hash in ``rare``."""
        hs, rare = sent.value, []

        class Places(dict):
            def __missing__(self, word):
                h = word_hash(word)
                i = int(np.searchsorted(hs, h))
                if i == len(hs) or hs[i] != h:
                    rare.append((h, -1 - bucket(word)))
                    i = -len(rare)
                self[word] = i
                return i

        place, uid = Places(), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, "text"):
                ids = part.column("doc_id").to_pylist()
                codes, hashes = [], []
                for text in part.column("text"):
                    tokens = words_of(text.as_py())
                    if len(place) > 600_000:
                        place.clear()
                        rare.clear()
                    at = np.fromiter(map(place.__getitem__, tokens), np.int32, len(tokens))
                    unseen = np.flatnonzero(at < 0)
                    found = [rare[-1 - i] for i in at[unseen].tolist()]
                    at[unseen] = [b for _, b in found]
                    codes.append(at.tobytes())
                    hashes.append([h for h, _ in found])
                n = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(uid, uid + n)), pa.array(ids, pa.int64()), pa.array([is_held_out(i, folds, fold) for i in ids], pa.bool_()), pa.array(codes, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))], schema=coded_schema)
                uid += n

    coded = staged(base.mapInArrow(code, "uid bigint, doc_id bigint, held_out boolean, codes binary, rare array<bigint>"), "coded")
    training = coded.where("not held_out")

    def bigrams(of: np.ndarray, end: int, size: int, skip_rare: bool) -> np.ndarray:
        """How often one follows another in training texts; of[code] numbers a token, negative codes from the back."""
        table_of = spark.sparkContext.broadcast(of)

        def run(batches):
            of, table = table_of.value, np.zeros(size * size, np.int64)
            for batch in batches:
                at, starts, _ = _flat(batch)
                u = of[at]
                both = _after(u, starts, end) * size + u
                if skip_rare:
                    both = both[(at >= 0) & (_after(at, starts, 0) >= 0)]
                table += np.bincount(both, minlength=size * size)
            some = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["code", "hits"])

        out = np.zeros(size * size)
        # at most size squared rows, whatever the input
        got = training.select("codes").mapInArrow(run, "code bigint, hits bigint").groupBy("code").agg(F.sum("hits").alias("hits")).toPandas()
        out[got["code"].to_numpy()] = got["hits"].to_numpy()
        return out.reshape(size, size)

    from_back = np.arange(_BUCKETS)[::-1]
    pairs = bigrams(np.concatenate([unit, from_back]), _BUCKETS, n_units, False)
    of = exchange(pairs, classes)
    end_class = int(of[_BUCKETS])
    one = np.eye(classes)[of]
    follow = one.T @ pairs @ one + 0.5
    size = (follow.sum(0) + follow.sum(1)) / 2
    # rows: class before, then class after; whole numbers, so that sums don't depend on their order
    gain = np.rint(np.concatenate([np.log(follow), np.log(follow).T]) * 2**20 - np.log(size) * 2**20).astype(np.int64)
    first = spark.sparkContext.broadcast((np.concatenate([of[unit], of[from_back]]), np.isin(np.arange(len(hs) + _BUCKETS), own_at)))

    def contexts(batches):
        hs, (of, fixed) = sent.value, first.value
        held, n = [], 0
        for batch in batches:
            at, starts, _ = _flat(batch)
            h = hs[np.maximum(at, 0)]
            h[at < 0] = batch.column("rare").flatten().to_numpy()
            c = of[at].astype(np.uint64)
            moves = np.flatnonzero(~fixed[at])  # never the end, so a token follows
            key = h[moves].view(np.uint64) & ~np.uint64(63)
            held += [key | _after(c, starts, end_class)[moves], key | (c[moves + 1] + np.uint64(classes))]
            n += 2 * len(moves)
            if n > 8_000_000:
                yield from _context_rows(held)
                held, n = [], 0
        if n:
            yield from _context_rows(held)

    def choose(batches):
        """The likeliest class of each key; rows come in order of keys, of which one may go on in the next batch."""

        def out(keys, sums):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.argmax(sums, 1).astype(np.int32))], names=["key", "class"])

        key, total = np.zeros(0, np.int64), np.zeros((0, classes), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("packed")
            packed, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            each = np.add.reduceat(gain[packed & 63] * (packed >> 6).astype(np.int64)[:, None], np.cumsum(n) - n)
            keys, each = np.concatenate([key, batch.column("key").to_numpy()]), np.concatenate([total, each])
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            keys, each = keys[new], np.add.reduceat(each, new)
            if len(keys) > 1:
                yield out(keys[:-1], each[:-1])
            key, total = keys[-1:], each[-1:]
        if len(key):
            yield out(key, total)

    gathered = training.select("codes", "rare").mapInArrow(contexts, "key bigint, packed array<int>").repartition("key").sortWithinPartitions("key")
    placed = gathered.mapInArrow(choose, "key bigint, class int")
    # the hash without its last 6 bits, as an unsigned number
    key = F.expr("shiftrightunsigned(h, 6)")
    words = staged(counts.where(~F.col("h").isin(own)).withColumn("key", key).join(placed, "key").select("h", "c", "class"), "word-classes")

    final = of[unit]
    known = words.where(F.col("c") >= lowest).select("h", "class").toPandas()  # at most ``frequent`` rows
    final[np.searchsorted(hs, known["h"].to_numpy(np.int64))] = known["class"].to_numpy(np.int64)
    lookup = np.concatenate([final, of[from_back]])
    tokens_in, words_in = np.zeros(classes), np.zeros(classes)
    for r in words.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        tokens_in[r["class"]], words_in[r["class"]] = r.n, r.v
    np.add.at(tokens_in, final[own_at], cs[own_at])
    np.add.at(words_in, final[own_at], cs[own_at] > 0)
    log_class = np.log10(tokens_in + 0.5 * (words_in + 1))
    log_all = float(np.log10(total + 0.5 * (distinct + 1)))
    final_of = spark.sparkContext.broadcast(lookup)

    def rare_places(batches):
        """Each rare token with the classes beside it, null where those are rare too: the next row then tells."""
        of = final_of.value
        for batch in batches:
            at, starts, n = _flat(batch)
            where = np.flatnonzero(at < 0)
            before, behind = _after(at, starts, int(np.searchsorted(sent.value, end_hash)))[where], at[where + 1]
            side = lambda x: pa.array(of[x].astype(np.int8), mask=x < 0)
            text = np.repeat(np.arange(len(n)), n)[where]
            columns = [pa.array(batch.column("uid").to_numpy()[text]), pa.array((where - starts[text]).astype(np.int32)), batch.column("rare").flatten(), pa.array(batch.column("held_out").to_numpy(zero_copy_only=False)[text]), side(before), pa.array(of[at[where]].astype(np.int8)), side(behind)]
            every = pa.RecordBatch.from_arrays(columns, names=["uid", "at", "h", "held_out", "before", "other", "behind"])
            for i in range(0, every.num_rows, 100_000):
                yield every.slice(i, 100_000)

    rare = coded.where(F.size("rare") > 0).drop("doc_id").mapInArrow(rare_places, "uid bigint, at int, h bigint, held_out boolean, before tinyint, other tinyint, behind tinyint")
    rare = rare.join(words, "h", "left").select("uid", "at", "held_out", "before", F.coalesce("class", "other").cast("tinyint").alias("own"), "behind", F.coalesce("c", F.lit(0)).alias("c"))
    previous = F.lag("own").over(Window.partitionBy("uid").orderBy("at"))
    rare = staged(rare.select("uid", "held_out", F.coalesce("before", previous).alias("before"), "own", "behind", "c"), "rare-words")

    follow = bigrams(lookup, end_class, classes, True)
    steps = F.array(F.struct(F.col("before").alias("x"), F.col("own").alias("y")), F.struct(F.col("own").alias("x"), F.col("behind").alias("y")))
    for r in rare.where("not held_out").select(F.explode(steps).alias("s")).where("s.y is not null").groupBy("s.x", "s.y").agg(F.count(F.lit(1)).alias("n")).collect():
        follow[r.x, r.y] += r.n
    log_next = np.log10((follow + 0.5) / (follow.sum(1, keepdims=True) + 0.5 * classes))
    model = spark.sparkContext.broadcast((cs, log_next, log_class))

    def score(batches):
        of, (cs, log_next, log_class) = final_of.value, model.value
        log_c = np.append(np.log10(cs + 0.5), np.zeros(_BUCKETS))
        has = np.append(cs > 0, np.zeros(_BUCKETS, bool))
        for batch in batches:
            if not batch.num_rows:
                continue
            at, starts, n = _flat(batch)
            c = of[at]
            logs = log_c[at]
            step = np.where((at >= 0) & (_after(at, starts, 0) >= 0), log_next[_after(c, starts, end_class), c], 0.0) - np.where(at >= 0, log_class[c], 0.0)
            total = np.add.reduceat(logs, starts)
            columns = [batch.column("uid"), batch.column("doc_id"), batch.column("held_out"), pa.array(n), pa.array(np.add.reduceat(has[at].astype(np.int64), starts)), pa.array(total - n * log_all), pa.array(total + np.add.reduceat(step, starts))]
            yield pa.RecordBatch.from_arrays(columns, names=["uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    scored = coded.drop("rare").mapInArrow(score, "uid bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, model double")
    numbers = lambda x: F.array(*map(F.lit, x.ravel().tolist()))
    step = lambda x, y: F.get(numbers(log_next), F.col(x) * F.lit(classes) + F.col(y))
    extra = step("before", "own") + F.coalesce(step("own", "behind"), F.lit(0.0)) - F.get(numbers(log_class), F.col("own").cast("int"))
    sums = rare.groupBy("uid").agg(F.sum(F.log10(F.col("c") + 0.5)).alias("logs"), F.sum(extra).alias("extra"), F.count_if(F.col("c") > 0).alias("known"))
    logs, extra, more = (F.coalesce(x, F.lit(0)) for x in ("logs", "extra", "known"))
    return scored.join(sums, "uid", "left").select("doc_id", "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(int(total)).cast("bigint").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs + extra).alias("score"))
