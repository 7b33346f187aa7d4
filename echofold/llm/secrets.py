"""Secret scans: candidates by pattern, false positives removed by a random forest, all in native expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import commonest, staged

#: A candidate: a run of at least 8 such characters with a letter and a digit, not inside a longer run.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{8,}+"
#: Words that announce a secret, and words that announce something harmless.
SECRET_WORDS = r"(?i)(passw(or)?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key([_-]?id)?|private[_-]?key|credentials?|auth|bearer)[\"']?\s*(=>|[:=])?\s*[\"']?$"
HARMLESS_WORDS = r"(?i)(commit|sha1|sha256|sha|md5|checksum|digest|uuid|guid|etag|revision|version|build|id|ref|hash|page|section|figure|isbn|example|sample)[\"']?\s*[:=#]?\s*[\"']?$"
#: Fragments of technical words, known beside those that the corpus teaches.
FRAGMENTS = ("password", "example", "version", "release", "section", "number", "please", "change", "sample", "public", "config", "module", "python", "string", "option", "build", "index", "class", "value", "token", "image", "table", "user", "name", "file", "data", "test", "page", "tion", "ment", "the", "and", "ing", "ion", "ent", "her", "for", "get", "set", "key", "lib", "src", "min", "max", "your")
FEATURES = ("length", "turns", "flow", "digits", "words", "hexes", "uppers", "path", "asks", "harmless", "prefix")
#: How many characters before and after a candidate the neighbouring words are looked for in.
BEFORE, AFTER = 40, 20


@dataclass(frozen=True)
class Tree:
    """A node (feature, bound, below, above), or a leaf with its share of secrets."""

    share: float
    feature: str | None = None
    bound: int = 0
    low: Tree | None = None
    high: Tree | None = None

    def sql(self, row: str) -> str:
        if self.feature is None:
            return f"{self.share:.6f}D"
        return f"CASE WHEN {row}.{self.feature} <= {self.bound} THEN {self.low.sql(row)} ELSE {self.high.sql(row)} END"


@dataclass(frozen=True)
class Language:
    """What prose looks like: fragments of words, the longest first, and 26 x 26 hundredths of log2 odds of one letter after another."""

    fragments: tuple[str, ...]
    odds: tuple[int, ...]


def language(words: dict[str, int]) -> Language:
    """From counts of lower-case words; a letter after another is compared with letters at random."""
    follow = np.full((26, 26), 0.5)
    for w, n in words.items():
        codes = np.frombuffer(w.encode(), np.uint8) - 97
        np.add.at(follow, (codes[:-1], codes[1:]), n)
    odds = np.log2(26 * follow / follow.sum(1, keepdims=True)) * 100
    own = {w for w in words if len(w) >= 4} | set(FRAGMENTS)
    return Language(tuple(sorted(own, key=lambda w: (-len(w), w))), tuple(np.clip(odds, -500, 500).astype(int).ravel().tolist()))


def corpus_words(docs: DataFrame, n: int = 400, text_col: str = "text") -> dict[str, int]:
    """The commonest words of 3 letters or more over all texts, at most n, with their counts; only these reach the driver."""
    words = docs.select(F.explode(F.split(F.lower(text_col), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return {r.w: r.c for r in sorted(commonest(staged(counts, "corpus-words"), "c", n).collect())}


def features(candidate: Column, before: Column, after: Column, known: Language) -> Column:
    """Small integers that the forest reads.

    length; turns: changes of character class, a tenth of its length; flow: tenths of log2 odds of its
    letters' transitions, on average, against letters at random; digits, hexes and uppers: tenths
    of the characters; words: tenths covered by dictionary fragments; path: it holds or follows a
    slash, or a dot and letters follow it; asks and harmless: the neighbouring words before it;
    prefix: a key's well-known start.
    """
    n = F.length(candidate)
    low = F.lower(candidate)
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(candidate, "[0-9]+", "9"), "[a-z]+", "a"), "[A-Z]+", "A")
    tenth = lambda kept: F.floor(10 * (n - F.length(kept)) / n).cast("int")
    codes = F.transform(F.split(low, ""), lambda c: F.ascii(c) - 97)
    letter = lambda c: (c >= 0) & (c < 26)
    odds = F.lit(list(known.odds))
    steps = F.zip_with(codes, F.slice(codes, 2, n), lambda a, b: F.when(letter(a) & letter(b), F.element_at(odds, a * 26 + b + 1)))
    both = F.filter(steps, lambda x: x.isNotNull())
    flow = F.when(F.size(both) > 0, F.floor(F.aggregate(both, F.lit(0).cast("bigint"), lambda s, x: s + x) / F.size(both) / 10)).otherwise(0)
    return F.struct(
        F.least(n, F.lit(80)).cast("int").alias("length"),
        F.floor(10 * (F.length(classes) - 1) / n).cast("int").alias("turns"),
        flow.cast("int").alias("flow"),
        tenth(F.regexp_replace(candidate, "[0-9]", "")).alias("digits"),
        tenth(F.regexp_replace(low, "|".join(known.fragments), "")).alias("words"),
        tenth(F.regexp_replace(low, "[0-9a-f]", "")).alias("hexes"),
        tenth(F.regexp_replace(candidate, "[A-Z]", "")).alias("uppers"),
        (candidate.rlike("^/|/[a-z]+/") | before.rlike(r"[/.\\]$") | after.rlike(r"^\.[a-z]")).cast("int").alias("path"),
        before.rlike(SECRET_WORDS).cast("int").alias("asks"),
        before.rlike(HARMLESS_WORDS).cast("int").alias("harmless"),
        candidate.rlike("^(AKIA|ASIA|ghp_|gho_|glpat-|xox[abp]-|sk_live_)").cast("int").alias("prefix"),
    )


def example_findings(spark: SparkSession, words: list[str] | None = None, n: int = 8000) -> DataFrame:
    """Labelled findings (candidate, before, after, secret, form), the same on every call: real secrets, and look-alikes made of words.

    A form is a kind of value in a kind of place; values and lengths vary by a hash of the row.
    """
    pool = F.lit(sorted(words or FRAGMENTS))
    i = F.col("id")
    hashed = lambda salt, size: (F.pmod(F.xxhash64(i, F.lit(salt)), F.lit(size)) + 1).cast("int")
    word = lambda salt: F.element_at(pool, hashed(salt, max(1, len(words or FRAGMENTS))))
    seed = i.cast("string").cast("binary")
    hex40, hex32 = F.sha1(seed), F.md5(seed)
    mixed = F.regexp_replace(F.base64(F.unhex(F.sha2(seed, 256))), "[=]", "")
    alnum = F.translate(mixed, "+/", "x9")
    upper = F.upper(F.translate(F.substring(mixed, 1, 16), "+/", "Q7"))
    short = 15 + hashed(3, 25)
    digits = hashed(4, 9999).cast("string")
    v, w, x = word(5), word(6), word(7)
    secret = [
        (F.substring(hex40, F.lit(1), short), "x password=", " and so"), (hex40, 'here token = "', '" then'), (F.upper(hex40), 'HERE TOKEN = "', '" THEN'),
        (F.concat(F.lit("AKIA"), upper), "of it ", " is the"), (F.substring(mixed, F.lit(1), short), "api_key: '", "'"), (F.substring(alnum, F.lit(1), short), "the secret=", ", or"),
        (F.concat(F.lit("ghp_"), F.substring(alnum, 1, 36)), "use ", " for it"), (hex32, '"auth": "', '",'), (F.substring(alnum, F.lit(1), short), "Authorization: Bearer ", "\n"),
        (F.concat(F.lit("sk_live_"), F.substring(alnum, 1, 24)), "stripe ", ";"), (F.substring(mixed, F.lit(1), short), "client_secret => ", ","), (F.substring(alnum, F.lit(1), short), "export PASSWD=", "\n"),
        (F.concat(F.lit("xoxb-"), F.substring(alnum, 1, 30)), "slack is ", "."), (F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 12)), "private_key = ", " "), (F.upper(hex32), "API-KEY: ", " "),
    ]
    harmless = [
        (hex40, "in commit ", " we"), (hex32, "md5: ", "  file"), (F.concat_ws("-", F.substring(hex32, 1, 8), F.substring(hex32, 9, 4), F.substring(hex32, 13, 4), F.substring(hex32, 17, 12)), "uuid=", " was"),
        (F.concat(F.lit("/usr/"), v, F.lit("/"), w, digits), "see ", ".txt"), (F.concat(v, w, digits), "the ", " of"), (F.concat(v, F.lit("_"), w, F.lit("_1")), "password=", " here"),
        (F.concat(v, F.lit("-"), w, F.lit("-"), digits), "https://example.com/", "/page"), (F.concat(digits, v, w, x), "no ", " more"), (F.substring(hex40, 1, 12), "version ", "."),
        (F.concat(v, w, F.lit("2"), x), "token: ", ","), (F.concat(F.lit("2024-0"), hashed(8, 9), F.lit("-1"), hashed(9, 9), F.lit("T10")), "on ", ":30"), (F.sha2(seed, 256), "sha256 ", " ok"),
        (F.concat(v, F.initcap(w), digits, F.initcap(x)), "call ", "("), (F.concat(v, digits), "mail ", "@example.com"), (F.concat(F.upper(v), F.lit("_"), F.upper(w), F.lit("_"), digits), "THE ", " OF"),
        (F.concat(v, F.lit("_"), w, F.lit("_"), digits), "def ", "_"), (F.concat(F.lit("your_"), v, F.lit("_key_"), digits), "api_key=", " "),
    ]
    forms = [(*f, 1) for f in secret] + [(*f, 0) for f in harmless]
    kind, pick = F.pmod(i, F.lit(len(forms))), F
    for k, (c, b, a, s) in enumerate(forms):
        pick = pick.when(kind == k, F.struct(c.alias("candidate"), F.lit(b).alias("before"), F.lit(a).alias("after"), F.lit(s).alias("secret"), F.lit(k).alias("form")))
    # exploded, so that the optimizer does not write the choice once for each field
    return spark.range(n).select(F.explode(F.array(pick)).alias("x")).select("x.*").where(f"candidate rlike '^{CANDIDATE}$'")


def train_forest(labelled: DataFrame, known: Language, trees: int = 16, depth: int = 8, max_rows: int = 20000, seed: int = 5) -> list[Tree]:
    """A random forest from labelled findings (candidate, before, after, secret 0/1).

    Equal feature rows are counted first; at most max_rows distinct ones, in order of their hash, reach the
    driver.  Each tree draws its own bootstrap and, at each node, five features, and splits by Gini.
    """
    row = features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")), known)
    counted = labelled.where("candidate is not null and secret is not null").select(row.alias("f"), "secret").select("f.*", "secret").groupBy(*FEATURES).agg(F.sum("secret").alias("yes"), F.count(F.lit(1)).alias("n"))
    rows = counted.orderBy(F.xxhash64(*FEATURES), *FEATURES).limit(max_rows).collect()
    if not rows:
        return [Tree(0.0)]
    x = np.array([[r[f] for f in FEATURES] for r in rows])
    yes, n = np.array([float(r.yes) for r in rows]), np.array([float(r.n) for r in rows])
    rng = np.random.default_rng(seed)

    def grow(at: np.ndarray, p: np.ndarray, w: np.ndarray, level: int) -> Tree:
        total, good = w[at].sum(), p[at].sum()
        share = float(good / total) if total else 0.0
        if not level or share in (0.0, 1.0):
            return Tree(share)
        best = (1e-9, None, 0)
        for f in rng.choice(len(FEATURES), 5, replace=False).tolist():
            for bound in np.unique(x[at, f])[:-1].tolist():
                low = x[at, f] <= bound
                a, b = w[at][low].sum(), p[at][low].sum()
                if a and total - a:
                    gain = 2 * share * (1 - share) * total - 2 * b * (1 - b / a) - 2 * (good - b) * (1 - (good - b) / (total - a))
                    best = max(best, (gain, f, bound), key=lambda t: t[0])
        if best[1] is None:
            return grow(at, p, w, level - 1)
        low = x[at, best[1]] <= best[2]
        return Tree(share, FEATURES[best[1]], best[2], grow(at[low], p, w, level - 1), grow(at[~low], p, w, level - 1))

    out = []
    for _ in range(trees):
        drawn_yes, drawn_no = rng.poisson(yes).astype(float), rng.poisson(n - yes).astype(float)
        out.append(grow(np.arange(len(rows)), drawn_yes, drawn_yes + drawn_no, depth))
    return out


def places(lengths: Column, block: int = 64) -> Column:
    """Where each of an array's parts starts: sums of the lengths before it, by blocks, so that long arrays don't cost their square."""
    zero = F.lit(0).cast("bigint")
    total = lambda part: F.aggregate(part, zero, lambda s, x: s + x)

    def within(n: Column) -> Column:
        count = F.size(n)
        return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.array(F.transform(F.sequence(F.lit(0), F.floor((count - 1) / block).cast("int")), lambda b: total(F.slice(n, b * block + 1, F.lit(block))))),
                lambda sums: F.transform(
                    F.array(F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))),
                    lambda before: F.transform(n, lambda _, i: before[F.floor(i / block).cast("int")] + total(F.slice(n, (i - i % block) + 1, i % block))),
                )[0],
            )[0]
        )

    # lambda variables: else an array would be computed again for each element
    return F.transform(F.array(lengths), within)[0]


def scan(rows: DataFrame, forest: list[Tree], known: Language, threshold: float = 0.5) -> DataFrame:
    """rows (row, text) with pieces (the text cut before and after each candidate) and hits: an array of (start, candidate, score, secret) in order.

    Everything is row-local array functions; no join, shuffle or Python.
    """
    text = F.coalesce("text", F.lit(""))
    out = rows.withColumns({"found": F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)), "around": F.split(text, CANDIDATE, -1)})
    out = out.withColumn("pieces", F.flatten(F.zip_with("around", F.concat("found", F.array(F.lit(""))), lambda a, c: F.array(a, c))))
    out = out.withColumn("at", F.when(F.size("found") > 0, places(F.transform("pieces", lambda p: F.length(p).cast("bigint")))))
    # a candidate and the gap behind it have 9 characters or more, so a few pieces hold the neighbouring words
    back, ahead = 2 * (BEFORE // 9 + 2), 2 * (AFTER // 9 + 2)

    def hit(c, i):
        here = 2 * i + 2  # the candidate among the pieces, from 1
        first = F.greatest(here - back, F.lit(1))
        before = F.substring(F.array_join(F.slice("pieces", first, here - first), ""), -BEFORE, BEFORE)
        after = F.substring(F.array_join(F.slice("pieces", here + 1, F.lit(ahead)), ""), 1, AFTER)
        return F.struct(F.element_at("at", here).alias("start"), c.alias("candidate"), features(c, before, after, known).alias("f"))

    out = out.withColumn("raw", F.transform("found", hit))
    score = "(" + " + ".join(t.sql("h.f") for t in forest) + f") / {len(forest)}.0D"
    scored = F.expr(f"transform(raw, h -> named_struct('start', h.start, 'candidate', h.candidate, 'score', {score}))")
    return out.select("row", "text", "pieces", F.transform(scored, lambda h: h.withField("secret", h["score"] >= threshold)).alias("hits"))


def model(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text") -> tuple[list[Tree], Language]:
    """The forest and the language that it reads: transitions and dictionary from all texts, the forest from labelled findings, or else example_findings."""
    words = corpus_words(docs, text_col=text_col)
    known = language(words)
    return train_forest(example_findings(docs.sparkSession, [w for w in words if len(w) >= 4]) if labelled is None else labelled, known), known


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate: doc_id, start, length, masked, sha256, score, is_secret.

    Candidates are runs of letters, digits and +/_- with a letter and a digit; a random forest
    trained on labelled findings (example_findings unless given) tells secrets from look-alikes by
    length, transitions of letters and classes, dictionary, path and the words around it.
    masked shows the first four characters.  A null or empty text, and an empty table, give no rows; a null or repeated
    id gives rows as any other, repeated rows as often as they occur.  Other columns are ignored.
    """
    forest, known = model(docs, labelled, text_col)
    hits = scan(docs.select(F.struct(F.col(id_col).cast("bigint").alias("doc_id")).alias("row"), F.col(text_col).alias("text")), forest, known, threshold)
    h = hits.select("row.doc_id", F.explode("hits").alias("h"))
    return h.select("doc_id", "h.start", F.length("h.candidate").cast("bigint").alias("length"), F.concat(F.substring("h.candidate", 1, 4), F.lit("...")).alias("masked"), F.sha2(F.col("h.candidate").cast("binary"), 256).alias("sha256"), F.round("h.score", 6).alias("score"), F.col("h.secret").alias("is_secret"))


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, mark: str = "[SECRET]", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """docs with each secret in the text replaced by mark; null texts stay null, other columns stay, size_col follows the text.

    Every row stays, repeated ones and those without an id too; an empty table stays empty.
    """
    forest, known = model(docs, labelled, text_col)
    hits = scan(docs.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), forest, known, threshold)
    # pieces at even places from 1 are candidates
    filled = F.transform("pieces", lambda p, i: F.when((i % 2 == 1) & F.get("hits", F.floor(i / 2).cast("int"))["secret"], F.lit(mark)).otherwise(p))
    changed = F.exists("hits", lambda h: h["secret"])
    text = F.when(F.col("text").isNotNull() & changed, F.array_join(filled, "")).otherwise(F.col("text"))
    out = hits.select("row", text.alias("new"), changed.alias("changed"))
    own = lambda c: F.col("row")[c]
    size = lambda c: F.when(F.col("changed"), F.length("new").cast(docs.schema[c].dataType)).otherwise(own(c))
    return out.select(*((F.col("new") if c == text_col else size(c) if c == size_col else own(c)).alias(c) for c in docs.columns))
