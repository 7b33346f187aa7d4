"""Near-duplicate bodies: shingles, MinHash, LSH bands, exact Jaccard, clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashes as H
from ..functions import names as N
from .graph import connected_components

BANDS, ROWS = 16, 4


def text_words(text: Column) -> Column:
    """Lower-case white-space words: the body of a text."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "\\s+"), lambda w: w != "")


def body_shape(tokens: Column) -> Column:
    """Code tokens with identifiers and numbers replaced by their kind."""
    return F.transform(tokens, lambda t: F.when(t["kind"] == "id", "ID").when(t["kind"] == "num", "NUM").otherwise(t["v"]))


signed = H.signed


def lsh_buckets(signatures: DataFrame) -> DataFrame:
    """One row per body and band: id, band, bucket."""
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.slice("sig", b * ROWS + 1, F.lit(ROWS)))
    return signatures.select("id", F.posexplode(bands).alias("band", "bucket"))


@dataclass(frozen=True)
class Clones:
    """pairs: a, b, sim; clusters: see clone_clusters; stats: one row of counters."""

    pairs: DataFrame
    clusters: DataFrame
    stats: DataFrame


def lsh_candidates(buckets: DataFrame, largest: int | None = 60) -> DataFrame:
    """Distinct pairs (a < b) that share a bucket; buckets over ``largest`` are left out, as the counters say."""
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if largest is not None:
        sizes = sizes.where(F.col("n") <= largest)
    own = buckets.join(sizes.drop("n"), ["band", "bucket"])
    x, y = own.select("band", "bucket", F.col("id").alias("a")), own.select("band", "bucket", F.col("id").alias("b"))
    return x.join(y, ["band", "bucket"]).where("a < b").select("a", "b").distinct()


def judged_pairs(candidates: DataFrame, signatures: DataFrame, floor: float, spans: bool = False) -> DataFrame:
    """Candidates with verdict (nested, size, low or accepted) and sim, checked in that order."""
    extra = ["file", "line", "end_line"] if spans else []
    side = lambda s: signatures.select(F.col("id").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in ("shingles", "n_shingles", *extra)])
    both = candidates.join(side("a"), "a").join(side("b"), "b")
    nested = (F.col("a_file") == F.col("b_file")) & (F.col("a_line") <= F.col("b_end_line")) & (F.col("b_line") <= F.col("a_end_line")) if spans else F.lit(False)
    sized = F.least("a_n_shingles", "b_n_shingles") / F.greatest("a_n_shingles", "b_n_shingles")
    sim = F.when(~nested & (sized >= floor), N.jaccard(F.col("a_shingles"), F.col("b_shingles")))
    verdict = F.when(nested, "nested").when(sized < floor, "size").when(F.col("sim") < floor, "low").otherwise("accepted")
    return both.withColumn("sim", sim).withColumn("verdict", verdict).select("a", "b", "sim", "verdict")


def clone_clusters(accepted: DataFrame, bodies: DataFrame) -> DataFrame:
    """Connected accepted pairs: cluster_id (smallest id), members, names, files, copies, size (mean), min_sim, same_name.

    bodies needs id, name, file, line and size.  Rows come in report order: differing names first, then those that
    cross files, then the most copied tokens.
    """
    ends = accepted.select(F.col("a").alias("node")).unionAll(accepted.select(F.col("b").alias("node")))
    roots = connected_components(ends, accepted)
    least = accepted.join(roots, accepted.a == roots.node).groupBy("root").agg(F.min("sim").alias("min_sim"))
    member = F.struct("file", "line", "name", "id")
    grouped = roots.join(bodies.select(F.col("id").alias("node"), "id", "name", "file", "line", "size"), "node").groupBy("root")
    out = grouped.agg(F.array_sort(F.collect_list(member)).alias("members"), F.array_sort(F.collect_set("name")).alias("names"), F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("copies"), F.floor(F.avg("size") + 0.5).cast("int").alias("size"))
    out = out.join(least, "root").select(F.col("root").alias("cluster_id"), "members", "names", "files", "copies", "size", N.half_up(F.col("min_sim"), 2).alias("min_sim"), (F.size("names") == 1).alias("same_name"))
    return out.orderBy(F.col("same_name"), F.col("files") == 1, F.desc(F.col("copies") * F.col("size")), F.col("members")[0]["file"], F.col("members")[0]["line"])


def body_clones(bodies: DataFrame, min_body: int = 40, floor: float = 0.7, k: int = 5, largest: int | None = 60) -> Clones:
    """Near-duplicate bodies (id, name, file, line, end_line, size, words) with every step counted."""
    from .graph import _cut

    large = bodies.where(F.col("size") >= min_body)
    sigs = _cut(signed(large, k))
    buckets = _cut(lsh_buckets(sigs))
    judged = _cut(judged_pairs(lsh_candidates(buckets, largest), sigs, floor, spans=True))
    accepted = judged.where("verdict = 'accepted'").select("a", "b", "sim")
    sizes = buckets.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = sizes.agg(F.count(F.lit(1)).alias("buckets"), F.lit(0).cast("bigint").alias("oversize_buckets") if largest is None else F.count_if(F.col("n") > largest).alias("oversize_buckets"))
    of = lambda *v: F.count_if(F.col("verdict").isin(*v))
    verdicts = judged.agg(F.count(F.lit(1)).alias("candidate_pairs"), of("nested").alias("nested"), of("size").alias("ruled_out_size"), of("low", "accepted").alias("verified"), of("accepted").alias("accepted"))
    seen = bodies.agg(F.count(F.lit(1)).alias("functions"), F.count_if(F.col("size") < min_body).alias("too_small"))
    stats = seen.crossJoin(sigs.agg(F.count(F.lit(1)).alias("signed"))).crossJoin(counted).crossJoin(verdicts)  # one row each
    return Clones(accepted, clone_clusters(accepted, large), stats)
