"""Journal status and reconciliation of claims against facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_event(journal: DataFrame, event: str | None = None, by: list[str] | None = None, seq: str = "seq") -> DataFrame:
    """The last row (by seq) of an event type, whole or for each group."""
    rows = journal if event is None else journal.where(F.col("event") == event)
    return rows.groupBy(*(by or [])).agg(F.max_by(F.struct(*rows.columns), seq).alias("r")).where("r is not null").select("r.*")


def event_counts(journal: DataFrame) -> DataFrame:
    """Rows by event; unreadable rows count as malformed."""
    return journal.groupBy(F.coalesce("event", F.lit("malformed")).alias("event")).agg(F.count(F.lit(1)).alias("rows"))


def status_line(journal: DataFrame) -> DataFrame:
    """One row: how many events, and the tier, exit and sha of the last gate."""
    gate = F.when(F.col("event") == "gate", F.struct("tier", "exit", "sha"))
    return journal.agg(F.count(F.lit(1)).alias("events"), F.max_by(gate, F.when(F.col("event") == "gate", F.col("seq"))).alias("g")).select("events", F.col("g.tier").alias("last_tier"), F.col("g.exit").alias("last_exit"), F.col("g.sha").alias("last_sha"))


def gated(commits: DataFrame, journal: DataFrame, keys: list[str], counts: Column | None = None) -> DataFrame:
    """Commits with a gate row that counts (by default: event gate with exit 0, 1 or 2)."""
    ok = (F.col("event") == "gate") & F.col("exit").isin(0, 1, 2) if counts is None else counts
    return commits.join(journal.where(ok).select(*keys).distinct(), keys, "left_semi")


def ungated(commits: DataFrame, journal: DataFrame, keys: list[str], counts: Column | None = None) -> DataFrame:
    """Commits without one."""
    ok = (F.col("event") == "gate") & F.col("exit").isin(0, 1, 2) if counts is None else counts
    return commits.join(journal.where(ok).select(*keys).distinct(), keys, "left_anti")


def board_claims(lines: DataFrame) -> DataFrame:
    """Claims in record lines (seq, value): kind (landed, reconciled, retired) and subject, each once with its first seq.

    Landed: a line that starts with LANDED and has sha= (the last one in it); retired: a line that is the key
    retired_branch=, blanks before it allowed; reconciled: the first line that starts with the marker
    ``reconciled: <sha>``.  Prose makes no claim.
    """
    v = F.col("value")
    sha = "([0-9a-f]{7,40})"
    landed = F.regexp_extract(v, f"^LANDED.*sha={sha}", 1)
    marker = F.regexp_extract(v, f"^reconciled: {sha}", 1)
    retired = F.regexp_extract(v, r"^\s*retired_branch=([^\s|]*)", 1)
    kinds = F.array(*(F.when(s != "", F.struct(F.lit(k).alias("kind"), s.alias("subject"))) for k, s in (("landed", landed), ("reconciled", marker), ("retired", retired))))
    found = lines.select("seq", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("c")).select("seq", "c.*")
    once = found.where("kind <> 'reconciled'").groupBy("kind", "subject").agg(F.min("seq").alias("seq")).select("seq", "kind", "subject")
    first = found.where("kind = 'reconciled'").groupBy("kind").agg(F.min(F.struct("seq", "subject")).alias("c")).select("c.seq", "kind", "c.subject")
    return once.unionByName(first)


def ancestors(parents: DataFrame, heads: DataFrame) -> DataFrame:
    """sha of every commit that heads (sha) reach over parents (sha, parent), heads included.

    Links are doubled each round, so a history of n generations takes log n rounds; each commit keeps links of
    1, 2, 4, ... generations only as long as a round needs them.
    """
    from .graph import _cut

    hop = _cut(parents.where("parent is not null").select("sha", "parent").distinct())
    seen = _cut(heads.select("sha").distinct())
    while True:
        up = hop.join(seen, "sha").select(F.col("parent").alias("sha"))
        grown = _cut(seen.unionAll(up).distinct())
        far = hop.select("sha", F.col("parent").alias("mid")).join(hop.select(F.col("sha").alias("mid"), "parent"), "mid").select("sha", "parent").distinct()
        further = _cut(far)
        if not further.limit(1).count():
            return grown
        seen, hop = grown, further


def stale_claims(claims: DataFrame, landed: DataFrame, live_branches: DataFrame) -> DataFrame:
    """Claims that facts contradict: landed or reconciled shas that are no ancestors (landed: sha), retired branches that live (branch).

    A sha may be abbreviated to seven characters or more.  Without a reconciled marker there is a row of its own,
    kind reconciled with no subject.
    """
    short = landed.select(F.explode(F.transform(F.sequence(F.lit(7), F.length("sha")), lambda n: F.substring("sha", F.lit(1), n))).alias("subject")).distinct()
    lost = claims.where("kind in ('landed', 'reconciled')").join(short, "subject", "left_anti")
    alive = claims.where("kind = 'retired'").join(live_branches.select(F.col("branch").alias("subject")).distinct(), "subject", "left_semi")
    marked = claims.agg(F.count_if(F.col("kind") == "reconciled").alias("n")).where("n = 0")
    seq = claims.schema["seq"].dataType
    missing = marked.select(F.lit(None).cast("string").alias("subject"), F.lit(None).cast(seq).alias("seq"), F.lit("reconciled").alias("kind"))
    return lost.unionByName(alive).unionByName(missing)


def is_sha(c: Column) -> Column:
    """Whether a value is a whole sha: 40 lower-case hex digits."""
    return F.coalesce(c.rlike("^[0-9a-f]{40}$"), F.lit(False))


def inside(target: Column, root: Column) -> Column:
    """Whether a path is root or lies below it; both are resolved already."""
    base = F.regexp_replace(root, "/+$", "")
    return (target == root) | (target == base) | F.startswith(target, F.concat(base, F.lit("/")))


def missing_lines(wanted: DataFrame, present: DataFrame) -> DataFrame:
    """Lines (value) that present lacks, as an ignore file's additions."""
    return wanted.select("value").distinct().join(present.select("value"), "value", "left_anti")


def worktrees_with(listed: DataFrame, added: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """A worktree list (path, session) after upserts and removals by path."""
    gone = added.select("path") if removed is None else added.select("path").unionAll(removed.select("path"))
    kept = listed.select("path", "session").join(gone.distinct(), "path", "left_anti")
    return kept.unionByName(added.groupBy("path").agg(F.max("session").alias("session")))


def runtime(forced: Column, harness: Column) -> Column:
    """The runtime that a record names: forced, else the harness's, else unknown; empty values count as none."""
    some = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(some(forced), some(harness), F.lit("unknown"))


def doctor(checks: DataFrame) -> DataFrame:
    """One row for a table of checks (check, status OK, WARN or FAIL): verdict (fail if any fails), and counts."""
    of = lambda v: F.count_if(F.col("status") == v)
    return checks.agg(F.when(of("FAIL") > 0, "fail").otherwise("ok").alias("verdict"), of("OK").alias("ok"), of("WARN").alias("warn"), of("FAIL").alias("fail"))


def size_check(files: DataFrame, budget: int = 12288) -> DataFrame:
    """Checks (check, status) that files (file, bytes) keep within a size budget."""
    return files.select(F.concat(F.lit("size "), "file").alias("check"), F.when(F.col("bytes") > budget, "FAIL").otherwise("OK").alias("status"))


def verdict(stale: DataFrame, can_look: bool = True) -> DataFrame:
    """One row: stale, reconciled, or cannot-look, which never passes."""
    n = F.count(F.lit(1))
    return stale.agg(F.when(F.lit(not can_look), "cannot-look").when(n > 0, "stale").otherwise("reconciled").alias("verdict"), n.alias("stale"))


def inventory_changes(groups: DataFrame, inventory: DataFrame, key: str) -> DataFrame:
    """key, change: new (not in the inventory), stale (no longer there) or same."""
    now, then = groups.select(key).distinct().withColumn("_now", F.lit(1)), inventory.select(key).distinct().withColumn("_then", F.lit(1))
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "stale").otherwise("same")
    return now.join(then, key, "full_outer").select(key, change.alias("change"))
