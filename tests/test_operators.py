import random

from pyspark.sql import functions as F

from echofold.functions import hashes
from echofold.operators import clones, idioms, pairs, peers, records
from echofold.operators.graph import connected_components


def functions(spark, rows):
    return spark.createDataFrame(rows, "name string, file string, line int")


def test_tiers_take_the_lowest_and_cross_files(spark):
    f = functions(spark, [("load", "a", 1), ("load", "b", 1), ("load", "a", 9), ("Load_", "c", 1), ("getUser", "a", 3), ("userz", "d", 4)])
    got = {(r.a.file, r.a.line, r.b.file, r.b.line): r.tier for r in pairs.name_tiers(f, []).collect()}
    assert got == {("a", 1, "b", 1): 1, ("a", 9, "b", 1): 1, ("a", 1, "c", 1): 2, ("a", 9, "c", 1): 2, ("b", 1, "c", 1): 2, ("a", 3, "d", 4): 3}


def test_ignored_pairs_are_counted_not_lost(spark):
    f = functions(spark, [("constructor", "a", 1), ("constructor", "b", 1), ("shared", "a", 2), ("shared", "b", 2)])
    t = pairs.name_tiers(f)
    assert [tuple(r) for r in pairs.tier_counts(t).collect()] == [(1, 1, 1)]
    assert [tuple(r) for r in pairs.ignored_breakdown(t).collect()] == [("constructor", 1)]
    assert pairs.name_tiers(f, []).where("is_ignored").count() == 0


def test_evidence(spark):
    ten = [str(i) for i in range(10)]
    rows = [(1, ten, 10, ten * 1, 400), (2, ten, 10, [f"x{i}" for i in range(10)], 10), (3, ten, 10, ten, 10), (4, ten, 10, ten[:5] + [f"x{i}" for i in range(5)], 10)]
    e = pairs.body_evidence(spark.createDataFrame(rows, "id int, a_set array<string>, a_size int, b_set array<string>, b_size int"))
    got = {r.id: r for r in e.collect()}
    assert [got[i].status for i in (1, 2, 3, 4)] == ["ruled-out-size", "ruled-out-disjoint", "confirmed", "compared"]
    assert got[1].sim is None and got[1].examined == 0
    assert 0 < got[2].examined < 10
    assert got[3].sim >= 0.6 and got[3].examined < 10 and got[3].is_lower_bound
    assert got[4].sim == 0.33
    c = pairs.evidence_counts(e).first()
    assert c.compared + c.confirmed + c.pruned_size + c.pruned_disjoint == c.pairs == 4


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8)], "a int, b int")
    nodes = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 8, 9)], "node int")
    assert {tuple(r) for r in connected_components(nodes, edges).collect()} == {(1, 1), (2, 2), (3, 2), (4, 2), (5, 2), (8, 8), (9, 8)}


def test_clones_count_every_step(spark):
    body = [f"w{i}" for i in range(60)]
    rows = [(1, "one", "a", 1, 9, body), (2, "two", "b", 1, 9, body), (3, "in", "a", 2, 8, body), (4, "tiny", "c", 1, 1, ["x"])]
    b = spark.createDataFrame(rows, "id int, name string, file string, line int, end_line int, words array<string>").withColumn("size", F.size("words"))
    c = clones.body_clones(b)
    s = c.stats.first()
    assert (s.functions, s.too_small, s.signed, s.candidate_pairs, s.nested, s.accepted) == (4, 1, 3, 3, 1, 2)
    assert s.nested + s.ruled_out_size + s.verified == s.candidate_pairs
    r = c.clusters.first()
    assert r.names == ["in", "one", "two"] and r.copies == 3 and r.min_sim == 1.0


def test_oversize_bucket_is_counted(spark):
    rows = [(i, "n", f"f{i}", 1, 2, [f"w{j}" for j in range(50)]) for i in range(5)]
    b = spark.createDataFrame(rows, "id int, name string, file string, line int, end_line int, words array<string>").withColumn("size", F.size("words"))
    s = clones.body_clones(b, largest=3).stats.first()
    assert s.oversize_buckets == 16 and s.candidate_pairs == 0


def test_idioms_absorb_shifts_and_filter_generic_runs(spark):
    run = ["open", "rare", "close", "again", "more", "end"]
    rows = [(d, f"f{d}", [f"x{d}{j}" for j in range(5)] + run + [f"y{d}{j}" for j in range(5)]) for d in range(3)] + [(d, f"f{d}", [f"z{d}{j}" for j in range(9)]) for d in range(3, 12)]
    docs = spark.createDataFrame(rows, "d int, file string, norm array<string>")
    docs = docs.withColumn("names", F.transform("norm", lambda x: F.when(x.isin("rare", "again"), x))).withColumn("lines", F.transform("norm", lambda x, i: i + 1))
    got = idioms.find_idioms(docs, size=4, min_files=3, min_info=3.0)
    rows = got.runs.orderBy("rank").collect()
    assert [r.verdict for r in rows] == ["reported", "absorbed", "absorbed"]
    assert rows[0].tokens == 6 and rows[0].names == ["again", "rare"] and rows[0].info == 4.0 and (rows[0].line, rows[0].end_line) == (6, 11)
    s = got.stats.first()
    assert s.absorbed + s.low_info + s.reported == s.recurring == 3


def test_peers(spark):
    rows = [(1, "l", 3080, "l", 0, "LISTEN", "1"), (2, "l", 3080, "l", 50000, "ESTABLISHED", "111"), (3, "l", 50000, "l", 3080, "ESTABLISHED", "222"), (4, "l", 50001, "far", 443, "ESTABLISHED", "333")]
    e = spark.createDataFrame(rows, "seq int, local_ip string, local_port int, remote_ip string, remote_port int, state string, inode string")
    owners = spark.createDataFrame([("111", 1000, "srv"), ("222", 2000, "cli"), ("333", 2000, "cli")], "inode string, pid int, comm string")
    p = peers.pair_connections(e)
    assert {(r.inode, r.peer_inode) for r in p.collect()} == {("111", "222"), ("222", "111"), ("333", None)}
    s = peers.summarise(p, owners, peers.listening(e), threshold=2)
    assert [(r.pid, r.client_end, r.server_end, r.external, r.flagged) for r in s.processes.collect()] == [(2000, 2, 0, 1, True), (1000, 0, 1, 0, False)]
    assert [tuple(r) for r in s.pairs.collect()] == [("srv(1000) :3080  <->  cli(2000)", 1)]
    assert peers.established(e).first().established == 3
    assert peers.summarise(p, owners, peers.listening(e), port=9999).processes.count() == 0


def test_records(spark):
    j = spark.createDataFrame([(1, "gate", "cheap", 2, "a"), (2, "gate", "full", 9, "b"), (3, None, None, None, None), (4, "gate", "full", 0, "c")], "seq int, event string, tier string, exit int, sha string")
    assert records.status_line(j).first().asDict() == {"events": 4, "last_tier": "full", "last_exit": 0, "last_sha": "c"}
    assert records.last_event(j, "gate").first().sha == "c"
    commits = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "sha string")
    assert {r.sha for r in records.ungated(commits, j, ["sha"]).collect()} == {"b", "d"}
    parents = spark.createDataFrame([("c" * 40, "b" * 40), ("b" * 40, "a" * 40), ("f" * 40, "e" * 40)], "sha string, parent string")
    seen = records.ancestors(parents, spark.createDataFrame([("c" * 40,)], "sha string"))
    assert {r.sha[0] for r in seen.collect()} == {"a", "b", "c"}
    text = ["prose reconciled: " + "a" * 9, "LANDED 2026-01-01 | x | sha=" + "a" * 7, "LANDED sha=" + "e" * 9, "we retired branch x", "  retired_branch=live|more", "retired_branch=gone", "see retired_branch=live2", "LANDED again sha=" + "e" * 9, "reconciled: " + "b" * 12, "reconciled: " + "f" * 12]
    lines = spark.createDataFrame(list(enumerate(text)), "seq int, value string")
    claims = records.board_claims(lines)
    assert sorted((r.kind, r.subject) for r in claims.collect()) == [("landed", "a" * 7), ("landed", "e" * 9), ("reconciled", "b" * 12), ("retired", "gone"), ("retired", "live")]
    live = spark.createDataFrame([("live",), ("live2",)], "branch string")
    stale = records.stale_claims(claims, seen, live)
    assert {(r.kind, r.seq) for r in stale.collect()} == {("landed", 2), ("retired", 4)}
    unmarked = records.stale_claims(claims.where("kind <> 'reconciled'"), seen, live)
    assert {(r.kind, r.subject) for r in unmarked.collect()} == {("landed", "e" * 9), ("retired", "live"), ("reconciled", None)}
    assert records.verdict(stale).first().verdict == "stale"
    assert records.verdict(stale, can_look=False).first().verdict == "cannot-look"


def test_ancestors_of_a_long_history(spark):
    n = 40
    parents = spark.createDataFrame([(f"c{i}", f"c{i - 1}") for i in range(1, n)] + [("c30", "d1"), ("d1", "d0"), ("x1", "x0"), ("c0", None)], "sha string, parent string")
    got = {r.sha for r in records.ancestors(parents, spark.createDataFrame([("c35",)], "sha string")).collect()}
    assert got == {f"c{i}" for i in range(36)} | {"d0", "d1"}


def test_small_record_tools(spark):
    row = spark.createDataFrame([("a" * 40, "/w/repo/src", "/w/repo/", "/w/repository")], "sha string, t string, r string, u string").select(
        records.is_sha(F.col("sha")).alias("s"), records.is_sha(F.col("t")).alias("n"), records.inside(F.col("t"), F.col("r")).alias("i"), records.inside(F.col("u"), F.col("r")).alias("o"), records.runtime(F.lit(" "), F.lit("cli")).alias("rt"), records.runtime(F.lit(None), F.lit("")).alias("none")
    ).first()
    assert (row.s, row.n, row.i, row.o, row.rt, row.none) == (True, False, True, False, "cli", "unknown")
    value = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert [r.value for r in records.missing_lines(value("a", "b", "b"), value("a")).collect()] == ["b"]
    tree = lambda *x: spark.createDataFrame(x, "path string, session string")
    got = records.worktrees_with(tree(("p", "1"), ("q", "1"), ("r", "1")), tree(("p", "2"), ("s", "2")), tree(("r", "")))
    assert {tuple(r) for r in got.collect()} == {("p", "2"), ("q", "1"), ("s", "2")}
    checks = records.size_check(spark.createDataFrame([("a", 9), ("b", 99999)], "file string, bytes int"))
    assert records.doctor(checks).first().asDict() == {"verdict": "fail", "ok": 1, "warn": 0, "fail": 1}


def test_candidates_with_evidence(spark):
    ten = [str(i) for i in range(10)]
    rows = [("load", "a", 1, 10, ten), ("load", "b", 1, 10, ten), ("load", "c", 1, 40, ten), ("load", "d", 1, 10, [f"x{i}" for i in range(10)]), ("main", "a", 2, 0, []), ("main", "b", 2, 0, [])]
    f = spark.createDataFrame(rows, "name string, file string, line int, size int, shape_set array<string>")
    g = pairs.group_candidates(f)
    got = [(r.a.file, r.b.file, r.status, r.text) for r in g.pairs.withColumn("text", pairs.evidence_text()).where("not is_ignored").orderBy(*pairs.report_order()).collect()]
    assert got[0][:3] == ("a", "b", "confirmed") and got[0][3].endswith("(confirmed early)")
    assert [x[2] for x in got] == ["confirmed"] + ["ruled-out-size"] * 3 + ["ruled-out-disjoint"] * 2
    empty = g.pairs.where("is_ignored").orderBy(*pairs.ignored_order()).first()
    assert (empty.status, empty.sim, empty.size_ratio) == ("ruled-out-size", None, 0.0)
    c = g.counts.first()
    assert (c.pairs, c.confirmed, c.pruned_size, c.pruned_disjoint, c.shape_computations) == (7, 1, 4, 2, 3)
    assert pairs.prune_percentages(g.counts).first().confirmed_percent == 14.3
    assert [r.file for r in f.orderBy(*pairs.function_order()).collect()] == ["a", "a", "b", "b", "c", "d"]


def test_gram_sets_match_the_plain_hashes():
    rng = random.Random(2)
    for _ in range(20):
        texts = [" ".join(rng.choice(["a", "bé", "😀x", "cc", "word"]) for _ in range(rng.randint(0, 40))) for _ in range(8)]
        flat, counts = hashes.gram_sets(texts, 3)
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            w = t.split()
            want = sorted({hashes.fnv1a(" ".join(w[i : i + 3])) for i in range(len(w) - 2)})
            assert flat[at : at + n].tolist() == want
            at += n
        some = counts[counts > 0]
        sig, at = hashes.signatures(flat, some), 0
        for s, n in zip(sig, some.tolist(), strict=True):
            assert s.tolist() == hashes.signature(flat[at : at + n]).tolist()
            at += n


def bodied(spark, seed, n):
    rng = random.Random(seed)
    word = lambda: [rng.choice("abcdef") for _ in range(rng.randint(0, 4))]
    rows = [(rng.choice(["load", "save", "run"]), rng.choice(["x", "y", "z", None]), i // 2, rng.randint(0, 5), list(dict.fromkeys(word()))) for i in range(n)]
    return spark.createDataFrame(rows, "name string, file string, line int, size int, shape_set array<string>")


def test_evidence_by_set_is_that_of_each_pair(spark, monkeypatch):
    f = bodied(spark, 3, 60)
    rows = f.collect()
    both = [(a.file, a.line, b.file, b.line, a.shape_set, a.size, b.shape_set, b.size) for a in rows for b in rows if a.name == b.name and a.file and b.file and a.file < b.file]
    plain = spark.createDataFrame(both, "af string, al int, bf string, bl int, a_set array<string>, a_size int, b_set array<string>, b_size int")
    judged = pairs.body_evidence(plain)
    key = lambda rs: sorted(map(repr, map(tuple, rs)))
    want = key(judged.select("af", "al", "bf", "bl", "status", "sim", "is_lower_bound", "examined", "size_ratio").collect())
    for few in (100_000, 0):
        monkeypatch.setattr(pairs, "_FEW_SETS", few)
        got = pairs.exact_evidence(f).select("a.file", "a.line", "b.file", "b.line", "status", "sim", "is_lower_bound", "examined", "size_ratio")
        assert key(got.collect()) == want
    assert pairs.evidence_counts(pairs.counted_exact_evidence(f)).first() == pairs.evidence_counts(judged).first()
    assert pairs.evidence_counts(pairs.counted_exact_evidence(f.limit(0))).first().pairs == 0


def test_evidence_meets_in_units_and_few_copies(spark, monkeypatch):
    frequent = spark.createDataFrame([("load", 50_000), ("run", 10)], "name string, n long")
    assert {r.name: r.parts for r in pairs._parts(frequent, 8).collect()} == {"load": 32, "run": 1}
    monkeypatch.setattr(pairs, "_BLOCK", 4)
    f = spark.createDataFrame([("load", "xyz"[i % 3], i, None if i % 5 == 0 else 2, ["a"]) for i in range(40)], "name string, file string, line int, size int, shape_set array<string>")
    units = pairs._units(pairs._numbered(f, pairs._set_pairs(f, 0.3, 0.6)[0])).collect()
    assert sum(u.n for u in units) == 40 and 2 < len(units) < 40
    got = sorted((r.a.file, r.a.line, r.b.file, r.b.line, r.status) for r in pairs.exact_evidence(f).collect())
    rows = f.collect()
    status = lambda a, b: "compared" if a.size or b.size else "ruled-out-size"  # noqa: E731  greatest and least leave null out
    assert got == sorted((a.file, a.line, b.file, b.line, status(a, b)) for a in rows for b in rows if a.file < b.file)


def test_counted_tiers_are_those_of_all_pairs(spark):
    rng = random.Random(5)
    names = ["load", "Load_", "lod", "getUser", "userz", "user", "main", None]
    for per_line in (1, 3):  # one name a place, then several
        f = functions(spark, [(rng.choice(names), rng.choice(["a", "b", "c", None]), i // per_line) for i in range(50)])
        tiers, counted = pairs.name_tiers(f, ["load", "main"]), pairs.counted_tiers(f, ["load", "main"])
        assert sorted(map(tuple, pairs.tier_counts(counted).collect())) == sorted(map(tuple, pairs.tier_counts(tiers).collect()))
        assert [tuple(r) for r in pairs.ignored_breakdown(counted).collect()] == [tuple(r) for r in pairs.ignored_breakdown(tiers).collect()]


def test_first_pairs_are_the_head_of_all(spark):
    rng = random.Random(7)
    f = functions(spark, [(rng.choice(["load", "save", "run", "only"]), "z" if i > 55 else rng.choice("abc"), i // 3) for i in range(60)] + [("load", "a", 0)] * 3)
    order = ["a.file", "a.line", "a.name", "b.file", "b.line"]
    every = [tuple(r) for r in pairs.exact_name_pairs(f).orderBy(*order).collect()]
    for n in (1, 7, 100, 5000):
        assert [tuple(r) for r in pairs.first_exact_pairs(f, n).orderBy(*order).collect()] == every[:n]


def test_a_frequent_name_is_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "_BLOCK", 4)
    rows = [("load", "abc"[i % 3], i) for i in range(30)] + [("lode", "abc"[i % 3], 99 + i) for i in range(9)] + [("once", "a", 1)]
    f = functions(spark, rows)
    places = lambda p: sorted((r.a.file, r.a.line, r.b.file, r.b.line) for r in p.collect())
    met = lambda same: sorted((x[1], x[2], y[1], y[2]) for x in rows for y in rows if x[1] < y[1] and (x[0] == y[0]) == same and (same or "once" not in (x[0], y[0])))
    assert places(pairs.exact_name_pairs(f)) == met(True)
    assert places(pairs.near_name_pairs(f)) == met(False)


def test_idioms_match_brute_force_and_read_only_stretches(spark):
    rng = random.Random(11)
    part = [[rng.choice("abcdefgh") + str(i % 3) for i in range(30)] for _ in range(3)]
    bodies = [[f"x{d}_{j}" for j in range(9)] + sum(([*part[rng.randrange(3)][a : a + 18], f"y{d}{a}"] for a in rng.choices(range(12), k=3)), []) for d in range(12)]
    docs = spark.createDataFrame([(d, f"f{d:02}", w, w, list(range(1, len(w) + 1))) for d, w in enumerate([*bodies, ["only"] * 3, ["far", "off"] * 40])], "d int, file string, norm array<string>, names array<string>, lines array<int>")
    size, least, first = 8, 3, {}
    for d, w in enumerate(bodies):
        for i in range(len(w) - size + 1):
            first.setdefault(tuple(w[i : i + size]), {}).setdefault(d, i)
    want = []
    for at in first.values():
        if len(at) >= least:
            same = lambda k: all(0 <= i + k < len(bodies[d]) for d, i in at.items()) and len({bodies[d][i + k] for d, i in at.items()}) == 1  # noqa: B023, E731
            left = next(x for x in range(99) if not same(-x - 1))
            right = next(x for x in range(99) if not same(size + x))
            want.append((len(at), size + left + right, sorted((d, i - left) for d, i in at.items())))
    got = idioms.find_idioms(docs, size=size, min_files=least).runs.collect()
    assert sorted((r.files, r.tokens, [tuple(p) for p in r.places]) for r in got) == sorted(want) and len(want) > 9
    assert all(r.line == r.places[0].i + 1 and r.end_line == r.line + r.tokens - 1 for r in got)
    stretches = idioms._spans(docs, size, least).collect()
    assert {r.d for r in stretches} <= set(range(12)) and not any(t.startswith("x") for r in stretches for t in r.norm[size:-size])


def test_idioms_broadcast_no_table(spark, monkeypatch):
    from echofold.operators import graph

    plans = []
    for name in ("_stored", "_cut"):
        monkeypatch.setattr(graph, name, lambda df, f=getattr(graph, name): plans.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    words = ["x", *"abcdefgh", "y"]
    docs = spark.createDataFrame([(d, f"f{d}", w, w, list(range(1, 11))) for d in range(3) for w in [[f"{c}{d}" if c in "xy" else c for c in words]]], "d int, file string, norm array<string>, names array<string>, lines array<int>")
    kept = spark.conf.get(idioms._BATCH)
    got = [(r.files, r.tokens) for r in idioms.find_idioms(docs, size=4, min_files=3, min_info=0.0).runs.collect()]
    assert got == [(3, 8)] * 5 and spark.conf.get(idioms._BATCH) == kept
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def _odd_functions(spark):
    """Copies of a place, places without a line, file or name, a name in one file only."""
    rows = [("load", f"f{i % 3}", i // 2) for i in range(40)] + [("load", "f1", 3)] * 3 + [("load", "f0", None), ("load", None, 1), (None, "f2", 1), ("solitary", "f1", 1), ("solitary", "f1", 2)]
    return rows + [("loads", f"f{i % 2}", i) for i in range(20)] + [("loads", "f2", None)]


def _brute(rows, near):
    """All pairs by comparison of each with each, copies counted."""
    pairs_of = lambda x, y: (x[0] != y[0] and {x[0], y[0]} == {"load", "loads"}) if near else x[0] == y[0]
    return sorted(((x, y) for x in rows for y in rows if None not in (x[0], y[0], x[1], y[1]) and x[1] < y[1] and pairs_of(x, y)), key=str)


def _listed(p):
    place = lambda s: (s.name, s.file, s.line)
    return sorted(((place(r.a), place(r.b)) for r in p.collect()), key=str)


def test_exact_pairs_meet_in_groups_of_a_file(spark, monkeypatch):
    rows = _odd_functions(spark)
    f = functions(spark, rows)
    met = pairs._met_groups(f)
    assert met.count() == 6 and met.agg(F.sum(F.size("x_at") * F.size("y_at"))).first()[0] == len(_brute(rows, False))
    assert _listed(pairs.exact_name_pairs(f)) == _brute(rows, False)
    monkeypatch.setattr(pairs, "_BLOCK", 4)
    assert _listed(pairs.exact_name_pairs(f)) == _brute(rows, False)


def test_near_pairs_meet_in_groups_and_test_no_words_of_functions(spark, monkeypatch):
    rows = _odd_functions(spark)
    f = functions(spark, rows)
    p = pairs.near_name_pairs(f)
    plan = p._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "split(" not in plan
    assert _listed(p) == _brute(rows, True)
    monkeypatch.setattr(pairs, "_BLOCK", 4)
    assert _listed(pairs.near_name_pairs(f)) == _brute(rows, True)
