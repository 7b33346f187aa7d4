import pytest
from pyspark.sql import functions as F

from echofold.operators import code
from echofold.plans.reports import markdown
from echofold.sources import records as S
from echofold.streaming.journal import counts_to, journal_stream


def test_tree(spark, tmp_path):
    for name in ("a.ts", "b.tsx", "a.d.ts", "a.test.ts", "node_modules/x.js", "distant/y.js", "cache/CACHEDIR.TAG", "cache/z.rs", "src/r.rs"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files, skipped = S.read_sources(spark, str(tmp_path))
    assert {(r.file, r.lang) for r in files.collect()} == {("a.ts", "js"), ("b.tsx", "js"), ("src/r.rs", "rust")}
    assert skipped.count() == 0
    assert S.normalised_extensions(" RS, .ts") == (".rs", ".ts")


def test_sockets(spark):
    lines = ["  sl  local_address", "0: 0100007F:0C08 00000000:0000 0A 0:0 0:0 0 0 0 77", "1: 0100007F:0C08 0100007F:C350 01 0:0 0:0 0 0 0 111", "bad line", "2: 00000000000000000000000001000000:0016 B80D0120000000000000000001000000:0001 01 0:0 0:0 0 0 0 5"]
    entries, bad = S.socket_entries(spark.createDataFrame(list(enumerate(lines)), "seq bigint, value string"))
    got = entries.orderBy("seq").collect()
    assert [(r.local_ip, r.local_port, r.state, r.inode) for r in got] == [("127.0.0.1", 3080, "LISTEN", "77"), ("127.0.0.1", 3080, "ESTABLISHED", "111"), ("::1", 22, "ESTABLISHED", "5")]
    assert got[2].remote_ip == "2001:db8::1" and bad.count() == 1


def test_several_tables_and_owners(spark, tmp_path):
    for n, line in (("tcp", "0: 0100007F:0C08 00000000:0000 0A 0:0 0:0 0 0 0 77"), ("tcp6", "junk")):
        (tmp_path / n).write_text(f"any header with ten fields 1 2 3 4 5 6\n{line}\n")
    lines = S.socket_lines(spark, [str(tmp_path / n) for n in ("tcp", "gone", "tcp6")])
    entries, bad = S.socket_entries(lines)
    assert [r.inode for r in entries.collect()] == ["77"] and [r.value for r in bad.collect()] == ["junk"]
    with pytest.raises(FileNotFoundError):
        S.socket_lines(spark, [str(tmp_path / "gone")])
    for pid, comm in ((7, "srv"), (9, "cli")):
        (tmp_path / "proc" / str(pid) / "fd").mkdir(parents=True)
        (tmp_path / "proc" / str(pid) / "comm").write_text(comm + "\n")
        (tmp_path / "proc" / str(pid) / "fd" / "3").symlink_to(f"socket:[{pid}1]")
        (tmp_path / "proc" / str(pid) / "fd" / "4").symlink_to("/dev/null")
    (tmp_path / "proc" / "8").mkdir()
    owners, counts = S.process_owners(spark, str(tmp_path / "proc"))
    assert {tuple(r) for r in S.first_owners(owners).collect()} == {("71", 7, "srv"), ("91", 9, "cli")} and counts == {"sockets": 2, "unreadable": 1}


def test_lines_and_prompts(spark, tmp_path):
    (tmp_path / "l").write_text(" a \n\n b\n")
    assert [r.value for r in S.record_lines(spark, str(tmp_path / "l")).collect()] == ["a", "b"]
    assert S.record_lines(spark, str(tmp_path / "none")).count() == 0
    df = spark.createDataFrame([("---\nk: v\n---\nDo $1 and $2 of $ARGUMENTS", ["x", "y"]), ("no --- front", [])], "t string, a array<string>")
    got = [r.p for r in df.select(S.filled_prompt(S.without_frontmatter(F.col("t")), F.col("a")).alias("p")).collect()]
    assert got == ["Do x and y of x y", "no --- front"]


def test_scan_counters(spark):
    files = spark.createDataFrame([("a.js", "js", "function f() { go() }"), ("b.js", "js", "(" * 10)], "file string, lang string, source string")
    assert code.scan_counters(files).first().asDict() == {"files": 2, "functions": 1, "skipped": 0}
    bad = files.withColumn("source", F.when(F.col("file") == "b.js", F.lit(None).cast("string")).otherwise(F.col("source")))
    assert code.skipped_files(bad, spark.createDataFrame([("c.js", "read: gone")], "file string, reason string")).collect()[0].reason == "read: gone"


def test_journal_and_stream(spark, tmp_path):
    lines = ['{"event":"gate","tier":"full","exit":0}', "not json", "", '{"event":"gate","tier":"cheap","exit":2}']
    got = S.journal(spark.createDataFrame(list(enumerate(lines)), "seq bigint, value string")).orderBy("seq").collect()
    assert [(r.event, r.tier) for r in got] == [("gate", "full"), ("malformed", None), ("gate", "cheap")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(lines))
    counts_to(journal_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert {(r.event, r.tier, r.rows) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {("gate", "full", 1), ("malformed", None, 1), ("gate", "cheap", 1)}


def test_report_is_plain(spark):
    df = spark.createDataFrame([("a|b", 1), ("c", 2)], "k string, n int")
    text = markdown("Title", [("Rows", df)], limit=1)
    assert text == "# Title\n\n## Rows (2, first 1)\n\n| k | n |\n| --- | --- |\n| a\\|b | 1 |\n"
    assert markdown("Title", [("Rows", df)]) == markdown("Title", [("Rows", df)])
