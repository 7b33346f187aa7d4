"""Sources: source trees, socket tables, owners, journals, record lines."""

from __future__ import annotations

import contextlib
import ipaddress
import os
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name endings that count as source code.
EXTENSIONS = (".js", ".mjs", ".cjs", ".jsx", ".ts", ".mts", ".cts", ".tsx", ".rs")
#: Directory name prefixes that hold no sources of one's own.
SKIPPED_PREFIXES = ("node_modules", "dist")
CACHE_MARK = "CACHEDIR.TAG"

TCP_STATES = {1: "ESTABLISHED", 2: "SYN_SENT", 3: "SYN_RECV", 4: "FIN_WAIT1", 5: "FIN_WAIT2", 6: "TIME_WAIT", 7: "CLOSE", 8: "CLOSE_WAIT", 9: "LAST_ACK", 10: "LISTEN", 11: "CLOSING"}


def normalised_extensions(given: str | None) -> tuple[str, ...]:
    """A comma-separated list, which replaces the default; trimmed, lower-cased, each with its dot."""
    if not given:
        return EXTENSIONS
    return tuple(x if x.startswith(".") else f".{x}" for x in (p.strip().lower() for p in given.split(",")) if x)


def source_paths(root: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(path, path below root) of each source file in sorted order, and (directory, reason) of what can't be read.

    Links, dependency and build directories, cache directories, tests and declaration files are left out.
    """
    skipped_ends = (".d.ts", *(f".{kind}{e}" for kind in ("test", "spec") for e in extensions))
    found, skipped, todo = [], [], [root]
    while todo:
        folder = todo.pop()
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            skipped.append((folder, f"readdir: {e.strerror}"))
            continue
        if any(e.name == CACHE_MARK for e in entries) and folder != root:
            continue
        for e in entries:
            if e.is_symlink():
                continue
            if e.is_dir():
                if not e.name.startswith(SKIPPED_PREFIXES):
                    todo.append(e.path)
            elif e.name.endswith(extensions) and not e.name.endswith(skipped_ends):
                found.append((e.path, os.path.relpath(e.path, root)))
    return sorted(found, key=lambda x: x[1]), skipped


def read_sources(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """files (file, lang, source) and skipped (file, reason) of a tree that driver and executors both see.

    Only paths are listed on the driver; texts are read where they are used.
    """
    paths, skipped = source_paths(root, extensions)
    listed = spark.createDataFrame(paths, "path string, file string").repartition(max(1, len(paths) // 64))

    def read(batches):
        for pdf in batches:
            out = []
            for path, file in zip(pdf["path"], pdf["file"], strict=True):
                try:
                    with open(path, encoding="utf-8", errors="replace", newline="") as f:
                        out.append((file, "rust" if file.lower().endswith(".rs") else "js", f.read(), None))
                except OSError as e:
                    out.append((file, None, None, f"read: {e.strerror}"))
            yield pd.DataFrame(out, columns=["file", "lang", "source", "reason"])

    rows = listed.mapInPandas(read, "file string, lang string, source string, reason string")
    lost = spark.createDataFrame(skipped, "file string, reason string").unionByName(rows.where("reason is not null").select("file", "reason"))
    return rows.where("reason is null").drop("reason"), lost


def address(text: str) -> tuple[str, int]:
    """IP and port of a kernel socket table's address: 32-bit groups in host order, port in hex."""
    groups, port = text.split(":")
    raw = b"".join(bytes.fromhex(groups[i : i + 8])[::-1] for i in range(0, len(groups), 8))
    if len(raw) == 4:
        return str(ipaddress.IPv4Address(raw)), int(port, 16)
    parts = [int.from_bytes(raw[i : i + 2]) for i in range(0, 16, 2)]
    runs = [(n, -i) for i in range(8) for n in range(2, 9 - i) if not any(parts[i : i + n])]
    if not runs:
        return ":".join(f"{p:x}" for p in parts), int(port, 16)
    n, at = max(runs)
    return ":".join(f"{p:x}" for p in parts[:-at]) + "::" + ":".join(f"{p:x}" for p in parts[-at + n :]), int(port, 16)


def socket_entries(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries (seq, local_ip, local_port, remote_ip, remote_port, state, inode) and malformed lines of socket tables.

    lines: seq, value, and optionally table.  The first line (by seq) of each table is its header; it and blank
    lines are neither.
    """
    schema = "seq bigint, value string, local_ip string, local_port int, remote_ip string, remote_port int, state string, inode string"

    def parse(batches):
        for pdf in batches:
            out = []
            for seq, value in zip(pdf["seq"], pdf["value"], strict=True):
                fields = (value or "").split()
                if not fields:
                    continue
                try:
                    if len(fields) < 10:
                        raise ValueError
                    (lip, lport), (rip, rport) = address(fields[1]), address(fields[2])
                    out.append((seq, value, lip, lport, rip, rport, TCP_STATES.get(int(fields[3], 16), fields[3]), fields[9]))
                except ValueError:
                    out.append((seq, value, None, None, None, None, None, None))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"local_port": "Int32", "remote_port": "Int32"})

    named = lines if "table" in lines.columns else lines.withColumn("table", F.lit(""))
    heads = named.groupBy("table").agg(F.min("seq").alias("seq"))
    body = named.join(F.broadcast(heads), ["table", "seq"], "left_anti")  # one row a table
    rows = body.select(F.col("seq").cast("bigint"), "value").mapInPandas(parse, schema)
    return rows.where("inode is not null").drop("value"), rows.where("inode is null").select("seq", "value")


def socket_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines (table, seq, value) of several socket tables in the order given; missing tables are left out, and none at all is an error."""
    rows = []
    for path in paths:  # a kernel's tables are small and local to one machine
        try:
            with open(path, encoding="utf-8", errors="replace") as f:
                rows += [(path, line) for line in f.read().split("\n")]
        except OSError:
            continue
    if not rows:
        raise FileNotFoundError(f"no socket table can be read: {', '.join(paths)}")
    return spark.createDataFrame([(t, i, v) for i, (t, v) in enumerate(rows)], "table string, seq bigint, value string")


def process_owners(spark: SparkSession, root: str = "/proc") -> tuple[DataFrame, dict[str, int]]:
    """owners (seq, inode, pid, comm) of a process directory, one row for each socket of each process, and counts: sockets and unreadable processes."""
    rows, unreadable = [], 0
    for pid in (n for n in os.listdir(root) if n.isdigit()):
        try:
            links = os.listdir(os.path.join(root, pid, "fd"))
        except OSError:  # another user's process, or one that has ended
            unreadable += 1
            continue
        try:
            with open(os.path.join(root, pid, "comm"), encoding="utf-8", errors="replace") as f:
                comm = f.read().strip()
        except OSError:
            comm = ""
        for link in links:
            with contextlib.suppress(OSError):
                if m := re.fullmatch(r"socket:\[(\d+)\]", os.readlink(os.path.join(root, pid, "fd", link))):
                    rows.append((len(rows), m[1], int(pid), comm))
    owners = spark.createDataFrame(rows, "seq bigint, inode string, pid bigint, comm string")
    return owners, {"sockets": len(rows), "unreadable": unreadable}


def first_owners(owners: DataFrame) -> DataFrame:
    """inode, pid, comm: of several owners of an inode the first by seq."""
    return owners.groupBy("inode").agg(F.min_by(F.struct("pid", "comm"), "seq").alias("o")).select("inode", "o.pid", "o.comm")


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed lines (value) that aren't blank; none where there is no such file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException:
        lines = spark.createDataFrame([], "value string")
    return lines.select(F.trim("value").alias("value")).where("value <> ''")


def without_frontmatter(text: Column) -> Column:
    """A Markdown text without the block between --- lines that it starts with."""
    return F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---[ \t]*(\r?\n|$)", "")


def filled_prompt(text: Column, arguments: Column) -> Column:
    """A prompt with its placeholders filled from an array: $ARGUMENTS with all, $1 to $9 with one each (empty if missing)."""
    out = F.replace(text, F.lit("$ARGUMENTS"), F.array_join(arguments, " "))
    for i in range(1, 10):
        out = F.replace(out, F.lit(f"${i}"), F.coalesce(F.get(arguments, F.lit(i - 1)), F.lit("")))
    return out


JOURNAL = "ts string, event string, runtime string, session string, tier string, exit int, sha string, branch string, repo string, log string, lock string, duration_s int"


def journal(lines: DataFrame) -> DataFrame:
    """Journal rows (seq and the journal's fields) of JSON lines (seq, value); a malformed line has the event malformed."""
    parsed = F.from_json("value", JOURNAL + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = lines.where("trim(value) <> ''").select("seq", parsed.alias("j")).select("seq", "j.*")
    return rows.withColumn("event", F.when(F.col("_bad").isNotNull(), "malformed").otherwise(F.col("event"))).drop("_bad")


def append_journal(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    rows.write.mode("append").json(path)
