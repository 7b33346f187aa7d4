"""Table functions over source files: functions, and idiom documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lex

#: Words that an idiom's shape keeps, first those of the language, then its globals and types.
JS_WORDS = frozenset("break case catch class const continue default delete do else export extends finally for function if import in instanceof let new of return super switch this throw try typeof var void while yield await async static true false null undefined".split())
JS_GLOBALS = frozenset("NaN Infinity Math Number Object Array JSON String Boolean Date Map Set WeakMap Promise Symbol console performance window document globalThis".split())
RUST_WORDS = frozenset("as break const continue crate else enum fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait type unsafe use where while async await dyn true false".split())
RUST_TYPES = frozenset("f32 f64 i8 i16 i32 i64 i128 isize u8 u16 u32 u64 u128 usize bool char str Some None Ok Err Option Result Vec String Box".split())

FUNCTIONS = "name string, file string, line int, end_line int, kind string, size int, tokens array<struct<v:string,line:int,kind:string>>"


def scan(files: DataFrame) -> DataFrame:
    """functions and, for a file that can't be parsed, a row with its name in file and the reason alone."""

    def run(batches):
        for pdf in batches:
            out = []
            for file, lang, source in zip(pdf["file"], pdf["lang"], pdf["source"], strict=True):
                try:
                    found = lex.extract(source or "", lang or "js")
                except Exception as e:  # noqa: BLE001  one file's failure is a row, not the job's end
                    out.append((None, file, None, None, None, None, None, f"parse: {type(e).__name__}"))
                    continue
                for f in found:
                    out.append((f.name, file, f.line, f.tokens[-1].line, f.kind, len(f.tokens), [{"v": t.v, "line": t.line, "kind": t.kind} for t in f.tokens], None))
            yield pd.DataFrame(out, columns=["name", "file", "line", "end_line", "kind", "size", "tokens", "reason"]).astype({"line": "Int32", "end_line": "Int32", "size": "Int32"})

    return files.select("file", "lang", "source").mapInPandas(run, FUNCTIONS + ", reason string")


def functions(files: DataFrame) -> DataFrame:
    """Every function of files (file, lang, source), with body tokens; null sources have none, nor have files that can't be parsed (see skipped_files)."""
    return scan(files).where("reason is null").drop("reason")


def skipped_files(files: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """file, reason of files that can't be parsed, after those that could not be read (file, reason)."""
    lost = scan(files).where("reason is not null").select("file", "reason")
    return lost if unread is None else unread.select("file", "reason").unionByName(lost)


def scan_counters(files: DataFrame, unread: DataFrame | None = None) -> DataFrame:
    """One row: files, functions, skipped (unread ones, and those that can't be parsed)."""
    rows = scan(files).agg(F.count_if(F.col("reason").isNull()).alias("functions"), F.count_if(F.col("reason").isNotNull()).alias("lost"))
    seen = files.agg(F.count(F.lit(1)).alias("files"))
    more = files.sparkSession.range(1).select(F.lit(0).cast("bigint").alias("unread")) if unread is None else unread.agg(F.count(F.lit(1)).alias("unread"))
    return seen.crossJoin(rows).crossJoin(more).select("files", "functions", (F.col("lost") + F.col("unread")).alias("skipped"))  # one row each


def idiom_shape(tokens: list[lex.Token], lang: str = "js") -> tuple[list[str], list[str | None]]:
    """Each token's normal form and the kept name that it carries, if any.

    Members after a dot, language words, globals and, in Rust, path segments are kept; numbers and
    other identifiers become their kind.
    """
    words, known = (RUST_WORDS, RUST_TYPES) if lang == "rust" else (JS_WORDS, JS_GLOBALS)
    v = ["", "", *(t.v for t in tokens), "", ""]
    out = []
    for i, t in enumerate(tokens, 2):
        if t.kind == "num":
            out.append(("NUM", None))
        elif t.kind != "id" or t.v in words and v[i - 1] != ".":
            out.append((t.v, None))
        elif v[i - 1] == ".":
            out.append((t.v, f".{t.v}"))
        elif t.v in known:
            out.append((t.v, t.v))
        elif lang == "rust" and v[i - 2] == v[i - 1] == ":":
            out.append((t.v, f"::{t.v}"))
        elif lang == "rust" and v[i + 1] == v[i + 2] == ":":
            out.append((t.v, f"{t.v}::"))
        else:
            out.append(("ID", None))
    return [n for n, _ in out], [n for _, n in out]


def idiom_documents(files: DataFrame) -> DataFrame:
    """files as the documents that find_idioms reads: d (by order of file), file, norm, names, lines.

    Numbers are ranks in name order; only the names meet in one task for that.
    """
    from pyspark.sql import Window

    def run(batches):
        for pdf in batches:
            out = []
            for d, file, lang, source in zip(pdf["d"], pdf["file"], pdf["lang"], pdf["source"], strict=True):
                tokens = lex.tokenise(lex.mask(source or "", lang or "js"))
                norm, names = idiom_shape(tokens, lang or "js")
                out.append((d, file, norm, names, [t.line for t in tokens]))
            yield pd.DataFrame(out, columns=["d", "file", "norm", "names", "lines"])

    paths = files.select("file").distinct()  # only names are ordered in one place
    order = paths.withColumn("d", F.row_number().over(Window.orderBy("file")) - 1)
    return files.join(order, "file").select("d", "file", "lang", "source").mapInPandas(run, "d int, file string, norm array<string>, names array<string>, lines array<int>")
