"""License scans: Aho-Corasick over normalised words, and a shunting-yard parser of licence expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slice, small_batches

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: The method's own phrases: label and weight of evidence.
NOTICES = {
    "gnu general public license version 3": ("gpl-3", 0.9),
    "gnu general public license version 2": ("gpl-2", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.8),
    "permission is hereby granted free of charge": ("mit", 0.8),
    "all rights reserved": ("proprietary", 0.5),
}
TAG = "spdx license identifier"
_TAG_TEXT = re.compile(r"(?i)spdx-license-identifier:[ \t]*([^\r\n]*)")
_ATOM = re.compile(r"\s*(\(|\)|[A-Za-z0-9.+\-:]+)")
_RANK = {"or": 1, "and": 2, "with": 3}
#: Licence identifiers that expressions may name, by the label that they get; -only, -or-later and + may follow.
IDENTIFIERS = {
    "mit": ("MIT",), "mit-0": ("MIT-0",), "apache-2": ("Apache-2.0",), "apache-1": ("Apache-1.0", "Apache-1.1"), "bsd": ("0BSD", "BSD-1-Clause", "BSD-2-Clause", "BSD-3-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause"),
    "gpl-1": ("GPL-1.0",), "gpl-2": ("GPL-2.0",), "gpl-3": ("GPL-3.0",), "lgpl": ("LGPL-2.0", "LGPL-2.1", "LGPL-3.0"), "agpl": ("AGPL-1.0", "AGPL-3.0"), "mpl": ("MPL-1.0", "MPL-1.1", "MPL-2.0", "MPL-2.0-no-copyleft-exception"),
    "epl": ("EPL-1.0", "EPL-2.0"), "eupl": ("EUPL-1.1", "EUPL-1.2"), "cddl": ("CDDL-1.0", "CDDL-1.1"), "isc": ("ISC",), "zlib": ("Zlib",), "unlicense": ("Unlicense",), "wtfpl": ("WTFPL",), "bsl-1": ("BSL-1.0",), "artistic": ("Artistic-1.0", "Artistic-2.0"),
    "cc0": ("CC0-1.0",), "cc-by": ("CC-BY-3.0", "CC-BY-4.0"), "cc-by-sa": ("CC-BY-SA-3.0", "CC-BY-SA-4.0"), "cc-by-nc": ("CC-BY-NC-3.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-NC-ND-4.0"), "cc-by-nd": ("CC-BY-ND-4.0",),
    "python": ("PSF-2.0", "Python-2.0"), "openssl": ("OpenSSL",), "curl": ("curl",), "x11": ("X11",), "ncsa": ("NCSA",), "postgresql": ("PostgreSQL",), "unicode": ("Unicode-DFS-2016", "Unicode-3.0"), "ofl": ("OFL-1.1",), "bluoak": ("BlueOak-1.0.0",), "upl": ("UPL-1.0",), "ms": ("MS-PL", "MS-RL"), "sspl": ("SSPL-1.0",), "vim": ("Vim",), "ruby": ("Ruby",), "php": ("PHP-3.01",),
}
#: Exceptions that may follow ``with``.
EXCEPTIONS = frozenset(
    x.lower() for x in ("Classpath-exception-2.0", "LLVM-exception", "GCC-exception-2.0", "GCC-exception-3.1", "Autoconf-exception-2.0", "Autoconf-exception-3.0", "Bison-exception-2.2", "Bootloader-exception", "Font-exception-2.0", "Linux-syscall-note", "OpenJDK-assembly-exception-1.0", "openvpn-openssl-exception", "Qt-GPL-exception-1.0", "Qt-LGPL-exception-1.1", "Swift-exception", "Universal-FOSS-exception-1.0", "WxWindows-exception-3.1", "eCos-exception-2.0", "freertos-exception-2.0", "u-boot-exception-2.0")
)
_LABELS = {i.lower(): label for label, own in IDENTIFIERS.items() for i in own}
PERMISSIVE = {"mit", "mit-0", "apache-2", "apache-1", "bsd", "isc", "zlib", "unlicense", "wtfpl", "bsl-1", "cc0", "cc-by", "python", "curl", "x11", "ncsa", "postgresql", "unicode", "bluoak", "upl", "openssl"}


def label_of(identifier: str) -> str | None:
    """The label of a licence identifier, or None if it is not known; LicenseRef-... is its own label."""
    low = identifier.lower()
    if low.startswith("licenseref-"):
        return low
    for end in ("-only", "-or-later", "+", ""):
        if low.endswith(end) and (label := _LABELS.get(low.removesuffix(end))):
            return label
    return None


_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def parse_expression(text: str) -> tuple[set[str], bool] | None:
    """Labels of a licence expression and whether a permissive choice satisfies it; None if there is no expression.

    Shunting-yard: with binds before and, and before or.  ``a with e`` is licence a (the exception
    only grants more); ``and`` needs both sides permissive; ``or`` one.  Identifiers and exceptions must be
    known; the longest well-formed start of the text counts, so a comment's end or a remark after the
    expression does no harm, and prose makes no licence.
    """
    out: list = []
    ops: list[str] = []
    best = None
    at, want_value = 0, True

    def reduce_top(stack, op):
        right, left = stack.pop(), stack.pop()
        stack.append((left[0] | right[0], left[1] and right[1] if op == "and" else left[1] or right[1]))

    def result():
        stack, rest = list(out), list(ops)
        while rest:
            reduce_top(stack, rest.pop())
        return stack[0]

    while m := _ATOM.match(text, at):
        x, low = m[1], m[1].lower()
        if want_value:
            if x == "(":
                ops.append(x)
            elif x == ")" or low in _RANK:
                break
            elif ops and ops[-1] == "with":
                if low not in EXCEPTIONS:
                    break
                ops.pop()  # the licence before it stands for both
                want_value = False
            elif label := label_of(x):
                out.append(({label}, label in PERMISSIVE))
                want_value = False
            else:
                break
        elif x == ")":
            while ops and ops[-1] != "(":
                reduce_top(out, ops.pop())
            if not ops:
                break
            ops.pop()
        elif low in _RANK:
            while ops and ops[-1] != "(" and _RANK[ops[-1]] >= _RANK[low]:
                reduce_top(out, ops.pop())
            ops.append(low)
            want_value = True
        else:
            break
        at = m.end()
        if not want_value and "(" not in ops:
            best = result()
    return best


def normalised(text: str) -> bytes:
    """Words (A-Z lower-cased) in UTF-8, one space around each."""
    words = text.encode().translate(_TABLE).split()
    return b" " + b" ".join(words) + b" " if words else b" "


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of each whole text.

    One Aho-Corasick pass over the normalised words finds the base phrases, further notices and
    SPDX tags; each tag's expression is parsed in the raw text.  base_labels and n_base come from
    base phrases alone; labels also hold the method's.  permissive: some tag's expression, or else
    some notice, allows permissive use (null without a licence).  score is the strongest evidence:
    1 a parsed tag, 0.9 a named licence, 0.8 a clause, 0.5 a reservation, 0 none.

    A null text is empty.  Each row gives one row; other columns are ignored.  No shuffle.
    """
    schema = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, permissive boolean"

    def build():
        import ahocorasick

        machine = ahocorasick.Automaton()
        for phrase, label in BASE_PHRASES.items():
            machine.add_word(f" {phrase} ", (len(phrase) + 1, label, 0.9, True))
        for phrase, (label, weight) in NOTICES.items():
            machine.add_word(f" {phrase} ", (len(phrase) + 1, label, weight, False))
        machine.add_word(f" {TAG} ", (len(TAG) + 1, None, 1.0, False))
        machine.make_automaton()
        return machine

    def make(batch):
        machine = _MACHINES.setdefault("licenses", None) or _MACHINES.update(licenses=build()) or _MACHINES["licenses"]
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            text = text or ""
            line = normalised(text).decode("latin-1")
            starts, base, more, score, allowed, tagged, word, seen = [], set(), set(), 0.0, [], False, 0, 0
            for end, (size, label, weight, is_base) in machine.iter(line):
                if label is None:
                    tagged = True
                    continue
                score = max(score, weight)
                (base if is_base else more).add(label)
                allowed.append(label in PERMISSIVE)
                if is_base:
                    first = end - size
                    word, seen = word + line.count(" ", seen, first), first
                    starts.append(word)
            if tagged:
                parsed = [p for p in map(parse_expression, _TAG_TEXT.findall(text)) if p]
                if parsed:
                    score, allowed = 1.0, [ok for _, ok in parsed]
                    more.update(*(labels for labels, _ in parsed))
            rows.append((doc, line.count(" ") - 1, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), score, any(allowed) if allowed else None))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return small_batches(docs).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(by_slice(make), schema)


_MACHINES: dict = {}
