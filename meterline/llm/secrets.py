"""Secret scans: fixed patterns, and passwords found by what they would cost to guess.

The patterns give the base spans. The method adds values that stand in a credential context
(after a name such as ``pwd`` or ``bearer``) and that a guesser would need many tries for: the
value is cut into words, dates, repeats, keyboard walks and brute-force spans so that the
product of their guesses is least, by dynamic programming over positions. Base spans stay
whatever their cost; a value inside a base span is not reported again, one that goes on beyond
it is reported whole.

A value follows ``:``, ``=``, ``==``, ``:=`` or ``=>``, on the same line, or `` is `` or ``bearer``.
A quoted value goes up to its closing quote, over line breaks but not over an empty line; any
other goes up to the next blank, so that it takes along what is joined to it, such as ``&user=x``
or a tag. Its cost alone decides, however short it is and of whatever characters.

Left out: values that cost less; values of letters only after `` is ``, where prose is meant;
what follows a blank in a value without quotes; and, at the end of a value without quotes, marks
that end a sentence and brackets or quotes that it does not open.

Defined results: a null or empty text has no spans; long texts are scanned whole; rows are
scanned one by one, so ties and repeated rows get equal results. Positions are code points,
ends are exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterline.llm.common import table

# Patterns of the base kinds, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS = 6, 20

#: Names after which a value is a credential, also after a prefix such as ``db_``, and what may stand between; group 1 is a quote after the name, 2 the `` is `` form.
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pwd|pass(?:phrase|code|word|wd)?|secret|token|credentials?|auth|bearer"""
    r"""|(?:api|access|private|client|secret)[_-]?key)(["'])?"""
    r"""(?:[\x20\t]*(?::=|=>|={1,3}|:)[\x20\t]*|([\x20\t]+is[\x20\t]+)|(?<=bearer)[\x20\t]+)"""
    r"""(?:(?:bearer|basic)[\x20\t]+)?(?=\S)""",
    re.ASCII | re.IGNORECASE,
)
BLANK = re.compile(r"\s")
#: What ends a quoted value: its quote, unless escaped or an apostrophe within a word, or an empty line.
QUOTE_ENDS = {
    q: re.compile(rf"\\.|(?P<close>{q}{'(?![A-Za-z0-9])' * (q != chr(34))})|\n[\x20\t\r]*\n", re.DOTALL) for q in "\"'`"
}
#: A number or word of JSON after a quoted name, which ends before the next member.
LITERAL = re.compile(r"""(?:-?\d[\d.eE+-]*|true|false|null)(?=[,}\]]+(?:["'\s]|$))""", re.ASCII)
#: Marks at the end of a value without quotes that belong to the sentence, and pairs of brackets.
SENTENCE_MARKS, BRACKETS = ".,;:!?", ("()", "[]", "{}", "<>")
#: Lower-case parts of which every name in ASSIGN or CONTEXT holds one; a plain search is much faster.
NAME_PARTS = ("pass", "pwd", "secret", "token", "key", "cred", "auth", "bearer")
#: A value is reported if guessing it takes at least ten to this power of tries.
MIN_LOG10 = 8.0

# Common words of passwords, the most common first.
WORDS = (
    "password passwd pass admin root user login welcome secret letmein master test guest default changeme "
    "dragon monkey shadow sunshine princess football baseball superman batman hello love money freedom "
    "whatever trustno access system server database manager service account token private public example "
    "sample demo temp summer winter spring autumn january february march april june july august september "
    "october november december monday friday sunday the and for you with this that from have"
).split()
RANK = {word: rank for rank, word in enumerate(WORDS, 1)}
LONGEST_WORD = max(map(len, WORDS))
# Signs that stand for letters, and rows of keys.
LEET = str.maketrans("@4310$57!", "aaeiosstl")
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
NEXT_KEYS = {
    pair for row in KEY_ROWS for line in (row, row[::-1]) for pair in zip(line, line[1:], strict=False)
}
DATE = re.compile(r"(?:19|20)\d\d[-./]?(?:(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01]))?", re.ASCII)

_LOG2, _BRUTE = math.log10(2), math.log10(10)


def _charset(c: str) -> float:
    """Log10 of how many characters a guesser tries at a place that holds this one."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def _runs(value: str, joined) -> list[int]:
    """For each position, the end of the run beginning there whose neighbours are all joined."""
    ends = list(range(1, len(value) + 1))
    for i in range(len(value) - 2, -1, -1):
        if joined(value[i], value[i + 1]):
            ends[i] = ends[i + 1]
    return ends


def guess_log10(value: str) -> float:
    """Log10 of the tries that the cheapest segmentation of the value needs."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    repeats = _runs(low, lambda a, b: a == b)
    walks = _runs(low, lambda a, b: (a, b) in NEXT_KEYS)
    best = [0.0] + [math.inf] * n
    for i in range(n):
        at = best[i]
        steps = [(i + 1, _charset(value[i]))]
        for length in range(3, min(LONGEST_WORD, n - i) + 1):
            word = plain[i : i + length]
            if word in RANK:
                cost = math.log10(RANK[word]) + _LOG2 * (low[i : i + length] != word)
                steps.append((i + length, cost + _LOG2 * (value[i : i + length] != low[i : i + length])))
        found = DATE.match(value, i)
        if found:
            steps.append((found.end(), math.log10(366 * 60 if found.end() - i > 5 else 120)))
        for end in (repeats[i], walks[i]):
            if end - i >= 3:
                steps.append((end, _charset(value[i]) + math.log10(end - i)))
        for end, cost in steps:
            best[end] = min(best[end], at + cost + (_BRUTE * 0.1 if i else 0.0))
    return best[n]


def _names_a_credential(text: str) -> bool:
    low = text.lower()
    return any(part in low for part in NAME_PARTS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the fixed patterns, sorted."""
    found = []
    if _names_a_credential(text):
        matches = ASSIGN.finditer(text)
        found = [(m.start(), 0, m.end()) for m in matches if m.end(2) - m.start(2) >= MIN_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _trimmed(value: str) -> str:
    """A value without quotes, less the marks at its end that belong to the text around it."""
    spare = {c: value.count(c) - value.count(o) for o, c in BRACKETS} | {q: value.count(q) % 2 for q in QUOTE_ENDS}
    end = len(value)
    while end and (value[end - 1] in SENTENCE_MARKS or spare.get(value[end - 1], 0) > 0):
        end -= 1
        if value[end] in spare:
            spare[value[end]] -= 1
    return value[:end]


def context_values(text: str) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, after `` is ``, quoted) of the values in a credential context, which may overlap."""
    at = blank = 0
    closes = dict.fromkeys(QUOTE_ENDS, (0, 0, None))  # from, to, and the end of any value that opens between
    while m := CONTEXT.search(text, at):
        start = at = m.end()
        quote = text[start]
        if quote in QUOTE_ENDS:
            start += 3 if text.startswith(quote * 3, start) else 1
            low, high, end = closes[quote]
            if not low <= start <= high:
                stop = next((x for x in QUOTE_ENDS[quote].finditer(text, start) if x[0][0] != "\\"), None)
                end = stop.start() if stop and stop["close"] else None
                closes[quote] = (start, stop.start() if stop else len(text), end)
            if end is not None:
                yield start, end, bool(m[2]), True
                continue
        if m[1] and (literal := LITERAL.match(text, start)):
            yield start, literal.end(), False, False
            continue
        if start >= blank:
            stop = BLANK.search(text, start)
            blank = stop.start() if stop else len(text)
        yield start, blank, bool(m[2]), False


def all_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    starts, reach = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    more, done = [], 0
    for start, stop, stated, quoted in context_values(text) if _names_a_credential(text) else ():
        if stop <= done:  # within a value that is reported, or within a base span
            continue
        value = text[start:stop] if quoted else _trimmed(text[start:stop])
        before = bisect_right(starts, start)
        inside = before and start + len(value) <= reach[before - 1]
        if not inside and (stated and value.isalpha() or guess_log10(value) < MIN_LOG10):
            continue
        if value and not inside:
            more.append((start, 3, start + len(value)))
        done = stop
    return sorted(base + more)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def redacted(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    parts, at = [], 0
    for start, _, end in spans:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


_STRUCT = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, n_guess bigint, spans string"


def _scan(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts.to_pylist():
        spans = all_spans(text or "")
        base = [s for s in spans if s[1] < 3]
        n = [sum(kind == k for _, kind, _ in spans) for k in range(4)]
        digest = hashlib.sha256(listed(base).encode()).hexdigest()
        rows.append((n[0], n[1], n[2], digest, n[3], listed(spans)))
    names = [part.split()[0] for part in _STRUCT.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.string()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _redact(texts: pa.Array) -> pa.Array:
    return pa.array([t and redacted(t, all_spans(t)) for t in texts.to_pylist()], pa.string())


def scan(text: Column) -> Column:
    """Counts, digest and list of the secrets of a text, as a struct."""
    return F.arrow_udf(_scan, _STRUCT).asNondeterministic()(text)


def redact(text: Column) -> Column:
    """The text with its secrets replaced; null stays null."""
    return F.arrow_udf(_redact, "string").asNondeterministic()(text)


def op9_secret_scans(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", scan(F.col("text")).alias("found")).select("doc_id", "found.*")
