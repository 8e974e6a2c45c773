"""Secrets in text: fixed patterns, and values in credential contexts by guess cost.

Three patterns give the base spans. A fourth kind, ``guess``, reads the value that is assigned to a
credential word (after ``:``, ``=`` or ``=>``, or quoted after "is") and asks how many guesses it would take:
the cheapest way to cut the value into ranked words, dates, repeats, sequences, keyboard walks and
brute-force characters, found by dynamic programming over its prefixes. The ranked words are
those of passwords and placeholders and, after them, the ``RANKED`` commonest of the corpus itself, counted
over all documents and broadcast. A value ends at its closing quote, or where white space
or a separator with the next key begins. A value that costs at least ``MIN_COST`` decimal orders of magnitude
is taken for a secret; ``changeme123`` or ``xxxxxxxx`` is not. Words and names (letters without
digits, cased as words are) must cost ``PLAIN_COST``, and a reference such as ``${NAME}`` is no value.

Texts are scanned as UTF-8 bytes; spans count code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log10

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernlake.llm.chunks import slices

KINDS = ("assign", "access", "hex", "guess")
ASSIGN_LEAST = 12
MIN_COST, PLAIN_COST = 10.0, 22.0
#: Fewest bytes of a value in context that is weighed, and most at once; a longer value is weighed in stretches.
VALUE_LEAST, STRETCH = 8, 256
#: Words of the corpus that are ranked, the commonest first, and the lengths they may have.
RANKED, WORD_LEAST, WORD_MOST = 5000, 3, 20


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_KEY = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(rf"(?:{_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)".encode())
ACCESS = re.compile(rb"AKIA[A-Z0-9]{14,}")
HEX = re.compile(rb"[0-9a-f]{16,}")
# Words that name a credential.
CONTEXT_WORDS = ("password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "private_key", "client_secret", "credential", "credentials", "passwort", "contraseña", "auth")
CONTEXT = re.compile(
    rb"(?:" + b"|".join(_any_case(w).encode() if w.isascii() else re.escape(w.encode()) for w in sorted(CONTEXT_WORDS, key=len, reverse=True)) + rb")"
    rb"(?:[\"']?\s{0,3}(?::|=>|=)\s{0,3}([\"'`]?)|[\"']?\s{1,3}is\s{1,3}([\"'`]))(?=[!-~])"
)
# One of these is part of every credential word above and of every key of an assignment, in lower case.
STEMS = (b"pass", b"pwd", b"secret", b"token", b"api", b"_key", b"credential", b"contrase", b"auth")
# Letters cased as in words or names, and references to where a value is kept.
_WORD = r"(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[A-Z]{2,})"
PLAIN = re.compile(rf"{_WORD}(?:[-_./]{_WORD})*")
REFERENCE = re.compile(r"\$\{[^{}]*\}?|\$\([^()]*\)?|\{\{[^{}]*\}{0,2}|<[^<>]*>?|%\([^()]*\)?s?")
RUN = re.compile(rb"[!-~]*")
# A quote closes a value if no more of it can follow: before the end, a separator or a bracket.
CLOSES = {q: re.compile(rb"(?<!\\)" + q + rb"(?=$|[,;:&|)\]}>\s])") for q in (b'"', b"'", b"`")}
NEXT_KEY = re.compile(rb"[&,;|?][\"'`]?[A-Za-z_][\w.-]{0,63}[\"'`]?(?:=>|[:=])")
# Common words of passwords and placeholders, commonest first.
COMMON_WORDS = """password admin welcome login letmein monkey dragon master shadow sunshine princess football baseball
superman batman trustno hello freedom whatever secret summer winter spring autumn qazwsx iloveyou starwars flower
test user guest root default changeme change example sample dummy placeholder your here token key value string none null
true false unknown redacted removed hidden insert enter my the api access private public server database account name
pass word code pin love money god house computer internet company office work home""".split()
# Rows of a keyboard.
KEY_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4310$5!7", "aaeiossit")


def _neighbours() -> set[tuple[str, str]]:
    near = set()
    for r, row in enumerate(KEY_ROWS):
        for c, key in enumerate(row):
            for rr, cc in ((r, c + 1), (r + 1, c), (r + 1, c - 1)):
                if rr < len(KEY_ROWS) and 0 <= cc < len(KEY_ROWS[rr]):
                    near |= {(key, KEY_ROWS[rr][cc]), (KEY_ROWS[rr][cc], key)}
    return near


NEAR = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d")
_YEAR = re.compile(r"(?:19|20)\d\d")
#: Decimal orders of a date, a year, and of starting a repeat, a sequence and a walk.
DATE_COST, YEAR_COST, REPEAT_COST, RUN_COST, WALK_COST = log10(365.25 * 120), log10(120), 1.5, 1.7, 2.0
#: What telling a word, one in leetspeak and one in other case takes beside its rank.
WORD_COST, LEET_COST, CASE_COST = 0.3, 0.9, 0.5


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


class Guesser:
    """Guess costs with common words ranked first and ``words``, commonest first, after them."""

    def __init__(self, words: Iterable[str] = ()):
        self.cost_of: dict[str, float] = {}
        for word in (*COMMON_WORDS, *words):
            self.cost_of.setdefault(word, log10(len(self.cost_of) + 2))
        self.longest = max(map(len, self.cost_of))
        self.cost = lru_cache(4096)(self._cost)

    def _cost(self, value: str) -> float:
        """Decimal logarithm of the guesses that the cheapest segmentation of ``value`` needs."""
        n, low = len(value), value.lower()
        leet = low.translate(LEET)
        known = self.cost_of.get
        best = [0.0] + [float("inf")] * n
        brute = [log10(_class_size(c)) for c in value]
        same, run, walk = [1] * n, [1] * n, [1] * n  # lengths of the repeat, sequence and walk that end at each place
        for j in range(1, n):
            step = ord(low[j]) - ord(low[j - 1])
            same[j] = same[j - 1] + 1 if step == 0 else 1
            if abs(step) == 1 and low[j].isalnum() and low[j - 1].isalnum():
                run[j] = run[j - 1] + 1 if run[j - 1] > 1 and ord(low[j - 1]) - ord(low[j - 2]) == step else 2
            walk[j] = walk[j - 1] + 1 if (low[j - 1], low[j]) in NEAR else 1
        for j in range(1, n + 1):
            cost = best[j - 1] + brute[j - 1]
            for most, each in ((same[j - 1], REPEAT_COST), (run[j - 1], RUN_COST), (walk[j - 1], WALK_COST)):
                for length in range(3, most + 1):
                    cost = min(cost, best[j - length] + each + log10(length))
            if value[j - 1].isdigit():
                for length in (4, 8, 9, 10):
                    if length <= j and value[j - length].isdigit() and (_YEAR if length == 4 else _DATE).fullmatch(value, j - length, j):
                        cost = min(cost, best[j - length] + (YEAR_COST if length == 4 else DATE_COST))
            for i in range(max(0, j - self.longest), j - 1):
                told = known(low[i:j])
                swapped = known(leet[i:j])
                if told is None and swapped is None:
                    continue
                cased = 0.0 if value[i:j] == low[i:j] else CASE_COST
                if told is not None:
                    cost = min(cost, best[i] + told + WORD_COST + cased)
                if swapped is not None:
                    cost = min(cost, best[i] + swapped + LEET_COST + cased)
            best[j] = cost
        return best[n]

    def is_costly(self, value: str) -> bool:
        """Whether any stretch of the value costs what a secret does; stretches overlap by half."""
        if REFERENCE.fullmatch(value):
            return False
        least = PLAIN_COST if PLAIN.fullmatch(value) else MIN_COST
        return any(self.cost(value[i : i + STRETCH]) >= least for i in range(0, max(1, len(value) - STRETCH // 2), STRETCH // 2))


DEFAULT = Guesser()


def ranked_words(docs: DataFrame, text_col: str = "text", most: int = RANKED) -> list[str]:
    """The commonest words of all texts, counted where they stand between white space; ties go by the word.

    What follows ``:`` or ``=`` is not counted, so no assigned value makes itself common. Words are of the
    letters a to z, ``WORD_LEAST`` to ``WORD_MOST`` of them. At most ``most`` words reach the driver.
    """
    prose = F.regexp_replace(F.lower(text_col), r"[:=][\"'`\s]{0,4}\S+", " ")
    word = docs.select(F.explode(F.split(prose, r"[\s.,;!?\"'()]+")).alias("word")).filter(F.col("word").rlike(f"^[a-z]{{{WORD_LEAST},{WORD_MOST}}}$"))
    return [r["word"] for r in word.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(most).collect()]


def _next(pattern: re.Pattern, data: bytes, at: int, end: int, seen: dict) -> int:
    """Where ``pattern`` next begins, or ``end``; what was found for an earlier place is kept in ``seen``."""
    low, last, found = seen.get(pattern, (0, -1, -1))
    if last != end or not low <= at <= found:
        m = pattern.search(data, at, end)
        found = m.start() if m else end
        seen[pattern] = (at, end, found)
    return found


def find(data: bytes, guesser: Guesser = DEFAULT) -> list[tuple[int, int, int]]:
    """``(start, kind's place in KINDS, end)`` in bytes, in order; guesses may overlap base spans but none lies inside them.

    Separators may be part of a value: one that is not costly up to them is weighed as a whole if no base span touches it.
    """
    base = [(m.start(), 2, m.end()) for m in HEX.finditer(data)]
    if b"AKIA" in data:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data)]
    lowered = data.lower()
    if not any(stem in lowered for stem in STEMS):
        return sorted(base)
    base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    base.sort()
    starts, ends = _union(base)

    def trimmed(low: int, high: int) -> int:
        return low + len(data[low:high].rstrip(b"\"'`,;.)]}>"))

    def inside(low: int, high: int) -> bool:
        at = bisect_right(starts, low) - 1
        return at >= 0 and ends[at] >= high

    def touched(low: int, high: int) -> bool:
        at = bisect_left(starts, high) - 1
        return at >= 0 and ends[at] > low

    def costly(low: int, high: int) -> bool:
        return high - low >= VALUE_LEAST and not inside(low, high) and guesser.is_costly(data[low:high].decode("ascii"))

    more, at, end, cheap, seen = [], 0, 0, -1, {}
    while m := CONTEXT.search(data, at):
        a, quote = m.end(), m[1] or m[2]
        if a >= end:
            end = RUN.match(data, a).end()
        closing = _next(CLOSES[quote], data, a, end, seen) if quote else end
        b = closing if closing < end else trimmed(a, _next(NEXT_KEY, data, a, end, seen))
        whole = trimmed(a, end) if closing == end and cheap != end else b
        at = a  # a short value may itself be a key
        if costly(a, b):
            more.append((a, 3, b))
            at = b
        elif whole > b and not touched(a, whole):
            if costly(a, whole):
                more.append((a, 3, whole))
                at = whole
            else:
                cheap = end
        elif b - a >= VALUE_LEAST:
            at = b
    return sorted(base + more)


def _union(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, which are in order, cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for low, _, high in spans:
        if ends and low <= ends[-1]:
            ends[-1] = max(ends[-1], high)
        else:
            starts.append(low)
            ends.append(high)
    return starts, ends


def code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    lead = np.zeros(len(data) + 1, np.int64)
    lead[1:] = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    return [(int(lead[a]), k, int(lead[b])) for a, k, b in spans]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, guesser: Guesser = DEFAULT, mark: str = "[secret]") -> str:
    """The text with every found span replaced; overlapping spans are replaced as one."""
    data = text.encode("utf-8", "surrogatepass")
    out, at = [], 0
    for a, _, b in find(data, guesser):
        if a >= at:
            out += [data[at:a], mark.encode()]
        at = max(at, b)
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass") if at else text


def redactor(spark: SparkSession, words: list[str]):
    """A column function that redacts texts, guesses ranked by ``words``; null stays null."""
    sent = spark.sparkContext.broadcast(words)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        guesser = Guesser(sent.value)
        for texts in batches:
            parts = [pa.array([None if t is None else redact(t, guesser) for t in part.to_pylist()], pa.string()) for part in slices(texts, 500)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base string, spans string"


def scan(docs: DataFrame, words: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: counts by kind and the spans, ``kind:start:end`` joined by commas.

    Guesses are ranked by ``words``, else by those of the texts themselves. Null texts count as empty; null
    ids and repeated rows stay; other columns are ignored. Scanning is narrow; only word counts are exchanged.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranked_words(docs, text_col) if words is None else words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        guesser = Guesser(sent.value)
        for batch in batches:
            rows = []
            for text in batch["t"]:
                data = (text or "").encode("utf-8", "surrogatepass")
                spans = code_points(data, find(data, guesser))
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), written([s for s in spans if s[1] < 3]), written(spans)))
            got = pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_guess", "base", "spans"])
            got.insert(0, "doc_id", batch["k"].to_numpy())
            yield got

    return docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInPandas(run, SPANS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fernlake.runtime import table

    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
