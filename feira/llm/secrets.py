"""Secret scans with password guess costs.

Three base patterns (credential assignments, access keys, long hexadecimal runs)
are found in the whole text. Beyond them, any value in a credential context
("SMTP_PASS=...", "pwd: ...", "passphrase is ...", "bearer ...") is scored by the
number of guesses it takes: a dynamic program cuts it into words, dates, repeats,
keyboard walks and brute-force characters at minimum cost, and values of a cost
above a threshold are secrets too.

Words and their costs are the corpus' own: a word found in n documents takes
N / n guesses, N being the sum over all words. They are counted over all documents,
outside the values themselves (a secret is no word because it is repeated); only
a value of letters alone after "is" counts, as prose looks the same. So such a value
is a secret only if it is rare as a word. No word is left out: of the words of the
corpus, those that stand in some value are joined to it.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, with_columns

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_KEYS = ("passw", "secret", "token", "api")
#: Other words that announce a credential, alone or as a part of an identifier
#: (SMTP_PASS, userPassphrase, secret_key_base), and what may stand between them and it.
_CONTEXT = re.compile(
    r"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))(?i:passphrase|passcode|password|passwd|pwd|pass|credential|secret|token|bearer|api[\x20_-]?key|access[\x20_-]?key|private[\x20_-]?key|auth)"
    r"(?:(?:s|[_-][A-Za-z0-9_-]{0,32}|(?<=[a-z])[A-Z][A-Za-z0-9_-]{0,32})?[\"']?\s{0,4}(?::=|=>|->|[:=])\s{0,4}|s?(?:(?P<prose>\s{1,4}is:?\s{1,4})|\s(?=\S*\d)))"
    r"[\"']?(?P<value>[^\s\"',;<>(){}]{6,})", re.A)
_CONTEXT_KEYS = ("pass", "pwd", "credential", "secret", "token", "bearer", "key", "auth")
_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
#: Lengths of words, in characters.
SHORT, LONG = 3, 24

#: Common password words, commonest first.
COMMON = (
    "password", "123456", "qwerty", "admin", "letmein", "welcome", "monkey", "dragon", "master", "login", "abc123", "iloveyou",
    "football", "baseball", "shadow", "superman", "michael", "sunshine", "princess", "secret", "token", "example", "changeme",
    "default", "test", "user", "root", "guest", "pass", "hello", "summer", "winter", "spring", "autumn", "love", "your", "here",
    "none", "null", "true", "false", "value", "string", "key", "api", "the", "and", "company", "server", "database", "system",
)
_RANK = {w: i + 1 for i, w in enumerate(COMMON)}
_LEET = str.maketrans("@4301$57", "aaeoisst")
#: Rows of a keyboard.
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz")
_NEXT = {(a, b) for row in _ROWS for a, b in zip(row, row[1:])} | {(b, a) for row in _ROWS for a, b in zip(row, row[1:])}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:(?:19|20)\d\d|\d\d)")
#: What one more segment costs a guesser, in powers of ten.
_SEGMENT = 0.5


def _brute(value: str) -> float:
    """Power of ten of the guesses for one character, by the kinds that occur."""
    n = 10 * bool(re.search(r"[0-9]", value)) + 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 33 * bool(re.search(r"[^0-9A-Za-z]", value))
    if re.fullmatch(r"[0-9a-f]+", value):
        n = 16
    return math.log10(max(n, 10))


def _forms(value: str) -> tuple[str, str]:
    """The value in small letters, and with letters for the signs in their place."""
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    return low, low.translate(_LEET)


#: Characters of a value whose inner words leave in one batch.
PIECE = 2048


def inner_words(value: str) -> Iterator[set[str]]:
    """The stretches of letters in a value that may be words, in both forms: a set for
    those that begin in each PIECE characters, so a long value is never held as words."""
    forms = _forms(value)
    for start in range(0, len(value), PIECE):
        out = set()
        for form in forms:
            for i in range(start, min(len(form), start + PIECE)):
                j = i
                while j < min(len(form), i + LONG) and form[j].isalpha():
                    j += 1
                    if j - i >= SHORT:
                        out.add(form[i:j])
        yield out


def _words_to(value: str, forms: tuple[str, str], words: dict[str, float], j: int) -> Iterator[tuple[int, float]]:
    """(start, cost) of the words in a value that end at j."""
    for i in range(max(0, j - LONG), j - SHORT + 1):
        for form, extra in zip(forms, (0.0, 0.3)):
            w = form[i:j]
            cost = min(words.get(w, math.inf), math.log10(_RANK[w] + 1) if w in _RANK else math.inf)
            if cost < math.inf:
                yield i, cost + extra + (0.0 if value[i:j] == forms[0][i:j] else 0.3)
                break


def _segments(value: str, words: dict[str, float]) -> Iterator[tuple[int, int, float]]:
    """(start, end, cost) of all patterns in a value."""
    forms = _forms(value)
    for j in range(SHORT, len(value) + 1):
        for i, cost in _words_to(value, forms, words, j):
            yield i, j, cost
    yield from _patterns(value)


def _patterns(value: str) -> list[tuple[int, int, float]]:
    """(start, end, cost) of dates, repeats of one to four characters, and keyboard walks."""
    out, n, low = [], len(value), _forms(value)[0]
    for i in range(n):
        m = _DATE.match(value, i)
        if m:
            out.append((i, m.end(), math.log10(365 * 60 if m.end() - i > 4 else 120)))
    for unit in range(1, 5):
        i = 0
        while i + 2 * unit <= n:
            j = i + unit
            while j < n and value[j] == value[j - unit]:
                j += 1
            if j - i >= max(3, 2 * unit):
                out.append((i, j, unit * _brute(value[i:i + unit]) + math.log10((j - i) / unit)))
                i = j - unit + 1
            else:
                i += 1
    i = 0
    while i < n - 1:
        j, turns, step = i + 1, 0, None
        while j < n and (low[j - 1], low[j]) in _NEXT:
            way = ord(low[j]) > ord(low[j - 1])
            turns += step is not None and way != step
            step, j = way, j + 1
        if j - i >= 3:
            out.append((i, j, math.log10(50 * (j - i)) + turns * 0.6))
        i = max(j - 1, i + 1)
    return out


def guess_cost(value: str, words: dict[str, float] = {}) -> float:
    """Power of ten of the guesses of the cheapest way to build the value, with the
    costs of words beside the common ones. Time and memory grow with the length (some
    200 bytes a character; words are looked up as the cost moves on, not held); a
    brute-force span is paid by the character."""
    n, per, forms = len(value), _brute(value), _forms(value)
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in _patterns(value):
        ends.setdefault(j, []).append((i, cost))
    # the cheapest way to the first j characters that ends in brute force, and at all
    brute, best = [math.inf] * (n + 1), [0.0] + [math.inf] * n
    for j in range(1, n + 1):
        brute[j] = min(brute[j - 1], best[j - 1] + _SEGMENT) + per
        best[j] = min([brute[j], *(best[i] + cost + _SEGMENT for i, cost in ends.get(j, ())), *(best[i] + cost + _SEGMENT for i, cost in _words_to(value, forms, words, j))])
    return best[n]


Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Spans (start, end, kind) of the base patterns in code points, by start, then kind."""
    spans, low = [], text.lower()
    if any(k in low for k in _KEYS):
        spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end() - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, base: list[Span]) -> list[Span]:
    """(start, end, value) of credential values that no base span covers in part."""
    low, out = text.lower(), []
    if any(k in low for k in _CONTEXT_KEYS):
        starts, upto = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
        for m in _CONTEXT.finditer(text):
            value = m["value"].rstrip(".!?:")
            a = m.start("value")
            before = bisect_left(starts, a + len(value))  # base spans that begin before its end
            if len(value) >= 6 and not (before and upto[before - 1] > a):
                out.append((a, a + len(value), value))
    return out


def words_of(text: str) -> set[str]:
    """Distinct words of a text in small letters, outside of credential values."""
    low = text.lower()
    if any(k in low for k in _CONTEXT_KEYS):
        parts, at = [], 0
        for m in _CONTEXT.finditer(text):
            if not (m["prose"] and m["value"].rstrip(".!?:").isalpha()):
                parts.append(text[at:m.start("value")])
                at = m.end("value")
        low = " ".join([*parts, text[at:]]).lower() if parts else low
    return {w for w in low.encode().translate(_LETTERS).decode().split() if SHORT <= len(w) <= LONG}


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


_ROW = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
_VALUES = "array<struct<a: long, b: long, value: string>>"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("value", pa.string())]))]
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            s = text.as_py() or ""
            base = base_spans(s)
            kinds, joined = [k for _, _, k in base], _joined(base)
            found = [{"a": a, "b": b, "value": v} for a, b, v in candidates(s, base)]
            rows.append((*map(kinds.count, KINDS[:3]), hashlib.sha256(joined.encode()).hexdigest(), joined, found))
        cols = list(zip(*rows)) if rows else [[]] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types))],
                                         ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "found"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(w, n): documents of a batch with the word; the empty word stands for all."""
    for batch in batches:
        counts: Counter = Counter()
        for text in batch.column("text"):
            counts.update(words_of(text.as_py() or ""))
        counts[""] = counts.total()
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, value in zip(batch.column("k").to_pylist(), batch.column("value").to_pylist()):
            for words in inner_words(value):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.string()), pa.array(list(words), pa.string())], ["k", "w"])


def value_costs(values: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct values (k: their digest, value) -> k, cost, with the words of all docs.
    Words travel with the digest, not the value; a value's row holds the distinct words
    of the corpus that occur in it."""
    inner = materialize(values.mapInArrow(_inner, "k string, w string"), "inner-words")
    spark = values.sparkSession
    wanted = inner.select("w").unionByName(spark.createDataFrame([("",)], "w string")).distinct()
    words = docs.select("text").mapInArrow(_count, "w string, n long").join(wanted, "w", "left_semi")
    words = materialize(words.groupBy("w").agg(F.sum("n").alias("n")), "words")
    total = words.filter("w = ''").select(F.col("n").alias("all_n"))
    own = (inner.join(words, "w").crossJoin(F.broadcast(total))  # one row
           .groupBy("k").agg(F.collect_set(F.struct("w", F.log10(F.col("all_n") / F.col("n")).alias("cost"))).alias("words")))

    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [guess_cost(v, {w["w"]: w["cost"] for w in ws or ()}) for v, ws in zip(batch.column("value").to_pylist(), batch.column("words").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.float64())], ["k", "cost"])

    return values.join(own, "k", "left").select("k", "value", "words").mapInArrow(cost, "k string, cost double")


def find_secrets(docs: DataFrame, least: float = 9.0, salts: int = 8) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_guess, guess_log10 (the largest cost of its guess spans, 0 if none).

    A guess span is a credential value of cost `least` (a power of ten) or more that
    no base span covers. A null text counts as empty. Repeated and null ids pass
    through, extra columns are ignored, an empty table gives no rows. Texts of any
    length are scanned whole; spans of different kinds may overlap, except that a
    guess span never overlaps a base span. A value that many documents share is
    scored once; its rows are dealt to `salts` parts to meet its cost.
    """
    d = with_columns(docs, {"doc_id": "long", "text": "string"})
    rows = d.mapInArrow(_scan, f"{_ROW}, found {_VALUES}").withColumn("row", F.monotonically_increasing_id())
    rows = materialize(rows, "scanned")
    names = [x.split()[0] for x in _ROW.split(", ")]
    found = rows.filter("size(found) > 0").select("row", F.explode("found").alias("x")).select("row", "x.*", F.sha2("x.value", 256).alias("k"))
    costs = value_costs(materialize(found.select("k", "value").dropDuplicates(["k"]), "values"), d).filter(F.col("cost") >= least)
    costs = materialize(costs, "costly").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    guess = (found.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int")).drop("value").join(costs, ["k", "salt"])
             .groupBy("row").agg(F.collect_list(F.struct("a", "b")).alias("guess"), F.max("cost").alias("guess_log10")))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for base, guesses in zip(batch.column("spans").to_pylist(), batch.column("guess").to_pylist()):
                spans = [(int(a), int(b), k) for k, a, b in (x.split(":") for x in base.split(",") if x)]
                spans += [(g["a"], g["b"], "guess") for g in guesses or ()]
                out.append(_joined(sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))))
            kept = [batch.column(c) for c in (*names[:-1], "n_guess", "guess_log10")]
            yield pa.RecordBatch.from_arrays([*kept[:len(names) - 1], pa.array(out, pa.string()), *kept[len(names) - 1:]], [*names, "n_guess", "guess_log10"])

    with_values = (rows.filter("size(found) > 0").join(guess, "row", "left")
                   .select(*names, "guess", F.greatest(F.size("guess"), F.lit(0)).cast("long").alias("n_guess"), F.coalesce("guess_log10", F.lit(0.0)).alias("guess_log10"))
                   .mapInArrow(merge, f"{_ROW}, n_guess long, guess_log10 double"))
    without = rows.filter("size(found) = 0").select(*names, F.lit(0).cast("long").alias("n_guess"), F.lit(0.0).alias("guess_log10"))
    return without.unionByName(with_values)
