"""Secret scan: fixed patterns, and values in credential contexts by their guess cost.

Three patterns find the base spans. Beyond them, a value that stands in a credential
context is segmented into words, dates, repeats, sequences, keyboard walks and
brute-force spans so that the total number of guesses is least (a dynamic program over
its positions); a mark that joins two parts costs little once it was used. Words have their rank in a frequency list: English (``word_list``), and the
most frequent words of the corpus outside credential contexts (``learn_words``), so that
prose in any language is cheap. Brute force tries all character classes of the value at each place. A value that would cost at least ``min_log2`` bits is a span of kind
``guess`` unless base spans cover it entirely; it may overlap them.

Ordinary values are told from secrets by their form. A mail address is none. Of links, file
paths and code (names with brackets, placeholders) only the parts count that mix letters with
digits or cases within. Parts joined by marks are a sentence, and no secret, if two of them are
function words. Letters of scripts without case cost nothing; other letters beyond ASCII count
in values that hold a digit or a symbol too. Pass phrases are four words or more without
function words, quoted or up to the end of their line. Other values end at the first blank.

Null and empty texts have no spans; bytes that are no UTF-8 count, and are written, as U+FFFD. Every row is scanned by itself, so repeated rows get
equal results and columns beyond the two that are read don't matter. Runs, walks and repeated
blocks count at their full length, each found once, so time is linear in a value's length.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few_files, slices, stage, table, texts, unstage
from .word_list import WORDS

# The base patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_VALUE = 6
KINDS = ("assign", "access", "hex", "guess")

#: A credential word, a separator, and the value that is judged: no blanks, letters of any script.
CREDENTIAL = r"(?i:pass(?:word|wd|[ _-]?phrase|code)?|pwd|secret|token|credentials?|authorization|auth|bearer|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|login|pin|(?:seed|recovery)[ _-]phrase|mnemonic)"
VALUE = r"""["']?(?:(?i:bearer|basic|token)\x20)?([^\x00-\x20\x7f\u0085\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000]{8,})"""
#: Separators are rare, so contexts are found from them: what stands before one, its rest and the value after it.
SEPARATOR = re.compile(r"[:=]|is\b")
BEFORE = re.compile(CREDENTIAL + r"""["']?\s{0,3}\Z""")
AFTER = re.compile(r">?\s{0,3}" + VALUE)
#: Characters before a separator that hold a credential word, a quote and three blanks.
REACH = 24
#: The same values for Spark's regular expressions, found from their separators, which are rare.
VALUES = r"(?:[:=]|\bis\b)(?<=" + CREDENTIAL + r"""["']?\s{0,3}(?::|=|is))>?\s{0,3}""" + VALUE
_PHRASE = r"[a-zß-öø-ÿ]++(?:\x20[a-zß-öø-ÿ]++){3,23}"
PHRASE = re.compile(rf"""\x20{{0,3}}(?:(["'])({_PHRASE})\1|({_PHRASE})(?=[.,;]?(?:[\r\n]|\Z)))""")
#: Words of sentences, and words that speak of secrets rather than being one.
FUNCTION_WORDS = frozenset(
    (
        "a all also an and any are as at be been but by can do does for from has have here how if in into is it its "
        "may must my no not of on or our see should so than that the their them then there these they this to was we "
        "were what when where which who will with you your "
        "least minimum maximum required characters letters digits please enter choose forgot reset invalid "
        "incorrect wrong changed expired confirm missing optional password token secret"
    ).split()
)
#: Ends of host names of mail addresses.
MAIL = re.compile(r"(?:mailto:)?[\w.+-]+@(?:[a-z0-9-]+\.)+(?:com|org|net|edu|gov|info|io|dev|eu|[a-z]{2})", re.I)
#: Links; paths; calls and lookups of names; placeholders.
FORM = re.compile(r"(?i:[a-z][a-z0-9+.-]{1,15}://|www\.)|(?:[A-Za-z]:[\\/]|~?/|\.{1,2}[\\/]|\\\\)[\w./\\@,+-]*\Z|[A-Za-z_$][\w$]*(?:(?:\.|::|->)[A-Za-z_$][\w$]*)*[(\[]|[$<{%]+[A-Za-z_][\w. -]*[}>%]")
#: A mark between two parts; a short number between marks.
JOINT = re.compile(r"(?<=[^\W_])[-_./:\x20](?=[^\W_])")
NUMBER = re.compile(r"(?<![^\W_])\d{1,4}(?![^\W_])")
#: Frequent parts of chosen passwords, most frequent first, before WORDS: a word's rank is its guess count.
COMMON = (
    "password pass admin login welcome master secret qwerty letmein dragon monkey shadow sunshine princess football "
    "baseball superman batman michael jordan hunter summer winter spring autumn monday friday sunday love hello test "
    "user root guest default change changeme account office company server system money star angel flower cookie "
    "cheese coffee orange purple yellow silver golden tiger eagle lion the and for you this that with from have not"
).split()
KEYBOARD = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
#: Characters by which a repeated block is found.
SEED = 4
#: Words learned from a corpus: at most so many, of so many occurrences at least, of 3 to 20 letters; all of a count or none.
VOCABULARY, LEAST_SEEN = 20_000, 5
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
MIN_LOG2 = 40.0

_RANK = {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *WORDS]))}
#: Letters of the longest word that is looked up.
LONGEST_WORD = max(map(len, _RANK))
_NEIGHBOURS = {frozenset(p) for row in KEYBOARD for p in zip(row, row[1:], strict=False)}
_UNLEET = str.maketrans("01345$@7", "oleassat")


def _alphabet(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isalpha() else 33


def _charset(value: str) -> int:
    """Characters of all classes that a value has: what brute force tries at each place; 64 letters beyond ASCII."""
    ascii_only = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    return max(ascii_only, 1) + 64 * any(c > "\x7f" and c.lower() != c.upper() for c in value)


def _uncased(c: str) -> bool:
    """A letter of a script without case, or a sign that belongs to a letter."""
    return c > "\x7f" and unicodedata.category(c) in ("Lo", "Lm", "Mn", "Mc", "Me")


def ranks(learned: list[str]) -> dict[str, int]:
    """Ranks of the shipped words and of those learned, most frequent first; the better one of a word in both."""
    out = dict(_RANK)
    for i, w in enumerate(learned, len(COMMON) + 1):
        out[w] = min(i, out.get(w, i))
    return out


def _pieces(value: str, rank_of: dict[str, int] | None = None) -> list[list[tuple[int, float]]]:
    """For each end position, the (start, log2 guesses) of the structured pieces that end there."""
    n, rank_of = len(value), rank_of or _RANK
    low, ends = value.lower(), [[] for _ in range(n + 1)]
    if len(low) != n:  # a few letters become two
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_UNLEET)
    for i in range(n):
        for k in range(2, min(LONGEST_WORD, n - i) + 1):
            if rank := rank_of.get(plain[i : i + k]):
                part = value[i : i + k]
                twist = (part[0].isupper()) + 2 * (not part.islower() and not part[:1].isupper()) + (low[i : i + k] != plain[i : i + k])
                ends[i + k].append((i, math.log2(rank + 1) + twist))
    for m in DATE.finditer(value):
        ends[m.end()].append((m.start(), math.log2(365 * 120) if m.end() - m.start() > 4 else math.log2(120)))
    used: set[str] = set()
    for m in JOINT.finditer(value):
        ends[m.end()].append((m.start(), 1.0 if m[0] in used else math.log2(33)))
        used.add(m[0])
    for m in NUMBER.finditer(value):
        ends[m.end()].append((m.start(), math.log2(10) * len(m[0])))
    for step, cost in (("repeat", 1.0), ("up", 2.0), ("down", 2.0), ("walk", 4.0)):
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and _follows(low[j - 1], low[j], step):
                j += 1
            if j - i >= 3:
                ends[j].append((i, cost + math.log2(_alphabet(value[i])) + math.log2(j - i)))
            i = max(j - 1, i + 1)
    for k in range(2, SEED):  # short blocks that are repeated at once cost their first copy, known by then
        i = 0
        while i + 2 * k <= n:
            j = i + k
            while j < n and value[j] == value[j - k]:
                j += 1
            if j >= i + 2 * k:
                ends[j].append((i + k, 2.0 + math.log2(j - i - k)))
            i = max(j - k, i) + 1
    last: dict[str, int] = {}
    i, known = 0, 0
    while i + SEED <= n:  # longer ones, wherever their first copy stands
        at = last.get(value[i : i + SEED], -1)
        j = i
        if at >= 0:
            while j < n and value[j] == value[at + j - i]:
                j += 1
            ends[j].append((i, 2.0 + math.log2(i) + math.log2(j - i)))
        after = max(i + 1, j - SEED + 1)
        for known in range(max(known, i), min(after, n - SEED + 1)):
            last[value[known : known + SEED]] = known
        i = after
    return ends


def _follows(a: str, b: str, step: str) -> bool:
    if step == "repeat":
        return a == b
    if step == "walk":
        return a != b and frozenset((a, b)) in _NEIGHBOURS
    return a.isalnum() and b.isalnum() and ord(b) - ord(a) == (1 if step == "up" else -1)


def guess_cost(value: str, charset: int | None = None, rank_of: dict[str, int] | None = None) -> float:
    """Least log2 of the guesses for a value, over all its segmentations.

    A brute-force character costs its own class, or charset where that is given; letters of
    scripts without case cost nothing.
    """
    n = len(value)
    pieces = _pieces(value, rank_of)
    best = [0.0] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1] + (0.0 if _uncased(value[j - 1]) else math.log2(charset or _alphabet(value[j - 1])))
        for i, cost in pieces[j]:
            best[j] = min(best[j], best[i] + cost)
    return best[n]


def _parts(value: str) -> list[str]:
    return [p for p in re.split(r"[\W_]+", value) if p]


def _plain(part: str) -> bool:
    """A part of digits alone, or of letters that differ in case at most by their first."""
    return part.isdigit() or (part.isalpha() and (part.isupper() or part[1:] == part[1:].lower()))


def _sentence(value: str) -> bool:
    parts = _parts(value)
    return sum(p.lower() in FUNCTION_WORDS for p in parts) >= 2 and all(_plain(p) and not (p.isdigit() and len(p) > 4) for p in parts)


def value_cost(value: str, rank_of: dict[str, int] | None = None) -> float:
    """Least log2 of the guesses for a value in a credential context; 0 for ordinary ones, by their form."""
    if MAIL.fullmatch(value) or _sentence(value):
        return 0.0
    if FORM.match(value):
        return sum(guess_cost(p, _charset(p), rank_of) for p in _parts(value) if not _plain(p))
    if not value.isascii() and not any(c.isdigit() or c in "!#$%&*+=?@^|~<>" for c in value):
        return 0.0
    return guess_cost(value, _charset(value), rank_of)


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether the union of spans, sorted by start, holds start to end."""
    for s, e, _ in spans:
        if s > start:
            break
        start = max(start, e)
    return start >= end


def find_spans(text: str | None, min_log2: float = MIN_LOG2, rank_of: dict[str, int] | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind's place in KINDS) of one text, by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    base = sorted(found)
    at = said = 0  # ends of the last value and the last phrase: neither overlap their own kind
    for m in SEPARATOR.finditer(text):
        if m[0] == "is" and m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        if not BEFORE.search(text, max(said, m.start() - REACH), m.start()):
            continue
        if m[0] != "is" and (p := PHRASE.match(text, m.end())):
            start, end = p.span(2) if p[2] else p.span(3)
            phrase = text[start:end]
            if not FUNCTION_WORDS.intersection(phrase.split(" ")) and guess_cost(phrase, 26, rank_of) >= min_log2:
                found.append((start, end, 3))
                said = at = p.end()
                continue
        if m.start() < at or not BEFORE.search(text, max(at, m.start() - REACH), m.start()):
            continue
        if not (v := AFTER.match(text, m.end())):
            continue
        start, at = v.span(1)
        value = v[1]
        if (quote := text[start - 1]) in "\"'":  # a quoted value ends with its quote
            value = value.partition(quote)[0]
        value = value.rstrip("\"',;.)»”’。，；）")
        end = start + len(value)
        if len(value) >= 8 and not _covered(start, end, base) and value_cost(value, rank_of) >= min_log2:
            found.append((start, end, 3))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def learn_words(docs: DataFrame, text: str = "text", most: int = VOCABULARY) -> list[str]:
    """The most frequent words of all texts, without the values in credential contexts; of one count by code point.

    All words are counted, with partial sums. The least count is the one from which there are
    at most ``most`` words, so only these reach the driver.
    """
    words = F.split(F.lower(F.regexp_replace(text, VALUES, " ")), r"[^\p{L}]+")
    counts = docs.select(F.explode(words).alias("word")).where(F.length("word").between(3, 20)).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.where(F.col("n") >= LEAST_SEEN), "secret-words")
    least = room = None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.col("n").desc()).limit(most).collect():
        room = (most if room is None else room) - r.words
        if room < 0:
            break
        least = r.n
    found = [] if least is None else counts.where(F.col("n") >= least).collect()
    unstage(counts)
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))]


def _shared_ranks(docs: DataFrame, words: list[str] | None):
    """The ranks for the executors: the shipped list and VOCABULARY learned words at most."""
    return docs.sparkSession.sparkContext.broadcast(ranks(words or []))


def assign_bits(text: str | None, spans: list[tuple[int, int, int]], rank_of: dict[str, int]) -> str:
    """Guess costs of the values of assign spans in whole bits, in order: low ones are words or patterns."""
    found = (ASSIGN.match(text, s) for s, _, k in spans if k == 0)
    return ",".join(str(round(guess_cost(m[2], _charset(m[2]), rank_of))) for m in found)


def scan_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", min_log2: float = MIN_LOG2, words: list[str] | None = None) -> DataFrame:
    """One row per document: counts, the base spans' digest, all spans and the bits of assigned values.

    ``words`` are learned words, most frequent first.
    """
    shared = _shared_ranks(docs, words)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            own = texts(part.column(1))
            rows = [find_spans(x, min_log2, shared.value) for x in own]
            base = [_joined([s for s in r if s[2] < 3]) for r in rows]
            yield pa.RecordBatch.from_pydict(
                {
                    key: part.column(0),
                    **{f"n_{KINDS[k]}": pa.array([sum(s[2] == k for s in r) for r in rows], pa.int64()) for k in range(3)},
                    "base_sha256": pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base], pa.string()),
                    "spans": pa.array([_joined(r) for r in rows], pa.string()),
                    "n_guess": pa.array([sum(s[2] == 3 for s in r) for r in rows], pa.int64()),
                    "assign_bits": pa.array([assign_bits(x, r, shared.value) for x, r in zip(own, rows, strict=True)], pa.string()),
                }
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, assign_bits string")


def redact_secrets(docs: DataFrame, text: str = "text", count: str = "n_chars", mark: str = "[SECRET]", min_log2: float = MIN_LOG2, words: list[str] | None = None) -> DataFrame:
    """The same rows and columns, each text with its spans replaced; overlapping spans become one mark.

    A column ``count``, if there is one, changes by as much as the text's length does.
    """

    shared = _shared_ranks(docs, words)

    def clean(x: str | None) -> str | None:
        spans = find_spans(x, min_log2, shared.value)
        if not spans:
            return x
        out, at = [], 0
        for s, e, _ in spans:
            if s >= at:
                out += [x[at:s], mark]
            at = max(at, e)
        return "".join([*out, x[at:]])

    place = docs.columns.index(text)
    counted = docs.columns.index(count) if count in docs.columns else -1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (x for whole in parts for x in slices(whole)):
            old = texts(part.column(place))
            new = [clean(x) for x in old]
            cols = list(part.columns)
            cols[place] = pa.array(new, pa.string())
            if counted >= 0:
                sizes = zip(part.column(counted).to_pylist(), old, new, strict=True)
                cols[counted] = pa.array([n if n is None or a is b else n + len(b) - len(a) for n, a, b in sizes], cols[counted].type)
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return few_files(scan_secrets(docs, words=learn_words(docs)))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can express of the scan: the numbers of base spans."""
    return scan_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


QUERIES = {"op10_secret_scan": op10_secret_scan, "secret_counts": secret_counts}

_WORDS = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ORACLE_SQL = {
    "secret_counts": rf"""
SELECT doc_id,
  CAST(coalesce(len(list_filter(regexp_extract_all(text, '({_WORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: len(x) >= 6)), 0) AS BIGINT) AS n_assign,
  CAST(coalesce(len(regexp_extract_all(text, 'AKIA[A-Z0-9]{{16,}}')), 0) AS BIGINT) AS n_access,
  CAST(coalesce(len(regexp_extract_all(text, '[0-9a-f]{{24,}}')), 0) AS BIGINT) AS n_hex
FROM documents
"""
}
