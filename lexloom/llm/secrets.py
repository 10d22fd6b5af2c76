"""Operator 7: secrets in texts, by fixed patterns and by the cost of guessing values in credential contexts.

Base patterns (assign, access, hex) give spans as they are. Beside them, every value that stands where
credentials stand ("pwd: x", "token = x", "secret is x", "Authorization: Bearer x", "login with x") is costed
by dynamic programming over its characters: the cheapest way, in bits, to cut it into dictionary words, dates,
repeats, keyboard walks, sequences and brute-force spans. The cost alone decides: values of at least
``min_bits`` are kind "guess", or ``prose_bits`` where only a blank parts them from the credential word, as
prose follows such words too. Values are costed whole, however long, those of base spans included.

The dictionary holds common parts of passwords, then (where a rank file of a public vocabulary is given) its
words, by rank: bounded by the vocabulary, loaded once a worker.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from .byte_bpe import read_ranks
from .common import only, table

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as long as AKIA[A-Z0-9]+ of 16 or more: runs are taken whole
HEX = re.compile(r"[0-9a-f]{32,}")
#: A text without any of these (lower-cased) has no assign match, or no value to cost.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CONTEXT_WORDS = (*ASSIGN_WORDS, "pwd", "pass", "cred", "auth", "bearer", "login", "private_key", "access_key", "signing", "session")
CONTEXT = re.compile(r"""(?:pwd|secret|token|api_?key|pass(?:word|wd|phrase|code|key)?|credentials?|auth(?:orization|_token)?|bearer|login|private_key|access_key|signing_key|session_(?:id|key))["']?(\x20*[:=]+\x20*|\x20+(?:is|with)\x20+|\x20+)(?:bearer\x20+)?["']?""", re.ASCII | re.IGNORECASE)
RUN = re.compile(r"[\x21\x23-\x26\x28-\x7e]*")
MIN_BITS, PROSE_BITS = 40.0, 64.0

#: Common parts of chosen passwords, by rank.
COMMON = ("password", "pass", "admin", "welcome", "letmein", "login", "master", "secret", "dragon", "monkey", "qwerty", "shadow", "sunshine", "princess", "football", "baseball", "superman", "batman", "trustno", "hello", "freedom", "whatever", "summer", "winter", "spring", "autumn", "love", "test", "user", "root", "default", "changeme", "guest", "example", "token", "key", "api", "the", "and", "for", "you", "abc", "access", "server", "data", "home", "work", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
WORD = re.compile("[a-z]{4,20}").fullmatch
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301!$57", "aaeoiisst")
DATE = re.compile(r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_BITS = math.log2(365 * 120)
#: Bits of starting one more segment: a guesser must choose its kind.
SWITCH_BITS = 2.0


@lru_cache(maxsize=1)
def neighbours() -> set[str]:
    """Pairs of characters next to each other on a keyboard row or straight below one another."""
    out = set()
    for row in ROWS:
        out |= {a + b for a, b in zip(row, row[1:])} | {b + a for a, b in zip(row, row[1:])}
    for up, down in zip(ROWS, ROWS[1:]):
        out |= {a + b for a, b in zip(up.lstrip("`"), down)} | {b + a for a, b in zip(up.lstrip("`"), down)}
    return out


def alphabet_bits(value: str) -> float:
    """Bits of one brute-force character: the size of the classes that the value draws on."""
    n = 26 * any(c.islower() for c in value) + 26 * any(c.isupper() for c in value) + 10 * any(c.isdigit() for c in value) + 33 * any(not c.isalnum() for c in value)
    return math.log2(max(n, 2))


@lru_cache(maxsize=4)
def dictionary(path: str | None) -> tuple[dict[str, int], int]:
    """Ranks of words, and the length of the longest: common parts of passwords first, then the words of a rank file."""
    rank = {w: r for r, w in enumerate(COMMON, 1)}
    if path:
        for raw in sorted(ranks := read_ranks(path), key=ranks.__getitem__):
            word = raw.decode("utf-8", "replace").strip().lower()
            if WORD(word):
                rank.setdefault(word, len(rank) + 1)
    return rank, max(map(len, rank))


def periodic(low: str, p: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the longest span from each start on that repeats a block of p characters at least twice."""
    same = 0
    for i in range(len(low) - p - 1, -1, -1):
        same = same + 1 if low[i] == low[i + p] else 0
        if same >= p:
            yield i, i + same + p


def guess_bits(value: str, words: str | None = None) -> float:
    """The least bits over all segmentations: best[j] = min over i of best[i] + bits of value[i:j].

    Words are bounded in length by the dictionary; of repeated blocks (up to eight characters) the longest span
    from a start counts. Of a run (one character, walk, sequence) only the starts that may still be the cheapest are
    kept: once a later start costs no less than an earlier one, it never does again. Empty values cost nothing.
    """
    n, low = len(value), value.lower()
    rank, longest = dictionary(words)
    plain, per_char, near = low.translate(LEET), alphabet_bits(value), neighbours()
    spans: dict[int, list[tuple[int, float]]] = {}
    for i in range(n):
        if value[i].isdigit() and (m := DATE.match(value, i)):
            spans.setdefault(i, []).append((m.end(), DATE_BITS))
    for p in range(2, 9):
        for i, j in periodic(low, p):
            spans.setdefault(i, []).append((j, p * per_char + 1.5 * math.log2((j - i) / p)))
    best = [0.0] + [math.inf] * n
    brute = [0.0] + [math.inf] * n  # best cost that ends inside a brute-force span
    steps = (lambda a, b: a == b, lambda a, b: a + b in near, lambda a, b: abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum())
    starts: list[list[int]] = [[], [], []]
    for i in range(n):
        for k, step in enumerate(steps):
            if i and not step(low[i - 1], low[i]):
                starts[k] = []
        brute[i] = best[i] + SWITCH_BITS if not i else min(brute[i], best[i] + SWITCH_BITS)
        for word, extra in ((low, 0.0), (plain, 1.0)):
            for j in range(i + 2, min(n, i + longest) + 1):
                if r := rank.get(word[i:j]):
                    shift = 0.0 if value[i:j].islower() else 1.0 if value[i:j].istitle() or value[i:j].isupper() else j - i
                    best[j] = min(best[j], best[i] + SWITCH_BITS + math.log2(r + 1) + shift + extra)
        for j, bits in spans.get(i, ()):
            best[j] = min(best[j], best[i] + SWITCH_BITS + bits)
        brute[i + 1] = min(brute[i + 1], brute[i] + per_char)
        best[i + 1] = min(best[i + 1], brute[i + 1])
        for k in range(3):
            starts[k].append(i)
            open_ = [(best[a] + SWITCH_BITS + per_char + 1.5 * math.log2(i + 1 - a), a) for a in starts[k] if i + 1 - a >= 3]
            if open_:
                cost, at = min(open_)
                best[i + 1] = min(best[i + 1], cost)
                starts[k] = [a for a in starts[k] if a == at or i + 1 - a < 3 or (a < at and best[a] <= best[at])]
    return best[n]


def base_spans(text: str, lower: str | None = None) -> list[tuple[int, int, int]]:
    """(start, end, kind's index), code points, of the base patterns, by start, then kind."""
    lower = text.lower() if lower is None else lower
    out = []
    if any(w in lower for w in ASSIGN_WORDS):
        out += [(*m.span(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(*m.span(), 1) for m in ACCESS.finditer(text)]
    out += [(*m.span(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


def guess_spans(text: str, lower: str | None = None, words: str | None = None, min_bits: float = MIN_BITS, prose_bits: float = PROSE_BITS) -> list[tuple[int, int, int]]:
    """Spans of the values that cost too much to guess. Each run of characters is costed once, from its first credential word on."""
    lower = text.lower() if lower is None else lower
    if not any(w in lower for w in CONTEXT_WORDS):
        return []
    out, at, stop = [], 0, 0
    while m := CONTEXT.search(text, at):
        start = at = m.end()
        if start < stop:
            continue
        run = RUN.match(text, start)[0]
        stop, end = start + len(run), start + len(run.rstrip(".,;:!?)]}>|"))
        if end - start >= 8 and guess_bits(text[start:end], words) >= (prose_bits if m[1].strip(" ") == "" else min_bits):
            out.append((start, end, 3))
            at = stop
    return out


def find(text: str | None, words: str | None = None, **bits: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text (null: empty), each by start, then kind."""
    text = text or ""
    lower = text.lower()
    base = base_spans(text, lower)
    return base, sorted(base + guess_spans(text, lower, words, **bits), key=lambda s: (s[0], s[2]))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, of the first kind."""
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, words: str | None = None, **bits: float) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans, redacted (the text with spans replaced).

    One narrow pass over whole texts. A null text has no spans and stays null; a null doc_id stays null;
    repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
    words: the path of a rank file; bits: min_bits, prose_bits.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            n, sha, spans, clean = [[], [], [], []], [], [], []
            for text in b.column(1).to_pylist():
                base, every = find(text, words, **bits)
                for k in range(4):
                    n[k].append(sum(s[2] == k for s in every))
                sha.append(hashlib.sha256(said(base).encode()).hexdigest())
                spans.append(said(every))
                clean.append(redact(text, every) if every else text)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(clean, pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_guess", "base_sha256", "spans", "redacted"])

    return only(docs, doc_id="long", text="string").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string, redacted string")


def redacted_documents(docs: DataFrame, words: str | None = None, **bits: float) -> DataFrame:
    """The table with its columns, secrets in text replaced and n_chars (if there) counted anew.

    Keeps every row: a null text stays null (n_chars too), repeated rows stay repeated, an empty table stays empty.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            texts = [redact(t, s) if t and (s := find(t, words, **bits)[1]) else t for t in b.column("text").to_pylist()]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(texts, pa.string()))

    out = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        out = out.withColumn("n_chars", F.char_length("text").cast(kind))
    return out.select(docs.columns)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return scan(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("redacted")
