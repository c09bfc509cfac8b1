"""Secret scan: fixed patterns plus the token-efficiency test.

A random string is spelt with many tokens: a vocabulary trained on ordinary
text has no long pieces for it. Strings of ``MIN_LENGTH`` or more key
characters whose characters-per-token ratio is at most ``MAX_RATIO`` are
reported as kind ``token``, unless they are a known digest (hex of a digest
length, UUID) or an identifier (numbers, or letters in ordinary casing, joined by
separators or followed by a number, of which words make up half at least). Where parts of up to
three letters that are no words, and numbers, make up more, the whole string's ratio decides. The fixed patterns (kinds ``assign``,
``access``, ``hex``) always stay; what they leave of a longer string is tested
like a string of its own.

Offsets are code points, end exclusive, over the whole match. Null and empty
texts have no spans. Repeated rows are scanned one by one; a null ``doc_id``
is carried through; other columns of the input are ignored by ``scan`` and
kept as they are by ``redact``. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tally.llm.common import map_arrow, text_or_empty

MIN_LENGTH, MAX_RATIO = 20, 2.2
VOCABULARY = "byte_bpe_50k.tiktoken"
MASK = "[SECRET]"

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "token")
ASSIGN_VALUE = 6

CANDIDATE = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}")
DIGEST = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{48}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}"
                    r"|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"
                    r"|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$")
SEPARATORS = re.compile(r"[+/_=-]+")
#: An ordinary part of an identifier: lower, UPPER, Capitalised or camelCase, then at most a short number; or a number.
SHORT = 3   # letters in a row that are no word
LETTERS = re.compile(rf"[A-Za-z]{{{SHORT + 1},}}")
PART = re.compile(r"(?:[a-z]+|[A-Z]+|[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*)?[0-9]{0,6}|[0-9]+")


@lru_cache(maxsize=1)
def encoder(name: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file; loaded once per worker."""
    import public_tokenizers as files
    import tiktoken
    with open(files.path(name), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(name, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def tokens(string: str) -> int:
    return len(encoder().encode_ordinary(string))


def is_identifier(string: str) -> bool:
    """Ordinary parts that are numbers alone, or that words make up for the most part: longer runs of letters, which
    together pass the token-efficiency test (in small letters or as they are), and short parts that are a
    token as a word of their own, half of all letters and digits at least."""
    parts = SEPARATORS.split(string)
    if not all(map(PART.fullmatch, parts)):
        return False
    if not any(map(str.isalpha, string)):
        return True
    runs = LETTERS.findall(string)
    covered = sum(map(len, runs))
    if runs and covered <= MAX_RATIO * sum(min(tokens(r), tokens(r.lower())) for r in runs):
        return False
    short = sum(len(p) for p in parts if len(p) <= SHORT and p.isalpha() and tokens(" " + p.lower()) == 1)
    return 2 * (covered + short) >= sum(map(str.isalnum, string))


def looks_random(string: str) -> bool:
    """The token-efficiency test of one candidate."""
    if DIGEST.match(string) or is_identifier(string):
        return False
    return len(string) <= MAX_RATIO * tokens(string)


def token_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out = []
    k = 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(base) and base[k][2] <= at:   # neither this nor a later candidate touches it
            k += 1
        rest = []
        j = k
        while j < len(base) and base[j][0] < end:
            rest.append((at, base[j][0]))
            at, j = max(at, base[j][2]), j + 1
        rest.append((at, end))
        out += [(s, 3, e) for s, e in rest if e - s >= MIN_LENGTH and looks_random(text[s:e])]
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def all_spans(text: str) -> list[tuple[int, int, int]]:
    base = base_spans(text)
    return sorted(base + token_spans(text, base))


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """``text`` with each run of overlapping spans replaced by ``mask``."""
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts, digest of the base spans, all spans, their number by the method."""
    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column("text").to_pylist():
            base = base_spans(text)
            extra = token_spans(text, base)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2),
                         hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + extra)), len(extra)))
        cols = list(zip(*rows)) if rows else [()] * 6
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id")] + [pa.array(c, t) for c, t in zip(cols, types)],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_token"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), one,
                     "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_token long")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by ``MASK``; ``n_chars`` follows where there is one.

    All rows and columns stay; a null text stays null.
    """
    def one(texts: pa.Array) -> pa.Array:
        each = (t.as_py() for t in texts)      # one text at a time
        return pa.array([t if t is None else masked(t, all_spans(t)) for t in each], pa.string())

    hide = F.arrow_udf(one, "string")
    out = docs.withColumn("text", hide(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars"))
                             .otherwise(F.length("text")).cast(kind))
    return out.select(*docs.columns)
