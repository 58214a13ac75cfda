"""Secret scan by dictionary-primed zstandard novelty.

Base kinds are patterns: assignments (assign), access keys (access) and long
hex runs (hex); their spans are always reported. The method adds spans of kind
`novel`: strings of at least MIN_NOVEL key characters, a letter among them, that
stand in a sensitive context (a word that holds a context word, within REACH
characters before them). In NAME=value the name is context and the value is the
candidate; if no part between such signs is reported, the whole string is a
candidate. A date is none.

Each candidate is priced as its marginal compressed bytes: the size of
surroundings and candidate less the size of the surroundings alone, both
compressed with a zstandard dictionary that is trained on source code. That
dictionary holds ordinary identifiers and, in its entropy tables, how often a
letter, capital or digit stands in code, so words cost about half a byte a
character and random strings nearly a whole one. A string of capitals only is
priced in lower case, as constants are words too. The surroundings are the AROUND
characters on both sides and a list of identifiers, so what they hold already
costs next to nothing. Candidates that cost at least NOVELTY bytes a byte are
reported, if they do not overlap a base span. The price of base spans is given
too.

The dictionary is not learned from the scanned table: a leaked key stands in
each copy of its document, and would become one of the table's identifiers.

Offsets are code points, ends exclusive. Spans are ordered by start, then kind
in the order assign, access, hex, novel.

Defined cases: a null text counts as empty; texts without secrets have zero
counts, an empty span list and the hash of the empty string. Null doc_ids and
repeated rows are passed along, one row out per row in. Long texts are read
whole in one pass over base spans and candidates together. Columns other than
doc_id and text are not read, whatever their names. No rows in, no rows out.
"""

from __future__ import annotations

import hashlib
import importlib
import inspect
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import batch, small, texts

#: The base patterns and the least length of what they must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "novel")

#: Words that make what follows them sensitive, and identifiers that ordinary code is made of.
CONTEXT = re.compile(r"(?:pass(?:word|wd|phrase)?|pwd|secret|token|api_?key|credential|private_?key|bearer|authorization|auth(?!or(?!i[sz]))|signature|access_?key)[A-Za-z0-9_]*", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
NAME_END = re.compile(r"(?<=[A-Za-z0-9_-])=(?=[^=])")
DATE = re.compile(r"\d{4}-\d\d-\d\d(?:T\d\d)?", re.ASCII)
IDENTIFIERS = (
    "username password passwd secret token api_key apiKey access_key private_key public_key client_id client_secret authorization bearer "
    "signature credential session cookie account config settings environment variable string integer boolean value return function class "
    "import package example placeholder your_api_key_here changeme REPLACE_ME abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 "
    "http://localhost https://www.example.com/index.html user@example.com true false null None self this "
)
#: Modules of the standard library whose source the dictionary is trained on: ordinary code, much of it about keys, sessions and hosts.
CODE = (
    "argparse ast base64 calendar collections configparser csv datetime email.message ftplib getpass hashlib hmac http.client http.cookiejar imaplib inspect "
    "json.decoder logging.config mailbox netrc os pathlib poplib random secrets shutil smtplib socket ssl string subprocess tarfile threading tokenize urllib.request uuid zipfile"
).split()
REACH, AROUND, MIN_NOVEL, NOVELTY = 64, 512, 12, 0.76
DICTIONARY_BYTES, SAMPLE_BYTES, LEVEL = 32_768, 2048, 3


@lru_cache(maxsize=1)
def code_dictionary() -> bytes:
    """The dictionary trained on CODE and IDENTIFIERS."""
    samples = []
    for name in CODE:
        source = inspect.getsource(importlib.import_module(name)).encode()
        samples += [source[at : at + SAMPLE_BYTES] for at in range(0, len(source), SAMPLE_BYTES)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, [*samples, IDENTIFIERS.encode()], level=LEVEL).as_bytes()


@lru_cache(maxsize=1)
def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False)


def novelty(text: str, start: int, end: int, dictionary: bytes | None = None) -> float:
    """Marginal compressed bytes of text[start:end] given what surrounds it, per byte of it."""
    size = lambda data: len(_compressor(dictionary or code_dictionary()).compress(data))
    around = f"{text[end : end + AROUND]}\n{IDENTIFIERS}\n{text[max(0, start - AROUND) : start]}".encode()
    own = text[start:end]
    own = (own.lower() if own.isupper() else own).encode()
    return (size(around + own) - size(around)) / max(1, len(own))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, base: list[tuple[int, int, int]], dictionary: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of further strings in a sensitive context that their surroundings do not predict."""
    found = []
    contexts = [m.end() for m in CONTEXT.finditer(text)]
    if not contexts:
        return found
    passed, reach = 0, 0  # base spans that start before the end of what is looked at, and the furthest end of them

    def novel(a: int, b: int) -> bool:
        nonlocal passed, reach
        while passed < len(base) and base[passed][0] < b:
            reach = max(reach, base[passed][2])
            passed += 1
        k = bisect_right(contexts, a)
        if b - a < MIN_NOVEL or not k or a > contexts[k - 1] + REACH or reach > a:
            return False
        own = text[a:b]
        return any(map(str.isalpha, own)) and not DATE.fullmatch(own) and novelty(text, a, b, dictionary) >= NOVELTY

    for m in CANDIDATE.finditer(text):
        a, b = m.start() + len(m[0]) - len(m[0].lstrip(".-=")), m.start() + len(m[0].rstrip(".-"))
        ends = [a + x.start() for x in NAME_END.finditer(text[a:b])]
        parts = [(s, e) for s, e in zip([a, *[x + 1 for x in ends]], [*ends, b]) if novel(s, e)]
        if not parts and ends and novel(a, b):
            parts = [(a, b)]
        found += [(s, 3, e) for s, e in parts]
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


#: Whether any of the patterns may match at all, told in one cheap pass each.
_MAYBE = re.compile(r"[0-9a-f]{24}|AKIA")
_WORDS = ("pass", "secret", "token", "key", "pwd", "credential", "bearer", "auth", "signature")


def scan(text: str, dictionary: bytes | None = None) -> tuple[int, int, int, str, str, list[float]]:
    """n_assign, n_access, n_hex, base_sha256, spans, novelty of each span."""
    low = text.lower()
    if any(w in low for w in _WORDS) or _MAYBE.search(text):
        base = base_spans(text)
        spans = sorted(base + novel_spans(text, base, dictionary))
    else:
        base = spans = []
    n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
    return *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans), [round(novelty(text, s, e, dictionary), 4) for s, _, e in spans]


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, novelty."""
    dictionary = code_dictionary()  # 32 kB, trained once

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            c = list(zip(*(scan(t, dictionary) for t in texts(b.column(1))))) or [()] * 6
            yield batch("doc_id n_assign n_access n_hex base_sha256 spans novelty", b.column(0), *[pa.array(x, pa.int64()) for x in c[:3]], *[pa.array(x, pa.string()) for x in c[3:5]], pa.array(c[5], pa.list_(pa.float64())))

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, novelty array<double>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(go, schema)
