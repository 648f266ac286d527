"""Secret scans: pattern kinds, and random strings shown by low token efficiency."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchment.llm.common import slices

# The kinds in their order, and the patterns of the first three.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
HEX = re.compile(r"[0-9a-f]{32,}")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]+")
SHORTEST = 16  # characters of a random string; as long as the shortest RUN
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
CALLED_DIGEST = re.compile(r"(?:md5|sha-?[0-9]*|digest|checksum|hash|etag|commit|revision|integrity)[^A-Za-z0-9]{0,4}\Z", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.IGNORECASE)
NAME = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4})(?:[-_/=+](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))*")
PART = re.compile(UUID.pattern + "|[A-Za-z0-9+]+", re.IGNORECASE)
NUMBER = re.compile(r"[-+0-9/_=]+")


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> tiktoken.Encoding:
    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(word: str, vocabulary: str, max_chars_per_token: float, before: str = "") -> bool:
    """Low characters per token, unless the string is a known digest, an identifier or a plain number.

    A digest is known by a word for one at the end of `before`, what stands before the string.
    """
    if DIGEST.fullmatch(word) and CALLED_DIGEST.search(before):
        return False
    if UUID.fullmatch(word) or NUMBER.fullmatch(word) or (NAME.fullmatch(word) and not word.isalpha()):
        return False
    if not re.search("[A-Za-z]", word):
        return False
    return len(word) < max_chars_per_token * len(encoder(vocabulary).encode_ordinary(word))


def hidden(word: str, vocabulary: str, max_chars_per_token: float) -> list[tuple[int, int]]:
    """Spans of random strings that words glued by '/', '=', '_' or '-' hide: neighbouring parts of few characters a token.

    Digests (parts of such a string are names of content), UUIDs and readable parts end a stretch,
    so that they neither hide nor join a neighbour.
    """
    spans, start, end = [], -1, -1
    for m in PART.finditer(word):
        part = m[0]
        known = DIGEST.fullmatch(part) or UUID.fullmatch(part)
        low = not known and len(part) < max_chars_per_token * len(encoder(vocabulary).encode_ordinary(part))
        if low and start < 0:
            start = m.start()
        if low:
            end = m.end()
        if start >= 0 and not low:
            spans.append((start, end))
            start = -1
    if start >= 0:
        spans.append((start, end))
    return [(a, b) for a, b in spans if b - a >= SHORTEST and is_random(word[a:b], vocabulary, max_chars_per_token)]


def find(text: str, vocabulary: str, max_chars_per_token: float) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span, sorted; code points, end exclusive."""
    spans = []
    low = text.lower()
    if any(word in low for word in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in RUN.finditer(text):  # longer strings of the other kinds lie within such runs
        a, b = run.span()
        if "AKIA" in run[0]:
            spans += [(a + m.start(), 1, a + m.end()) for m in ACCESS.finditer(run[0]) if m.end() - m.start() >= 16]
        if b - a >= 32:
            spans += [(a + m.start(), 2, a + m.end()) for m in HEX.finditer(run[0])]
        for m in CANDIDATE.finditer(run[0]):
            if m.end() - m.start() < SHORTEST:
                continue
            at = a + m.start()
            if is_random(m[0], vocabulary, max_chars_per_token, text[max(0, at - 24) : at]):
                spans.append((at, 3, a + m.end()))
            elif not DIGEST.fullmatch(m[0]):
                spans += [(at + i, 3, at + j) for i, j in hidden(m[0], vocabulary, max_chars_per_token)]
    return sorted(spans)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.tiktoken",
    max_chars_per_token: float = 2.0,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Base kinds are patterns. Spans of kind `random` are strings of 16 or more base64 letters,
    with a letter, that take so many tokens that a token covers fewer than `max_chars_per_token`
    characters, or such stretches of the parts that '/', '=', '_' and '-' make of longer strings.
    Left out are known digests (hexadecimal of a digest's length behind a word for one, as in
    "sha1: ...", or as part of a path), UUIDs, plain numbers and identifiers (words and short
    numbers joined by marks).

    Null and empty texts have no spans (spans '', base_sha256 of the empty string). Rows are
    independent: repeated rows give repeated results, a null id stays null, other columns are
    ignored. One pass without a shuffle; a task holds a slice of texts.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            counts, digests, spans = [[], [], [], []], [], []
            for text in batch.column("text").to_pylist():
                found = find(text, vocabulary, max_chars_per_token) if text else []
                for kind, count in enumerate(counts):
                    count.append(sum(x[1] == kind for x in found))
                digests.append(hashlib.sha256(written([x for x in found if x[1] < 3]).encode()).hexdigest())
                spans.append(written(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in counts[:3]), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(counts[3], pa.int64())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
            )

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", vocabulary: str = "byte_bpe_50k.tiktoken", max_chars_per_token: float = 2.0, mask: str = "[SECRET]") -> DataFrame:
    """`docs` with every span replaced by `mask` and the length set anew; overlapping spans share one mask.

    Rows without spans pass unchanged, null and empty texts included; no row goes, repeated ones
    are masked each, and other columns stay as they are. Without `length_col` only the text
    changes. An empty table gives an empty one.
    """
    at, n_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col in docs.columns else -1

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            columns = list(batch.columns)
            texts, lengths = columns[at].to_pylist(), columns[n_at].to_pylist() if n_at >= 0 else [0] * batch.num_rows
            for i, text in enumerate(texts):
                if text and (spans := find(text, vocabulary, max_chars_per_token)):
                    parts, reached, done = [], 0, -1
                    for start, _, end in spans:
                        if start >= done:
                            parts += [text[reached:start], mask]
                        done = reached = max(done, end)
                    texts[i] = "".join(parts) + text[reached:]
                    lengths[i] = len(texts[i])
            columns[at] = pa.array(texts, columns[at].type)
            if n_at >= 0:
                columns[n_at] = pa.array(lengths, columns[n_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)
