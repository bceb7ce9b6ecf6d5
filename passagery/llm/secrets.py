"""Secret scan with a token-efficiency test.

Base patterns (assignments, access keys, hexadecimal strings) name the base spans. Beyond them, every long run of
token characters is encoded with a public vocabulary: prose and identifiers are made of long known pieces, random
strings fall apart into short ones, so few characters a token expose a secret. Known digests, UUIDs, numbers and rules
are excluded first; names and words are told by the test alone. A run is encoded in slices of bounded length, all of it.

What base spans and UUIDs cover is cut out, the rest of a run is tested. A rest that passes as a whole is tested again
piece by piece between its separators, and a long piece window by window, so that neither a path nor a prefix of plain
words hides a key.

Places are code points. Null and empty texts have no spans. Repeated rows are scanned each for itself. An empty table
gives no rows. Very long texts and runs are scanned whole. Spans that start together are ordered by kind. Columns other
than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ["assign", "access", "hex", "token"]
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
MIN_VALUE, MIN_ACCESS = 8, 16

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: fixed values: lengths of common digests in hexadecimal (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512)
DIGESTS = {32, 40, 56, 64, 96, 128}
KNOWN = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-9_=+/-]+"  # numbers and rules
    r"|(.)\1+")  # one character repeated
UUID = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
SEPARATORS = "+/_=-"
PIECE = re.compile(r"[A-Za-z0-9]{16,}")
SLICE, MOST_CHARS_PER_TOKEN = 256, 2.2
#: a piece of twice the shortest run is tested in windows of `WINDOW` tokens, which must be short all together
SHORTEST, WINDOW = 16, 12


@lru_cache(maxsize=1)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def chars_per_token(run: str, path: str) -> float:
    encode = encoder(path).encode_ordinary
    return len(run) / sum(len(encode(run[i:i + SLICE])) for i in range(0, len(run), SLICE))


def short_windows(piece: str, path: str) -> list[tuple[int, int]]:
    """(start, stop) of the stretches of a piece made of windows of tokens that are short together."""
    encoding, out, base = encoder(path), [], 0
    for i in range(0, len(piece), SLICE):
        tokens = encoding.encode_ordinary(piece[i:i + SLICE])
        ends = list(itertools.accumulate((len(encoding.decode_single_token_bytes(t)) for t in tokens), initial=0))
        for k in range(len(tokens) - WINDOW + 1):
            start, stop = base + ends[k], base + ends[k + WINDOW]
            if stop - start >= SHORTEST and stop - start <= MOST_CHARS_PER_TOKEN * WINDOW:
                if out and start <= out[-1][1]:
                    out[-1] = (out[-1][0], stop)
                else:
                    out.append((start, stop))
        base += ends[-1]
    return out


def random_parts(rest: str, path: str) -> list[tuple[int, int]]:
    """(start, stop) of what looks random in the rest of a run: all of it, else pieces, else stretches of long pieces."""
    if excluded(rest):
        return []
    if chars_per_token(rest, path) <= MOST_CHARS_PER_TOKEN:
        return [(0, len(rest))]
    out = []
    for m in PIECE.finditer(rest):
        if excluded(m[0]):
            continue
        if len(m[0]) < len(rest) and chars_per_token(m[0], path) <= MOST_CHARS_PER_TOKEN:
            out.append(m.span())
        elif len(m[0]) >= 2 * SHORTEST:
            out += [(m.start() + a, m.start() + b) for a, b in short_windows(m[0], path)]
    return out


def excluded(run: str) -> bool:
    """Known digests, identifiers, numbers and rules."""
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    return KNOWN.fullmatch(run) is not None


def base_spans(text: str) -> list[tuple[int, int, int, bool]]:
    out = [(0, *m.span(), True) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [(1, *m.span(), True) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    return out + [(2, *m.span(), True) for m in HEX.finditer(text)]


def rests(run: re.Match, covered: list[tuple[int, int]]) -> Iterator[tuple[int, str]]:
    """(start, characters) of the parts of a run outside the covered spans; cut parts lose the separators at their ends."""
    at = run.start()
    for start, stop in [*covered, (run.end(), run.end())]:
        part, left = run.string[at:start], at
        if covered:
            left += len(part) - len(part.lstrip(SEPARATORS))
            part = part.strip(SEPARATORS)
        if len(part) >= SHORTEST:
            yield left, part
        at = max(at, stop)


def scan(text: str, path: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, stop, base) by start, then kind. What base spans cover is not reported again."""
    base, added, at = base_spans(text), [], 0
    covered = sorted([(start, stop) for _, start, stop, _ in base] + [m.span() for m in UUID.finditer(text)])
    for run in RUN.finditer(text):
        while at < len(covered) and covered[at][1] <= run.start():
            at += 1
        upto = at
        while upto < len(covered) and covered[upto][0] < run.end():
            upto += 1
        for start, rest in rests(run, covered[at:upto]):
            added += [(3, start + a, start + b, False) for a, b in random_parts(rest, path)]
    return sorted(base + added, key=lambda s: (s[1], s[0]))


def find_secrets(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and `spans` of each row, an array of (kind, start, stop, base).

    Workers read the vocabulary from `path`, which must be the same place on every machine.
    """
    small_batches(docs.sparkSession)
    path = path or default_path()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = ["kind", "start", "stop", "base"]
        spans = pa.list_(pa.struct(list(zip(names, [pa.int32(), pa.int64(), pa.int64(), pa.bool_()]))))
        for batch in batches:
            found = [[dict(zip(names, s)) for s in scan(t or "", path)] for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(found, spans)], names=["doc_id", "spans"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:long,stop:long,base:boolean>>")


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")
