"""Secret scans: pattern spans plus a token-efficiency test for random strings."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from luminode.llm.common import replaced

# The base patterns of the contract, in the order in which kinds are listed.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_MIN = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_WORDS = ("passw", "secret", "token", "api")

# What is a known digest (hex lengths of MD5, SHA-1, SHA-2) or identifier.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
LEAST = 20
CANDIDATE = rf"[A-Za-z0-9+/_=-]{{{LEAST},}}"
UUID = r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
MAX_CHARS_PER_TOKEN = 2.25

SPANS = "array<struct<kind:string,start:int,end:int>>"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_tiktoken(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def left_over(text: str, start: int, end: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The parts of a run that base spans leave: of the run's least length, or of any where a hex or access span goes on in a letter or digit."""
    parts, at, glued = [], start, False
    for s, kind, e in [*(b for b in base if b[0] < end and start < b[2]), (end, 0, end)]:
        if at < s:
            before = kind > 0 and text[s - 1].isalnum()
            after = glued and text[at].isalnum()
            if s - at >= LEAST or before or after:
                parts.append((at, s))
        if e > at:
            at, glued = e, kind > 0
    return parts


def scanner(encode, max_ratio: float):
    """text -> [(start, kind index, end)] in the order of the contract."""
    assign, access, hexa = re.compile(ASSIGN, re.I | re.A), re.compile(ACCESS), re.compile(HEX)
    candidate, uuid = re.compile(CANDIDATE), re.compile(UUID)
    letter, not_hex = re.compile("[A-Za-z]"), re.compile("[^0-9A-Fa-f]")

    def is_known(word: str) -> bool:
        if not letter.search(word):
            return True  # numbers, rulers
        if not not_hex.search(word) and len(word) in DIGEST_LENGTHS:
            return True
        return uuid.fullmatch(word) is not None

    def scan(text: str) -> list[tuple[int, int, int]]:
        found = []
        lower = text.lower()
        if any(word in lower for word in ASSIGN_WORDS):
            found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= ASSIGN_MIN]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text)]
        words = [(m.start(), m.end()) for m in candidate.finditer(text)]
        # a run of 24 hex characters lies inside a run of 20 candidate characters
        for start, end in words:
            found += [(m.start(), 2, m.end()) for m in hexa.finditer(text, start, end)]
        base = sorted(found)
        for start, end in words:
            for left, right in left_over(text, start, end, base):
                word = text[left:right]
                if not is_known(word) and len(word) < max_ratio * len(encode(word)):
                    found.append((left, 3, right))
        return sorted(found)

    return scan


def scan_secrets(df: DataFrame, text: str = "text", into: str = "secrets", vocabulary: str = "byte_bpe_50k.tiktoken", max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Adds `into`: the spans (kind, start, end) of every secret in the whole text.

    Base kinds assign, access and hex come from their patterns. Kind random comes from the
    token-efficiency test: a run of 20 or more base64-like characters with fewer than
    max_chars_per_token characters per token, unless it is a known digest or identifier, or has no
    letter. Of a run that base spans overlap, the parts that they leave over are tested. Spans are ordered by start, then kind as listed; code points, end
    exclusive. Null and empty texts have an empty list; other columns pass; an input column
    named as `into` is replaced. Repeated rows are scanned each for itself.
    """

    def scan_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load_tiktoken(vocabulary_path(vocabulary)).encode_ordinary
        scan = scanner(encode, max_chars_per_token)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for texts in batches:
            yield pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(x.as_py() or "")] for x in texts], kind)

    udf = F.arrow_udf(annotated(scan_batches), SPANS)
    return replaced(df, **{into: udf(F.col(text))})


def annotated(function):
    """Annotations as objects, whatever the module's __future__ says."""
    function.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return function


def span_list(spans, kinds: tuple[str, ...]):
    """kind:start:end of the given kinds, comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(df: DataFrame, text: str = "text", spans: str = "secrets", mask: str = "[SECRET]") -> DataFrame:
    """Replaces every span (overlapping ones together) of text by mask; null texts stay null.

    Spans must be ordered by start, as scan_secrets gives them.
    """
    step = F.aggregate(
        F.col(spans),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(
            F.struct(
                F.when(s["start"] < acc["at"], acc["out"]).otherwise(
                    F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask))
                ).alias("out"),
                s["end"].alias("at"),
            )
        ),
    )
    masked = F.when(F.size(spans) == 0, F.col(text)).otherwise(F.concat(step["out"], F.substring(F.col(text), step["at"] + 1, F.length(text))))
    return df.withColumn(text, masked)
