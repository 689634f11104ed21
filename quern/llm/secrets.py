"""Secret scan: an Aho-Corasick prefilter finds keywords, anchored expressions look only there, checksums decide.

The automaton reads each text once, lower-cased. At a keyword the expression of its kind is tried on
the original bytes, at that place only; as every expression begins with its keyword, this gives the
leftmost non-overlapping matches. Hexadecimal runs have no keyword of letters: the text is mapped to
two letters (hexadecimal or not) and the keyword is 32 times the one letter.

Base kinds: assign, access, hex. Added kinds, kept only where the embedded check holds: github and npm
(CRC-32 in base 62 in the last six characters), jwt (a header that decodes to an object with "alg"),
pem (a private key block whose body decodes).

Each kind's attempts read disjoint parts of a text, but for a constant, so time grows with its length whatever it holds.

Defined cases: null text is empty; empty texts give no spans; very long texts and runs are read whole, in linear time; repeated rows are judged each on their
own; an empty table gives an empty result; other columns are never looked at.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import id_and_text, id_type, lean, table

_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc(body: bytes) -> bytes:
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _DIGITS[k : k + 1] + out
    return out


def _crc_holds(m: re.Match[bytes]) -> bool:
    return base62_crc(m[1][:-6]) == m[1][-6:]


def _b64(part: bytes) -> bytes:
    return base64.urlsafe_b64decode(part + b"=" * (-len(part) % 4))


def _jwt_holds(m: re.Match[bytes]) -> bool:
    try:
        header = json.loads(_b64(m[1]))
        json.loads(_b64(m[2]))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and "alg" in header


def _pem_holds(m: re.Match[bytes]) -> bool:
    try:
        return len(base64.b64decode(b"".join(m[1].split()), validate=True)) >= 32
    except binascii.Error:
        return False


#: Kind: its keywords (lower case), its expression, what a match must satisfy, whether it is a base kind. In the order of the result.
KINDS: dict[str, tuple[tuple[str, ...], re.Pattern[bytes], Callable[[re.Match[bytes]], bool], bool]] = {
    "assign": (("password", "passwd", "secret", "token", "api_key", "apikey"), re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I), lambda m: len(m[2]) >= 8, True),
    "access": (("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16, True),
    "hex": ((), re.compile(rb"[0-9a-f]+"), lambda m: len(m[0]) >= 32, True),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_holds, False),
    "npm": (("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_holds, False),
    "jwt": (("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.(eyJ[A-Za-z0-9_-]+)\.[A-Za-z0-9_-]+"), _jwt_holds, False),
    "pem": (("-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]+)-----END (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----"), _pem_holds, False),
}
RANK = {kind: k for k, kind in enumerate(KINDS)}
_HEX = bytes(104 if 48 <= c <= 57 or 97 <= c <= 102 else 46 for c in range(256))
_HEX_RUN = b"h" * 32
_RUN = re.compile(rb"[A-Za-z0-9_-]*")


def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, (keywords, *_) in KINDS.items():
        for word in keywords:
            out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def scan(text: bytes, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start, then kind as listed."""
    found: list[tuple[int, int, str]] = []
    behind = dict.fromkeys(KINDS, 0)
    for end, (kind, length) in words.iter(text.lower().decode("latin-1")):
        at = end - length + 1
        if at < behind[kind]:
            continue
        if m := KINDS[kind][1].match(text, at):
            behind[kind] = m.end()
            if KINDS[kind][2](m):
                found.append((at, m.end(), kind))
        elif kind == "jwt":  # what begins later in this run ends where it ends, so it fails as well
            behind[kind] = _RUN.match(text, at).end()
    classes, at = text.translate(_HEX), 0
    while (at := classes.find(_HEX_RUN, at)) >= 0:
        end = KINDS["hex"][1].match(text, at).end()
        found.append((at, end, "hex"))
        at = end
    return sorted(found, key=lambda x: (x[0], RANK[x[2]]))


def code_points(text: bytes, found: list[tuple[int, int, str]]) -> list[dict]:
    """The same in code points."""
    if not found:
        return []
    if not text.isascii():
        at = {0: 0}
        last = 0
        for x in sorted({x for a, b, _ in found for x in (a, b)}):
            at[x] = at[last] + len(text[last:x].decode())
            last = x
        found = [(at[a], at[b], kind) for a, b, kind in found]
    return [{"kind": kind, "start": a, "end": b, "base": KINDS[kind][3]} for a, b, kind in found]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = automaton()
    for batch in batches:
        texts = (x.as_py() for x in batch.column("text").cast(pa.binary()))
        spans = [code_points(text, scan(text, words)) for text in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, _SPANS)], ["doc_id", "secrets"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, secrets: array of kind, start, end (code points, end exclusive), base."""
    return id_and_text(docs, id_col, text_col).mapInArrow(lean(_scan_batches), f"doc_id {id_type(docs, id_col)}, secrets array<struct<kind:string,start:long,end:long,base:boolean>>")


def op3_of(docs: DataFrame) -> DataFrame:
    found = find_secrets(docs)
    joined = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(joined(F.filter("secrets", lambda x: x["base"])).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_of(table(spark, sf_dir, "documents"))


_SQL_KINDS = {
    "assign": (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", "len(regexp_extract(v, '[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"),
    "access": ("AKIA[A-Z0-9]+", "len(v) >= 16"),
    "hex": ("[0-9a-f]{32,}", "true"),  # runs are maximal, so shorter ones are what would be dropped
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", "len(v) = 40 AND check_ = v[35:40]"),
    "npm": ("npm_[A-Za-z0-9]{36,}", "len(v) = 40 AND check_ = v[35:40]"),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "coalesce(json_valid(one) AND json_valid(two) AND json_type(one) = 'OBJECT' AND json_exists(one, '$.alg'), false)"),
    "pem": (r"-----BEGIN (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----[A-Za-z0-9+/=\x20\x09-\x0D]+-----END (?:[A-Z]{1,16} ){0,3}PRIVATE KEY-----", "coalesce(octet_length(body) >= 32, false)"),
}
_SQL_LISTS = " UNION ALL ".join(
    f"SELECT r, '{kind}' AS kind, {k} AS o, regexp_split_to_array(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m FROM d WHERE regexp_matches(t, '{pattern}')" for k, (kind, (pattern, _)) in enumerate(_SQL_KINDS.items())
)
_SQL_HOLDS = " ".join(f"WHEN '{kind}' THEN {holds}" for kind, (_, holds) in _SQL_KINDS.items())
_SQL_B64 = "TRY(decode(from_base64(translate({0}, '-_', '+/') || repeat('=', ((4 - len({0}) % 4) % 4)::INT))))"
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
k AS ({_SQL_LISTS}),
u AS (SELECT r, kind, o, unnest(m) AS v, unnest(range(1, len(m) + 1)) AS i, g, m FROM k),
s AS (SELECT r, kind, o, v, (list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::BIGINT AS a FROM u),
c AS (SELECT *, CASE WHEN kind IN ('github', 'npm') AND len(v) = 40 THEN xor(4294967295, list_reduce(list_transform(range(5, 35), lambda i: ord(v[i])::BIGINT), lambda c, b:
  list_reduce(list_transform(range(0, 8), lambda j: j::BIGINT), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END, xor(c, b)), 4294967295::BIGINT)) END AS crc FROM s),
f AS (SELECT *, array_to_string(list_transform(range(0, 6), lambda i: '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz'[(crc // (62 ** (5 - i))::BIGINT % 62)::INT + 1]), '') AS check_,
  CASE kind WHEN 'jwt' THEN {_SQL_B64.format("split_part(v, '.', 1)")} END AS one, CASE kind WHEN 'jwt' THEN {_SQL_B64.format("split_part(v, '.', 2)")} END AS two,
  CASE kind WHEN 'pem' THEN TRY(from_base64(regexp_replace(regexp_replace(v, '^-----BEGIN[A-Z ]*-----|-----END[A-Z ]*-----$', '', 'g'), '[\x20\x09-\x0D]+', '', 'g'))) END AS body FROM c),
h AS (SELECT r, kind, o, a, kind || ':' || a || ':' || (a + len(v)) AS x FROM f WHERE CASE kind {_SQL_HOLDS} END),
n AS (SELECT r, count(*) FILTER (o = 0) AS n0, count(*) FILTER (o = 1) AS n1, count(*) FILTER (o = 2) AS n2, string_agg(x, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(x, ',' ORDER BY a, o) AS spans FROM h GROUP BY r)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN n USING (r)
"""

QUERIES = {"op3_secrets": op3_secrets}
ORACLES = {"op3_secrets": ORACLE}
