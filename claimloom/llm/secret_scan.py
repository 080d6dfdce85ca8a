"""Secret scans: an Aho-Corasick pass finds keywords, anchored patterns look only where one was hit,
and tokens that embed a checksum are kept only if it holds.

Kinds, in order: assign (a named value), access (an access key id), hex (a long lower-case
hexadecimal run), github and npm (tokens whose last six base-62 digits are the CRC-32 of the rest).
The keywords of hex are all runs of four hexadecimal digits: a run of 24 holds one at its start.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

from pyspark.sql import DataFrame

from claimloom.llm.common import fields, map_rows, texts

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

#: Names that introduce a secret, and the prefixes of checksummed tokens.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
GITHUB = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
HEX = "0123456789abcdef"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_CASE = {n: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in n) for n in ("password", "passwd", "secret", "token", "api", "key")}
ASSIGN = re.compile(rf"""(?:{_CASE["password"]}|{_CASE["passwd"]}|{_CASE["secret"]}|{_CASE["token"]}|{_CASE["api"]}_?{_CASE["key"]})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
RUN = re.compile(r"[0-9a-f]+")
GITHUB_TOKEN = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM_TOKEN = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
_LOWER = {c: c + 32 for c in range(65, 91)}


def base62(value: int, digits: int = 6) -> str:
    out = ""
    while value:
        value, d = divmod(value, 62)
        out = BASE62[d] + out
    return out.rjust(digits, "0")


def checksum_holds(body: str, check: str) -> bool:
    return base62(zlib.crc32(body.encode())) == check


def checksummed_token(prefix: str, body: str) -> str:
    return prefix + body + base62(zlib.crc32(body.encode()))


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for kind, words in (("hex", map("".join, itertools.product(HEX, repeat=4))), ("assign", NAMES), ("access", ("akia",)), ("github", GITHUB), ("npm", ("npm_",))):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def lowered(text: str) -> str:
    """`text` with A-Z lowered and each code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else text.translate(_LOWER)


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of every secret, by start, then kind.

    In each kind matches are leftmost and don't overlap; one that fails its test is dropped and what
    it covered is not looked at again.
    """
    found: list[tuple[int, int, int]] = []
    done = [0, 0, 0, 0, 0]
    for last, (kind, n) in automaton().iter(lowered(text)):
        at = last + 1 - n
        if kind == "hex":
            if at < done[2]:
                continue
            m = RUN.match(text, at)
            if m:
                done[2] = end = m.end()
                if end - at >= 24:
                    found.append((at, 2, end))
        elif kind == "assign":
            if at >= done[0] and (m := ASSIGN.match(text, at)):
                done[0] = m.end()
                if len(m[1]) >= 6:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if at >= done[1] and (m := ACCESS.match(text, at)):
                done[1] = m.end()
                if m.end() - at >= 20:
                    found.append((at, 1, m.end()))
        else:
            k = KINDS.index(kind)
            if at >= done[k] and not (at and text[at - 1].isalnum()) and (m := (GITHUB_TOKEN if k == 3 else NPM_TOKEN).match(text, at)):
                done[k] = m.end()
                if checksum_holds(m[1], m[2]):
                    found.append((at, k, m.end()))
    found.sort()
    return found


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every whole text: doc_id, secrets (array of kind, start, end in code points, end exclusive).

    Null and empty texts have none; repeated rows give repeated results, an empty table none; a very
    long text is read once, in time in proportion to it. Other columns are not read.
    """
    schema = fields(f"doc_id {df.schema[id_col].dataType.simpleString()}, secrets array<struct<kind:string,start:int,end:int>>")

    def make():
        def step(cols):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t)] for t in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "secrets": found}

        return step

    return map_rows(texts(df, id_col, text_col), schema, make)
