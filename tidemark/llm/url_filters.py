"""URL filters by a bit-parallel wildcard automaton.

Glob rules become one extended Shift-And automaton: a bit per pattern position,
packed into 64-bit words, so one shift, one mask and one self-loop term advance
all patterns over one byte of many URLs at once.

In a glob `**` stands for any bytes, `*` for any bytes but "/", `?` for one byte
but "/"; all else is literal. Patterns cover the whole canonical URL, which is
the host with A-Z lower-cased, followed by the path.

A null URL, or one without "://", has an empty host and path and is judged as
such. Repeated URLs get equal results; an empty table gives an empty result. Of
fitting rules of one length, and of fitting globs, the first counts. A batch takes
as many steps as its longest URL has bytes, and only URLs that are that long take
part in the last of them. Batches are cut so that states of all patterns fit in
STATE_WORDS. Input columns clashing with an output name are replaced by the output.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append

_HOST, _PATH = re.compile(rb"[^/?#]*"), re.compile(rb"[^?#]*")
_TOKENS = re.compile(rb"\*\*|\*|\?|.", re.S)
#: Words of state that a batch of URLs holds, and rows of a table of rules that are read.
STATE_WORDS, MOST_RULES = 1 << 21, 100_000


@dataclass(frozen=True)
class Rule:
    """A host with its subdomains, and the start of a path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.name}**", f"*.{self.name}**"


class Automaton:
    """All globs at once; pattern i is accepted where bit i of match() is set."""

    def __init__(self, globs: list[str]):
        parsed = [_TOKENS.findall(g.encode()) for g in globs]
        states = [1 + sum(t not in (b"*", b"**") for t in p) for p in parsed]
        self.words = max(1, -(-sum(states) // 64))
        step = np.zeros((256, self.words), np.uint64)
        loop = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for p in parsed:
            bit = lambda i: (i // 64, np.uint64(1) << np.uint64(i % 64))
            w, b = bit(at)
            self.start[w] |= b
            for token in p:
                w, b = bit(at)
                if token == b"**":
                    loop[:, w] |= b
                elif token == b"*":
                    loop[np.arange(256) != 47, w] |= b
                else:
                    at += 1
                    w, b = bit(at)
                    step[np.arange(256) != 47 if token == b"?" else token[0], w] |= b
            self.final.append(bit(at))
            at += 1
        self.step, self.loop = step, loop

    def match(self, found: list[bytes]) -> np.ndarray:
        """Boolean array: URL by pattern. Long URLs stay in the run after short ones ended."""
        n = len(found)
        size = np.fromiter(map(len, found), np.int64, n)
        order = np.argsort(-size, kind="stable")
        size = size[order]
        flat = np.frombuffer(b"".join([found[i] for i in order]), np.uint8)
        begin = np.cumsum(size) - size
        state = np.tile(self.start, (n, 1))
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for t in range(int(size[0]) if n else 0):
            live = int(np.searchsorted(-size[:live], -t, side="left"))
            byte = flat[begin[:live] + t]
            s = state[:live]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:live] = (moved & self.step[byte]) | (s & self.loop[byte])
        out = np.zeros((n, len(self.final)), bool)
        for i, (w, b) in enumerate(self.final):
            out[order, i] = (state[:, w] & b) != 0
        return out


def canonical(url: str | None) -> tuple[bytes, bytes]:
    """(host, path) of a URL."""
    _, found, rest = (url or "").encode().partition(b"://")
    if not found:
        return b"", b""
    host = _HOST.match(rest).group()
    return host.lower(), _PATH.match(rest, len(host)).group()


FIELDS = [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]


def judge(df: DataFrame, rules: list[Rule], globs: list[tuple[str, str]], default: str = "allow", column: str = "url") -> DataFrame:
    """df with host, path, rule and verdict.

    Of the rules that fit the longest decides (of equal ones the first). Where
    none fits, rule is null and the first fitting glob of (verdict, glob) pairs
    decides, else the default.
    """
    rules = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([g for r in rules for g in r.globs] + [g for _, g in globs])
    names = np.array([r.name for r in rules] + [None], object)
    verdicts = np.array([r.verdict for r in rules] + [v for v, _ in globs] + [default], object)

    def compute(batch: pa.RecordBatch):
        parts = [canonical(u) for u in batch.column(batch.schema.get_field_index(column)).to_pylist()]
        hit = automaton.match([h + p for h, p in parts])
        n = len(rules)
        fits = np.concatenate([hit[:, : 2 * n].reshape(len(parts), n, 2).any(axis=2), hit[:, 2 * n :], np.ones((len(parts), 1), bool)], axis=1)
        first = fits.argmax(axis=1)
        text = lambda x: pa.array(x, pa.string())
        return text([h.decode() for h, _ in parts]), text([p.decode() for _, p in parts]), text(names[np.minimum(first, n)].tolist()), text(verdicts[first].tolist())

    return append(df, FIELDS, compute, rows=max(64, min(8192, STATE_WORDS // automaton.words)))


def rule_pack(table: DataFrame) -> tuple[list[Rule], list[tuple[str, str]]]:
    """(rules, globs) from rows of verdict, host, path and pattern, in order of pattern and host.

    A row with a pattern is a glob, any other a rule of host and path. The table is
    collected and sent to every task: more than MOST_RULES rows are an error.
    """
    found = table.select("verdict", "host", "path", "pattern").limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"a pack of rules has at most {MOST_RULES} rows")
    found.sort(key=lambda r: (r.pattern or "", r.host or "", r.path or "", r.verdict))
    return [Rule(r.verdict, (r.host or "").lower(), r.path or "") for r in found if not r.pattern], [(r.verdict, r.pattern) for r in found if r.pattern]


#: The rules of the query, and what the method blocks beyond them.
RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]
GLOBS = [
    ("block", g)
    for g in (
        "*ads-*.**", "ads.**", "ad.**", "adserver*.**", "*banner*.**", "*spam-*.**", "*casino-*.**", "*-casino.**", "*free-bets*.**", "*poker-*.**", "*cheap-pills*.**", "*pharma-sale*.**", "*tracker*.**",
        "*/login", "*/login/**", "*/signin/**", "*/cart/**", "*/checkout/**", "*/wp-admin/**", "*/cgi-bin/**", "**/feed.xml", "**/sitemap*.xml", "**.exe", "**.zip",
    )
]


def as_pattern(glob: str) -> str:
    """The glob as a regular expression over the whole canonical URL."""
    kinds = {b"**": ".*", b"*": "[^/]*", b"?": "[^/]"}
    return "".join(kinds.get(t) or re.escape(t.decode()) for t in _TOKENS.findall(glob.encode()))


_BLOCKED = "|".join(as_pattern(g) for _, g in GLOBS)
ORACLE = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM cut
), named AS (
  SELECT page_id,
    translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM parts
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule
  FROM named
)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_full_match(host || path, '{_BLOCKED}', 's') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""
